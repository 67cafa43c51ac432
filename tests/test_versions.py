"""Changes file by file, in one commit with log and views; the driver's entry without the training-data operators."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnql.operators import relational as rel
from cairnql.operators.dml import ConstraintViolation
from cairnql.plans.engine import Engine
from cairnql.plans.statements import StatementError

SHOP = """CREATE TABLE t (id BIGINT NOT NULL, k INTEGER, PRIMARY KEY (id));
CREATE VIEW v (k, cnt, ids) AS SELECT k, COUNT(*), SUM(id) FROM t GROUP BY k;"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), SHOP, log=True)
    for lo in (0, 100, 200):
        e.load("t", spark.range(lo, lo + 100).selectExpr("id", "CAST(id % 3 AS int) AS k").coalesce(1))
    return e


def consistent(e):
    assert rows(e.relation("v")) == rows(e.relation("t").groupBy("k").agg(F.count(F.lit(1)), F.sum("id")))
    log = e.tables["t"].changes()
    alive = log.groupBy("id", "k").agg(F.sum(F.when(F.col("op") == "INSERT", 1).otherwise(-1)).alias("n")).where("n <> 0").select("id", "k")
    assert rows(alive) == rows(e.relation("t"))


def test_a_change_of_one_key_writes_one_file(engine):
    t = engine.tables["t"]
    before = set(t.store.manifest)
    assert len(before) == 3
    assert engine.sql("UPDATE t SET k = 9 WHERE id = 150").first()[0] == 1
    assert len(before & set(t.store.manifest)) == 2
    before = set(t.store.manifest)
    assert t.delete("id = 7") == 1
    assert len(before - set(t.store.manifest)) == 1
    before = set(t.store.manifest)
    t.merge(engine.spark.createDataFrame([(250, 1), (900, 1)], "id long, k int"))
    assert len(before - set(t.store.manifest)) == 1
    assert t.update("id = 12345", k=1) == 0 == t.delete("id < 0")
    consistent(engine)


@pytest.mark.parametrize("change", ["UPDATE t SET k = 5 WHERE id < 150", "DELETE FROM t WHERE id = 3", "INSERT INTO t VALUES (777, 1)", "DELETE FROM t", "UPSERT INTO t VALUES (5, 8)"])
def test_a_failure_before_the_commit_changes_nothing(engine, monkeypatch, change):
    t = engine.tables["t"]
    was, log, view = rows(engine.relation("t")), rows(t.changes()), rows(engine.relation("v"))

    def fails(old, new):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(t.store.files, "rename", fails)
        with pytest.raises(OSError):
            engine.sql(change)
    assert (rows(engine.relation("t")), rows(t.changes()), rows(engine.relation("v"))) == (was, log, view)
    engine.sql(change)
    consistent(engine)


def test_a_lost_rename_is_an_error(engine):
    with pytest.raises(Exception, match="does not exist|cannot rename"):
        engine.tables["t"].store.files.rename(f"{engine.path}/nothing", f"{engine.path}/something")


def test_reopening_goes_on_where_the_last_change_was(engine):
    state = engine.tables["t"].store.note["views"]["v"]
    again = Engine(engine.spark, engine.path, SHOP, log=True)
    assert again.tables["t"].txn == 3 and again.tables["t"].store.note["views"]["v"] == state  # not built again
    again.sql("DELETE FROM t WHERE id = 5")
    assert again.tables["t"].txn == 4 and rows(again.tables["t"].changes().select("txn").distinct()) == [(1,), (2,), (3,), (4,)]
    consistent(again)


def test_restore_is_a_logged_change(engine):
    engine.snapshot("s")
    engine.sql("DELETE FROM t WHERE id > 50")
    engine.restore("s")
    assert engine.relation("t").count() == 300
    consistent(engine)


def test_refused_changes_leave_no_files(engine):
    t = engine.tables["t"]
    with pytest.raises(ConstraintViolation):
        t.insert_values((5, 1))
    with pytest.raises(ConstraintViolation):
        t.update("id < 2", id=F.lit(1))
    assert engine.relation("t").count() == 300
    consistent(engine)


def test_merge_text(engine):
    engine.attach(s=engine.spark.createDataFrame([(1, 50), (999, 51)], "id long, n int"))
    merge = "MERGE INTO t USING s ON t.id = s.id"
    assert engine.sql(f"{merge} WHEN MATCHED THEN UPDATE SET k = t.k + s.n").first()[0] == 1
    assert engine.sql(f"{merge} WHEN NOT MATCHED THEN INSERT (id, k) VALUES (s.id, s.n)").first()[0] == 1
    assert rows(engine.sql("SELECT * FROM t WHERE id IN (1, 999)")) == [(1, 51), (999, 51)]
    engine.attach(s=engine.spark.createDataFrame([(1, 50), (1, 51)], "id long, n int"))
    with pytest.raises(ConstraintViolation):  # two rows for one
        engine.sql(f"{merge} WHEN MATCHED THEN UPDATE SET k = s.n")
    with pytest.raises(StatementError):
        engine.sql(f"{merge} WHEN NOT MATCHED THEN INSERT (id, k) VALUES (s.id)")
    consistent(engine)


def test_interval_join_of_wide_and_empty_intervals(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(-20, 50)], "i int, x double")
    spans = [(0, 3.0, 3.0), (1, -5.5, 40.0), (2, 9.0, 8.0), (3, -1e9, 1e9), (4, 0.5, 0.75), (5, None, 3.0), (6, 15.0, 16.0)]
    b = spark.createDataFrame(spans, "j int, lo double, hi double")
    got = rows(rel.interval_join(a, b, F.col("x"), F.col("lo"), F.col("hi"), 5).select("i", "j"))
    assert got == sorted(((i, j) for i in range(-20, 50) for j, lo, hi in spans if lo is not None and lo <= i <= hi), key=repr)


def test_interval_join_of_many_rows_with_one_interval(spark):
    """Rows that share an interval meet only the keys within it, not those of its bucket."""
    a = spark.range(20_000).selectExpr("id AS i", "id % 1000 + 0.5D AS x")
    b = spark.range(3000).selectExpr("id AS j", "id % 10 * 100D AS lo").withColumn("hi", F.col("lo") + 0.5)
    out = rel.interval_join(a, b, F.col("x"), F.col("lo"), F.col("hi"), 100)
    assert out.count() == 20 * 3000
    steps, made = [out._jdf.queryExecution().executedPlan()], []
    steps[0].execute().count()
    while steps:
        plan = steps.pop()
        if plan.nodeName() == "Generate":
            made.append(plan.metrics().apply("numOutputRows").value())
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
        steps += inner + [plan.children().apply(i) for i in range(plan.children().size())]
    assert sorted(made) == [10, 20_000]


def test_interval_join_of_odd_intervals(spark):
    inf, nan = float("inf"), float("nan")
    keys = [-inf, -1e300, -7.0, -0.0, 0.0, 1e-12, 0.1, 0.30000000000000004, 1.0, 5.0, 1e15, 1e300, inf, nan, None]
    spans = [(0.0, 0.0), (-0.0, 0.1), (0.1, 0.1), (0.3, 0.30000000000000004), (-inf, inf), (-inf, -1e300), (1.0, nan), (inf, inf), (-1e300, 1e300), (1e15, 1e15), (nan, nan), (0.0, 1e-12), (5.0, 1.0), (0.99, 5.01), (None, None)]
    a = spark.createDataFrame(list(enumerate(keys)), "i int, x double")
    b = spark.createDataFrame([(j, *s) for j, s in enumerate(spans)] * 2, "j int, lo double, hi double")
    want = rows(a.crossJoin(b).where("x >= lo AND x <= hi").select("i", "j"))
    assert rows(rel.interval_join(a, b, F.col("x"), F.col("lo"), F.col("hi"), 5).select("i", "j")) == want
    far = 1 << 62
    a = spark.createDataFrame([(far + 1,), (-far * 2,), (7,)], "x long")
    b = spark.createDataFrame([(far + 1, far + 1), (far + 2, far + 3), (-far * 2, far), (7, 7)], "lo long, hi long")
    assert rows(rel.interval_join(a, b, F.col("x"), F.col("lo"), F.col("hi"), 5)) == rows(a.crossJoin(b).where("x >= lo AND x <= hi"))


def test_places_of_many_slices(spark):
    df = spark.createDataFrame([(i * 7919 % 1000 if i % 9 else None, i) for i in range(3000)], "a int, b int")
    out = rel.placed(df, [F.col("a"), F.col("b")], "place", rows=100).orderBy("place").collect()
    assert [r["place"] for r in out] == list(range(1, 3001))
    assert [(r["a"], r["b"]) for r in out] == sorted(((r["a"], r["b"]) for r in out), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))


def test_places_in_even_slices(spark):
    """A slice a task, and none much larger than asked for."""
    df = spark.range(60_000).selectExpr("id * 7919 % 60000 AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x' END AS s")
    out = rel.placed(df, [F.col("s"), -F.col("a")], "place", rows=2000)
    got = out.withColumn("task", F.spark_partition_id()).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 60_001))
    assert [(r["s"], r["a"]) for r in got] == sorted(((r["s"], r["a"]) for r in got), key=lambda t: (t[0] is not None, -t[1]))
    sizes = Counter(r["task"] for r in got)
    assert len(sizes) >= 24 and max(sizes.values()) < 3500


@pytest.mark.parametrize("gone", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    """With their files removed, or with a library of theirs missing."""
    top = Path(__file__).parent.parent
    for name in ("cairnql", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (top / name).is_dir() else shutil.copy)(top / name, tmp_path / name) if (top / name).exists() else None
    if gone:
        shutil.rmtree(tmp_path / "cairnql/llm", ignore_errors=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    else:
        (tmp_path / "xxhash.py").write_text("raise ImportError('absent')")
    run = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == int(out[1]) > 100 and out[2] == "False"


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from cairnql.session import shared_folder

    def at(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder or d), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(at("yarn", "hdfs:///x/")) == "hdfs:///x" and shared_folder(at("local[4]")) is None
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(at(master))
