"""Small expected results for typing, tables, views, changes and jobs."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnql.functions import typing as ty
from cairnql.operators import relational as rel
from cairnql.operators import stats, views
from cairnql.operators.dml import ConstraintViolation
from cairnql.operators.mapreduce import MapReduceJob
from cairnql.plans.engine import Engine
from cairnql.sources import schema as ddl
from cairnql.sources import store
from cairnql.streaming import views as live

GENERAL = """CREATE TABLE p1 (id INTEGER DEFAULT 0 NOT NULL, descr VARCHAR(300), num INTEGER, ratio FLOAT, PRIMARY KEY (id));
CREATE TABLE p1_decimal (id INTEGER NOT NULL, cash DECIMAL NOT NULL, credit DECIMAL NOT NULL, ratio FLOAT NOT NULL, PRIMARY KEY (id));
PARTITION TABLE p1 ON COLUMN id;"""
PEOPLE = """CREATE TABLE people (part INTEGER NOT NULL, id INTEGER NOT NULL, age INTEGER, salary FLOAT, children INTEGER, PRIMARY KEY (id));
CREATE VIEW matpeople (age, num, salary, children) AS SELECT age, COUNT(*), SUM(salary), SUM(children) FROM people WHERE age > 5 GROUP BY age;"""


@pytest.fixture
def general(spark, tmp_path):
    return Engine(spark, str(tmp_path), GENERAL, log=True)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_grouped_counts(general):
    for ids, num in ((range(1, 4), 100), (range(6, 8), 300), ((8,), 500)):
        general.tables["p1"].insert_values(*[(i, "d", num, 14.5) for i in ids])
    assert rows(general.sql("SELECT num, COUNT(*) FROM p1 GROUP BY num")) == [(100, 3), (300, 2), (500, 1)]


def test_limit_counts_only_rows_that_pass(general):
    general.tables["p1"].insert_values((1, "d", -1, 1.0), (2, "d", 100, 1.0), (3, "d", 100, 1.0))
    assert general.sql("SELECT * FROM p1 WHERE id < num LIMIT 2").count() == 2


def test_cross_join_with_range(spark):
    a = spark.createDataFrame([(i,) for i in (1, 2, 3, 6, 7, 8)], "id int")
    for low, n in ((2, 30), (3, 24), (6, 18)):
        assert a.crossJoin(a.where(F.col("id") >= low).select(F.col("id").alias("other"))).count() == n


def test_aggregates_keep_types(spark):
    df = spark.createDataFrame([(i, i // 2, Decimal(10)) for i in range(10)], "id int, num int, cash decimal(38,12)")
    out = df.agg(F.count("num"), F.sum("num"), F.min("num"), F.max("num"), ty.typed_avg(df, "num").alias("avg"), ty.typed_avg(df, "cash").alias("cash"))
    assert tuple(out.first()) == (10, 20, 0, 4, 2, Decimal("10.000000000000"))
    assert out.schema["avg"].dataType == T.IntegerType() and out.schema["cash"].dataType == T.DecimalType(38, 12)
    empty = df.limit(0)
    assert tuple(empty.agg(F.count("*"), F.sum("num"), ty.typed_avg(df, "num")).first()) == (0, None, None)


def test_decimals_truncate(spark):
    df = spark.createDataFrame([(Decimal("0.9999999999999"), Decimal(1)), (Decimal("-1"), Decimal(3))], "a decimal(24,13), b decimal(24,12)")
    q = df.select(ty.dec_div(F.col("a").cast("decimal(24,12)"), F.col("b"))).collect()
    assert q[1][0] == Decimal("-0.333333333333")


def test_decimal_updates(general):
    t = general.tables["p1_decimal"]
    t.insert_values((26, Decimal("307473.174514"), Decimal("289429.605067"), 0.971903320295135486617))
    skip = F.col("cash") != Decimal("88687.224073")
    assert t.update(skip, cash=ty.dec_mul(F.col("cash"), F.lit(5))) == 1
    assert t.update(skip, cash=F.col("cash") + Decimal("5.5")) == 1
    assert t.read().first()["cash"] == Decimal("1537371.372570000000")


def test_types_that_may_not_meet():
    assert ty.promote(T.ByteType(), T.IntegerType()) == T.LongType()
    assert ty.promote(T.DecimalType(10, 2), T.LongType()) == ty.DECIMAL
    for a, b in ((T.StringType(), T.LongType()), (T.DecimalType(38, 12), T.DoubleType())):
        with pytest.raises(ty.TypeMismatch):
            ty.promote(a, b)


def test_sentinels_become_null(spark):
    df = spark.createDataFrame([(-(1 << 31), -1.7e308), (5, 1.0)], "a int, b double")
    assert rows(ty.from_sentinels(df)) == [(5, 1.0), (None, None)]


def test_negative_limits_are_refused(spark):
    with pytest.raises(ValueError):
        rel.limit(spark.range(5), -1)
    assert rel.limit(spark.range(20), 10).count() == 10


def test_unions_need_equal_columns(spark):
    with pytest.raises(TypeError):
        rel.union_all(spark.range(1), spark.createDataFrame([("x",)], "a string"))


def test_constraints_leave_the_table_alone(general):
    t = general.tables["p1"]
    t.insert_values((1, "a", 1, 1.0))
    for bad in ([(1, "b", 2, 2.0)], [(2, "b", 2, 2.0), (2, "c", 2, 2.0)], [(None, "b", 2, 2.0)]):
        with pytest.raises(ConstraintViolation):
            t.insert_values(*bad)
    with pytest.raises(ConstraintViolation):
        t.update(None, id=F.col("id") + 1)
    assert rows(t.read()) == [(1, "a", 1, 1.0)]
    assert t.insert_values(("x",), columns=["descr"]) == 1 and t.read().where("id = 0").count() == 1


def test_changes_and_log(general):
    t = general.tables["p1"]
    t.insert_values(*[(i, "d", i, 0.5) for i in range(6)])
    assert t.update("num >= 4", num=F.lit(None)) == 2
    assert t.delete("num > 1") == 2  # a null condition is not true
    assert t.delete() == 4
    assert rows(t.changes().groupBy("op", "txn").count()) == [("DELETE", 2, 2), ("DELETE", 3, 2), ("DELETE", 4, 4), ("INSERT", 1, 6), ("INSERT", 2, 2)]


def test_view_through_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path), PEOPLE)
    t = e.tables["people"]
    t.insert_values((1, 1, 31, 27500.20, 7), (1, 2, 31, 28920.99, 3), (1, 3, 32, 63250.01, -1), (1, 4, 2, 1.0, 0), (1, 5, None, 1.0, 0))
    assert rows(e.relation("matpeople").select("age", "num", "children")) == [(31, 2, 10), (32, 1, -1)]
    t.delete("id = 1")
    assert rows(e.relation("matpeople")) == [(31, 1, 28920.99, 3), (32, 1, 63250.01, -1)]
    t.update("id = 3", age=31, salary=F.lit(None))
    assert rows(e.relation("matpeople").select("age", "num", "children")) == [(31, 2, 2)]
    t.delete("id = 2")
    assert rows(e.relation("matpeople")) == [(31, 1, None, -1)]


def test_view_grammar():
    for bad in ("SELECT age, SUM(salary) FROM people GROUP BY age", "SELECT age, COUNT(*), AVG(salary) FROM people GROUP BY age", "SELECT COUNT(*), age FROM people GROUP BY age"):
        with pytest.raises(ddl.DDLError):
            ddl.parse(f"CREATE VIEW v AS {bad}")


def test_views_take_filters_that_are_true_only(spark):
    _, made = ddl.parse("CREATE VIEW v (k, n) AS SELECT k, COUNT(*) FROM t WHERE x > 1 GROUP BY k")
    df = spark.createDataFrame([(1, None), (1, 2), (2, 1)], "k int, x int")
    assert rows(views.result(made["v"], views.build(made["v"], df))) == [(1, 1)]


def test_procedures_catalog_and_snapshots(general, tmp_path):
    t = general.tables["p1"]
    t.insert_values((1, "a", 1, 1.0), (2, "b", 2, 2.0))
    general.procedure("get", "SELECT descr FROM p1 WHERE id = ?", single_partition=True)
    general.procedure("both", lambda e, k: e.sql("SELECT * FROM p1 WHERE num >= :k", k=k))
    assert rows(general.call("GET", 2)) == [("b",)] and general.call("both", 1).count() == 2
    general.snapshot("s")
    t.delete()
    general.restore("s")
    assert t.read().count() == 2
    assert general.catalog().where("relation = 'p1'").count() == 4
    assert store.Snapshots(general.spark, f"{tmp_path}/_snapshots").scan() == {"s": ["p1", "p1_decimal"]}
    general.dump(f"{tmp_path}/dump")
    assert store.read_csv(general.spark, f"{tmp_path}/dump/p1", t.table.schema).count() == 2
    t.store.vacuum()
    assert t.read().count() == 2


def test_csv_with_a_generated_first_column(spark, tmp_path):
    store.write_csv(spark.createDataFrame([("a",), ("b",)], "s string"), f"{tmp_path}/c", header=False)
    df = store.read_csv(spark, f"{tmp_path}/c", T.StructType.fromDDL("n long, s string"), header=False, generate_first=True)
    assert df.columns == ["n", "s"] and df.select("n").distinct().count() == 2


def test_jobs_stream_each_key_once(spark):
    calls = spark.createDataFrame([(i % 3, i) for i in range(1000)], "k long, v long")
    job = MapReduceJob("SELECT * FROM {t}", "k long, v long", "k long, n long, top long", lambda r: [(r["k"], r["v"])] * 2, lambda k, vs: [(k, len(x := [v for _, v in vs]), max(x))])
    assert rows(job.run(spark, t=calls)) == [(0, 668, 999), (1, 666, 997), (2, 666, 998)]


def test_histograms(spark):
    h = stats.histogram(spark.createDataFrame([(x,) for x in (1, 1, 2, 5, 5)], "x int"), "x")
    assert rows(stats.extremes(h)) == [(1, 5, 2, 1, 5, 3)]
    assert rows(stats.put(h, h.where("value = 5"), -1)) == [(1, 2), (2, 1)]
    assert rows(stats.values_for_count(h, 2)) == [(1,), (5,)]


def test_histograms_as_the_dialect_measures_them(spark):
    h = stats.histogram(spark.createDataFrame([(x,) for x in (1, 1, 2, 5, 5)], "x int"), "x")
    total, mean, sd = stats.moments(h).first()
    assert (total, mean) == (14, 2.8) and abs(sd - 4.2**0.5) < 1e-12
    assert stats.moments(h.where("value = 2"))._jdf is not None and str(stats.moments(h.where("value = 2")).first()["stdev"]) == "nan"
    of = lambda p: stats.percentile(h, p).first()[0]
    assert (of(0.5), of(0.1), of(0.6), of(1.0)) == (2.0, 1.0, pytest.approx(3.2), 5.0)
    assert rows(stats.weighted_values(h, 1)) == [(1,), (1,), (2,), (5,), (5,)]
    assert [tuple(r) for r in stats.sorted_values(h).collect()] == [(1, 2), (5, 2), (2, 1)]
    assert rows(stats.spread_values(h)) == sorted([(1, -1.0), (2, 0.0), (5, 1.0)], key=repr)


def test_ranks_in_slices(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("string").alias("v"))
    got = {r["v"]: r["k"] for r in rel.ranked(df, "v", "k", slices=20, small=10).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}
    assert rows(rel.ranked(spark.createDataFrame([(None,), (3,), (1,)], "v int"), "v", "k", 2, 1)) == sorted([(None, 0), (1, 1), (3, 2)], key=repr)


def test_changes_as_text(general):
    one = lambda *a: general.sql(*a).first()["modified_tuples"]
    assert one("INSERT INTO p1 VALUES (1, 'it''s; where', 5, 1.5), (2, NULL, 6, 2.5)") == 2
    assert one("insert into p1 (descr, id) values (?, ?)", "a ? 'b' \\ c", 3) == 1
    assert one("INSERT INTO p1 (id, num) SELECT id + 10, num FROM p1 WHERE num IS NOT NULL") == 2
    assert one("UPDATE p1 SET num = num + ?, descr = 'x = y WHERE z' WHERE id > 1 AND num >= ?", 1, 6) == 2
    assert rows(general.sql("SELECT id, descr, num FROM p1 WHERE id IN (1, 2, 3)")) == sorted([(1, "it's; where", 5), (2, "x = y WHERE z", 7), (3, "a ? 'b' \\ c", None)], key=repr)
    assert one("UPSERT INTO p1 (id, num) VALUES (3, 30), (4, 40)") == 2
    assert one("DELETE FROM p1 WHERE num > 6") == 4
    assert one("DELETE FROM p1") == 2 and general.tables["p1"].read().isEmpty()
    for bad in ("INSERT INTO p1 (id) VALUES (1, 2)", "UPDATE p1 num = 1", "INSERT INTO p1 (id) VALUES (?)"):
        with pytest.raises(ValueError):
            general.sql(bad)
    with pytest.raises(ConstraintViolation):
        general.sql("INSERT INTO p1 (id) VALUES (NULL)")


def test_typed_functions_in_sql(general):
    q = "SELECT int_div(-7, 2), dec_div(-1, 3), dec_mul(0.0000001, 0.0000019), difference('Robert', 'Rubin'), difference(NULL, 'a')"
    assert tuple(general.sql(q).first()) == (-3, Decimal("-0.333333333333"), Decimal("0E-12"), 2, 0)


def test_random_numbers(spark):
    from cairnql.functions import random as rnd

    df = spark.range(20_000)
    flat = [r[0] for r in df.select(rnd.flat(F.col("id"), 5, 15, 1)).collect()]
    assert set(flat) == set(range(5, 15)) and all(1700 < flat.count(x) < 2300 for x in range(5, 15))
    assert flat == [r[0] for r in df.repartition(3).orderBy("id").select(rnd.flat(F.col("id"), 5, 15, 1)).collect()]
    bell = [r[0] for r in df.select(rnd.gaussian(F.col("id"), 0, 100)).collect()]
    assert min(bell) >= 0 and max(bell) < 100 and abs(sum(bell) / len(bell) - 50) < 1 and sum(25 <= x < 75 for x in bell) > 0.66 * len(bell)
    hot = [r[0] for r in df.select(rnd.hot_warm_cold(F.col("id"), 0, 1000, 70, 5, 20, 15)).collect()]
    assert abs(sum(x < 50 for x in hot) / 20_000 - 0.7) < 0.02 and abs(sum(50 <= x < 200 for x in hot) / 20_000 - 0.2) < 0.02
    hist = spark.createDataFrame([("a", 1), ("b", 3)], "value string, count long")
    drawn = dict(rows(rnd.from_histogram(df, F.col("id"), hist).groupBy("value").count()))
    assert rows(rnd.from_histogram(df, F.col("id"), hist, few=0).select("id", "value")) == rows(rnd.from_histogram(df, F.col("id"), hist).select("id", "value"))
    assert set(drawn) == {"a", "b"} and abs(drawn["b"] / 20_000 - 0.75) < 0.02


def test_routing_numbers(spark):
    """Against 32-bit arithmetic in Python, for negative, wide and null keys and beyond ASCII."""
    signed = lambda x: (x + 2**31) % 2**32 - 2**31
    longs = [0, 1, -1, 2**31 + 1, -(2**31) - 7, 2**62 + 12345, -(2**63), 2**63 - 1, None]
    texts = ["", "a", "héllo wörld \U0001f600", "z" * 300, None]

    def of_long(v):
        return 0 if v is None else abs(signed((v ^ (v % 2**64 >> 32)) % 2**32)) % 10

    def of_text(t):
        h = 0
        for b in (t or "").encode():
            h = signed(31 * h + (b - 256 if b > 127 else b))
        return abs(h) % 10

    got = spark.createDataFrame([(i, v) for i, v in enumerate(longs)], "i int, v long").orderBy("i").select(rel.hash_partition("long", F.col("v"), 10)).collect()
    assert [r[0] for r in got] == [of_long(v) for v in longs]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string").orderBy("i").select(rel.hash_partition("string", F.col("v"), 10)).collect()
    assert [r[0] for r in got] == [of_text(t) for t in texts]


def test_partition_methods(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    for method, n in (("hash", 4), ("range", 4), ("random", 4)):
        assert rel.partitioned(df, method, n, "k").count() == 100
    assert rel.partitioned(df, "none", 4).count() == rel.partitioned(df, "replication", 4).count() == 100
    with pytest.raises(ValueError):
        rel.partitioned(df, "other", 4)
    parts = [r[0] for r in df.select(rel.combined_partition([F.col("id"), F.col("k")], 5)).collect()]
    assert set(parts) == set(range(5))


def test_snapshot_status_and_settings(general):
    general.load("p1", general.spark.createDataFrame([(1, "a", 1, 1.0)], "id int, descr string, num int, ratio double"))
    general.snapshot("s")
    status = store.Snapshots(general.spark, f"{general.path}/_snapshots").status().collect()
    assert {(r["snapshot"], r["table"]) for r in status} == {("s", "p1"), ("s", "p1_decimal")} and all(r["bytes"] > 0 for r in status)
    general.configure(spark__sql__maxMetadataStringLength="321")
    assert general.configuration().where("name = 'spark.sql.maxMetadataStringLength'").first()["value"] == "321"


def test_stream_batch_counts_once(spark, tmp_path):
    view = ddl.View("v", "t", [("k", "k")], "n", [("SUM", "x", "s")])
    data = spark.createDataFrame([(1, 2), (1, 3), (2, None)], "k int, x int")
    data.write.parquet(f"{tmp_path}/in")
    kept = store.VersionedTable(spark, f"{tmp_path}/view", views.delta(view, data.limit(0)).schema)
    for _ in range(2):
        stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
        live.maintain(view, stream, kept, f"{tmp_path}/cp").awaitTermination()
    assert rows(views.result(view, kept.read())) == [(1, 2, 5), (2, 1, None)]
    data.write.mode("append").parquet(f"{tmp_path}/in")
    live.maintain(view, spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), kept, f"{tmp_path}/cp").awaitTermination()
    assert rows(views.result(view, kept.read())) == [(1, 4, 10), (2, 2, None)]


def test_a_batch_that_comes_again_is_not_counted(spark, tmp_path):
    view = ddl.View("v", "t", [("k", "k")], "n", [])
    data = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    kept = store.VersionedTable(spark, f"{tmp_path}/view", views.delta(view, data.limit(0)).schema)
    for source, number in (("a", 0), ("a", 0), ("a", 1), ("b", 0), ("a", 1), ("b", 0)):
        live.merge_batch(view, kept, source, data, number)
    assert rows(kept.read()) == [(1, 6), (2, 3)]


def test_plans_push_down_and_aggregate_in_part(spark, sf):
    from cairnql.plans.queries import QUERIES

    plan = QUERIES["mr_q1"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "partial_sum" in plan and "l_orderkey" not in plan.split("ReadSchema")[1]
    joined = QUERIES["broadcast_join"](spark, sf)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in joined
