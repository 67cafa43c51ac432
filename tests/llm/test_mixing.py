"""The mix against DuckDB and its own laws."""

import duckdb
import pytest
from helpers import awkward, documents, prose

from cairnql.llm import mixing, queries


def both(spark, rows):
    d = documents(spark, rows)
    got = [tuple(r) for r in mixing.mix(d).select("id", "source", "size", "source_size", "target", "copies").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows) if rows else None
    want = con.sql("WITH " + mixing.MIX_SQL.format(docs="documents") + " SELECT id, source, size, source_size, target, copies FROM mixed").fetchall()
    return sorted(got, key=str), sorted(want, key=str)


def test_awkward_rows_match_sql(spark):
    got, want = both(spark, awkward())
    assert got == want


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 400, "c": 30, None: 3, "d": 900}, {"only": 50}, {"a": 0, "b": 0}, {"z": 100, "\U0001f600": 100, "￮": 100}])
def test_sources_of_many_shapes(spark, sizes):
    rows = [(1000 * k + i, prose(i, 10 + i % 5) if n else "", None, s) for k, (s, n) in enumerate(sizes.items()) for i in range(max(1, n // 4))]
    got, want = both(spark, rows)
    assert got == want
    taken = {}
    for _, s, size, total, target, copies in got:
        assert 0 <= copies <= 2
        t = taken.setdefault(s, [0, target, total, 0])
        t[0] += size * copies
        t[3] = max(t[3], size)
    for took, target, total, longest in taken.values():
        assert target <= 2 * total and abs(took - target) <= longest / 2 + 1e-6
    everything = sum(t[2] for t in taken.values())
    capped = [t for t in taken.values() if t[1] == 2 * t[2]]
    if len(capped) < len(taken):
        assert sum(t[1] for t in taken.values()) == pytest.approx(1.5 * everything)


def test_mixes_of_growing_shares_are_nested(spark):
    d = documents(spark, [(i, prose(i, 12), None, "ab"[i % 2]) for i in range(200)])
    mixes = [{r["id"]: r["copies"] for r in mixing.mix(d, percent=p).collect()} for p in (40, 80, 120)]
    assert all(a[i] <= b[i] for a, b in zip(mixes, mixes[1:]) for i in a)


def test_documents_come_as_often_as_the_mix_says(spark):
    rows = awkward()
    d = documents(spark, rows)
    want = sum(r["copies"] for r in mixing.mix(d).collect())
    assert mixing.mixed(d).count() == want
    once = {r["id"]: r["copies"] for r in mixing.mix(d).where("id >= 50").collect()}
    got = {r[0]: r[1] for r in mixing.mixed(d).where("doc_id >= 50").groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in once.items() if n}


def test_query_runs_without_python_workers(spark, sf):
    plan = queries.op3_mix_sources(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query_reruns_agree(spark, sf):
    a, b = (sorted(map(tuple, queries.op3_mix_sources(spark, sf).collect())) for _ in range(2))
    assert a == b
