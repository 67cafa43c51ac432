"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names for every operator."""

import public_tokenizers
import pytest
from helpers import CLASHING, awkward, documents
from pyspark.sql import functions as F

from cairnql.llm import langid, mixing, neardup_vectors, packing, pii, sharding, simhash, tokencount, topk, toxicity

BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def label_rows(spark, docs):
    return docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")


def langs(docs):
    return langid.predict(docs, langid.fit(docs, F.lit(True), steps=3))


OPERATORS = {
    "kd_shards": lambda spark, d: sharding.kd_shards(d, leaves=5),
    "mix": lambda spark, d: mixing.mix(d),
    "pack": lambda spark, d: packing.pack(packing.pieces(d, BPE)),
    "toxicity": lambda spark, d: toxicity.score(d, toxicity.learn(d, label_rows(spark, d), F.lit(True))),
    "language": lambda spark, d: langs(d),
    "token_counts": lambda spark, d: tokencount.token_counts(d, RANKS),
    "pii": lambda spark, d: pii.sanitise(d),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_documents(spark, name):
    """Every row has its result, with or without columns of clashing names."""
    rows = awkward()
    plain = OPERATORS[name](spark, documents(spark, rows)).collect()
    keys = ("id", "doc_id")
    of = lambda out: sorted(str(next(r[k] for k in keys if k in r)) for r in out)
    seen = of(plain)
    if name in ("pack", "token_counts"):  # one row per piece or section
        assert set(seen) == {str(r[0]) for r in rows} and len(seen) >= len(rows)
    else:
        assert seen == sorted(str(r[0]) for r in rows)
    clash = OPERATORS[name](spark, documents(spark, rows, clash=True))
    assert of([r.asDict() if hasattr(r, "asDict") and "doc_id" in r else r for r in clash.select("doc_id" if "doc_id" in clash.columns else "id").collect()]) == seen
    if "doc_id" in clash.columns:  # operators that pass all columns through
        made = {"toxicity": {"toxicity"}, "language": {"lang_pred", "lang_score"}, "pii": {"pii_spans", "pii_text"}}[name]
        for c in set(CLASHING) - made:
            assert clash.select(c).distinct().collect() == [(f"own {c}",)]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    out = OPERATORS[name](spark, documents(spark, []))
    assert out.collect() == [] and out.columns


def test_filters_of_the_pipeline_keep_columns(spark):
    rows = awkward()
    d = documents(spark, rows, clash=True)
    for out in (simhash.dedup(d), mixing.mixed(d)):
        assert out.columns == d.columns
        assert {r[0] for r in out.select("h").distinct().collect()} == {"own h"}
    assert simhash.dedup(documents(spark, [])).collect() == []
    assert mixing.mixed(documents(spark, [])).collect() == []


VECTORS = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.01]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]),
    (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 0.0]), (10, []), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]),
]


def vectors(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", *[F.lit("own").alias(c) for c in CLASHING]) if clash else df


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_vectors_link(spark, clash):
    out = neardup_vectors.near_duplicates(vectors(spark, VECTORS, clash)).collect()
    got = sorted(((r["id"], r["n_links"], r["component"]) for r in out), key=str)
    want = [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (4, 1, 4), *[(i, 0, i) for i in (5, 6, 7, 8, 9, 10, 11)], (None, 0, None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_vectors_search(spark, clash):
    out = topk.top_k(vectors(spark, VECTORS, clash), F.col("vec_id").isin(1, 4, 5, 11), k=3).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out)
    # ties go to the smaller id; null, empty and non-finite vectors take no part; another id's repeated rows count each
    assert got == [(1, 1, 2, 65536), (1, 2, 3, 65536), (1, 3, 4, 0), (4, 1, 3, 512), (4, 2, 1, 0), (4, 3, 2, 0)]


def test_no_vectors(spark):
    assert neardup_vectors.near_duplicates(vectors(spark, [])).collect() == []
    assert topk.top_k(vectors(spark, []), F.lit(True)).collect() == []
    assert topk.top_k(vectors(spark, VECTORS), F.lit(False)).collect() == []
