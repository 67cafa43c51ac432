"""The corpus pipeline, stage by stage, against plain Python."""

import public_tokenizers
import pytest
from helpers import awkward, documents, smallest_in_component
from pyspark.sql import functions as F
from test_pii import brute_spans
from test_simhash import brute_fingerprint, near

import corpus_pipeline
from cairnql.llm import common, packing


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input of each stage, and the last output."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(common.save(f(spark, out[-1], sf)))
    return out


def test_stages_and_their_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "PII", "mixing sources", "best-fit packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert all(df.count() > 0 for df in stages)


def test_language_rejects_little_and_fills_in(stages):
    before = {r["doc_id"]: r for r in stages[0].collect()}
    after = {r["doc_id"]: r for r in stages[1].collect()}
    prose = {i for i, r in before.items() if r["text"] and sum(map(str.isalpha, r["text"])) > 0.6 * len(r["text"]) and r["lang"]}
    assert len(set(after) & prose) >= 0.99 * len(prose)
    assert all(r["lang"] is not None for r in after.values())
    assert all(any(map(str.isalpha, r["text"])) for r in after.values())


def test_one_document_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    top = smallest_in_component(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near(fps[a], fps[b])])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(set(top.values()))


def test_personal_data_goes_and_documents_stay(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        for _, a, b in brute_spans(before[i]):
            assert before[i][a:b] not in r["text"]


def test_mix_and_packing(stages):
    kept = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    mixed = {r[0]: r[1] for r in stages[4].groupBy("doc_id").count().collect()}
    assert set(mixed) <= set(kept) and set(mixed.values()) <= {1, 2}
    pieces = packing.pieces(stages[4], public_tokenizers.path("word_bpe_49k.json"))
    a, b = (sorted(map(tuple, x.collect())) for x in (pieces, stages[5].select("doc_id", "piece", "start", "length", "ids_crc32")))
    assert a == b
    ends = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n > 2048 OR n <> end").isEmpty()


def test_awkward_and_empty_inputs(spark, sf):
    for rows in (awkward(), []):
        docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
        for _, f in corpus_pipeline.STAGES:
            docs = common.save(f(spark, docs, sf))
        assert rows == [] and docs.isEmpty() or docs.count() > 0


def test_run_is_the_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1].count()
