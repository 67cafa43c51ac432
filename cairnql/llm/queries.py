"""The thin ``opN_<name>`` queries over the driver tables, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnql.session import ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    out = kd_shards(_documents(spark, sf_dir), leaves=16)
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup_vectors import near_duplicates

    out = near_duplicates(_embeddings(spark, sf_dir))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(_documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, pieces

    out = pack(pieces(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    out = score(docs, lexicon)
    return out.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    out = predict(docs.select("doc_id", "text"), fit(docs, ~held_out))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import token_counts

    out = token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.withColumnRenamed("id", "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, sanitise

    out = sanitise(_documents(spark, sf_dir).select("doc_id", "text"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    is_kind = lambda k: lambda s: s["kind"] == k
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    return out.select(
        "doc_id",
        *[F.size(F.filter("pii_spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii_spans", one), ",").alias("spans"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(_documents(spark, sf_dir))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kd_shards, op2_embedding_neardup, op3_mix_sources, op4_best_fit_packing, op5_toxicity, op6_language, op7_topk, op8_token_counts, op9_pii, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    from .mixing import MIX_SQL
    from .neardup_vectors import NEAR_SQL
    from .topk import TOP_K_SQL

    return {
        "op2_embedding_neardup": NEAR_SQL,
        "op7_topk": TOP_K_SQL,
        "op3_mix_sources": "WITH " + MIX_SQL.format(docs="documents")
        + " SELECT id AS doc_id, size, source_size, target, size * copies AS taken FROM mixed",
    }
