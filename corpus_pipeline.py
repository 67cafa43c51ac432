"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnql.llm import common, langid, mixing, packing, pii, simhash
from cairnql.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if some language has this mean probability, or where many are known this many times an even share.
CONFIDENCE, TIMES_EVEN = 0.35, 1.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that no language fits; fills in missing languages.

    Where no document has a language there is nothing to learn from, and all with a letter stay.
    """
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    net = langid.fit(docs, ~held_out)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    named = langid.predict(docs, net)
    sure = min(CONFIDENCE, TIMES_EVEN / len(net.languages))
    kept = named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= sure))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id."""
    return simhash.dedup(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it give way to marks; no document goes."""
    clean = pii.sanitise(docs)
    return clean.select("doc_id", F.col("pii_text").alias("text"), "lang", "source", F.length("pii_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in sequences of at most 2048."""
    import public_tokenizers

    out = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("crc", "ids_crc32")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir))
    return docs
