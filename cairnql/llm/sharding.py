"""K-d tree sharding by distributed weighted medians.

Every node of the tree is split along its widest metadata dimension at the weighted median
of its rows, until each leaf holds the target bytes.  The medians of all nodes of a level
are located together: a histogram of weights over the node's key range names the bin that
holds the median, and only that bin is refined.  Rows are never sorted; state per node is
one row of a small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnql.operators.relational import ranked

from .common import positions, save, small_side

HASH_BITS = 42
COORD = (1 << 20) - 1
BINS = 4096
BROADCAST_NODES = 100_000


def metadata_dimensions(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Default dimensions: log of the text's length and, where the table has them, source and language."""
    out = {"length": F.log2(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(1.0))}
    kinds = dict(docs.dtypes)
    return out | {name: F.col(name) for name in ("source", "lang") if kinds.get(name) == "string"}


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """A string column as the rank of its value among the distinct ones, in code point order; null stays."""
    own = f"{column}_of"
    values = save(ranked(save(rows.select(F.col(column).alias(own)).dropna().distinct()), own, "_rank"))
    return rows.join(small_side(values), F.col(column) == F.col(own), "left").drop(column, own).withColumnRenamed("_rank", column)


def _small(nodes: DataFrame, leaves: int) -> DataFrame:
    return F.broadcast(nodes) if leaves <= BROADCAST_NODES else nodes


def kd_shards(
    docs: DataFrame,
    *,
    leaves: int | None = None,
    target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: (id, size, crc, shard, slot).

    ``size`` is the UTF-8 bytes of the text plus 1 (null: 1), ``crc`` its unsigned CRC-32
    (null: that of the empty text).  Either ``leaves`` shards are made or as many as give
    each ``target_bytes``.  A node of k leaves splits so that k // 2 of its weight's k parts
    go left.  A dimension of strings counts as their ranks; nulls and NaNs count as the
    smallest value of a dimension.  Rows with equal
    coordinates are told apart by a hash of id and text, so that a third of all rows may be
    alike; only wholly repeated rows (same id, same text) stay together.  ``slot`` numbers a
    shard's rows from 0 without a gap.  Very long texts weigh what they are, and one may
    outweigh a shard.  An empty table gives no rows; columns that no dimension reads may have
    any names.
    """
    dims = dimensions or metadata_dimensions(docs, text_col)
    kinds = [kind for _, kind in docs.select(*dims.values()).dtypes]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = save(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            *[(c if kinds[i] == "string" else F.nanvl(c.cast("double"), F.lit(None))).alias(f"c{i}") for i, c in enumerate(dims.values())],
        )
    )
    for i, kind in enumerate(kinds):
        if kind == "string":
            raw = _numbered(raw, f"c{i}")
    if "string" in kinds:
        raw = save(raw.select("id", "size", "crc", *[F.col(f"c{i}").cast("double").alias(f"c{i}") for i in range(len(dims))]))
    n_dims = len(dims)
    span = raw.agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
        *[f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(n_dims) for f in (F.min, F.max)],
    ).first()
    if not leaves:
        leaves = max(1, math.ceil((span["bytes"] or 0) / (target_bytes or 1 << 30)))
    tie = F.shiftrightunsigned(F.xxhash64("id", "crc", "size"), 64 - HASH_BITS)

    def key(i: int) -> Column:
        lo, hi = span[f"min{i}"], span[f"max{i}"]
        wide = lo is not None and hi > lo
        at = F.coalesce(((F.col(f"c{i}") - F.lit(lo)) / F.lit(hi - lo) * COORD).cast("long"), F.lit(0)) if wide else F.lit(0).cast("long")
        return (F.shiftleft(at, HASH_BITS) + tie).alias(f"k{i}")

    rows = raw.select("id", "size", "crc", *[key(i) for i in range(n_dims)], F.lit(0).cast("long").alias("node"), F.lit(leaves).alias("k"))
    for _ in range(math.ceil(math.log2(leaves)) if span["n"] and leaves > 1 else 0):
        rows = save(rows)
        rows = _split(rows, n_dims, leaves)
    out = rows.select("id", "size", "crc", F.col("node").cast("int").alias("shard"))
    return positions(save(out), "shard", ["id", "crc", "size"], "slot", span["n"])


def _split(rows: DataFrame, n_dims: int, leaves: int) -> DataFrame:
    """Split every node of more than one leaf once."""
    width = F.array(*[F.shiftright(F.max(f"k{i}"), HASH_BITS) - F.shiftright(F.min(f"k{i}"), HASH_BITS) for i in range(n_dims)])
    ends = F.array(*[F.struct(F.min(f"k{i}").alias("lo"), F.max(f"k{i}").alias("hi")) for i in range(n_dims)])
    nodes = rows.where("k > 1").groupBy("node", "k").agg(F.sum("size").alias("total"), width.alias("w"), ends.alias("e"))
    state = save(
        nodes.selectExpr("node", "k", "total * (k div 2) / k AS want", "cast(array_position(w, array_max(w)) AS int) AS dim", "e")
        .selectExpr("node", "want", "dim", "e[dim - 1].lo AS lo", "e[dim - 1].hi AS hi", "0L AS before", "0L AS inside")
    )
    own = F.element_at(F.array(*[F.col(f"k{i}") for i in range(n_dims)]), F.col("dim"))
    while not state.where("lo < hi").isEmpty():
        at = rows.join(_small(state.withColumnRenamed("node", "_node"), leaves), F.col("node") == F.col("_node")).withColumn("key", own)
        hist = (
            at.where("key BETWEEN lo AND hi")
            .withColumn("bin", F.expr(f"(key - lo) div ((hi - lo) div {BINS} + 1)"))
            .groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        )
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        old = state.selectExpr("node", "want", "dim", "before")
        state = save(
            hist.withColumn("cum", F.sum("w").over(upto)).join(_small(old, leaves), "node")
            .where("before + cum >= want AND before + cum - w < want")
            .selectExpr("node", "want", "dim", "lo", "hi", "before + cum - w AS before", "w AS inside")
        )
    cut = state.selectExpr("node AS _node", "dim", "CASE WHEN want - before < before + inside - want THEN lo ELSE lo + 1 END AS cut")
    placed = rows.join(_small(cut, leaves), F.col("node") == F.col("_node"), "left").withColumn("right", own >= F.col("cut"))
    half = F.expr("k div 2").cast("int")
    return placed.select(
        "id", "size", "crc", *[f"k{i}" for i in range(n_dims)],
        F.when(F.col("k") == 1, F.col("node")).when(F.col("right"), F.col("node") + half).otherwise(F.col("node")).alias("node"),
        F.when(F.col("k") == 1, F.lit(1)).when(F.col("right"), F.col("k") - half).otherwise(half).cast("int").alias("k"),
    )
