"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a fixed 60-bit hash.  A source's part of a mix is the set of its
documents with hashes up to a threshold, so mixes of growing budgets are nested and a rerun
gives the same mix.  The threshold is found by summing sizes over hash buckets and refining
only the bucket in which the budget ends; rows are filtered, never sorted.

Null and empty texts have size 0 and are never taken more often than ``whole`` says.  Very
long texts count all their words; a source ends within half a document of its target.
Repeated rows have one hash and are taken alike.  An empty table gives no rows.  Columns of
clashing names pass through where all columns do.  The table of sources, one row each, is
ordered in one task; all else is distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

HASH_BITS, STEP = 60, 10
WORDS = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 100_000


def words(text_col: str = "text") -> Column:
    """Words of a text: runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def hash60(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits of the MD5 of the id; a null id takes the text's place-holder digest instead."""
    seed = F.coalesce(F.col(id_col).cast("string"), F.md5(F.encode(F.col(text_col), "UTF-8")), F.lit(""))
    return F.conv(F.substring(F.md5(F.encode(seed, "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], percent: int, cap: int) -> DataFrame:
    """Rows (source, total) to rows (source, total, target).

    Sources in code point order, null last, weigh ``weights`` over and over.  They share
    ``percent`` % of all sizes by weight; a target stops at ``cap`` times its source's size
    and the excess goes to the others by weight until none is above.  In the order of size
    over weight the capped sources come first, so one pass of running sums gives the level.
    The table has one row per source.
    """
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("n", n).withColumn("w", F.element_at(w, F.col("n") % len(weights) + 1))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("total") / F.col("w")).asc(), F.col("n").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "source", "total", "n", "w",
        F.sum("total").over(everything).alias("every"), F.sum("w").over(everything).alias("wall"),
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias("capped"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("wcapped"),
    )
    # all in hundredths: what is left to share, and the weights that still share it
    left = F.col("every") * percent - F.col("capped") * (100 * cap)
    rest = F.col("wall") - F.col("wcapped")
    tested = level.withColumn("left", left).withColumn("rest", rest)
    tested = tested.withColumn("open", F.col("left") * F.col("w") <= F.col("total") * F.col("rest") * (100 * cap))
    first = F.min(F.when(F.col("open"), F.struct((F.col("total") / F.col("w")).alias("r"), "n", "left", "rest"))).over(everything)
    return tested.withColumn("first", first).select(
        "source", "total",
        F.when(F.col("open"), F.col("first.left") * F.col("w") / (F.col("first.rest") * 100)).otherwise((F.col("total") * cap).cast("double")).alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Largest hash to take for each budget: rows (source, budget) to (source, budget, upto).

    ``rows`` holds (source, size, h).  A document is taken if the middle of its span of the
    source's running size lies within the budget, so the sum ends within half a document of
    it.  A budget of nothing has ``upto`` -1.
    """
    state = save(budgets.selectExpr("source", "budget", "0L AS prefix", "0L AS before", "0L AS lo", f"{(1 << HASH_BITS) - 1}L AS hi", "0L AS inside"))
    few = state.count() <= BROADCAST_SOURCES
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        s = state.selectExpr("source AS _s", "budget", "prefix", "before")
        at = rows.join(F.broadcast(s) if few else s, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + STEP) == F.col("prefix")))
        hist = (
            at.where("budget > 0").groupBy("source", "budget", "before", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("w"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        upto = Window.partitionBy("source", "budget").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        state = save(
            hist.withColumn("cum", F.sum("w").over(upto)).where("before + cum >= budget AND before + cum - w < budget")
            .selectExpr("source", "budget", "bucket AS prefix", "before + cum - w AS before", "lo", "hi", "w AS inside")
        )
        if state.where("lo < hi").isEmpty():
            break
    ends = state.selectExpr("source AS _s", "budget AS _b", "CASE WHEN 2 * before + inside <= 2 * budget THEN lo ELSE lo - 1 END AS upto")
    out = budgets.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("budget") == F.col("_b")), "left")
    return out.select("source", "budget", F.coalesce("upto", F.lit(-1)).alias("upto"))


def plan(rows: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, cap: int = 2) -> DataFrame:
    """One row per source of ``rows`` (source, size, h): (_s, total, target, whole, upto).

    A source's target of ``whole`` times its size plus a rest takes every document ``whole``
    times and those with words and a hash up to ``upto`` once more.
    """
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("total")), weights, percent, cap)
    goal = goal.withColumn("whole", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("int"))
    goal = save(goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("total")))
    ends = thresholds(rows, goal.select("source", "budget")).select(F.col("source").alias("_t"), "upto")
    out = goal.join(ends, F.col("source").eqNullSafe(F.col("_t"))).select(F.col("source").alias("_s"), "total", "target", "whole", "upto")
    return F.broadcast(out) if goal.count() <= BROADCAST_SOURCES else out


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares: object,
) -> DataFrame:
    """One row per input row: (id, h, source, size, source_size, target, copies).

    ``shares`` are those of ``plan``; nothing is taken more than ``cap`` times.  Null texts
    have size 0; null sources form a source of their own.  Rows that share an id share a
    hash and are taken together.  An empty table gives no rows.
    """
    rows = save(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), hash60(id_col, text_col).alias("h"))
    )
    out = rows.join(plan(rows, **shares), F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select(
        "id", "h", "source", "size", F.col("total").alias("source_size"), "target",
        (F.col("whole") + ((F.col("h") <= F.col("upto")) & (F.col("size") > 0)).cast("int")).alias("copies"),
    )


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares: object) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    The same choice as ``mix`` makes, by the same thresholds; texts are filtered where they
    lie and not shuffled.
    """
    rows = save(docs.select(F.col(source_col).alias("source"), words(text_col).alias("size"), hash60(id_col, text_col).alias("h")))
    taken = plan(rows, **shares)
    more = (hash60(id_col, text_col) <= taken["upto"]) & (words(text_col) > 0)
    hit = docs.join(taken, docs[source_col].eqNullSafe(taken["_s"]))
    copies = taken["whole"] + F.coalesce(more, F.lit(False)).cast("int")
    own = [docs[f"`{c}`"] for c in docs.columns]
    spread = hit.select(F.struct(*own).alias("row"), F.explode(F.array_repeat(F.lit(0), copies)))
    return spread.select("row.*")


#: DuckDB SQL of ``mix`` with its default parameters over a relation named documents (doc_id, source, text).
MIX_SQL = r"""
rows AS (
  SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS h FROM {docs}),
totals AS (SELECT source, sum(size)::BIGINT AS total FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM totals),
weighed AS (SELECT *, [3, 1, 2][(n % 3 + 1)::INT]::BIGINT AS w FROM ranked),
level AS (
  SELECT *, total / w AS r, (sum(total) OVER ())::BIGINT AS every, (sum(w) OVER ())::BIGINT AS wall,
         coalesce(sum(total) OVER o, 0)::BIGINT AS capped, coalesce(sum(w) OVER o, 0)::BIGINT AS wcapped
  FROM weighed WINDOW o AS (ORDER BY total / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tested AS (
  SELECT *, every * 150 - capped * 200 AS lft, wall - wcapped AS rest,
         (every * 150 - capped * 200) * w <= total * (wall - wcapped) * 200 AS open FROM level),
least_open AS (SELECT lft AS l0, rest AS r0 FROM tested WHERE open ORDER BY r, n LIMIT 1),
goal AS (
  SELECT source, total, CASE WHEN open THEN (l0 * w)::DOUBLE / (r0 * 100)::DOUBLE ELSE (total * 2)::DOUBLE END AS target
  FROM tested LEFT JOIN least_open ON true),
cut AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total)::INT ELSE 0 END AS whole FROM goal),
cum AS (
  SELECT r.id, r.h, r.source, r.size, c.total, c.target, c.whole, c.target - c.whole * c.total AS budget,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c1,
         sum(r.size) OVER (PARTITION BY r.source, r.h) AS w1
  FROM rows r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source),
mixed AS (
  SELECT id, h, source, size, total AS source_size, target,
         whole + (budget > 0 AND size > 0 AND 2 * c1 - w1 <= 2 * budget)::INT AS copies FROM cum)
"""
