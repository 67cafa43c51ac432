"""Seeded random numbers by row, for test data: the same key and seed give the same number on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnql.operators.relational import interval_join

FINE = 1 << 53


def uniform(key: Column, seed: int = 0) -> Column:
    """A double from 0 inclusive to 1 exclusive."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / float(FINE)


def flat(key: Column, low: int, high: int, seed: int = 0) -> Column:
    """Integers from low inclusive to high exclusive, all alike."""
    return (F.lit(low) + F.floor(uniform(key, seed) * (high - low))).cast("long")


def gaussian(key: Column, low: int, high: int, seed: int = 0, tries: int = 8) -> Column:
    """Integers from low inclusive to high exclusive; the range is four standard deviations wide.

    Numbers outside are drawn again, and after some tries held at the edge."""
    size = high - low

    def draw(n: int) -> Column:
        u = F.greatest(uniform(key, seed * 1000 + 2 * n), F.lit(1.0 / FINE))
        z = F.sqrt(-2 * F.log(u)) * F.cos(uniform(key, seed * 1000 + 2 * n + 1) * 6.283185307179586)
        return F.round((z + 2.0) / 4.0 * size)

    inside = [F.when((draw(n) >= 0) & (draw(n) < size), draw(n)) for n in range(tries)]
    return (F.lit(low) + F.coalesce(*inside, F.least(F.greatest(draw(0), F.lit(0.0)), F.lit(float(size - 1))))).cast("long")


def hot_warm_cold(key: Column, low: int, high: int, hot_access: int, hot_size: int, warm_access: int, warm_size: int, seed: int = 0) -> Column:
    """Integers of which hot_access % fall in the first hot_size % of the range, warm_access % in the next warm_size %."""
    if hot_access + warm_access > 100 or hot_size + warm_size > 100:
        raise ValueError("shares above 100 %")
    hot = low + (high - low) * hot_size // 100
    warm = hot + (high - low) * warm_size // 100
    at = uniform(key, seed + 7919) * 100
    return F.when(at < hot_access, flat(key, low, hot, seed)).when(at < hot_access + warm_access, flat(key, hot, warm, seed)).otherwise(flat(key, warm, high, seed))


def from_histogram(df: DataFrame, key: Column, hist: DataFrame, seed: int = 0, few: int = 10_000) -> DataFrame:
    """Adds ``value``, drawn from a histogram (value, count) by its counts.

    Up to ``few`` values go to every task as one array; more are joined by the interval of
    each.  The running sum of the counts is made in one task, of a row per value.
    """
    upto = F.sum("count").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    bounds = hist.select("value", upto.alias("u"), (upto - F.col("count")).alias("_low"))
    n, total = hist.agg(F.count(F.lit(1)), F.sum("count")).first()
    at = F.floor(uniform(key, seed) * F.lit(total))
    if n > few:
        spans = bounds.where(F.col("u") > F.col("_low")).select("value", "_low", (F.col("u") - 1).alias("_high"))
        return interval_join(df.withColumn("_at", at), spans, F.col("_at"), F.col("_low"), F.col("_high"), max(1, total // n)).drop("_at", "_low", "_high")
    table = bounds.agg(F.array_sort(F.collect_list(F.struct("u", "value"))).alias("_h"))
    drawn = F.element_at(F.filter("_h", lambda b: b["u"] > at), 1)["value"]
    return df.crossJoin(F.broadcast(table)).withColumn("value", drawn).drop("_h")  # one row of `few` values at most
