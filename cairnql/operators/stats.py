"""Histograms and statistics of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnql.operators.relational import ranked


def histogram(df: DataFrame, value: Column | str, weight: Column | str | None = None) -> DataFrame:
    """Rows (value, count); nulls count as a value."""
    v = F.col(value) if isinstance(value, str) else value
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(v.alias("value")).agg(n.alias("count"))


def put(hist: DataFrame, other: DataFrame, sign: int = 1) -> DataFrame:
    """Add (or with -1 take away) another histogram; values whose count is not positive go."""
    both = hist.union(other.select("value", (F.col("count") * sign)))
    return both.groupBy("value").agg(F.sum("count").alias("count")).where(F.col("count") > 0)


def extremes(hist: DataFrame) -> DataFrame:
    """Smallest and largest value, and the values of the smallest and largest count (the least of equals)."""
    return hist.agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min(F.struct("count", "value")).getField("value").alias("min_count_value"),
        F.min(F.struct(-F.col("count"), F.col("value"))).getField("value").alias("max_count_value"),
        F.sum("count").alias("samples"), F.count(F.lit(1)).alias("values"),
    )


def values_for_count(hist: DataFrame, count: int) -> DataFrame:
    return hist.where(F.col("count") == count).select("value")


def normalize(hist: DataFrame) -> DataFrame:
    """Counts as shares of the largest."""
    return hist.join(F.broadcast(hist.agg(F.max("count").alias("_top"))), how="cross").select("value", (F.col("count") / F.col("_top")).alias("share"))


def moments(hist: DataFrame) -> DataFrame:
    """Sum, mean and sample standard deviation (NaN for fewer than two) of the values, weighted by count."""
    n, s = F.sum("count"), F.sum(F.col("value") * F.col("count"))
    q = F.sum(F.col("value") * F.col("value") * F.col("count"))
    spread = F.when(n > 1, F.sqrt(F.greatest((q - s * (s / n)) / (F.nullif(n, F.lit(1)) - 1), F.lit(0.0)))).otherwise(F.lit(float("nan")))
    return hist.agg(s.alias("sum"), (s / F.nullif(n, F.lit(0))).alias("mean"), spread.alias("stdev"))


def percentile(hist: DataFrame, p: float) -> DataFrame:
    """Exact percentile (0 to 1, held within 0.01 and 1) of the values by count, interpolated.

    Within one step of the smallest value it is that value."""
    p = min(1.0, max(0.01, p))
    at = F.percentile("value", F.lit(p), F.col("count"))
    return hist.agg(F.when((F.sum("count") - 1) * p < 1, F.min("value").cast("double")).otherwise(at).alias("percentile"))


def sorted_values(hist: DataFrame) -> DataFrame:
    """Values by descending count; those of equal count ascend."""
    return hist.orderBy(F.col("count").desc(), F.col("value").asc())


def weighted_values(hist: DataFrame, block: int = 65_536) -> DataFrame:
    """Every value as often as it was counted; blocks keep a frequent value from being one long array."""
    blocks = hist.select("value", "count", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("count") - 1), F.lit(block).cast("long"))).alias("_at")).where("count > 0")
    return blocks.select("value", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + block, F.col("count")) - 1))).select("value")


def spread_values(hist: DataFrame) -> DataFrame:
    """(value, position): the distinct values in order, evenly from -1 to 1, to ten digits."""
    top = max(1, hist.count() - 1)
    return ranked(hist.select("value"), "value", "k").select("value", F.round(F.col("k") * (2.0 / top) - 1, 10).alias("position"))


def column_histograms(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, count) for each of some columns in one pass; values as text."""
    names = columns or tuple(df.columns)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("e")).select("e.*")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def partition_counts(df: DataFrame, part: Column) -> DataFrame:
    """Rows of each routing partition."""
    return df.groupBy(part.alias("partition")).agg(F.count(F.lit(1)).alias("tuples"))


def table_statistics(df: DataFrame, name: str) -> DataFrame:
    """(table, tuples, then per column: nulls, approximate distinct values, minimum, maximum as text)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    for c in plain:
        aggs += [F.count(c).alias(f"{c}|c"), F.min(c).cast("string").alias(f"{c}|lo"), F.max(c).cast("string").alias(f"{c}|hi"), F.approx_count_distinct(c).alias(f"{c}|d")]
    one = df.agg(*aggs)
    row = lambda c: F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"{c}|c")).alias("nulls"), F.col(f"{c}|d").alias("distinct_values"), F.col(f"{c}|lo").alias("min_value"), F.col(f"{c}|hi").alias("max_value"))
    return one.select(F.lit(name).alias("table"), F.col("n").alias("tuples"), F.explode(F.array(*[row(c) for c in plain])).alias("s")).select("table", "tuples", "s.*")


def tuple_sizes(df: DataFrame) -> DataFrame:
    """Minimum, maximum, average and total bytes of the rows written as text."""
    size = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns])).cast("long")
    return df.agg(F.min(size).alias("size_min"), F.max(size).alias("size_max"), F.avg(size).alias("size_avg"), F.sum(size).alias("size_total"))
