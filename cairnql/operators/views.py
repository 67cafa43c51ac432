"""Incrementally maintained aggregate views.

A view's state is one row per group with a row count, so that inserts and deletes are signed
deltas: they are aggregated by group, added to the state, and groups whose count is zero go.
An update is a delete and an insert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnql.sources.schema import View


def _sum_type(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else kind


def delta(view: View, rows: DataFrame, sign: int = 1) -> DataFrame:
    """Signed aggregate of changed rows; rows where the view's filter is not true don't count.

    Sums over only nulls are null; each sum has a hidden count of its values so that deletes
    can make it null again.
    """
    if view.where:
        rows = rows.where(view.where)
    aggs = [(F.count(F.lit(1)) * sign).alias(view.count)]
    for f, column, out in view.sums:
        if f == "SUM":
            kind = _sum_type(rows.schema[column].dataType)
            aggs.append((F.sum(F.col(column).cast(kind)) * sign).cast(kind).alias(out))
            aggs.append((F.count(column) * sign).alias(f"_{out}_n"))
        else:
            aggs.append((F.count(column) * sign).alias(out))
    return rows.groupBy(*[F.col(c).alias(o) for c, o in view.groups]).agg(*aggs)


def build(view: View, rows: DataFrame) -> DataFrame:
    """The view's state over a whole table."""
    return delta(view, rows)


def merge(view: View, state: DataFrame, *deltas: DataFrame) -> DataFrame:
    """State after signed deltas; only as many rows as groups are shuffled."""
    both = state
    for d in deltas:
        both = both.unionByName(d)
    aggs = [F.sum(view.count).alias(view.count)]
    for f, _, out in view.sums:
        kind = state.schema[out].dataType
        if f == "SUM":
            n = F.sum(f"_{out}_n")
            aggs.append(F.when(n > 0, F.sum(out)).cast(kind).alias(out))
            aggs.append(n.alias(f"_{out}_n"))
        else:
            aggs.append(F.sum(out).alias(out))
    return both.groupBy(*[o for _, o in view.groups]).agg(*aggs).where(F.col(view.count) > 0)


def insert(view: View, state: DataFrame, rows: DataFrame) -> DataFrame:
    return merge(view, state, delta(view, rows, 1))


def delete(view: View, state: DataFrame, rows: DataFrame) -> DataFrame:
    return merge(view, state, delta(view, rows, -1))


def update(view: View, state: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(view, state, delta(view, old, -1), delta(view, new, 1))


def result(view: View, state: DataFrame) -> DataFrame:
    """The columns that the view shows."""
    return state.select(*[o for _, o in view.groups], view.count, *[o for _, _, o in view.sums])
