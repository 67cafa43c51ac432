"""Map-reduce jobs: a map query, a map function on rows, a shuffle by key and a reduce function.

Prefer a plain aggregate where one says the same; a job is for logic that needs code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairnql.session import ship

Row = dict
ROWS = 4096


@dataclass
class MapReduceJob:
    """``map_fn(row)`` yields tuples of ``map_schema``, whose first column is the key;
    ``reduce_fn(key, rows)`` gets an iterator over a key's tuples and yields tuples of
    ``reduce_schema``.

    Keys are dealt by hash and sorted, and a reducer reads its rows as a stream: a frequent
    key never has to fit in memory.  ``combine_fn``, if given, is a reduce function whose
    output has the map schema; it runs in the map tasks, so that a frequent key sends few rows.
    """

    map_query: str
    map_schema: str
    reduce_schema: str
    map_fn: Callable[[Row], Iterable[tuple]]
    reduce_fn: Callable[[object, Iterator[tuple]], Iterable[tuple]]
    combine_fn: Callable[[object, Iterator[tuple]], Iterable[tuple]] | None = None

    def run(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        ship(spark)
        mapped = spark.sql(self.map_query, **tables).mapInArrow(_mapper(self.map_fn, self.map_schema), self.map_schema)
        key = T.StructType.fromDDL(self.map_schema).fieldNames()[0]
        if self.combine_fn:
            mapped = mapped.sortWithinPartitions(key).mapInArrow(_reducer(self.combine_fn, self.map_schema), self.map_schema)
        dealt = mapped.repartition(key).sortWithinPartitions(key)
        return dealt.mapInArrow(_reducer(self.reduce_fn, self.reduce_schema), self.reduce_schema)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _mapper(fn: Callable, ddl: str):
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches((t for row in b.to_pylist() for t in fn(row)), schema)

    return run


def _reducer(fn: Callable, ddl: str):
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (t for b in batches for t in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches((out for key, group in groupby(rows, key=lambda t: t[0]) for out in fn(key, group)), schema)

    return run
