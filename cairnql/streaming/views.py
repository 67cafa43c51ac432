"""Aggregate views and change logs kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from cairnql.operators import views
from cairnql.sources.schema import View
from cairnql.sources.store import VersionedTable


def merge_batch(view: View, store: VersionedTable, source: str, batch: DataFrame, number: int) -> None:
    """Merge one micro-batch into a view's state, once.

    The number of a source's last batch is written in the same commit as the state; so a
    batch that comes again after a failure, wherever that struck, is not counted twice.
    """
    key = f"batch of {source}"
    if store.note.get(key, -1) >= number:
        return
    change = views.delta(view, batch)
    store.overwrite(views.merge(view, store.read(), change) if store.version else change, **{key: number})


def maintain(view: View, rows: DataFrame, store: VersionedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a view over a stream of inserted rows; each micro-batch is aggregated to its groups first."""
    def apply(batch: DataFrame, number: int) -> None:
        merge_batch(view, store, checkpoint, batch, number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running(view: View, rows: DataFrame) -> DataFrame:
    """The view as a streaming aggregate, for sinks of mode "update" or "complete"."""
    return views.result(view, views.delta(view, rows))


def export(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of change records to Parquet files, each once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
