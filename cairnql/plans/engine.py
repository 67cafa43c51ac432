"""An engine over a folder: declared tables and views, ad-hoc SQL, named procedures, statistics."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnql.operators import stats, views
from cairnql.functions import sql as dialect
from cairnql.operators.dml import MutableTable
from cairnql.operators.relational import hash_partition
from cairnql.plans.statements import execute, is_change
from cairnql.sources import schema as ddl
from cairnql.sources.store import Snapshots, dump


@dataclass
class Procedure:
    """A named query: SQL text with ? or named parameters, or a callable (engine, *args) -> DataFrame."""

    name: str
    body: str | Callable[..., DataFrame]
    partition_by: str | None = None
    single_partition: bool = False


class Engine:
    """Runs queries over tables of its own and over frames attached from outside."""

    def __init__(self, spark: SparkSession, path: str, script: str = "", *, log: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables: dict[str, MutableTable] = {}
        self.views: dict[str, tuple[ddl.View, Callable[[], DataFrame]]] = {}
        self.frames: dict[str, DataFrame] = {}
        self.procedures: dict[str, Procedure] = {}
        self.log = log
        dialect.register(spark)
        if script:
            self.declare(script)

    def declare(self, script: str) -> None:
        tables, agg = ddl.parse(script)
        for t in tables.values():
            self.tables[t.name] = MutableTable(self.spark, t, self.path, log=self.log)
        for v in agg.values():
            self._add_view(v)

    def _add_view(self, view: ddl.View) -> None:
        """Keep a view in the versions of its table; a state that is there already is used as it is."""
        source = self.tables[view.source]
        shape = views.build(view, source.store.read_files([])).schema
        definition = repr(view)

        def state(rows: DataFrame) -> dict:
            return {"definition": definition, "files": source.store.write(rows)}

        def read() -> DataFrame:
            return source.store.read_files(source.store.note["views"][view.name]["files"], shape)

        def next_state(deleted: DataFrame | None, inserted: DataFrame | None) -> dict:
            parts = [views.delta(view, rows, sign) for rows, sign in ((deleted, -1), (inserted, 1)) if rows is not None]
            return state(views.merge(view, read(), *parts))

        note = source.store.note
        if note.get("views", {}).get(view.name, {}).get("definition") != definition:
            built = {view.name: state(views.build(view, source.read()))}
            source.store.commit(source.store.manifest, note | {"views": note.get("views", {}) | built})
        source.views[view.name] = next_state
        self.views[view.name] = (view, read)

    def attach(self, **frames: DataFrame) -> Engine:
        """Make frames known to SQL under a name, read only."""
        self.frames |= frames
        return self

    def relation(self, name: str) -> DataFrame:
        name = name.lower()
        if name in self.tables:
            return self.tables[name].read()
        if name in self.views:
            view, read = self.views[name]
            return views.result(view, read())
        return self.frames[name]

    def query(self, text: str, *args: object, **named: object) -> DataFrame:
        """A query with positional (?) or named (:x) parameters; only the relations it names are looked up."""
        words = set(re.findall(r"\w+", text.lower()))
        for name in words & {*self.tables, *self.views, *self.frames}:
            self.relation(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=list(args) if args else named or None)

    def sql(self, text: str, *args: object, **named: object) -> DataFrame:
        """Ad-hoc SQL: a query, or a change of a table, whose result is one row with the number of rows it affects."""
        if is_change(text):
            n = execute(self, text, args)
            return self.spark.range(1).select(F.lit(n).cast("long").alias("modified_tuples"))
        return self.query(text, *args, **named)

    def procedure(self, name: str, body: str | Callable[..., DataFrame], **meta) -> Procedure:
        self.procedures[name.lower()] = p = Procedure(name, body, **meta)
        return p

    def call(self, name: str, *args: object) -> DataFrame:
        p = self.procedures[name.lower()]
        return self.sql(p.body, *args) if isinstance(p.body, str) else p.body(self, *args)

    def statistics(self, name: str, selector: str = "TABLE", *, key: str | None = None, partitions: int = 1) -> DataFrame:
        """TABLE: rows and columns of a relation.  PARTITIONCOUNT: its rows, and how many of ``partitions`` routing partitions hold any."""
        df = self.relation(name)
        if selector.upper() == "TABLE":
            return stats.table_statistics(df, name)
        if selector.upper() != "PARTITIONCOUNT" or key is None:
            raise ValueError(f"no statistics {selector}" if key else "PARTITIONCOUNT needs a key")
        kind = "string" if df.schema[key].dataType.typeName() == "string" else "long"
        dealt = stats.partition_counts(df, hash_partition(kind, F.col(key), partitions))
        return dealt.agg(F.sum("tuples").alias("tuples"), F.count(F.lit(1)).alias("partitions")).select(F.lit(name).alias("table"), "tuples", "partitions")

    def catalog(self) -> DataFrame:
        """(relation, kind, column, type, nullable) of all relations."""
        rows = []
        for kind, names in (("TABLE", self.tables), ("VIEW", self.views), ("FRAME", self.frames)):
            for n in names:
                rows += [(n, kind, f.name, f.dataType.simpleString(), f.nullable) for f in self.relation(n).schema]
        return self.spark.createDataFrame(rows, "relation string, kind string, column string, type string, nullable boolean")

    def load(self, name: str, rows: DataFrame) -> int:
        """Bulk load: one append of a whole frame, checked like any insert."""
        return self.tables[name.lower()].insert(rows)

    def configure(self, **settings: str) -> None:
        """Set session settings; dots are written as double underscores."""
        for k, v in settings.items():
            self.spark.conf.set(k.replace("__", "."), v)

    def configuration(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.spark.conf.getAll.items()), "name string, value string")

    def snapshot(self, name: str, path: str | None = None) -> None:
        Snapshots(self.spark, path or f"{self.path}/_snapshots").save(name, {n: t.read() for n, t in self.tables.items()})

    def restore(self, name: str, path: str | None = None) -> None:
        """Bring back the tables of a snapshot; a logged change of each, which its views follow."""
        for n, df in Snapshots(self.spark, path or f"{self.path}/_snapshots").restore(name).items():
            self.tables[n].replace(df)

    def dump(self, path: str) -> None:
        dump({n: t.read() for n, t in self.tables.items()}, path)
