"""Inserts, updates and deletes on versioned tables, with constraints and a change log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnql.sources.schema import Table
from cairnql.sources.store import VersionedTable


class ConstraintViolation(ValueError):
    """A change that would break NOT NULL or a key; the table stays as it was."""


class MutableTable:
    """A declared table in a folder, changed file by file.

    Every change is checked first and returns the number of rows it affects.  A change finds
    the files that hold rows it affects, and writes only those anew.  Changed rows go to the
    change log (op, txn, seq, then the columns) and as (deleted, inserted) frames to the
    views; files, log, states of views and the number of the change become current in one
    commit, so a failure before it leaves all of them as they were.
    """

    def __init__(self, spark: SparkSession, table: Table, path: str, *, log: bool = False):
        self.spark, self.table, self.log = spark, table, log
        self.store = VersionedTable(spark, f"{path}/{table.name}", table.schema)
        #: For each view a function of the changed rows that writes the view's next state and returns what its reader needs.
        self.views: dict[str, Callable[[DataFrame | None, DataFrame | None], dict]] = {}

    @property
    def txn(self) -> int:
        """Number of the last change."""
        return self.store.note.get("txn", 0)

    def read(self) -> DataFrame:
        return self.store.read()

    # ---- checks

    def _complete(self, rows: DataFrame) -> DataFrame:
        """All columns in order and type; missing ones take their default or null."""
        given = {c.lower(): c for c in rows.columns}
        unknown = set(given) - set(self.table.schema.fieldNames())
        if unknown:
            raise ValueError(f"no column {sorted(unknown)} in {self.table.name}")
        out = []
        for f in self.table.schema:
            if f.name in given:
                c = F.col(given[f.name])
            else:
                d = self.table.defaults.get(f.name)
                c = F.current_timestamp() if d in ("NOW", "CURRENT_TIMESTAMP") else F.lit(d)
            out.append(c.cast(f.dataType).alias(f.name))
        return rows.select(*out)

    def _check_nulls(self, rows: DataFrame) -> None:
        if names := self.table.not_null:
            bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
            if not rows.where(bad).isEmpty():
                raise ConstraintViolation(f"{self.table.name}: null in a NOT NULL column")

    def _check_keys(self, rows: DataFrame, present: DataFrame | None) -> None:
        """No key twice among the rows, nor in the rows and the present ones.  Keys with a null don't clash.

        Only present rows within the range of the new keys are read, so files elsewhere are skipped."""
        for key in self.table.keys:
            whole = rows.dropna(subset=key).select(*key)
            if not whole.groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintViolation(f"{self.table.name}: {key} repeats")
            if present is not None:
                low, high = whole.agg(F.min(key[0]), F.max(key[0])).first()
                if low is not None and not present.where(F.col(key[0]).between(low, high)).join(whole, key, "left_semi").isEmpty():
                    raise ConstraintViolation(f"{self.table.name}: {key} exists")

    def _commit(self, files: list[str], deleted: DataFrame | None, inserted: DataFrame | None) -> None:
        """Write the log and the views' states, then make all current at once."""
        note = dict(self.store.note)
        txn = note["txn"] = note.get("txn", 0) + 1
        if self.log:
            for op, rows in (("DELETE", deleted), ("INSERT", inserted)):
                if rows is not None:
                    seq = F.monotonically_increasing_id().alias("seq")
                    note["log"] = note.get("log", []) + self.store.write(rows.select(F.lit(op).alias("op"), F.lit(txn).cast("long").alias("txn"), seq, *rows.columns))
        note["views"] = note.get("views", {}) | {name: state(deleted, inserted) for name, state in self.views.items()}
        self.store.commit(files, note)

    def _checked(self, rows: DataFrame, check: Callable[[DataFrame], None]) -> list[str]:
        """Write rows once, and check them as written; what fails the check is deleted."""
        files = self.store.write(rows)
        try:
            check(self.store.read_files(files))
        except ConstraintViolation:
            self.store.discard(files)
            raise
        return files

    def _filed(self) -> DataFrame:
        """The table with the name of each row's file."""
        return self.read().select("*", F.col("_metadata.file_name").alias("_file"))

    def _hits(self, rows: DataFrame) -> tuple[list[str], list[str], int]:
        """(files that hold such rows of ``_filed``, other files, number of rows)."""
        counts = {r[0]: r[1] for r in rows.groupBy("_file").count().collect()}  # a row per file
        held = [f for f in self.store.manifest if f.rsplit("/", 1)[1] in counts]
        return held, [f for f in self.store.manifest if f not in set(held)], sum(counts.values())

    # ---- changes

    def insert(self, rows: DataFrame) -> int:
        """Append rows; what is there is read for the key check only."""
        def check(new: DataFrame) -> None:
            self._check_nulls(new)
            self._check_keys(new, self.read() if self.table.keys else None)

        files = self._checked(self._complete(rows), check)
        new = self.store.read_files(files)
        n = new.count()
        if n:
            self._commit([*self.store.manifest, *files], None, new)
        return n

    def insert_values(self, *rows: tuple, columns: list[str] | None = None) -> int:
        names = columns or self.table.schema.fieldNames()
        kinds = ", ".join(f"`{n}` {self.table.schema[n].dataType.simpleString()}" for n in names)
        return self.insert(self.spark.createDataFrame(list(rows), kinds))

    def _check_moves(self, hits: DataFrame, values: dict) -> None:
        part = self.table.partition_by
        if part in values:
            to = values[part] if isinstance(values[part], Column) else F.lit(values[part])
            if not hits.where(~F.col(part).eqNullSafe(to)).isEmpty():
                raise ConstraintViolation(f"{self.table.name}: an update may not move a row to another partition")

    def update(self, where: Column | str | None, **values: Column | object) -> int:
        """Set columns of the rows for which the condition is true; others (false or null) stay."""
        if not self.store.manifest:
            return 0
        hit = _condition(where)
        hits = self._filed().where(hit)
        held, others, n = self._hits(hits)
        if not n:
            return 0
        self._check_moves(hits, values)
        old = self.store.read_files(held)
        value = lambda f: values[f.name] if isinstance(values[f.name], Column) else F.lit(values[f.name])
        changed = old.where(hit).select(*[value(f).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in self.table.schema])

        def check(new: DataFrame) -> None:
            if set(self.table.not_null) & set(values):
                self._check_nulls(new)
            if any(set(k) & set(values) for k in self.table.keys):
                self._check_keys(new, self.read().where(~hit))

        files = self._checked(changed, check)
        self._commit([*others, *self.store.write(old.where(~hit)), *files], old.where(hit), self.store.read_files(files))
        return n

    def delete(self, where: Column | str | None = None) -> int:
        """Delete the rows for which the condition is true; without one, all of them."""
        if not self.store.manifest:
            return 0
        if where is None:
            old = self.read()
            n = old.count()
            if n:
                self._commit([], old, None)
            return n
        hit = _condition(where)
        held, others, n = self._hits(self._filed().where(hit))
        if n:
            old = self.store.read_files(held)
            self._commit([*others, *self.store.write(old.where(~hit))], old.where(hit), None)
        return n

    def replace(self, rows: DataFrame) -> int:
        """All rows give way to these, as one logged change."""
        old = self.read() if self.store.manifest else None
        files = self._checked(self._complete(rows), lambda new: (self._check_nulls(new), self._check_keys(new, None)))
        new = self.store.read_files(files)
        self._commit(files, old, new)
        return new.count()

    def merge(self, rows: DataFrame, on: list[str] | None = None) -> int:
        """Upsert by key: rows that exist are replaced, others inserted.  Returns the number of given rows."""
        on = on or self.table.primary_key
        files = self._checked(self._complete(rows), lambda new: (self._check_nulls(new), self._check_keys(new, None)))
        return self._put(files, on)

    def _put(self, files: list[str], on: list[str]) -> int:
        """Rows of new files instead of those with equal keys."""
        new = self.store.read_files(files)
        n = new.count()
        if not n:
            return 0
        if not self.store.manifest:
            self._commit(files, None, new)
            return n
        keys = new.select(*on)
        held, others, gone = self._hits(self._filed().join(keys, on, "left_semi"))
        if not gone:
            self._commit([*others, *files], None, new)
            return n
        old = self.store.read_files(held)
        kept = self.store.write(old.join(keys, on, "left_anti").select(*old.columns))
        self._commit([*others, *kept, *files], old.join(keys, on, "left_semi").select(*old.columns), new)
        return n

    def merge_into(self, source: DataFrame, on: Column, *, names: tuple[str, str], matched: dict[str, Column] | None, missing: dict[str, Column] | None) -> int:
        """MERGE: rows of the source that meet one of the table update it, others are inserted.

        ``names`` are those of table and source in the expressions.  A row of the table that
        two rows of the source meet is an error, as is a table without a primary key.
        Returns the number of rows updated and inserted.
        """
        key = self.table.primary_key
        if not key:
            raise ValueError(f"{self.table.name} has no primary key to merge by")
        t, s = self.read().alias(names[0]), source.alias(names[1])
        new = None
        if matched:
            if set(matched) & set(key):
                raise ValueError("MERGE may not change a primary key")
            met = t.join(s, on)
            new = met.select(*[(matched[f.name] if f.name in matched else F.col(f"{names[0]}.{f.name}")).cast(f.dataType).alias(f.name) for f in self.table.schema])
        if missing:
            rest = self._complete(s.join(t, on, "left_anti").select(*[c.alias(n) for n, c in missing.items()]))
            new = new.unionByName(rest) if new is not None else rest
        if new is None:
            return 0
        return self._put(self._checked(new, lambda x: (self._check_nulls(x), self._check_keys(x, None))), key)

    def changes(self) -> DataFrame:
        """The change log in full."""
        if not self.log:
            raise ValueError("this table keeps no log")
        head = T.StructType.fromDDL("op string, txn long, seq long").fields
        return self.store.read_files(self.store.note.get("log", []), T.StructType([*head, *self.table.schema.fields]))


def _condition(where: Column | str | None) -> Column:
    """Whether the condition is true, never null."""
    if where is None:
        return F.lit(True)
    return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
