"""Tables declared by DDL: columns, keys, defaults and aggregate views."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

TYPES = {
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "INT": T.IntegerType(),
    "BIGINT": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(),
    "TIMESTAMP": T.TimestampType(), "DECIMAL": T.DecimalType(38, 12), "VARBINARY": T.BinaryType(), "BOOLEAN": T.BooleanType(),
    "NUMERIC": T.DecimalType(38, 12), "REAL": T.DoubleType(), "CHAR": T.StringType(), "LONGVARCHAR": T.StringType(), "DATE": T.DateType(),
}
MAX_COLUMNS = 1024


@dataclass
class Table:
    """A declared table; ``partition_by`` is the routing column, None for a replicated table."""

    name: str
    schema: T.StructType
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    indexes: list[str] = field(default_factory=list)
    partition_by: str | None = None

    @property
    def keys(self) -> list[list[str]]:
        return [self.primary_key] * bool(self.primary_key) + self.unique

    @property
    def not_null(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]


@dataclass
class View:
    """An aggregate view: group columns, a row count, sums and counts of plain columns, an optional filter."""

    name: str
    source: str
    groups: list[tuple[str, str]]  # (source column, view column)
    count: str
    sums: list[tuple[str, str, str]]  # (SUM or COUNT, source column, view column)
    where: str | None = None


class DDLError(ValueError):
    """A statement that the dialect rejects."""


def split(text: str, mark: str = ",") -> list[str]:
    """Split at a mark outside of parentheses and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == mark and not depth:
                out.append(text[start:i].strip())
                start = i + 1
    return [*out, text[start:].strip()]


def _literal(text: str) -> object:
    if text.upper() == "NULL":
        return None
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?[\d.]+([eE][-+]?\d+)?", text):
        return float(text)
    return text.upper()  # a function such as CURRENT_TIMESTAMP


def parse(script: str) -> tuple[dict[str, Table], dict[str, View]]:
    """Tables and views of a script of CREATE statements; names are case-insensitive (kept in lower case).

    Foreign keys and checks are accepted and not enforced; indexes are recorded, unique ones
    as keys.
    """
    tables: dict[str, Table] = {}
    views: dict[str, View] = {}
    script = re.sub(r"--[^\n]*", " ", script)
    for statement in filter(None, split(script, ";")):
        s = " ".join(statement.split())
        if m := re.fullmatch(r"CREATE TABLE (\w+) ?\((.*)\)", s, re.I):
            tables[m[1].lower()] = _table(m[1].lower(), m[2])
        elif m := re.fullmatch(r"CREATE (UNIQUE )?INDEX (\w+) ON (\w+) ?\((.*)\)", s, re.I):
            t = tables[m[3].lower()]
            t.indexes.append(m[2].lower())
            if m[1]:
                t.unique.append([c.lower() for c in split(m[4])])
        elif m := re.fullmatch(r"PARTITION TABLE (\w+) ON COLUMN (\w+)", s, re.I):
            tables[m[1].lower()].partition_by = m[2].lower()
        elif m := re.fullmatch(r"CREATE VIEW (\w+) ?(?:\((.*?)\))? ?AS SELECT (.*) FROM (\w+)(?: WHERE (.*?))? GROUP BY (.*)", s, re.I):
            views[m[1].lower()] = _view(m[1].lower(), m[2], m[3], m[4].lower(), m[5], m[6])
        else:
            raise DDLError(f"cannot read: {s[:80]}")
    return tables, views


def _table(name: str, body: str) -> Table:
    out = Table(name, T.StructType())
    fields: list[T.StructField] = []
    for part in split(body):
        if m := re.match(r"(?:CONSTRAINT \w+ )?(PRIMARY KEY|UNIQUE) ?\((.*)\)", part, re.I):
            columns = [c.lower() for c in split(m[2])]
            if m[1].upper() == "UNIQUE":
                out.unique.append(columns)
            else:
                out.primary_key = columns
            continue
        if re.match(r"(CONSTRAINT \w+ )?(FOREIGN KEY|CHECK)", part, re.I):
            continue
        m = re.match(r"(\w+) (\w+) ?(?:\([\d, ]+\))?(.*)", part)
        if not m or m[2].upper() not in TYPES:
            raise DDLError(f"cannot read the column: {part[:80]}")
        column, rest = m[1].lower(), m[3]
        if re.search(r"PRIMARY KEY", rest, re.I):
            out.primary_key = [column]
        if re.search(r"\bUNIQUE\b", rest, re.I):
            out.unique.append([column])
        if d := re.search(r"DEFAULT ('(?:[^']|'')*'|\S+)", rest, re.I):
            out.defaults[column] = _literal(d[1])
        fields.append(T.StructField(column, TYPES[m[2].upper()], not re.search(r"NOT NULL|PRIMARY KEY", rest, re.I)))
    if len(fields) > MAX_COLUMNS:
        raise DDLError(f"{name} has more than {MAX_COLUMNS} columns")
    out.schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in out.primary_key) for f in fields])
    return out


def _view(name: str, names: str | None, items: str, source: str, where: str | None, groups: str) -> View:
    shown = [re.sub(r"^.* AS (\w+)$", r"\1", x, flags=re.I).lower() for x in split(items)]
    outputs = [x.lower() for x in split(names)] if names else shown
    if len(outputs) != len(shown):
        raise DDLError(f"view {name} names {len(outputs)} of {len(shown)} columns")
    by = [g.lower() for g in split(groups)]
    plain = [re.sub(r" AS \w+$", "", x, flags=re.I) for x in split(items)]
    keys = list(zip(by, outputs))
    if [x.lower() for x in plain[: len(by)]] != by:
        raise DDLError(f"view {name} must begin with its group columns")
    if len(plain) == len(by) or not re.fullmatch(r"COUNT ?\( ?\* ?\)", plain[len(by)], re.I):
        raise DDLError(f"view {name} needs COUNT(*) after its group columns")
    sums = []
    for x, out in zip(plain[len(by) + 1 :], outputs[len(by) + 1 :]):
        m = re.fullmatch(r"(SUM|COUNT) ?\( ?(\w+) ?\)", x, re.I)
        if not m:
            raise DDLError(f"view {name}: only SUM or COUNT of a column, not {x}")
        sums.append((m[1].upper(), m[2].lower(), out))
    return View(name, source, keys, outputs[len(by)], sums, where)
