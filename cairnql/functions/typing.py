"""Result typing of the strict dialect, as Column builders and plan-time checks.

Integers promote to BIGINT and divide integrally; AVG has its argument's type; DECIMAL is
(38, 12) with truncating products and quotients; strings never meet numbers and decimals
never meet floats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DECIMAL = T.DecimalType(38, 12)
#: Smallest value of each stored integer type; it means null in exchanged files.
NULL_SENTINELS = {T.ByteType: -(1 << 7), T.ShortType: -(1 << 15), T.IntegerType: -(1 << 31), T.LongType: -(1 << 63)}
NULL_FLOAT = -1.7e308


class TypeMismatch(TypeError):
    """Operands whose types may not meet."""


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, INTEGERS)


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type of an arithmetic result or comparison: STRING, DECIMAL, FLOAT, TIMESTAMP, then BIGINT."""
    text = [isinstance(t, T.StringType) for t in (a, b)]
    if any(text):
        if not all(text):
            raise TypeMismatch(f"a string cannot meet {a.simpleString()} / {b.simpleString()}")
        return T.StringType()
    exact = [isinstance(t, T.DecimalType) for t in (a, b)]
    floats = [isinstance(t, (T.FloatType, T.DoubleType)) for t in (a, b)]
    if any(exact):
        if any(floats):
            raise TypeMismatch("a decimal cannot meet a float")
        return DECIMAL
    if any(floats):
        return T.DoubleType()
    times = [isinstance(t, (T.TimestampType, T.TimestampNTZType)) for t in (a, b)]
    if any(times):
        return T.TimestampType()
    if isinstance(a, T.BooleanType) and isinstance(b, T.BooleanType):
        return T.BooleanType()
    if not (is_integer(a) and is_integer(b)):
        raise TypeMismatch(f"no common type of {a.simpleString()} and {b.simpleString()}")
    return T.LongType()


def check(df: DataFrame, *columns: str) -> T.DataType:
    """Common type of some columns of a frame; raises TypeMismatch before anything runs."""
    kinds = [df.schema[c].dataType for c in columns]
    out = kinds[0]
    for k in kinds[1:]:
        out = promote(out, k)
    return out


def int_div(a: Column | str, b: Column | str) -> Column:
    """Quotient of integers, truncated towards zero; zero divides with an error."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.call_function("div", a.cast("long"), b.cast("long"))


def typed_avg(df: DataFrame, column: str) -> Column:
    """AVG in its argument's type: integers truncate, decimals keep twelve digits."""
    kind = df.schema[column].dataType
    return F.avg(column).cast(kind)


def weighted_avg(value: Column | str, weight: Column | str) -> Column:
    """sum(value * weight) / sum(weight); null values carry no weight."""
    value, weight = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def _truncated(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x, F.lit(12))).otherwise(F.ceil(x, F.lit(12))).cast(DECIMAL)


def dec_mul(a: Column, b: Column) -> Column:
    """Product of decimals (below 10^12) at twelve digits, truncated towards zero."""
    return _truncated(a.cast("decimal(24,12)") * b.cast("decimal(24,12)"))


def dec_div(a: Column, b: Column) -> Column:
    """Quotient of decimals (below 10^12) at twelve digits, truncated towards zero."""
    return _truncated(a.cast("decimal(24,12)") / b.cast("decimal(24,12)"))


def from_sentinels(df: DataFrame) -> DataFrame:
    """Turn each type's smallest value, the exchange form of null, into null."""

    def clean(f: T.StructField) -> Column:
        c = F.col(f.name)
        if (low := NULL_SENTINELS.get(type(f.dataType))) is not None:
            return F.when(c != F.lit(low), c).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.when(c > NULL_FLOAT, c).alias(f.name)
        return c

    return df.select(*[clean(f) for f in df.schema])
