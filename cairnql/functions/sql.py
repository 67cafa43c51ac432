"""The dialect's typed arithmetic as SQL functions, for ad-hoc text."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, parameters, result, body
FUNCTIONS = (
    ("int_div", "a BIGINT, b BIGINT", "BIGINT", "a div b"),
    ("dec_mul", "a DECIMAL(24,12), b DECIMAL(24,12)", "DECIMAL(38,12)", "CAST(CASE WHEN a * b >= 0 THEN floor(a * b, 12) ELSE ceil(a * b, 12) END AS DECIMAL(38,12))"),
    ("dec_div", "a DECIMAL(24,12), b DECIMAL(24,12)", "DECIMAL(38,12)", "CAST(CASE WHEN a / b >= 0 THEN floor(a / b, 12) ELSE ceil(a / b, 12) END AS DECIMAL(38,12))"),
    ("difference", "a STRING, b STRING", "INT", "IF(a IS NULL OR b IS NULL, 0, aggregate(sequence(1, 4), 0, (n, i) -> n + IF(substring(soundex(a), i, 1) = substring(soundex(b), i, 1), 0, 1)))"),
)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; plain expressions, inlined by the optimizer."""
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
