"""The library's functions for SQL: each is an expression that Spark puts in place of the call, so nothing leaves the JVM.

A metric of SQL text is an average of its error, which is NULL where a target doesn't count:

    SELECT coalesce(avg(abs_error(prediction, target, NULL)), 0) AS mae FROM forecasts

and `patches` cuts an array into overlapping parts, to be exploded by the query around it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .metrics import EPS

#: Whether a target t counts beside a null value (none: NULL).
_COUNTS = f"t IS NOT NULL AND (null_val IS NULL OR abs(t - null_val) > {EPS} + {{rtol}} * abs(null_val))"
_ERRORS = {  # error where both are known, and what else a target must be
    "abs_error": ("abs(p - t)", 0.0, "true"),
    "square_error": ("(p - t) * (p - t)", 1e-5, "true"),
    "share_error": ("abs((p - t) / t)", 1e-5, f"abs(t) > {EPS}"),
    "symmetric_error": ("abs(p - t) / ((abs(p) + abs(t)) / 2)", 1e-5, f"abs(t) > {EPS}"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session's SQL, in place of earlier ones of these names; their names."""
    made = []
    for name, (error, rtol, also) in _ERRORS.items():
        counts = _COUNTS.format(rtol=rtol)
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(p DOUBLE COMMENT 'prediction', t DOUBLE COMMENT 'target', null_val DOUBLE) RETURNS DOUBLE
          RETURN CASE WHEN {counts} AND {also} THEN CASE WHEN p IS NULL THEN 0.0D ELSE {error} END END""")
        made.append(name)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION patches(x ARRAY<DOUBLE>, width INT, stride INT) RETURNS ARRAY<ARRAY<DOUBLE>>
      RETURN CASE WHEN size(x) >= width THEN transform(sequence(0, CAST(floor((size(x) - width) / stride) AS INT)), k -> slice(x, k * stride + 1, width)) ELSE array() END""")
    return [*made, "patches"]
