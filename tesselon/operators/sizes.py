"""Checked broadcasts: a side is sent to all executors only while it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; beyond it Spark joins by shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is; counting stops at the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def gather(df: DataFrame, rows: int, what: str) -> list:
    """All rows of a table that a parameter bounds (a codebook, weights of cells); an error if it has more."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"{what} has more than {rows} rows")
    return found


def required(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """left with the columns of right, in one join; a row of left without partner is an error of the job that names its keys.

    The check is part of the columns that right brings, so it costs no pass of its own."""
    there = "there_"
    rows = left.join(right.withColumn(there, F.lit(True)), keys, "left")
    lost = F.raise_error(F.concat(F.lit(f"{what}: "), F.to_json(F.struct(*keys))))
    brought = [c for c in right.columns if c not in keys]
    checked = {c: F.when(F.col(there).isNull(), lost).otherwise(F.col(c)) for c in brought or keys[:1]}
    return rows.withColumns(checked).drop(there)
