"""Counts of cells over arriving index files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import index, states


def cell_counts(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """A stream of (cell, n) from Parquet files as they arrive below path, so many a micro-batch."""
    return states.from_files(spark, path, schema, files).groupBy("cell").agg(F.count("*").alias("n"))


def keep_counts(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Keeps the counts at target up to date: of each batch only the counts of its cells are put in place; see read_counts."""
    return states.keep(cell_counts(spark, source, schema, files), target, ["cell"], checkpoint)


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """(cell, n) as of the last batch."""
    return index.read(spark, target, "cell int, n long")
