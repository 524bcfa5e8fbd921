"""Tables that the queries start from, and the list of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x) -> F.Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


#: Series per user in order of time; one value in 17 is missing.
PANEL = """panel AS (SELECT user_id, event_type, event_id, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return series.number(df.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id"], "ts", "event_id")


#: Persistence forecasts of the series.
PRED = PANEL + """, pred AS (SELECT user_id, event_type, t, value AS target,
  lag(value) OVER (PARTITION BY user_id ORDER BY t) AS prediction FROM panel)"""


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.persistence(panel(spark, sf_dir), ["user_id"]).select("user_id", "event_type", "t", "prediction", "target")


#: A series as an array.
PACKED = PANEL + ", packed AS (SELECT user_id, list(value ORDER BY t) AS values FROM panel GROUP BY user_id)"


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pack(panel(spark, sf_dir), ["user_id"])
