"""Streams with state: moving codebook sizes and sums, dead codes, and meters, batch by batch.

State is kept by Spark's state store under the key of a code or meter; results go to a table that is
upserted once a batch (see index). What depends on time goes by the step that a row carries, not by the
micro-batch it happens to come in, so results don't depend on how steps are dealt to batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import index

_EMA = "code long, step long, size double, total array<double>"


def moving_sums(stream: DataFrame, decay: float, start: float = 1.0) -> DataFrame:
    """A stream of (code, step, size, total) from one of assigned vectors (code, step, e): of each changed code the newest.

    In each step a code's size and sum decay, and (1 - decay) of the step's number and sum of vectors is added. A
    code that a step has no vectors of only decays, which is made up for when it is next seen; see at_step. As all
    this is linear, vectors of a step that was passed already are added with what is left of them by now: steps may
    come late and in parts. A code has size `start` and a sum of 0 before step 1."""
    parts = stream.where(F.col("code").isNotNull() & F.col("step").isNotNull() & F.col("e").isNotNull())

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, size, total = state.get if state.exists else (0, start, 0.0)
        total = np.array(total)
        for f in frames:
            steps, x = f["step"].to_numpy(), np.stack(f["e"].to_numpy())
            now = max(last, int(steps.max()))
            fade, left = decay ** (now - last), (1 - decay) * decay ** (now - steps).astype(np.float64)
            last, size, total = now, size * fade + left.sum(), total * fade + left @ x
        held = [float(v) for v in total]
        state.update((last, float(size), held))
        yield pd.DataFrame({"code": [key[0]], "step": [last], "size": [float(size)], "total": [held]})

    return parts.groupBy("code").applyInPandasWithState(run, _EMA, "step long, size double, total array<double>", "update", GroupStateTimeout.NoTimeout)


def at_step(sums: DataFrame, step: int | Column, decay: float) -> DataFrame:
    """Sizes and sums (code, step, size, total) as they are at a later step without further vectors."""
    fade = F.pow(F.lit(decay), (F.lit(step) if isinstance(step, int) else step) - F.col("step"))
    return sums.select("code", (F.col("size") * fade).alias("size"), F.transform("total", lambda x: x * fade).alias("total"))


def dead(sums: DataFrame, threshold: float) -> DataFrame:
    """Codes whose moving size is below the threshold."""
    return sums.where(F.col("size") < threshold).select("code", "size")


def meters(stream: DataFrame) -> DataFrame:
    """A stream of (meter, n, average, rmse) from one of batches (meter, value, n), n the number of samples behind a value: of each
    changed meter the newest. average: by n, 0 without samples; rmse: the root of the average, for meters of squared errors."""
    some = stream.where(F.col("value").isNotNull())
    sums = some.groupBy("meter").agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("s"))
    average = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    return sums.select("meter", "n", average.alias("average"), F.sqrt(F.greatest(average, F.lit(0.0))).alias("rmse"))


def keep(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the table at target up to date with a stream of changed rows (in update mode), until what is there is done."""

    def put(df: DataFrame, batch: int) -> None:
        index.upsert(df, batch, target, keys)

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def from_files(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive below path, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
