"""Registries, audits and reproducible sampling: all draws are by md5 of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept


def draw(seed: int | Column, *keys: str) -> Column:
    """A row's place in the lottery."""
    return F.md5(F.concat_ws(":", (F.lit(seed) if isinstance(seed, int) else seed).cast("string"), *[F.col(k).cast("string") for k in keys]))


def registry(paths: DataFrame, order: list[Column], ranges: int | None = None, name: str = "id") -> DataFrame:
    """Adds a column (id, or as name says): dense numbers from 0 in the given order, without ties; a table without rows stays empty.

    The rows are sorted in ranges, each in a task of its own, and written with their place in the
    range. Numbers come from that one written table: a range's begin after those of the ranges
    before it, so only the ranges' sizes meet in one place, and nothing is sorted twice."""
    spark = paths.sparkSession
    if ranges is None:
        ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place, part = "place_", F.shiftright("place_", 33).alias("part_")
    in_order = paths.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    held = kept(in_order.withColumn(place, F.monotonically_increasing_id()), "registry")  # the range's number, then the row's in 33 bits
    sizes = held.groupBy(part).agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    rows = held.withColumn("part_", part).join(F.broadcast(before), "part_")  # a row for each range
    return rows.withColumn(name, F.col("before_") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop("part_", "before_", place)


def missing(sources: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    return sources.join(outputs, key, "left_anti")


def require_all(sources: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """outputs, if every source has one; else an error that names one that has none."""
    lost = missing(sources, outputs, key).head(1)
    if lost:
        raise ValueError(f"no output for {key} = {lost[0][key]!r}")
    return outputs


def quota(df: DataFrame, cell: str, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows of every cell that has any, with pos 1..n: without repetition as far as they go, then repeated.

    Row pos > count is the row whose number is the hash of pos, modulo the count."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(cell).orderBy(draw(seed, cell, *keys), *keys)))
    kept = ranked.where(F.col("rank") <= n)
    counts = df.groupBy(cell).agg(F.count("*").alias("have")).where(F.col("have") < n)
    more = counts.withColumn("pos", F.explode(F.sequence((F.col("have") + 1).cast("int"), F.lit(n))))
    pick = F.conv(F.substring(draw(seed, cell, "pos"), 1, 8), 16, 10).cast("long") % F.col("have") + 1
    more = more.withColumn("rank", pick.cast("int")).join(kept, [cell, "rank"])
    return kept.withColumn("pos", F.col("rank")).drop("rank").unionByName(more.drop("have", "rank"))


def cell_sample(df: DataFrame, cell: str, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """min(n, count) different rows of each cell."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(cell).orderBy(draw(seed, cell, *keys), *keys)))
    return ranked.where(F.col("rank") <= n).drop("rank")


def subset(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of all."""
    return df.orderBy(draw(seed, *keys), *keys).limit(n)


def place(room: Column, seed: str, *keys: str) -> Column:
    """A number from 0 to room, drawn by hash of the seed column and the keys."""
    return (F.conv(F.substring(draw(F.col(seed), *keys), 1, 8), 16, 10).cast("long") % (room + 1)).cast("int")


def crop(df: DataFrame, size: int, seed: str, *keys: str) -> DataFrame:
    """Adds crop_start and crop_len: a range of at most size elements of values, its start by hash of the seed column."""
    start = place(F.greatest(F.lit(0), F.size("values") - size), seed, *keys)
    return df.withColumn("crop_start", start).withColumn("crop_len", F.least(F.lit(size), F.size("values")))


def weighted(df: DataFrame, weights: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(i, key) for i = 1..n: keys drawn by weight through the inverse of their cumulative shares.

    weights (key, w), any number of rows; those of null or no weight are never drawn. They are numbered in order
    of key and written, shares are summed up by ranges, and draws and bounds meet in a merge: both are
    sorted by their place from 0 to 1 in ranges, where each draw takes the last bound before it. An
    error if no weight is positive."""
    held = registry(weights.where("w > 0").select(key, F.col("w").cast("double").alias("w")), [F.col(key)])
    held = kept(held.withColumn("part_", F.floor(F.col("id") / 65536)), "weights")  # sums of so many rows at a time
    whole = held.groupBy("part_").agg(F.sum("w").alias("s_"))
    before = whole.select("part_", (F.sum("s_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s_")).alias("before_"))
    total = whole.agg(F.sum("s_")).first()[0]
    if not total:
        raise ValueError("no cell has a positive weight")
    so_far = F.sum("w").over(Window.partitionBy("part_").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    bounds = held.join(before, "part_").select(((F.col("before_") + so_far) / total).alias("at"), F.lit(0).alias("i"), F.col("id").alias("bound"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    draws = df.sparkSession.range(1, n + 1).toDF("i").select(u.alias("at"), "i", F.lit(None).cast("long").alias("bound"))
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = bounds.unionByName(draws).repartitionByRange(ranges, "at").withColumn("part_", F.spark_partition_id())
    rows = kept(rows, "draws")  # ranges are dealt by a sample: written once, they stay as they are
    top = rows.groupBy("part_").agg(F.max("bound").alias("top_"))
    carried = top.select("part_", F.max("top_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))  # a row a range
    last = F.max("bound").over(Window.partitionBy("part_").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.join(F.broadcast(carried), "part_").withColumn("id", F.coalesce(last, "carried_", F.lit(0).cast("long"))).where("i > 0")
    return found.select("i", "id").join(held.select("id", key), "id").select("i", key)


