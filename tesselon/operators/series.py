"""Series: order, splits, windows and scalers over long tables (keys, t, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Adds t: the place in the series, from 1."""
    return df.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def pack(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, values): one array a series, in order of t; NULLs stay."""
    rows = F.sort_array(F.collect_list(F.struct("t", F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["v"]).alias("values"))


def zscore(df: DataFrame, keys: list[str], floor: float, value: str = "value") -> DataFrame:
    """(keys, values): packed series of mean 0 and deviation 1 by their valid values; a deviation below the floor is 1.

    One aggregation gives the array and its statistics, so each is computed once."""
    rows = F.sort_array(F.collect_list(F.struct("t", F.col(value).alias("v"))))
    df = df.groupBy(*keys).agg(rows.alias("rows"), F.avg(value).alias("m"), F.stddev_pop(value).alias("d"))
    df = df.withColumn("d", F.when(F.col("d") < floor, 1.0).otherwise(F.col("d")))
    return df.select(*keys, F.transform("rows", lambda x: (x["v"] - F.col("m")) / F.col("d")).alias("values"))


def persistence(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Forecast pairs: the target is a value, the prediction the one before it."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("t"))
    return df.withColumn("prediction", before).withColumnRenamed(value, "target")


def split(df: DataFrame, keys: list[str], valid: float, test: float, window: tuple[int, int] | None = None) -> DataFrame:
    """Adds split: the last int(T*test) rows test, the int(T*valid) before them valid, the rest train.

    window: input and output steps. A split shorter than both together borrows rows from its
    neighbours, which then stand in both: input - 1 rows before it (not train), output rows
    after it (not test), as far as there are any."""
    df, n = df.withColumn("split", F.count("*").over(Window.partitionBy(*keys))), F.col("split")
    v, x = F.floor(n * F.lit(valid)), F.floor(n * F.lit(test))
    bounds = [("train", F.lit(0), n - v - x), ("valid", n - v - x, n - x), ("test", n - x, n)]
    parts = []
    for name, low, high in bounds:
        short = (high - low < sum(window)) if window else F.lit(False)
        before = F.when(short, window[0] - 1 if window and name != "train" else 0).otherwise(0)
        after = F.when(short, window[1] if window and name != "test" else 0).otherwise(0)
        parts.append(F.when((F.col("t") > low - before) & (F.col("t") <= high + after), F.lit(name)))
    return df.withColumn("split", F.explode(F.array_compact(F.array(*parts))))


def sliding(df: DataFrame, keys: list[str], size_in: int, size_out: int, value: str = "value") -> DataFrame:
    """(keys, i, inputs, targets) for every place with whole windows; i from 0.

    Windows are made within keys, so a split belongs into them."""
    w = Window.partitionBy(*keys).orderBy("t")
    rows = df.select(
        *keys, (F.col("t") - F.min("t").over(Window.partitionBy(*keys))).cast("long").alias("i"),
        F.collect_list(value).over(w.rowsBetween(0, size_in - 1)).alias("inputs"),
        F.collect_list(value).over(w.rowsBetween(size_in, size_in + size_out - 1)).alias("targets"))
    return rows.where((F.size("inputs") == size_in) & (F.size("targets") == size_out))


def fit_z(df: DataFrame, keys: list[str], part: Column, value: str = "value") -> DataFrame:
    """(keys, mean, std) of the rows in part; a deviation of 0 becomes 1."""
    d = F.stddev_pop(value)
    return df.where(part).groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(d == 0, 1.0).otherwise(d).alias("std"))


def fit_range(df: DataFrame, keys: list[str], part: Column, value: str = "value") -> DataFrame:
    return df.where(part).groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def unrange(scaled: Column | str, low: Column | str, high: Column | str) -> Column:
    """What min-max scaling by low and high came from."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(scaled) * (c(high) - c(low)) + c(low)


def append(df: DataFrame, more: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Later steps behind a panel, numbered on."""
    return number(df.drop("t").unionByName(more.drop("t")), keys, *order)
