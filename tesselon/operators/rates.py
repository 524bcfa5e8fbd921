"""Convergence rates of cells from validation curves, and reports on weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sizes import required


def rates(curves: DataFrame, mode: str, eps: float = 1e-8) -> DataFrame:
    """(bin, iter, rate) of curves (bin, iter, perf) for every iteration strictly between a bin's first and last."""
    w = Window.partitionBy("bin").orderBy("iter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = curves.select("bin", "iter", "perf", F.first("perf").over(w).alias("p0"), F.last("perf").over(w).alias("p1"),
                       F.first("iter").over(w).alias("i0"), F.last("iter").over(w).alias("i1"))
    df = df.where("i0 < iter AND iter < i1")
    d1, d2, all_ = (F.greatest((a - b).cast("double"), F.lit(eps)) for a, b in
                    ((F.col("iter"), F.col("i0")), (F.col("i1"), F.col("iter")), (F.col("i1"), F.col("i0"))))
    gained, left, whole = F.col("p0") - F.col("perf"), F.col("perf") - F.col("p1"), F.col("p0") - F.col("p1")
    kinds = {"slope": gained / d1, "ratio": gained / d1 / (left / d2 + eps), "progress_ratio": gained / (whole + eps) / (d1 / all_ + eps)}
    if mode not in kinds:
        raise ValueError(f"no rate {mode!r}, there are {', '.join(kinds)}")
    return df.select("bin", "iter", F.greatest(kinds[mode], F.lit(eps)).alias("rate"))


def gather(draws: DataFrame, table: DataFrame) -> DataFrame:
    """draws (iter, bin, …) with the rate of their stage and cell; a draw without one is an error that names it."""
    return required(draws, table.select("iter", "bin", "rate"), ["iter", "bin"], "no rate")


def stage_target(df: DataFrame, mode: str, const: float = 1.0) -> DataFrame:
    """(iter, target): mean, lower median or a constant of an iteration's rates."""
    how = {"mean": F.avg("rate"), "median": F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rate)"), "const": F.lit(const) + 0 * F.count("*")}[mode]
    return df.groupBy("iter").agg(how.alias("target"))


def advantage(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds reward and advantage within groups of (w, rate): the deviation is that of a sample."""
    by = Window.partitionBy(*group)
    df = df.withColumn("x", F.col("w") * F.col("rate"))
    d = F.col("x") - F.avg("x").over(by)
    df = df.withColumn("reward", -d * d)
    return df.withColumn("advantage", (F.col("reward") - F.avg("reward").over(by)) / (F.stddev_samp("reward").over(by) + 1e-6)).drop("x")


def normalize(weights: DataFrame) -> DataFrame:
    """w to a sum of 1, if the sum is positive and finite. A row a cell: the one window is small."""
    total = F.sum("w").over(Window.partitionBy())
    return weights.withColumn("w", F.when((total > 0) & (total < float("inf")), F.col("w") / total).otherwise(F.col("w")))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    some = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return df.agg(F.when(some, F.corr(x, y)).otherwise(0.0).alias("pearson"))


def _top(df: DataFrame, by: str, frac: float, bottom: bool) -> DataFrame:
    order = F.col(by).asc() if bottom else F.col(by).desc()
    k = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy()) * frac))
    return df.withColumn("r", F.row_number().over(Window.orderBy(order, "bin"))).withColumn("k", k).where("r <= k")


def overlap(df: DataFrame, frac: float = 0.1, bottom: bool = False) -> DataFrame:
    """Share of common bins among the k best (or worst) by w and by base, ties by bin."""
    a = _top(df.select("bin", "base"), "base", frac, bottom).select("bin", "k")
    b = _top(df.select("bin", "w"), "w", frac, bottom).select("bin")
    hits = a.join(b.withColumn("hit", F.lit(1)), "bin", "left")
    return hits.agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.max("k")).alias("overlap"))


def mass_recall(df: DataFrame, frac: float = 0.1) -> DataFrame:
    """Base mass of the bins that are best by both, over that of the best by base."""
    a = _top(df.select("bin", "base"), "base", frac, False).select("bin", "base")
    b = _top(df.select("bin", "w"), "w", frac, False).select("bin")
    hits = a.join(b.withColumn("hit", F.lit(1)), "bin", "left")
    return hits.agg((F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("base"))), F.lit(0.0)) / F.greatest(F.sum("base"), F.lit(1e-12))).alias("recall"))


def report(df: DataFrame) -> DataFrame:
    d = F.abs(F.col("w") - F.col("base"))
    return df.agg(F.avg("w").alias("w_mean"), F.stddev_pop("w").alias("w_std"), F.min("w").alias("w_min"), F.max("w").alias("w_max"),
                  F.avg("base").alias("base_mean"), F.stddev_pop("base").alias("base_std"), F.avg(d).alias("diff_mean"), F.max(d).alias("diff_max"))
