"""Metrics of forecasts over rows (keys, prediction, target). Missing values are NULL.

A target counts unless it is NULL or within 5e-5 of null_val. Where a counted target has no
prediction, MAE, MSE, MAPE and SMAPE take an error of 0, as a NaN error does there; WAPE, R2
and Huber take a prediction of 0."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 5e-5


def counted(null_val: float | None = None, rtol: float = 0.0) -> Column:
    t = F.col("target")
    if null_val is None:
        return t.isNotNull()
    return t.isNotNull() & (F.abs(t - null_val) > EPS + rtol * abs(null_val))


def _masked(error: Column, mask: Column) -> Column:
    return F.coalesce(F.sum(F.when(mask, F.coalesce(error, F.lit(0.0)))) / F.sum(F.when(mask, 1.0)), F.lit(0.0))


def mae(null_val: float | None = None) -> Column:
    return _masked(F.abs(F.col("prediction") - F.col("target")), counted(null_val))


def mse(null_val: float | None = None) -> Column:
    d = F.col("prediction") - F.col("target")
    return _masked(d * d, counted(null_val, 1e-5))


def rmse(null_val: float | None = None) -> Column:
    return F.sqrt(mse(null_val))


def mape(null_val: float | None = None) -> Column:
    t = F.col("target")
    return _masked(F.abs((F.col("prediction") - t) / t), counted(null_val, 1e-5) & (F.abs(t) > EPS))


def smape(null_val: float | None = None) -> Column:
    p, t = F.col("prediction"), F.col("target")
    return _masked(F.abs(p - t) / ((F.abs(p) + F.abs(t)) / 2), counted(null_val, 1e-5) & (F.abs(t) > EPS))


def huber(null_val: float | None = None, delta: float = 1.0) -> Column:
    """Rows that don't count are errors of 0, in the denominator too."""
    d = F.abs(F.coalesce("prediction", F.lit(0.0)) - F.col("target"))
    loss = F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))
    return F.avg(F.when(counted(null_val, 1e-5), loss).otherwise(0.0))


def weight(null_val: float | None = None) -> Column:
    """How much a batch counts in a running mean: all its elements without a null value, missing ones too; with one, those that differ from it."""
    t = F.col("target")
    return F.count("*") if null_val is None else F.count_if(t.isNull() | (F.abs(t - null_val) > EPS))


#: Metrics that one aggregation gives, by name; `register` adds more.
METRICS = {"mae": mae, "mse": mse, "rmse": rmse, "mape": mape, "smape": smape, "huber": huber}


def register(name: str, metric: Callable[..., Column]) -> None:
    """A metric of one's own under a name: a function that gives an aggregate, of whichever arguments it names."""
    METRICS[name.lower()] = metric


def resolve(name: str, **known) -> Column:
    """The metric of that name with those of the known arguments that its signature has; an unknown name is an error."""
    metric = METRICS.get(name.lower())
    if metric is None:
        raise ValueError(f"no metric {name!r}, there are {', '.join(sorted(METRICS))}")
    return metric(**{k: v for k, v in known.items() if k in signature(metric).parameters})


def wape(df: DataFrame, series: list[str], null_val: float | None = None) -> DataFrame:
    """Mean over series of the error's share of the targets."""
    mask = counted(null_val, 1e-5)
    d = F.abs(F.coalesce("prediction", F.lit(0.0)) - F.col("target"))
    by = df.groupBy(*series).agg((F.coalesce(F.sum(F.when(mask, d)), F.lit(0.0)) / (F.coalesce(F.sum(F.when(mask, F.abs("target"))), F.lit(0.0)) + EPS)).alias("r"))
    return by.agg(F.avg("r").alias("wape"))


def r2(df: DataFrame, series: list[str], null_val: float | None = None) -> DataFrame:
    """Mean over series of 1 - residual / total squares; what doesn't count is 0 on both sides."""
    mask = counted(null_val)
    df = df.select(*series, F.when(mask, F.coalesce("prediction", F.lit(0.0))).otherwise(0.0).alias("p"), F.when(mask, F.col("target")).otherwise(0.0).alias("t"))
    # the sum of squares about the mean is n times the population variance
    by = df.groupBy(*series).agg((1 - F.sum((F.col("t") - F.col("p")) * (F.col("t") - F.col("p"))) / (F.var_pop("t") * F.count("*") + EPS)).alias("r"))
    return by.agg(F.avg("r").alias("r2"))


def corr(df: DataFrame, series: list[str], null_val: float | None = None) -> DataFrame:
    """Pearson correlation over time, by counted targets; 0 for series with a missing value or without variance."""
    whole = F.count("*") == F.count(F.col("prediction") + F.col("target"))
    c = F.when((F.stddev_pop("prediction") > 0) & (F.stddev_pop("target") > 0), F.corr("prediction", "target"))
    by = df.groupBy(*series).agg(F.when(whole, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias("c"), F.sum(F.when(counted(null_val), 1).otherwise(0)).alias("n"))
    return by.agg(F.coalesce(F.sum(F.col("c") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("corr"))
