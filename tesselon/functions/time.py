"""Scalar functions of timestamps and steps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)) / 1440.0


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts) / 7.0


def day_of_month(ts: Column) -> Column:
    return (F.dayofmonth(ts) - 1) / 31.0


def day_of_year(ts: Column) -> Column:
    return (F.dayofyear(ts) - 1) / 366.0


def mark(feature: Column) -> Column:
    """A time feature from 0 to 1 as a mark about 0."""
    return feature - 0.5


def frequency_minutes(first: Column, second: Column) -> Column:
    """Whole minutes between a series' first two time stamps; NULL unless that is positive."""
    us = F.unix_micros(second.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    minutes = F.floor(us / F.lit(60_000_000)).cast("int")
    return F.when(minutes > 0, minutes)


def require_frequency(first: Column, second: Column) -> Column:
    """frequency_minutes; none is an error."""
    return F.coalesce(frequency_minutes(first, second), F.raise_error(F.lit("the first two time stamps must be a minute apart or more")).cast("int"))


def cosine_rate(step: Column, warmup: int, total: int, cycles: float = 0.5) -> Column:
    """Linear warm-up to 1, then a cosine to 0."""
    done = (step - warmup) / float(max(1, total - warmup))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(
        F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(F.lit(math.pi * cycles * 2.0) * done))))


def restart_rate(step: Column, warmup: int, total: int, cycles: int = 2) -> Column:
    """Linear warm-up, then a cosine that starts again `cycles` times."""
    done = (step - warmup) / float(max(1, total - warmup))
    part = cycles * done - F.floor(cycles * done)
    return (F.when(step < warmup, step / float(max(1, warmup)))
            .when(done >= 1.0, 0.0).otherwise(F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(F.lit(math.pi) * part)))))


def curriculum_length(epoch: Column, warmup: int, epochs: int, step: int, full: int) -> Column:
    """Horizon steps that count in an epoch: all in the warm-up, then a growing prefix."""
    return F.when(epoch <= warmup, full).otherwise(F.least((F.floor((epoch - 1 - warmup) / epochs) + 1) * step, F.lit(full))).cast("int")
