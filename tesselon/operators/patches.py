"""Patches of series and their codes: validity, levels, overlap-add, pair merging, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import frame_mask, frames, merge_mask


def patches(df: DataFrame, size: int, stride: int) -> DataFrame:
    """(keys, p, patch, ok): patches of values; ok if no value is missing."""
    rest = [c for c in df.columns if c != "values"]
    return df.select(*rest, F.posexplode(frames("values", size, stride)).alias("p", "patch")).withColumn("ok", F.forall("patch", lambda v: v.isNotNull()))


def level_masks(df: DataFrame, size: int, stride: int, levels: list[int]) -> DataFrame:
    """(keys, mask): masks of all levels, the coarsest first; levels: their sizes from coarse to fine.

    The finest mask is that of the patches; each coarser one merges the next finer one."""
    rest = [c for c in df.columns if c != "values"]
    df = df.select(*rest, frame_mask(frames("values", size, stride)).alias("m"))
    found = F.col("m")
    masks = [found]
    for k, n in enumerate(reversed(levels)):
        df = df.withColumn(f"m{k}", merge_mask(masks[-1], n))
        masks.append(F.col(f"m{k}"))
    return df.select(*rest, F.concat(*reversed(masks[1:])).alias("mask"))


def overlap_add(df: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """(keys, t, value): patches (p, patch) put back; where they overlap, their mean."""
    rows = df.select(*keys, "p", F.posexplode("patch").alias("o", "v"))
    return rows.groupBy(*keys, (F.col("p") * stride + F.col("o")).alias("t")).agg(F.avg("v").alias("value"))


def split_scales(codes: Column | str, sizes: list[int]) -> Column:
    """Array of structs (s, codes): consecutive scales of a code array."""
    codes = F.col(codes) if isinstance(codes, str) else codes
    at, parts = 1, []
    for s, n in enumerate(sizes):
        parts.append(F.struct(F.lit(s).alias("s"), F.slice(codes, at, n).alias("codes")))
        at += n
    return F.array(*parts)


def valid_length(codes: Column | str, finest: int, stride: int) -> Column:
    """stride times the number of valid codes of the finest scale, the last `finest` ones."""
    codes = F.col(codes) if isinstance(codes, str) else codes
    last = F.slice(codes, F.greatest(F.lit(1), F.size(codes) - finest + 1), F.lit(finest))
    return stride * F.size(F.filter(last, lambda c: c.isNotNull()))


def merge_pairs(values: Column | str) -> Column:
    """Neighbours joined two by two; an odd one at the end is joined with 0."""
    values = F.col(values) if isinstance(values, str) else values
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / 2).cast("int") - 1),
                       lambda i: F.array(F.get(values, 2 * i), F.coalesce(F.get(values, 2 * i + 1), F.lit(0.0))))


def expand_pairs(pairs: Column | str, size: Column) -> Column:
    """The inverse of merge_pairs for size elements."""
    return F.slice(F.flatten(F.col(pairs) if isinstance(pairs, str) else pairs), F.lit(1), size)


def attention_windows(df: DataFrame, keys: list[str], window: int, value: str = "value", shift: int = 0) -> DataFrame:
    """(keys, window, values): arrays of window elements of rows (t from 1), zeros behind the last row.

    shift moves the whole padded series to the left, and what leaves in front comes in again
    behind; a series of one window isn't moved."""
    rows = F.sort_array(F.collect_list(F.struct("t", F.coalesce(F.col(value), F.lit(0.0)).alias("v"))))
    packed = df.groupBy(*keys).agg(F.transform(rows, lambda x: x["v"]).alias("v"))
    short = F.pmod(-F.size("v"), F.lit(window))
    packed = packed.select(*keys, F.concat("v", F.array_repeat(F.lit(0.0), short)).alias("v"))
    by = F.when(F.size("v") > window, shift).otherwise(0)
    packed = packed.select(*keys, F.concat(F.slice("v", by + 1, F.size("v")), F.slice("v", F.lit(1), by)).alias("v"))
    parts = F.transform(F.sequence(F.lit(0), (F.size("v") / window).cast("int") - 1), lambda i: F.slice("v", i * window + 1, F.lit(window)))
    return packed.select(*keys, F.posexplode(parts).alias("window", "values"))
