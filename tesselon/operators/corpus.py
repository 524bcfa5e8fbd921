"""The balanced corpus: sampled items to series with full provenance, and code-length audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.arrays import clean, segment
from .sampling import place, quota
from .sizes import required


def sample_manifest(usage: DataFrame, n: int, min_valid: int, seed: int = 42) -> DataFrame:
    """(cell, pos, file_id, n, c, s, valid_len): n items of every cell from index rows long enough."""
    long_enough = usage.where(F.col("valid_len") >= min_valid)
    return quota(long_enough, "cell", ["file_id", "n", "c", "s"], n, seed)


def group_items(manifest: DataFrame, k: int) -> DataFrame:
    """The manifest with k items of a cell, one behind the other, as one corpus row: pos from 1, item from 0."""
    return manifest.withColumn("item", (F.col("pos") - 1) % k).withColumn("pos", F.floor((F.col("pos") - 1) / k).cast("int") + 1)


def with_paths(items: DataFrame, registry: DataFrame) -> DataFrame:
    """items (file_id, …) with the path of their file; an unknown file_id is an error that names it."""
    return required(items, registry.select(F.col("id").alias("file_id"), "path"), ["file_id"], "no file")


def index_codes(index: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows with their codes; an index row without codes is an error that names it."""
    return required(index, codes, keys, "no codes")


def with_errors(sample: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Sampled items with their reconstruction errors mae and mse; NULL where none is known."""
    return sample.join(errors.select(*keys, "mae", "mse"), keys, "left")


def _scaled(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Numbers of groups, each to mean 0 and deviation 1 by those that aren't NaN; a deviation below 1e-6 is 1."""
    seen = ~np.isnan(x)
    own, count = group[seen], np.maximum(np.bincount(group[seen], minlength=groups), 1)
    mean = np.bincount(own, x[seen], groups) / count
    d = np.sqrt(np.bincount(own, (x[seen] - mean[own]) ** 2, groups) / count)
    return (x - mean[group]) / np.where(d < 1e-6, 1.0, d)[group]


def composed(parts: pa.Array, size: int, normalise: bool) -> np.ndarray:
    """Corpus rows from lists of series, all of a batch at once: a single series with NaN behind it; several in turn,
    each to size // k values, zeros where one ends, and then normalised once more, zeros included."""
    k = pc.list_value_length(parts).to_numpy()
    series = parts.flatten()
    lengths = pc.list_value_length(series).to_numpy()
    x = series.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.repeat(np.arange(len(lengths)), lengths)  # each value's series
    x = _scaled(x, of, len(lengths)) if normalise else np.nan_to_num(x, posinf=0.0, neginf=0.0)
    row = np.repeat(np.arange(len(k)), k)  # each series' row
    turn, at = np.arange(len(lengths)) - (np.cumsum(k) - k)[row], np.arange(len(x)) - (np.cumsum(lengths) - lengths)[of]
    fits = at < (size // k)[row[of]]
    of, at = of[fits], at[fits]
    out = np.repeat(np.where(k == 1, np.nan, 0.0), size).reshape(len(k), size)
    out[row[of], at * k[row[of]] + turn[of]] = x[fits]
    many = np.flatnonzero(k > 1)
    out[many] = _scaled(out[many].reshape(-1), np.repeat(np.arange(len(many)), size), len(many)).reshape(len(many), size)
    return out


def materialise(manifest: DataFrame, series: DataFrame, size: int, normalise: bool = True) -> DataFrame:
    """Corpus rows (cell, pos, group_size, per_seq_len, items, values).

    manifest: cell, pos, file_id, n, c, s and, for rows of several series, item. series: file_id,
    n, c, values, start, end. Of each item's valid range a part of size // group_size values is
    taken, at a place drawn by the cell; items tell where: start, end, raw_len = end - start,
    crop_start (a place in the whole series) and crop_len. A sampled item without series is an
    error that names it. A series is cut where it meets its item, so only the parts travel on."""
    if "item" not in manifest.columns:
        manifest = manifest.withColumn("item", F.lit(0))
    manifest = manifest.withColumn("group_size", F.count("*").over(Window.partitionBy("cell", "pos")).cast("int"))
    manifest = manifest.withColumn("per_seq_len", F.floor(F.lit(size) / F.col("group_size")).cast("int"))
    df = required(manifest, series.select("file_id", "n", "c", "values", "start", "end"), ["file_id", "n", "c"], "sampled item without series")
    df = df.withColumn("raw_len", F.col("end") - F.col("start"))
    offset = place(F.greatest(F.lit(0), F.col("raw_len") - F.col("per_seq_len")), "cell", "file_id", "n", "c", "pos", "item")
    df = df.withColumn("crop_start", F.col("start") + offset).withColumn("crop_len", F.least("raw_len", "per_seq_len"))
    df = df.withColumn("values", segment("values", "crop_start", F.col("crop_start") + F.col("crop_len")))
    facts = ["item", "file_id", "n", "c", "s", "start", "end", "raw_len", "crop_start", "crop_len"]
    rows = df.groupBy("cell", "pos", "group_size", "per_seq_len").agg(F.sort_array(F.collect_list(F.struct(*facts, "values"))).alias("items"))
    rows = rows.select("cell", "pos", "group_size", "per_seq_len", F.transform("items", lambda x: x.dropFields("values")).alias("items"),
                       F.transform("items", lambda x: F.transform(x["values"], lambda v: v.cast("double"))).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = composed(b.column("values"), size, normalise).reshape(-1)
                made = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=b.schema.names)

    kind = StructType([*rows.schema.fields[:-1], StructField("values", ArrayType(DoubleType()))])
    found = rows.mapInArrow(run, kind)
    return found.withColumn("values", F.transform("values", clean))


def audit_lengths(codes: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(summary, bad): how many code rows there are and how many don't have size codes; those rows."""
    wrong = F.coalesce(F.size("codes") != size, F.lit(True))
    summary = codes.agg(F.count("*").alias("rows"), F.count_if(wrong).alias("bad"), F.min(F.size("codes")).alias("shortest"), F.max(F.size("codes")).alias("longest"))
    return summary, codes.where(wrong).withColumn("length", F.size("codes")).drop("codes")
