"""Array files as tables: npy and raw floats by ranges (see ranged), npz by Spark's binary reader, side files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.sizes import small
from .ranged import scan_dat
from .ranged import scan_npy as read_npy  # noqa: F401
from .scratch import kept

#: Folders of a manifest, by hash of the cell.
BUCKETS = 64


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of numbers as one Arrow array of lists, NaN as NULL."""
    flat = np.ascontiguousarray(x, np.float64).reshape(-1)
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=np.isnan(flat)))


def read_npz(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(path, index, values) of one array of every .npz file below root: a row for each entry of its leading axes.

    index holds the place in the leading axes; a missing key is an error of the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as z:
                    if key not in z:
                        raise KeyError(f"{key} not in {path}")
                    x = np.atleast_1d(z[key])
                flat = x.reshape(-1, x.shape[-1])
                places = [list(p) for p in np.ndindex(*x.shape[:-1])] or [[]]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(flat)), pa.array(places, pa.list_(pa.int32())), _lists(flat)], names=["path", "index", "values"])

    return files.select("path", "content").mapInArrow(run, "path string, index array<int>, values array<double>")


def read_metric_logs(spark: SparkSession, root: str, key: str = "mean_bin", first: int = 0, last: int = 1 << 31) -> DataFrame:
    """(iter, bin, perf) from files *_<iter>.npz with iterations from first to last, both included."""
    df = read_npz(spark, root, key).withColumn("iter", F.regexp_extract("path", r"_(\d+)\.npz$", 1))
    df = df.where("iter <> ''").withColumn("iter", F.col("iter").cast("int")).where(F.col("iter").between(first, last))
    return df.select("iter", F.posexplode("values").alias("bin", "perf"))


def read_floats(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(row, values) of a raw float32 file of `width` numbers a row, in ranges."""
    return scan_dat(spark, path, width).select("row", F.col("values").cast("array<double>").alias("values"))


#: Suffixes of array files in the order in which they are tried, and the field of the side file that each asks for.
SUFFIXES = [("_past_feat_dynamic_real", "past_feat_dynamic_real_valid_indices"), ("_feat_dynamic_real", "feat_dynamic_real_valid_indices"),
            ("_values", "valid_indices"), ("_data", "valid_indices")]


def validity_field(path: Column, direct: Column) -> Column:
    """The field of a side file with an array file's ranges: valid_indices where the side file has the array's own
    name (direct), else by the suffix in the array's name; NULL without one."""
    field = F.lit(None).cast("string")
    for suffix, name in reversed(SUFFIXES):
        field = F.when(F.contains(F.substring_index(path, "/", -1), F.lit(suffix)), F.lit(name)).otherwise(field)
    return F.when(direct, F.lit("valid_indices")).otherwise(field)


def read_side_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): JSON files as whole texts."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).select(
        F.col("_metadata.file_path").alias("path"), "value")


def resolve_validity(files: DataFrame, side: DataFrame) -> DataFrame:
    """(path, n, c, start, end): valid ranges of array files (path) by their side files (path, value: JSON).

    A file without side file, and a side file without the field that the array's name asks for,
    are errors that name the file. Side files are read once: what they resolve to is written, and
    errors are looked for there."""
    there = side.select(F.col("path").alias("meta"), F.lit(True).alias("there"), "value")
    tries = _tries(files).join(there, "meta", "left")
    hit = F.min(F.when(F.col("there"), F.struct("k", "meta", "value"))).alias("hit")
    held = tries.groupBy("path").agg(hit).select("path", "hit.meta", "hit.value")
    field = validity_field(F.col("path"), F.col("meta") == F.regexp_replace("path", r"\.npy$", ".json"))
    v = F.from_json(F.element_at(F.from_json("value", "map<string,string>"), field), "array<array<array<int>>>")
    held = kept(held.select("path", F.col("meta").isNotNull().alias("found"), v.alias("v")), "validity")
    if missing := held.where("NOT found").head(1):
        raise ValueError(f"no side file for {missing[0].path!r}")
    if missing := held.where("v IS NULL").head(1):
        raise ValueError(f"no valid ranges for {missing[0].path!r}")
    return _ranges(held)


def _ranges(held: DataFrame) -> DataFrame:
    rows = held.select("path", F.posexplode("v").alias("n", "by_c")).select("path", "n", F.posexplode("by_c").alias("c", "r"))
    return rows.select("path", "n", "c", F.get("r", F.lit(0)).alias("start"), F.get("r", F.lit(1)).alias("end"))


def read_validity(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, c, start, end) from side files alone, by the first field that they have; resolve_validity goes by the array's name."""
    keys = ["valid_indices", *[name for _, name in SUFFIXES[:2]]]
    kind = "struct<" + ",".join(f"{k}:array<array<array<int>>>" for k in keys) + ">"
    raw = read_side_files(spark, path).select("path", F.from_json("value", kind).alias("j"))
    return _ranges(raw.select("path", F.coalesce(*[F.col(f"j.{k}") for k in keys]).alias("v")))


def metadata_path(path: F.Column) -> F.Column:
    """The side file of an array file: its name without the ending and the suffix of its kind."""
    return F.concat(F.regexp_replace(path, r"(?:_past_feat_dynamic_real|_feat_dynamic_real|_values|_data)?\.npy$", ""), F.lit(".json"))


def read_inference(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    """(ts, node, v) from CSV without header: a time stamp, then a number for each node."""
    schema = "ts string, " + ", ".join(f"v{i} double" for i in range(nodes))
    df = spark.read.csv(path, schema=schema, header=False)
    df = df.select(F.to_timestamp_ntz("ts", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.posexplode(F.array(*[f"v{i}" for i in range(nodes)])).alias("node", "v"))
    return df


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, path) from a JSON object of paths by number, or from many, one a line."""
    raw = spark.read.option("wholetext", not path.rstrip("/").endswith("by_id")).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "path")).select(F.col("id").cast("int").alias("id"), "path")


def read_description(spark: SparkSession, path: str) -> DataFrame:
    """One row from a dataset's JSON description."""
    return spark.read.json(path, multiLine=True)


def read_labelled(spark: SparkSession, root: str, mode: str, key: str = "arr_0") -> DataFrame:
    """(row, inputs, label) of a labelled dataset's split from array files root/mode_inputs.npz and root/mode_labels.npz.

    valid is the test split. Rows of inputs that have several channels are flattened, the last axis fastest."""
    name = f"{root}/{'test' if mode == 'valid' else mode}"
    x = read_npz(spark, f"{name}_inputs.npz", key).withColumn("row", F.get("index", F.lit(0)))
    x = x.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("index", "values"))), lambda r: r["values"])).alias("inputs"))
    y = read_npz(spark, f"{name}_labels.npz", key).select(F.posexplode("values").alias("row", "label"))
    return x.join(y, "row").select("row", "inputs", F.col("label").cast("int").alias("label"))


def read_splits(spark: SparkSession, root: str, mode: str) -> DataFrame:
    """Rows of a labelled dataset's split (Parquet below root/mode); valid is the test split."""
    return spark.read.parquet(f"{root}/{'test' if mode == 'valid' else mode}")


def read_cell(spark: SparkSession, path: str, cell: int) -> DataFrame:
    """Rows of one cell of an index written by cell: only its folder is read; no rows for an absent cell."""
    return spark.read.parquet(path).where(F.col("cell") == cell)


def read_places(spark: SparkSession, path: str, cell: int, order: list[str], places: DataFrame) -> DataFrame:
    """Rows of a cell at given places (turn, at), in the order of turn; at counts from 0 by the order columns.

    An index written with its order holds places: only the row groups between the least and the greatest are read."""
    rows, asked = read_cell(spark, path, cell), small(places)
    if "at" in rows.columns:
        low, high = places.agg(F.min("at"), F.max("at")).first()
        rows = rows.where(F.col("at").between(low, high)) if low is not None else rows.where("false")
    else:
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy(*order)) - 1)
    return rows.join(asked, "at").orderBy("turn")


def read_manifest(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """Manifest lines, or the one of a cell, for which only one folder is read."""
    df = spark.read.json(path)
    if index is not None:
        df = df.where((F.col("bucket") == bucket(F.lit(index))) & (F.col("index") == index))
    return df.drop("bucket")


def bucket(index: Column) -> Column:
    """The folder of a cell's manifest line."""
    return F.pmod(F.crc32(index), F.lit(BUCKETS)).cast("int")


def load_array(content: bytes, name: str, key: str | None = None) -> np.ndarray:
    """An array from a small file's bytes: .npy; .npz by key, arr_0 or its only array; else comma-separated text."""
    if name.endswith(".npy"):
        return np.load(io.BytesIO(content), allow_pickle=False)
    if name.endswith(".npz"):
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            for k in (key, "arr_0", z.files[0] if len(z.files) == 1 else None):
                if k and k in z.files:
                    return z[k]
            raise KeyError(f"{name} has {z.files}")
    return np.loadtxt(io.BytesIO(content), delimiter=",")


def read_codebook(spark: SparkSession, path: str, codes: int, dims: int) -> DataFrame:
    """(code, e), once it is known to have so many codes of so many numbers."""
    df = spark.read.parquet(path).select("code", "e")
    rows, short, long = df.agg(F.count("*"), F.min(F.size("e")), F.max(F.size("e"))).first()
    if (rows, short, long) != (codes, dims, dims):
        raise ValueError(f"codebook is {rows} x {short}..{long}, not {codes} x {dims}")
    return df


def walk_order(path: F.Column) -> list[F.Column]:
    """Order of a registry: files by folder, in a folder its files before its sub-folders, all by name."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    # a file's own level sorts before the folders of that level
    return [F.concat(F.transform(folders, lambda f: F.concat(F.lit("1"), f)), F.array(F.concat(F.lit("0"), F.element_at(parts, -1))))]


def _tries(files: DataFrame) -> DataFrame:
    """(path, k, meta): names that an array file's side file can have, in the order in which they are tried."""
    direct = F.regexp_replace("path", r"\.npy$", ".json")
    return files.select("path", F.posexplode(F.array(direct, metadata_path(F.col("path")))).alias("k", "meta"))


def find_metadata(files: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, lost): array files (path) with their side file, directly by name or without the suffix of the kind; those with none."""
    hits = _tries(files).join(side.select(F.col("path").alias("meta")), "meta").groupBy("path").agg(F.min_by("meta", "k").alias("meta"))
    return hits, files.join(hits, "path", "left_anti")
