"""Sinks: each writes with Spark's own writers, in parallel."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.sampling import registry
from . import store
from .arrays import bucket
from .ranged import write_dat
from .scratch import kept


def write_cells(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """An index partitioned by cell, so that a cell is read alone; appends. A cell with many rows is written by several tasks.

    order: rows get `at`, their place in the cell from 0 (of one write), and lie in that order, so that rows at
    given places are found without numbering the cell again."""
    if order:
        rows = kept(registry(df, [F.col("cell"), *map(F.col, order)], name="number_"), "cells")
        first = rows.groupBy("cell").agg(F.min("number_").alias("first_"))
        df = rows.join(first, "cell").withColumn("at", F.col("number_") - F.col("first_")).drop("number_", "first_")
    df.hint("rebalance", "cell").sortWithinPartitions("cell", *["at"] * bool(order)).write.partitionBy("cell").mode("append").parquet(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """Corpus rows in order of cell and pos: values as raw float32 with their measured shape, and where each row came from
    (all other columns) beside them; see ranged.write_dat."""
    write_dat(df, path, ["cell", "pos"])


def write_manifest(df: DataFrame, path: str) -> None:
    """A JSON line for each cell: {"index", "results": items in order of pos}, in folders by hash of the cell."""
    item = F.struct("pos", F.struct(*[c for c in df.columns if c not in ("cell", "pos")]).alias("item"))
    rows = df.groupBy(F.col("cell").cast("string").alias("index")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("results"))
    rows.withColumn("bucket", bucket(F.col("index"))).repartition("bucket").write.partitionBy("bucket").mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV with time stamps as text."""
    df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).write.mode("overwrite").csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics of rows (h, …) as one JSON object: overall (h = 0) and horizon_h, a row a horizon."""
    names = [c for c in df.columns if c != "h"]
    name = F.when(F.col("h") == 0, "overall").otherwise(F.concat(F.lit("horizon_"), F.col("h").cast("string")))
    _one_object(df.select("h", name.alias("k"), F.struct(*names).alias("v")), F.struct("h", "k", "v"), path)


def _one_object(df: DataFrame, row: Column, path: str) -> None:
    """One JSON object from rows (order, k, v), as few as a report has."""
    rows = F.sort_array(F.collect_list(row))
    whole = F.map_from_entries(F.transform(rows, lambda x: F.struct(x["k"], x["v"])))
    df.agg(F.to_json(whole).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_registry(df: DataFrame, path: str) -> None:
    """Registry rows (id, path), once as a table below path/rows, and from that both ways: JSON lines {"id": path} below
    path/by_id, {"path": id} below path/by_path.

    Each line is an object; together they are the registry, and no task holds all of it."""
    df.select(F.col("id").cast("long").alias("id"), "path").write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema("id long, path string").parquet(f"{path}/rows")
    rows.select(F.to_json(F.create_map(F.col("id").cast("string"), "path")).alias("value")).write.mode("overwrite").text(f"{path}/by_id")
    rows.select(F.to_json(F.create_map("path", "id")).alias("value")).write.mode("overwrite").text(f"{path}/by_path")


def write_rates(rates: DataFrame, weights: DataFrame, report: DataFrame, path: str) -> None:
    """Outputs of the weight step: rates and weights as Parquet, the report (one row) as a JSON object."""
    write_table(rates, f"{path}/rates")
    write_table(weights, f"{path}/weights")
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_results(df: DataFrame, path: str) -> None:
    """Results of a test (batch, place in the batch, …) with their place in the whole: offset, behind all batches before.

    A row a batch meets in one place, no more."""
    sizes = df.groupBy("batch").agg(F.count("*").alias("n"))
    before = sizes.select("batch", (F.sum("n").over(Window.orderBy("batch")) - F.col("n")).alias("before"))
    rows = df.join(before, "batch").withColumn("offset", F.col("before") + F.col("place")).drop("before")
    rows.repartitionByRange("offset").sortWithinPartitions("offset").write.mode("overwrite").parquet(path)


def write_validation(summary: DataFrame, bad: DataFrame, path: str) -> None:
    """A report in two parts: {path}/summary and {path}/bad."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    bad.write.mode("overwrite").json(f"{path}/bad")


def write_table(df: DataFrame, path: str) -> None:
    """Codes, errors, embeddings, cells, codebooks, rates and weights: plain Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_texts(df: DataFrame, path: str) -> None:
    """Rows (name, value) as files path/name, each written whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = f"{path}/.{name}.{uuid.uuid4().hex}"
                with store.created(new) as f:
                    f.write(value.encode())
                store.move(new, f"{path}/{name}")
            yield b.select(["name"])

    df.select("name", "value").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def write_npz(df: DataFrame, path: str, shape: list[int] | None = None) -> None:
    """Rows (file, array, i, values) as path/<file>.npz: each array has the values of its rows, in order of i, as its rows.

    shape: of what a row of values stands for, for arrays of more dimensions; an array of one row has no leading
    axis. A file is made in one task: such files are small (curves, labels, parts of a dataset)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for name, part in rows.groupby("array"):
            x = np.stack(part.sort_values("i")["values"].to_numpy()).astype(np.float64)
            held[name] = x.reshape(len(x), *shape) if shape and len(x) > 1 else x[0] if len(x) == 1 else x
        content = io.BytesIO()
        np.savez(content, **held)
        new = f"{path}/.{key[0]}.{uuid.uuid4().hex}"
        with store.created(new) as f:
            f.write(content.getvalue())
        store.move(new, f"{path}/{key[0]}.npz")
        return pd.DataFrame({"file": [key[0]]})

    df.select("file", "array", "i", "values").groupBy("file").applyInPandas(run, "file string").write.format("noop").mode("overwrite").save()
