"""Principal axes and cells fitted on all vectors: moments are summed where the vectors are and merged in a tree.

What comes to the driver is one row of moments, as large as the vectors' dimension squared, however
many vectors and partitions there are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bin_index, mixed_radix
from . import cells
from .kernels import allocate_bins

#: Partial moments that one task merges.
FAN_IN = 16
_MOMENTS = "n long, mean array<double>, spread array<double>"


def _matrix(values: pa.Array) -> np.ndarray:
    """Vectors (none null) as rows; an error if their lengths differ."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(values):
        raise ValueError("vectors of different lengths")
    sizes = pc.list_value_length(values)
    if pc.min_max(sizes).as_py() != {"min": len(flat) // len(values), "max": len(flat) // len(values)}:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(values), -1)


def merged(a: tuple, b: tuple) -> tuple:
    """Moments (n, mean, sum of outer products of deviations) of two sets together, by means and not by raw sums, which would cancel."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    if len(a[1]) != len(b[1]):
        raise ValueError(f"vectors of {len(a[1])} and of {len(b[1])} numbers")
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _row(m: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[0]]), pa.array([m[1]], pa.list_(pa.float64())), pa.array([m[2].reshape(-1)], pa.list_(pa.float64()))], names=["n", "mean", "spread"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (0, None, None)
    for b in batches:
        values = b.column(0).drop_null()
        if len(values):
            x = _matrix(values)
            mean = x.mean(axis=0)
            held = merged(held, (len(x), mean, (x - mean).T @ (x - mean)))
    if held[0]:
        yield _row(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (0, None, None)
    for b in batches:
        for n, mean, spread in zip(*(b.column(c).to_pylist() for c in ("n", "mean", "spread")), strict=True):
            held = merged(held, (n, np.array(mean), np.array(spread).reshape(len(mean), -1)))
    if held[0]:
        yield _row(held)


def moments(vectors: DataFrame, column: str) -> DataFrame:
    """One row (n, mean, spread) over all non-null vectors: spread is the matrix of summed products of deviations, row by row.

    No vectors: no row. Each partition sums its own; partial sums are merged FAN_IN at a time."""
    parts = vectors.select(column).mapInArrow(_partial, _MOMENTS)
    many = vectors.rdd.getNumPartitions()
    while many > 1:
        many = -(-many // FAN_IN)
        parts = parts.repartition(many).mapInArrow(_merge, _MOMENTS)
    return parts


def covariance(vectors: DataFrame, column: str) -> DataFrame:
    """(i, j, cov) for i <= j: sample covariances of the vectors' numbers; null for a single vector."""
    rows = moments(vectors, column).select("n", F.size("mean").alias("d"), F.posexplode("spread").alias("k", "s"))
    rows = rows.select(F.floor(F.col("k") / F.col("d")).cast("int").alias("i"), (F.col("k") % F.col("d")).cast("int").alias("j"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).alias("cov"))
    return rows.where("i <= j")


@dataclass
class Axes:
    """Principal axes: mean, components (rows, the widest first, each one's largest entry positive), variances, and the number of vectors."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    n: int


def fit(vectors: DataFrame, column: str) -> Axes:
    """Principal axes of all vectors. Axes of equal variance come in any order; an error if there is no vector."""
    row = moments(vectors, column).first()
    if row is None:
        raise ValueError("no vectors")
    d = len(row.mean)
    values, rows = np.linalg.eigh(np.array(row.spread).reshape(d, d) / max(1, row.n - 1))
    components = rows.T[::-1]
    sign = np.sign(components[np.arange(d), np.abs(components).argmax(axis=1)])
    return Axes(np.array(row.mean), components * np.where(sign == 0, 1, sign)[:, None], np.maximum(values[::-1], 0), row.n)


def project(vectors: DataFrame, key: str, column: str, axes: Axes, most: int | None = None) -> DataFrame:
    """(key, z): coordinates of vectors on the first axes, in blocks; a null vector has null coordinates."""
    kind, turn = vectors.schema[key].dataType.simpleString(), axes.components[:most].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column(1).is_valid()
            some = b.column(1).drop_null()
            z = (_matrix(some) - axes.mean) @ turn if len(some) else np.zeros((0, turn.shape[1]))
            ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))]) * turn.shape[1]
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(z.reshape(-1)), mask=pc.invert(there))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[key, "z"])

    return vectors.select(key, column).mapInArrow(run, f"{key} {kind}, z array<double>")


def fit_cells(vectors: DataFrame, key: str, column: str, count: int, most: int = 32, accuracy: int | None = None) -> DataFrame:
    """(key, raw, cell): cells of about equal mass along the principal axes, fitted on all vectors.

    Axes get bins by their variance, edges are quantiles (exact; with an accuracy by sketches), and raw
    cells are merged to `count` cells, all by aggregates. Null vectors have no row."""
    axes = fit(vectors.where(F.col(column).isNotNull()), column)
    bins = [b for b in allocate_bins(axes.variances, count, most)]
    used = [i for i, b in enumerate(bins) if b > 1] or [0]
    z = project(vectors.where(F.col(column).isNotNull()), key, column, axes, max(used) + 1)
    z = z.select(key, *[F.get("z", F.lit(i)).alias(f"z{i}") for i in used])
    names, counts = [f"z{i}" for i in used], [bins[i] for i in used]
    edges, table = cells.fit(z, names, counts, count, accuracy)
    raw = mixed_radix([bin_index(c, e) for c, e in zip(names, edges, strict=True)], counts)
    return cells.assign(z.select(key, raw.alias("raw")), table)
