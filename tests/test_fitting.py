"""Fits over all vectors: principal axes, sketched edges, weighted draws, eigenvalues."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import cells, graph, kernels, pca, sampling


def _vectors(spark, x, parts):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, e array<double>").repartition(parts)


@pytest.mark.parametrize(("dims", "rows", "parts"), [(1, 5, 1), (2, 300, 40), (7, 50, 3), (33, 400, 5), (64, 90, 20)])
def test_axes_are_those_of_all_vectors(spark, dims, rows, parts):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(rows, dims)) * np.linspace(3, 1, dims) + 1e4  # far from zero, where raw sums would cancel
    mean, components, variances = kernels.fit_pca(x)
    axes = pca.fit(_vectors(spark, x, parts), "e")
    assert axes.n == rows and np.allclose(axes.mean, mean) and np.allclose(axes.variances, np.pad(variances, (0, dims - len(variances))), atol=1e-6)
    n = min(dims, rows - 1)
    assert np.allclose(axes.components[:n], components[:n], atol=1e-5)
    z = {r.k: r.z for r in pca.project(_vectors(spark, x, parts), "k", "e", axes, n).collect()}
    assert np.allclose([z[i] for i in range(rows)], (x - mean) @ components[:n].T, atol=1e-3)


def test_moments_of_odd_tables(spark):
    none = spark.createDataFrame([(1, None)], "k long, e array<double>")
    assert pca.moments(none, "e").count() == 0 and pca.moments(none.where("false"), "e").count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        pca.fit(none, "e")
    some = none.union(spark.createDataFrame([(2, [1.0, 2.0]), (2, [1.0, 2.0])], "k long, e array<double>")).repartition(3)
    assert pca.covariance(some, "e").where("abs(cov) > 1e-12").count() == 0
    assert {(r.k, r.z is None) for r in pca.project(some, "k", "e", pca.fit(some, "e")).collect()} == {(1, True), (2, False)}
    assert pca.covariance(some.where("k = 2").limit(1), "e").first().cov is None
    with pytest.raises(Exception, match="different lengths|and of"):
        pca.moments(some.union(spark.createDataFrame([(3, [1.0])], "k long, e array<double>")).coalesce(1), "e").collect()


def test_cells_as_from_one_place(spark):
    x = np.random.default_rng(3).normal(size=(500, 6)) * [5, 4, 3, 1, 1, 1]
    part = kernels.Partition(x, 40)
    got = {r.k: r.cell for r in pca.fit_cells(_vectors(spark, x, 7), "k", "e", 40).collect()}
    assert [got[i] for i in range(500)] == part.cells(x).tolist()


def test_sketches_merge(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=6000), rng.exponential(size=3000), np.zeros(1000)])
    df = spark.createDataFrame([(int(i % 9), float(v)) for i, v in enumerate(x)] + [(1, None), (1, float("nan"))], "file int, x double").withColumn("none", F.lit(None).cast("double"))
    merged = cells.merge_sketches(cells.edge_sketches(df, ["x", "none"], ["file"]))
    assert [(r.column, r.n) for r in merged.collect()] == [("x", 10_000)]
    rows = cells.sketched_edges(merged, {"x": 20}).orderBy("i").collect()
    assert len(rows) == 21 and rows[0].edge == x.min() and rows[-1].edge == x.max()
    for r in rows:
        low, high = (x < r.edge).mean(), (x <= r.edge).mean()
        assert low - 0.02 <= r.i / 20 <= high + 0.02


def test_weighted_draws_over_many_cells(spark):
    n = 150_000  # more than two blocks of sums
    df = spark.range(n).select(F.col("id").alias("bin"), F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, None).otherwise((F.col("id") % 7 + 1).cast("double")).alias("w"))
    w = np.array([i % 7 + 1 if i % 3 == 2 else 0 for i in range(n)], float)
    upper = np.cumsum(w) / w.sum()
    import hashlib

    u = [int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(1, 2001)]
    got = {r.i: r.bin for r in sampling.weighted(df.repartition(5), df.repartition(6), "bin", 2000).collect()}
    assert got == {i: int(np.searchsorted(upper, x, side="right")) for i, x in enumerate(u, 1)}
    one = sampling.weighted(df, df.where("bin = 2"), "bin", 5).collect()
    assert [r.bin for r in one] == [2] * 5
    with pytest.raises(ValueError, match="positive weight"):
        sampling.weighted(df, df.where("bin % 3 < 2"), "bin", 5)


def test_largest_eigenvalue(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 12, 30):
        x = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
        rows = [(i, j, float(x[i, j])) for i in range(n) for j in range(n) if x[i, j]] + [(0, 0, 1.0)]
        adj = spark.createDataFrame(rows, "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w"))
        lap = graph.laplacian(graph.symmetric(adj))
        dense = np.zeros((n, n))
        for r in lap.collect():
            dense[r.src, r.dst] = r.w
        want = np.linalg.eigvalsh(dense)[-1]
        assert abs(graph.largest_eigenvalue(lap) - want) < 1e-8
        got = {(r.src, r.dst): r.w for r in graph.scaled_laplacian(adj, None).collect()}
        if want > 1e-9:
            assert all(abs(v - (2 * dense[i, j] / want - (i == j))) < 1e-6 for (i, j), v in got.items())
        if n == 12:
            break
    assert graph.largest_eigenvalue(spark.createDataFrame([], "src long, dst long, w double")) == 0
