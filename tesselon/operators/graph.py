"""Normalised adjacency matrices over edge lists (src, dst, w); entries of 0 are left out."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept


def _degree(adj: DataFrame, by: str = "src") -> DataFrame:
    return adj.groupBy(F.col(by).alias("v")).agg(F.sum("w").alias("deg"))


def _inverse(x, power: float):
    return F.when(x > 0, F.pow(x, F.lit(power))).otherwise(0.0)


def symmetric(adj: DataFrame) -> DataFrame:
    """The larger of both directions, in both."""
    both = adj.unionByName(adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def with_loops(adj: DataFrame) -> DataFrame:
    """A + I."""
    nodes = adj.select(F.col("src").alias("v")).union(adj.select("dst")).distinct()
    loops = nodes.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("w"))
    return adj.unionByName(loops).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _scaled(adj: DataFrame) -> DataFrame:
    deg = _degree(adj)
    left = adj.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst", "left")
    return left.select("src", "dst", (_inverse(F.col("ds"), -0.5) * F.col("w") * _inverse(F.coalesce("dd", F.lit(0.0)), -0.5)).alias("w"))


def message_passing(adj: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2, transposed."""
    return _scaled(with_loops(adj)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def laplacian(adj: DataFrame) -> DataFrame:
    """I - D^-1/2 A D^-1/2."""
    nodes = adj.select(F.col("src").alias("v")).union(adj.select("dst")).distinct()
    loops = nodes.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("w"))
    minus = _scaled(adj).select("src", "dst", (-F.col("w")).alias("w"))
    return loops.unionByName(minus).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def largest_eigenvalue(matrix: DataFrame, rounds: int = 100, tolerance: float = 1e-12) -> float:
    """The largest eigenvalue of a symmetric matrix of entries (src, dst, w), by Lanczos' method.

    In each round the vector is multiplied by the matrix as a join and a sum by rows, which are spread over
    the cluster, and written, so that no plan grows. Six sums come to the driver, which finds the largest
    eigenvalue of the small tridiagonal matrix they make. It starts from a vector by hash of the nodes,
    which no eigenvector is orthogonal to but by chance, and ends when the value moves by less than
    tolerance of itself, or after so many rounds. Without entries: 0."""
    entries = kept(matrix.select("src", "dst", "w"), "matrix")
    nodes = entries.select(F.col("src").alias("v")).union(entries.select("dst")).distinct()
    state = kept(nodes.select("v", (F.pmod(F.xxhash64("v"), F.lit(1 << 20)) / float(1 << 20) + 0.5).alias("q"), F.lit(0.0).alias("p")), "vector")
    norm = state.agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).first()[0]
    if not norm:
        return 0.0
    state = state.withColumn("q", F.col("q") / norm)
    on, off, found = [], [], None
    for _ in range(rounds):
        y = entries.join(state.select(F.col("v").alias("dst"), "q"), "dst").groupBy(F.col("src").alias("v")).agg(F.sum(F.col("w") * F.col("q")).alias("y"))
        here = kept(state.join(y, "v", "left").select("v", "q", "p", F.coalesce("y", F.lit(0.0)).alias("y")), "vector")
        product = lambda a, b: F.sum(F.col(a) * F.col(b))
        yy, qq, pp, yq, yp, qp = here.agg(*[product(a, b) for a, b in ("yy", "qq", "pp", "yq", "yp", "qp")]).first()
        alpha, beta = yq / qq, off[-1] if off else 0.0
        on.append(alpha)
        top = float(np.linalg.eigvalsh(np.diag(on) + np.diag(off, 1) + np.diag(off, -1))[-1])
        rest = yy + alpha * alpha * qq + beta * beta * pp - 2 * alpha * yq - 2 * beta * yp + 2 * alpha * beta * qp
        if found is not None and abs(top - found) <= tolerance * abs(top) or rest <= 1e-20:
            return top
        found = top
        off.append(sqrt(rest))
        state = here.select("v", ((F.col("y") - alpha * F.col("q") - beta * F.col("p")) / off[-1]).alias("q"), F.col("q").alias("p"))
    return found


def scaled_laplacian(adj: DataFrame, largest: float | None = 2.0) -> DataFrame:
    """2 L / largest - I of the symmetric graph; largest None: the largest eigenvalue of L. An L of zeros has no scale and gives -I."""
    lap = laplacian(symmetric(adj))
    if largest is None:
        lap = kept(lap, "laplacian")
        largest = largest_eigenvalue(lap)
    return lap.select("src", "dst", (F.col("w") * (2.0 / largest if largest else 0.0) - F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)).alias("w"))


def transition(adj: DataFrame) -> DataFrame:
    """D^-1 A."""
    deg = _degree(adj).toDF("src", "deg")
    return adj.join(deg, "src").select("src", "dst", (F.col("w") * _inverse(F.col("deg"), -1.0)).alias("w"))


def transposed(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def load(adj: DataFrame, kind: str) -> list[DataFrame]:
    """The matrices of a graph kind: one, or two for doubletransition."""
    if kind == "doubletransition":
        return [transposed(transition(adj)), transposed(transition(transposed(adj)))]
    one = {"scalap": scaled_laplacian, "normlap": laplacian, "symnadj": message_passing, "transition": lambda a: transposed(transition(a)),
           "identity": lambda a: with_loops(a).where("src = dst").withColumn("w", F.lit(1.0)), "original": lambda a: a}
    if kind not in one:
        raise ValueError(f"unknown graph kind: {kind}")
    return [one[kind](adj)]
