"""What codebook learning looks at and draws: losses, moving moments, samples, noisy picks and mixtures, as DataFrames.

Draws are by md5 of a seed and keys, so that they don't depend on partitions and SQL gives the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as v
from ..sources.scratch import kept
from . import pca
from .codes import _scores, _stacked
from .sampling import draw, registry, subset, weighted


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) for a row's keys: 32 bits of their md5."""
    return (F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def pick(seed: int, count: int | Column, *keys: str) -> Column:
    """A number from 0 to count - 1 for a row's keys."""
    return (F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("long") % count).cast("long")


# losses --------------------------------------------------------------------------------------


def orthogonality(codebook: DataFrame) -> DataFrame:
    """(orthogonality) of a codebook (e): the mean squared cosine of all pairs of codes, less 1/n; 0 for an orthogonal one.

    The squared cosines of all pairs add up to the squared entries of the unit codes' d x d product matrix,
    so no pair is ever made: the matrix comes from moments merged in a tree."""
    rows = pca.moments(codebook.select(v.unit("e").alias("e")), "e")
    product = F.zip_with("spread", F.flatten(F.transform("mean", lambda a: F.transform("mean", lambda b: a * b))), lambda s, m: s + F.col("n") * m)
    return rows.select((v.dot(product, product) / (F.col("n") * F.col("n")) - 1 / F.col("n")).alias("orthogonality"))


def commitment(assigned: DataFrame) -> DataFrame:
    """(commitment) of vectors (e) and their codes' (q): the mean squared difference of their numbers."""
    square = F.zip_with("e", "q", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return assigned.agg((F.sum(v.total(square)) / F.sum(F.size("e"))).alias("commitment"))


def mean_softmax(vectors: DataFrame, codebook: DataFrame, temperature: float = 1.0, metric: str = "cosine") -> DataFrame:
    """(code, p): the mean over vectors (e) of the softmax of their scores with all codes (code, e), a parameter's number of codes.

    Each partition sends one sum a code."""
    book = codebook.orderBy("code").collect()
    ids, table = [r.code for r in book], np.array([r.e for r in book], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(ids)), 0
        for b in batches:
            if b.num_rows:
                x = _scores(_stacked(b.column(0)), table, metric) / temperature
                p = np.exp(x - x.max(axis=1, keepdims=True))
                sums, n = sums + (p / p.sum(axis=1, keepdims=True)).sum(axis=0), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums), pa.array([n] * len(ids), pa.int64())], names=["code", "s", "n"])

    parts = vectors.where(F.col("e").isNotNull()).select("e").mapInArrow(run, "code long, s double, n long")
    return parts.groupBy("code").agg((F.sum("s") / F.sum("n")).alias("p"))


def diversity(vectors: DataFrame, codebook: DataFrame, temperature: float = 1.0, metric: str = "cosine") -> DataFrame:
    """(diversity): the negative entropy of the mean softmax; least where codes are used evenly."""
    return mean_softmax(vectors, codebook, temperature, metric).agg(F.sum(F.col("p") * F.ln(F.greatest("p", F.lit(1e-5)))).alias("diversity"))


def affine_step(batch: DataFrame, state: DataFrame, decay: float) -> DataFrame:
    """(d, mean, var): moving mean and population variance of vectors' numbers after a batch (e). Without vectors the state stays."""
    new = batch.select(F.posexplode("e").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    move = lambda old, x: F.coalesce(decay * F.col(old) + (1 - decay) * F.col(x), F.col(old)).alias(old)
    return state.join(new, "d", "left").select("d", move("mean", "m"), move("var", "s"))


# draws ---------------------------------------------------------------------------------------


def draw_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42, repeat: bool | None = None) -> DataFrame:
    """n rows of df; (draw, …) with draw from 0. No rows give none.

    repeat: with repetition or without (then all rows if there are fewer); by default without if there are as many rows as draws."""
    count = df.count()
    if count >= n if repeat is None else not repeat:
        rows = registry(subset(df, keys, n, seed), [draw(seed, *keys), *map(F.col, keys)], name="draw")
        return rows.select("draw", *df.columns)
    numbered = registry(df, [F.col(k) for k in keys], name="number_")
    draws = df.sparkSession.range(n).toDF("draw").withColumn("number_", pick(seed, max(count, 1), "draw"))
    return draws.join(numbered, "number_").select("draw", *df.columns)


def multinomial(weights: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(key, n): how many of n draws fall to each key by its weight; keys without any have 0."""
    drawn = weighted(weights, weights, key, n, seed).groupBy(key).agg(F.count("*").alias("n"))
    return weights.select(key).distinct().join(drawn, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def gumbel_pick(logits: DataFrame, row: str, choice: str, temperature: float, top: int | None = None, seed: int = 42) -> DataFrame:
    """(row, choice): for each row the choice with the largest noisy logit (row, choice, logit); ties by choice.

    The noise is that of Gumbel's distribution, so choices fall by softmax of logit / temperature; temperature 0:
    without noise. top: only the rows' largest logits compete, those that tie with the last of them too."""
    if top:
        place = F.rank().over(Window.partitionBy(row).orderBy(F.desc("logit")))
        logits = logits.withColumn("place_", place).where(F.col("place_") <= top)
    noisy = F.col("logit") / temperature - F.ln(-F.ln(uniform(seed, row, choice))) if temperature > 0 else F.col("logit")
    best = logits.groupBy(row).agg(F.max(F.struct(noisy.alias("x"), (-F.col(choice)).alias("c"))).alias("b"))
    return best.select(row, (-F.col("b.c")).alias(choice))


def group_sample(stages: DataFrame, cells: DataFrame, groups: int, sample: int, seed: int = 42) -> DataFrame:
    """(g, j, stage, cell): for each of so many groups a stage (iter) and `sample` cells (bin), all with repetition."""
    spark = stages.sparkSession
    by_stage, by_cell = kept(registry(stages.select("iter").distinct(), [F.col("iter")]), "stages"), kept(registry(cells.select("bin").distinct(), [F.col("bin")]), "cells")
    n_stages, n_cells = max(by_stage.count(), 1), max(by_cell.count(), 1)
    rows = spark.range(groups * sample).select(F.floor(F.col("id") / sample).alias("g"), (F.col("id") % sample).alias("j"))
    rows = rows.withColumn("s_", pick(seed, n_stages, "g")).withColumn("c_", pick(seed, n_cells, "g", "j"))
    rows = rows.join(by_stage.select(F.col("id").alias("s_"), F.col("iter").alias("stage")), "s_").join(by_cell.select(F.col("id").alias("c_"), F.col("bin").alias("cell")), "c_")
    return rows.select("g", "j", "stage", "cell")


def mixup(series: DataFrame, key: str, mixtures: int, most: int = 3, seed: int = 42) -> DataFrame:
    """(mixture, t, value): weighted sums of one to `most` series (key, t, value), drawn with repetition.

    Series are brought to mean 0 and deviation 1 (1e-8 more), their missing values count as 0, and where all are
    missing the mixture is too; where a series has ended it is missing. Weights are Dirichlet's with 1.5 each:
    gamma draws -ln a - ln b cos^2(2 pi c) of three uniform numbers, over their sum."""
    by = Window.partitionBy(key)
    z = (F.col("value") - F.avg("value").over(by)) / (F.stddev_pop("value").over(by) + 1e-8)
    scaled = kept(series.select(key, "t", z.alias("z")), "series")
    ids = kept(registry(scaled.select(key).distinct(), [F.col(key)], name="number_"), "ids")
    parts = series.sparkSession.range(mixtures).toDF("mixture")
    parts = parts.withColumn("k", pick(seed, most, "mixture") + 1).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    parts = parts.withColumn("number_", pick(seed, max(ids.count(), 1), "mixture", "j"))
    u = [uniform(seed + i, "mixture", "j") for i in (1, 2, 3)]
    parts = parts.withColumn("g", -F.ln(u[0]) - F.ln(u[1]) * F.pow(F.cos(2 * np.pi * u[2]), 2))
    parts = parts.withColumn("w", F.col("g") / F.sum("g").over(Window.partitionBy("mixture"))).join(ids, "number_")
    rows = parts.select("mixture", key, "w").join(scaled, key)
    return rows.groupBy("mixture", "t").agg(F.sum(F.col("w") * F.col("z")).alias("value"))
