"""Codes and vectors: look-up, nearest code, scale embeddings, codebook learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept
from .sizes import small

#: Codes up to which a codebook goes to every worker; a larger one is searched around pivots, with the same rows.
BROADCAST_CODES = 1 << 14
#: Codes that a larger codebook is dealt out around; codes and vectors that meet in one task.
PIVOTS, CELL_CODES, CELL_VECTORS = 512, 4096, 8192
#: Numbers of a matrix of scores or distances that a worker holds at once, and rows that it sends at once.
BLOCK_SCORES, BLOCK_ROWS = 1 << 20, 4096
#: Two scores are equal if they agree to so many decimals: products in another order differ in the last digits.
DECIMALS = 9


def lookup(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """codes (keys, pos, code) with the vector e of each code."""
    return codes.join(small(codebook), "code")


def _stacked(values: pa.Array) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _scores(x: np.ndarray, table: np.ndarray, metric: str) -> np.ndarray:
    """Scores of vectors (rows) with codes: the cosine, or the negative squared distance."""
    norm = np.linalg.norm(table, axis=1)
    if metric == "cosine":
        return x @ table.T / np.maximum(np.linalg.norm(x, axis=1)[:, None] * norm[None], 1e-12)
    return 2 * x @ table.T - norm[None] ** 2 - (x * x).sum(1)[:, None]


def _slices(b: pa.RecordBatch | pa.Table, width: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """A batch in parts of so many rows that a matrix of `width` numbers a row has BLOCK_SCORES or fewer."""
    step = max(1, min(BLOCK_ROWS, BLOCK_SCORES // max(1, width)))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def nearest(vectors: DataFrame, codebook: DataFrame, key: str, metric: str = "cosine", most: int = BROADCAST_CODES) -> DataFrame:
    """(key, code, score): the best code for each vector (key, e), of equals the first.

    A codebook (code, e) of at most `most` codes goes to the workers, and blocks of vectors meet it in one
    matrix product. A larger one, of any size, is searched around pivots; see nearest_by_pivots."""
    if codebook.limit(most + 1).count() > most:
        return nearest_by_pivots(vectors, codebook, key, metric)
    book = codebook.orderBy("code").collect()
    ids, table = np.array([r.code for r in book], np.int64), np.array([r.e for r in book], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(table)):
                score = _scores(_stacked(b.column(1)), table, metric)
                best = np.argmax(np.round(score, DECIMALS), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[best]), pa.array(score[np.arange(len(best)), best])], names=[key, "code", "score"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "e").mapInArrow(run, f"{key} {kind}, code long, score double")


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors where distance orders as the metric does: for the cosine on the unit sphere."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def nearest_by_pivots(vectors: DataFrame, codebook: DataFrame, key: str, metric: str = "cosine", pivots: int = PIVOTS) -> DataFrame:
    """nearest for a codebook of any size: no task and not the driver holds more of it than pivots and a cell's part.

    Codes are dealt to the nearest of some pivots, drawn from them by hash. Each vector meets the codes of its
    nearest pivot, and from then on knows how far its best code is at most. By the triangle inequality the codes
    of another pivot, none further from it than its radius, can be better only if the vector is no further from
    that pivot than both together: it meets those too. Cells with many codes or vectors are split over tasks."""
    spark = vectors.sparkSession
    book = kept(codebook.select(F.col("code").cast("long").alias("code"), F.col("e").cast("array<double>").alias("e")), "codes")
    drawn = book.orderBy(F.md5(F.col("code").cast("string")), "code").limit(pivots).collect()
    centres = _placed(np.array([r.e for r in drawn], np.float64), metric)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(centres)):
                d = _distances(_placed(_stacked(b.column("e")), metric), centres)
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(d[np.arange(len(d)), home])], names=[*b.schema.names, "pivot", "far"])

    codes = kept(book.mapInArrow(dealt, "code long, e array<double>, pivot int, far double"), "dealt")
    cells = codes.groupBy("pivot").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / CELL_CODES).cast("int").alias("blocks"))
    cells = spark.createDataFrame(cells.collect(), "pivot int, radius double, blocks int")  # a row for each pivot
    radius = np.full(len(centres), -np.inf)
    for r in cells.collect():
        radius[r.pivot] = r.radius
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col("e").cast("array<double>").alias("e"))
    rows = kept(rows.mapInArrow(dealt, f"row long, key {kind}, e array<double>, pivot int, far double"), "vectors")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("code")
        ids, found, scores = right["code"].to_numpy(), [], []
        table = _stacked(right["e"]) if right.num_rows else None
        for part in _slices(left, right.num_rows) if right.num_rows else ():
            score = _scores(_stacked(part["e"]), table, metric)
            top = np.argmax(np.round(score, DECIMALS), axis=1)
            found.append(ids[top])
            scores.append(score[np.arange(len(top)), top])
        held = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((found, np.int64), (scores, np.float64))]
        return pa.table({"row": left["row"].slice(0, len(held[0])), "code": held[0], "score": held[1]})

    def meet(some: DataFrame) -> DataFrame:
        """The best code of each vector among those of the pivots it is given."""
        load = some.groupBy("pivot").agg(F.ceil(F.count("*") / CELL_VECTORS).cast("int").alias("salts"))
        plan = F.broadcast(cells.join(load, "pivot").select("pivot", "blocks", "salts"))  # a row for each pivot
        numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = some.select("row", "e", "pivot").join(plan, "pivot").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
        left = left.withColumn("block", numbers("blocks")).select("row", "e", "pivot", "block", "salt")
        right = codes.select("code", "e", "pivot").join(plan, "pivot").withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
        right = right.withColumn("salt", numbers("salts")).select("code", "e", "pivot", "block", "salt")
        by = ["pivot", "block", "salt"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "row long, code long, score double")

    def first(found: DataFrame) -> DataFrame:
        order = F.struct(F.round("score", DECIMALS).alias("r"), (-F.col("code")).alias("c"), "score")
        return found.groupBy("row").agg(F.max(order).alias("x")).select("row", (-F.col("x.c")).alias("code"), "x.score")

    near = kept(first(meet(rows)), "near")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole, len(centres))):
            x = _placed(_stacked(b.column("e")), metric)
            score, home = b.column("score").to_numpy(), b.column("pivot").to_numpy()
            # how far the best code so far is: of a zero vector, whose cosines are all 0, every cell can hold the first
            within = np.sqrt(np.maximum((x * x).sum(1) + 1 - 2 * score, 0)) if metric == "cosine" else np.sqrt(np.maximum(-score, 0))
            within = np.where((x * x).sum(1) > 0, within, np.inf) if metric == "cosine" else within
            d = _distances(x, centres)
            some = d - radius[None] <= within[:, None] + 1e-6 * (1 + d)
            some[np.arange(len(x)), home] = False
            r, p = np.nonzero(some)
            for at in range(0, len(r), BLOCK_ROWS):  # a vector can go to all pivots: its copies are made as they are sent
                i = pa.array(r[at : at + BLOCK_ROWS])
                yield pa.RecordBatch.from_arrays([b.column("row").take(i), b.column("e").take(i), pa.array(p[at : at + BLOCK_ROWS], pa.int32())], names=["row", "e", "pivot"])

    more = rows.select("row", "e", "pivot").join(near.select("row", "score"), "row").mapInArrow(elsewhere, "row long, e array<double>, pivot int")
    found = first(near.unionByName(meet(kept(more, "elsewhere"))))
    return rows.select("row", "key").join(found, "row").select(F.col("key").alias(key), "code", "score")


def scale_embedding(codes: DataFrame, codebook: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, d, v): position-weighted mean of the vectors of a scale's valid codes, by dimension.

    codes: keys, s, pos, code (NULL: masked). The k valid codes have weights 0, 1/(k-1), …, 1,
    a single one has 1; a scale without valid codes is the zero vector. Codes travel as one array
    a scale, and meet the codebook in blocks; a codebook of more than BROADCAST_CODES is joined instead."""
    by = [*keys, "s"]
    if codebook.limit(BROADCAST_CODES + 1).count() > BROADCAST_CODES:
        return _joined_embedding(codes, codebook, by)
    book = codebook.orderBy("code").collect()
    ids, table = np.array([r.code for r in book]), np.array([r.e for r in book], dtype=np.float64)
    rows = F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("pos", "code"))))
    packed = codes.groupBy(*by).agg(F.transform(rows, lambda x: x["code"].cast("long")).alias("codes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f["codes"]:
                row = np.asarray(row, np.int64)
                at = np.minimum(np.searchsorted(ids, row), len(ids) - 1)
                known = ids[at] == row
                w = (np.linspace(0, 1, len(row)) if len(row) > 1 else np.ones(len(row)))[known]
                out.append(w @ table[at[known]] / w.sum() if w.sum() > 0 else np.zeros(table.shape[1]))
            yield f[by].assign(e=out)

    kinds = ", ".join(f"{k} {packed.schema[k].dataType.simpleString()}" for k in by)
    found = packed.mapInPandas(run, f"{kinds}, e array<double>")
    return found.select(*by, F.posexplode("e").alias("d", "v"))


def _joined_embedding(codes: DataFrame, codebook: DataFrame, by: list[str]) -> DataFrame:
    """scale_embedding by a shuffle join of each valid code with its vector."""
    scale = Window.partitionBy(*by)
    rows = codes.where("code IS NOT NULL").withColumn("rank_", F.row_number().over(scale.orderBy("pos", "code")) - 1).withColumn("of_", F.count("*").over(scale))
    rows = rows.withColumn("w_", F.when(F.col("of_") == 1, 1.0).otherwise(F.col("rank_") / (F.col("of_") - 1))).select(*by, "code", "w_")
    parts = rows.join(codebook, "code").select(*by, "w_", F.posexplode("e").alias("d", "x_"))
    sums = parts.groupBy(*by, "d").agg(F.sum(F.col("w_") * F.col("x_")).alias("x_"), F.sum("w_").alias("w_"))
    dims = codebook.select(F.size("e")).first()[0]
    every = codes.select(*by).distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))))
    return every.join(sums, [*by, "d"], "left").select(*by, "d", F.when(F.col("w_") > 0, F.col("x_") / F.col("w_")).otherwise(0.0).alias("v"))


def perplexity(codes: DataFrame) -> DataFrame:
    """exp of the entropy of code use; negative and missing codes don't count; 0 if none does."""
    use = codes.where("code >= 0").groupBy("code").agg(F.count("*").alias("n"))
    share = use.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return share.agg(F.coalesce(F.exp(-F.sum(F.col("p") * F.ln(F.greatest(F.col("p"), F.lit(1e-10))))), F.lit(0.0)).alias("perplexity"))


def kmeans_step(assigned: DataFrame, old: DataFrame) -> DataFrame:
    """(code, d, v, n): means of the assigned vectors (code, e) by dimension; an empty code keeps its old vector."""
    parts = assigned.select("code", F.posexplode("e").alias("d", "x"))
    new = parts.groupBy("code", "d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return old.select("code", F.posexplode("e").alias("d", "o")).join(new, ["code", "d"], "left").select(
        "code", "d", F.coalesce("m", "o").alias("v"), F.coalesce("n", F.lit(0)).alias("n"))


def kmeans(vectors: DataFrame, codebook: DataFrame, key: str, rounds: int = 10, metric: str = "cosine", searched: list[int] | None = None) -> DataFrame:
    """(code, e) after rounds of assignment to the nearest code and means; for cosine, codes of length 1; an empty code stays.

    vectors: key, e. By Hamerly's bounds: with each vector its code is kept, how far it is at most, and how far
    all others are at least. These hold on with the codes' moves, and while they leave no doubt, no other code
    is looked at. Each round is one pass over what the round before wrote: it makes the new state and each
    task's sums by code together. A codebook of at most BROADCAST_CODES codes is gathered; a larger one stays
    distributed, and each round searches it around pivots. searched: gets for each round the number of
    vectors that were compared with all codes."""
    spark = vectors.sparkSession
    if codebook.limit(BROADCAST_CODES + 1).count() > BROADCAST_CODES:
        return _kmeans_by_pivots(vectors, codebook, rounds, metric)
    book = codebook.orderBy("code").collect()
    ids, table = [r.code for r in book], _placed(np.array([r.e for r in book], np.float64), metric)
    k, dims = table.shape
    kind = "e array<double>, at int, upper double, lower double, sums array<double>, n long, searched long"
    none = [F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("upper", "double"), ("lower", "double"))]
    state, moved = vectors.where(F.col("e").isNotNull()).select(F.col("e").cast("array<double>").alias("e"), *none), np.zeros(k)
    for turn in range(rounds):
        state = kept(state.mapInArrow(_hamerly(table, moved, turn > 0, metric), kind), "kmeans")
        sums = state.where("n > 0").select("at", "n", F.posexplode("sums").alias("d", "x")).groupBy("at", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        if searched is not None:
            searched.append(state.agg(F.sum("searched")).first()[0] or 0)
        new = table.copy()
        for r in sums:
            new[r.at, r.d] = r.x / r.n
        new = _placed(new, metric)
        moved, table = np.linalg.norm(new - table, axis=1), new
        state = state.where("n IS NULL").select("e", "at", "upper", "lower")
    return spark.createDataFrame([(c, e.tolist()) for c, e in zip(ids, table, strict=True)], "code long, e array<double>")


def _kmeans_by_pivots(vectors: DataFrame, codebook: DataFrame, rounds: int, metric: str) -> DataFrame:
    """Plain rounds for a codebook that no task can hold."""
    unit = lambda c: F.transform(c, lambda x: x / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    place = unit if metric == "cosine" else lambda c: c
    e = F.col("e").cast("array<double>")
    rows = kept(vectors.where(F.col("e").isNotNull()).select(F.monotonically_increasing_id().alias("row"), e.alias("e")), "kmeans")
    book = kept(codebook.select(F.col("code").cast("long").alias("code"), place(e).alias("e")), "codebook")
    for _ in range(rounds):
        near = rows.join(nearest_by_pivots(rows, book, "row", metric).select("row", "code"), "row")
        means = kmeans_step(near, book).groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("e"))
        book = kept(means.select("code", place(F.col("e")).alias("e")), "codebook")
    return book


def _hamerly(table: np.ndarray, moved: np.ndarray, known: bool, metric: str):
    """One round: rows of the new state, then for each code the sum and number of the task's vectors."""
    k, dims = table.shape
    apart = _distances(table, table)
    np.fill_diagonal(apart, np.inf)
    half = apart.min(axis=1) / 2  # nothing nearer than that to a code is nearer to another
    order = np.argsort(moved)[::-1]
    most = np.full(k, moved[order[0]])  # of all other codes the longest move
    most[order[0]] = moved[order[1]] if k > 1 else 0.0
    names = ["e", "at", "upper", "lower", "sums", "n", "searched"]

    def nulls(n: int, kind: pa.DataType) -> pa.Array:
        return pa.nulls(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, searched = np.zeros((k, dims)), np.zeros(k, np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            raw = _stacked(b.column("e"))
            x, n = _placed(raw, metric), len(raw)
            at, upper, lower, open_ = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
            if known:
                at = b.column("at").to_numpy().astype(np.int64)
                upper, lower = b.column("upper").to_numpy() + moved[at], b.column("lower").to_numpy() - most[at]
                doubt = lambda i: upper[i] >= np.maximum(lower[i], half[at[i]]) - 1e-7 * (1 + upper[i])
                open_ = np.flatnonzero(doubt(np.arange(n)))
                upper[open_] = np.linalg.norm(x[open_] - table[at[open_]], axis=1)
                open_ = open_[doubt(open_)]
            for part in np.array_split(open_, max(1, -(-len(open_) * k // (1 << 22)))):
                if not len(part):
                    continue
                y = x[part]
                squares = (y * y).sum(1)[:, None] + (table * table).sum(1)[None] - 2 * y @ table.T
                best = np.argmax(np.round(y @ table.T if metric == "cosine" else -squares, DECIMALS), axis=1)
                d = np.sqrt(np.maximum(squares, 0))
                at[part], upper[part] = best, d[np.arange(len(part)), best]
                d[np.arange(len(part)), best] = np.inf
                lower[part] = d.min(axis=1)
            searched += len(open_)
            np.add.at(sums, at, raw)
            count += np.bincount(at, minlength=k)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(raw.reshape(-1)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(at, pa.int32()), pa.array(upper), pa.array(lower), nulls(n, pa.list_(pa.float64())), nulls(n, pa.int64()), nulls(n, pa.int64())], names=names)
        some = np.flatnonzero(count)
        m = len(some)
        if m:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dims), pa.array(sums[some].reshape(-1)))
            first = np.concatenate([[searched], np.zeros(m - 1, np.int64)])
            yield pa.RecordBatch.from_arrays([nulls(m, pa.list_(pa.float64())), pa.array(some, pa.int32()), nulls(m, pa.float64()), nulls(m, pa.float64()), lists, pa.array(count[some]), pa.array(first)], names=names)

    return run


def project(vectors: DataFrame, key: str, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(key, e): vectors through a linear layer (out x in) to the codebook's dimensions, each of length 1; in blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                y = np.stack(f["e"].to_numpy()).astype(np.float64) @ weights.T + bias
                yield pd.DataFrame({key: f[key], "e": list(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12))})

    return vectors.select(key, "e").mapInPandas(run, f"{key} {vectors.schema[key].dataType.simpleString()}, e array<double>")


def ema_step(assigned: DataFrame, state: DataFrame, decay: float, eps: float = 1e-5) -> DataFrame:
    """(code, d, size, total, v): moving cluster sizes and sums; v: sum over the Laplace-smoothed size.

    state: code, size, total (array). A code without vectors decays."""
    sums = assigned.select("code", F.posexplode("e").alias("d", "x")).groupBy("code", "d").agg(F.sum("x").alias("sx"), F.count("*").alias("n"))
    rows = state.select("code", "size", F.posexplode("total").alias("d", "total")).join(sums, ["code", "d"], "left")
    rows = rows.select("code", "d", (F.col("size") * decay + F.coalesce("n", F.lit(0)) * (1 - decay)).alias("size"),
                       (F.col("total") * decay + F.coalesce("sx", F.lit(0.0)) * (1 - decay)).alias("total"))
    by = Window.partitionBy("d")
    whole, codes = F.sum("size").over(by), F.count("*").over(by)
    smooth = (F.col("size") + eps) / (whole + codes * eps) * whole
    return rows.withColumn("v", F.col("total") / smooth)


def dead_codes(sizes: DataFrame, vectors: DataFrame, threshold: float, key: str, seed: int = 42) -> DataFrame:
    """(code, key): codes whose size is below the threshold, each with a vector drawn by hash order.

    The k-th dead code gets the k-th vector; only as many vectors as there are dead codes are ranked.
    If there are fewer vectors, they are dealt out again from the first."""
    dead = sizes.where(F.col("size") < threshold)
    count = dead.count()
    dead = dead.select("code", F.row_number().over(Window.orderBy("code")).alias("k"))
    drawn = vectors.select(key, F.md5(F.concat_ws(":", F.lit(seed), F.col(key))).alias("h")).orderBy("h", key).limit(count)
    drawn = drawn.select(key, F.row_number().over(Window.orderBy("h", key)).alias("k"))
    dead = dead.withColumn("k", (F.col("k") - 1) % max(1, drawn.count()) + 1)
    return dead.join(drawn, "k").select("code", key)


def reconstruction_error(df: DataFrame, keys: list[str], batch: list[str]) -> DataFrame:
    """(batch, keys, mae, mse) of rows (prediction, target): each sample's mean of the masked errors, the mask
    divided by its mean over the whole batch.

    So a sample with many missing targets counts less than its neighbours. A counted target
    without prediction has an error of 0; a batch without counted targets has errors of 0."""
    d = F.col("prediction") - F.col("target")
    total = lambda e: F.coalesce(F.sum(F.when(F.col("target").isNotNull(), F.coalesce(e, F.lit(0.0)))), F.lit(0.0))
    sums = df.groupBy(*batch, *keys).agg(total(F.abs(d)).alias("mae"), total(d * d).alias("mse"), F.count("*").alias("n"), F.count("target").alias("seen"))
    whole = Window.partitionBy(*batch)
    share = F.sum("seen").over(whole) / F.sum("n").over(whole)
    mean = lambda c: F.when(share > 0, F.col(c) / F.col("n") / share).otherwise(0.0).alias(c)
    return sums.select(*batch, *keys, mean("mae"), mean("mse"))


def below_error(df: DataFrame, limit: float) -> Column:
    """Keeps unknown errors: only what exceeds the limit goes."""
    return F.coalesce(F.col("mae") <= limit, F.lit(True)) & F.coalesce(F.col("mse") <= limit, F.lit(True))


def spectrum(values: DataFrame) -> DataFrame:
    """Ratios of neighbouring eigenvalues (i, value, largest first) and the slope of their logarithms."""
    order = Window.orderBy("i")
    rows = values.withColumn("ratio", F.lead("value").over(order) / F.col("value"))
    return rows.agg(F.avg("ratio").alias("ratio_mean"), F.stddev_pop("ratio").alias("ratio_std"),
                    (F.stddev_pop("ratio") / F.avg("ratio")).alias("ratio_cv"), F.regr_slope(F.ln("value"), F.col("i")).alias("slope"))
