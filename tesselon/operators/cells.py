"""Density-balanced cells: edges, raw ids, merge table, assignment, usage and distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import bin_index, mixed_radix
from .sizes import gather, small


def quantile_edges(df: DataFrame, columns: list[str], bins: list[int], accuracy: int | None = None) -> list[list[float]]:
    """Quantiles at b+1 even steps for each column: b+1 numbers a column.

    Exact with linear interpolation by default, which keeps every distinct value: right for a
    codebook of fixed size. For large tables give an accuracy: sketches of that size, no interpolation."""
    steps = [F.array(*[F.lit(i / b) for i in range(b + 1)]) for b in bins]
    how = (lambda c, p: F.percentile(c, p)) if accuracy is None else (lambda c, p: F.percentile_approx(c, p, accuracy))
    row = df.agg(*[how(c, p).alias(c) for c, p in zip(columns, steps, strict=True)]).first()
    return [list(row[c]) if row[c] is not None else [] for c in columns]


def edge_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None, size: int = 400) -> DataFrame:
    """(by, column, n, sketch): mergeable quantile sketches of columns, one for each group of `by` (an arriving file, say) and column.

    Missing and NaN values don't count; a column without any has no row. size: of a sketch; the rank error falls with it
    (about 0.7 % at 400)."""
    by = by or []
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")
    long = df.select(*by, names).select(*by, "v.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    return long.groupBy(*by, "column").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("x", F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, size: int = 400) -> DataFrame:
    """(column, n, sketch): sketches (column, n, sketch) of the same column as one, whatever files they are of."""
    return sketches.groupBy("column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketched_edges(sketches: DataFrame, bins: dict[str, int]) -> DataFrame:
    """(column, i, edge): quantiles at even steps, b+1 for a column of b bins, from one sketch a column."""
    parts = []
    for b in sorted(set(bins.values())):
        own = sketches.where(F.col("column").isin(*[c for c in bins if bins[c] == b]))
        steps = F.array(*[F.lit(i / b) for i in range(b + 1)])
        parts.append(own.select("column", F.posexplode(F.kll_sketch_get_quantile_double("sketch", steps)).alias("i", "edge")))
    return reduce(DataFrame.unionByName, parts)


def raw_ids(df: DataFrame, columns: list[str], edges: list[list[float]]) -> DataFrame:
    """Adds raw: the mixed-radix number of the bins, the first column least significant."""
    digits = [bin_index(c, e) for c, e in zip(columns, edges, strict=True)]
    return df.withColumn("raw", mixed_radix(digits, [len(e) - 1 for e in edges]))


def histogram(df: DataFrame, column: str, size: int) -> DataFrame:
    """(column, n) for every number from 0 to size-1, absent ones with 0."""
    counts = df.groupBy(F.col(column).cast("long").alias(column)).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(size).withColumnRenamed("id", column)
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def merge_table(hist: DataFrame, cells: int) -> DataFrame:
    """(raw, cell): an equal-mass cut of a histogram (raw, n) that advances by one cell a raw id at most.

    In exact integers; both windows run over the raw ids, whose number the bins fix (a few
    thousand), not over data."""
    order = Window.orderBy("raw").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("acc", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    share = F.expr(f"(acc * {int(cells)}) div greatest(total, 1)")
    hist = hist.withColumn("gap", share - F.col("raw"))
    after = F.least(F.col("raw") + 1, F.col("raw") + F.min("gap").over(order))
    hist = hist.withColumn("next", after)
    cell = F.least(F.coalesce(F.lag("next").over(Window.orderBy("raw")), F.lit(0)), F.lit(cells - 1))
    return hist.select("raw", cell.cast("int").alias("cell"))


def assign(df: DataFrame, table: DataFrame) -> DataFrame:
    """df (raw, …) with the cell of its raw id. The table has a row for each raw id of the partition's space."""
    return df.join(small(table), "raw")


def fit(df: DataFrame, columns: list[str], bins: list[int], cells: int, accuracy: int | None = None) -> tuple[list[list[float]], DataFrame]:
    """Edges and merge table from df: a codebook, or all vectors, for which accuracy bounds the memory of the edges.

    The table, a row for each raw id of the bins' space, is fixed here, so that what it was made from isn't read again."""
    edges = quantile_edges(df, columns, bins, accuracy)
    size = 1
    for b in bins:
        size *= b
    table = gather(merge_table(histogram(raw_ids(df, columns, edges), "raw", size), cells), size, "the merge table")
    return edges, df.sparkSession.createDataFrame([tuple(r) for r in table], "raw long, cell int")


def distribution(df: DataFrame, cells: int) -> DataFrame:
    """(cell, n) of every cell, empty ones too."""
    return histogram(df, "cell", cells)


def summary(dist: DataFrame) -> DataFrame:
    return dist.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("non_empty"), F.max("n").alias("largest"), F.min("n").alias("smallest"))


def by_size(dist: DataFrame) -> DataFrame:
    """Cells with their place by size, from 1, the largest first, ties by number. A row a cell."""
    return dist.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "cell")))


def extremes(dist: DataFrame, k: int) -> DataFrame:
    """The k largest and the k smallest cells, ties by number."""
    large = dist.orderBy(F.col("n").desc(), "cell").limit(k).withColumn("side", F.lit("largest"))
    return large.union(dist.orderBy("n", "cell").limit(k).withColumn("side", F.lit("smallest")))


def usage(df: DataFrame, cells: int) -> DataFrame:
    """Index rows (cell, series keys, scale, valid_len) of cells in range."""
    return df.where(F.col("cell").between(0, cells - 1))
