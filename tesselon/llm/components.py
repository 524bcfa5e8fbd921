"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(vertex, label) for each vertex of edges (u, v of one type); label is a vertex of the component.

    In each round a vertex moves onto the member of its closed neighbourhood whose hash is
    least, by a hash that differs from round to round, so that long chains shrink by a factor
    instead of by one. Edges inside a merged vertex go; the rounds end when none is left.
    Rounds are written to the shared folder; the last step composes them. Self-loops and nulls
    are ignored; a vertex without other neighbours has no row."""
    spark = edges.sparkSession
    edges = scratch.write(edges.select("u", "v").where("u <> v").distinct(), f"{name}-edges")
    kind = edges.schema["u"].dataType.simpleString()
    labels = spark.createDataFrame([], f"vertex {kind}, label {kind}")
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("to"))
        moved = both.groupBy(F.col("u").alias("at")).agg(
            F.least(F.min(rank(F.col("v"))), rank(F.col("at")))["to"].alias("to")
        )
        moved = scratch.write(moved, f"{name}-moved")
        to_u, to_v = moved.toDF("u", "u2"), moved.toDF("v", "v2")
        edges = edges.join(to_u, "u").join(to_v, "v").select(F.col("u2").alias("u"), F.col("v2").alias("v"))
        edges = scratch.write(edges.where("u <> v").distinct(), f"{name}-edges")
        if turn:
            step = labels.join(moved.toDF("label", "to"), "label", "left")
            labels = step.select("vertex", F.coalesce("to", "label").alias("label"))
        else:
            labels = moved.toDF("vertex", "label")
        labels = scratch.write(labels, f"{name}-labels")
        turn += 1
    if turn:
        scratch.drop(f"{name}-edges", f"{name}-moved")
    return labels
