"""Near duplicates by an inverted join of MinHash signatures.

Each different set of word shingles has COORDINATES minima, and is posted under each pair of a
coordinate and its value. Two sets of similarity s agree in a coordinate with probability s; pairs
that agree in at least `least` coordinates are candidates, a threshold that a pair of just the
similarity asked for misses with a probability of less than MISS (a parameter; 1e-9).

Lists are merged with prefix and skip: values are ordered by how many sets have them. A set leaves
out its least-1 most frequent values. Of the values that a pair of candidates shares, the rarest has
least-1 shared ones above it, so neither set leaves it out, and they meet in its list: long lists are
skipped, and values that one set alone has are never posted. A list leads its sets to its least one,
and around each of those collisions of whole signatures are counted, in blocks of bounded size, by a
search that doesn't compare sets of one component. What passes forms families, in which links are
confirmed on full sets. Equal sets are one class, and posted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import jaccard
from .common import Scratch, mix, spark_gc, tidy
from .components import connected_components
from .forest import Signatures, forest

COORDINATES = 64
#: Chance of a miss that the threshold of matches allows for a pair of just the similarity.
MISS = 1e-9
#: Sets of a block whose signatures are compared.
BLOCK_SETS = 8192

_U = np.uint64
_TURN = mix(np.arange(1, COORDINATES + 1, dtype=_U) * _U(0xBF58476D1CE4E5B9))[:, None]
_TIMES = mix(np.arange(1, COORDINATES + 1, dtype=_U) * _U(0x94D049BB133111EB))[:, None] | _U(1)
_NAME = (np.arange(COORDINATES, dtype=_U) + _U(1)) << _U(32)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of matches that a pair of that similarity falls short of with probability miss at most."""
    p, total = percent / 100, 0.0
    for k in range(coordinates + 1):
        total += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if total > miss:
            return max(1, k)
    return coordinates


def signature(features: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set of uint64 features, as 32 bits."""
    out = np.full(COORDINATES, ~_U(0))
    for at in range(0, len(features), 1024):
        np.minimum(out, ((features[None, at : at + 1024] ^ _TURN) * _TIMES).min(axis=1), out=out)
    return out >> _U(32)


def _signed(words: int):
    sets = jaccard._sets(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s in sets(b.column("text")):
                if len(s):
                    values = signature(s)
                    rows.append((jaccard._vertex(jaccard._key(s)), len(s), values.astype(np.uint8).tobytes(), mix(values | _NAME).view(np.int64)))
            if rows:
                vertex, size, sign, posts = zip(*rows, strict=True)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vertex, pa.int64()), pa.array(size, pa.int64()), pa.array(sign, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(posts)))],
                    names=["vertex", "n", "made", "posts"])

    return run


def _units(signed: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(vertex, home): sets and the least set of each list that they share after the cut."""
    posts = signed.select("vertex", F.explode("posts").alias("post"))
    lists = posts.groupBy("post").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = posts.join(lists, "post")
    by_set = Window.partitionBy("vertex")  # a row for each coordinate at most
    shared = shared.withColumn("turn", F.row_number().over(by_set.orderBy("sets", "post"))).withColumn("all", F.count("*").over(by_set))
    kept = scratch.write(shared.where(F.col("turn") <= F.col("all") - (least - 1)).select("vertex", "post"), "kept")
    spark_gc(signed.sparkSession)
    homes = kept.groupBy("post").agg(F.min("vertex").alias("home"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    pairs = scratch.write(kept.join(homes, "post").where("vertex <> home").select("vertex", "home").distinct(), "pairs")
    scratch.drop("kept")
    return pairs.union(pairs.select(F.col("home").alias("vertex"), "home").distinct())


def _families(texts: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(vertex, label): sets that matches of signatures lead to each other, directly or through others."""
    signed = scratch.write(texts.mapInArrow(tidy(_signed(words)), "vertex long, n long, made binary, posts array<long>"), "signed")
    least = least_matches(percent)
    units = scratch.write(_units(signed, scratch, least), "units")
    blocks = units.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    rows = units.join(blocks, "home").join(signed.select("vertex", F.col("n").alias("weight"), "made"), "vertex")
    rows = jaccard._in_blocks(rows.select("home", "blocks", "vertex", "weight", "made"), "vertex")

    def work(side: list[int], ids: list[int], sizes: list[int], made: list[bytes]) -> Iterator[tuple[int, int]]:
        for x, y in forest(np.array(sizes), percent, Signatures(made, least)):
            yield ids[x], ids[y]

    edges = scratch.write(rows.mapInArrow(jaccard._grouped(work, ["u", "v"], [pa.int64()] * 2), "u long, v long"), "near")
    scratch.drop("signed", "pairs", "units")
    spark_gc(texts.sparkSession)
    return connected_components(edges, scratch, "family")


def linked(texts: DataFrame, classes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(u key, v key, links null): a spanning forest of the links between classes, confirmed on full sets."""
    return jaccard.confirmed(texts, classes, _families(texts, scratch, words, percent), scratch, words, percent)


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near duplicates: one row per row of docs with doc_id, n_shingles, component_id (least doc_id that links lead to), kept.

    docs: doc_id long, text string; other columns are ignored, whatever their names. Two texts are linked
    when their sets of word shingles have Jaccard similarity percent/100 or more; kept: the row's doc_id is
    its component's least. Null, empty or wordless text: an empty set, linked with nothing. Very long texts
    are taken whole. Rows that repeat a doc_id are one vertex, of all its texts' links, and are kept or not
    together; a null doc_id has a null component_id, no links, and is kept. An empty table gives no rows."""
    rows = jaccard.similar_classes(docs, words=words, percent=percent, find=linked)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)


#: The same rows by comparing all pairs that share a shingle.
OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
c AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.v, c.r FROM c JOIN e ON e.u = c.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.r AS component_id, s.doc_id = m.r AS kept FROM s JOIN (SELECT v, min(r) AS r FROM c GROUP BY v) m ON m.v = s.doc_id
"""
