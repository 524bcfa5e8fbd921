"""Bottom-k sketches of word-shingle hashes.

A sketch is the k least distinct 48-bit hashes of a text's shingles, in base64. The sketch of
two parts together is the k least hashes of both sketches, so sketches merge across parts.
Two sketches estimate resemblance and containment; one estimates the number of distinct
shingles. With at most k shingles all of them are exact.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shingle_hashes, small, words_by_row

_U = np.uint64
K, WORDS = 256, 5
_TOP = 1 << 48


def sketch(words: np.ndarray, k: int = K, size: int = WORDS) -> np.ndarray:
    """The sketch of a text's word hashes: sorted uint64 values below 2**48."""
    return np.unique(shingle_hashes(words, size) >> _U(16))[:k]


def encode(found: np.ndarray) -> str:
    return base64.b64encode(found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 2:] = raw
    return full.reshape(-1).view(">u8").astype(_U)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of what a and b describe together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * _TOP / (float(a[k - 1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float]:
    """Resemblance and containment of a in b, from one merge of the two sorted sketches."""
    if not len(a):
        return (0.0 if len(b) else 1.0), 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    first = np.flatnonzero(new)
    end = int(first[k]) if len(first) > k else len(both)  # the k least hashes of either end here
    n = min(k, len(first))
    share = (end - n) / n
    whole = float(n) if n < k else (k - 1) * _TOP / (float(both[first[k - 1]]) + 1)
    return share, min(1.0, share * whole / distinct(a, k))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common shingles among those of either; 1 for two empty sketches."""
    return likeness(a, b, k)[0]


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has too; 1 for an empty sketch."""
    return likeness(a, b, k)[1]


def _fingerprints(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(w, k, size) for w in words_by_row(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encode(f) for f in found], pa.string()), pa.array([distinct(f, k) for f in found], pa.float64())],
                names=["doc_id", "fingerprint", "n_shingles"])

    return run


def fingerprints(docs: DataFrame, *, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, n_shingles estimated) of whole texts (doc_id, text).

    Fewer words than a shingle has: the whole sequence is one. Null, empty or wordless text: the
    empty sketch, an empty string. Equal texts have equal fingerprints."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints(k, words), "doc_id long, fingerprint string, n_shingles double")


def _longs(values: list[int]) -> Column:
    """A constant array; one literal however many values there are."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _above(ends: list[int], x: Column) -> Column:
    """How many of the descending ends are larger than x, by bisection."""
    table = _longs(ends)
    steps = F.sequence(F.lit(1), F.lit(max(1, len(ends).bit_length())))
    halve = lambda a, _: F.when(
        a["low"] >= a["high"], a).when(F.get(table, F.shiftright(a["low"] + a["high"], 1)) > x, F.struct((F.shiftright(a["low"] + a["high"], 1) + 1).alias("low"), a["high"].alias("high"))
    ).otherwise(F.struct(a["low"].alias("low"), F.shiftright(a["low"] + a["high"], 1).alias("high")))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(ends)).alias("high")), halve)["low"]


def neighbours(docs: DataFrame, bytes_per_range: int = 32 << 20) -> DataFrame:
    """docs (doc_id, text) in ranges of descending doc_id, with the first row of the next range at the end of each.

    Columns: part, doc_id, text, extra (true for the row lent by the next range; after the last
    range comes the first). Rows of a part are together and sorted, each part in a partition of
    its own. Where ranges end comes from Spark's range partitioning of the ids alone, so that
    ranges have about as many rows each, wherever the ids lie; the ends are fixed numbers from
    then on. Rows without doc_id come last."""
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = max(1, -(-int(size or 0) // bytes_per_range), min(n, spark.sparkContext.defaultParallelism))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(ranges, F.desc("doc_id"))
    ends = ids.groupBy(F.spark_partition_id().alias("at")).agg(F.min("doc_id").alias("end")).collect()  # a number a range
    ends = sorted((r.end for r in ends), reverse=True)
    slot = F.when(F.col("doc_id").isNull(), max(0, len(ends) - 1)).otherwise(F.least(_above(ends, F.col("doc_id")), F.lit(max(0, len(ends) - 1)))).cast("int")
    rows = docs.select(slot.alias("part"), "doc_id", "text")
    # the last of a range's ids is its end, so the first of the next one is all that is to be found; a row a range
    firsts = rows.groupBy("part").agg(F.max("doc_id").alias("id")).collect()
    order = sorted(r.part for r in firsts)
    first = {r.part: r.id for r in firsts}
    lent = spark.createDataFrame([(order[i - 1], first[p]) for i, p in enumerate(order)], "to int, id long")
    # of rows with one id, the least text comes first
    border = docs.join(small(lent), F.col("doc_id").eqNullSafe(F.col("id")))
    border = border.groupBy("to").agg(F.min_by(F.struct("doc_id", "text"), F.coalesce("text", F.lit(""))).alias("d"))
    rows = rows.withColumn("extra", F.lit(False)).union(border.select("to", "d.doc_id", "d.text", F.lit(True)))
    # a number for each range whose hash puts it into a partition of its own
    n = max(1, len(order))
    free = spark.range(40 * n).select(F.col("id").cast("int").alias("k")).withColumn("at", F.pmod(F.hash("k"), F.lit(n)))
    free = {r["at"]: r["k"] for r in free.groupBy("at").agg(F.min("k").alias("k")).collect()}
    keys = {p: free.get(i, i) for i, p in enumerate(order)}
    dealt = F.get(_longs([keys.get(p, 0) for p in range(max(order, default=0) + 1)]), F.col("part")).cast("int")
    rows = rows.withColumn("dealt", dealt).repartition(n, "dealt").drop("dealt")
    return rows.sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))


def _edited(k: int, size: int):
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "in_edited", "in_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            own = [sketch(w, k, size) for w in words_by_row(batch.column("text"))]
            rows = list(zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), texts, own, batch.column("extra").to_pylist(), strict=True))
            pairs = [(a, b) for a, b in zip([last, *rows[:-1]], rows, strict=True) if a is not None and not a[4]]
            if rows:
                last = rows[-1]
            if not pairs:
                continue
            news = []
            for (_, _, text, _, _), (_, _, after, _, _) in pairs:
                cut = len(text) // 3
                news.append(text[: len(text) - cut] + after[:cut])
            found = [sketch(w, k, size) for w in words_by_row(pa.array(news, pa.string()))]
            out = []
            for (a, b), new, f in zip(pairs, news, found, strict=True):
                edited, after = likeness(a[3], f, k), likeness(a[3], b[3], k)
                out.append((a[1], len(a[2]), hashlib.sha256(new.encode()).hexdigest(), encode(a[3]), encode(f), edited[0], after[0], distinct(a[3], k), edited[1], after[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=fields)

    return run


def edited_pairs(docs: DataFrame, *, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    The edited text has its last third replaced by the beginning of the next document's text, in
    descending doc_id, after the last one the first. near_*: resemblance with the edited text and
    with the next document; in_*: share of the text's shingles that those have; n_shingles: how
    many distinct ones it has. Null and empty texts: the empty sketch, alike to itself. Very long
    texts are taken whole. Ties of doc_id, repeated rows among them, follow each other by text; a
    null doc_id comes last; a single row is its own neighbour; an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    rows = neighbours(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.mapInArrow(_edited(k, words), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_edited double, in_next double")


def op6_sketch(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
