"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A mask selects some of the words of a window and ignores the others, so windows that differ in
ignored words only have the same hash. Hashes of all windows of the documents meet those of the
benchmark; hits on one diagonal (document place minus item place) are verified once, word by
word along the whole item.

No overlap is without a hit: one of 22 or more words has a half of 11 words or more with the same
share or a larger one, hence 8 matches, and so on down to 21 words; every arrangement of matches
over 8 to 21 words that meets the criterion holds one of the masks (the tests go through all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, Scratch, free_name, small

#: Items of SPAN words or more have the masks (places of a window), shorter ones are a mask as a whole.
SPAN = 9
MASKS = [(0, 1, 2, 4), (0, 1, 6, 7), (0, 2, 3, 4)]
#: Words that must match in an overlap (all words of a shorter item), and their share of it.
LEAST_MATCHES, LEAST_SHARE = 8, 0.7
#: Every longer overlap holds one of at most so many words.
LONGEST = 21
#: Seeds of the benchmark up to which they are broadcast.
SEED_ROWS = 2_000_000


def word_ids(text: Column) -> Column:
    """Hashes of a text's words, lower-cased; for no words one hash, of the empty string."""
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\r\v\f")), SEPARATORS, -1)
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """rows with ids → all columns but ids, at, seed: the hash of each window under each mask that fits."""
    kinds, span = len(masks), min(m[-1] for m in masks) + 1
    rows = rows.where(F.size("ids") >= span)
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), (F.size("ids") - span + 1) * kinds - 1)))
    at = F.floor(F.col("turn") / kinds).cast("int") if kinds > 1 else F.col("turn")
    hashes = [F.when(F.get("ids", at + mask[-1]).isNotNull(), F.xxhash64(F.lit(mask[-1] + 1), F.lit(m), *[F.get("ids", at + p) for p in mask])) for m, mask in enumerate(masks)]
    seed = hashes[0]
    for m in range(1, kinds):
        seed = F.when(F.col("turn") % kinds == m, hashes[m]).otherwise(seed)
    return rows.select(*[c for c in rows.columns if c not in ("ids", "turn")], at.alias("at"), seed.alias("seed")).where("seed IS NOT NULL")


def _overlap() -> Column:
    """The best segment along the diagonal, as (start, size, matches) in places of the item."""
    low, high = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.size("item_ids"), F.size("ids") - F.col("diagonal")) - 1
    zero = F.struct(*[F.lit(0).alias(c) for c in ("score", "start", "hits", "best", "best_start", "best_size", "best_hits")])

    def step(a: Column, i: Column) -> Column:
        same = F.get("ids", i + F.col("diagonal")) == F.get("item_ids", i)
        fresh = a["score"] <= 0
        score = F.when(fresh, 0).otherwise(a["score"]) + F.when(same, 1).otherwise(-2)
        start = F.when(fresh, i).otherwise(a["start"])
        hits = F.when(fresh, 0).otherwise(a["hits"]) + F.when(same, 1).otherwise(0)
        better = score > a["best"]
        pick = lambda new, old: F.when(better, new).otherwise(a[old])
        return F.struct(score.alias("score"), start.alias("start"), hits.alias("hits"), pick(score, "best").alias("best"),
                        pick(start, "best_start").alias("best_start"), pick(i - start + 1, "best_size").alias("best_size"),
                        pick(hits, "best_hits").alias("best_hits"))

    return F.aggregate(F.sequence(low, high), zero, step)


def _window(least: Column) -> Column:
    """The overlap of at most LONGEST words with most matches, of equals the shortest, then the first; of size 0 if there is none."""
    low, high = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.size("item_ids"), F.size("ids") - F.col("diagonal")) - 1
    none = lambda *names: F.struct(*[F.lit(0).alias(c) for c in names])
    parts = ("best_start", "best_size", "best_hits")

    def from_start(start: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            same = F.get("ids", i + F.col("diagonal")) == F.get("item_ids", i)
            hits, size = a["hits"] + F.when(same, 1).otherwise(0), i - start + 1
            better = same & (hits >= least) & (hits >= LEAST_SHARE * size)
            return F.struct(hits.alias("hits"), F.when(better, start).otherwise(a["best_start"]).alias("best_start"),
                            F.when(better, size).otherwise(a["best_size"]).alias("best_size"), F.when(better, hits).otherwise(a["best_hits"]).alias("best_hits"))

        return F.aggregate(F.sequence(start, F.least(start + LONGEST - 1, high)), none("hits", *parts), step)

    def pick(a: Column, b: Column) -> Column:
        better = (b["best_hits"] > a["best_hits"]) | ((b["best_hits"] == a["best_hits"]) & (b["best_size"] < a["best_size"]))
        return F.struct(*[F.when(better, b[c]).otherwise(a[c]).alias(c) for c in parts])

    return F.aggregate(F.transform(F.sequence(low, high), from_start), none(*parts), pick)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where documents (doc_id, text) hold benchmark items (item_id, text).

    One row per document, item and diagonal with an overlap: doc_id, text_key (of equal texts
    under one id), item_id, doc_start, item_start, words (of the overlap), matches. An overlap
    has at least min(8, the item's words) matching words, and 7 in 10 of its words match. The row
    gives the segment with the largest score (1 a match, -2 a substitution) if that is an overlap,
    else the overlap of at most 21 words with most matches. Words are lower-cased and end at white
    space. Null, empty or wordless texts and items have none; repeated rows count once; very long
    texts are taken whole. Other columns are ignored, whatever their names; an empty table on
    either side gives no rows."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    words = F.col("text").cast("string")
    items = benchmark.where(words.rlike(r"[^\x20\x09-\x0D]")).select(F.col("item_id").cast("long"), word_ids(words).alias("ids"))
    items = scratch.write(items.distinct(), "items")
    spans = [r.n for r in items.where(F.size("ids") < SPAN).select(F.size("ids").alias("n")).distinct().collect()]
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = source.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.xxhash64("text").alias("text_key"), word_ids(F.col("text")).alias("ids"))
    hits = None
    for span, masks in [(SPAN, MASKS)] + [(n, [tuple(range(n))]) for n in sorted(spans)]:
        known = items if span == SPAN else items.where(F.size("ids") == span)
        known = scratch.write(_seeds(known, masks).withColumnRenamed("at", "item_at").distinct(), f"seeds{span}")
        met = _seeds(keyed, masks).join(small(known, SEED_ROWS), "seed")
        met = met.select("doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"))
        hits = met if hits is None else hits.union(met)
    hits = scratch.write(hits.distinct(), "hits")
    places = hits.select("doc_id", "text_key").distinct()
    found = source.withColumn("text_key", F.xxhash64("text")).withColumn("doc_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    wanted = scratch.write(places.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_key"), "text_key"), "places")
    found = found.join(small(wanted), ["doc_key", "text_key"], "left_semi").dropDuplicates(["doc_key", "text_key"])
    found = scratch.write(found.select("doc_key", "text_key", word_ids(F.col("text")).alias("ids")), "found")
    hits = hits.withColumn("doc_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows = hits.join(found, ["doc_key", "text_key"]).join(small(items.withColumnRenamed("ids", "item_ids"), 4_000_000, F.size("item_ids")), "item_id")
    rows = rows.withColumn("least", F.least(F.lit(LEAST_MATCHES), F.size("item_ids"))).withColumn("b", F.explode(F.array(_overlap())))
    best = F.struct("b.best_start", "b.best_size", "b.best_hits")
    meets = (F.col("b.best_hits") >= F.col("least")) & (F.col("b.best_hits") >= LEAST_SHARE * F.col("b.best_size"))
    rows = rows.withColumn("o", F.explode(F.array(F.when(meets, best).otherwise(_window(F.col("least")))))).where("o.best_size > 0")
    rows = rows.select(
        "doc_id", "text_key", "item_id", (F.col("o.best_start") + F.col("diagonal")).alias("doc_start"),
        F.col("o.best_start").alias("item_start"), F.col("o.best_size").alias("words"), F.col("o.best_hits").alias("matches"))
    return rows.distinct()


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents without any overlap with the benchmark, all columns as they are.

    An item of at most eight words overlaps with each text that holds all of them in a row, so an item
    of one word takes every document with that word. Null and empty texts stay; of rows that repeat a
    doc_id only those with the overlap go; an empty table stays empty, and without items all stay."""
    scratch = Scratch(docs.sparkSession, "leaks")
    dk, tk = free_name(docs, "dk"), free_name(docs, "tk")
    leaks = overlaps(docs, benchmark).select(F.col("doc_id").alias(dk), F.col("text_key").alias(tk)).distinct()
    leaks = small(scratch.write(leaks, "leaks"))
    here = docs["doc_id"].cast("long").eqNullSafe(F.col(dk)) & (F.xxhash64(docs["text"].cast("string")) == F.col(tk))
    return docs.join(leaks, here, "left_anti")
