"""Join of near-equal word-shingle sets by PartEnum signatures, and the classes it leads to.

Two sets of a and b features whose Jaccard similarity is at least g differ in at most
k = (1-g)/(1+g) * (a+b) features. Sets are compared within levels, bands of sizes that grow by
1/g; each set also gives the signatures of the next level, so every pair that can be similar
meets in one. A level cuts the feature domain into n parts and each part into three cells; a
part's signatures are the subsets of two cells. A part without differences shares three of
them, one with a single difference at least one, so a similar pair shares max(2n-k, 3n-2k).

One less than that many signatures of a set are to spare. A set may leave out its worst ones,
if worse is the same for all sets that share a signature: the best shared signature of a pair
has all others of the pair below it, so neither set leaves it out. Half of them go before the
shuffle (those of the fewest features), the others after it (those that most sets share, as
parts of passages that many documents hold). What is left and shared leads each set to the
least one it shares a signature with. Around each of these, bitmaps are compared, in blocks:
two bitmaps differ in at most as many bits as the sets do in features. What passes forms
families, and each family is compared exactly, in blocks of bounded size: for numbers of links pair
by pair, where only components are asked for by a search that compares a set with those that no
component holds yet (see forest), so that a family of near copies costs a comparison a member.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bound_batches, free_name, mix, shingle_hashes, small, spark_gc, tidy, words_by_row
from .components import connected_components
from .forest import Bitmaps, Sets, forest

_U = np.uint64
#: Features that one block of a family may hold; larger families are compared block by block.
BLOCK_FEATURES = 1_500_000
#: Bytes of bitmaps that one block around a common neighbour may hold.
BLOCK_BYTES = 16 << 20
#: Sets of a block, as large as they may be.
BLOCK_SETS = 8192
#: Rows that leave a worker together.
_ROWS = 100_000


@lru_cache(maxsize=64)
def _tops(percent: int) -> list[int]:
    """The largest size of each level."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return tops


@lru_cache(maxsize=4096)
def _layout(level: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Parts of a level, the upper limits of its cells, and a tag for each part."""
    most = 2 * _tops(percent)[level] * (100 - percent) // (100 + percent)
    parts = most // 2 + 1
    step = (1 << 64) / (3 * parts)
    limits = np.array([min(int(step * i), (1 << 64) - 1) for i in range(1, 3 * parts)], _U)
    return parts, limits, mix(np.arange(parts, dtype=_U) * _U(8191) + _U((level + 2) << 32))


@lru_cache(maxsize=65536)
def _spare(size: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(level, signatures to spare) for each level in which a set of that size can have partners."""
    tops, out = _tops(percent), []
    own = bisect_left(tops, size)
    for level in (own, own + 1):
        partner = min(100 * size // percent, tops[level])
        if level > own and partner <= tops[own]:
            continue
        parts, apart = _layout(level, percent)[0], (size + partner) * (100 - percent) // (100 + percent)
        out.append((level, max(2 * parts - apart, 3 * parts - 2 * apart) - 1))
    return tuple(out)


def late_spare(size: int, percent: int) -> list[int]:
    """Signatures to leave out after the shuffle, for signatures with even and with odd numbers."""
    out = [0, 0]
    for level, spare in _spare(size, percent):
        out[level & 1] = spare - spare // 2
    return out


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a sorted array of distinct uint64 features; the last bit is that of the level."""
    spread = np.sort(mix(features ^ _U(0xA0761D6478BD642F)))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(spread), dtype=_U)])
    out = []
    for level, spare in _spare(len(features), percent):
        parts, limits, tag = _layout(level, percent)
        cuts = np.concatenate([[0], np.searchsorted(spread, limits), [len(spread)]])
        cell, count = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(parts, 3), np.diff(cuts).reshape(parts, 3)
        made = np.concatenate([mix(mix(tag + _U(7 * a + b) + cell[:, a]) + cell[:, b]) for a, b in ((0, 1), (0, 2), (1, 2))])
        if early := spare // 2:
            held = np.concatenate([count[:, a] + count[:, b] for a, b in ((0, 1), (0, 2), (1, 2))])
            made = made[np.lexsort((made, held))[early:]]
        out.append((made & ~_U(1)) | _U(level & 1))
    return np.concatenate(out)


def bitmap(features: np.ndarray) -> bytes:
    """A bit for each feature, in a power of two of at least twice as many bits (64 to 2**20)."""
    size = min(1 << 20, max(64, 1 << (2 * len(features) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[((features >> _U(17)) & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(size: int):
    """The sorted distinct shingle hashes of each text."""

    def each(text: pa.Array) -> Iterator[np.ndarray]:
        for words in words_by_row(text):
            yield np.unique(shingle_hashes(words, size))

    return each


def _key(features: np.ndarray) -> bytes:
    return hashlib.blake2b(features.tobytes(), digest_size=16).digest()


def _vertex(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _describe(size: int, percent: int):
    sets = _sets(size)
    names = ["n_shingles", "key", "vertex", "late"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in sets(batch.column("text")):
                key = _key(s) if len(s) else None
                rows.append((len(s), key, _vertex(key), late_spare(len(s), percent)) if key else (0, None, None, None))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "text_key", *names])

    return run


def _signed(size: int, percent: int):
    sets = _sets(size)

    def batch(sigs: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(sigs).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(flat), pa.array(np.repeat(np.array(owners, np.int64), [len(s) for s in sigs]))], names=["sig", "vertex"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, owners, waiting = [], [], 0
            for s in sets(b.column("text")):
                if not len(s):
                    continue
                sigs.append(signatures(s, percent))
                owners.append(_vertex(_key(s)))
                waiting += len(sigs[-1])
                if waiting >= _ROWS:
                    yield batch(sigs, owners)
                    sigs, owners, waiting = [], [], 0
            if sigs:
                yield batch(sigs, owners)

    return run


def _with_sets(size: int, columns: list[str], make):
    """Rows with columns and the text's features, as make (features to bytes) writes them."""
    sets = _sets(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([make(s) for s in sets(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [found], names=[*columns, "made"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def compare(ids: list[int], copies: list[int], features: list[np.ndarray], side: list[int], percent: int):
    """Exact links of one family or of two of its blocks (side differs from row to row).

    Yields (u, v, 0) for a spanning forest of the links and (u, None, linked documents) for each
    row with links. With two sides, only pairs across them count."""
    m = len(ids)
    sizes = np.array([len(x) for x in features])
    flat = np.concatenate(features)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    first = np.flatnonzero(new)
    run = np.empty(len(flat), np.int64)
    run[order] = np.cumsum(new) - 1
    count = np.diff(np.append(first, len(flat)))
    holders = owner[order]
    ends = np.cumsum(sizes)
    side_of, weight = np.array(side), np.array(copies)
    two = len(set(side)) > 1
    linked, forest = np.zeros(m, np.int64), _Forest(m)
    for x in range(m):
        runs = run[ends[x] - sizes[x] : ends[x]]
        runs = runs[count[runs] > 1]
        if not len(runs):
            continue
        c = count[runs]
        at = np.arange(c.sum()) + np.repeat(first[runs] - np.cumsum(c) + c, c)
        both = np.bincount(holders[at], minlength=m)[x + 1 :]
        good = 100 * both >= percent * (sizes[x] + sizes[x + 1 :] - both)
        if two:
            good &= side_of[x + 1 :] != side_of[x]
        near = np.flatnonzero(good) + x + 1
        if not len(near):
            continue
        linked[x] += weight[near].sum()
        linked[near] += weight[x]
        for y in near.tolist():
            if forest.join(x, y):
                yield ids[x], ids[y], 0
    for x in np.flatnonzero(linked).tolist():
        yield ids[x], None, int(linked[x])


def _grouped(work, names: list[str], kinds: list[pa.DataType]):
    """work on the rows (block, …) of each run of equal (home, lo, hi); rows stay in memory for one such run."""

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for b in batches:
            for *group, block, member, weight, made in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group != key:
                    if len(rows) > 1:
                        out += work(*map(list, zip(*rows, strict=True)))
                    key, rows = group, []
                rows.append((block, member, weight, made))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if len(rows) > 1:
            out += work(*map(list, zip(*rows, strict=True)))
        if out:
            yield batch(out)

    return tidy(run)


def _blocks(parts: Column) -> Column:
    """Blocks of a group, at least so many parts, each of BLOCK_SETS rows at most or so."""
    return F.ceil(F.greatest(parts, F.count("*") / BLOCK_SETS)).cast("int").alias("blocks")


def _in_blocks(rows: DataFrame, member: str) -> DataFrame:
    """rows (home, blocks, member, weight, made) dealt out by (home, lo, hi): each pair of a home's blocks, and each block alone, together."""
    block = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("block", i).alias("lo"), F.greatest("block", i).alias("hi")))
    rows = rows.withColumn("block", block).withColumn("pair", F.explode(pairs))
    rows = rows.select("home", "pair.lo", "pair.hi", "block", member, "weight", "made")
    return rows.repartition("home", "lo", "hi").sortWithinPartitions("home", "lo", "hi", member)


def _candidates(texts: DataFrame, classes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(vertex, home): sets and the least set with which they share a signature after both cuts."""
    sigs = texts.mapInArrow(tidy(_signed(words, percent)), "sig long, vertex long")
    shared = F.count("*").over(Window.partitionBy("sig"))
    sigs = scratch.write(sigs.withColumn("shared", shared).where("shared > 1"), "shared")
    spark_gc(texts.sparkSession)
    level = F.col("sig").bitwiseAND(F.lit(1)).cast("int")
    hot_first = Window.partitionBy("vertex", level).orderBy(F.desc("shared"), "sig")
    late = classes.select("vertex", "late").dropDuplicates(["vertex"])
    left = sigs.join(late, "vertex").withColumn("turn", F.row_number().over(hot_first))
    left = left.where(F.col("turn") > F.get("late", level)).select("sig", "vertex")
    home = F.min("vertex").over(Window.partitionBy("sig"))
    pairs = left.withColumn("home", home).where("vertex <> home").select("vertex", "home").distinct()
    pairs = scratch.write(pairs, "pairs")
    scratch.drop("shared")
    return pairs.union(pairs.select(F.col("home"), F.col("home")).distinct())


def _families(texts: DataFrame, classes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(vertex, label): sets that bitmaps don't tell apart, directly or through others."""
    units = scratch.write(_candidates(texts, classes, scratch, words, percent), "units")
    met = small(scratch.write(units.select("vertex").distinct(), "met"))
    own = classes.join(met, "vertex", "left_semi").select("vertex", F.col("n").alias("weight"), "doc_id", "text_key")
    maps = texts.join(small(scratch.write(own, "own")), ["doc_id", "text_key"]).select("vertex", "weight", "text")
    maps = scratch.write(maps.mapInArrow(tidy(_with_sets(words, ["vertex", "weight"], bitmap)), "vertex long, weight long, made binary"), "maps")
    units = units.join(maps.select("vertex", F.length("made").alias("bytes")), "vertex")
    blocks = units.groupBy("home").agg(_blocks(F.sum("bytes") / BLOCK_BYTES))
    units = scratch.write(units.select("vertex", "home").join(blocks, "home"), "blocked")
    rows = _in_blocks(units.join(maps, "vertex").select("home", "blocks", "vertex", "weight", "made"), "vertex")

    def work(side: list[int], ids: list[int], sizes: list[int], maps: list[bytes]) -> Iterator[tuple[int, int]]:
        for x, y in forest(np.array(sizes), percent, Bitmaps(maps, np.array(sizes), percent)):
            yield ids[x], ids[y]

    edges = rows.mapInArrow(_grouped(work, ["u", "v"], [pa.int64()] * 2), "u long, v long")
    edges = scratch.write(edges, "alike")
    scratch.drop("pairs", "units", "met", "own", "maps", "blocked")
    spark_gc(texts.sparkSession)
    return connected_components(edges, scratch, "family")


def _linked(texts: DataFrame, classes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(u key, v key, links): the exact links of each family, a forest of them with v, and each set's number of linked documents without."""
    family = _families(texts, classes, scratch, words, percent)
    member = classes.join(family, "vertex").select("label", "doc_id", "text_key", "key", "n", "copies")
    parts = member.groupBy("label").agg(_blocks(F.sum("n") / BLOCK_FEATURES))
    member = member.join(parts, "label").select(F.col("label").alias("home"), "blocks", "key", F.col("copies").alias("weight"), "doc_id", "text_key")
    member = small(scratch.write(member, "members"))
    rows = texts.join(member, ["doc_id", "text_key"]).select("home", "blocks", "key", "weight", "text")
    rows = rows.mapInArrow(tidy(_with_sets(words, ["home", "blocks", "key", "weight"], lambda s: s.tobytes())), "home long, blocks int, key binary, weight long, made binary")
    work = lambda side, ids, copies, made: compare(ids, copies, [np.frombuffer(m, _U) for m in made], side, percent)
    links = _in_blocks(rows, "key").mapInArrow(_grouped(work, ["u", "v", "links"], [pa.binary(), pa.binary(), pa.int64()]), "u binary, v binary, links long")
    return scratch.write(links, "links")


def confirmed(texts: DataFrame, classes: DataFrame, family: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """A spanning forest of the exact links within families (vertex, label), (u key, v key, links null): for components, which need no counts."""
    member = classes.join(family, "vertex").select("label", "doc_id", "text_key", "key", "n")
    parts = member.groupBy("label").agg(_blocks(F.sum("n") / BLOCK_FEATURES))
    member = member.join(parts, "label").select(F.col("label").alias("home"), "blocks", "key", F.col("n").alias("weight"), "doc_id", "text_key")
    member = small(scratch.write(member, "members"))
    rows = texts.join(member, ["doc_id", "text_key"]).select("home", "blocks", "key", "weight", "text")
    kind = "home long, blocks int, key binary, weight long, made binary"
    rows = rows.mapInArrow(tidy(_with_sets(words, ["home", "blocks", "key", "weight"], lambda s: s.tobytes())), kind)

    def work(side: list[int], ids: list[bytes], sizes: list[int], made: list[bytes]) -> Iterator[tuple[bytes, bytes, None]]:
        for x, y in forest(np.array(sizes), percent, Sets([np.frombuffer(m, _U) for m in made], percent)):
            yield ids[x], ids[y], None

    links = _in_blocks(rows, "key").mapInArrow(_grouped(work, ["u", "v", "links"], [pa.binary(), pa.binary(), pa.int64()]), "u binary, v binary, links long")
    return scratch.write(links, "links")


def _joined(texts: DataFrame, classes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """As _linked, without numbers of links."""
    return confirmed(texts, classes, _families(texts, classes, scratch, words, percent), scratch, words, percent)


def _classify(docs: DataFrame, words: int, percent: int, scratch: Scratch, find=_linked) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of docs with their sets, the classes of equal sets with the label of their links' component, and whether ids repeat."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    kind = "doc_id long, text_key long, n_shingles long, key binary, vertex long, late array<int>"
    rows = scratch.write(source.mapInArrow(tidy(_describe(words, percent)), kind), "rows")
    repeats = not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    known = rows.where("key is not null and doc_id is not null")
    if repeats:
        known, source = known.dropDuplicates(["doc_id", "text_key"]), source.dropDuplicates(["doc_id", "text_key"])
    same = [F.max(c).alias(c) for c in ("vertex", "late")]
    classes = known.groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), *same)
    classes = scratch.write(classes.select("key", "first.doc_id", "first.text_key", "copies", "n", "vertex", "late"), "classes")
    first = classes.select("key", F.struct("doc_id", "text_key").alias("first"))
    copies = known.join(first, "key").where(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key")
    copies = small(scratch.write(copies, "copies"), 500_000)
    texts = source.where("doc_id is not null").join(copies, ["doc_id", "text_key"], "left_anti")
    links = find(texts, classes, scratch, words, percent)
    label = connected_components(links.where("v is not null").select("u", "v"), scratch, "class").withColumnRenamed("vertex", "key")
    degree = links.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    classes = classes.join(label, "key", "left").join(degree, "key", "left").withColumn("label", F.coalesce("label", "key"))
    classes = scratch.write(classes.drop("late", "vertex", "n"), "labelled")
    scratch.drop("classes", "copies", "members", "links")
    return rows, classes, repeats


def _one_vertex_an_id(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """classes with labels that also join the texts of one doc_id."""
    held = rows.where("doc_id is not null").join(classes.select("key", "label"), "key").select("doc_id", "label")
    ties = held.groupBy("doc_id").agg(F.min("label").alias("u"), F.max("label").alias("top")).where("u <> top").select("doc_id", "u")
    ties = held.join(ties, "doc_id").select("u", F.col("label").alias("v"))
    moved = connected_components(ties, scratch, "ids").toDF("label", "to")
    return classes.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def similar_classes(docs: DataFrame, *, words: int = 5, percent: int = 80, find=_linked) -> DataFrame:
    """Classes of documents whose sets of word shingles have Jaccard similarity percent/100 or more.

    docs: doc_id long, text string; other columns are ignored. Returns one row per row of docs:
    doc_id, n_shingles (size of the set), component_id (least doc_id that links lead to, itself
    included), n_links (documents linked to the row's text directly, copies included, as far as find
    counts them; find: how links between classes are found). Equal sets are one class and are compared once. Null, empty or wordless text: an empty set, linked with
    nothing. Very long texts are taken whole. Rows that repeat a doc_id are one vertex: their
    texts' links count as the document's own, and equal rows count once. A null doc_id has a null
    component_id, no links and part in no component. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows, classes, repeats = _classify(docs, words, percent, scratch, find)
    if repeats:
        classes = scratch.write(_one_vertex_an_id(rows, classes, scratch), "joined")
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component"))
    classes = scratch.write(classes.join(least, "label"), "components")
    out = rows.join(classes.select("key", "component", "copies", "links"), "key", "left")
    known = F.col("doc_id").isNotNull()
    component = F.coalesce("component", "doc_id")
    if repeats:  # a row without words goes with its document's other texts
        own = out.where(known).groupBy("doc_id").agg(F.min("component").alias("other"))
        out, component = out.join(own, "doc_id", "left"), F.coalesce("component", "other", "doc_id")
    links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("doc_id", "n_shingles", F.when(known, component).alias("component_id"), F.when(known, links).otherwise(0).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each class of linked texts one row, with all its columns: that of the least doc_id, of equal ids that of the least text hash.

    Rows without doc_id and rows without words stay, as they are linked with nothing. A doc_id that
    stands at texts of two classes doesn't join them here. Of equal rows one stays. An empty table
    stays empty."""
    scratch = Scratch(docs.sparkSession, "classes")
    rows, classes, repeats = _classify(docs, words, percent, scratch, _joined)
    first = scratch.write(classes.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first")), "first")
    stays = classes.join(first, "label").select("key", "first")
    gone = rows.where("key is not null and doc_id is not null").join(stays, "key").where(F.struct("doc_id", "text_key") != F.col("first"))
    at, text_at = free_name(docs, "at"), free_name(docs, "text_at")
    gone = scratch.write(gone.select(F.col("doc_id").alias(at), F.col("text_key").alias(text_at)), "gone")
    here = (docs["doc_id"].cast("long") == F.col(at)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text_at))
    left = docs.join(small(gone, 1_000_000), here, "left_anti")
    if not repeats:
        return left
    again = rows.where("key is not null and doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").drop("count")
    again = scratch.write(again.toDF(at, text_at), "again")
    here = (left["doc_id"].cast("long") == F.col(at)) & (F.xxhash64(left["text"].cast("string")) == F.col(text_at))
    alone, twice = left.join(small(again, 1_000_000), here, "left_anti"), left.join(small(again, 1_000_000), here, "left_semi")
    turn = free_name(docs, "turn")
    order = Window.partitionBy(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))).orderBy(F.lit(0))
    return alone.union(twice.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


#: The same rows by comparing all pairs that share a shingle.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
c AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.v, c.r FROM c JOIN e ON e.u = c.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(r) FROM c WHERE c.v = s.doc_id) AS component_id,
  (SELECT count(*) FROM e WHERE e.u = s.doc_id) AS n_links FROM s
"""
