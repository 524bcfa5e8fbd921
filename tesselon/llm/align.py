"""Alignment of the ids of two tokenizers through a dictionary of groups.

Both tokenizers cut the same bytes. Where both end a token, a group ends: a few A ids and B ids for
the same bytes. Texts have few different groups, so each is interned once: in a worker, then in a
block of documents, which is written as numbers into the block's own dictionary, then by a digest of
its ids over all blocks. Links (the pairs of a group's A and B ids) are expanded once for each
different group, and counted by the documents that hold the group. Where several groups of one
document hold the same pair, it would count that document more than once; blocks report these
surpluses, which are taken off. What a group's links add up to goes back by the group's key to the
blocks' dictionaries, and from there to the documents, which never leave their block.

Before single spaces and line ends between other characters both tokenizers end a token, so that words
are encoded apart, many new ones as one text, and kept; a test holds this against whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, spark_gc, tidy
from .packing import ByteBpe

#: Groups (different ones of each document) of a block; a single document may have more.
BLOCK_GROUPS = 400_000
#: Words and groups that a worker keeps between blocks.
CACHED_WORDS, CACHED_GROUPS = 200_000, 300_000
#: Characters of new words that are encoded together.
_TOGETHER = 1 << 16
#: Between words: before a single space or line end with other characters on both sides.
_BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PART = 36

BLOCK = ("block long, doc_id array<long>, n_groups array<long>, n_a array<long>, n_b array<long>, n_links array<long>, digest array<string>, "
         "ends array<int>, at array<int>, times array<int>, key array<binary>, a array<array<int>>, b array<array<int>>, held array<long>, "
         "pair array<long>, surplus array<long>")  # fmt: skip


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Ids of both tokenizers and the bytes of each id; strings of special tokens are plain text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast, self.slow = ByteBpe._ranked(spec), None
        if not self.fast:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path_a)
            self.slow.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary shows as they are
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes_a = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(i, self.sp.id_to_piece(i)) for i in range(self.sp.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.sizes = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]
        #: No piece goes on behind a space, and none has a line end: before single ones of them tokens end.
        self.by_word = self.fast is not None and not any("▁" in p.lstrip("▁") or "\n" in p for _, p in pieces)

    def __call__(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of a space and text; None if their bytes are not those of a space and text."""
        want = b" " + text.encode()
        a = self.fast.encode_ordinary(" " + text) if self.fast else self.slow.encode(" " + text, add_special_tokens=False).ids
        b = self.sp.encode(text, num_threads=1)
        same = b"".join(map(self.bytes_b.__getitem__, b)) == want and b"".join(map(self.bytes_a.__getitem__, a)) == want
        return (a, b) if same else None

    def groups(self, a: list[int], b: list[int]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        out, i, j, i0, j0, at_a, at_b = [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(self.bytes_a[a[i]])
                i += 1
            else:
                at_b += len(self.bytes_b[b[j]])
                j += 1
            if at_a == at_b:
                out.append((tuple(a[i0:i]), tuple(b[j0:j])))
                i0, j0 = i, j
        return out


class Dictionary:
    """Groups as a worker numbers them, and the groups of words. A word begins with the space or line end before it."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.number, self.groups, self.spelled, self.keys, self.pairs, self.words = {}, [], [], [], [], {}

    def intern(self, group: tuple) -> int:
        n = self.number.get(group)
        if n is None:
            n = self.number[group] = len(self.groups)
            self.groups.append(group)
            self.spelled.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
            self.keys.append(blake2b(self.spelled[n].encode(), digest_size=16).digest())
            self.pairs.append([x << 32 | y for x in set(group[0]) for y in set(group[1])])
        return n

    def _made(self, numbers: list[int]) -> tuple[list[int], str]:
        return numbers, ";".join(map(self.spelled.__getitem__, numbers))

    def _whole(self, text: str) -> tuple[list[int], str] | None:
        ids = self.tokens(text)
        return self._made([self.intern(g) for g in self.tokens.groups(*ids)]) if ids else None

    def _learn(self, words: list[str]) -> None:
        """Encodes new words together, as one text."""
        words = [w for w in words if not w[-1].isspace() and not w[1:2].isspace()]
        if not words:
            return
        text = "." + "".join(words)
        found = self.tokens(text)
        if not found:
            return
        ends = np.cumsum([2, *(len(w.encode()) for w in words)])
        at_a, at_b = (np.cumsum(np.fromiter(map(of.__getitem__, ids), np.int64, len(ids))) for of, ids in zip(self.tokens.sizes, found, strict=True))
        both, cut_a, cut_b = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        last = np.searchsorted(both, ends)  # of each word its last group
        if last[-1] >= len(both) or (both[last] != ends).any():
            return
        (a, b), cut_a, cut_b = found, [0, *(cut_a + 1).tolist()], [0, *(cut_b + 1).tolist()]
        numbers = [self.intern((tuple(a[cut_a[i] : cut_a[i + 1]]), tuple(b[cut_b[i] : cut_b[i + 1]]))) for i in range(len(both))]
        last = (last + 1).tolist()
        for w, low, high in zip(words, last[:-1], last[1:], strict=True):
            self.words[w] = self._made(numbers[low:high])

    def documents(self, texts: list[str | None]) -> Iterator[tuple[list[int], str]]:
        """Of each text the numbers of its groups in order, and the digest of their ids; nothing for a text without tokens."""
        if not self.tokens.by_word:
            for text in texts:
                yield self._whole(text) or ([], "") if text else ([], "")
            return
        cut = [_BREAK.split(" " + t) if t else [] for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = {w for words in cut for w in words if w not in self.words}
        some, held = [], 0
        for w in new:
            some.append(w)
            held += len(w)
            if held >= _TOGETHER:
                self._learn(some)
                some, held = [], 0
        self._learn(some)
        known = self.words
        for text, words in zip(texts, cut, strict=True):
            found = []
            for w in words:
                x = known.get(w)
                if x is None:  # a first word with white space at its edges, or bytes that differ
                    x = self._whole(w[1:]) if w is words[0] else None
                    if x is None:
                        whole = self._whole(text)
                        found = [whole] if whole else []
                        break
                found.append(x)
            yield (list(chain.from_iterable([x[0] for x in found])), sha256(";".join([x[1] for x in found]).encode()).hexdigest()) if found else ([], "")

    def document(self, text: str | None) -> tuple[list[int], str]:
        return next(self.documents([text]))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _surplus(pairs: list[list[int]], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that several groups of a document hold, and how often more than once, over all documents of a block.

    pairs: of each group of the block; doc, at: each document with each of its groups."""
    flat = np.fromiter(chain.from_iterable(pairs), np.int64)
    owner = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    owner, place = owner[shared], place[shared]
    size = np.bincount(owner, minlength=len(pairs))
    start = np.cumsum(size) - size
    some = size[at] > 0
    doc, at = doc[some], at[some]
    n = size[at]
    spread = np.arange(n.sum()) + np.repeat(start[at] - np.cumsum(n) + n, n)
    held, times = np.unique(np.repeat(doc, n) * len(values) + place[spread], return_counts=True)
    over = np.bincount(held[times > 1] % max(1, len(values)), times[times > 1] - 1, minlength=len(values)).astype(np.int64)
    return values[over > 0], over[over > 0]


def _blocks(path_a: str, path_b: str):
    names = [re.match(r"\s*(\w+)", c)[1] for c in BLOCK.split(", ")]
    long, whole = pa.int64(), pa.int32()

    def block(number: int, words: Dictionary, docs: list[tuple]) -> pa.RecordBatch:
        ids = [d[0] for d in docs]
        n = np.array([len(d[2]) for d in docs])
        groups = np.concatenate([d[2] for d in docs]) if docs else np.zeros(0, np.int64)
        times = np.concatenate([d[3] for d in docs]) if docs else groups
        own, at = np.unique(groups, return_inverse=True)
        doc = np.repeat(np.arange(len(docs)), n)
        made, size_a, size_b = [words.groups[g] for g in own], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for i, (a, b) in enumerate(made):
            size_a[i], size_b[i] = len(a), len(b)
        total = lambda x: np.bincount(doc, times * x[at], minlength=len(docs)).astype(np.int64)  # noqa: E731  exact below 2**53
        pair, surplus = _surplus([words.pairs[g] for g in own], doc, at) if len(own) else (own, own)
        columns = [
            pa.array([number], long), _lists(ids, long), _lists(total(np.ones(len(own), np.int64)), long), _lists(total(size_a), long), _lists(total(size_b), long),
            _lists(total(size_a * size_b), long), _lists([d[1] for d in docs], pa.string()), _lists(np.cumsum(n), whole), _lists(at, whole), _lists(times, whole),
            _lists([words.keys[g] for g in own], pa.binary()), pa.array([[a for a, _ in made]], pa.list_(pa.list_(whole))), pa.array([[b for _, b in made]], pa.list_(pa.list_(whole))),
            _lists(np.bincount(at, minlength=len(own)), long), _lists(pair, long), _lists(surplus, long),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Dictionary(Tokens(path_a, path_b)), TaskContext.get().partitionId() << _PART
        docs, held = [], 0
        for b in batches:
            if len(words.groups) > CACHED_GROUPS:
                if docs:
                    yield block(number, words, docs)
                    docs, held, number = [], 0, number + 1
                words.clear()
            texts = b.column(1).to_pylist()
            for doc, (groups, digest) in zip(b.column(0).to_pylist(), words.documents(texts), strict=True):
                some, times = np.unique(np.array(groups, np.int64), return_counts=True)
                docs.append((doc, digest, some, times))
                held += len(some) + 1
                if held >= BLOCK_GROUPS:
                    yield block(number, words, docs)
                    docs, held, number = [], 0, number + 1
        if docs:
            yield block(number, words, docs)

    return run


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of blocks, each with the sums over its groups."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name, row=row, batch=batch: batch.column(name)[row].values
            ends, at, times = (get(c).to_numpy().astype(np.int64) for c in ("ends", "at", "times"))
            sums = []
            for name in ("best", "total"):
                of = np.zeros(len(at) and at.max() + 1, np.int64)
                if batch.column("i")[row].is_valid:
                    of[get("i").to_numpy()] = get(name).to_numpy()
                run = np.concatenate([[0], np.cumsum(times * of[at])])
                sums.append(run[ends] - run[np.concatenate([[0], ends[:-1]]).astype(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [get("doc_id"), get("n_a"), get("n_b"), get("n_groups"), get("n_links"), pa.array(sums[0]), pa.array(sums[1]), get("digest")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _ids(column: str) -> F.Column:
    """Different ids of a group with the times that each stands there."""
    return F.explode(F.transform(F.array_distinct(column), lambda x: F.struct(x.alias("id"), F.size(F.filter(column, lambda y: y == x)).cast("long").alias("n"))))


def link_counts(blocks: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, counts): links (key, a, b, n) of each different group; counts (a, b, docs) of each different pair of ids."""
    words = blocks.select(F.explode(F.arrays_zip("key", "a", "b", "held")).alias("x")).select("x.*")
    groups = words.groupBy("key").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("held").alias("docs"))
    links = groups.select("key", "docs", "b", _ids("a").alias("x")).select("key", "docs", "x", _ids("b").alias("y"))
    links = links.select("key", "docs", F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.n") * F.col("y.n")).alias("n"))
    links = scratch.write(links, "links")
    over = blocks.select(F.explode(F.arrays_zip("pair", "surplus")).alias("x")).select("x.*")
    over = over.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), (-F.col("surplus")).alias("docs"))
    counts = links.select("a", "b", "docs").union(over).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return links, scratch.write(counts, "counts")


def align(docs: DataFrame, *, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """For each row of docs n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see the module.

    docs: doc_id, text; other columns are ignored, whatever their names. A text that is null, empty, or
    that one of the tokenizers doesn't give back byte by byte has no tokens: zeros, and '' for the digest.
    Very long texts are taken whole. Rows that repeat a doc_id are documents of their own, also for the
    counts; ties for the highest count of an A id all count as best; an empty table gives no rows.
    tokenizers: paths of a byte-level tokenizer file and of a piece model that every executor has."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "align")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = scratch.write(rows.mapInArrow(tidy(_blocks(*(tokenizers or default_tokenizers()))), BLOCK), "blocks")
    links, counts = link_counts(blocks, scratch)
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has ids: its vocabulary bounds the broadcast
    counts = counts.join(F.broadcast(best), "a")
    sums = links.select("key", "a", "b", "n").join(counts, ["a", "b"]).groupBy("key").agg(
        F.sum(F.when(F.col("docs") == F.col("most"), F.col("n")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("docs")).alias("total"))
    words = blocks.select("block", F.posexplode("key").alias("i", "key")).join(sums, "key")
    words = words.groupBy("block").agg(F.collect_list(F.struct("i", "best", "total")).alias("x"))  # a block's dictionary, which BLOCK_GROUPS bounds
    words = scratch.write(words.select("block", "x.i", "x.best", "x.total"), "sums")
    scratch.drop("links", "counts")
    spark_gc(docs.sparkSession)
    held = blocks.drop("key", "a", "b", "held", "pair", "surplus").join(words, "block", "left")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return held.mapInArrow(tidy(_back), kind)


def op11_align(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
