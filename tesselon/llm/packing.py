"""Hierarchical multi-length packing of tokenised documents.

Documents lose whole windows of the longest size first; what remains goes to a tier of context
sizes (256 to 2048 tokens). Windows are made from the longest tier down: the longest waiting
remainder opens a window of its tier, the largest remainders that fit fill its gap from shorter
tiers, and if none fits, the longest waiting one is cut. So every sequence is full, and a
document is cut only where a gap would stay. What waits at the end of a partition is laid out
in windows of smaller powers of two. Each partition is packed as it streams by: no shuffle of
texts, and memory for one block. The written pieces are then numbered through all partitions,
tier by tier, and dealt to step groups of one tier whose sizes differ by one sequence at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import Scratch, bound_batches, small, tidy

#: Tokens of a block: that many wait at most before windows are made.
BLOCK_TOKENS = 2_000_000

#: Sequence ids are a partition's number and, in so many bits, the sequence's.
_PART = 36
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, turn long")  # fmt: skip


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, as 4-byte little-endian strings.

    Texts are encoded whole: a call for each word, and a look at those kept, takes longer than the
    merges. Those that hold one of the file's special tokens are encoded by the tokenizer itself,
    which gives those their own ids."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast, self.special = self._ranked(spec), [t["content"] for t in spec.get("added_tokens", [])]

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranked(spec: dict):
        """The same merges as ranks, if the file's ids are in the order of its merges."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            return None
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        import numpy as np

        if not text:
            return b""
        plain = self.fast and not any(t in text for t in self.special)
        ids = self.fast.encode_ordinary(text) if plain else self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


class Packer:
    """Windows from documents that come one by one; rows are (doc, start, length, crc, n, sequence, offset, tier, turn in the tier)."""

    def __init__(self, window: int, least_tier: int, first_id: int):
        self.window, self.least, self.next_id = window, least_tier, first_id
        self.pool: list[list] = [[] for _ in range(window)]  # waiting pieces by length
        self.there = 0  # bit n: a piece of n tokens waits
        self.waiting = 0
        self.made: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        full = n // w
        for i in range(full):
            self._place([(doc, i * w, w, ids, n)], w)
        if n % w:
            self._wait((doc, full * w, n % w, ids, n))
        if self.waiting >= BLOCK_TOKENS:
            self.make(w)

    def _wait(self, piece: tuple) -> None:
        self.pool[piece[2]].append(piece)
        self.there |= 1 << piece[2]
        self.waiting += piece[2]

    def _take(self, most: int) -> tuple | None:
        """The longest waiting piece of at most so many tokens."""
        fits = self.there & ((1 << (most + 1)) - 1)
        if not fits:
            return None
        n = fits.bit_length() - 1
        piece = self.pool[n].pop()
        if not self.pool[n]:
            self.there ^= 1 << n
        self.waiting -= n
        return piece

    def make(self, least: int) -> None:
        """Windows as long as `least` tokens wait."""
        while self.waiting >= max(1, least):
            seed = self.there.bit_length() - 1
            tier = min(max(self.least, 1 << (seed - 1).bit_length()), self.window, 1 << (self.waiting.bit_length() - 1))
            gap, pieces = tier, []
            while gap:
                piece = self._take(gap)
                if piece is None:
                    doc, start, n, ids, total = self._take(self.window)
                    piece = (doc, start, gap, ids, total)
                    self._wait((doc, start + gap, n - gap, ids, total))
                pieces.append(piece)
                gap -= piece[2]
            self._place(pieces, tier)

    def _place(self, pieces: list[tuple], tier: int) -> None:
        turn, offset = self.made.get(tier, 0), 0
        self.made[tier] = turn + 1
        for doc, start, n, ids, total in pieces:
            crc = crc32(memoryview(ids)[4 * start : 4 * (start + n)])
            self.rows.append((doc, start, n, crc, total, self.next_id, offset, tier, turn))
            offset += n
        self.next_id += 1


def _pack(path: str, end_id: int, window: int, least_tier: int):
    end = end_id.to_bytes(4, "little")
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe(path)
        packer = Packer(window, least_tier, TaskContext.get().partitionId() << _PART)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, encode(text or "") + end)
                if len(packer.rows) >= 20_000:
                    yield batch(packer.rows)
                    packer.rows = []
        packer.make(0)
        if packer.rows:
            yield batch(packer.rows)

    return run


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, window: int = 2048,
         least_tier: int = 256, step_tokens: int = 1 << 17) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    docs: doc_id, text; other columns are ignored, whatever their names. A document is its ids and
    end_id; null or empty text is end_id alone. Each id lies in one piece, however long its text.
    Sequences are full: of window tokens or a smaller power of two. step_group joins sequences of
    a tier, from all partitions, into steps of at most step_tokens tokens (of one sequence, if that
    is longer), each with as many sequences as the others of its tier or one less. Rows that repeat
    a doc_id are packed as documents of their own; an empty table gives no rows. tokenizer: path
    of a tokenizer file that every executor has; by default that of the installed vocabulary files."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.write(rows.mapInArrow(tidy(_pack(tokenizer or default_tokenizer(), end_id, window, least_tier)), SCHEMA), "pieces")
    return _in_steps(rows, step_tokens)


def _in_steps(rows: DataFrame, step_tokens: int) -> DataFrame:
    """Pieces with step_group in place of turn: a tier's sequences are numbered through and cut into even steps."""
    part = F.shiftright("sequence_id", _PART).alias("part")
    held = rows.groupBy(part, "tier").agg((F.max("turn") + 1).alias("n"))  # a row for each partition and tier
    tier = Window.partitionBy("tier")
    held = held.withColumn("before", F.sum("n").over(tier.orderBy("part")) - F.col("n")).withColumn("all", F.sum("n").over(tier))
    each = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    held = held.withColumn("steps", F.ceil(F.col("all") / each)).select("part", "tier", "before", "all", "steps")
    step = F.floor((F.col("before") + F.col("turn")) * F.col("steps") / F.col("all")).cast("long")
    rows = rows.withColumn("part", part).join(small(held), ["part", "tier"])
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier",
                       (F.shiftleft(F.col("tier").cast("long"), 40) + step).alias("step_group"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
