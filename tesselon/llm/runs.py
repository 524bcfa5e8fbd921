"""Periodic runs of words, by Kolpakov and Kucherov's method, and texts without their repetitions.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring
word extends. A text is cut into factors (each the longest stretch that begins earlier, or a new
word) by its suffix automaton. Runs that touch the border of two factors are found by Main's
algorithm, in a window of twice the factor before and once the factor behind, by longest common
extensions for all periods at once. A run that lies within a factor is a copy of one in the factor's
earlier occurrence.

Only stretches that can hold a run go through this: with at least 12 words, each word of a run lies
in some six neighbouring words that stand in the same stretch once more. All else is left out
before, which no run crosses. A row's text is worked on alone, in memory in proportion to its
words; nothing is shuffled, and a lost task is run again from its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix, tidy

#: Words that a run has at least.
LEAST_WORDS = 12
#: Neighbouring words that must stand twice. With 12 words and two periods in a run, up to six always do.
GRAM = 6
#: Times that a text is cut into stretches; more cut finer, the runs are the same.
PASSES = 3
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")  # fmt: skip

_U = np.uint64
_TURNS = [_U(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(GRAM)]


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int], dict[int, dict[int, int]]]:
    """The suffix automaton of s: the end of each state's first occurrence, and its ways on, the first as letter and
    target, where there are more than one all of them as a table (most states have one)."""
    n = len(s)
    size, link, first = [0] * (2 * n + 1), [-1] * (2 * n + 1), [-1] * (2 * n + 1)
    letter, target, more = [-1] * (2 * n + 1), [0] * (2 * n + 1), {}
    last, states = 0, 1
    for at, c in enumerate(s):
        new, states = states, states + 1
        size[new], first[new] = size[last] + 1, at
        p, q = last, -1
        while p >= 0:
            if letter[p] < 0:
                letter[p], target[p] = c, new
            elif (ways := more.get(p)) is not None:
                if (q := ways.get(c, -1)) >= 0:
                    break
                ways[c] = new
            elif letter[p] == c:
                q = target[p]
                break
            else:
                more[p] = {letter[p]: target[p], c: new}
            p = link[p]
        last = new
        if p < 0:
            link[new] = 0
            continue
        if size[p] + 1 == size[q]:
            link[new] = q
            continue
        twin, states = states, states + 1
        size[twin], link[twin], first[twin] = size[p] + 1, link[q], first[q]
        letter[twin], target[twin] = letter[q], target[q]
        if q in more:
            more[twin] = dict(more[q])
        while p >= 0:
            ways = more.get(p)
            if ways is not None:
                if ways.get(c) != q:
                    break
                ways[c] = twin
            elif letter[p] == c and target[p] == q:
                target[p] = twin
            else:
                break
            p = link[p]
        link[q] = link[new] = twin
    return first, letter, target, more


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, source) of each factor: source is where it stands first, or -1 for a new word."""
    first, letter, target, more = automaton(s)
    out, b, n = [], 0, len(s)
    while b < n:
        state, size = 0, 0
        while b + size < n:
            c = s[b + size]
            ways = more.get(state)
            to = ways[c] if ways is not None else target[state]
            if first[to] - size >= b:
                break
            state, size = to, size + 1
        out.append((b, size, first[state] - size + 1) if size else (b, 1, -1))
        b += max(1, size)
    return out


def _same(s: list[int]) -> list[int]:
    """For each place the length of the longest stretch from there that s begins with."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(s: list[int], low: int, b: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions in s[low:high] that touch b, by Main's algorithm."""
    u, v = s[low:b], s[b:high]
    back, nu, nv = u[::-1], len(u), len(v)
    if nv:
        ahead, behind = _same(v), _same([*back, -1, *v[::-1], *back])  # behind[nu + 1 + nv - p]: how far back v's first p words go on
        for p in range(1, nv + 1):
            on = ahead[p] if p < nv else 0
            before = behind[nu + 1 + nv - p] if nu else 0
            if before + on >= p and before + on + p >= LEAST_WORDS:
                yield b - before, b + p + on, p
    if nu:
        ahead, behind = _same([*v, -1, *u]), _same(back)
        for p in range(1, nu + 1):
            on = ahead[nv + 1 + nu - p] if nv else 0
            before = behind[p] if p < nu else 0
            if before + on >= p and before + on + p >= LEAST_WORDS:
                yield b - p - before, b + on, p


def runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least LEAST_WORDS, in order of start, then period."""
    n, found, by_start = len(s), {}, {}

    def keep(start: int, end: int, p: int) -> None:
        known = found.get((start, end))
        if known is None:
            by_start.setdefault(start, []).append(end)
        if known is None or p < known:
            found[start, end] = p

    before = 0
    for b, size, source in [*factors(s), (n, 0, -1)]:
        low = max(0, b - 2 * before - size)
        if b + size - low >= LEAST_WORDS:
            for start, end, p in _at_border(s, low, b, b + size):
                whole = (start == 0 or s[start - 1] != s[start - 1 + p]) and (end == n or s[end] != s[end - p])
                if whole:
                    keep(start, end, p)
        if source >= 0 and size > LEAST_WORDS:
            shift = b - source
            for start in range(source + 1, source + size):
                for end in by_start.get(start, ()):
                    if end < source + size:
                        keep(start + shift, end + shift, found[start, end])
        before = size
    return sorted((start, end, p) for (start, end), p in found.items())


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ids, in order, outside which no run has a word."""
    out, work = [], [(0, len(ids), 0)]
    while work:
        low, high, turn = work.pop()
        n = high - low
        if n < LEAST_WORDS:
            continue
        if turn == PASSES:
            out.append((low, high))
            continue
        x = mix(ids[low:high])
        h = x[: n - GRAM + 1] * _TURNS[0]
        for k in range(1, GRAM):
            h = h + x[k : n - GRAM + 1 + k] * _TURNS[k]
        order = np.argsort(h)
        there = h[order]
        same = there[1:] == there[:-1]
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if not len(twice):
            continue
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, twice, 1)
        np.add.at(change, twice + GRAM, -1)
        held = np.concatenate([[False], np.cumsum(change[:n]) > 0, [False]])
        edge = np.flatnonzero(held[1:] != held[:-1]).reshape(-1, 2)
        for a, b in edge.tolist():
            work.append((low + a, low + b, PASSES if b - a == n else turn + 1))
    return sorted(out)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in a text's words."""
    if len(words) < LEAST_WORDS:
        return []
    number = _Numbers()
    ids = np.fromiter(map(number.__getitem__, words), _U, len(words))
    if len(number) == len(words):
        return []
    out = []
    for low, high in _stretches(ids):
        _, own = np.unique(ids[low:high], return_inverse=True)
        out += [(low + a, low + b, p) for a, b, p in runs(own.tolist())]
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, end, p in found:
        change[start + p] += 1
        change[end] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def with_repeats(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words, of every tenth document (by hash of its id) with a tail that repeats its own beginning."""
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _described(planted: bool, texts: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["text"] * texts
    kinds = [pa.int64()] * 6 + [pa.string()] * (2 + texts)

    def row(doc, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes: at U+0020 and U+0009 to U+000D
        if planted:
            words = with_repeats(words, doc)
        found = runs_of(words)
        listed = "".join(f"{a},{b - a},{p}\n" for a, b, p in found)
        start, end, p = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else (None, None, None)
        best = (start, end - start, p, 1000 * (end - start) // p) if found else (None,) * 4
        left = b" ".join(collapsed(words, found))
        return doc, len(found), *best, sha256(listed.encode()).hexdigest(), sha256(left).hexdigest(), *[left.decode("utf-8", "replace")] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def periodic_runs(docs: DataFrame, *, planted: bool = False, texts: bool = False) -> DataFrame:
    """For each row of docs its periodic runs: n_runs, the longest (start, length, period, exponent_milli), digests of all and of the text without repetitions.

    docs: doc_id, text; other columns are ignored, whatever their names. texts: also text, the words
    that are left, joined by single spaces. A null, empty or wordless text has no words and no runs:
    nulls for the longest, and the digests of nothing. Of equally long runs the first, then that of
    the least period counts. Very long texts are taken whole; rows that repeat are rows of their own;
    an empty table gives no rows. planted: every tenth document, by hash of a non-null doc_id, gets a
    repeating tail first, which gives each table runs to find."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_described(planted, texts)), SCHEMA + ", text string" * texts)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=True)
