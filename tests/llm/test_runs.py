"""Periodic runs against a comparison of all periods, and whole results of the query."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from tesselon.llm import runs

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(words, least=12):
    """For each period the stretches on which words a period apart are equal; of equal stretches the least period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((a, b, p) for (a, b), p in found.items())


def expected(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc).encode())
    if doc is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for a, b, p in found for i in range(a + p, b)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b - a},{p}\n" for a, b, p in found).encode()
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(found), *four, sha256(listed).hexdigest(), sha256(left).hexdigest())


def _sequence(rng):
    s = [rng.randrange(rng.choice([1, 2, 2, 3, 4, 8])) for _ in range(rng.randrange(1, 90))]
    for _ in range(rng.randrange(4)):
        i, p, m = rng.randrange(len(s)), rng.randrange(1, 9), rng.randrange(10, 40)
        s[i:i] = (s[i : i + p] * m)[:m]
    if rng.random() < 0.5:
        i = rng.randrange(len(s))
        s += s[max(0, i - 30) : i]
    return s


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(250):
        s = _sequence(rng)
        want = brute(s)
        assert runs.runs(s) == want  # without the cut into stretches
        assert runs.runs_of([b"%d" % x for x in s]) == want


def test_factors_are_the_longest_that_begin_earlier():
    rng = random.Random(9)
    for _ in range(200):
        s, at = _sequence(rng), 0
        for b, size, source in runs.factors(s):
            assert b == at
            longest = max((k for i in range(b) for k in [next((k for k in range(len(s) - b) if s[i + k] != s[b + k]), len(s) - b)]), default=0)
            assert size == max(1, longest) and (source < 0 if not longest else s[source : source + size] == s[b : b + size] and source < b)
            at += size
        assert at == len(s)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 40_000]  # the brute force is quadratic; long texts have tests of their own
    want = {r.doc_id: expected(r.doc_id, r.text) for r in short}
    rows = runs.op12_runs(spark, sf_dir).collect()
    assert len(rows) == len(docs) and len(short) > 0.95 * len(docs)
    assert all(tuple(r) == want[r.doc_id] for r in rows if r.doc_id in want)
    assert sum(r.n_runs > 0 for r in rows) >= 10


def test_odd_rows(spark):
    loop = "a b c " * 8
    rows = [(1, None, "x", "y", 1), (2, "", None, None, None), (3, " \t\n\x0b\x0c\r", "x", "y", 1), (4, "one", "x", "y", 1), (5, loop, "x", "y", 1), (5, loop, "x", "y", 1),
            (None, loop, "x", "y", 1), (None, None, None, None, None), (6, "a\u00a0b " * 12, "x", "y", 1), (7, "A a " * 6, "x", "y", 1), (8, "a b c d " * 3 + "a b c d", "x", "y", 1),
            (9, "w " * 11, "x", "y", 1), (10, "w " * 12, "x", "y", 1), (12, "日本 語 " * 9 + "終", "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'q' AS start", "'q' AS period", "'q' AS runs")
    for planted in (False, True):
        got = runs.periodic_runs(docs, planted=planted).collect()
        want = [expected(d if planted else None, t)[1:] for d, t, *_ in rows]
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((d, *w)) for (d, *_), w in zip(rows, want, strict=True))
    empty = runs.periodic_runs(docs.where("false"))
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "n_runs", "start"]


def test_texts_without_repetitions(spark):
    docs = spark.createDataFrame([(1, "x " + "a b\tc\n" * 6 + "y", None, None, None), (2, None, None, None, None)], DOC)
    assert {r.doc_id: r.text for r in runs.periodic_runs(docs, texts=True).collect()} == {1: "x a b c y", 2: ""}


def test_very_long_texts(spark):
    words = [f"w{i * i % 9973}" for i in range(40_000)]
    rows = [(1, "same " * 200_000, None, None, None), (3, " ".join(words * 3), None, None, None), (4, " ".join(f"{i}" for i in range(200_000)), None, None, None)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, DOC)).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (1, 0, 200_000, 1, 200_000_000)
    assert got[1].collapsed_sha256 == sha256(b"same").hexdigest() and got[4].n_runs == 0
    # squares modulo 9973 repeat after 9973 words, in mirrored halves
    assert (got[3].start, got[3].period) == (0, 9973 if got[3].period == 9973 else 40_000) and got[3].length >= 40_000
