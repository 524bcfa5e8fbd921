"""The MinHash join and the component search against all pairs."""

import random

import numpy as np
import pytest

from tesselon.llm import forest, jaccard, minhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, percent):
    """(n_shingles, component_id, kept) of each row by comparing all pairs; rows of one doc_id are one vertex."""
    sets = [shingles(t, words) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            e = rows[j][0]
            both = len(sets[i] & sets[j])
            if d is not None and e is not None and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return sorted(((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


def _texts(rng, families, size):
    out = []
    for _ in range(families):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 6, 30, 120]))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 8)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(30)}"
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("words", "percent", "seed"), [(2, 80, 1), (5, 80, 2), (3, 60, 3)])
def test_classes_of_random_families(spark, words, percent, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 300)
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(_texts(rng, 60, 12))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=words, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, words, percent)


def test_odd_rows(spark):
    base = " ".join(f"word{i % 97}x{i}" for i in range(80))
    rows = [(1, base), (2, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, " \n\t "), (7, "..."), (8, "one"), (9, "One"), (None, base), (None, None), (10, "long " * 60_000),
            (11, "日本語 テキスト"), (12, base + "\n" + base), (3, "one"), (13, "É é"), (14, "é É")]
    docs = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], DOC).selectExpr("*", "'q' AS key", "'q' AS home", "'q' AS vertex", "'q' AS kept")
    got = minhash.near_duplicates(docs, words=2)
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 2, 80)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_a_large_family_of_near_copies(spark):
    """20,000 texts from one template, and as many copies of one of them: one class, without a comparison of each pair."""
    base = [f"t{i}" for i in range(60)]
    near = [" ".join([*base[:30], f"name{i}", *base[31:]]) for i in range(20_000)]
    rows = [(i, t) for i, t in enumerate([*near, *near[:1] * 20_000, "something else altogether here"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for found in (minhash.near_duplicates(docs, words=2), jaccard.similar_classes(docs, words=2, find=jaccard._joined)):
        assert {(r.component_id, r["count"]) for r in found.groupBy("component_id").count().collect()} == {(0, 40_000), (40_000, 1)}


def test_thresholds_miss_less_than_asked_for():
    from math import comb

    for percent in (50, 80, 90):
        least, p = minhash.least_matches(percent), percent / 100
        tail = [sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(n)) for n in (least, least + 1)]
        assert tail[0] <= minhash.MISS < tail[1]


def test_matches_of_signatures_follow_the_similarity():
    rng = np.random.default_rng(3)
    for common, own in ((4, 0.5), (80, 10), (800, 100)):
        shares = []
        for _ in range(150):
            a, b, c = (rng.integers(0, 1 << 63, int(n) + (rng.random() < n % 1), dtype=np.uint64) for n in (common, own, own))
            x, y = np.concatenate([a, b]), np.concatenate([a, c])
            shares.append((minhash.signature(x) == minhash.signature(y)).mean() - common / (common + len(b) + len(c)))
        assert abs(np.mean(shares)) < 0.02 and np.std(shares) < 0.07


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_components_of_all_pairs(seed):
    rng = random.Random(seed)
    features = [np.unique(np.array(rng.sample(range(60), rng.randrange(1, 40)), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(80)]
    features += [np.unique(np.concatenate([x[: len(x) - rng.randrange(1 + len(x) // 5)], x[:1] + np.uint64(rng.randrange(3))])) for x in features * 2]
    sizes = np.array([len(x) for x in features])
    signs = [minhash.signature(x).astype(np.uint8).tobytes() for x in features]
    maps = [jaccard.bitmap(x) for x in features]
    apart = lambda i, j: len(np.setxor1d(features[i], features[j]))
    tests = [(forest.Sets(features, 80), lambda i, j, both: 100 * both >= 80 * (sizes[i] + sizes[j] - both), True),
             (forest.Signatures(signs, 30), lambda i, j, both: sum(a == b for a, b in zip(signs[i], signs[j], strict=True)) >= 30, True),
             (forest.Bitmaps(maps, sizes, 80), lambda i, j, both: 180 * apart(i, j) <= 20 * (sizes[i] + sizes[j]), False)]
    for sets, linked, exact in tests:
        label = list(range(len(features)))
        for i, x in enumerate(features):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) and linked(i, j, len(np.intersect1d(x, features[j]))):
                    old, new = label[i], label[j]
                    label = [new if k == old else k for k in label]
        found = list(range(len(features)))
        edges = list(forest.forest(sizes, 80, sets))
        for a, b in edges:
            old, new = found[a], found[b]
            assert old != new  # a forest: no edge within a component
            found = [new if k == old else k for k in found]
        together = lambda x: {(i, j) for i in range(len(x)) for j in range(i) if x[i] == x[j]}
        assert together(found) == together(label) if exact else together(found) >= together(label)
