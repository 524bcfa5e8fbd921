"""Decontamination finds every overlap that meets the stated criterion, and nothing else."""

import itertools
import random

from tesselon.llm import decontaminate


def minimal(size):
    """Arrangements of just enough matches over size words, as numbers."""
    least = max(8, -(-7 * size // 10))
    for gone in itertools.combinations(range(size), size - least):
        yield (1 << size) - 1 - sum(1 << i for i in gone)


def test_every_arrangement_holds_a_mask():
    masks = [sum(1 << p for p in m) for m in decontaminate.MASKS]
    for size in range(8, decontaminate.LONGEST + 1):
        assert all(any(x >> s & m == m for m in masks for s in range(size)) for x in minimal(size))


def qualifies(same, least):
    """Whether a segment of the diagonal has enough matches and 7 in 10."""
    sums = [0, *itertools.accumulate(same)]
    return any(sums[j] - sums[i] >= least and 10 * (sums[j] - sums[i]) >= 7 * (j - i) for i in range(len(same)) for j in range(i + 1, len(same) + 1))


def cases(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([4, 6, 8, 9, 11, 15, 15, 20, 30, 59])}
    docs = {0: [w if c == "1" else word() for w, c in zip(items[4], "11011011011", strict=True)],
            1: [w if c == "1" else word() for w, c in zip(items[5], "111111100011111", strict=True)]}
    for d in range(2, 400):
        part = items[rng.randrange(10)]
        part = part[rng.randrange(max(1, len(part) - 8)) :]
        for k in rng.sample(range(len(part)), min(len(part), rng.randint(0, 1 + len(part) * 4 // 10))):
            part = [*part[:k], word(), *part[k + 1 :]]
        docs[d] = [word() for _ in range(rng.choice([0, 0, 3, 20]))] + part + [word() for _ in range(rng.choice([0, 0, 3, 20]))]
    want = set()
    for d, ws in docs.items():
        for i, q in items.items():
            for g in range(1 - len(q), len(ws)):
                places = range(max(0, -g), min(len(q), len(ws) - g))
                if qualifies([ws[p + g] == q[p] for p in places], min(8, len(q))):
                    want.add((d, i, g))
    return docs, items, want


def test_same_as_brute_force(spark):
    docs, items, want = cases()
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows = decontaminate.overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.doc_start - r.item_start) for r in rows} == want and len(rows) == len(want)
    assert {(0, 4, 0), (1, 5, 0)} <= want
    for r in rows:
        same = [docs[r.doc_id][r.doc_start + k] == items[r.item_id][r.item_start + k] for k in range(r.words)]
        assert sum(same) == r.matches >= min(8, len(items[r.item_id])) and 10 * r.matches >= 7 * r.words


def test_an_item_of_one_word_takes_every_document_with_it(spark):
    docs = spark.createDataFrame([(1, "the Word stands here"), (2, "words stand here"), (3, None), (4, "word")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word"), (2, None), (3, " ")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [2, 3]
