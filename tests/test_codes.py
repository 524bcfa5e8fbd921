"""Nearest codes around pivots and k-means with bounds, against all distances."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.operators import codes


def _table(spark, x, key, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, e array<double>").repartition(parts)


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
@pytest.mark.parametrize("pivots", [1, 12])
def test_pivots_find_what_all_distances_find(spark, monkeypatch, metric, pivots):
    monkeypatch.setattr(codes, "CELL_CODES", 11)
    monkeypatch.setattr(codes, "CELL_VECTORS", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 5)) * 4
    book = np.concatenate([centres[rng.integers(0, 8, 120)] + rng.normal(size=(120, 5)) * 0.3, np.zeros((1, 5)), centres[:3], centres[:3]])  # with repeated codes and one of zeros
    x = np.concatenate([centres[rng.integers(0, 2, 300)] + rng.normal(size=(300, 5)), np.zeros((2, 5)), book[:4]])
    vectors, table = _table(spark, x, "k"), _table(spark, book, "code")
    want = {r.k: (r.code, r.score) for r in codes.nearest(vectors, table, "k", metric).collect()}
    got = {r.k: (r.code, r.score) for r in codes.nearest_by_pivots(vectors, table, "k", metric, pivots).collect()}
    assert len(got) == len(x) and {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert np.allclose([got[k][1] for k in range(len(x))], [want[k][1] for k in range(len(x))], atol=1e-8)
    assert {r.k: r.code for r in codes.nearest(vectors, table, "k", metric, most=50).collect()} == {k: c for k, (c, _) in want.items()}
    assert codes.nearest_by_pivots(vectors.where("false"), table, "k", metric, pivots).count() == 0


def test_what_goes_to_all_pivots_is_sent_in_parts(spark, monkeypatch):
    held, frame = {}, type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, real=frame.mapInArrow: held.update({f.__name__: f}) or real(self, f, *a))
    x = np.random.default_rng(5).normal(size=(30, 4))
    codes.nearest_by_pivots(_table(spark, x, "k"), _table(spark, x, "code"), "k", pivots=30)
    rows = np.tile(x, (100, 1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 4), pa.array(rows.reshape(-1)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), lists, pa.array(np.zeros(len(rows), np.int32)), pa.array(np.full(len(rows), -1.0))], names=["row", "e", "pivot", "score"])
    sizes = [b.num_rows for b in held["elsewhere"](iter([batch]))]  # a score of -1 leaves all pivots but the vector's own
    assert sum(sizes) == 29 * len(rows) and max(sizes) <= 4096


def lloyd(x, book, rounds, metric):
    place = (lambda y: y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)) if metric == "cosine" else lambda y: y
    book = place(book)
    for _ in range(rounds):
        score = place(x) @ book.T if metric == "cosine" else -((x[:, None] - book[None]) ** 2).sum(2)
        at = np.argmax(np.round(score, 9), axis=1)
        book = place(np.stack([x[at == c].mean(0) if (at == c).any() else book[c] for c in range(len(book))]))
    return book


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_bounds_change_no_round(spark, metric):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 4)) * 5
    x = centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 4))
    x = np.concatenate([x, x[:50], np.zeros((1, 4))])
    start = np.concatenate([x[:7], [[900.0, 900, -900, 900]]])  # one that no vector is near to
    for rounds in (1, 2, 9):
        searched = []
        found = codes.kmeans(_table(spark, x, "k"), _table(spark, start, "code"), "k", rounds, metric, searched).orderBy("code").collect()
        assert np.allclose([r.e for r in found], lloyd(x, start, rounds, metric), atol=1e-9)
        assert searched[0] == len(x) and len(searched) == rounds
    assert sum(searched[1:]) < 0.7 * len(x) * 8  # the bounds spare most comparisons
    repeated = _table(spark, x, "k").select(F.lit(1).alias("k"), "e")  # keys that repeat are vectors of their own
    again = codes.kmeans(repeated, _table(spark, start, "code"), "k", 2, metric).orderBy("code").collect()
    assert np.allclose([r.e for r in again], lloyd(x, start, 2, metric), atol=1e-9)


def test_large_codebooks_stay_distributed(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_CODES", 4)
    rng = np.random.default_rng(7)
    x, start = rng.normal(size=(80, 3)), rng.normal(size=(9, 3))
    found = codes.kmeans(_table(spark, x, "k"), _table(spark, start, "code"), "k", 2, "euclid").orderBy("code").collect()
    assert np.allclose([r.e for r in found], lloyd(x, start, 2, "euclid"), atol=1e-9)
    rows = spark.createDataFrame([(1, 0, p, c) for p, c in enumerate([3, None, 5, 99, 1])] + [(2, 0, 0, None), (3, 0, 0, 7), (3, 1, 0, 99)], "k int, s int, pos int, code int")
    far = {(r.k, r.s, r.d): r.v for r in codes.scale_embedding(rows, _table(spark, start, "code"), ["k"]).collect()}
    monkeypatch.setattr(codes, "BROADCAST_CODES", 100)
    near = {(r.k, r.s, r.d): r.v for r in codes.scale_embedding(rows, _table(spark, start, "code"), ["k"]).collect()}
    assert far.keys() == near.keys() and len(far) == 12 and all(abs(far[k] - near[k]) < 1e-12 for k in far)
