"""Tables kept by batches, and streams with state against the whole at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.sources import store
from tesselon.streaming import cells, index, states


def _rows(spark, path):
    return {r.k: r.v for r in index.read(spark, path).collect()}


def test_upsert_by_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    assert index.read(spark, path, "k int, v string").count() == 0
    assert index.upsert(df(*[(i, f"a{i}") for i in range(100)], (None, "none")), 0, path, ["k"], buckets=8)
    before = store.get_json(f"{path}/manifest.json")["buckets"]
    assert index.upsert(df((3, "b3"), (200, "new"), (None, "now")), 4, path, ["k"])
    after = store.get_json(f"{path}/manifest.json")["buckets"]
    want = {i: f"a{i}" for i in range(100)} | {3: "b3", 200: "new", None: "now"}
    assert _rows(spark, path) == want and index.read(spark, path).count() == 102
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3  # other buckets are left alone
    for again in (4, 2):  # batches that come again
        assert not index.upsert(df((3, "worse"), (5, "worse")), again, path, ["k"])
    assert _rows(spark, path) == want
    changed = df((5, "c5"))
    changed.withColumn("bucket_", F.lit(1)).write.partitionBy("bucket_").parquet(f"{path}/batch-{5:012d}")  # a batch that broke off before its manifest
    assert _rows(spark, path) == want and index.upsert(changed, 5, path, ["k"])
    assert _rows(spark, path) == want | {5: "c5"}
    with pytest.raises(ValueError, match="several rows"):
        index.upsert(df((1, "x"), (1, "y")), 6, path, ["k"])
    assert _rows(spark, path) == want | {5: "c5"}
    assert index.upsert(df((1, "x")).where("false"), 7, path, ["k"]) and _rows(spark, path) == want | {5: "c5"}


def test_counts_grow_with_new_files_and_replays_change_nothing(spark, tmp_path):
    source, target, keep = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/keep"
    cell = lambda *x: spark.createDataFrame([(c,) for c in x], "cell int").coalesce(1)
    run = lambda: cells.keep_counts(spark, source, "cell int", target, keep, files=1).awaitTermination()
    cell(1, 1, 2).write.parquet(source)
    cell(2, 3).write.mode("append").parquet(source)
    run()
    run()
    assert {r.cell: r.n for r in cells.read_counts(spark, target).collect()} == {1: 2, 2: 2, 3: 1}
    cell(3, 9).write.mode("append").parquet(source)
    run()
    assert {r.cell: r.n for r in cells.read_counts(spark, target).collect()} == {1: 2, 2: 2, 3: 2, 9: 1}


def test_moving_sums_whatever_way_steps_come(spark, tmp_path):
    rng = np.random.default_rng(1)
    steps = [(int(rng.integers(0, 4)), int(rng.integers(1, 9)), [float(v) for v in rng.normal(size=2)]) for _ in range(200)]
    rows = [r for r in steps if r[0] != 2 or r[1] < 3]  # code 2 isn't seen any more
    size, total = {c: 1.0 for c in range(4)}, {c: np.zeros(2) for c in range(4)}
    for s in range(1, 9):
        for c in range(4):
            own = [np.array(e) for k, t, e in rows if (k, t) == (c, s)]
            size[c] = 0.9 * size[c] + 0.1 * len(own)
            total[c] = 0.9 * total[c] + 0.1 * sum(own, np.zeros(2))
    schema = "code long, step long, e array<double>"
    for name, parts in (("order", sorted(rows, key=lambda r: r[1])), ("mixed", rows)):
        source, target = f"{tmp_path}/{name}", f"{tmp_path}/{name}-out"
        for at in range(0, len(parts), 45):
            spark.createDataFrame([*parts[at : at + 45], (None, 1, [1.0, 1.0]), (1, 1, None)], schema).coalesce(1).write.mode("append").parquet(source)
            stream = states.from_files(spark, source, schema)
            states.keep(states.moving_sums(stream, 0.9), target, ["code"], f"{tmp_path}/{name}-state").awaitTermination()
        now = {r.code: r for r in states.at_step(index.read(spark, target), 8, 0.9).collect()}
        assert set(now) == set(range(4))
        for c in range(4):
            assert abs(now[c]["size"] - size[c]) < 1e-9 and np.allclose(now[c].total, total[c])
    gone = states.dead(states.at_step(index.read(spark, target), 8, 0.9), (size[2] + min(size[c] for c in (0, 1, 3))) / 2)
    assert [r.code for r in gone.collect()] == [2]


def test_meters(spark, tmp_path):
    rows = [("a", 4.0, 1), ("a", 1.0, 2), ("b", None, 3), ("c", 5.0, 0), (None, 2.0, 1)]
    for r in rows:
        spark.createDataFrame([r], "meter string, value double, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = states.from_files(spark, f"{tmp_path}/in", "meter string, value double, n long")
    states.keep(states.meters(stream), f"{tmp_path}/out", ["meter"], f"{tmp_path}/state").awaitTermination()
    got = {r.meter: (r.n, r.average, round(r.rmse, 6)) for r in index.read(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (3, 2.0, round(2**0.5, 6)), "c": (0, 0.0, 0.0), None: (1, 2.0, round(2**0.5, 6))}
