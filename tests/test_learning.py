"""Losses, moving moments and draws against numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from tesselon.functions import vectors as v
from tesselon.operators import kernels, learning


def _table(spark, x, key="k"):
    return spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], f"{key} long, e array<double>").repartition(3)


def test_losses(spark):
    rng = np.random.default_rng(1)
    x, book = rng.normal(size=(200, 5)) + 0.5, rng.normal(size=(12, 5))
    assert abs(learning.orthogonality(_table(spark, book)).first()[0] - kernels.orthogonality(book)) < 1e-9
    assert abs(learning.orthogonality(_table(spark, np.eye(4))).first()[0]) < 1e-12
    scores = kernels.unit(x) @ kernels.unit(book).T
    found = learning.diversity(_table(spark, x), _table(spark, book, "code"), 0.5).first()[0]
    assert abs(found - kernels.diversity(scores, 0.5)) < 1e-9
    pairs = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in zip(x[:12], book, strict=True)], "e array<double>, q array<double>")
    assert abs(learning.commitment(pairs).first()[0] - kernels.commitment(x[:12], book)) < 1e-9


def test_moving_moments(spark):
    x = np.random.default_rng(2).normal(size=(50, 3))
    state = spark.createDataFrame([(d, 1.0, 2.0) for d in range(3)], "d int, mean double, var double")
    mean, var = kernels.affine_state(np.ones(3), np.full(3, 2.0), x, 0.8)
    rows = learning.affine_step(_table(spark, x), state, 0.8).orderBy("d").collect()
    assert np.allclose([r.mean for r in rows], mean) and np.allclose([r["var"] for r in rows], var)
    same = learning.affine_step(_table(spark, x).where("false"), state, 0.8).collect()
    assert {(r.d, r.mean, r["var"]) for r in same} == {(d, 1.0, 2.0) for d in range(3)}


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(v.norm("a").alias("n"), v.unit("a").alias("u"), v.distance("a", "b").alias("d"), v.softmax("b").alias("s"), v.entropy(v.softmax("b")).alias("h"), v.divide(F.lit(1.0), v.norm("b")).alias("q")).collect()
    assert (rows[0].n, rows[0].u, rows[0].d, rows[0].s) == (5.0, [0.6, 0.8], 5.0, [0.5, 0.5]) and rows[1].u == [0.0, 0.0]
    assert abs(rows[0].h - math.log(2)) < 1e-12 and rows[0].q == 1e6


def test_draws_of_more_vectors_than_draws(spark, tmp_path):
    import duckdb

    from tesselon.plans import catalog

    spark.range(6000).toDF("vec_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = [tuple(r) for r in catalog.queries()["vector_draws"](spark, str(tmp_path)).select("draw", "vec_id").collect()]
    assert sorted(found) == sorted(con.execute(catalog.oracle_sql()["vector_draws"]).fetchall())
    few = learning.draw_rows(spark.range(30).toDF("k"), ["k"], 40, repeat=False)
    assert sorted(r.k for r in few.collect()) == list(range(30))


def test_draws(spark):
    df = spark.range(30).toDF("k")
    different = learning.draw_rows(df, ["k"], 30).collect()
    assert sorted(r.k for r in different) == list(range(30)) == sorted(r.draw for r in different)
    again = learning.draw_rows(df, ["k"], 3000)
    counts = [r["count"] for r in again.groupBy("k").count().collect()]
    assert len(counts) == 30 and 60 < min(counts) and max(counts) < 150 and again.count() == 3000
    assert learning.draw_rows(df.where("false"), ["k"], 5).count() == 0
    w = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "bin int, w double")
    found = {r.bin: r.n for r in learning.multinomial(w, "bin", 4000).collect()}
    assert sum(found.values()) == 4000 and found[2] == 0 and 850 < found[0] < 1150
    g = learning.group_sample(spark.range(4).toDF("iter"), spark.range(9).toDF("bin"), 50, 40)
    rows = g.collect()
    assert len(rows) == 2000 and all(len({r.stage for r in rows if r.g == k}) == 1 for k in range(50)) and len({r.cell for r in rows}) == 9


def test_noisy_picks_follow_softmax(spark):
    p = np.array([0.1, 0.2, 0.7])
    df = spark.range(4000).toDF("row").crossJoin(spark.createDataFrame([(i, float(np.log(x))) for i, x in enumerate(p)], "i long, logit double"))  # three logits a row
    counts = {r.i: r["count"] for r in learning.gumbel_pick(df, "row", "i", 1.0).groupBy("i").count().collect()}
    assert all(abs(counts[i] / 4000 - p[i]) < 0.03 for i in range(3))
    assert {r.i for r in learning.gumbel_pick(df, "row", "i", 0).collect()} == {2}
    assert {r.i for r in learning.gumbel_pick(df, "row", "i", 50.0, top=2).collect()} == {1, 2}


def test_mixtures(spark):
    rows = [(k, t, None if (k, t) == (0, 3) else float(k * 10 + t * t)) for k in range(4) for t in range(6)]
    series = spark.createDataFrame(rows, "user int, t int, value double")
    found = learning.mixup(series, "user", 300).collect()
    assert {r.mixture for r in found} == set(range(300)) and len(found) == 1800
    z = {}
    for k in range(4):
        x = np.array([np.nan if v is None else v for u, _, v in rows if u == k], float)
        z[k] = (x - np.nanmean(x)) / (np.nanstd(x) + 1e-8)
    by = {(r.mixture, r.t): r.value for r in found}
    single = [m for m in range(300) for k in (1,) if all(abs(by[m, t] - z[k][t]) < 1e-9 for t in range(6))]
    gone = [m for m in range(300) if by[m, 3] is None]
    assert single and gone  # some mixtures are one series; of the one with a gap the gap stays where no other series fills it
    assert learning.mixup(series.where("false"), "user", 5).count() == 0
