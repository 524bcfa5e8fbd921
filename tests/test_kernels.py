"""Dense kernels and column functions against numpy and against their own laws."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselon.functions import arrays as a
from tesselon.functions import metrics as m
from tesselon.operators import cells, corpus, kernels, patches, sampling


def loop_table(count, target):
    """The merge rule as a plain loop over integers."""
    table, acc, cur, total = [], 0, 0, max(1, sum(count))
    for n in count:
        table.append(cur)
        acc += n
        if cur < target - 1 and acc * target >= (cur + 1) * total:
            cur += 1
    return table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60).filter(any), st.integers(1, 30))
def test_merge_rule(count, target):
    c = np.array(count)
    share = np.cumsum(c) * target // c.sum()
    r = np.arange(len(c))
    after = np.minimum(r + 1, r + np.minimum.accumulate(share - r))
    assert np.minimum(np.concatenate([[0], after[:-1]]), target - 1).tolist() == loop_table(count, target)


def test_merge_table_in_spark(spark):
    count = [3, 0, 0, 9, 1, 4, 0, 2, 2, 7]
    df = spark.createDataFrame(list(enumerate(count)), "raw long, n long")
    assert [r.cell for r in cells.merge_table(df, 6).orderBy("raw").collect()] == loop_table(count, 6)


def test_partition_covers_cells_in_range():
    x = np.random.default_rng(0).normal(size=(500, 8)) * np.arange(8, 0, -1)
    part = kernels.Partition(x, 50)
    found = part.cells(x)
    assert 0 <= found.min() and found.max() <= 49 and np.diff(part.table).max() <= 1 and np.prod(part.bins) >= 50
    assert part.cells(x * 100).max() <= 49  # far outside the edges


def test_greedy_bins():
    assert kernels.allocate_bins(np.array([4.0, 1.0]), 8) == [4, 2]
    assert kernels.allocate_bins(np.array([1.0, 1.0, 1.0]), 5) == [2, 2, 2]  # equals in turn, by number
    assert kernels.allocate_bins(np.array([9.0, 0.0]), 64, most=8) == [8, 8]  # the full one passes its turn
    assert kernels.allocate_bins(np.array([9.0]), 64, most=8) == [8]  # nobody to pass it to
    assert kernels.allocate_bins(np.array([9.0, 8.0, 0.0]), 200, most=3) == [3, 67, 1]  # the second is served in its place though full


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0.01, 9), min_size=1, max_size=6), st.integers(1, 500))
def test_bins_reach_the_target_first(variances, cells):
    variances = sorted(variances, reverse=True)
    bins = kernels.allocate_bins(np.array(variances), cells, most=10**6)
    assert np.prod(bins) >= cells
    # the last bin given was needed, and each dimension was the widest when it got its last one
    widths = [(v / variances[0]) ** 0.5 / b for v, b in zip(variances, bins, strict=True)]
    for v, b in zip(variances, bins, strict=True):
        if b > 1:
            assert (v / variances[0]) ** 0.5 / (b - 1) >= max(widths) - 1e-9
    assert all(b == 1 for b in bins) or any(np.prod(bins) // b * (b - 1) < cells for b in bins if b > 1)


def test_binning_at_the_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 0.5, 1.0, 1.5, 2.0, 9.0)], "z double")
    assert [r[0] for r in df.select(a.bin_index("z", [0.0, 1.0, 2.0])).collect()] == [0, 0, 0, 1, 1, 1, 1]


def test_resizing(spark):
    df = spark.createDataFrame([([float(i) for i in range(n)],) for n in (3, 4, 9, 17)], "v array<double>")
    rows = df.select(a.truncate("v", 4), a.decimate("v", 4), a.pad("v", 4)).collect()
    assert [r[0] for r in rows] == [[0, 1, 2, None], [0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, 3]]
    assert [r[1] for r in rows] == [[0, 1, 2, None], [0, 1, 2, 3], [0, 2, 4, 6], [0, 4, 8, 12]]
    assert [len(r[2]) for r in rows] == [4, 4, 9, 17]


def test_overlap_add_undoes_framing(spark):
    df = spark.createDataFrame([(1, [float(i * i) for i in range(20)])], "k int, values array<double>")
    back = patches.overlap_add(patches.patches(df, 8, 4), ["k"], 4).orderBy("t").collect()
    assert [r.value for r in back] == [float(i * i) for i in range(20)]


def test_pairs_come_back(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert df.select(patches.expand_pairs(patches.merge_pairs("v"), F.lit(3))).first()[0] == [1.0, 2.0, 3.0]


def test_masks_round_half_to_even(spark):
    df = spark.createDataFrame([([True] * 4 + [False] + [True] * 5,)], "m array<boolean>")
    bounds = [int(np.rint(i * 2.5)) for i in range(5)]
    want = [all(([True] * 4 + [False] + [True] * 5)[bounds[i] : bounds[i + 1]]) for i in range(4)]
    assert df.select(a.merge_mask("m", 4)).first()[0] == want


def test_metrics_of_nothing_and_of_missing(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, 1.0, None), (1, 3.0, 1.0), (1, 2.0, 0.0)], "k int, prediction double, target double")
    row = df.agg(m.mae().alias("mae"), m.mse().alias("mse"), m.mape().alias("mape"), m.huber().alias("huber")).first()
    assert row.mae == (0 + 2 + 2) / 3 and row.mse == (0 + 4 + 4) / 3 and row.mape == (0 + 2) / 2 and row.huber == (1.5 + 0 + 1.5 + 1.5) / 4
    empty = df.where("false").agg(*[f().alias(k) for k, f in m.METRICS.items() if k != "huber"]).first()
    assert set(empty.asDict().values()) == {0.0}


def test_quota_is_exact(spark):
    df = spark.createDataFrame([(c, i) for c, n in ((0, 1), (1, 4), (2, 5), (3, 6)) for i in range(n)], "cell int, id int")
    rows = sampling.quota(df, "cell", ["id"], 5).collect()
    assert sorted((r.cell, r.pos) for r in rows) == [(c, p) for c in range(4) for p in range(1, 6)]
    assert len({r.id for r in rows if r.cell == 3}) == 5 and {r.id for r in rows if r.cell == 1} == set(range(4))


def test_audits(spark):
    import pytest

    src, out = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in sampling.missing(src, out, "k").collect()] == [2]
    with pytest.raises(ValueError):
        sampling.require_all(src, out, "k")
    summary, bad = corpus.audit_lengths(spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, None)], "k int, codes array<int>"), 2)
    assert summary.first().bad == 2 and sorted(r.k for r in bad.collect()) == [2, 3]


def test_learned_weights_follow_rates():
    rates = np.tile(np.array([[0.5, 1.0, 2.0, 4.0]]), (3, 1))
    w = kernels.learn_weights(rates, epochs=60, steps=10, groups=16, sample=4, lr=5e-3, log_std=-2.0)
    assert (w > 0).all() and w[0] > w[3]


def test_policy_gradient():
    """Against differences of the surrogate loss, whose advantages stay as they were drawn."""
    rng = np.random.default_rng(5)
    net = {"e": rng.normal(size=(6, 3)), "w1": rng.normal(size=(3, 4)), "b1": rng.normal(size=4), "w2": rng.normal(size=(4, 1)), "b2": rng.normal(size=1), "s": np.array([-1.0])}
    at, noise, explores = rng.integers(6, size=(2, 3, 5)), rng.normal(size=(2, 3, 5)), rng.random((2, 3, 5)) < 0.7
    rate = rng.random((2, 3, 5)) + 0.5

    def mean(p):
        return (np.maximum(p["e"][at] @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"])[..., 0]

    drawn = mean(net) + np.exp(net["s"][0]) * noise * explores
    product = (np.exp(drawn) + 1e-6) * rate
    reward = -((product - product.mean(2, keepdims=True)) ** 2)
    advantage = (reward - reward.mean(2, keepdims=True)) / (reward.std(2, ddof=1, keepdims=True) + 1e-6)
    density = lambda p: -p["s"][0] - 0.5 * ((drawn - mean(p)) / np.exp(p["s"][0])) ** 2
    before = density(net)
    loss = lambda p: -(np.exp(density(p) - before) * advantage * explores).sum() / explores.sum()
    found = kernels.policy_gradient(net, rate, at, noise, explores, 1e-6)
    for k, x in net.items():
        for i in np.ndindex(*x.shape):
            up, down = ({**net, k: x.copy()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - found[k][i]) < 1e-4


def test_weights_by_squares():
    rng = np.random.default_rng(9)
    net = {"e": rng.normal(size=(5, 3)), "w1": rng.normal(size=(3, 4)), "b1": rng.normal(size=4), "w2": rng.normal(size=(4, 1)), "b2": rng.normal(size=1)}
    at, rate, target = rng.integers(5, size=(2, 3, 4)), rng.random((2, 3, 4)) + 0.5, np.array([1.0, 2.0])[:, None, None]

    def loss(p):
        w = np.logaddexp(0, np.maximum(p["e"][at] @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"])[..., 0] + 1e-6
        return ((w * rate - target) ** 2).mean()

    found = kernels.square_gradient(net, rate, at, target, 1e-6)
    for k, x in net.items():
        for i in np.ndindex(*x.shape):
            up, down = ({**net, k: x.copy()} for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - found[k][i]) < 1e-5
    rates = np.tile(np.array([[0.5, 1.0, 2.0, 4.0]]), (3, 1))
    w = kernels.learn_weights(rates, epochs=60, steps=20, groups=8, sample=4, lr=2e-2, target=rates.mean(1))
    assert np.allclose(w * rates[0], rates.mean(), rtol=0.3)


def test_multinomial_and_range_inverse(spark):
    from tesselon.operators import series

    rng = np.random.default_rng(2)
    found = np.array([kernels.multinomial(50, np.array([0.5, 0.0, 0.3, 0.2]), rng) for _ in range(300)])
    assert (found.sum(1) == 50).all() and (found[:, 1] == 0).all() and np.allclose(found.mean(0), [25, 0, 15, 10], atol=1)
    assert kernels.multinomial(7, np.zeros(3), rng).tolist() == [0, 0, 0]
    row = spark.createDataFrame([(0.25, 2.0, 6.0)], "v double, low double, high double").select(series.unrange("v", "low", "high")).first()
    assert row[0] == 3.0


def test_splits_borrow_where_they_are_short(spark):
    from tesselon.operators import series

    df = spark.createDataFrame([(1, t) for t in range(1, 31)] + [(2, t) for t in range(1, 101)], "k int, t int")
    rows = series.split(df, ["k"], 0.1, 0.2, (4, 2)).groupBy("k", "split").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()
    found = {(r.k, r.split): (r.a, r.b) for r in rows}
    assert found[1, "train"] == (1, 21) and found[1, "valid"] == (19, 26) and found[1, "test"] == (25, 30)
    assert found[2, "valid"] == (71, 80) and found[2, "test"] == (81, 100)


def test_frequency_must_be_positive(spark):
    import pytest

    from tesselon.functions import time as tm

    df = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS a, timestamp '2024-01-01 00:05:30' AS b")
    assert df.select(tm.frequency_minutes(F.col("a"), F.col("b"))).first()[0] == 5
    with pytest.raises(Exception, match="a minute apart"):
        df.select(tm.require_frequency(F.col("b"), F.col("a"))).collect()
    assert df.select(tm.frequency_minutes(F.col("b"), F.col("a"))).first()[0] is None


def test_mixing_and_picking():
    rng = np.random.default_rng(1)
    x = kernels.mix_series([np.array([1.0, 2.0, np.nan]), np.array([3.0, 1.0, np.nan])], rng)
    assert np.isnan(x[2]) and np.isfinite(x[:2]).all()
    assert kernels.gumbel_pick(np.array([[0.0, 9.0, 1.0]]), 0, rng).tolist() == [1]
    assert len(kernels.sample_vectors(np.zeros((3, 2)), 7)) == 7


def test_codes_of_series(spark):
    rng = np.random.default_rng(3)
    coder = kernels.Patches(rng.normal(size=(16, 32)))
    x = rng.normal(size=4096)
    x[40] = np.nan
    found = coder.codes(x)
    assert len(found) == 734 and np.isnan(found[-255:]).sum() == 2 and np.nanmax(found) < 16
    df = spark.createDataFrame([(1, [None if np.isnan(v) else float(v) for v in x])], "k int, values array<double>")
    codes = kernels.encode_series(df, coder, ["k"]).first().codes
    assert codes == [None if np.isnan(c) else int(c) for c in found]
    assert spark.createDataFrame([(codes,)], "c array<int>").select(patches.valid_length("c", 255, 16)).first()[0] == 16 * 253


def test_losses():
    assert abs(kernels.orthogonality(np.eye(4))) < 1e-12 and kernels.orthogonality(np.ones((4, 4))) > 0.5
    assert kernels.diversity(np.eye(4) * 50) < kernels.diversity(np.tile([50.0, 0, 0, 0], (4, 1)))
    a = np.random.default_rng(0).normal(size=(5, 3))
    assert np.allclose(np.diag(kernels.distances(a, a)), 0, atol=1e-6) and kernels.commitment(a, a) == 0


def test_learning_a_codebook(spark):
    """The rounds of a plain loop over numpy arrays."""
    from tesselon.operators import codes

    rng = np.random.default_rng(4)
    x, book = rng.normal(size=(60, 5)), rng.normal(size=(4, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, e array<double>")
    found = codes.kmeans(df, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "code long, e array<double>"), "k", rounds=3)
    for _ in range(3):
        best = (kernels.unit(x) @ kernels.unit(book).T).argmax(1)
        book = kernels.unit(np.stack([x[best == c].mean(0) if (best == c).any() else book[c] for c in range(4)]))
    assert np.allclose([r.e for r in found.orderBy("code").collect()], book)
    w, b = rng.normal(size=(3, 5)), rng.normal(size=3)
    got = {r.k: r.e for r in codes.project(df, "k", w, b).collect()}
    assert np.allclose([got[i] for i in range(60)], kernels.unit(x @ w.T + b))


def test_moving_moments_and_draws():
    rng = np.random.default_rng(6)
    batch = rng.normal(size=(9, 3))
    mean, var = kernels.affine_state(np.zeros(3), np.ones(3), batch, 0.9)
    assert np.allclose(mean, 0.1 * batch.mean(0)) and np.allclose(var, 0.9 + 0.1 * ((batch - batch.mean(0)) ** 2).mean(0))
    stage, cell = kernels.group_sample(3, 5, 400, 7, 1)
    assert stage.shape == (400,) and cell.shape == (400, 7) and set(stage) == {0, 1, 2} and set(cell.ravel()) == set(range(5))
    series = np.vstack([np.arange(4.0), [np.nan, 1, 2, 3], [np.nan] * 4])
    out = kernels.mixup(series[:2], rng)
    assert out.shape == (4,) and np.isfinite(out[1:]).all()


def test_paths_by_rule(spark):
    import pytest

    from tesselon.functions import paths

    df = spark.createDataFrame([("/a/data/x/y_codebook.npz",), ("lonely",)], "p string")
    assert [r[0] for r in df.select(paths.parent_key(F.col("p"))).collect()] == ["x", "lonely"]
    assert df.where("p <> 'lonely'").select(paths.array_path(F.col("p"), "/new/", "/data/")).first()[0] == "/new/x/y.npy"
    with pytest.raises(Exception, match="lonely"):
        df.select(paths.array_path(F.col("p"), "/new", "/data/")).collect()
