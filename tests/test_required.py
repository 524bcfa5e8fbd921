"""Joins that must find a partner: one pass, and an error that names who has none; corpus rows of a batch against one by one."""

import numpy as np
import pyarrow as pa
import pytest

from tesselon.operators import corpus, rates
from tesselon.operators.sizes import required
from tesselon.sources import arrays, sinks


def test_required_in_one_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, x string")
    right = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "k int, y int")
    found = required(left, right, ["k"], "no partner")
    assert sorted((r.k, r.x, r.y) for r in found.collect()) == [(1, "a", None), (1, "c", None), (2, "b", 5)] and found.columns == ["k", "x", "y"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftAnti" not in plan
    with pytest.raises(Exception, match=r'no partner: {"k":3}'):
        required(right, left, ["k"], "no partner").collect()
    assert required(left.where("false"), right, ["k"], "no partner").count() == 0


def test_who_has_no_partner_is_named(spark):
    items = spark.createDataFrame([(7, 1)], "file_id long, n int")
    with pytest.raises(Exception, match='no file: {"file_id":7}'):
        corpus.with_paths(items, spark.createDataFrame([(1, "p")], "id long, path string")).collect()
    with pytest.raises(Exception, match='no codes: {"n":1}'):
        corpus.index_codes(items, spark.createDataFrame([(2, 1)], "n int, code int"), ["n"]).collect()
    with pytest.raises(Exception, match='no rate: {"iter":1,"bin":7}'):
        rates.gather(spark.createDataFrame([(1, 7)], "iter int, bin int"), spark.createDataFrame([(2, 7, 1.0)], "iter int, bin int, rate double")).collect()


def one_by_one(series, size, normalise):
    def scaled(x):
        seen = x[~np.isnan(x)]
        if not len(seen):
            return x
        d = seen.std()
        return (x - seen.mean()) / (d if d >= 1e-6 else 1.0)

    series = [scaled(x) if normalise else np.nan_to_num(x, posinf=0, neginf=0) for x in series]
    k, out = len(series), np.full(size, np.nan if len(series) == 1 else 0.0)
    for i, x in enumerate(series):
        for j, v in enumerate(x[: size // k]):
            out[i + j * k] = v
    return out if k == 1 else scaled(out)


@pytest.mark.parametrize("normalise", [True, False])
def test_corpus_rows_of_a_batch(normalise):
    rng = np.random.default_rng(2)
    rows = [[np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n) * 3 + 5) for n in rng.integers(0, 20, k)] for k in (1, 2, 3, 1, 5, 2)]
    rows += [[np.full(4, 7.0)], [np.full(4, np.nan), np.array([1.0, 2.0])], [np.zeros(0)]]
    parts = pa.array([[[None if np.isnan(v) else v for v in x] for x in r] for r in rows], pa.list_(pa.list_(pa.float64())))
    want = [one_by_one(r, 12, normalise) for r in rows]
    assert np.allclose(corpus.composed(parts, 12, normalise), want, equal_nan=True)
    assert np.allclose(corpus.composed(parts.slice(2, 3), 12, normalise), want[2:5], equal_nan=True)  # a part of a larger batch


def test_places_of_a_large_cell(spark, tmp_path):
    df = spark.range(3000).selectExpr("cast(if(id < 2500, 1, id % 3 + 2) as int) AS cell", "id", "-id AS turned").repartition(6)
    sinks.write_cells(df, f"{tmp_path}/i", ["turned"])
    places = spark.createDataFrame([(1, 2499), (2, 0), (3, 2499), (4, 9999)], "turn int, at int")
    assert [(r.turn, r.id) for r in arrays.read_places(spark, f"{tmp_path}/i", 1, ["turned"], places).collect()] == [(1, 0), (2, 2499), (3, 0)]
    rows = spark.read.parquet(f"{tmp_path}/i").collect()
    for cell in (1, 2, 3, 4):
        own = sorted((r.at, r.turned) for r in rows if r.cell == cell)
        assert [a for a, _ in own] == list(range(len(own))) and [t for _, t in own] == sorted(t for _, t in own)
    assert arrays.read_places(spark, f"{tmp_path}/i", 1, ["turned"], places.where("false")).count() == 0


def test_array_files_with_several_arrays(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, [3.0, 4.0]), ("a", "x", 0, [1.0, None]), ("a", "y", 0, [9.0]), ("b", "x", 0, [5.0])], "file string, array string, i int, values array<double>")
    sinks.write_npz(df, str(tmp_path))
    with np.load(tmp_path / "a.npz") as z:
        assert np.array_equal(z["x"], [[1, np.nan], [3, 4]], equal_nan=True) and z["y"].tolist() == [9]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.npz", "b.npz"]
    sinks.write_texts(spark.createDataFrame([("n.json", '{"é": 1}')], "name string, value string"), f"{tmp_path}/t")
    assert (tmp_path / "t/n.json").read_text(encoding="utf-8") == '{"é": 1}'
