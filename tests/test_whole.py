"""Queries over whole tables take in every row."""

import duckdb
import pytest

from tesselon.plans import catalog
from tests.test_queries import duck, plain  # noqa: F401  the fixture runs here too

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sf_dir():
    """Tables large enough for ids beyond the cuts of the older queries."""
    return LARGER


def same(spark, sf_dir, duck, name):  # noqa: F811
    """The rows of a query, once they agree with its SQL."""
    df = catalog.queries()[name](spark, sf_dir)
    names = df.columns
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    want = duck.execute(f'SELECT {", ".join(names)} FROM ({catalog.oracle_sql()[name]})').fetchall()
    want = sorted((tuple(plain(v) for v in r) for r in want), key=repr)
    assert len(got) == len(want) and all(str(a) == str(b) or a == pytest.approx(b, abs=2e-4) for a, b in zip(got, want, strict=True))
    return [dict(zip(names, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", ["laplacian", "scaled_laplacian", "message_passing", "transition_matrix", "double_transition"])
def test_graph_of_all_suppliers(spark, sf_dir, duck, name):  # noqa: F811
    rows = same(spark, sf_dir, duck, name)
    suppliers = {r[0] for r in duck.execute("SELECT DISTINCT l_suppkey FROM lineitem").fetchall()}
    assert max(suppliers) >= 50 and suppliers <= {r["src"] for r in rows} | {r["dst"] for r in rows}


def test_series_are_interleaved_whole(spark, sf_dir, duck):  # noqa: F811
    rows = same(spark, sf_dir, duck, "interleave")
    want = duck.execute("SELECT sum(value) FROM events WHERE event_id % 17 <> 0").fetchone()[0]
    assert sum(r["v"] for r in rows) == pytest.approx(want, abs=0.1)


def test_every_window_has_decoder_inputs(spark, sf_dir, duck):  # noqa: F811
    rows = same(spark, sf_dir, duck, "decoder_frames")
    want = duck.execute("SELECT sum(greatest(1, n - 15)) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)").fetchone()[0]
    assert len(rows) == 12 * want


def test_masks_cover_whole_series(spark, sf_dir, duck):  # noqa: F811
    rows = same(spark, sf_dir, duck, "multilevel_mask")
    lengths = dict(duck.execute("SELECT user_id, count(*) FROM events GROUP BY user_id").fetchall())
    assert min(lengths.values()) < 52 < max(lengths.values())
    for u, n in lengths.items():
        frames = sorted(r["w"] for r in rows if r["user_id"] == u)
        assert frames == list(range(len(frames))) and 48 * len(frames) + 4 >= n


@pytest.mark.parametrize("name", ["interleave", "decoder_frames", "multilevel_mask"])
def test_short_and_left_over_series(spark, tmp_path, name):
    """One to 60 points, the last group of one series only."""
    rows = [(u * 1000 + t, u * 7, t, float(u + t), "view") for u, n in enumerate([1, 3, 8, 12, 16, 52, 60]) for t in range(1, n + 1)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s int, value double, event_type string")
    df.selectExpr("event_id", "user_id", "value", "event_type", "timestamp_seconds(s) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert same(spark, str(tmp_path), con, name)


def test_no_row_is_left_out_by_id(spark, sf_dir, duck):  # noqa: F811
    count = lambda sql: duck.execute(sql).fetchone()[0]
    assert len(same(spark, sf_dir, duck, "batch_union")) == count("SELECT count(*) FROM orders")
    assert len(same(spark, sf_dir, duck, "feature_select")) == count("SELECT count(*) FROM events WHERE event_type IN ('click', 'view')")
    finished = count("SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'")
    assert len(same(spark, sf_dir, duck, "missing_outputs")) == count("SELECT count(*) FROM customer") - finished
    errors = {r["event_id"] for r in same(spark, sf_dir, duck, "quota_sample") if r["event_type"] == "error"}
    assert any(e % 10 for e in errors)
