"""Range readers, the raw writer with its commit, and lines by offset."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.sources import offsets, ranged, store


@pytest.fixture
def arrays_at(tmp_path):
    x = np.random.default_rng(1).normal(size=(50, 3, 8)).astype(np.float32)
    x[4, 1, 2] = np.nan
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "deep" / "whole.npy", np.arange(24, dtype=np.int16).reshape(2, 3, 4))
    np.save(tmp_path / "turned.npy", np.asfortranarray(x[:5].astype(np.float64)))
    return tmp_path, x


def test_npy_in_ranges(spark, arrays_at):
    root, x = arrays_at
    df = ranged.scan_npy(spark, str(root), range_bytes=1000)
    assert df.rdd.getNumPartitions() >= 5
    rows = {(r.path.rpartition("/")[2], r.n, r.c): r["values"] for r in df.collect()}
    assert len(rows) == 150 + 6 + 15
    for (name, n, c), v in rows.items():
        want = {"a.npy": x, "turned.npy": x[:5], "whole.npy": np.arange(24).reshape(2, 3, 4)}[name][n, c]
        assert v == [None if np.isnan(w) else float(w) for w in want]


def test_npy_filters_reach_the_reader(spark, arrays_at):
    root, x = arrays_at
    df = ranged.scan_npy(spark, str(root), range_bytes=1000).where((F.col("path") == f"{root}/a.npy") & F.col("n").between(3, 5) & (F.col("c") == 1))
    assert {(r.n, r.c) for r in df.collect()} == {(3, 1), (4, 1), (5, 1)}
    reader = ranged.NpyReader(str(root), 1000)
    left = list(reader.pushFilters([ranged.EqualTo(("path",), f"{root}/a.npy"), ranged.GreaterThan(("n",), 3), ranged.LessThanOrEqual(("n",), 5), ranged.In(("c",), (0, 9)), ranged.EqualTo(("error",), "x")]))
    assert [f.attribute for f in left] == [("error",)]
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert sorted((n, c) for b in read for n, c in zip(b.column("n").to_pylist(), b.column("c").to_pylist(), strict=True)) == [(4, 0), (5, 0)]
    assert {p[0] for r in reader.partitions() for p in r.pieces} == {f"{root}/a.npy"}


def test_npy_rejects_are_rows(spark, tmp_path):
    (tmp_path / "broken.npy").write_bytes(b"nothing")
    (tmp_path / "empty.npy").write_bytes(b"")
    np.save(tmp_path / "flat.npy", np.zeros(9))
    np.save(tmp_path / "words.npy", np.array([[["a"]]]))
    np.save(tmp_path / "short.npy", np.zeros((4, 4, 4)))
    (tmp_path / "short.npy").write_bytes((tmp_path / "short.npy").read_bytes()[:-1])
    np.save(tmp_path / "none.npy", np.zeros((0, 3, 4)))
    rows = ranged.scan_npy(spark, str(tmp_path), range_bytes=100).collect()
    assert sorted(r.path.rpartition("/")[2] for r in rows) == ["broken.npy", "empty.npy", "flat.npy", "short.npy", "words.npy"]
    assert all(r.error and r.n is None and r["values"] is None for r in rows)
    assert ranged.scan_npy(spark, f"{tmp_path}/nowhere").count() == 0


def test_npy_written_with_gaps(spark, tmp_path):
    df = spark.createDataFrame([("x", 2, 1, [1.0, None, 3.0]), ("x", 0, 0, [4.0]), ("y", 0, 0, [5.0, 6.0])], "file string, n int, c int, values array<double>")
    ranged.write_npy(df, str(tmp_path))
    x = np.load(tmp_path / "x.npy")
    assert x.shape == (3, 2, 3) and x[0, 0, 0] == 4 and np.isnan(x[1]).all() and x[2, 1, 2] == 3 and np.isnan(x[2, 1, 1]) and np.isnan(x[0, 0, 1])
    assert np.load(tmp_path / "y.npy").tolist() == [[[5, 6]]] and sorted(p.name for p in tmp_path.iterdir()) == ["x.npy", "y.npy"]


def test_npy_of_a_shuffled_join_is_whole(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("file"), F.floor(F.col("id") / 3).cast("int").alias("n"), F.lit(0).alias("c"), F.array(F.col("id").cast("double")).alias("values"))
    df.repartition(4).write.parquet(f"{tmp_path}/rows")
    # as with large tables: planned as a shuffled join, and the sizes found small when it runs
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ranged.write_npy(spark.read.parquet(f"{tmp_path}/rows"), f"{tmp_path}/npy")
    finally:
        for k in conf:
            spark.conf.unset(k)
    for k in range(3):
        assert np.array_equal(np.load(tmp_path / f"npy/{k}.npy").reshape(-1), np.arange(1000) * 3 + k)


def test_dat_in_order_with_its_shape(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).cast("int").alias("cell"), "id", F.array(F.col("id").cast("float"), F.lit(None).cast("float"), F.lit(0.5).cast("float")).alias("values"))
    path = f"{tmp_path}/c"
    ranged.write_dat(df.repartition(5), path, ["cell", "id"])
    order = sorted((i % 7, i) for i in range(1000))
    assert store.get_json(f"{path}/shape.json")["shape"] == [1000, 3]
    rows = ranged.scan_dat(spark, path, range_bytes=600)
    assert rows.rdd.getNumPartitions() >= 20
    assert [(r.row, r["values"]) for r in rows.orderBy("row").collect()] == [(k, [float(i), None, 0.5]) for k, (_, i) in enumerate(order)]
    assert [(r.row, r.cell, r.id) for r in ranged.read_dat_meta(spark, path).orderBy("row").collect()] == [(k, c, i) for k, (c, i) in enumerate(order)]
    assert [r["values"][0] for r in rows.where("row >= 10 and row < 13").orderBy("row").collect()] == [float(i) for _, i in order[10:13]]
    assert ranged.join_dat(spark, path, f"{tmp_path}/one.dat") == (1000, 3)
    assert np.array_equal(np.fromfile(f"{tmp_path}/one.dat", "<f4").reshape(-1, 3)[:, 0], [i for _, i in order])
    assert ranged.scan_dat(spark, f"{tmp_path}/one.dat", 3, 600).where("row = 999").first()["values"][0] == float(order[-1][1])
    with pytest.raises(Exception, match="written already"):
        ranged.write_dat(df, path, ["cell"], overwrite=False)
    with pytest.raises(Exception, match="different widths|rows of"):
        ranged.write_dat(df.withColumn("values", F.slice("values", F.lit(1), F.col("cell") % 3 + 1)), f"{tmp_path}/bad", ["cell"])
    assert store.size(f"{tmp_path}/bad/shape.json") is None


def test_dat_commit_with_failed_and_repeated_tasks(tmp_path):
    import pyarrow as pa

    batch = lambda low: pa.RecordBatch.from_arrays([pa.array([[float(low + i)] * 2 for i in range(3)], pa.list_(pa.float64())), pa.array([low + i for i in range(3)])], names=["values", "k"])
    writer = ranged.DatWriter(str(tmp_path / "d"), True)

    def failing():
        yield batch(90)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    late = writer.write(iter([batch(10), batch(20)]))
    twice = [writer.write(iter([batch(0)])) for _ in range(2)]  # the task runs again; one of its messages counts
    late.number, twice[1].number = 5, 2
    writer.commit([late, None, twice[1], ranged.Part(3, "none", 0, -1, 0)])
    held = store.get_json(str(tmp_path / "d/shape.json"))
    assert held["shape"] == [9, 2] and [(p["first"], p["rows"]) for p in held["parts"]] == [(0, 3), (3, 6)]
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["data", "meta", "shape.json"] and len(list((tmp_path / "d/data").iterdir())) == 2
    reader = ranged.DatReader({"path": str(tmp_path / "d")})
    assert [v[0] for p in reader.partitions() for b in reader.read(p) for v in b.column("values").to_pylist()] == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    writer = ranged.DatWriter(str(tmp_path / "gone"), True)
    writer.write(iter([batch(0)]))
    writer.abort([])
    assert not list((tmp_path / "gone").iterdir())


def test_an_empty_table_is_an_empty_array(spark, tmp_path):
    ranged.write_dat(spark.createDataFrame([], "k int, values array<float>"), f"{tmp_path}/e", ["k"])
    assert store.get_json(f"{tmp_path}/e/shape.json")["shape"] == [0, 0] and ranged.scan_dat(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("nodes", [4, 40_000])  # small frames are read whole, large ones by runs of nodes
def test_panel_of_some_nodes_and_features(spark, tmp_path, nodes):
    x = np.random.default_rng(2).normal(size=(6, nodes, 2)).astype("<f4")
    x.tofile(tmp_path / "p.dat")
    pick = [3, 0, nodes - 1]
    df = ranged.scan_panel(spark, str(tmp_path / "p.dat"), nodes, 2, pick, [1], range_bytes=8 * nodes)
    assert df.rdd.getNumPartitions() == 6
    assert {(r.t, r.node): r["values"] for r in df.collect()} == {(t, n): [float(x[t, n, 1])] for t in range(6) for n in pick}
    some = df.where("t in (2, 5) and node > 0").collect()
    assert {(r.t, r.node) for r in some} == {(t, n) for t in (2, 5) for n in pick if n}
    whole = ranged.scan_panel(spark, str(tmp_path / "p.dat"), nodes, 2).where("t = 1 and node = 2").collect()
    assert [r["values"] for r in whole] == [[float(v) for v in x[1, 2]]]
    with pytest.raises(Exception, match="outside a frame"):
        ranged.scan_panel(spark, str(tmp_path / "p.dat"), nodes, 2, [nodes]).count()
    with pytest.raises(Exception, match="no file of rows"):
        ranged.scan_panel(spark, str(tmp_path / "p.dat"), nodes, 5).count()


def test_lines_by_offset(spark, tmp_path, monkeypatch):
    lines = [json.dumps({"index": str(i), "results": ["é" * (i % 50)]}, ensure_ascii=False) for i in range(500)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text("\n".join(lines[:300]) + "\n", encoding="utf-8")
    (tmp_path / "m/b.json").write_text("\n".join(lines[300:]), encoding="utf-8")  # no end of line at the end
    (tmp_path / "m/none.json").write_text("")
    path, to = str(tmp_path / "m"), str(tmp_path / "i")
    found = offsets.scan_lines(spark, path, ".json", range_bytes=700)
    assert sorted(r.value for r in found.collect()) == sorted(lines) and found.rdd.getNumPartitions() > 20
    offsets.write_offsets(spark, path, to, F.get_json_object("value", "$.index"), ".json", range_bytes=700)
    wanted = spark.createDataFrame([(1, "499"), (2, "7"), (3, "499"), (4, "x")], "turn int, key string")
    rows = offsets.read_lines(spark, to, wanted).orderBy("turn").collect()
    assert [(r.turn, r.value) for r in rows] == [(1, lines[499]), (2, lines[7]), (3, lines[499])]
    assert sum(r.length for r in rows) == sum(len(lines[i].encode()) for i in (499, 7, 499))
    assert offsets.read_lines(spark, to, wanted.where("false")).count() == 0


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"\n\na\n\n", b"ab\ncd\nef", b"x" * 50 + b"\n" + b"y" * 3])
def test_ranges_find_each_line_once(text):
    import io

    want, at = [], 0
    for line in text.split(b"\n")[: None if not text.endswith(b"\n") else -1]:
        if text:
            want.append((at, line))
        at += len(line) + 1
    for k in (1, 2, 3, 7):
        cuts = [len(text) * i // k for i in range(k + 1)]
        assert [x for a, b in zip(cuts, cuts[1:], strict=False) for x in offsets.lines_of(io.BytesIO(text), a, b)] == want
