import json

import numpy as np
from pyspark.sql import functions as F

from tesselon.sources import arrays, ranged, sinks
from tesselon.streaming import cells


def test_npy_with_rejects(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(2, 2, 3)
    x[1, 1, 2] = np.nan
    np.save(tmp_path / "good.npy", x)
    np.save(tmp_path / "flat.npy", x.reshape(-1))
    (tmp_path / "broken.npy").write_bytes(b"nothing")
    rows = arrays.read_npy(spark, str(tmp_path)).collect()
    good = {(r.n, r.c): r["values"] for r in rows if r.error is None}
    assert len(good) == 4 and good[1, 1] == [9.0, 10.0, None] and sum(r.error is not None for r in rows) == 2


def test_metric_logs(spark, tmp_path):
    for i in (10, 20, 30):
        np.savez(tmp_path / f"run_{i}.npz", mean_bin=np.array([i, i + 1.0]))
    rows = arrays.read_metric_logs(spark, str(tmp_path), first=10, last=20).collect()
    assert sorted((r.iter, r.bin, r.perf) for r in rows) == [(10, 0, 10.0), (10, 1, 11.0), (20, 0, 20.0), (20, 1, 21.0)]


def test_raw_floats(spark, tmp_path):
    np.arange(12, dtype="<f4").tofile(tmp_path / "x.dat")
    rows = arrays.read_floats(spark, str(tmp_path / "x.dat"), 4).orderBy("row").collect()
    assert [r["values"] for r in rows] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_side_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"past_feat_dynamic_real_valid_indices": [[[1, 5], [0, 2]]]}))
    rows = arrays.read_validity(spark, str(tmp_path / "a.json")).collect()
    assert sorted((r.n, r.c, r.start, r.end) for r in rows) == [(0, 0, 1, 5), (0, 1, 0, 2)]
    df = spark.createDataFrame([(p,) for p in ("d/x_values.npy", "d/x_past_feat_dynamic_real.npy", "d/x.npy")], "p string")
    assert {r[0] for r in df.select(arrays.metadata_path(df.p)).collect()} == {"d/x.json"}
    (tmp_path / "i.csv").write_text("2024-01-01 00:00:00,1.5,2\n2024-01-01 00:10:00,3,4\n")
    assert arrays.read_inference(spark, str(tmp_path / "i.csv"), 2).count() == 4
    (tmp_path / "r.json").write_text(json.dumps({"0": "a", "1": "b"}))
    assert {(r.id, r.path) for r in arrays.read_registry(spark, str(tmp_path / "r.json")).collect()} == {(0, "a"), (1, "b")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(c, p, 10 * c + p, [1.0]) for c in range(3) for p in range(2)], "cell int, pos int, item int, values array<double>")
    sinks.write_cells(df, f"{tmp_path}/cells")
    assert spark.read.parquet(f"{tmp_path}/cells").where("cell = 1").count() == 2
    sinks.write_manifest(df, f"{tmp_path}/manifest")
    assert {r["index"]: [x["item"] for x in r.results] for r in spark.read.json(f"{tmp_path}/manifest").collect()} == {str(c): [10 * c, 10 * c + 1] for c in range(3)}
    sinks.write_corpus(df, f"{tmp_path}/corpus")
    sinks.write_report(df.drop("values"), f"{tmp_path}/report")
    assert ranged.scan_dat(spark, f"{tmp_path}/corpus").count() == ranged.read_dat_meta(spark, f"{tmp_path}/corpus").count() == spark.read.csv(f"{tmp_path}/report", sep="\t", header=True).count() == 6


def test_counts_over_arriving_files(spark, tmp_path):
    source, target, keep = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/keep"
    df = spark.createDataFrame([(1,), (1,), (2,)], "cell int")
    for _ in range(2):
        df.write.mode("append").parquet(source)
        cells.keep_counts(spark, source, df.schema, target, keep).awaitTermination()
    assert {r.cell: r.n for r in cells.read_counts(spark, target).collect()} == {1: 4, 2: 2}


def test_index_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(c, p, 10 * c + p) for c in range(3) for p in range(4)], "cell int, pos int, item int")
    sinks.write_cells(df, f"{tmp_path}/cells")
    places = spark.createDataFrame([(1, 3), (2, 0)], "turn int, at int")
    assert [r.item for r in arrays.read_places(spark, f"{tmp_path}/cells", 1, ["item"], places).collect()] == [13, 10]
    assert arrays.read_cell(spark, f"{tmp_path}/cells", 9).count() == 0
    sinks.write_manifest(df, f"{tmp_path}/manifest")
    assert arrays.read_manifest(spark, f"{tmp_path}/manifest", "2").count() == 1
    sinks.write_registry(spark.createDataFrame([(0, "a"), (1, "b")], "id int, path string"), f"{tmp_path}/registry")
    assert arrays.read_registry(spark, f"{tmp_path}/registry/by_id").count() == 2


def test_walk_and_metadata(spark):
    df = spark.createDataFrame([(p,) for p in ("a/z.npy", "a/b/c.npy", "a/y_data.npy", "b/x.npy")], "path string")
    assert [r.path for r in df.orderBy(*arrays.walk_order(df.path)).collect()] == ["a/y_data.npy", "a/z.npy", "a/b/c.npy", "b/x.npy"]
    side = spark.createDataFrame([("a/z.json",), ("a/y.json",), ("b/x.json",)], "path string")
    found, lost = arrays.find_metadata(df, side)
    assert {(r.path, r.meta) for r in found.collect()} == {("a/z.npy", "a/z.json"), ("a/y_data.npy", "a/y.json"), ("b/x.npy", "b/x.json")}
    assert [r.path for r in lost.collect()] == ["a/b/c.npy"]


def test_codebook_and_types(spark, tmp_path):
    import pytest

    from tesselon import types

    df = spark.createDataFrame([(i, [0.0, float(i)]) for i in range(3)], types.CODEBOOK)
    sinks.write_table(df, f"{tmp_path}/book")
    assert arrays.read_codebook(spark, f"{tmp_path}/book", 3, 2).count() == 3 and not types.violations(df, types.CODEBOOK) and types.violations(df, types.CURVE)
    with pytest.raises(ValueError):
        arrays.read_codebook(spark, f"{tmp_path}/book", 4, 2)
    assert arrays.load_array(b"1,2\n3,4", "x.txt").shape == (2, 2)


def test_ranges_go_by_the_name(spark, tmp_path):
    """The side file of the array's own name has its ranges; else the suffix tells the field; else it is an error."""
    import pytest

    ranges = {"valid_indices": [[[0, 1]]], "past_feat_dynamic_real_valid_indices": [[[0, 2]]], "feat_dynamic_real_valid_indices": [[[0, 3]]]}
    side = spark.createDataFrame([("d/a.json", json.dumps(ranges)), ("d/b.json", json.dumps({"valid_indices": [[[5, 9]]]}))], "path string, value string")
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    found = arrays.resolve_validity(files("d/a.npy", "d/a_past_feat_dynamic_real.npy", "d/a_feat_dynamic_real.npy", "d/a_values.npy", "d/b_data.npy"), side)
    assert {r.path: (r.start, r.end) for r in found.collect()} == {
        "d/a.npy": (0, 1), "d/a_past_feat_dynamic_real.npy": (0, 2), "d/a_feat_dynamic_real.npy": (0, 3), "d/a_values.npy": (0, 1), "d/b_data.npy": (5, 9)}
    with pytest.raises(ValueError, match="no side file"):
        arrays.resolve_validity(files("d/c.npy"), side)
    with pytest.raises(ValueError, match="no valid ranges"):
        arrays.resolve_validity(files("d/b_feat_dynamic_real.npy"), side)


def test_labelled_arrays(spark, tmp_path):
    x = np.arange(24.0).reshape(3, 2, 4)
    np.savez(tmp_path / "test_inputs.npz", x)
    np.savez(tmp_path / "test_labels.npz", np.array([2, 0, 1]))
    rows = {r.row: (r.inputs, r.label) for r in arrays.read_labelled(spark, str(tmp_path), "valid").collect()}
    assert rows == {i: (x[i].reshape(-1).tolist(), [2, 0, 1][i]) for i in range(3)}


def test_settings_and_metrics_by_name(spark):
    import pytest

    from pyspark.sql import functions as F
    from tesselon.functions import metrics as m
    from tesselon.functions import settings as st

    assert st.dataset_name({"DATASET": {"NAME": "a"}}) == "a" and st.dataset_name({}) == "Unknown Dataset" and st.dataset_name({"DATASET": {"x": 1}}) == "Unknown Dataset"
    part = lambda n: {"DATA": {"DATASET": {"NAME": n}}}
    assert st.dataset_name({"TRAIN": part("b"), "VAL": part("b"), "TEST": part("c")}) == "b_c"
    assert st.save_every(6, 3) == 2 and st.save_every([3, 9], 3) == [1, 3] and st.save_every(None, 3) is None
    with pytest.raises(ValueError):
        st.save_every(7, 3)
    m.register("Worst", lambda null_val=None: F.max(F.abs(F.col("prediction") - F.col("target"))))
    df = spark.createDataFrame([(1.0, 4.0), (2.0, None), (5.0, 5.0)], "prediction double, target double")
    assert df.agg(m.resolve("worst", null_val=None, loss=3)).first()[0] == 3.0
    assert df.agg(m.weight(), m.weight(4.0)).first() == (3, 2)
    with pytest.raises(ValueError, match="no metric"):
        m.resolve("nothing")
    del m.METRICS["worst"]


def test_windows_wrap_around(spark):
    from tesselon.operators import patches

    df = spark.createDataFrame([(1, t, float(t)) for t in range(1, 7)] + [(2, 1, 9.0)], "k int, t int, value double")
    rows = {(r.k, r.window): r["values"] for r in patches.attention_windows(df, ["k"], 4, shift=2).collect()}
    assert rows == {(1, 0): [3, 4, 5, 6], (1, 1): [0, 0, 1, 2], (2, 0): [9, 0, 0, 0]}


def test_side_files_are_read_once(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"a{k}.json").write_text(f'{{"valid_indices": [[[0, {k}]]]}}')
    files = spark.createDataFrame([(f"a{k}{kind}.npy",) for k in range(40) for kind in ("", "_values")], "path string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    side = arrays.read_side_files(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("path"), "value")
    found = arrays.resolve_validity(files, side.mapInArrow(counted, side.schema)).collect()
    assert sorted((r.path, r.start, r.end) for r in found) == sorted((f"a{k}{kind}.npy", 0, k) for k in range(40) for kind in ("", "_values"))
    assert seen.value == 40
