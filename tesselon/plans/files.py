"""Sinks and sources: each query writes a table and gives what reading it back gives."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rates as ra
from ..operators import sampling as sa
from ..sources import arrays, offsets, ranged, sinks
from ..sources.scratch import folder, kept
from .base import PANEL, PRED, panel, pred, query, r6, read
from .cellular import _CELL, assigned, book
from .forecast import _ERRORS, _SQL, _errors
from .models import _PARTS, _corpus
from .selection import _CURVE, _RATE, _W, curve, weights


@query(f"WITH {_CELL} SELECT vec_id, label FROM a WHERE cell = 3")
def cell_read(spark, sf_dir):
    """One cell of an index that was written by cell."""
    path = folder(spark, "cells")
    sinks.write_cells(assigned(spark, sf_dir).select("cell", "vec_id", "label"), path)
    return arrays.read_cell(spark, path, 3).select("vec_id", "label")


@query(f"WITH {_CELL}, r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM a WHERE cell = 3) "
       "SELECT turn, vec_id FROM r JOIN (VALUES (1, 4), (2, 0), (3, 4)) p(turn, place) USING (place)")  # fmt: skip
def places_read(spark, sf_dir):
    """Rows of a cell at given places, in their order, one of them twice."""
    path = folder(spark, "cells")
    sinks.write_cells(assigned(spark, sf_dir).select("cell", "vec_id"), path, ["vec_id"])
    places = spark.createDataFrame([(1, 4), (2, 0), (3, 4)], "turn int, at int")
    return arrays.read_places(spark, path, 3, ["vec_id"], places).select("turn", "vec_id")


_SAMPLE = """r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_type || ':' || event_id), event_id) AS pos FROM events)"""


@query(f"WITH {_SAMPLE} SELECT event_type AS cell, event_id FROM r WHERE pos <= 20")
def manifest_read(spark, sf_dir):
    """A manifest of twenty items a cell, written and read again line by line."""
    path = folder(spark, "manifest")
    rows = sa.quota(read(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), "event_id"), "cell", ["event_id"], 20)
    sinks.write_manifest(rows, path)
    return arrays.read_manifest(spark, path).select(F.col("index").alias("cell"), F.explode("results.event_id").alias("event_id"))


@query(f"WITH {_SAMPLE} SELECT event_id FROM r WHERE pos <= 20 AND event_type = 'click'")
def manifest_line(spark, sf_dir):
    """One cell's line of a manifest."""
    path = folder(spark, "manifest")
    rows = sa.quota(read(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), "event_id"), "cell", ["event_id"], 20)
    sinks.write_manifest(rows, path)
    return arrays.read_manifest(spark, path, "click").select(F.explode("results.event_id").alias("event_id"))


_ITEM = """SELECT cell, CAST(row AS INTEGER) AS pos, CAST(item AS INTEGER) AS item, user_id AS file_id, CAST(start AS INTEGER) AS start, CAST(finish AS INTEGER) AS "end",
  CAST(crop_start AS INTEGER) AS crop_start, CAST(crop_len AS INTEGER) AS crop_len FROM c"""
_GROUPS = """s AS (SELECT cell, row, unnest(range(32)) AS p FROM (SELECT DISTINCT cell, row FROM u)),
  f AS (SELECT s.cell, s.row, p, CASE WHEN x.i IS NULL THEN 0 ELSE x.v END AS v FROM s LEFT JOIN u x ON x.cell = s.cell AND x.row = s.row AND x.item = p % 2 AND x.i = p // 2),
  q AS (SELECT cell, row AS pos, p, CAST((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w < 1e-6 THEN 1 ELSE stddev_pop(v) OVER w END AS REAL) AS v
    FROM f WINDOW w AS (PARTITION BY cell, row))"""


@query(f"""WITH {_PARTS.format(k=2)}, {_GROUPS}, o AS ({_ITEM}), t AS (SELECT cell, pos, round(sum(CAST(v AS DOUBLE) * (p + 1)), 3) AS total FROM q GROUP BY cell, pos)
  SELECT o.*, 32 AS size, total FROM o JOIN t USING (cell, pos)""")
def corpus_read(spark, sf_dir):
    """A corpus of groups: where each item came from, and the numbers of its row (their sum, weighted by place)."""
    path = folder(spark, "corpus")
    sinks.write_corpus(_corpus(spark, sf_dir, 2), path)
    meta = ranged.read_dat_meta(spark, path).select("row", "cell", "pos", F.explode("items").alias("x"))
    fields = [F.col(f"x.{c}").cast("int").alias(c) for c in ("item", "start", "end", "crop_start", "crop_len")]
    meta = meta.select("row", "cell", "pos", F.col("x.file_id").alias("file_id"), *fields)
    total = F.aggregate(F.transform("values", lambda v, i: F.coalesce(v.cast("double"), F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    rows = ranged.scan_dat(spark, path).select("row", F.size("values").alias("size"), F.round(total, 3).alias("total"))
    return meta.join(rows, "row").drop("row")


@query(f"""WITH {_PARTS.format(k=2)}, {_GROUPS} SELECT dense_rank() OVER (ORDER BY cell, pos) - 1 AS row, CAST(p AS BIGINT) AS i, round(CAST(v AS DOUBLE), 5) AS v FROM q""")
def dat_corpus(spark, sf_dir):
    """The corpus as one raw file: rows in order, as many as its shape says."""
    path = folder(spark, "corpus")
    ranged.write_dat(_corpus(spark, sf_dir, 2), f"{path}/parts", ["cell", "pos"])
    _, width = ranged.join_dat(spark, f"{path}/parts", f"{path}/corpus.dat")
    rows = ranged.scan_dat(spark, f"{path}/corpus.dat", width, range_bytes=1 << 16).select("row", F.posexplode("values").alias("i", "v"))
    return rows.select("row", F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query(f"""WITH {PANEL}, s AS (SELECT event_type, user_id AS n, CASE WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS c, ts, event_id, value FROM panel)
  SELECT event_type AS name, CAST(n AS INTEGER) AS n, c, row_number() OVER (PARTITION BY event_type, n, c ORDER BY ts, event_id) - 1 AS i,
    round(CAST(CAST(value AS REAL) AS DOUBLE), 4) AS v FROM s""")
def npy_scan(spark, sf_dir):
    """Series of users by type of event, mornings and afternoons, as array files; read back in ranges."""
    path = folder(spark, "series")
    df = panel(spark, sf_dir).withColumn("c", F.when(F.hour("ts") < 12, 0).otherwise(1))
    by = ["event_type", "user_id", "c"]
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    rows = rows.select(F.col("event_type").alias("file"), F.col("user_id").cast("int").alias("n"), "c", F.col("x.value").alias("values"), F.size("x").alias("size"))
    rows = kept(rows, "rows")
    ranged.write_npy(rows.drop("size"), path)
    found = ranged.scan_npy(spark, path, range_bytes=1 << 18).where("error IS NULL").withColumn("name", F.regexp_extract("path", r"(\w+)\.npy$", 1))
    found = found.join(rows.select(F.col("file").alias("name"), "n", "c", "size"), ["name", "n", "c"])  # array files are filled up: series have their lengths beside
    found = found.select("name", "n", "c", F.posexplode(F.slice("values", F.lit(1), F.col("size"))).alias("i", "v"))
    return found.select("name", "n", "c", F.col("i").cast("long").alias("i"), F.round("v", 4).alias("v"))


_FRAMES = """d AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS node, value FROM events),
  k AS (SELECT user_id, day, row_number() OVER (ORDER BY user_id, day) - 1 AS t FROM (SELECT DISTINCT user_id, day FROM d)),
  n AS (SELECT user_id, day, node, count(*) AS n, max(value) AS top FROM d GROUP BY 1, 2, 3)"""


@query(f"""WITH {_FRAMES}, p AS (SELECT k.*, node FROM k, (VALUES (4), (1)) x(node))
  SELECT p.t, p.node, round(CAST(CAST(n.top AS REAL) AS DOUBLE), 4) AS top, CAST(coalesce(n.n, 0) AS DOUBLE) AS n FROM p LEFT JOIN n USING (user_id, day, node)""")
def panel_scan(spark, sf_dir):
    """A panel of days of users as raw frames (5 types of event, 2 features); of it two nodes, features in another order."""
    path, types = folder(spark, "panel"), ["click", "error", "purchase", "signup", "view"]
    df = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    of = lambda t: F.col("event_type") == t
    parts = [x for t in types for x in (F.count_if(of(t)).cast("float"), F.max(F.when(of(t), F.col("value"))).cast("float"))]
    ranged.write_dat(df.groupBy("user_id", "day").agg(F.array(*parts).alias("values")), path, ["user_id", "day"])
    found = ranged.scan_panel(spark, path, 5, 2, pick=[4, 1], of=[1, 0], range_bytes=1 << 16)
    value = lambda i: F.get("values", F.lit(i)).cast("double")
    return found.select("t", "node", F.round(value(0), 4).alias("top"), value(1).alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || event_id), event_id) AS pos FROM events),
  a AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) AS turn FROM events GROUP BY user_id)
  SELECT CAST(turn AS INTEGER) AS turn, user_id, pos - 1 AS i, event_id FROM r JOIN a USING (user_id) WHERE pos <= 5 AND turn <= 10""")
def manifest_offset(spark, sf_dir):
    """Manifest lines of the ten busiest users, in that order, each by its offset."""
    path, events = folder(spark, "manifest"), read(spark, sf_dir, "events").select("user_id", "event_id")
    sinks.write_manifest(sa.quota(events.withColumnRenamed("user_id", "cell"), "cell", ["event_id"], 5), path)
    offsets.write_offsets(spark, path, f"{path}-offsets", F.get_json_object("value", "$.index"), ".json")
    asked = events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(10)
    asked = kept(asked.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("count"), "user_id"))), "asked")  # ten rows
    lines = offsets.read_lines(spark, f"{path}-offsets", asked.select("turn", "user_id", F.col("user_id").cast("string").alias("key")))
    items = F.from_json("value", "struct<results:array<struct<event_id:long>>>")["results"]
    rows = lines.select("turn", "user_id", F.posexplode(items).alias("i", "x"))
    return rows.select("turn", "user_id", F.col("i").cast("long").alias("i"), "x.event_id")


_REGISTRY = "r AS (SELECT c_name AS path, row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) - 1 AS id FROM customer)"


@query(f"WITH {_REGISTRY} SELECT CAST(id AS INTEGER) AS id, path FROM r")
def registry_read(spark, sf_dir):
    """A registry written both ways; ids that agree in both."""
    path = folder(spark, "registry")
    files = read(spark, sf_dir, "customer").withColumn("path", F.col("c_name"))
    sinks.write_registry(sa.registry(files, [F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey")]).select("id", "path"), path)
    back = spark.read.text(f"{path}/by_path").select(F.explode(F.from_json("value", "map<string,int>")).alias("path", "id"))
    return arrays.read_registry(spark, f"{path}/by_id").join(back, ["id", "path"])


@query("SELECT n_nationkey, n_name FROM nation")
def report_read(spark, sf_dir):
    """A tab-separated report."""
    path = folder(spark, "report")
    sinks.write_report(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="n_nationkey int, n_name string")


@query(f"WITH {PANEL}, s AS (SELECT date_trunc('second', ts) AS ts, round(value, 4) AS v FROM panel) SELECT ts, 0 AS node, v FROM s UNION ALL SELECT ts, 1, -v FROM s")
def predictions_read(spark, sf_dir):
    """Predictions of two nodes as CSV, missing ones too, read as input for inference."""
    path = folder(spark, "predictions")
    rows = panel(spark, sf_dir).select(F.date_trunc("second", "ts").alias("ts"), F.round("value", 4).alias("a"))
    sinks.write_predictions(rows.withColumn("b", -F.col("a")), path)
    return arrays.read_inference(spark, path, 2)


@query(f"""WITH {PRED} SELECT CAST('horizon_' || (1 + (t - 1) % 12) AS VARCHAR) AS part, round({_SQL['mae']}, 6) AS mae, round({_SQL['rmse']}, 6) AS rmse FROM pred
    WHERE 1 + (t - 1) % 12 IN (3, 6) GROUP BY 1 UNION ALL SELECT 'overall', round({_SQL['mae']}, 6), round({_SQL['rmse']}, 6) FROM pred""")
def metrics_read(spark, sf_dir):
    """Overall metrics and those of two horizons as one JSON object."""
    from ..functions import metrics as m

    path = folder(spark, "metrics")
    df = pred(spark, sf_dir).withColumn("h", (1 + (F.col("t") - 1) % 12).cast("int"))
    some = [r6(m.resolve(k)).alias(k) for k in ("mae", "rmse")]
    sinks.write_metrics(df.where(F.col("h").isin(3, 6)).groupBy("h").agg(*some).unionByName(df.agg(F.lit(0).alias("h"), *some)), path)
    raw = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<mae:double,rmse:double>>")).alias("part", "v"))
    return raw.select("part", "v.mae", "v.rmse")


@query(f"""WITH {_CURVE}, {_W} SELECT 'rate' AS part, bin AS name, iter, round(greatest({_RATE['slope']}, 1e-8), 6) AS v FROM m
  UNION ALL SELECT 'weight', CAST(bin AS VARCHAR), NULL, round(w, 6) FROM w UNION ALL SELECT 'report', 'w_mean', NULL, round(avg(w), 4) FROM w""")
def rates_read(spark, sf_dir):
    """Rates, weights and the report on them, all read again."""
    path = folder(spark, "rates")
    found = weights(spark, sf_dir)
    sinks.write_rates(ra.rates(curve(spark, sf_dir), "slope"), found, ra.report(found), path)
    none = F.lit(None).cast("int").alias("iter")
    rates = spark.read.parquet(f"{path}/rates").select(F.lit("rate").alias("part"), F.col("bin").alias("name"), "iter", r6("rate").alias("v"))
    held = spark.read.parquet(f"{path}/weights").select(F.lit("weight").alias("part"), F.col("bin").cast("string").alias("name"), none, r6("w").alias("v"))
    report = spark.read.text(f"{path}/report").select(F.from_json("value", "w_mean double").alias("r"))
    report = report.select(F.lit("report").alias("part"), F.lit("w_mean").alias("name"), none, F.round("r.w_mean", 4).alias("v"))
    return rates.unionByName(held).unionByName(report)


@query(f"""WITH {_CURVE}, b AS (SELECT bin, iter, perf, dense_rank() OVER (ORDER BY bin) - 1 AS k FROM c)
  SELECT CAST(iter AS INTEGER) AS iter, CAST(k AS INTEGER) AS bin, round(perf, 4) AS perf FROM b WHERE iter BETWEEN 3 AND 9""")
def metric_logs_read(spark, sf_dir):
    """Validation curves as array files, one an iteration, and those of iterations 3 to 9 read again."""
    path, df = folder(spark, "logs"), curve(spark, sf_dir)
    rows = df.groupBy("iter").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "perf"))), lambda x: x["perf"]).alias("values"))
    sinks.write_npz(rows.select(F.concat(F.lit("run_"), F.col("iter").cast("string")).alias("file"), F.lit("mean_bin").alias("array"), F.lit(0).alias("i"), "values"), path)
    return arrays.read_metric_logs(spark, path, first=3, last=9).select("iter", "bin", F.round("perf", 4).alias("perf"))


@query("""WITH e AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS row, embedding, label FROM embeddings)
  SELECT row, CAST(i AS BIGINT) AS i, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS v, label FROM e, range(64) r(i)""")
def labelled_read(spark, sf_dir):
    """A labelled dataset of arrays of four channels, read again as its test split, channels behind each other."""
    path, df = folder(spark, "labelled"), read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    sinks.write_npz(df.select(F.lit("test_inputs").alias("file"), F.lit("arr_0").alias("array"), F.col("vec_id").alias("i"), F.col("embedding").alias("values")), path, [4, 16])
    labels = df.agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "label"))), lambda x: x["label"].cast("double")).alias("values"))
    sinks.write_npz(labels.select(F.lit("test_labels").alias("file"), F.lit("arr_0").alias("array"), F.lit(0).alias("i"), "values"), path)
    rows = arrays.read_labelled(spark, path, "valid").select("row", F.posexplode("inputs").alias("i", "v"), "label")
    return rows.select("row", F.col("i").cast("long").alias("i"), r6("v").alias("v"), "label")


@query(f"""WITH {PANEL}, u AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM panel GROUP BY user_id), t AS (SELECT unnest(['', '_past_feat_dynamic_real', '_values']) AS kind)
  SELECT 'u' || user_id || kind || '.npy' AS name, 0 AS n, 0 AS c, CASE WHEN kind = '_past_feat_dynamic_real' THEN 1 ELSE 0 END AS start, n - CASE WHEN kind = '' THEN 0 ELSE 1 END AS "end"
    FROM u, t""")
def validity_read(spark, sf_dir):
    """Valid ranges of users' series from side files, by the name of the array: three arrays a user share two side files."""
    path = folder(spark, "validity")
    users = kept(panel(spark, sf_dir).groupBy("user_id").agg(F.count("*").cast("int").alias("n")), "users")
    one = lambda a, b: F.array(F.array(F.array(a, b)))
    fields = F.struct(one(F.lit(0), F.col("n") - 1).alias("valid_indices"), one(F.lit(1), F.col("n") - 1).alias("past_feat_dynamic_real_valid_indices"))
    shared = users.select(F.concat(F.lit("u"), "user_id", F.lit(".json")).alias("name"), F.to_json(fields).alias("value"))
    own = users.select(F.concat(F.lit("u"), "user_id", F.lit("_own.json")).alias("name"), F.to_json(F.struct(one(F.lit(0), F.col("n")).alias("valid_indices"))).alias("value"))
    sinks.write_texts(shared.unionByName(own), path)
    side = arrays.read_side_files(spark, path)
    side = side.select(F.substring_index("path", "/", -1).alias("path"), "value")
    kinds = F.explode(F.array(F.lit("_own"), F.lit("_past_feat_dynamic_real"), F.lit("_values"))).alias("kind")
    found = arrays.resolve_validity(users.select("user_id", kinds).select(F.concat(F.lit("u"), "user_id", "kind", F.lit(".npy")).alias("path")), side)
    return found.select(F.regexp_replace("path", "_own", "").alias("name"), "n", "c", "start", "end")


@query(f"""WITH {PRED}, r AS (SELECT user_id // 64 AS batch, user_id, t, row_number() OVER (PARTITION BY user_id // 64 ORDER BY user_id, t) - 1 AS place FROM pred)
  SELECT batch, user_id, CAST(t AS INTEGER) AS t, row_number() OVER (ORDER BY batch, place) - 1 AS "offset" FROM r""")
def results_read(spark, sf_dir):
    """Test results of batches, each row with its offset in the whole."""
    path = folder(spark, "results")
    rows = pred(spark, sf_dir).withColumn("batch", F.floor(F.col("user_id") / 64))
    rows = rows.select("batch", "user_id", "t", (F.row_number().over(Window.partitionBy("batch").orderBy("user_id", "t")) - 1).cast("long").alias("place"))
    sinks.write_results(rows, path)
    return spark.read.parquet(path).select("batch", "user_id", "t", "offset")


@query("SELECT vec_id AS code, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id < 10")
def codebook_read(spark, sf_dir):
    """A codebook, once it has the codes and dimensions that it should."""
    path = folder(spark, "codebook")
    sinks.write_table(book(spark, sf_dir), path)
    found = arrays.read_codebook(spark, path, 10, 64)
    return found.select("code", F.size("e").cast("long").alias("dims"), r6(F.get("e", F.lit(0)).cast("double")).alias("first"))


@query(f"{_ERRORS} SELECT count(*) AS samples, count(*) FILTER (coalesce(mae > 60, false)) AS bad FROM e")
def validation_read(spark, sf_dir):
    """A validation report: how many samples there are, and those beyond the limit."""
    path = folder(spark, "validation")
    errors = _errors(spark, sf_dir)
    bad = errors.where(~F.coalesce(F.col("mae") <= 60, F.lit(True)))
    sinks.write_validation(errors.agg(F.count("*").alias("samples")), bad, path)
    samples, lost = spark.read.json(f"{path}/summary"), spark.read.schema("mae double").json(f"{path}/bad")
    key = lambda df: df.withColumn("one", F.lit(1))
    return key(samples).join(key(lost.agg(F.count("*").alias("bad"))), "one").drop("one")  # one row each


@query(f"WITH {_CURVE} SELECT bin, iter, round(greatest({_RATE['slope']}, 1e-8), 6) AS rate FROM m")
def table_read(spark, sf_dir):
    """A plain table, as codes, embeddings and rates are kept."""
    path = folder(spark, "table")
    sinks.write_table(ra.rates(curve(spark, sf_dir), "slope").withColumn("rate", r6("rate")), path)
    return spark.read.parquet(path)
