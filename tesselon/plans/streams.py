"""Streams over files that arrive in turn, each held against what one batch over all of them gives."""

from pyspark.sql import functions as F

from ..sources.scratch import folder
from ..streaming import cells, index, states
from .base import query, read
from .cellular import _CELL, CELLS, assigned


@query(f"WITH {_CELL}, c AS (SELECT CAST(unnest(range({CELLS})) AS BIGINT) AS cell) SELECT c.cell, count(a.cell) AS n FROM c LEFT JOIN a ON a.cell = c.cell GROUP BY c.cell")
def stream_cell_counts(spark, sf_dir):
    """Counts of cells from index files that arrive one by one."""
    path = folder(spark, "stream")
    assigned(spark, sf_dir).select("cell").repartition(5).write.parquet(f"{path}/in")
    cells.keep_counts(spark, f"{path}/in", "cell int", f"{path}/counts", f"{path}/state", files=1).awaitTermination()
    found = cells.read_counts(spark, f"{path}/counts")
    return spark.range(CELLS).withColumnRenamed("id", "cell").join(found, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


_DAYS = """d AS (SELECT date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS step, event_type, value, CAST(hour(ts) AS DOUBLE) AS hour FROM events WHERE value IS NOT NULL),
  s AS (SELECT event_type, step, count(*) AS n, sum(value) AS v, sum(hour) AS h FROM d GROUP BY 1, 2), l AS (SELECT max(step) AS last FROM d)"""


@query(f"""WITH {_DAYS} SELECT event_type, round(pow(0.9, last) + sum(0.1 * n * pow(0.9, last - step)), 6) AS size, round(sum(0.1 * v * pow(0.9, last - step)), 4) AS v,
  round(sum(0.1 * h * pow(0.9, last - step)), 4) AS h, pow(0.9, last) + sum(0.1 * n * pow(0.9, last - step)) < 5 AS dead FROM s, l GROUP BY event_type, last""")
def stream_ema(spark, sf_dir):
    """Moving sizes and sums of types of event, days arriving one by one, and which of them have died out."""
    path = folder(spark, "stream")
    df = read(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("step", F.datediff(F.to_date("ts"), F.lit("2023-12-31").cast("date")).cast("long"))
    df = df.select(F.xxhash64("event_type").alias("code"), "event_type", "step", F.array("value", F.hour("ts").cast("double")).alias("e"))
    df.select("code", "step", "e").repartitionByRange(31, "step").sortWithinPartitions("step").write.parquet(f"{path}/in")  # a day in one file, files in order of days
    stream = states.from_files(spark, f"{path}/in", "code long, step long, e array<double>", files=4)
    states.keep(states.moving_sums(stream, 0.9), f"{path}/ema", ["code"], f"{path}/state").awaitTermination()
    last = df.agg(F.max("step")).first()[0]
    now = states.at_step(index.read(spark, f"{path}/ema"), last, 0.9)
    gone = states.dead(now, 5.0).select("code", F.lit(True).alias("dead"))
    rows = now.join(gone, "code", "left").join(df.select("code", "event_type").distinct(), "code")
    part = lambda i: F.round(F.get("total", F.lit(i)), 4)
    return rows.select("event_type", F.round("size", 6).alias("size"), part(0).alias("v"), part(1).alias("h"), F.coalesce("dead", F.lit(False)).alias("dead"))


@query("""WITH b AS (SELECT user_id, event_type AS meter, avg(value * value) AS value, count(value) AS n FROM events GROUP BY 1, 2)
  SELECT meter, CAST(sum(n) AS BIGINT) AS n, round(sum(value * n) / sum(n), 5) AS average, round(sqrt(sum(value * n) / sum(n)), 6) AS rmse FROM b WHERE value IS NOT NULL GROUP BY meter""")
def stream_meters(spark, sf_dir):
    """Meters of squares by type of event, batches of users arriving one by one."""
    path = folder(spark, "stream")
    df = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("meter"))
    df = df.agg(F.avg(F.col("value") * F.col("value")).alias("value"), F.count("value").alias("n")).drop("user_id")
    df.repartition(6).write.parquet(f"{path}/in")
    stream = states.from_files(spark, f"{path}/in", "meter string, value double, n long", files=2)
    states.keep(states.meters(stream), f"{path}/meters", ["meter"], f"{path}/state").awaitTermination()
    found = index.read(spark, f"{path}/meters")
    return found.select("meter", "n", F.round("average", 5).alias("average"), F.round("rmse", 6).alias("rmse"))
