"""Forecast metrics."""

from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import sql
from ..operators import codes as co
from .base import PACKED, PRED, packed, pred, query, r6, read

_V = "target IS NOT NULL"


def _masked(error: str, mask: str = _V) -> str:
    return f"coalesce(sum(CASE WHEN {mask} THEN coalesce({error}, 0) END) / sum(CASE WHEN {mask} THEN 1.0 END), 0)"


_NZ = f"{_V} AND abs(target) > 5e-5"
_SQL = {
    "mae": _masked("abs(prediction - target)"),
    "mse": _masked("(prediction - target) * (prediction - target)"),
    "rmse": "sqrt(" + _masked("(prediction - target) * (prediction - target)") + ")",
    "mape": _masked("abs((prediction - target) / target)", _NZ),
    "smape": _masked("abs(prediction - target) / ((abs(prediction) + abs(target)) / 2)", _NZ),
    "huber": f"""avg(CASE WHEN {_V} THEN CASE WHEN abs(coalesce(prediction, 0) - target) <= 1
        THEN 0.5 * (coalesce(prediction, 0) - target) * (coalesce(prediction, 0) - target)
        ELSE abs(coalesce(prediction, 0) - target) - 0.5 END ELSE 0 END)""",
}


def _one(name):
    def run(spark, sf_dir):
        return pred(spark, sf_dir).agg(r6(m.METRICS[name]()).alias(name))

    run.__name__ = f"masked_{name}"
    query(f"WITH {PRED} SELECT round({_SQL[name]}, 6) AS {name} FROM pred")(run)


for _name in m.METRICS:
    _one(_name)


@query(f"""WITH {PRED}, g AS (SELECT sum(CASE WHEN {_V} THEN abs(coalesce(prediction, 0) - target) ELSE 0 END)
  / (sum(CASE WHEN {_V} THEN abs(target) ELSE 0 END) + 5e-5) AS r FROM pred GROUP BY user_id, event_type)
  SELECT round(avg(r), 6) AS wape FROM g""")
def masked_wape(spark, sf_dir):
    return m.wape(pred(spark, sf_dir), ["user_id", "event_type"]).select(r6("wape").alias("wape"))


@query(f"""WITH {PRED}, z AS (SELECT user_id, event_type, CASE WHEN {_V} THEN coalesce(prediction, 0) ELSE 0 END AS p,
  CASE WHEN {_V} THEN target ELSE 0 END AS q FROM pred),
  g AS (SELECT 1 - sum((q - p) * (q - p)) / (var_pop(q) * count(*) + 5e-5) AS r FROM z GROUP BY user_id, event_type)
  SELECT round(avg(r), 6) AS r2 FROM g""")
def masked_r2(spark, sf_dir):
    return m.r2(pred(spark, sf_dir), ["user_id", "event_type"]).select(r6("r2").alias("r2"))


@query(f"""WITH {PRED}, g AS (SELECT CASE WHEN count(*) = count(prediction + target) AND stddev_pop(prediction) > 0 AND stddev_pop(target) > 0
  THEN corr(prediction, target) ELSE 0 END AS c, count(target) AS n FROM pred GROUP BY user_id, event_type)
  SELECT round(coalesce(sum(c * n) / sum(n), 0), 6) AS corr FROM g""")
def masked_corr(spark, sf_dir):
    return m.corr(pred(spark, sf_dir), ["user_id", "event_type"]).select(r6("corr").alias("corr"))


@query(f"""WITH {PRED} SELECT CAST(1 + (t - 1) % 12 AS INTEGER) AS h, round({_SQL['mae']}, 6) AS mae, round({_SQL['rmse']}, 6) AS rmse,
  round({_SQL['mape']}, 6) AS mape FROM pred WHERE 1 + (t - 1) % 12 IN (3, 6, 12) GROUP BY 1
  UNION ALL SELECT 0, round({_SQL['mae']}, 6), round({_SQL['rmse']}, 6), round({_SQL['mape']}, 6) FROM pred""")
def horizon_metrics(spark, sf_dir):
    """Overall (h = 0) and at chosen horizons."""
    df = pred(spark, sf_dir).withColumn("h", (1 + (F.col("t") - 1) % 12).cast("int"))
    some = [r6(m.METRICS[k]()).alias(k) for k in ("mae", "rmse", "mape")]
    return df.where(F.col("h").isin(3, 6, 12)).groupBy("h").agg(*some).unionByName(df.agg(F.lit(0).alias("h"), *some))


@query(f"""WITH {PRED} SELECT round({_masked('abs(prediction - target)', _V + ' AND abs(target - 10.0) > 5e-5')}, 6) AS mae,
  round({_masked('(prediction - target) * (prediction - target)', _V + ' AND abs(target - 10.0) > 5e-5 + 1e-5 * 10.0')}, 6) AS mse FROM pred""")
def masked_null_value(spark, sf_dir):
    """Metrics with a numeric value that marks missing targets."""
    return pred(spark, sf_dir).agg(r6(m.mae(10.0)).alias("mae"), r6(m.mse(10.0)).alias("mse"))


@query("SELECT round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels")
def accuracy(spark, sf_dir):
    return read(spark, sf_dir, "labels").agg(r6(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("double"))).alias("accuracy"))


_METER = f"WITH {PRED}, b AS (SELECT t, {_SQL['mae']} AS v, count(*) AS n FROM pred GROUP BY t) "


def _meter(spark, sf_dir):
    """A batch for each step, with its weight."""
    return pred(spark, sf_dir).groupBy("t").agg(m.resolve("mae", null_val=None, unused=0).alias("v"), m.weight().alias("n"))


@query(_METER + "SELECT round(coalesce(sum(v * n) / sum(n), 0), 6) AS avg FROM b")
def meter_avg(spark, sf_dir):
    """A running mean over batches, weighted by their sizes."""
    return _meter(spark, sf_dir).agg(r6(F.coalesce(F.sum(F.col("v") * F.col("n")) / F.sum("n"), F.lit(0.0))).alias("avg"))


@query(_METER + "SELECT round(sqrt(coalesce(sum(v * v * n) / sum(n), 0)), 6) AS rmse FROM b")
def meter_rmse(spark, sf_dir):
    return _meter(spark, sf_dir).agg(r6(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n"), F.lit(0.0)))).alias("rmse"))


#: Errors of samples in batches of 64 series.
_ERRORS = f"""WITH {PRED}, s AS (SELECT user_id // 64 AS batch, user_id, count(*) AS n, count(target) AS seen, coalesce(sum(abs(prediction - target)) FILTER (target IS NOT NULL), 0) AS a,
    coalesce(sum((prediction - target) * (prediction - target)) FILTER (target IS NOT NULL), 0) AS q FROM pred GROUP BY 1, 2),
  e AS (SELECT batch, user_id, a / n / (sum(seen) OVER w / sum(n) OVER w) AS mae, q / n / (sum(seen) OVER w / sum(n) OVER w) AS mse FROM s WINDOW w AS (PARTITION BY batch))"""


def _errors(spark, sf_dir):
    return co.reconstruction_error(pred(spark, sf_dir).withColumn("batch", F.floor(F.col("user_id") / 64)), ["user_id"], ["batch"])


@query(f"{_ERRORS} SELECT batch, user_id, round(mae, 6) AS mae, round(mse, 5) AS mse FROM e")
def recon_error(spark, sf_dir):
    """Errors of each sample, by the share of counted targets in its batch."""
    return _errors(spark, sf_dir).select("batch", "user_id", r6("mae").alias("mae"), F.round("mse", 5).alias("mse"))


@query(f"{_ERRORS} SELECT user_id FROM e WHERE coalesce(mae <= 60, true) AND coalesce(mse <= 10000, true)")
def error_filter(spark, sf_dir):
    """Series whose reconstruction errors don't exceed a limit."""
    errors = _errors(spark, sf_dir)
    return errors.where(F.coalesce(F.col("mae") <= 60, F.lit(True)) & F.coalesce(F.col("mse") <= 10000, F.lit(True))).select("user_id")


@query(f"""WITH {PRED} SELECT event_type, count(*) AS whole, count(*) FILTER (target IS NULL OR abs(target - 50) > 5e-5) AS counted FROM pred GROUP BY event_type""")
def metric_weight(spark, sf_dir):
    """How much batches by type of event count in a running mean: all elements, and those that differ from a null value of 50."""
    return pred(spark, sf_dir).groupBy("event_type").agg(m.weight().alias("whole"), m.weight(50.0).alias("counted"))


@query(f"""WITH {PRED} SELECT event_type, round({_SQL['mae']}, 6) AS mae, round({_SQL['rmse']}, 6) AS rmse, round({_SQL['mape']}, 6) AS mape, round({_SQL['smape']}, 6) AS smape FROM pred GROUP BY event_type""")
def sql_metrics(spark, sf_dir):
    """Metrics by type of event as SQL text, with the library's functions."""
    sql.register(spark)
    mean = lambda name: f"coalesce(avg({name}(prediction, target, NULL)), 0)"
    return spark.sql(f"""SELECT event_type, round({mean('abs_error')}, 6) AS mae, round(sqrt({mean('square_error')}), 6) AS rmse,
      round({mean('share_error')}, 6) AS mape, round({mean('symmetric_error')}, 6) AS smape FROM {{df}} GROUP BY event_type""", df=pred(spark, sf_dir))


@query(f"""WITH {PACKED}, f AS (SELECT user_id, values, unnest(range((len(values) - 16) // 8 + 1)) AS i FROM packed WHERE len(values) >= 16)
  SELECT user_id, CAST(i AS INTEGER) AS i, round(list_sum(values[i * 8 + 1 : i * 8 + 16]), 5) AS total, list_count(values[i * 8 + 1 : i * 8 + 16]) AS seen FROM f""")
def sql_patches(spark, sf_dir):
    """Overlapping patches of series as SQL text: their sums, and how many values they have."""
    sql.register(spark)
    return spark.sql("""SELECT user_id, i, round(aggregate(filter(patch, x -> x IS NOT NULL), 0.0D, (a, x) -> a + x), 5) AS total,
      CAST(size(filter(patch, x -> x IS NOT NULL)) AS LONG) AS seen 
      FROM (SELECT user_id, patches(values, 16, 8) AS parts FROM {df}) LATERAL VIEW posexplode(parts) AS i, patch""", df=packed(spark, sf_dir))
