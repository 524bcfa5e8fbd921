"""The library's functions in SQL text give what its column builders give."""

import pytest
from pyspark.sql import functions as F

from tesselon.functions import arrays, metrics, sql


@pytest.mark.parametrize("null_val", [None, 2.0])
def test_errors_as_the_metrics(spark, null_val):
    names = sql.register(spark)
    assert set(names) <= {f.name.rpartition(".")[2] for f in spark.catalog.listFunctions()}
    rows = [(1.0, 2.0), (None, 3.0), (4.0, None), (2.5, 0.0), (7.0, 5.0), (None, None), (1.0, 2.00001)]
    df = spark.createDataFrame(rows, "prediction double, target double")
    for name, metric in (("abs_error", metrics.mae), ("square_error", metrics.mse), ("share_error", metrics.mape), ("symmetric_error", metrics.smape)):
        said = spark.sql(f"SELECT coalesce(avg({name}(prediction, target, {'NULL' if null_val is None else null_val})), 0) AS x FROM {{df}}", df=df).first().x
        assert abs(said - df.agg(metric(null_val)).first()[0]) < 1e-12
    plan = spark.sql("SELECT avg(abs_error(prediction, target, NULL)) FROM {df}", df=df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_patches_as_frames(spark):
    sql.register(spark)
    df = spark.createDataFrame([(1, [1.0, 2.0, None, 4.0, 5.0]), (2, [1.0]), (3, []), (4, [1.0, 2.0, 3.0])], "k int, x array<double>")
    said = {r.k: r.p for r in spark.sql("SELECT k, patches(x, 3, 2) AS p FROM {df}", df=df).collect()}
    assert said == {r.k: r.p for r in df.select("k", arrays.frames(F.col("x"), 3, 2).alias("p")).collect()}
