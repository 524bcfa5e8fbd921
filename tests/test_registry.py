"""Registry ids are the row numbers of the order, whatever other columns the rows carry and however they are dealt out."""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselon.operators import sampling
from tesselon.sources import sinks


def _rows(spark, n):
    return spark.range(n).select(F.md5(F.col("id").cast("string")).alias("a"), F.sha1(F.col("id").cast("string")).alias("path"), F.rand(3).alias("x")).repartition(7)


def test_ids_are_row_numbers_with_an_unordered_column(spark):
    got = {r.path: r.id for r in sampling.registry(_rows(spark, 20_000), [F.col("a")], ranges=13).select("path", "id").collect()}
    text = [str(i).encode() for i in range(20_000)]
    order = sorted(text, key=lambda t: hashlib.md5(t).hexdigest())
    assert got == {hashlib.sha1(t).hexdigest(): i for i, t in enumerate(order)}


def test_reading_it_again_gives_the_same_ids(spark):
    found = sampling.registry(_rows(spark, 20_000), [F.col("a").desc()])
    expected = found.withColumn("want", F.row_number().over(Window.orderBy(F.col("a").desc())) - 1)
    assert expected.where("id <> want").count() == 0
    assert found.select("id").distinct().count() == 20_000 and found.select("id").distinct().count() == 20_000


def test_both_files_agree_and_an_empty_table_stays_empty(spark, tmp_path):
    sinks.write_registry(sampling.registry(_rows(spark, 5_000), [F.col("a")]), f"{tmp_path}/r")
    ids = spark.read.text(f"{tmp_path}/r/by_id").select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "path"))
    back = spark.read.text(f"{tmp_path}/r/by_path").select(F.explode(F.from_json("value", "map<string,long>")).alias("path", "id"))
    assert ids.select(F.col("id").cast("long").alias("id"), "path").join(back, ["id", "path"]).count() == 5_000
    assert sampling.registry(_rows(spark, 0), [F.col("a")]).count() == 0


def test_numbers_are_dense_where_all_rows_are_equal(spark):
    same = spark.range(500).select(F.lit("x").alias("a"), F.col("id").alias("k"))
    assert sorted(r.id for r in sampling.registry(same, [F.col("a")]).collect()) == list(range(500))
