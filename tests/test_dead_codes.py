"""Every dead code gets a vector."""

from tesselon.operators import codes


def test_no_dead_code_is_left_out(spark):
    sizes = spark.range(3001).selectExpr("id AS code", "IF(id = 7, 5.0, 0.0) AS size")
    rows = codes.dead_codes(sizes, spark.range(4000).withColumnRenamed("id", "v"), 1.0, "v").collect()
    assert {r.code for r in rows} == set(range(3001)) - {7} and len({r.v for r in rows}) == len(rows) == 3000


def test_few_vectors_are_dealt_again(spark):
    sizes = spark.range(10).selectExpr("id AS code", "0.0 AS size")
    rows = codes.dead_codes(sizes, spark.range(3).withColumnRenamed("id", "v"), 1.0, "v").collect()
    assert sorted(r.code for r in rows) == list(range(10)) and {r.v for r in rows} == {0, 1, 2}
    assert codes.dead_codes(sizes, spark.range(0).withColumnRenamed("id", "v"), 1.0, "v").count() == 0
