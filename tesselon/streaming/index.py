"""A table kept up to date by batches: only the buckets of changed keys are written, each batch once.

The table lies in buckets by hash of its key. A batch rewrites the buckets that its keys fall in, into new
folders, and then replaces one small manifest, which names each bucket's folder and the last batch. A batch
that comes again finds its number there and changes nothing; one that broke off left folders that no manifest
names, and is done again. Readers take the folders of one manifest, so they see whole batches only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Buckets of a table, a parameter of its first batch.
BUCKETS = 64


def _manifest(path: str) -> dict:
    name = f"{path}/manifest.json"
    return store.get_json(name) if store.size(name) is not None else {"batch": -1, "buckets": {}, "count": 0, "schema": "", "old": []}


def bucket_of(keys: list[str], count: int) -> F.Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(count)).cast("int")


def upsert(changed: DataFrame, batch: int, path: str, keys: list[str], buckets: int = BUCKETS) -> bool:
    """Puts rows in place of those with the same keys (or beside the others, if there are none); False if the batch was done before.

    changed: at most one row a key, else an error. Rows of other buckets are neither read nor written."""
    spark, held = changed.sparkSession, _manifest(path)
    if batch <= held["batch"]:
        return False
    count = held["count"] or buckets
    changed = changed.withColumn("bucket_", bucket_of(keys, count)).persist()
    try:
        if changed.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"several rows for one {keys}")
        touched = [r.bucket_ for r in changed.select("bucket_").distinct().collect()]  # BUCKETS at most
        old = [held["buckets"][str(b)] for b in touched if str(b) in held["buckets"]]
        rows = changed
        if old:
            before = spark.read.schema(held["schema"]).parquet(*[f"{path}/{x}" for x in old])
            new = changed.select(*[F.col(k).alias(f"{k}_new") for k in keys])
            stays = before.join(new, reduce(and_, [before[k].eqNullSafe(new[f"{k}_new"]) for k in keys]), "left_anti")
            rows = stays.withColumn("bucket_", bucket_of(keys, count)).unionByName(changed)
        place = f"batch-{batch:012d}"
        rows.repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{path}/{place}")
    finally:
        changed.unpersist()
    for gone in held["old"]:  # what the batch before replaced; what this one does stays for readers of its manifest
        store.drop(f"{path}/{gone}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changed.schema.fields if f.name != "bucket_")
    store.put_json({"batch": batch, "buckets": held["buckets"] | {str(b): f"{place}/bucket_={b}" for b in touched}, "count": count, "schema": held["schema"] or schema, "old": old}, f"{path}/manifest.json")
    return True


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table as of its last whole batch. schema: what an empty table has, before any batch."""
    held = _manifest(path)
    if held["buckets"]:
        return spark.read.schema(held["schema"]).parquet(*[f"{path}/{x}" for x in held["buckets"].values()])
    return spark.createDataFrame([], held["schema"] or schema or "")
