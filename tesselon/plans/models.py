"""Queries that run dense kernels or build the corpus; without SQL where SQL can't express them."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import cells, corpus, kernels, pca
from ..operators import rates as ra
from ..operators import series as se
from ..operators.sizes import gather
from ..sources.scratch import kept
from .base import PANEL, panel, query, r6, read
from .selection import curve

@query()
def pca_cells(spark, sf_dir):
    """Cells of vectors along the principal axes of all of them."""
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return pca.fit_cells(df, "vec_id", "embedding", 40).select("vec_id", "cell")


@query("""WITH x AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def vector_covariance(spark, sf_dir):
    """Covariances of all vectors' numbers, from which the principal axes come."""
    df = read(spark, sf_dir, "embeddings")
    return pca.covariance(df, "embedding").withColumn("cov", r6("cov"))


@query("""WITH s AS (SELECT 'value' AS part, value AS x FROM events UNION ALL SELECT 'price', l_extendedprice FROM lineitem),
  n AS (SELECT part, count(*) AS n, min(x) AS low, max(x) AS high FROM s GROUP BY part)
  SELECT part, CAST(i AS INTEGER) AS i, n, true AS near, CASE i WHEN 0 THEN low WHEN 16 THEN high END AS bound FROM n, range(17) r(i)""")
def sketch_edges(spark, sf_dir):
    """Edges of 16 bins from sketches of arriving parts, kept as a table and merged; near: an edge's exact rank is within 2 % of its step."""
    parts = []
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("value"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").substr(1, 4).alias("file"), F.col("l_extendedprice").alias("price"))
    for df, column in ((events, "value"), (items, "price")):
        parts.append(cells.edge_sketches(df, [column], ["file"]))
    merged = cells.merge_sketches(kept(parts[0].unionByName(parts[1]), "sketches"))
    edges = kept(cells.sketched_edges(merged, {"value": 16, "price": 16}).join(merged.select("column", "n"), "column"), "edges")
    values = events.select(F.lit("value").alias("column"), F.col("value").alias("x")).unionByName(items.select(F.lit("price").alias("column"), F.col("price").alias("x")))
    below = values.join(F.broadcast(edges), "column").groupBy("column", "i", "edge", "n")  # 34 edges
    ranks = below.agg((F.count_if(F.col("x") < F.col("edge")) / F.col("n")).alias("low"), (F.count_if(F.col("x") <= F.col("edge")) / F.col("n")).alias("high"))
    step = F.col("i") / 16
    near = (F.col("low") <= step + 0.02) & (F.col("high") >= step - 0.02)
    return ranks.select(F.col("column").alias("part"), "i", "n", near.alias("near"), F.when(F.col("i").isin(0, 16), F.col("edge")).alias("bound"))


@query()
def grpo_weights(spark, sf_dir):
    """Weights of cells learned from their rates."""
    rows = gather(ra.rates(curve(spark, sf_dir), "slope"), 1 << 20, "the table of rates")  # a rate for each stage and cell
    bins, iters = sorted({r.bin for r in rows}), sorted({r.iter for r in rows})
    table = np.zeros((len(iters), len(bins)))
    for r in rows:
        table[iters.index(r.iter), bins.index(r.bin)] = r.rate
    found = kernels.learn_weights(table, epochs=4, steps=10, groups=8)
    return spark.createDataFrame([(b, float(w)) for b, w in zip(bins, found, strict=True)], "bin string, w double")


_ITEMS = PANEL + """, items AS (SELECT CAST(user_id % 8 AS INTEGER) AS cell, user_id, count(*) AS n, count(value) AS valid_len FROM panel GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5('42:' || cell || ':' || user_id || ':0:0:0'), user_id) AS rank FROM items WHERE valid_len >= 40),
  h AS (SELECT cell, count(*) AS have FROM r GROUP BY cell),
  m AS (SELECT cell, rank AS pos, user_id, valid_len, n FROM r WHERE rank <= 12
    UNION ALL SELECT r.cell, q.pos, r.user_id, r.valid_len, r.n FROM (SELECT cell, have, unnest(range(have + 1, 13)) AS pos FROM h) q
      JOIN r ON r.cell = q.cell AND r.rank = CAST('0x' || substr(md5('42:' || q.cell || ':' || q.pos), 1, 8) AS BIGINT) % q.have + 1)"""


#: Items with the part of their valid range that a corpus row of k items and 32 values takes.
_PARTS = _ITEMS + """, g AS (SELECT m.*, (pos - 1) // {k} + 1 AS row, (pos - 1) % {k} AS item, user_id % 5 AS start, n - user_id % 3 AS finish FROM m),
  c AS (SELECT *, finish - start AS raw_len, start + CAST('0x' || substr(md5(cell || ':' || user_id || ':0:0:' || row || ':' || item), 1, 8) AS BIGINT)
    % (greatest(0, finish - start - 32 // {k}) + 1) AS crop_start, least(32 // {k}, finish - start) AS crop_len FROM g),
  v AS (SELECT c.*, t - crop_start - 1 AS i, value FROM c JOIN panel p ON p.user_id = c.user_id AND t > crop_start AND t <= crop_start + crop_len),
  z AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d FROM v WINDOW w AS (PARTITION BY cell, row, item)),
  u AS (SELECT *, (value - m) / CASE WHEN d < 1e-6 THEN 1 ELSE d END AS v FROM z)"""


def _corpus(spark, sf_dir, k):
    """Twelve series of each cell, k to a corpus row of 32 values, from valid ranges that begin and end inside the series."""
    df = se.pack(panel(spark, sf_dir), ["user_id"])
    n, user = F.size("values"), F.col("user_id")
    df = df.select(user.alias("file_id"), F.lit(0).alias("n"), F.lit(0).alias("c"), "values", (user % 5).cast("int").alias("start"), (n - user % 3).cast("int").alias("end"))
    valid = F.size(F.filter("values", lambda v: v.isNotNull()))
    usage = df.select((F.col("file_id") % 8).cast("int").alias("cell"), "file_id", "n", "c", F.lit(0).alias("s"), valid.alias("valid_len"))
    manifest = corpus.group_items(corpus.sample_manifest(usage, 12, 40), k).withColumn("item", F.col("item").cast("int"))
    return corpus.materialise(manifest, df, 32)


@query(f"""WITH {_PARTS.format(k=1)} SELECT cell, CAST(row AS INTEGER) AS pos, user_id AS file_id, CAST(start AS INTEGER) AS start, CAST(raw_len AS INTEGER) AS raw_len,
  CAST(crop_start AS INTEGER) AS crop_start, CAST(crop_len AS INTEGER) AS crop_len, CAST(i AS BIGINT) AS i, round(v, 5) AS v FROM u""")
def corpus_rows(spark, sf_dir):
    """The balanced corpus of single series: normalised values with their provenance."""
    df = _corpus(spark, sf_dir, 1).withColumn("x", F.get("items", F.lit(0)))
    df = df.select("cell", "pos", "x.file_id", "x.start", "x.raw_len", "x.crop_start", "x.crop_len", F.posexplode("values").alias("i", "v")).where("i < crop_len")
    return df.withColumn("i", F.col("i").cast("long")).withColumn("v", F.round("v", 5))


@query(f"""WITH {_PARTS.format(k=2)}, s AS (SELECT cell, row, unnest(range(32)) AS p FROM (SELECT DISTINCT cell, row FROM u)),
  f AS (SELECT s.cell, s.row, p, CASE WHEN x.i IS NULL THEN 0 ELSE x.v END AS v FROM s LEFT JOIN u x ON x.cell = s.cell AND x.row = s.row AND x.item = p % 2 AND x.i = p // 2)
  SELECT cell, CAST(row AS INTEGER) AS pos, 2 AS group_size, 16 AS per_seq_len, CAST(p AS BIGINT) AS i,
    round((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w < 1e-6 THEN 1 ELSE stddev_pop(v) OVER w END, 5) AS v FROM f WINDOW w AS (PARTITION BY cell, row)""")
def corpus_groups(spark, sf_dir):
    """Corpus rows of two series, a value of each in turn, normalised before and after."""
    df = _corpus(spark, sf_dir, 2).select("cell", "pos", "group_size", "per_seq_len", F.posexplode("values").alias("i", "v"))
    return df.withColumn("i", F.col("i").cast("long")).withColumn("v", F.round("v", 5))


@query("""SELECT count(*) AS rows, count(*) FILTER (vec_id % 50 = 0) AS bad FROM embeddings""")
def length_audit(spark, sf_dir):
    """Code rows and how many don't have the right length (one in fifty is cut short here)."""
    codes = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), 64 - (F.col("vec_id") % 50 == 0).cast("int")).alias("codes"))
    summary, _ = corpus.audit_lengths(codes, 64)
    return summary.select("rows", "bad")
