"""Cells, codes and vectors."""

from pyspark.sql import functions as F

from ..functions import arrays as a
from ..operators import cells as ce
from ..operators import codes as co
from ..operators import patches as pt
from .base import query, r6, read

DIMS, BINS, CELLS = ["x0", "x1", "x2"], [4, 4, 2], 20


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(DIMS)])


def _bin(i: int) -> str:
    return f"CAST(greatest(0, least({BINS[i]} - 1, len(list_filter(e{i}, lambda b: b <= x{i})) - 1)) AS BIGINT)"


_V = """v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS x2 FROM embeddings),
  e AS (SELECT quantile_cont(x0, [0, 0.25, 0.5, 0.75, 1]) AS e0, quantile_cont(x1, [0, 0.25, 0.5, 0.75, 1]) AS e1, quantile_cont(x2, [0, 0.5, 1]) AS e2 FROM v)"""
_RAW = _V + f", d AS (SELECT vec_id, label, {_bin(0)} AS t0, {_bin(1)} AS t1, {_bin(2)} AS t2 FROM v, e), w AS (SELECT *, t0 + 4 * t1 + 16 * t2 AS raw FROM d)"
_HIST = _RAW + ", h AS (SELECT r AS raw, count(vec_id) AS n FROM range(32) x(r) LEFT JOIN w ON w.raw = r GROUP BY r)"
_TABLE = _HIST + """, acc AS (SELECT raw, n, sum(n) OVER (ORDER BY raw) AS acc, sum(n) OVER () AS total FROM h),
  nx AS (SELECT raw, least(raw + 1, raw + min(CAST(acc * 20 AS BIGINT) // CAST(total AS BIGINT) - raw) OVER (ORDER BY raw)) AS nxt FROM acc),
  tab AS (SELECT raw, CAST(least(coalesce(lag(nxt) OVER (ORDER BY raw), 0), 19) AS INTEGER) AS cell FROM nx)"""
_CELL = _TABLE + ", a AS (SELECT vec_id, label, raw, cell FROM w JOIN tab USING (raw))"
_DIST = _CELL + ", dist AS (SELECT c AS cell, count(vec_id) AS n FROM range(20) x(c) LEFT JOIN a ON a.cell = c GROUP BY c)"


def assigned(spark, sf_dir):
    v = vectors(spark, sf_dir)
    edges, table = ce.fit(v, DIMS, BINS, CELLS)
    return ce.assign(ce.raw_ids(v, DIMS, edges), table)


@query(f"WITH {_V} SELECT 0 AS dim, CAST(unnest(range(5)) AS INTEGER) AS i, round(unnest(e0), 6) AS edge FROM e UNION ALL "
       "SELECT 1, CAST(unnest(range(5)) AS INTEGER), round(unnest(e1), 6) FROM e UNION ALL SELECT 2, CAST(unnest(range(3)) AS INTEGER), round(unnest(e2), 6) FROM e")  # fmt: skip
def quantile_edges(spark, sf_dir):
    edges = ce.quantile_edges(vectors(spark, sf_dir), DIMS, BINS)
    return spark.createDataFrame([(d, i, x) for d, e in enumerate(edges) for i, x in enumerate(e)], "dim int, i int, edge double").withColumn("edge", r6("edge"))


@query(f"WITH {_RAW} SELECT vec_id, CAST(t0 AS INTEGER) AS t0, CAST(t1 AS INTEGER) AS t1, CAST(t2 AS INTEGER) AS t2 FROM d")
def bin_index(spark, sf_dir):
    v = vectors(spark, sf_dir)
    edges = ce.quantile_edges(v, DIMS, BINS)
    return v.select("vec_id", *[a.bin_index(c, e).alias(f"t{i}") for i, (c, e) in enumerate(zip(DIMS, edges, strict=True))])


@query(f"WITH {_RAW} SELECT vec_id, raw FROM w")
def mixed_radix(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return ce.raw_ids(v, DIMS, ce.quantile_edges(v, DIMS, BINS)).select("vec_id", "raw")


@query(f"WITH {_HIST} SELECT raw, n FROM h")
def raw_histogram(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return ce.histogram(ce.raw_ids(v, DIMS, ce.quantile_edges(v, DIMS, BINS)), "raw", 32)


@query(f"WITH {_TABLE} SELECT raw, cell FROM tab")
def merge_table(spark, sf_dir):
    return ce.fit(vectors(spark, sf_dir), DIMS, BINS, CELLS)[1]


@query(f"WITH {_CELL} SELECT vec_id, raw, cell FROM a")
def cell_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("vec_id", "raw", "cell")


@query(f"WITH {_DIST} SELECT cell, n FROM dist")
def cell_distribution(spark, sf_dir):
    return ce.distribution(assigned(spark, sf_dir), CELLS)


@query(f"WITH {_DIST} SELECT cell, n, CAST(row_number() OVER (ORDER BY n DESC, cell) AS INTEGER) AS place FROM dist")
def cells_by_size(spark, sf_dir):
    return ce.by_size(ce.distribution(assigned(spark, sf_dir), CELLS))


@query(f"WITH {_DIST} (SELECT cell, n, 'largest' AS side FROM dist ORDER BY n DESC, cell LIMIT 5) UNION ALL (SELECT cell, n, 'smallest' FROM dist ORDER BY n, cell LIMIT 5)")
def cell_extremes(spark, sf_dir):
    return ce.extremes(ce.distribution(assigned(spark, sf_dir), CELLS), 5)


@query(f"WITH {_DIST} SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 0) AS non_empty, max(n) AS largest, min(n) AS smallest FROM dist")
def cell_summary(spark, sf_dir):
    return ce.summary(ce.distribution(assigned(spark, sf_dir), CELLS))


@query(f"WITH {_CELL} SELECT DISTINCT cell FROM a")
def distinct_cells(spark, sf_dir):
    return assigned(spark, sf_dir).select("cell").distinct()


@query(f"WITH {_CELL} SELECT cell, vec_id, label FROM a WHERE cell BETWEEN 0 AND 9")
def cell_usage(spark, sf_dir):
    """Index rows of the cells in range."""
    return ce.usage(assigned(spark, sf_dir), 10).select("cell", "vec_id", "label")


@query(f"WITH {_CELL} SELECT cell, vec_id FROM a WHERE cell = (SELECT min(cell) FROM a) ORDER BY vec_id LIMIT 3")
def min_cell_preview(spark, sf_dir):
    """First rows of the smallest cell that has any."""
    df = assigned(spark, sf_dir)
    least = df.agg(F.min("cell").alias("cell"))
    return df.join(F.broadcast(least), "cell").orderBy("vec_id").limit(3).select("cell", "vec_id")


#: The ten first vectors are a codebook; codes of a series are labels of vectors.
_BOOK = "book AS (SELECT vec_id AS code, embedding AS e FROM embeddings WHERE vec_id < 10), "
_CODES = """c AS (SELECT vec_id // 20 AS series, CAST((vec_id % 20) // 5 AS INTEGER) AS s, vec_id % 5 AS pos,
  CASE WHEN vec_id % 7 = 0 OR (vec_id % 20) // 5 = 3 THEN NULL ELSE CAST(label AS BIGINT) END AS code FROM embeddings)"""


def book(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("vec_id < 10").select(F.col("vec_id").alias("code"), F.col("embedding").alias("e"))


def codes(spark, sf_dir):
    v = F.col("vec_id")
    s = F.floor((v % 20) / 5).cast("int")
    return read(spark, sf_dir, "embeddings").select(F.floor(v / 20).alias("series"), s.alias("s"), (v % 5).alias("pos"), F.when((v % 7 != 0) & (s != 3), F.col("label").cast("long")).alias("code"))


@query(f"WITH {_BOOK}{_CODES} SELECT series, s, pos, code, round(CAST(e[1] AS DOUBLE), 6) AS first FROM c JOIN book USING (code)")
def code_lookup(spark, sf_dir):
    return co.lookup(codes(spark, sf_dir), book(spark, sf_dir)).select("series", "s", "pos", "code", r6(F.get("e", F.lit(0)).cast("double")).alias("first"))


@query(f"""WITH {_BOOK[:-2]}, sc AS (SELECT vec_id, code, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(e[i] AS DOUBLE)))
    / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x))) AS score FROM embeddings, book),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, code) AS k FROM sc)
  SELECT vec_id, code, round(score, 5) AS score FROM r WHERE k = 1""")
def nearest_code(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    return co.nearest(df, book(spark, sf_dir), "vec_id").withColumn("score", F.round("score", 5))


@query(f"""WITH {_BOOK}{_CODES}, r AS (SELECT series, s, code, row_number() OVER (PARTITION BY series, s ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY series, s) AS n
    FROM c WHERE code IS NOT NULL),
  x AS (SELECT series, s, CASE WHEN n = 1 THEN 1.0 ELSE k / (n - 1) END AS w, unnest(range(64)) AS d, unnest(e) AS x FROM r JOIN book USING (code)),
  g AS (SELECT series, s, d, sum(w * CAST(x AS DOUBLE)) / sum(w) AS v FROM x GROUP BY 1, 2, 3)
  SELECT q.series, q.s, CAST(q.d AS INTEGER) AS d, round(coalesce(v, 0), 6) AS v FROM (SELECT DISTINCT series, s, d FROM c, range(64) t(d)) q LEFT JOIN g USING (series, s, d)""")
def scale_embedding(spark, sf_dir):
    return co.scale_embedding(codes(spark, sf_dir), book(spark, sf_dir), ["series"]).withColumn("v", r6("v"))


@query("""SELECT vec_id, CAST(s AS INTEGER) AS s, CAST(CASE s WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 40 END AS INTEGER) AS size,
  round(CAST(embedding[CASE s WHEN 0 THEN 1 WHEN 1 THEN 9 ELSE 25 END] AS DOUBLE), 6) AS first FROM embeddings, range(3) r(s)""")
def scale_split(spark, sf_dir):
    """An array of codes of three scales, taken apart: here the numbers of a vector."""
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(pt.split_scales("embedding", [8, 16, 40])).alias("x"))
    return df.select("vec_id", "x.s", F.size("x.codes").alias("size"), r6(F.get("x.codes", F.lit(0)).cast("double")).alias("first"))


@query(f"""WITH {_CODES}, u AS (SELECT code, count(*) AS n FROM c WHERE code >= 0 GROUP BY code), p AS (SELECT n / sum(n) OVER () AS p FROM u)
  SELECT round(coalesce(exp(-sum(p * ln(greatest(p, 1e-10)))), 0), 6) AS perplexity FROM p""")
def perplexity(spark, sf_dir):
    return co.perplexity(codes(spark, sf_dir)).select(r6("perplexity").alias("perplexity"))


_NEAR = "lab AS (SELECT vec_id, CAST(label AS BIGINT) AS code, embedding AS e FROM embeddings WHERE label <> 3)"


def _rounds(n: int) -> str:
    """Plain k-means from the first ten vectors: each round's nearest codes, and their means."""
    parts = ["v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)", "c0 AS (SELECT vec_id AS code, e FROM v WHERE vec_id < 10)"]
    for k in range(n):
        score = "-list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))"
        parts.append(f"a{k} AS (SELECT * FROM (SELECT vec_id, v.e, code, row_number() OVER (PARTITION BY vec_id ORDER BY round({score}, 9) DESC, code) AS r FROM v, c{k} c) WHERE r = 1)")
        parts.append(f"m{k} AS (SELECT code, list(m ORDER BY d) AS e FROM (SELECT code, d, avg(x) AS m FROM (SELECT code, unnest(range(64)) AS d, unnest(e) AS x FROM a{k}) GROUP BY 1, 2) GROUP BY code)")
        parts.append(f"c{k + 1} AS (SELECT c.code, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m USING (code))")
    return ", ".join(parts)


@query(f"WITH {_rounds(4)} SELECT code, CAST(unnest(range(64)) AS INTEGER) AS d, round(unnest(e), 5) AS v FROM c4")
def kmeans_fit(spark, sf_dir):
    """A codebook learned in four rounds from all vectors."""
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    found = co.kmeans(df, book(spark, sf_dir), "vec_id", rounds=4, metric="euclid")
    return found.select("code", F.posexplode("e").alias("d", "v")).withColumn("v", F.round("v", 5))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v), r AS (SELECT vec_id, list_reverse(e) AS e, norm FROM n),
  s AS (SELECT r.vec_id, n.vec_id AS code, list_sum(list_transform(range(1, 65), lambda i: r.e[i] * n.e[i])) / greatest(r.norm * n.norm, 1e-12) AS score FROM r, n),
  t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, code) AS k FROM s)
  SELECT vec_id, code, round(score, 5) AS score FROM t WHERE k = 1""")
def nearest_of_many(spark, sf_dir):
    """Each vector turned round, and its nearest among all vectors: a codebook that grows with the table, searched around pivots."""
    df = read(spark, sf_dir, "embeddings")
    turned = df.select("vec_id", F.reverse("embedding").alias("e"))
    codes = df.select(F.col("vec_id").alias("code"), F.col("embedding").alias("e"))
    return co.nearest_by_pivots(turned, codes, "vec_id", pivots=32).withColumn("score", F.round("score", 5))


def _labelled(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("label <> 3").select("vec_id", F.col("label").cast("long").alias("code"), F.col("embedding").alias("e"))


@query(f"""WITH {_BOOK}{_NEAR}, x AS (SELECT code, unnest(range(64)) AS d, CAST(unnest(e) AS DOUBLE) AS x FROM lab), m AS (SELECT code, d, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2),
  o AS (SELECT code, unnest(range(64)) AS d, CAST(unnest(e) AS DOUBLE) AS o FROM book)
  SELECT code, CAST(d AS INTEGER) AS d, round(coalesce(m, o), 6) AS v, coalesce(n, 0) AS n FROM o LEFT JOIN m USING (code, d)""")
def kmeans_update(spark, sf_dir):
    return co.kmeans_step(_labelled(spark, sf_dir), book(spark, sf_dir)).withColumn("v", r6(F.col("v").cast("double")))


@query(f"""WITH {_BOOK}{_NEAR}, x AS (SELECT code, unnest(range(64)) AS d, CAST(unnest(e) AS DOUBLE) AS x FROM lab), m AS (SELECT code, d, sum(x) AS sx, count(*) AS n FROM x GROUP BY 1, 2),
  o AS (SELECT code, unnest(range(64)) AS d, CAST(unnest(e) AS DOUBLE) AS o FROM book),
  r AS (SELECT code, d, CAST(0.97 + coalesce(n, 0) * 0.03 AS DOUBLE) AS size, o * 0.97 + coalesce(sx, 0) * 0.03 AS total FROM o LEFT JOIN m USING (code, d)),
  s AS (SELECT *, sum(size) OVER (PARTITION BY d) AS whole, count(*) OVER (PARTITION BY d) AS k FROM r)
  SELECT code, CAST(d AS INTEGER) AS d, round(size, 6) AS size, round(total, 5) AS total, round(total / ((size + 1e-5) / (whole + k * 1e-5) * whole), 5) AS v FROM s""")
def ema_update(spark, sf_dir):
    state = book(spark, sf_dir).select("code", F.lit(1.0).alias("size"), F.transform("e", lambda x: x.cast("double")).alias("total"))
    df = co.ema_step(_labelled(spark, sf_dir), state, 0.97)
    return df.select("code", "d", r6("size").alias("size"), F.round("total", 5).alias("total"), F.round("v", 5).alias("v"))


@query("""WITH n AS (SELECT CAST(label AS BIGINT) AS code, count(*) AS size FROM embeddings GROUP BY label), q AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY size) AS t FROM n),
  dead AS (SELECT code, row_number() OVER (ORDER BY code) AS k FROM n, q WHERE size < t),
  dr AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS k FROM embeddings)
  SELECT code, vec_id FROM dead JOIN dr USING (k)""")
def dead_codes(spark, sf_dir):
    """Codes of less than median use, and the vectors that replace them."""
    df = read(spark, sf_dir, "embeddings")
    sizes = df.groupBy(F.col("label").cast("long").alias("code")).agg(F.count("*").alias("size"))
    limit = sizes.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)")).first()[0]
    return co.dead_codes(sizes, df, float(limit), "vec_id")


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), v AS (SELECT row_number() OVER (ORDER BY n DESC, label) - 1 AS i, CAST(n AS DOUBLE) AS value FROM n),
  r AS (SELECT i, value, lead(value) OVER (ORDER BY i) / value AS ratio FROM v)
  SELECT round(avg(ratio), 6) AS ratio_mean, round(stddev_pop(ratio), 6) AS ratio_std, round(stddev_pop(ratio) / avg(ratio), 6) AS ratio_cv, round(regr_slope(ln(value), i), 6) AS slope FROM r""")
def spectrum(spark, sf_dir):
    from pyspark.sql.window import Window

    n = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").cast("double").alias("value"))
    rows = n.withColumn("i", F.row_number().over(Window.orderBy(F.col("value").desc(), "label")) - 1)
    out = co.spectrum(rows)
    return out.select(*[r6(c).alias(c) for c in out.columns])
