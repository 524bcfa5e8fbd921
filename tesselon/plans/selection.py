"""Registries, audits, sampling, rates, weights and graphs."""

from pyspark.sql import functions as F

from ..functions import paths as pa
from ..operators import corpus as co
from ..operators import graph as gr
from ..operators import rates as ra
from ..operators import sampling as sa
from ..operators import series as se
from ..operators.codes import reconstruction_error
from .base import PANEL, PRED, packed, panel, pred, query, r6, read


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) - 1 AS id FROM customer")
def file_registry(spark, sf_dir):
    """Dense ids in a stable order: segments stand for folders, names for files."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return sa.registry(df, [F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey")]).select("c_custkey", "c_name", F.col("id").cast("long").alias("id"))


@query("SELECT n_nationkey, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def registry_check(spark, sf_dir):
    """Counts by nation, once every customer's nation is known to exist."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey")
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    sa.require_all(rows, nation, "n_nationkey")
    return rows.join(nation, "n_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("customers"))


@query("""SELECT page_id, '/data/' || ltrim(regexp_replace(url, '^https?://[^/]*', ''), '/') AS path,
  CASE WHEN len(string_split(url, '/')) > 1 THEN string_split(url, '/')[-2] ELSE url END AS parent FROM pages WHERE NOT lower(url) LIKE '%label%'""")
def path_remap(spark, sf_dir):
    """Paths below another root and the folder that each file is in; names with 'label' are left out."""
    df = read(spark, sf_dir, "pages").where(~F.lower("url").contains("label"))
    inner = F.regexp_replace("url", "^https?://[^/]*", "|")
    return df.select("page_id", pa.array_path(inner, "/data", "|").alias("path"), pa.parent_key(F.col("url")).alias("parent"))


_QUOTA = """r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_type || ':' || event_id), event_id) AS rank,
  count(*) OVER (PARTITION BY event_type) AS have FROM events)"""


@query(f"""WITH {_QUOTA} SELECT event_type, event_id, CAST(rank AS INTEGER) AS pos FROM r WHERE rank <= 300
  UNION ALL SELECT r.event_type, r.event_id, CAST(pos AS INTEGER) FROM r JOIN (SELECT event_type, have, unnest(range(have + 1, 301)) AS pos FROM (SELECT DISTINCT event_type, have FROM r)) m
    ON m.event_type = r.event_type AND r.rank = CAST('0x' || substr(md5('42:' || m.event_type || ':' || pos), 1, 8) AS BIGINT) % m.have + 1""")
def quota_sample(spark, sf_dir):
    """Exactly 300 events of every type, repeated where a type has fewer."""
    df = read(spark, sf_dir, "events").select("event_type", "event_id")
    return sa.quota(df, "event_type", ["event_id"], 300)


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_type || ':' || event_id), event_id) AS k FROM events) WHERE k <= 20")
def cell_sample(spark, sf_dir):
    return sa.cell_sample(read(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"], 20)


@query("SELECT event_id FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 50")
def random_subset(spark, sf_dir):
    """Fifty events for validation."""
    return sa.subset(read(spark, sf_dir, "events").select("event_id"), ["event_id"], 50, 7)


@query(f"""WITH {PANEL}, n AS (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id),
  c AS (SELECT user_id, CAST(CAST('0x' || substr(md5((user_id % 10) || ':' || user_id), 1, 8) AS BIGINT) % (greatest(0, n - 24) + 1) AS INTEGER) AS crop_start, CAST(least(24, n) AS INTEGER) AS crop_len FROM n)
  SELECT c.user_id, crop_start, crop_len, round(sum(value), 6) AS total FROM c JOIN panel ON panel.user_id = c.user_id AND t > crop_start AND t <= crop_start + 24 GROUP BY 1, 2, 3""")
def random_crop(spark, sf_dir):
    """A range of at most 24 points of each series; the seed is its cell."""
    df = packed(spark, sf_dir).withColumn("cell", F.col("user_id") % 10)
    df = sa.crop(df, 24, "cell", "user_id")
    some = F.filter(F.slice("values", F.col("crop_start") + 1, F.col("crop_len")), lambda v: v.isNotNull())
    return df.select("user_id", "crop_start", "crop_len", r6(F.aggregate(some, F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query(f"""WITH {PANEL}, o AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS o FROM (SELECT DISTINCT user_id FROM panel)),
  p AS (SELECT o // 3 AS g, o % 3 AS j, t - 1 AS i, coalesce(value, 0) AS value FROM panel JOIN o USING (user_id)),
  k AS (SELECT g, max(j) + 1 AS k, max(i) + 1 AS n FROM p GROUP BY g), f AS (SELECT g, k, unnest(range(k * n)) AS x FROM k)
  SELECT f.g, CAST(x AS BIGINT) AS i, round(coalesce(value, 0), 6) AS v FROM f LEFT JOIN p ON p.g = f.g AND p.j = x % k AND p.i = x // k""")
def interleave(spark, sf_dir):
    """All series in groups of three, one value of each in turn until the longest ends, zeros where one ends before.

    The last group has the one or two series that are left over."""
    df = se.pack(panel(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0))), ["user_id"])
    place = sa.registry(df.select("user_id"), [F.col("user_id")])
    df = df.join(place, "user_id").withColumn("g", F.floor(F.col("id") / 3)).withColumn("j", F.col("id") % 3)
    rows = F.sort_array(F.collect_list(F.struct("j", "values")))
    df = df.groupBy("g").agg(F.transform(rows, lambda x: x["values"]).alias("all"), F.max(F.size("values")).alias("n"))
    turns = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda t: F.transform("all", lambda v: F.coalesce(F.get(v, t), F.lit(0.0))))
    return df.select("g", F.posexplode(F.flatten(turns)).alias("i", "v")).select("g", F.col("i").cast("long").alias("i"), r6("v").alias("v"))


#: Curves: mean prices of order priorities by month stand for validation errors of cells by iteration.
_CURVE = """curve AS (SELECT o_orderpriority AS bin, CAST(month(o_orderdate) AS INTEGER) AS iter, round(avg(o_totalprice) / 1000, 4) AS perf FROM orders GROUP BY 1, 2),
  c AS (SELECT bin, iter, perf, first_value(perf) OVER w AS p0, last_value(perf) OVER w AS p1, first_value(iter) OVER w AS i0, last_value(iter) OVER w AS i1 FROM curve
    WINDOW w AS (PARTITION BY bin ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), m AS (SELECT * FROM c WHERE i0 < iter AND iter < i1)"""


def curve(spark, sf_dir):
    df = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bin"), F.month("o_orderdate").alias("iter"))
    return df.agg(F.round(F.avg("o_totalprice") / 1000, 4).alias("perf"))


_RATE = {
    "ratio": "((p0 - perf) / (iter - i0)) / ((perf - p1) / (i1 - iter) + 1e-8)",
    "progress_ratio": "((p0 - perf) / (p0 - p1 + 1e-8)) / ((iter - i0) / CAST(i1 - i0 AS DOUBLE) + 1e-8)",
    "slope": "(p0 - perf) / (iter - i0)",
}


def _rate(mode, name):
    def run(spark, sf_dir):
        return ra.rates(curve(spark, sf_dir), mode).withColumn("rate", F.round("rate", 4))

    run.__name__ = name
    query(f"WITH {_CURVE} SELECT bin, iter, round(greatest({_RATE[mode]}, 1e-8), 4) AS rate FROM m")(run)


_rate("ratio", "rate_ratio")
_rate("progress_ratio", "rate_progress")
_rate("slope", "rate_slope")


@query(f"WITH {_CURVE} SELECT bin, iter, perf FROM curve WHERE iter BETWEEN 3 AND 7")
def iter_filter(spark, sf_dir):
    return curve(spark, sf_dir).where(F.col("iter").between(3, 7))


@query(f"""WITH {_CURVE}, r AS (SELECT bin, iter, greatest({_RATE['slope']}, 1e-8) AS rate FROM m)
  SELECT iter, round(avg(rate), 6) AS mean, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY rate), 6) AS median, 2.0::DOUBLE AS "const" FROM r GROUP BY iter""")
def stage_target(spark, sf_dir):
    """Mean, lower median and a constant of a stage's rates."""
    df = ra.rates(curve(spark, sf_dir), "slope")
    out = ra.stage_target(df, "mean").withColumnRenamed("target", "mean").join(ra.stage_target(df, "median").withColumnRenamed("target", "median"), "iter")
    out = out.join(ra.stage_target(df, "const", 2.0).withColumnRenamed("target", "const"), "iter")
    return out.select("iter", r6("mean").alias("mean"), r6("median").alias("median"), "const")


#: Weights of suppliers' nations: balance and number stand for learned and baseline weights.
_W = "w AS (SELECT s_suppkey AS bin, abs(s_acctbal) AS w, CAST(s_suppkey % 7 + 1 AS DOUBLE) * 100 + s_nationkey AS base FROM supplier)"


def weights(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bin"), F.abs("s_acctbal").alias("w"), ((F.col("s_suppkey") % 7 + 1).cast("double") * 100 + F.col("s_nationkey")).alias("base"))


@query(f"""WITH {_CURVE}, r AS (SELECT bin, iter, (iter / 10.0) * greatest({_RATE['slope']}, 1e-8) AS x FROM m),
  q AS (SELECT bin, iter, -(x - avg(x) OVER (PARTITION BY iter)) * (x - avg(x) OVER (PARTITION BY iter)) AS reward FROM r)
  SELECT bin, iter, round(reward, 4) AS reward, round((reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-6), 4) AS advantage FROM q WINDOW g AS (PARTITION BY iter)""")
def advantage(spark, sf_dir):
    """Rewards of weighted rates and their advantages within a stage."""
    df = ra.rates(curve(spark, sf_dir), "slope").withColumn("w", F.col("iter") / 10.0)
    return ra.advantage(df, ["iter"]).select("bin", "iter", F.round("reward", 4).alias("reward"), F.round("advantage", 4).alias("advantage"))


@query(f"WITH {_W} SELECT bin, round(w / sum(w) OVER (), 8) AS w FROM w")
def normalize_weights(spark, sf_dir):
    return ra.normalize(weights(spark, sf_dir).select("bin", "w")).withColumn("w", F.round("w", 8))


@query(f"WITH {_W} SELECT round(coalesce(corr(w, base), 0), 6) AS pearson FROM w")
def pearson(spark, sf_dir):
    return ra.pearson(weights(spark, sf_dir), "w", "base").select(r6("pearson").alias("pearson"))


_TOP = _W + """, k AS (SELECT greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT)) AS k FROM w),
  r AS (SELECT *, row_number() OVER (ORDER BY w DESC, bin) AS rw, row_number() OVER (ORDER BY base DESC, bin) AS rb, row_number() OVER (ORDER BY w, bin) AS lw, row_number() OVER (ORDER BY base, bin) AS lb FROM w)"""


@query(f"WITH {_TOP} SELECT round(count(*) FILTER (rw <= k AND rb <= k) / max(k), 6) AS top, round(count(*) FILTER (lw <= k AND lb <= k) / max(k), 6) AS bottom FROM r, k")
def topk_overlap(spark, sf_dir):
    df = weights(spark, sf_dir)
    top, low = ra.overlap(df).select(r6("overlap").alias("top")), ra.overlap(df, bottom=True).select(r6("overlap").alias("bottom"))
    return top.withColumn("one", F.lit(1)).join(low.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


@query(f"WITH {_TOP} SELECT round(coalesce(sum(base) FILTER (rw <= k AND rb <= k), 0) / greatest(sum(base) FILTER (rb <= k), 1e-12), 6) AS recall FROM r, k")
def topk_mass_recall(spark, sf_dir):
    return ra.mass_recall(weights(spark, sf_dir)).select(r6("recall").alias("recall"))


@query(f"""WITH {_W}, c AS (SELECT bin, sum(w) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS upper FROM w WHERE w > 0),
  u AS (SELECT i, CAST('0x' || substr(md5('42:' || i), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM range(1, 501) r(i))
  SELECT i, (SELECT min(bin) FROM c WHERE upper > u) AS bin FROM u""")
def weighted_sample(spark, sf_dir):
    """500 draws of cells by weight."""
    df = weights(spark, sf_dir)
    return sa.weighted(df, df, "bin", 500)


@query(f"""WITH {_W} SELECT round(avg(w), 4) AS w_mean, round(stddev_pop(w), 4) AS w_std, round(min(w), 4) AS w_min, round(max(w), 4) AS w_max, round(avg(base), 4) AS base_mean,
  round(stddev_pop(base), 4) AS base_std, round(avg(abs(w - base)), 4) AS diff_mean, round(max(abs(w - base)), 4) AS diff_max FROM w""")
def report_stats(spark, sf_dir):
    out = ra.report(weights(spark, sf_dir))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


#: Graph: suppliers and groups of parts, by number of line items.
_ADJ = "adj AS (SELECT l_suppkey AS src, l_partkey % 50 AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2)"


def adjacency(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return df.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst")).agg(F.count("*").cast("double").alias("w"))


_NODES = "nodes AS (SELECT src AS v FROM adj UNION SELECT dst FROM adj)"


def _norm(adj: str) -> str:
    return f"""dg AS (SELECT src AS v, sum(w) AS deg FROM {adj} GROUP BY src),
  sc AS (SELECT src, dst, CASE WHEN a.deg > 0 THEN 1 / sqrt(a.deg) ELSE 0 END * w * CASE WHEN coalesce(b.deg, 0) > 0 THEN 1 / sqrt(b.deg) ELSE 0 END AS w
    FROM {adj} JOIN dg a ON a.v = src LEFT JOIN dg b ON b.v = dst)"""


_LAP = "lap AS (SELECT src, dst, sum(w) AS w FROM (SELECT v AS src, v AS dst, 1.0::DOUBLE AS w FROM nodes UNION ALL SELECT src, dst, -w FROM sc) GROUP BY 1, 2)"


@query(f"WITH {_ADJ}, {_NODES}, {_norm('adj')}, {_LAP} SELECT src, dst, round(w, 6) AS w FROM lap")
def laplacian(spark, sf_dir):
    return gr.laplacian(adjacency(spark, sf_dir)).withColumn("w", r6("w"))


_SYM = "sy AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM adj UNION ALL SELECT dst, src, w FROM adj) GROUP BY 1, 2)"


@query(f"WITH {_ADJ}, {_NODES}, {_SYM}, {_norm('sy')}, {_LAP} SELECT src, dst, round(w - CASE WHEN src = dst THEN 1 ELSE 0 END, 6) AS w FROM lap")
def scaled_laplacian(spark, sf_dir):
    return gr.scaled_laplacian(adjacency(spark, sf_dir)).withColumn("w", r6("w"))


#: L to the power 2**16 by squarings, each divided by its trace; of such a power all but the largest eigenvalue is gone.
_POWER = ", ".join(["p0 AS (SELECT src, dst, w FROM lap)"] + [
    f"r{k} AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM p{k} a JOIN p{k} b ON a.dst = b.src GROUP BY 1, 2), "
    f"p{k + 1} AS (SELECT src, dst, w / (SELECT sum(w) FROM r{k} WHERE src = dst) AS w FROM r{k})" for k in range(16)])  # fmt: skip


@query(f"""WITH {_ADJ}, {_NODES}, {_SYM}, {_norm('sy')}, {_LAP}, {_POWER}, top AS (SELECT sum(lap.w * p16.w) AS top FROM lap JOIN p16 USING (src, dst))
  SELECT src, dst, round(w * 2 / top - CASE WHEN src = dst THEN 1 ELSE 0 END, 6) AS w FROM lap, top""")
def scaled_laplacian_auto(spark, sf_dir):
    """The Laplacian scaled by its own largest eigenvalue."""
    return gr.scaled_laplacian(adjacency(spark, sf_dir), None).withColumn("w", r6("w"))


_LOOP = "lo AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM adj UNION ALL SELECT v, v, 1.0::DOUBLE FROM nodes) GROUP BY 1, 2)"


@query(f"WITH {_ADJ}, {_NODES}, {_LOOP}, {_norm('lo')} SELECT dst AS src, src AS dst, round(w, 6) AS w FROM sc")
def message_passing(spark, sf_dir):
    return gr.message_passing(adjacency(spark, sf_dir)).withColumn("w", r6("w"))


@query(f"WITH {_ADJ} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM adj")
def transition_matrix(spark, sf_dir):
    return gr.transition(adjacency(spark, sf_dir)).withColumn("w", r6("w"))


@query(f"""WITH {_ADJ} SELECT 0 AS part, dst AS src, src AS dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM adj
  UNION ALL SELECT 1, src, dst, round(w / sum(w) OVER (PARTITION BY dst), 6) FROM adj""")
def double_transition(spark, sf_dir):
    one, two = gr.load(adjacency(spark, sf_dir), "doubletransition")
    return one.withColumn("part", F.lit(0)).unionByName(two.withColumn("part", F.lit(1))).withColumn("w", r6("w"))


@query(f"""WITH {_CURVE}, r AS (SELECT bin, iter, greatest({_RATE['slope']}, 1e-8) AS rate FROM m)
  SELECT o_orderkey, round(rate, 6) AS rate FROM orders JOIN r ON bin = o_orderpriority AND iter = least(greatest(month(o_orderdate), 2), 11)""")
def rate_gather(spark, sf_dir):
    """The rate of every order's priority and month; the first and the last month, which have none, take their neighbour's."""
    table = ra.rates(curve(spark, sf_dir), "slope")
    draws = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("bin"), F.least(F.greatest(F.month("o_orderdate"), F.lit(2)), F.lit(11)).alias("iter"))
    return ra.gather(draws, table).select("o_orderkey", r6("rate").alias("rate"))


@query("SELECT o_orderkey, c_name AS path FROM orders JOIN customer ON o_custkey = c_custkey")
def item_paths(spark, sf_dir):
    """Items with the path of their file: orders with their customer's name."""
    items = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file_id"))
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"))
    return co.with_paths(items, files).select("o_orderkey", "path")


@query("""WITH i AS (SELECT DISTINCT vec_id // 20 AS series, CAST(label AS BIGINT) AS cell FROM embeddings),
  c AS (SELECT vec_id // 20 AS series, count(*) AS codes, CAST(sum(label) AS BIGINT) AS total FROM embeddings GROUP BY 1)
  SELECT series, cell, codes, total FROM i JOIN c USING (series)""")
def index_codes(spark, sf_dir):
    """Index rows of cells with the codes of their series."""
    df = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("series"), F.col("label").cast("long").alias("label"))
    codes = df.groupBy("series").agg(F.count("*").alias("codes"), F.sum("label").alias("total"))
    return co.index_codes(df.select("series", F.col("label").alias("cell")).distinct(), codes, ["series"])


@query(f"""WITH {PRED}, s AS (SELECT user_id // 64 AS batch, user_id, count(*) AS n, count(target) AS seen, coalesce(sum(abs(prediction - target)) FILTER (target IS NOT NULL), 0) AS a,
    coalesce(sum((prediction - target) * (prediction - target)) FILTER (target IS NOT NULL), 0) AS q FROM pred GROUP BY 1, 2),
  e AS (SELECT user_id, a / n / (sum(seen) OVER w / sum(n) OVER w) AS mae, q / n / (sum(seen) OVER w / sum(n) OVER w) AS mse FROM s WINDOW w AS (PARTITION BY batch))
  SELECT o_orderkey, round(mae, 5) AS mae, round(mse, 4) AS mse FROM orders LEFT JOIN e ON e.user_id = o_custkey""")
def sample_errors(spark, sf_dir):
    """Sampled items with the errors of their series, NULL where there are none: orders stand for items."""
    df = pred(spark, sf_dir).withColumn("batch", F.floor(F.col("user_id") / 64))
    items = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("user_id"))
    errors = reconstruction_error(df, ["user_id"], ["batch"]).withColumn("user_id", F.col("user_id").cast("long"))
    out = co.with_errors(items, errors, ["user_id"])
    return out.select("o_orderkey", F.round("mae", 5).alias("mae"), F.round("mse", 4).alias("mse"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def index_intersection(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return df.where("o_orderstatus = 'F'").select("o_custkey").intersect(df.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def missing_outputs(spark, sf_dir):
    """Customers without a finished order."""
    outputs = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sa.missing(read(spark, sf_dir, "customer"), outputs, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_custkey, 'a' AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'b' FROM orders WHERE o_orderstatus <> 'F'")
def batch_union(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    part = lambda rows, name: df.where(rows).select("o_custkey", F.lit(name).alias("part"))
    return part("o_orderstatus = 'F'", "a").unionByName(part("o_orderstatus <> 'F'", "b"))
