"""Series preparation, patches and codes of patches."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as a
from ..functions import time as tm
from ..operators import patches as pt
from ..operators import series as se
from .base import PACKED, PANEL, packed, panel, query, r6, read

_STATS = PANEL + ", s AS (SELECT user_id, avg(value) AS m, CASE WHEN stddev_pop(value) < 1e-4 THEN 1 ELSE stddev_pop(value) END AS d FROM panel GROUP BY user_id)"


def _long(df, column="values"):
    return df.select("user_id", F.posexplode(column).alias("i", "v")).select("user_id", F.col("i").cast("long").alias("i"), r6("v").alias("v"))


@query(f"WITH {_STATS} SELECT user_id, CAST(t - 1 AS BIGINT) AS i, round((value - m) / d, 6) AS v FROM panel JOIN s USING (user_id)")
def zscore_series(spark, sf_dir):
    """Series to mean 0 and deviation 1 by their valid values."""
    return _long(se.zscore(panel(spark, sf_dir), ["user_id"], 1e-4))


_FIT = PANEL + ", n AS (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id), tr AS (SELECT panel.* FROM panel JOIN n USING (user_id) WHERE t <= n - floor(n * 0.1::DOUBLE) - floor(n * 0.2::DOUBLE))"


@query(f"""WITH {_FIT} SELECT user_id, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END, 6) AS std,
  round(min(value), 6) AS low, round(max(value), 6) AS high FROM tr GROUP BY user_id""")
def scaler_fit(spark, sf_dir):
    """Scalers of each series from its training split."""
    df = se.split(panel(spark, sf_dir), ["user_id"], 0.1, 0.2)
    part = F.col("split") == "train"
    both = se.fit_z(df, ["user_id"], part).join(se.fit_range(df, ["user_id"], part), "user_id")
    return both.select("user_id", *[r6(c).alias(c) for c in ("mean", "std", "low", "high")])


@query(f"""WITH {_FIT}, f AS (SELECT user_id, min(value) AS low, max(value) AS high FROM tr GROUP BY user_id)
  SELECT user_id, CAST(t AS INTEGER) AS t, round((value - low) / (high - low), 6) AS v, round(value, 6) AS back FROM panel JOIN f USING (user_id)""")
def minmax_series(spark, sf_dir):
    """Values by the range of the training split, and what the inverse makes of them."""
    df = se.split(panel(spark, sf_dir), ["user_id"], 0.1, 0.2)
    fit = se.fit_range(df, ["user_id"], F.col("split") == "train")
    df = df.join(fit, "user_id").withColumn("v", (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    return df.select("user_id", "t", r6("v").alias("v"), r6(se.unrange("v", "low", "high")).alias("back"))


@query(f"""WITH {_FIT}, f AS (SELECT user_id, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS d FROM tr GROUP BY user_id)
  SELECT user_id, CAST(t AS INTEGER) AS t, round((value - m) / d, 6) AS z, round(value, 6) AS back FROM panel JOIN f USING (user_id)""")
def scaler_inverse(spark, sf_dir):
    """Scaled values and what the inverse makes of them."""
    df = se.split(panel(spark, sf_dir), ["user_id"], 0.1, 0.2)
    df = df.join(se.fit_z(df, ["user_id"], F.col("split") == "train"), "user_id").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    return df.select("user_id", "t", r6("z").alias("z"), r6(F.col("z") * F.col("std") + F.col("mean")).alias("back"))


@query(f"""WITH {PANEL}, n AS (SELECT user_id, count(*) AS n, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) AS v, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS x FROM panel GROUP BY user_id),
  b AS (SELECT user_id, 'train' AS split, 0 AS low, n - v - x AS high, 0 AS before, 4 AS after FROM n UNION ALL SELECT user_id, 'valid', n - v - x, n - x, 7, 4 FROM n
    UNION ALL SELECT user_id, 'test', n - x, n, 7, 0 FROM n),
  w AS (SELECT user_id, split, CASE WHEN high - low < 12 THEN low - before ELSE low END AS low, CASE WHEN high - low < 12 THEN high + after ELSE high END AS high FROM b)
  SELECT w.user_id, split, count(*) AS rows, CAST(min(t) AS INTEGER) AS first, CAST(max(t) AS INTEGER) AS last FROM w JOIN panel p ON p.user_id = w.user_id AND t > low AND t <= high GROUP BY 1, 2""")
def tsf_split(spark, sf_dir):
    """Splits for windows of 8 and 4 steps; those too short for one borrow from their neighbours."""
    df = se.split(panel(spark, sf_dir), ["user_id"], 0.1, 0.2, (8, 4))
    return df.groupBy("user_id", "split").agg(F.count("*").alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"))


@query(f"""WITH {PANEL}, n AS (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id),
  tr AS (SELECT user_id, t, coalesce(value, 0) AS value FROM panel JOIN n USING (user_id) WHERE t <= n - floor(n * 0.1::DOUBLE) - floor(n * 0.2::DOUBLE)),
  w AS (SELECT user_id, CAST(t - 1 AS BIGINT) AS i, count(*) OVER a AS na, sum(value) OVER a AS sa, count(*) OVER b AS nb, sum(value) OVER b AS sb FROM tr
    WINDOW a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 8 FOLLOWING AND 11 FOLLOWING))
  SELECT user_id, i, round(sa, 6) AS input_sum, round(sb, 6) AS target_sum FROM w WHERE na = 8 AND nb = 4""")
def sliding_pairs(spark, sf_dir):
    """Input and target windows of the training split."""
    df = se.split(panel(spark, sf_dir), ["user_id"], 0.1, 0.2).where("split = 'train'").withColumn("value", F.coalesce("value", F.lit(0.0)))
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda s, v: s + v))
    return se.sliding(df, ["user_id"], 8, 4).select("user_id", "i", total("inputs").alias("input_sum"), total("targets").alias("target_sum"))


@query(f"WITH {PANEL} SELECT user_id, CAST(t - 1 AS BIGINT) AS i, round(value, 6) AS v FROM panel WHERE t <= 64 "
       f"UNION ALL SELECT user_id, i, NULL FROM (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id), range(64) r(i) WHERE i >= n")  # fmt: skip
def resize_truncate(spark, sf_dir):
    """Exactly 64 points: the first ones, or padded."""
    return _long(packed(spark, sf_dir).withColumn("values", a.truncate("values", 64)))


@query(f"""WITH {PANEL}, n AS (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id),
  k AS (SELECT user_id, n, CASE WHEN n // 16 >= 32 THEN 32 WHEN n // 16 >= 16 THEN 16 WHEN n // 16 >= 8 THEN 8 WHEN n // 16 >= 4 THEN 4 WHEN n // 16 >= 2 THEN 2 ELSE 1 END AS k FROM n)
  SELECT k.user_id, CAST(i AS BIGINT) AS i, round(value, 6) AS v FROM k CROSS JOIN range(16) r(i) LEFT JOIN panel ON panel.user_id = k.user_id AND t = i * k + 1""")
def resize_interval(spark, sf_dir):
    """Exactly 16 points at the largest interval that fits."""
    return _long(packed(spark, sf_dir).withColumn("values", a.decimate("values", 16)))


@query(f"""WITH {PANEL}, n AS (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id)
  SELECT n.user_id, CAST(i AS BIGINT) AS i, round(value, 6) AS v FROM n CROSS JOIN range(128) r(i) LEFT JOIN panel ON panel.user_id = n.user_id AND t = i + 1 WHERE i < greatest(n, 128)""")
def pad_series(spark, sf_dir):
    return _long(packed(spark, sf_dir).withColumn("values", a.pad("values", 128)))


@query(f"""WITH {PANEL}, s AS (SELECT user_id, min(t) FILTER (value IS NOT NULL) - 1 AS a, max(t) FILTER (value IS NOT NULL) AS b FROM panel GROUP BY user_id)
  SELECT user_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", CAST(b - a AS INTEGER) AS size FROM s""")
def valid_segment(spark, sf_dir):
    """The valid range of each series and its length once cut out."""
    df = panel(spark, sf_dir)
    some = F.when(F.col("value").isNotNull(), F.col("t"))
    ends = df.groupBy("user_id").agg((F.min(some) - 1).alias("start"), F.max(some).alias("end"))
    df = se.pack(df, ["user_id"]).join(ends, "user_id")
    return df.select("user_id", "start", "end", F.size(a.segment("values", "start", "end")).alias("size"))


@query(f"""WITH {PANEL} SELECT user_id, bool_or(value IS NULL) AS any_missing, round(sum(coalesce(value, 0)), 6) AS filled FROM panel GROUP BY user_id""")
def nan_check(spark, sf_dir):
    """Which series have missing values; their sum once those are 0."""
    return panel(spark, sf_dir).groupBy("user_id").agg(F.bool_or(F.col("value").isNull()).alias("any_missing"), r6(F.sum(a.finite("value"))).alias("filled"))


@query(f"""WITH {PANEL} SELECT user_id, CAST(t AS INTEGER) AS epoch, CAST(CASE WHEN t <= 3 THEN 12 ELSE least(((t - 1 - 3) // 4 + 1) * 2, 12) END AS INTEGER) AS length,
  CASE WHEN t % 12 < CASE WHEN t <= 3 THEN 12 ELSE least(((t - 1 - 3) // 4 + 1) * 2, 12) END THEN round(value, 6) END AS counted FROM panel""")
def curriculum(spark, sf_dir):
    """How much of the horizon counts in each epoch, a series' step standing for one; and its value, if its place in the horizon counts."""
    df = panel(spark, sf_dir).withColumn("length", tm.curriculum_length(F.col("t"), 3, 4, 2, 12))
    return df.select("user_id", F.col("t").cast("int").alias("epoch"), "length", F.when(F.col("t") % 12 < F.col("length"), r6("value")).alias("counted"))


@query(f"""WITH {PANEL}, w AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id) AS n, [coalesce(lag(value, 3) OVER s, 0), coalesce(lag(value, 2) OVER s, 0), coalesce(lag(value) OVER s, 0), coalesce(value, 0)] AS v
    FROM panel WINDOW s AS (PARTITION BY user_id ORDER BY t))
  SELECT user_id, CAST(t AS INTEGER) AS t, CAST(i AS BIGINT) AS i, round(CASE WHEN i < 4 THEN v[1 + i] ELSE 0 END, 6) AS v FROM w, range(12) r(i) WHERE t >= least(16, n)""")
def decoder_frames(spark, sf_dir):
    """Decoder inputs of every window of 16 input steps, by its last step; a shorter series is one window, with zeros in front."""
    order = Window.partitionBy("user_id").orderBy("t")
    df = panel(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    last = [F.lag("value", k, 0.0).over(order) for k in (3, 2, 1)]
    df = df.select("user_id", "t", "n", F.array(*last, F.col("value"), *[F.lit(0.0)] * 8).alias("values")).where("t >= least(16, n)")
    return df.select("user_id", "t", F.posexplode("values").alias("i", "v")).select("user_id", "t", F.col("i").cast("long").alias("i"), r6("v").alias("v"))


@query(f"""WITH {PANEL} SELECT user_id, count(*) AS steps, CAST(max(t) AS INTEGER) AS last FROM panel GROUP BY user_id""")
def append_steps(spark, sf_dir):
    """The first twenty steps and then the later ones: the same panel."""
    df = panel(spark, sf_dir)
    both = se.append(df.where("t <= 20"), df.where("t > 20"), ["user_id"], "ts", "event_id")
    return both.groupBy("user_id").agg(F.count("*").alias("steps"), F.max("t").alias("last"))


@query(f"WITH {PANEL} SELECT user_id, event_type, CAST(t AS INTEGER) AS t, round(value, 6) AS value FROM panel WHERE event_type IN ('click', 'view')")
def feature_select(spark, sf_dir):
    """Chosen channels of all series."""
    return panel(spark, sf_dir).where(F.col("event_type").isin("click", "view")).select("user_id", "event_type", "t", r6("value").alias("value"))


_FRAMES = PACKED + ", fr AS (SELECT user_id, p, list_slice(values, CAST(p * 4 + 1 AS BIGINT), CAST(p * 4 + 8 AS BIGINT)) AS patch FROM packed, range(400) r(p) WHERE p * 4 + 8 <= len(values))"


@query(f"WITH {_FRAMES} SELECT user_id, CAST(p AS INTEGER) AS p, round(list_sum(patch), 6) AS total, CAST(len(patch) AS INTEGER) AS size FROM fr")
def patch_frames(spark, sf_dir):
    df = pt.patches(packed(spark, sf_dir), 8, 4)
    some = F.filter("patch", lambda v: v.isNotNull())
    total = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, v: s + v))
    return df.select("user_id", "p", r6(total).alias("total"), F.size("patch").alias("size"))


@query(f"WITH {_FRAMES} SELECT user_id, CAST(p AS INTEGER) AS p, len(list_filter(patch, lambda x: x IS NULL)) = 0 AS ok FROM fr")
def patch_mask(spark, sf_dir):
    return pt.patches(packed(spark, sf_dir), 8, 4).select("user_id", "p", "ok")


@query(f"""WITH {PANEL}, n AS (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id), w AS (SELECT user_id, greatest(1, ceil((n - 4) / 48.0)) AS w FROM n),
  p AS (SELECT user_id, unnest(range(CAST(w * 12 AS BIGINT))) AS p FROM w),
  c AS (SELECT p.user_id, p, count(value) AS c FROM p LEFT JOIN panel ON panel.user_id = p.user_id AND t > p * 4 AND t <= p * 4 + 8 GROUP BY 1, 2),
  m3 AS (SELECT user_id, p // 12 AS w, list(c = 8 ORDER BY p) AS m FROM c GROUP BY 1, 2),
  m2 AS (SELECT *, list_transform(range(6), lambda i: list_bool_and(list_slice(m, i * 2 + 1, i * 2 + 2))) AS m2 FROM m3),
  m1 AS (SELECT *, list_transform(range(4), lambda i: list_bool_and(list_slice(m2, CAST(round_even(i * 1.5, 0) AS BIGINT) + 1, CAST(round_even((i + 1) * 1.5, 0) AS BIGINT)))) AS m1 FROM m2)
  SELECT user_id, CAST(w AS INTEGER) AS w, array_to_string(list_transform(list_concat(list_concat(m1, m2), m), lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS mask FROM m1""")
def multilevel_mask(spark, sf_dir):
    """Masks of three levels over whole series: frames of twelve patches, one behind the other, the last one padded."""
    df = packed(spark, sf_dir).withColumn("frames", F.greatest(F.lit(1), F.ceil((F.size("values") - 4) / 48)).cast("int"))
    df = df.select("user_id", "values", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("w"))
    df = df.select("user_id", "w", a.truncate(F.slice("values", F.col("w") * 48 + 1, F.lit(52)), 52).alias("values"))
    df = pt.level_masks(df, 8, 4, [4, 6, 12])
    return df.select("user_id", "w", F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "").alias("mask"))


@query(f"""WITH {_FRAMES} SELECT user_id, CAST(4 * count(*) FILTER (ok) AS INTEGER) AS valid_len FROM (
  SELECT user_id, p, len(list_filter(patch, lambda x: x IS NULL)) = 0 AS ok FROM fr) GROUP BY user_id""")
def valid_len(spark, sf_dir):
    """Stride times the valid patches of the finest scale."""
    df = pt.patches(packed(spark, sf_dir), 8, 4).withColumn("code", F.when(F.col("ok"), F.col("p")))
    codes = df.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "code"))), lambda x: x["code"]).alias("codes"))
    return codes.select("user_id", pt.valid_length("codes", 255, 4).alias("valid_len"))


@query(f"""WITH {PANEL}, n AS (SELECT user_id, count(*) AS n FROM panel GROUP BY user_id)
  SELECT user_id, CAST(t - 1 AS INTEGER) AS t, round(value, 6) AS value FROM panel JOIN n USING (user_id) WHERE n >= 8 AND t - 1 < ((n - 8) // 4) * 4 + 8""")
def overlap_add(spark, sf_dir):
    """Patches put back together: the framed part of the series."""
    df = pt.patches(packed(spark, sf_dir), 8, 4)
    return pt.overlap_add(df, ["user_id"], 4).select("user_id", F.col("t").cast("int").alias("t"), r6("value").alias("value"))


@query(f"""WITH {PANEL} SELECT user_id, CAST((t - 1) // 2 AS BIGINT) AS i, round(max(CASE WHEN t % 2 = 1 THEN coalesce(value, 0) END), 6) AS a,
  round(coalesce(max(CASE WHEN t % 2 = 0 THEN coalesce(value, 0) END), 0), 6) AS b FROM panel GROUP BY 1, 2""")
def pair_merge(spark, sf_dir):
    df = se.pack(panel(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0))), ["user_id"])
    df = df.select("user_id", F.posexplode(pt.merge_pairs("values")).alias("i", "x"))
    return df.select("user_id", F.col("i").cast("long").alias("i"), r6(F.get("x", F.lit(0))).alias("a"), r6(F.get("x", F.lit(1))).alias("b"))


@query(f"""WITH {PANEL}, n AS (SELECT user_id, CAST(ceil(count(*) / 17.0) AS BIGINT) * 17 AS size FROM panel GROUP BY user_id),
  f AS (SELECT user_id, size, unnest(range(size)) AS i FROM n),
  g AS (SELECT f.user_id, CASE WHEN size > 17 THEN (i - 8 + size) % size ELSE i END AS place, coalesce(value, 0) AS v FROM f LEFT JOIN panel p ON p.user_id = f.user_id AND p.t = i + 1)
  SELECT user_id, CAST(place // 17 AS INTEGER) AS "window", 17 AS size, round(sum(v * (place % 17)), 5) AS total FROM g GROUP BY 1, 2""")
def attention_windows(spark, sf_dir):
    """Windows of 17 steps, the series padded and moved by 8."""
    df = pt.attention_windows(panel(spark, sf_dir), ["user_id"], 17, shift=8)
    weighted = F.aggregate(F.transform("values", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return df.select("user_id", "window", F.size("values").alias("size"), F.round(weighted, 5).alias("total"))


@query("""WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events)
  SELECT user_id, CAST(n - t AS INTEGER) AS back, round((hour(ts) * 60 + minute(ts)) / 1440.0 - 0.5, 6) AS tod, round((isodow(ts) - 1) / 7.0 - 0.5, 6) AS dow FROM r WHERE t > n - 12""")
def decoder_marks(spark, sf_dir):
    """Time marks of the decoder, about 0: the last four input steps and the eight after them, here the last twelve of each series."""
    rows = se.number(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).where("t > n - 12")
    return rows.select("user_id", (F.col("n") - F.col("t")).cast("int").alias("back"), r6(tm.mark(tm.time_of_day(F.col("ts")))).alias("tod"), r6(tm.mark(tm.day_of_week(F.col("ts")))).alias("dow"))


@query("""SELECT event_id, round((hour(ts) * 60 + minute(ts)) / 1440.0, 6) AS tod, round((isodow(ts) - 1) / 7.0, 6) AS dow,
  round((day(ts) - 1) / 31.0, 6) AS dom, round((dayofyear(ts) - 1) / 366.0, 6) AS doy FROM events""")
def time_features(spark, sf_dir):
    ts = F.col("ts")
    return read(spark, sf_dir, "events").select("event_id", r6(tm.time_of_day(ts)).alias("tod"), r6(tm.day_of_week(ts)).alias("dow"), r6(tm.day_of_month(ts)).alias("dom"), r6(tm.day_of_year(ts)).alias("doy"))


@query("""WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  f AS (SELECT user_id, max(ts) AS last, epoch_us(min(ts) FILTER (k = 2)) - epoch_us(min(ts) FILTER (k = 1)) AS d FROM r GROUP BY user_id)
  SELECT user_id, CAST(k AS INTEGER) AS k, last + to_minutes(CAST(k * (d // 60000000) AS BIGINT)) AS ts FROM f, range(1, 7) r(k) WHERE d >= 60000000""")
def future_index(spark, sf_dir):
    """Six time stamps after a series' last one, at the frequency of its first two; a series without a frequency has none."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = read(spark, sf_dir, "events").select("user_id", "ts", F.row_number().over(order).alias("k"))
    at = lambda k: F.min(F.when(F.col("k") == k, F.col("ts")))
    df = df.groupBy("user_id").agg(F.max("ts").alias("last"), at(1).alias("a"), at(2).alias("b"))
    df = df.withColumn("m", tm.frequency_minutes(F.col("a"), F.col("b"))).where("m IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return df.select("user_id", "k", F.expr("last + make_interval(0, 0, 0, 0, 0, k * m, 0)").alias("ts"))


@query(f"""WITH {PANEL}, s AS (SELECT user_id, t AS s FROM panel) SELECT user_id, CAST(s AS INTEGER) AS step, round(CASE WHEN s < 10 THEN s / 10.0 ELSE greatest(0, 0.5 * (1 + cos(pi() * (s - 10) / 50.0))) END, 6) AS cosine,
  round(CASE WHEN s < 10 THEN s / 10.0 WHEN (s - 10) / 50.0 >= 1 THEN 0 ELSE greatest(0, 0.5 * (1 + cos(pi() * (2 * ((s - 10) / 50.0) - floor(2 * ((s - 10) / 50.0)))))) END, 6) AS restarts FROM s""")
def lr_cosine(spark, sf_dir):
    """Learning rates of a series' steps, on a schedule that ends within the longer ones."""
    df = panel(spark, sf_dir).select("user_id", F.col("t").cast("int").alias("step"))
    return df.select("user_id", "step", r6(tm.cosine_rate(F.col("step"), 10, 60)).alias("cosine"), r6(tm.restart_rate(F.col("step"), 10, 60)).alias("restarts"))
