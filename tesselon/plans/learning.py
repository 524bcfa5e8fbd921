"""Losses, moving moments and draws of codebook learning."""

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import learning as le
from .base import PANEL, panel, query, r6, read
from .cellular import book
from .selection import _CURVE, _W, curve, weights

_X = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v), b AS (SELECT vec_id AS code, e, norm FROM n WHERE vec_id < 10)"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}.e[i] * {b}.e[i]))"


def _u(seed: int, *keys: str) -> str:
    return f"((CAST('0x' || substr(md5('{seed}' || {' || '.join(chr(39) + ':' + chr(39) + ' || ' + k for k in keys)}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _p(seed: int, count: str, *keys: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}' || {' || '.join(chr(39) + ':' + chr(39) + ' || ' + k for k in keys)}), 1, 8) AS BIGINT) % {count})"


@query(f"""WITH {_X}, f AS (SELECT label, min(vec_id) AS first FROM n GROUP BY label), p AS (SELECT a.vec_id, a.e, a.norm, z.e AS ze, z.norm AS zn FROM n a JOIN f USING (label) JOIN n z ON z.vec_id = f.first),
  s AS (SELECT *, list_transform(e, lambda x: exp(x - list_max(e))) AS x FROM p), q AS (SELECT *, list_transform(x, lambda y: y / list_sum(x)) AS soft FROM s)
  SELECT vec_id, round(norm, 6) AS norm, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - ze[i]) * (e[i] - ze[i])))), 6) AS far,
    round(list_sum(list_transform(range(1, 65), lambda i: e[i] / norm * ze[i] / zn)), 6) AS cosine, round(e[1] / greatest(e[2], 1e-6), 4) AS ratio,
    round(-list_sum(list_transform(soft, lambda y: y * ln(greatest(y, 1e-5)))), 6) AS entropy FROM q""")
def vector_functions(spark, sf_dir):
    """Length, distance and cosine from the first vector of the label, a guarded ratio, and the entropy of the softmax."""
    df = read(spark, sf_dir, "embeddings")
    first = df.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("z"))
    rows = df.join(first, "label")
    return rows.select("vec_id", r6(v.norm("embedding")).alias("norm"), r6(v.distance("embedding", "z")).alias("far"), r6(v.dot(v.unit("embedding"), v.unit("z"))).alias("cosine"),
                       F.round(v.divide(F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")), 4).alias("ratio"), r6(v.entropy(v.softmax("embedding"))).alias("entropy"))


@query(f"""WITH {_X}, o AS (SELECT sum(pow({_DOT.format(a='x', b='y')} / x.norm / y.norm, 2)) / pow(count(DISTINCT x.vec_id), 2) - 1.0 / count(DISTINCT x.vec_id) AS o FROM n x, n y),
  c AS (SELECT sum(list_sum(list_transform(range(1, 65), lambda i: (n.e[i] - b.e[i]) * (n.e[i] - b.e[i])))) / (64 * count(*)) AS c FROM n JOIN b ON b.code = n.label),
  s AS (SELECT n.vec_id, b.code, exp({_DOT.format(a='n', b='b')} / n.norm / b.norm) AS x FROM n, b), p AS (SELECT code, avg(x / t) AS p FROM (SELECT *, sum(x) OVER (PARTITION BY vec_id) AS t FROM s) GROUP BY code),
  d AS (SELECT sum(p * ln(greatest(p, 1e-5))) AS d FROM p)
  SELECT round(o, 6) AS orthogonality, round(c, 6) AS commitment, round(d, 6) AS diversity FROM o, c, d""")
def codebook_losses(spark, sf_dir):
    """Orthogonality of all vectors as a codebook; commitment and diversity of the vectors and ten codes."""
    df, codes = read(spark, sf_dir, "embeddings"), book(spark, sf_dir)
    vectors = df.select("vec_id", F.col("label").cast("long").alias("code"), F.col("embedding").alias("e"))
    one = lambda x: x.withColumn("one", F.lit(1))
    own = le.commitment(vectors.join(codes.select("code", F.col("e").alias("q")), "code"))
    rows = one(le.orthogonality(vectors)).join(one(own), "one").join(one(le.diversity(vectors, codes)), "one")  # one row each
    return rows.select(*[r6(c).alias(c) for c in ("orthogonality", "commitment", "diversity")])


@query("""WITH x AS (SELECT unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  SELECT CAST(d AS INTEGER) AS d, round(0.1 * avg(x), 7) AS mean, round(0.9 + 0.1 * var_pop(x), 6) AS var FROM x GROUP BY d""")
def affine_ema(spark, sf_dir):
    """Moving mean and variance of the vectors' numbers after one batch, from 0 and 1."""
    state = spark.range(64).select(F.col("id").cast("int").alias("d"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("var"))
    found = le.affine_step(read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("e")), state, 0.9)
    return found.select("d", F.round("mean", 7).alias("mean"), r6("var").alias("var"))


@query(f"""WITH {_CURVE}, s AS (SELECT DISTINCT iter, dense_rank() OVER (ORDER BY iter) - 1 AS k FROM m), o AS (SELECT DISTINCT bin, dense_rank() OVER (ORDER BY bin) - 1 AS k FROM m),
  d AS (SELECT i // 50 AS g, i % 50 AS j FROM range(2000) r(i)), z AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM o) AS nc)
  SELECT g, j, s.iter AS stage, o.bin AS cell FROM d JOIN z ON true JOIN s ON s.k = {_p(42, 'ns', 'g')} JOIN o ON o.k = {_p(42, 'nc', 'g', 'j')}""")
def group_sample(spark, sf_dir):
    """Forty groups of a stage and fifty cells that have rates."""
    from ..operators import rates as ra

    rows = ra.rates(curve(spark, sf_dir), "slope")
    return le.group_sample(rows, rows, 40, 50)


@query(f"""WITH {_W}, u AS (SELECT bin, sum(w) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS upper FROM w WHERE w > 0),
  i AS (SELECT CAST('0x' || substr(md5('42:' || i), 1, 8) AS BIGINT) / 4294967296.0 AS place FROM range(1, 2001) r(i)), d AS (SELECT (SELECT min(bin) FROM u WHERE upper > place) AS bin FROM i),
  n AS (SELECT bin, count(*) AS n FROM d GROUP BY bin)
  SELECT w.bin, coalesce(n, 0) AS n FROM w LEFT JOIN n USING (bin)""")
def multinomial_counts(spark, sf_dir):
    """How 2000 draws fall to cells by weight."""
    return le.multinomial(weights(spark, sf_dir), "bin", 2000)


@query(f"""WITH l AS (SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  t AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS place FROM l),
  g AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x / 0.1 - ln(-ln({_u(42, 'vec_id', 'i')})) DESC, i) AS k FROM t WHERE place <= 8)
  SELECT vec_id, i FROM g WHERE k = 1""")
def gumbel_picks(spark, sf_dir):
    """For each vector one of its eight largest numbers, drawn by softmax."""
    logits = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return le.gumbel_pick(logits.select("vec_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("logit")), "vec_id", "i", 0.1, top=8)


@query(f"""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings), c AS (SELECT count(*) AS n FROM r), d AS (SELECT i AS draw FROM range(5000) x(i))
  SELECT draw, vec_id FROM d JOIN c ON true JOIN r ON r.k = {_p(42, 'n', 'draw')}""")
def vector_draws(spark, sf_dir):
    """Draws of vectors with repetition, however many there are."""
    return le.draw_rows(read(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 5000, repeat=True)


@query(f"""WITH {PANEL}, z AS (SELECT user_id, t, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS z FROM panel WINDOW w AS (PARTITION BY user_id)),
  i AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS k FROM (SELECT DISTINCT user_id FROM panel)), c AS (SELECT count(*) AS n FROM i),
  m AS (SELECT mixture, unnest(range(1, {_p(42, '3', 'mixture')} + 2)) AS j FROM (SELECT i AS mixture FROM range(60) x(i))),
  g AS (SELECT mixture, j, {_p(42, 'n', 'mixture', 'j')} AS k, -ln({_u(43, 'mixture', 'j')}) - ln({_u(44, 'mixture', 'j')}) * pow(cos(2 * pi() * {_u(45, 'mixture', 'j')}), 2) AS g FROM m, c),
  w AS (SELECT mixture, k, g / sum(g) OVER (PARTITION BY mixture) AS w FROM g)
  SELECT mixture, CAST(t AS INTEGER) AS t, round(sum(w * z), 6) AS value FROM w JOIN i USING (k) JOIN z USING (user_id) GROUP BY mixture, t""")
def mixup(spark, sf_dir):
    """Sixty mixtures of one to three users' series."""
    found = le.mixup(panel(spark, sf_dir).select("user_id", "t", "value"), "user_id", 60)
    return found.select("mixture", "t", r6("value").alias("value"))
