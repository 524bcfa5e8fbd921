"""Personal data by weak supervision, in DataFrame operations only.

Regular expressions find candidate spans: strict ones (the base) and loose ones. Labelers vote
on each candidate (+1, -1, or 0 for none): its check, words before it, a gazetteer, and the
characters beside it. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is; its posteriors train a final span classifier (naive Bayes over votes,
kind and length). Base spans that pass their check always stay; loose ones, among them all
secrets (keys, tokens, passwords), are added where the classifier is sure of them, whichever
labelers voted. Only counts of patterns come to the driver: at most a few thousand.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ["email", "ip", "card", "phone"]
#: Base kinds and those that only the method adds.
ALL = [*KINDS, "secret"]
#: The base patterns. What follows a possessive quantifier can't begin with what it takes, and a match can only
#: begin where a run of its first characters does (or where the last match ended), so they find what the plain
#: patterns find, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose patterns: written-out addresses, and telephone numbers without a country code.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\))\x20?[A-Za-z]{2,24}+){1,5}+",
    "phone": r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|(?:sk|pk)[_-][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9_-])"
              r"|(?<=(?:(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\x20?[:=]\x20?[\"']?))[A-Za-z0-9+/_.~-]{6,}+",
}
#: A text in small letters without any of these has no secret.
MAY_SECRET = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "akia", "asia",
              "gho_", "ghp_", "ghs_", "ghu_", "sk-", "sk_", "pk-", "pk_"]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words that announce a kind, and the gazetteers (top-level domains, calling codes, issuers' first digits).
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|address|kontakt|correo|courriel)[^A-Za-z]*$",
    "ip": r"(?i)(?:ip|host|server|addr|address|from|client)[^A-Za-z]*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)[^A-Za-z]*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|telefono|téléphone)[^A-Za-z]*$",
    "secret": r"(?i)(?:password|passwd|pwd|secret|token|key)[^A-Za-z]*$",
}
#: Words that announce some other number.
ELSE = r"(?i)\b(?:row|line|page|order|invoice|item|id|no|ref|serial|version|part|isbn|article|ticket)[^A-Za-z]*$"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|ca|us|mx|ar)$",
    "ip": r"^(?!0+\.)(?!255\.)",
    "card": r"^[3456]",
    "secret": r"^(?:AKIA|ASIA|gh[opsu]_|[sp]k[_-])|^[0-9a-f]{16,}$|^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.~-]{12,}$",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
_BLOCK = 256


def _matches(text: Column, pattern: str, may: Column) -> Column:
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _located(found: Column, gaps: Column, sizes: Column, blocks: Column) -> Column:
    """(start, end, s, pre, post) of matches: start by the lengths of all that is before it."""

    def one(s: Column, j: Column) -> Column:
        block = F.floor(j / _BLOCK).cast("int")
        inside = F.aggregate(F.slice(sizes, block * _BLOCK + 1, j % _BLOCK), F.lit(0), lambda a, x: a + x)
        start = F.get(blocks, block) + inside + F.length(F.get(gaps, j))
        return F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"),
                        F.right(F.get(gaps, j), F.lit(24)).alias("pre"), F.substring(F.get(gaps, j + 1), 1, 1).alias("post"))

    return F.transform(found, one)


def _with_spans(docs: DataFrame, name: str, pattern: str, may: Column) -> DataFrame:
    """docs with a column name: the located matches of pattern in text."""
    docs = docs.withColumn("m_", _matches(F.col("text"), pattern, may))
    some = F.size("m_") > 0
    docs = docs.withColumn("g_", F.when(some, F.split("text", pattern, -1)))
    docs = docs.withColumn("z_", F.when(some, F.zip_with("m_", F.slice("g_", 1, F.size("m_")), lambda a, b: F.length(a) + F.length(b))))
    total = lambda b: F.aggregate(F.slice("z_", (b - 1) * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x)
    sums = F.aggregate(F.sequence(F.lit(1), F.floor(F.size("m_") / _BLOCK).cast("int")), F.array(F.lit(0)),
                       lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + total(b))))
    docs = docs.withColumn("b_", F.when(F.size("m_") >= _BLOCK, sums).otherwise(F.array(F.lit(0))))
    return docs.withColumn(name, _located(F.col("m_"), F.col("g_"), F.col("z_"), F.col("b_"))).drop("m_", "g_", "z_", "b_")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "secret":  # letters and figures, or a mark among them
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _vote(yes: Column, no: Column | bool = False) -> Column:
    return F.when(yes, 1).when(F.lit(no) if isinstance(no, bool) else no, -1).otherwise(0)


def _candidate(kind: str, x: Column, base: bool) -> Column:
    check = _vote(_passes(kind, x["s"]), True) if base or kind not in KINDS else F.lit(0)
    known = x["s"].rlike(GAZETTEER[kind])
    # a candidate inside a longer word or number is doubtful; one that isn't may be anything, and so may a number with a likely first digit
    inside = x["post"].rlike("[A-Za-z0-9]") | F.right(x["pre"], F.lit(1)).rlike("[A-Za-z0-9]")
    return F.struct(F.lit(ALL.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                    F.lit(base).alias("strict"), check.alias("v0"), _vote(x["pre"].rlike(CONTEXT[kind]), x["pre"].rlike(ELSE)).alias("v1"),
                    _vote(known if kind != "phone" else F.lit(False), ~known).alias("v2"), _vote(F.lit(False), inside).alias("v3"),
                    F.least(F.floor((x["end"] - x["start"]) / 6), F.lit(7)).cast("int").alias("size"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all candidate spans of whole texts with their votes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digit_", F.col("text").rlike("[0-9]")).withColumn("low_", F.lower("text"))
    may = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind in KINDS:
        rows = _with_spans(rows, kind, BASE[kind], may.get(kind, F.col("digit_")))
    written = F.contains("text", F.lit("(dot)")) | F.contains("text", F.lit("[dot]"))
    rows = _with_spans(rows, "loose_email", LOOSE["email"], written)
    rows = _with_spans(rows, "loose_phone", LOOSE["phone"], F.col("digit_"))
    rows = _with_spans(rows, "loose_secret", LOOSE["secret"], reduce(or_, [F.contains(F.col("low_"), F.lit(w)) for w in MAY_SECRET]))
    votes = lambda kind, base: lambda x: _candidate(kind, x, base)
    parts = [F.transform(kind, votes(kind, True)) for kind in KINDS]
    parts += [F.transform(f"loose_{kind}", votes(kind, False)) for kind in LOOSE]
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


VOTES = ["v0", "v1", "v2", "v3"]


def fit(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 50) -> dict:
    """From (kind, votes, size bucket, count): reliabilities by EM, then the classifier's log-odds.

    Returns {"prior": {kind: logit}, "weight": {(feature, kind, value): log-odds}, "reliability":
    {(labeler, kind): share of right votes}}."""
    by_pattern: dict[tuple, float] = defaultdict(float)
    for kind, votes, _, n in counts:
        by_pattern[kind, votes] += n
    # a start where labelers are right in 4 of 5 cases breaks the symmetry
    right = {(i, k): 0.8 for i in range(len(VOTES)) for k in range(len(ALL))}
    prior = {k: 0.5 for k in range(len(ALL))}
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, votes in by_pattern:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for i, v in enumerate(votes):
                if v:
                    r = right[i, kind]
                    yes += math.log(r if v > 0 else 1 - r)
                    no += math.log(r if v < 0 else 1 - r)
            post[kind, votes] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
        for k in range(len(ALL)):
            all_k = sum(n for (kind, _), n in by_pattern.items() if kind == k)
            prior[k] = (sum(n * post[p] for p, n in by_pattern.items() if p[0] == k) + 1) / (all_k + 2)
            for i in range(len(VOTES)):
                cast = [(p, n) for p, n in by_pattern.items() if p[0] == k and p[1][i]]
                good = sum(n * (post[p] if p[1][i] > 0 else 1 - post[p]) for p, n in cast)
                right[i, k] = min(0.99, max(0.51, (good + 4) / (sum(n for _, n in cast) + 5)))
    mass: dict[tuple, list[float]] = defaultdict(lambda: [1.0, 1.0])
    whole: dict[int, list[float]] = defaultdict(lambda: [2.0, 2.0])
    for kind, votes, size, n in counts:
        p = post[kind, votes]
        for key in [(*f, kind, v) for f, v in zip([(x,) for x in VOTES], votes, strict=True)] + [("size", kind, size)]:
            mass[key][0] += n * p
            mass[key][1] += n * (1 - p)
        whole[kind][0] += n * p
        whole[kind][1] += n * (1 - p)
    weight = {k: math.log(a / whole[k[1]][0]) - math.log(b / whole[k[1]][1]) for k, (a, b) in mass.items()}
    return {"prior": {k: math.log(a / b) for k, (a, b) in whole.items()}, "weight": weight, "reliability": right}


#: Log-odds from which a loose span is added.
SURE = 2.0


def _logit(model: dict, x: Column) -> Column:
    total = F.lit(0.0)
    for kind, value in model["prior"].items():
        total = total + F.when(x["kind"] == kind, value).otherwise(0.0)
    for (feature, kind, value), w in sorted(model["weight"].items()):
        total = total + F.when((x["kind"] == kind) & (x[feature] == value), w).otherwise(0.0)
    return total


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in whole texts (doc_id, text).

    Returns doc_id, base and added: arrays of (kind number in ALL, start, end) in code points, end
    exclusive, sorted by kind and start. Null text is empty; repeated rows have the same spans
    (and count again where reliabilities are estimated); very long texts are taken whole; an empty
    table gives no rows; other columns are ignored, whatever their names. Added spans never
    overlap base ones."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(candidates(docs), "candidates")
    each = found.select(F.explode("spans").alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in ("kind", *VOTES, "size")]).count()
    counts = [(r["kind"], tuple(r[v] for v in VOTES), r["size"], r["count"]) for r in each.collect()]
    model = fit(counts)
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda x: x["strict"] & (x["v0"] > 0)), bare)
    found = found.withColumn("base", F.array_sort(base))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    loose = F.filter("spans", lambda x: ~x["strict"])
    sure = F.filter(loose, lambda x: (_logit(model, x) >= SURE) & free(x))
    added = F.when(F.exists("spans", lambda x: ~x["strict"]), F.array_sort(F.transform(sure, bare)))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("doc_id", "base", F.coalesce(added, empty).alias("added"))


def _said(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda i: lambda x: x["kind"] == i
    n = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    secrets = F.size(F.filter("added", of(ALL.index("secret")))).cast("long")
    return rows.select("doc_id", *n, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.array_sort(F.concat("base", "added"))).alias("spans"),
                       secrets.alias("n_secret"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
