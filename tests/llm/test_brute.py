"""Fingerprints, licences, shards and personal data against plain counterparts."""

import base64
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tesselon.llm import common, licenses, pii, sharding, sketch

_M = (1 << 64) - 1


# fingerprints --------------------------------------------------------------------------------


def _mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def least_hashes(text, k=256, size=5):
    """The k least 48-bit hashes of all shingles, each made by itself."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    base = common._BASE & _M
    hashes = [_mix(sum((b + 33 if 65 <= b <= 90 else b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w)) & _M) for w in words]
    n = min(size, len(words))
    places = [int(p) for p in common._PLACES]
    shingle = lambda i: sum(hashes[i + j] * places[j] for j in range(n)) & _M
    found = {_mix(shingle(i) ^ n) >> 16 for i in range(len(words) - n + 1)} if words else set()
    return sorted(found)[:k]


def test_fingerprints_are_the_least_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.length("text") < 20_000)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "One"), (-4, "one two"), (-5, "É Ünï\tcode\x0bwords  and\nmore"), (-6, "a b c d e " * 90)], "doc_id long, text string")
    rows = docs.union(odd).collect()
    got = {r.doc_id: r.fingerprint for r in sketch.fingerprints(docs.union(odd)).collect()}
    for r in rows:
        raw = base64.b64decode(got[r.doc_id])
        assert [int.from_bytes(raw[i : i + 6], "big") for i in range(0, len(raw), 6)] == least_hashes(r.text)


# licences ------------------------------------------------------------------------------------


def matches(sequence, rule):
    """(first, last) of a rule in a text's known sentences (place, id): from each place on the nearest next sentence that lets the rest match,
    with GAP known ones between at most and no gap of places beyond FAR; one match behind the other."""
    name, licence, ids = rule

    def rest(at, left):
        if not left:
            return at
        for step in range(1, licenses.GAP + 2):
            to = at + step
            if to >= len(sequence) or any(sequence[i][0] - sequence[i - 1][0] > licenses.FAR for i in range(at + 1, to + 1)):
                return None
            if sequence[to][1] == left[0] and (end := rest(to, left[1:])) is not None:
                return end
        return None

    out, at = [], 0
    while at < len(sequence):
        end = rest(at, ids[1:]) if sequence[at][1] == ids[0] else None
        if end is not None:
            out.append((sequence[at][0], sequence[end][0]))
        at = at + 1 if end is None else end + 1
    return out


def scanned(text):
    """{licence: (rules, matches, sentences of the longest rule, first place)} by looking at each sentence."""
    known = {licenses.normal(s): k for k, said in licenses.SENTENCES.items() for s in said}
    stop = r"(?:(?<=[.!?;])|(?<=[.!?;][\"')\]])|(?<=[.!?;][\"')\]]{2}))\s+"
    ways = []
    for line in (r"\s*\n\s*", r"\s*\n\s*\n\s*"):
        parts = re.split(f"{stop}|{line}", (text or "").lower())
        sequence = [(i, known[licenses.normal(s)]) for i, s in enumerate(parts) if licenses.normal(s) in known and any(w in s for w in licenses.MAY)]
        found = [(r, a, b) for r in licenses.RULES for a, b in matches(sequence, r)]
        ways.append([x for x in found if not any(len(y[0][2]) > len(x[0][2]) and y[1] <= x[1] and x[2] <= y[2] for y in found)])
    part = lambda x, y: x[0][1] == y[0][1] and set(x[0][2]) < set(y[0][2])
    lines = [x for x in ways[0] if not any(part(x, y) for y in ways[1])]
    more = [x for x in ways[1] if not any(x[0][0] == y[0][0] or part(x, y) for y in ways[0])]
    out = defaultdict(list)
    for x in lines + more:
        out[x[0][1]].append(x)
    return {k: (",".join(sorted({x[0][0] for x in v})), len(v), max(len(x[0][2]) for x in v), min(x[1] for x in v)) for k, v in out.items()}


def test_licences_by_sentences(spark, sf_dir):
    rng, texts = random.Random(3), {}
    said = {k: v for k, v in licenses.SENTENCES.items()}
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            rule = rng.choice(licenses.RULES)[2]
            for k in rule:
                if rng.random() < 0.9:
                    parts.append(rng.choice(said[k]))
                if rng.random() < 0.15:
                    parts.append(rng.choice(said[rng.choice(list(said))]))
                parts += ["Plain words stand here."] * (rng.choice([0, 0, 0, 1, 3, 14]) if rng.random() < 0.3 else 0)
        texts[i] = rng.choice(["\n", "\n\n", " "]).join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.length("text") < 50_000)
    for table in (docs, real):
        want = {(r.doc_id, k): v for r in table.collect() for k, v in scanned(r.text).items()}
        got = {(r.doc_id, r.license): (r.rules, r.n_matches, r.n_sentences, r.first_sentence) for r in licenses.scan(table).collect()}
        assert got == want and want


# shards --------------------------------------------------------------------------------------


def cut(groups, shard):
    """Pairs of documents of a group that lie in different shards."""
    total = 0
    for members in groups:
        held = Counter(shard[d] for d in members)
        total += (len(members) ** 2 - sum(n * n for n in held.values())) // 2
    return total


def plain_propagation(groups, docs, shards, rng):
    """Each document in turn moves to the shard with most of its group that has room, until none does."""
    shard = {d: rng.randrange(shards) for d in docs}
    quota, load = -(-len(docs) // shards), Counter(shard.values())
    for _ in range(30):
        moved = False
        for members in groups:
            for d in members:
                held = Counter(shard[x] for x in members)
                best = max(held, key=lambda s: (held[s], -s))
                if held[best] > held[shard[d]] and load[best] < quota:
                    load[shard[d]] -= 1
                    load[best] += 1
                    shard[d], moved = best, True
        if not moved:
            break
    return shard


def test_no_more_cut_edges_than_plain_propagation(spark):
    rng = random.Random(5)
    docs = list(range(900))
    rng.shuffle(docs)
    groups, at = [], 0
    while at < 700:  # the last 200 stand alone
        n = rng.choice([2, 3, 5, 9, 20])
        groups.append(docs[at : at + n])
        at += n
    table = spark.createDataFrame([(i, f"text {i}") for i in range(900)], "doc_id long, text string")
    links = spark.createDataFrame([(d, g) for g, members in enumerate(groups) for d in members], "doc_id long, group long")
    found = sharding.shard(table, shards=6, links=links).collect()
    own = cut(groups, {r.doc_id: r.shard for r in found})
    plain = min(cut(groups, plain_propagation(groups, docs, 6, random.Random(s))) for s in range(5))
    assert own <= plain and {n for n in Counter(r.shard for r in found).values()} == {150}


# personal data -------------------------------------------------------------------------------


def test_planted_spans_are_found(spark, sf_dir):
    """Of secrets, written-out addresses and telephone numbers planted in documents at least nine in ten are found."""
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").where(F.length("text").between(200, 4000)).collect()]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    kinds = {
        "secret": lambda: rng.choice([f"AKIA{mixed(16).upper()}", f"ghp_{mixed(36)}", f"password: {mixed(14)}", f"api_key = {mixed(28)}"]),
        "address": lambda: rng.choice(["{} [at] {} [dot] com", "contact: {}(at){}(dot)org", "mail {} (at) {} (dot) net", "{}@{} [dot] de"]).format(letters(7), letters(8)),
        "phone": lambda: f"phone: ({digits(3)}) {digits(3)}-{digits(4)}",
    }
    rows, planted = [], {}
    for i, text in enumerate(texts):
        kind = list(kinds)[i % 3]
        words = text.split(" ")
        cut_at = rng.randrange(len(words))
        before, said = " ".join(words[:cut_at]), kinds[kind]()
        planted[i] = (kind, len(before) + 1, len(before) + 1 + len(said))
        rows.append((i, f"{before} {said} " + " ".join(words[cut_at:])))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = Counter()
    for r in found:
        kind, low, high = planted[r.doc_id]
        hit[kind] += any(x.start < high and x.end > low for x in [*r.base, *r.added])
    of = Counter(k for k, *_ in planted.values())
    assert all(hit[k] >= 0.9 * of[k] for k in kinds), (hit, of)
