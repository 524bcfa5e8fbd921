"""Beyond what used to be limits: long texts, large sums and groups, repeated and extreme ids, clashing names, short items."""

import hashlib
import json
import random
import textwrap
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tesselon.llm import chat, decontaminate, jaccard, language, licenses, lines, packing, pii, sharding, sketch
from tesselon.llm.common import shingle_hashes, words_by_row
from tests.llm.test_operators import DOC, check_shards, classes, shingles

LOW, HIGH = -(1 << 63), (1 << 63) - 1


# language ------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_pieces_give_the_bundle_of_the_whole(monkeypatch, size):
    space, rng = language.Space(256, 3), random.Random(1)
    texts = ["a", "ab", " a", "a ", "12", "", "  ", *["".join(rng.choice("abc .1é") for _ in range(rng.randint(0, 60))) for _ in range(60)]]
    want = [space.bundle(t) for t in texts]
    monkeypatch.setattr(language, "CHUNK", size)
    for t, w in zip(texts, want, strict=True):
        got = space.bundle(t)
        assert (got is None and w is None) or np.array_equal(got, w), t


def test_bundle_of_three_million_characters():
    space = language.Space(256, 3)
    text = "the cat sat on a mat. " * 140_000
    symbols = np.concatenate([[0], language.Letters.symbols(text)])
    codes, counts = space.grams(symbols)
    want = counts @ space.vectors(codes).astype(np.int64)
    assert len(text) > 3_000_000 and np.array_equal(space.bundle(text), want)


def test_large_sums_are_exact():
    space, rng = language.Space(128, 3), np.random.default_rng(3)
    codes = space.grams(rng.integers(97, 123, 5000).astype(np.uint32))[0]
    counts = rng.integers(20_000_000, 40_000_000, len(codes))
    assert np.array_equal(space.total(codes, counts), counts @ space.vectors(codes).astype(np.int64))


def test_prediction_same_as_brute_force(spark):
    """Letter by letter, n-gram by n-gram, in plain sums."""
    rng = random.Random(4)
    draw = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, draw("abcdef" if i % 2 else "cdefgh", 20), "xy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    space = language.Space(1024, 3)

    def plain(text):
        s = [0, *(ord(c) if c.isalpha() else 0 for c in text), 0]
        s = [c for i, c in enumerate(s) if c or i == 0 or s[i - 1]]
        letter = lambda p, k: np.roll(space.letter(p).astype(int), k)
        return sum(letter(s[i], 2) * letter(s[i + 1], 1) * letter(s[i + 2], 0) for i in range(len(s) - 2))

    held = {i for i, _, _ in rows if crc32(str(i).encode()) % 3 == 1}
    proto = {lang: sum(plain(t) for i, t, x in rows if x == lang and i not in held) for lang in "xy"}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for r in language.predict(df, language.learned(df)).collect():
        scores = {k: cos(v, plain(rows[r.doc_id][1])) for k, v in proto.items()}
        assert r.lang_pred == max(scores, key=scores.get) and abs(r.score - max(0, max(scores.values()))) < 1e-9


# packing -------------------------------------------------------------------------------------


def test_special_tokens_and_even_steps(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(2)
    texts = ["a <|endoftext|> b", "<|endoftext|>", *[" ".join(rng.choice("red green blue").strip() + str(i) for _ in range(rng.randint(1, 900))) for i in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = packing.pack(df, step_tokens=8192).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in enumerate(texts)}
    assert t.encode(texts[0], add_special_tokens=False).ids[2] == 50256
    steps, tiers = defaultdict(set), defaultdict(set)
    for r in rows:
        steps[r.step_group].add(r.sequence_id)
        tiers[r.tier].add(r.step_group)
    for tier, groups in tiers.items():
        sizes = [len(steps[g]) for g in groups]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= max(8192, tier)
    full = sum(r.length for r in rows if r.tier == 2048) / sum(r.length for r in rows)
    assert full > 0.9  # what is left at the ends of six partitions


# lines ---------------------------------------------------------------------------------------


def test_maximal_runs_and_names(spark):
    first = "\n".join(f"line {i} has some words of its own here" for i in range(20))
    rows = [(LOW, "x\n" + first), (7, "y\n" + "\n".join(first.split("\n")[3:17]) + "\nz"), (HIGH, first)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("t_", "d_", "runs_", "doc_at", "text_at", "runs_at", "l", "r", "rank"):
        df = df.selectExpr("*", f"doc_id AS {c}")
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert out[LOW].n_removed == 0 and out[7].text == "y\nz" and out[HIGH].text == ""
    assert [r.asDict() for r in out[7].removed_runs] == [{"line": 1, "lines": 14, "first_doc": None, "first_line": 4}]
    assert [(r["line"], r["lines"]) for r in out[HIGH].removed_runs] == [(0, 20)]
    assert all(out[d][c] == d for d in out for c in ("t_", "d_", "runs_", "doc_at", "rank"))
    assert lines.without_copies(df).columns == df.columns


# join ----------------------------------------------------------------------------------------


def test_repeated_ids_are_one_vertex(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(5, a), (5, b), (3, b), (9, a), (5, ""), (5, a), (None, a), (LOW, "only one"), (HIGH, "only one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_classes(df).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 3), (3, 3), (9, 3), (None, None), (LOW, LOW), (HIGH, LOW)} and len(found) == len(rows)
    df = df.selectExpr("*", "doc_id AS turn_", "'x' AS at", "1 AS text_at", "2 AS first", "3 AS label")
    left = jaccard.one_per_class(df)
    # one row for each class of texts; the row without words and that without doc_id stay
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, a), (3, b), (5, ""), (None, a), (LOW, "only one")], key=str)


def test_spare_signatures_lose_no_pair():
    """Sets at the very edge of the similarity, among others that share half of their features."""
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        for n in (3, 8, 17, 60, 240):
            common = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            sets = [np.unique(np.concatenate([common[: n // 2], rng.integers(0, 1 << 63, n - n // 2).astype(np.uint64)])) for _ in range(12)]
            for s in list(sets):
                k = len(s) * (100 - percent) // (100 + percent)
                sets.append(np.unique(np.concatenate([rng.permutation(s)[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])))
            sigs = [jaccard.signatures(s, percent) for s in sets]
            shared = Counter(x for s in sigs for x in s.tolist())
            left = []
            for s, own in zip(sets, sigs, strict=True):
                keep = set()
                for level, late in enumerate(jaccard.late_spare(len(s), percent)):
                    mine = sorted((x for x in own.tolist() if x & 1 == level and shared[x] > 1), key=lambda x: (-shared[x], x - (1 << 64) if x >> 63 else x))
                    keep |= set(mine[late:])
                left.append(keep)
            for i, s in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(s, sets[j]))
                    if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                        assert left[i] & left[j]


def test_join_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 200)
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 400)
    rng, base = random.Random(6), [f"t{i}" for i in range(60)]
    texts = {i: " ".join(f"e{i}" if rng.random() < 0.03 else w for w in base) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_classes(df).collect()} == classes(texts, 5, 80)


# personal data -------------------------------------------------------------------------------


def test_secrets_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = [lambda: f'token = "{hexes(40)}"', lambda: f"password={hexes(16)}", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJK0123456789") for _ in range(16)), lambda: f"api_key: {hexes(32)}"]
    rows = [(i, f"some words and {made[i % 4]()} more words") for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(["the password: remember", "tokens are small", "secret: nothing", "AKIA", "token", "keys"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("spans", "x", "digit_", "m_", "email", "loose_secret"):
        df = df.selectExpr("*", f"'y' AS {c}")
    found = {r.doc_id: [(s.kind, rows_text[s.start : s.end]) for s in r.added] for r in pii.find(df.union(df.limit(1))).collect() for rows_text in [dict(rows)[r.doc_id]]}
    assert sum(bool(found[i]) for i in range(200)) / 200 >= 0.9
    assert not any(found[d] for d, _ in rows if d >= 1000)
    assert all(k == 4 and v in dict(rows)[i] for i in range(200) for k, v in found[i])


def test_reliabilities_against_known_ones():
    """Votes drawn with known reliabilities: EM finds them, and the truth, without seeing it."""
    rng = random.Random(7)
    right, counts, truth = [0.95, 0.8, 0.7, 0.9], Counter(), Counter()
    for _ in range(20_000):
        yes = rng.random() < 0.6
        votes = tuple((1 if yes else -1) * (1 if rng.random() < p else -1) for p in right)
        counts[votes] += 1
        truth[votes] += yes
    model = pii.fit([(3, v, 1, n) for v, n in counts.items()])
    assert all(abs(model["reliability"][i, 3] - p) < 0.03 for i, p in enumerate(right))
    best = sum(max(truth[v], n - truth[v]) for v, n in counts.items())
    logit = lambda v: model["prior"][3] + sum(model["weight"][f, 3, x] for f, x in zip(pii.VOTES, v, strict=True)) + model["weight"]["size", 3, 1]
    ours = sum(truth[v] if logit(v) > 0 else n - truth[v] for v, n in counts.items())
    assert ours > 0.99 * best


# sketches ------------------------------------------------------------------------------------


def test_sketches_of_extreme_ids(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 400)))
    ids = [LOW, LOW + 1, -5, *range(0, 60), 1 << 60, HIGH]
    rows = [(d, text()) for d in ids] + [(None, "last one"), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0) if r[0] is not None else 0, r[1] or ""))
    want = []
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(t) // 3
        want.append((d, t, t[: len(t) - cut] + after[:cut], after))
    parts = sketch.neighbours(df, bytes_per_range=2000)
    assert parts.select("part").distinct().count() > 5 and parts.groupBy("part").count().agg({"count": "max"}).first()[0] < 40
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in sketch.edited_pairs(df).collect())
    def least(t):  # the k least hashes of all, sorted in full
        found = sorted({int(h) >> 16 for h in shingle_hashes(next(words_by_row(pa.array([t]))), 5)})
        return sketch.encode(np.array(found[: sketch.K], np.uint64))

    assert got == Counter((d, len(t), hashlib.sha256(new.encode()).hexdigest(), least(t)) for d, t, new, _ in want)


def test_sketches_of_one_row_and_none(spark):
    one = sketch.edited_pairs(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].in_next == 1.0 and one[0].n_shingles == 2.0
    assert sketch.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# decontamination -----------------------------------------------------------------------------


def test_short_items_and_clashing_names(spark):
    bench = spark.createDataFrame([(1, "zork"), (2, "quux blip"), (3, "one two three"), (4, ""), (5, " \n"), (6, None)], "item_id long, text string")
    docs = [(1, "a Zork here"), (2, "quux\nblip"), (3, "quux a blip"), (4, "one two four"), (5, "say one two three now"), (6, ""), (7, None), (8, " "), (1, "nothing"), (None, "zork")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS ids", "'y' AS seed", "'z' AS dk", "1 AS tk", "2 AS text_key", "3 AS at", "4 AS b")
    found = {(r.doc_id, r.item_id, r.doc_start, r.words) for r in decontaminate.overlaps(df.union(df), bench).collect()}
    assert found == {(1, 1, 1, 1), (2, 2, 0, 2), (5, 3, 1, 3), (None, 1, 0, 1)}
    left = decontaminate.without_leaks(df, bench)
    assert left.columns == df.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([d for d in docs if d not in [docs[0], docs[1], docs[4], docs[9]]], key=str)
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == len(docs) and decontaminate.without_leaks(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2, 0.3])
def test_recall_under_substitutions(spark, share):
    rng = random.Random(int(share * 10))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(20)]
    docs = [[word() for _ in range(15)] + [word() if rng.random() < share else w for w in items[i % 20]] + [word() for _ in range(15)] for i in range(100)]
    docs += [[word() for _ in range(80)] for _ in range(50)]
    frame = lambda rows, k: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{k} long, text string")
    found = {r.doc_id for r in decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert len(found & set(range(100))) >= (95 if share == 0.3 else 100) and not found & set(range(100, 150))


def test_recall_under_insertions(spark):
    """Words put between others: what is left whole between two of them still counts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(10)]
    docs = []
    for i in range(60):
        said = list(items[i % 10])
        for _ in range(3):  # four parts of 40 words: one has ten or more
            said.insert(rng.randrange(len(said)), word())
        docs.append([word() for _ in range(10)] + said)
    frame = lambda rows, k: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{k} long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert found == {(i, i % 10) for i in range(60)}


# sharding ------------------------------------------------------------------------------------


@pytest.mark.parametrize("held", [0.5, 0.85])
def test_a_huge_group_lies_in_few_shards(spark, held):
    n = 4000
    rows = [(i, "hot" if i < held * n else f"t{i // 3}") for i in range(n)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(found, 40)
    where = defaultdict(set)
    for r in found:
        where[r.text_crc32].add(r.shard)
    most = max(where.values(), key=len)
    assert len(most) <= held * 40 + 1
    # far fewer groups are cut than by hash, where nearly all are
    small = [s for s in where.values() if s is not most]
    assert sum(len(s) > 1 for s in small) < 0.35 * len(small)


def test_shards_of_groups_only(spark):
    for n, shards in ((5, 3), (7, 40), (40, 40), (41, 40), (1, 3)):
        found = sharding.shard(spark.createDataFrame([(i, "same") for i in range(n)], "doc_id long, text string"), shards=shards).collect()
        check_shards(found, shards)
        assert len(found) == n


def test_links_of_several_groups_are_all_kept(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    links = spark.createDataFrame([(i, i // 2) for i in range(20)] + [(i, 100 + (i + 1) // 2) for i in range(20)], "doc_id long, group long")
    found = sharding.shard(docs, shards=4, links=links).collect()
    check_shards(found, 4)
    assert {r.members for r in found if r.doc_id < 20} == {20} and len({r.shard for r in found if r.doc_id < 20}) == 1


# chats ---------------------------------------------------------------------------------------


def test_unknown_records_are_kept_aside(spark):
    said = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a", "weight": 2}, {"else": 1}, {"messages": [{"role": "user", "content": "m", "id": 3}], "source": "s"}]
    rows = [(1, i, json.dumps(r)) for i, r in enumerate(said)] + [(1, 9, "{broken"), (1, 10, None)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, record string"), "turn").collect()
    assert len(out) == 1 and chat.read(out[0].formatted) == [("user", "q"), ("assistant", "a"), ("user", "m")]
    assert [r.record for r in out[0].rejects] == [json.dumps(said[2]), "{broken", None] and all(r.fingerprint for r in out[0].rejects)
    assert [out[0].formatted[s.start : s.end] for s in out[0].loss] == ["a"]


# licences ------------------------------------------------------------------------------------


def test_every_rule_matches_its_own_text(spark):
    """A text with a rule's sentences, wrapped at 60 characters, gives the rule's licence; brute force over sentences agrees."""
    said = licenses.SENTENCES
    texts = {i: "\n\n".join(textwrap.fill(said[k][-1], 60) for k in rule[2]) for i, rule in enumerate(licenses.RULES)}
    df = spark.createDataFrame([*texts.items(), (900, "plain words, a permit and a licence to fish"), (901, "")], "doc_id long, text string")
    for c in ("low", "q", "q0", "q1", "all", "own", "license"):
        df = df.selectExpr("*", f"'x' AS {c}")
    found = defaultdict(set)
    for r in licenses.scan(df).collect():
        found[r.doc_id] |= {r.license}
    assert all(licenses.RULES[i][1] in found[i] for i in texts) and not found[900] and not found[901]
    assert licenses.scan(df.limit(0)).count() == 0


def test_usual_headers(spark):
    apache = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
    gpl = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    rows = licenses.scan(spark.createDataFrame([(1, apache), (2, gpl)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rules) for r in rows} == {(1, "apache-2.0-header"), (2, "gpl-2.0-header")}


# pipeline ------------------------------------------------------------------------------------


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    base = " ".join(f"word{i % 97}x{i}" for i in range(80))
    odd = [(1, base, "en", "a", 1), (2, base, "en", None, None), (2, base, "en", None, None), (4, None, "fr", "b", None), (5, "", "de", "b", 0), (6, " \n\t ", None, "b", 3),
           (8, "one", "en", "b", 3), (None, base, "en", "b", 3), (None, None, None, None, None), (10, "long " * 60_000, "en", "b", 1), (LOW, "seven words that are only here now", "en", "b", 1)]
    spark.createDataFrame([(1, "some item of the benchmark that is nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, rows in enumerate((odd, [])):
        docs = spark.createDataFrame(rows, DOC)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pack":
                assert out.schema.simpleString() == docs.schema.simpleString()
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            left = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert left.count() <= docs.count() or name == "pack"
            docs = left if name != "pack" else docs
        assert bool(left.count()) == bool(rows)
        spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{k}").count() == left.count()


def test_texts_that_repeat_shingles(spark):
    """A class with links but no equal texts, against sets."""
    texts = {1: "a b c d e f g h i j " * 3, 2: "a b c d e f g h i j " * 4, 3: "other words entirely"}
    assert shingles(texts[1], 5) == shingles(texts[2], 5)
    found = {r.doc_id: r.component_id for r in jaccard.similar_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
