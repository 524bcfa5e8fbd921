"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest

from tesselon.llm import chat, decontaminate, jaccard, language, licenses, lines, packing, pii, registry, sharding, sketch
from tesselon.llm.common import words_by_row

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and wordless texts, ties, repeated rows, a long text."""
    base = " ".join(f"word{i % 97}x{i}" for i in range(80))
    return [
        (1, base, "en", "a", 1), (2, base, "en", None, None), (2, base, "en", None, None), (3, base + " more", None, "b", 2), (4, None, "fr", "b", None), (5, "", "de", "b", 0),
        (6, " \n\t ", None, "b", 3), (7, "...", "en", "b", 3), (8, "one", "en", "b", 3), (9, "One", "en", "b", 3), (None, base, "en", "b", 3), (None, None, None, None, None),
        (10, "long " * 60_000, "en", "b", 1), (11, "日本語 テキスト", "ja", "b", 1), (12, base + "\n" + base, "en", "b", 9),
    ]


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    """With columns whose names clash with those of the operators."""
    df = spark.createDataFrame(odd, DOC)
    for name in ("key", "d", "t", "score", "runs", "part", "ids", "spans", "shard", "g1", "u"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


# language ------------------------------------------------------------------------------------


def test_language_accuracy(spark, sf_dir):
    rows = language.op1_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd_docs, no_docs):
    found = language.learned(odd_docs)
    rows = language.predict(odd_docs, found).collect()
    assert len(rows) == 15 and {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 7)} == {"und"}
    assert [r.lang_pred for r in language.predict(odd_docs, {}).collect()] == ["und"] * 15
    assert language.predict(no_docs, language.learned(no_docs)).count() == 0
    assert language.keep_known(odd_docs).columns == odd_docs.columns


def test_prototypes_don_t_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    assert language.learn(docs.repartition(1)) == language.learn(docs.repartition(7))


def test_bundles_add_up():
    space = language.Space(1024, 3)
    a, b = "the cat sat", "on a mat"
    across = space.total(*space.grams(np.array([ord("t"), 0, ord("o")], np.uint32)))
    assert np.array_equal(space.bundle(a + ". " + b), space.bundle(a) + space.bundle(b) + across) and space.bundle("12 .") is None
    assert abs(space.letter(97) @ space.letter(98).astype(int)) < 150


# packing -------------------------------------------------------------------------------------


def held(rows, ids):
    """Pieces tile their documents and their sequences."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        whole = ids[doc]
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(whole) == pieces[0].doc_tokens
        for p in pieces:
            assert crc32(np.array(whole[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        size = sum(p.length for p in pieces)
        assert size == pieces[0].tier <= 2048 and size & (size - 1) == 0
    assert set(docs) == set(ids)


def test_packing_is_whole(spark, sf_dir, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in real.items()}
    held(packing.op2_packing(spark, sf_dir).collect(), ids)


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert [r.length for r in rows if r.doc_id in (4, 5)] == [1, 1] and packing.pack(no_docs).count() == 0
    steps = defaultdict(set)
    for r in rows:
        steps[r.step_group].add(r.tier)
    assert all(len(t) == 1 for t in steps.values())


def test_words_one_by_one_are_the_whole_text():
    bpe, rng = packing.ByteBpe(packing.default_tokenizer()), random.Random(2)
    assert bpe.fast is not None
    texts = ["", " ", "a  b", "a \n b", "\nx", "don't 's", "<|endoftext|> x <|endoftext|>", "é ü 日本", "a\x1cb c", "tab\tx y"]
    texts += ["".join(rng.choice("ab 1.\n\t'é<|>") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for t in texts:
        want = bpe.slow.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(bpe(t), "<u4").tolist() == want, t


# lines ---------------------------------------------------------------------------------------


def longest_copies(rows, least):
    """Lines to go: for each line the longest run from it that occurs at an earlier place, if it has enough words."""
    seqs = [[(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for _, t in rows]
    places = defaultdict(list)
    for d, s in enumerate(seqs):
        for j, (_, x) in enumerate(s):
            places[x].append((d, j))
    gone = []
    for d, s in enumerate(seqs):
        mine = set()
        for j in range(len(s)):
            best = 0
            for e, q in places[s[j][1]]:
                if (e, q) >= (d, j):
                    break
                n = 0
                while j + n < len(s) and q + n < len(seqs[e]) and s[j + n][1] == seqs[e][q + n][1]:
                    n += 1
                if sum(len(x.split()) for _, x in s[j : j + n]) >= least:
                    best = max(best, n)
            mine.update(s[j + k][0] for k in range(best))
        gone.append(mine)
    return gone


def test_line_copies(spark):
    rng = random.Random(3)
    pool = [f"w{k} " * rng.choice([1, 5, 20, 60]) for k in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(0, 30)))) for i in range(50)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (d, t), gone in zip(rows, longest_copies(rows, 50), strict=True):
        left = [x for i, x in enumerate(t.split("\n")) if i not in gone]
        assert got[d].n_removed == len(gone)
        assert got[d].text == (t if not gone else "\n".join(left) if any(x.strip() for x in left) else "")


def test_lines_of_odd_rows(odd_docs, no_docs):
    rows = {(r.doc_id, r.n_removed): r for r in lines.dedup_lines(odd_docs).collect()}
    assert rows[None, 0].text is None or rows[None, 0].doc_id is None
    assert rows[1, 1].text == "" and rows[2, 1].text == "" and rows[12, 2].text == "" and rows[4, 0].text is None and rows[5, 0].text == ""
    assert lines.dedup_lines(no_docs).count() == 0 and lines.without_copies(odd_docs).columns == odd_docs.columns


# Jaccard -------------------------------------------------------------------------------------


def classes(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up, links, ids = {i: i for i in sets}, dict.fromkeys(sets, 0), sorted(sets)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
                links[x] += 1
                links[y] += 1
    return {i: (len(sets[i]), root(i), links[i]) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_join_loses_no_link(spark, real, k, percent):
    rng, texts = random.Random(4), dict(real)
    base = [f"t{rng.randint(0, 500)}" for _ in range(150)]
    for i in range(120):  # a family whose members differ by a few words each, and tiny texts
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
        texts[10_000 + i] = " ".join(w)
        texts[20_000 + i] = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_classes(df, words=k, percent=percent).collect()}
    assert got == classes(texts, k, percent)


def test_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 500)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    texts = {}
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"e{i}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_classes(df, words=3, percent=90).collect()}
    assert got == classes(texts, 3, 90)


def test_signatures_meet():
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 40, 100, 333, 1500):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for _ in range(15):
                drop = int(len(a) * (100 - percent) / (100 + percent))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, drop if rng.random() < 0.7 else 0).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))


def test_join_of_odd_rows(odd_docs, no_docs):
    rows = jaccard.similar_classes(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 15 and by[2].component_id == by[3].component_id == 1 and by[8].component_id == by[9].component_id == 8
    assert by[5].n_shingles == by[6].n_shingles == 0 and by[5].component_id == 5
    left = jaccard.one_per_class(odd_docs)
    assert left.columns == odd_docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 10, 11]
    assert jaccard.similar_classes(no_docs).count() == 0


# personal data -------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_personal_data(spark, sf_dir, real, tmp_path):
    rng = random.Random(5)
    texts = ["a@b.c_d@e.f x.y@z.q.w@k.l", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1", "4111 1111 1111 1111-4111111111111111", "+1 (555) 123-4567 +49 30 1234567+33 1 22 33 44 55",
             "é@é.com éa@b.co", None, "", " ".join(f"u{i}@m{i}.org" for i in range(700)), "x" * 50_000, "1" * 50_000, "1.2." * 3000, "+1 " * 2000, "@.@..@a.b" * 50]
    texts += ["".join(rng.choice("a1@.+- (_%4") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + d, t) for d, t in real.items()]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op5_pii(spark, str(tmp_path)).collect()}
    for d, t in rows:
        want = base_spans(t)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_method_adds_announced_numbers(spark, no_docs):
    rows = [(i, f"Please call our phone 555-01{i % 10}-{1000 + i} today, or +1 555 010 {1000 + i}.") for i in range(40)] + [(99, "row 555-010-1234 of the table")]
    found = {r.doc_id: r.added for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[i]) == 1 for i in range(40)) and not found[99] and pii.find(no_docs).count() == 0


# sketches ------------------------------------------------------------------------------------


def test_sketches(spark, sf_dir, real):
    rows = {r.doc_id: r for r in sketch.op6_sketch(spark, sf_dir).collect()}
    ids = sorted(real, reverse=True)
    errors = []
    for d, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        cut = len(real[d]) // 3
        new = real[d][: len(real[d]) - cut] + real[after][:cut]
        assert rows[d].n_chars == len(real[d]) and rows[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors.append(abs(rows[d].near_edited - similarity(shingles(real[d], 5), shingles(new, 5))))
        assert abs(rows[d].near_next - similarity(shingles(real[d], 5), shingles(real[after], 5))) < 0.15
    assert len(rows) == len(real) and np.mean(errors) < 0.03


def test_sketches_merge():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    sa, sb, both = (sketch.sketch(x, size=1) for x in (a, b, np.concatenate([a, b])))
    assert np.array_equal(sketch.merge(sa, sb), both) and np.array_equal(sketch.decode(sketch.encode(sa)), sa)
    assert abs(sketch.distinct(both) / 5000 - 1) < 0.2 and sketch.resemblance(sa, sa) == 1.0
    assert abs(sketch.containment(sa, both) - 1) < 0.2 and sketch.resemblance(sa[:0], sa[:0]) == 1.0 and sketch.resemblance(sa[:0], sa) == 0.0


def test_sketches_of_odd_rows(odd_docs, no_docs):
    rows = sketch.edited_pairs(odd_docs).collect()
    assert len(rows) == 15 and len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1 and {r.fingerprint for r in rows if r.doc_id in (4, 5, 6)} == {""}
    assert sketch.edited_pairs(no_docs).count() == 0 and sketch.fingerprints(odd_docs).count() == 15


# decontamination -----------------------------------------------------------------------------


def test_leaks_with_substitutions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = {i: [word() for _ in range(30)] for i in range(20)} | {50: ["tiny", "but", "whole", "item"], 51: ["too", "short"], 52: []}
    docs, want = [], set()
    for d in range(200):
        text = [word() for _ in range(rng.randint(0, 120))]
        if d % 4 == 0:
            i = rng.randrange(20)
            part = items[i][rng.randint(0, 10) :]
            if d % 8 == 0:  # every seventh word another one
                part = [word() if k % 7 == 3 else w for k, w in enumerate(part)]
            at = rng.randint(0, len(text))
            text[at:at] = part
            want.add((d, i))
        docs.append((d, " ".join(text).upper()))
    docs += [(500, "xx tiny but whole item yy"), (501, None), (502, ""), (503, "too short"), (None, " ".join(items[3])), (500, "xx tiny but whole item yy")]
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(60, None), (3, " ".join(items[3]))]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = decontaminate.overlaps(df, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want | {(500, 50), (503, 51), (None, 3)}  # short items count too
    assert all(r.matches <= r.words and r.doc_start >= 0 for r in rows)
    left = decontaminate.without_leaks(df, b)
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d in range(200)} - {d for d, _ in want} | {501, 502})
    assert decontaminate.overlaps(df.limit(0), b).count() == 0 and decontaminate.overlaps(df, b.limit(0)).count() == 0


def test_real_passages(spark, sf_dir, real):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.op7_decontaminate(spark, sf_dir).collect()}
    assert {(d, i) for d, t in real.items() for i, q in items.items() if q in t} <= found


# sharding ------------------------------------------------------------------------------------


def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(n))


def test_shards(spark, sf_dir, real):
    rows = sharding.op8_sharding(spark, sf_dir).collect()
    check_shards(rows, 40)
    assert all(r.text_crc32 == crc32(real[r.doc_id].encode()) and r["size"] == len(real[r.doc_id].encode()) + 16 for r in rows) and len(rows) == len(real)


def test_groups_stay_together(spark, odd_docs, no_docs):
    rows = [(i, f"text {i // 4 if i < 800 else i}") for i in range(1200)] + [(2000 + i, "hot") for i in range(500)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    check_shards(found, 4)
    where = defaultdict(set)
    for r in found:
        where[r.text_crc32].add(r.shard)
    small = [len(where[crc32(f"text {g}".encode())]) for g in range(200)]
    assert sum(s == 1 for s in small) > 100  # by chance, about 3
    check_shards(sharding.shard(odd_docs, shards=3).collect(), 3)
    links = spark.createDataFrame([(i, i // 8) for i in range(160)], "doc_id long, group long")
    joined = sharding.shard(spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string"), shards=4, links=links).collect()
    check_shards(joined, 4)
    assert sum(len({r.shard for r in joined if r.doc_id // 8 == g}) == 1 for g in range(20)) > 10
    assert sharding.shard(no_docs).count() == 0


# chats ---------------------------------------------------------------------------------------


def test_chats_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cur = con.execute(registry.oracle_sql()["op9_chat"])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in chat.op9_chat(spark, sf_dir).collect()) == sorted(cur.fetchall())


def test_template_is_reversible():
    rng = random.Random(9)
    for _ in range(2000):
        turns = [("".join(rng.choice("ab<|\\%\n") for _ in range(rng.randint(0, 6))), "".join(rng.choice(["<|", "\\", "|>", "<|im_end|>\n", "<|im_start|>", "a", "<", "\n"]) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        assert chat.read("".join(chat.render(*t)[0] for t in turns)) == turns


def test_layouts():
    turns = [("user", "q"), ("assistant", "a")]
    for record in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
                   {"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a"}, {"input": {"text": "q"}, "target": {"text": "a"}}):
        assert chat.canonical(record)[1] == turns
    assert chat.canonical({"system": "s", "prompt": "q", "completion": "a"})[1] == [("system", "s"), *turns]
    assert chat.canonical({"else": 1}) == (None, []) and chat.canonical({"messages": []}) == ("messages", [])


def test_chats_in_parts(spark, monkeypatch):
    rows = [(1, i, f'{{"role": "assistant", "text": "{"x" * 10}{i}"}}') for i in range(50)] + [(None, 0, '{"odd": 1}'), (2, 0, None), (3, None, '{"prompt": "p", "completion": "c"}')]
    df = spark.createDataFrame(rows, "conv_id long, turn int, record string")
    monkeypatch.setattr(chat, "PART_CHARS", 300)
    found = chat.format_chats(df, "turn").collect()
    one = sorted((r for r in found if r.conv_id == 1), key=lambda r: r.part)
    assert [t for r in one for _, t in chat.read(r.formatted)] == ["x" * 10 + str(i) for i in range(50)]
    assert {r.conv_id: r.layout for r in found} == {1: "turn row", None: None, 2: None, 3: "prompt"}
    assert chat.format_chats(df.limit(0), "turn").count() == 0


# licences ------------------------------------------------------------------------------------


def test_licences(spark, odd_docs):
    s = {k: v[0] for k, v in licenses.SENTENCES.items()}
    mit = "\n\n".join(["MIT License", s["mit-grant"], s["mit-condition"], s["mit-warranty"]])
    texts = [mit, mit.replace("person obtaining", "person\nobtaining"), "\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
             "\n".join(s[k] for k in ("bsd-grant", "bsd-binary", "bsd-source")), "words before.\nLicensed under CC BY-NC 4.0. And after", "We have a licence to thrill.", None, "",
             s["mit-notice"] + " " + s["apache-2-notice"]]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in rows} == {(0, "MIT"), (1, "MIT"), (2, "BSD-3-Clause"), (4, "CC-BY-NC-4.0"), (8, "MIT"), (8, "Apache-2.0")}
    assert licenses.scan(odd_docs).count() == 0 and all(any(m in x.lower() for m in licenses.MAY) for v in licenses.SENTENCES.values() for x in v)


def test_licence_notices_in_real_texts(spark, sf_dir, real):
    found = defaultdict(set)
    for r in licenses.op10_licenses(spark, sf_dir).collect():
        found[r.license].add(r.doc_id)
    for said, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
        assert found[name] == {d for d, t in real.items() if said in t}


# shared --------------------------------------------------------------------------------------


def test_word_hashes_are_those_of_words(monkeypatch):
    import pyarrow as pa

    from tesselon.llm import common

    rng = random.Random(10)
    texts = [None, "", " a", "A b\tC\x0b", "é" * 50, *["".join(rng.choice("aB é\n") for _ in range(rng.randint(0, 200))) for _ in range(60)]]
    one = [list(x) for x in words_by_row(pa.array(texts))]
    alone = {w: next(words_by_row(pa.array([w])))[0] for t in texts if t for w in words(t)}
    assert one == [[alone[w] for w in words(t)] for t in texts] and len(set(alone.values())) == len(alone)
    monkeypatch.setattr(common, "_SEGMENT", 16)  # long texts by segments, words across their ends
    assert [list(x) for x in words_by_row(pa.array(texts))] == one


def test_a_text_is_encoded_in_one_call():
    class Counted:
        def __init__(self, fast):
            self.fast, self.calls = fast, 0

        def encode_ordinary(self, text):
            self.calls += 1
            return self.fast.encode_ordinary(text)

    bpe = packing.ByteBpe(packing.default_tokenizer())
    want = bpe.slow.encode("one two  three\nfour five six", add_special_tokens=False).ids
    bpe.fast = Counted(bpe.fast)
    assert bpe("one two  three\nfour five six") == b"".join(i.to_bytes(4, "little") for i in want) and bpe.fast.calls == 1
