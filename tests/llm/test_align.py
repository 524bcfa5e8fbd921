"""Alignment of two tokenizers against pairs of tokens by byte ranges."""

import json
import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tesselon.llm import align

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def plain():
    path_a, path_b = align.default_tokenizers()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in shown.values()]
    shown |= {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = {i: bytes(shown[c] for c in t) for t, i in json.load(open(path_a, encoding="utf-8"))["model"]["vocab"].items() if all(c in shown for c in t)}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        """(A ids, B ids) as (id, start, end)."""
        out = []
        for ids, name in ((a.encode(" " + text, add_special_tokens=False).ids, vocab.__getitem__), (sp.encode(text), piece)):
            at, row = 0, []
            for i in ids:
                row.append((i, at, at + len(name(i))))
                at = row[-1][2]
            if b"".join(map(name, ids)) != b" " + text.encode():
                return None
            out.append(row)
        return out

    return tokens


def brute(rows, tokens):
    """Rows as the query gives them: links are the pairs of tokens between two common ends."""
    parts, docs_of = [], Counter()
    for doc, text in rows:
        found = tokens(text) if text else None
        groups = []
        if found:
            ends = sorted({e for *_, e in found[0]} & {e for *_, e in found[1]})
            for low, high in zip([0, *ends[:-1]], ends, strict=True):
                groups.append([[i for i, s, e in side if s >= low and e <= high] for side in found])
        parts.append((doc, found, groups))
        docs_of.update({(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    out = []
    for doc, found, groups in parts:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, *(len(x) for x in found or ([], [])), len(groups), len(links), sum(docs_of[p] == most[p[0]] for p in links), sum(docs_of[p] for p in links),
                    sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_query_against_brute_force(spark, sf_dir, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = align.op11_align(spark, sf_dir)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, plain))


def test_odd_rows_in_small_blocks(spark, plain, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_GROUPS", 40)
    monkeypatch.setattr(align, "CACHED_GROUPS", 30)
    rng = random.Random(4)
    letters = "ab '.\n\t é日\U0001f600١ 　\x1c\x85<|>_"
    texts = [None, "", " ", "\n", "<|endoftext|> <s> </s> <0x0A>", "a▁b c", "x\0y", "  two  spaces ", "日本語 テキスト", "don't 'tis ﬁ", "a" * 3000, "long word " * 4000,
             "aa aa aa", "aa aa aa", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 50))) for _ in range(150))]
    rows = [(None if i % 13 == 5 else i % 40, t, None, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'q' AS key", "'q' AS block", "'q' AS a").repartition(3)
    got = [tuple(r) for r in align.align(docs).collect()]
    want = brute([(d, t) for d, t, *_ in rows], plain)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert align.align(docs.where("false")).count() == 0


def test_words_are_encoded_as_in_whole_texts(plain):
    words, rng = align.Dictionary(align.Tokens(*align.default_tokenizers())), random.Random(7)
    letters = "ab,. '\n\té日\U0001f600  \x1d9"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        found = plain(text)
        groups = [words.groups[i] for i in words.document(text)[0]]
        assert groups == (words.tokens.groups(*([i for i, *_ in side] for side in found)) if found else [])
    assert words.tokens.by_word


def test_a_pair_in_several_groups_of_a_document_counts_it_once():
    import numpy as np

    # groups 0 and 1 share pair 7; document 0 holds both, document 1 holds one of them
    pair, over = align._surplus([[7, 8], [7], [9]], np.array([0, 0, 1, 1]), np.array([0, 1, 1, 2]))
    assert (pair.tolist(), over.tolist()) == ([7], [1])
