"""The pipeline's language stage refuses scripts that no prototype has and keeps clean documents."""

import random

from pyspark.sql import functions as F

from tesselon.llm import language


def test_unlearned_scripts_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng, rows = random.Random(4), []
    for first in (0x3B1, 0x430, 0x5D0, 0x10D0, 0x4E00):  # Greek, Cyrillic, Hebrew, Georgian, Han
        for n in (25, 200):
            for _ in range(40):
                text = " ".join("".join(chr(first + rng.randrange(24)) for _ in range(rng.randint(2, 8))) for _ in range(n))
                rows.append((-1 - len(rows), text, None))
    kept = {r.doc_id for r in language.keep_known(docs.union(spark.createDataFrame(rows, docs.schema))).select("doc_id").collect()}
    assert sum(d < 0 for d in kept) <= len(rows) // 50
    clean = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert clean <= kept


def test_more_languages_ask_for_more():
    assert 3 / 32 < language.least_score(1) < language.least_score(4) < language.least_score(100) < 5 / 32


def test_the_bound_grows_with_the_text_and_has_no_step():
    import numpy as np

    n = np.arange(1, 3000)
    bound = np.minimum(language.least_score(4), language.likely_score(language.expected_score(n, 0.005)))
    assert (np.diff(bound) >= 0).all() and np.diff(bound).max() < 0.02 and bound[-1] == language.least_score(4)


def test_cosines_are_about_as_expected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    profiles = language._profiles(language._to_learn(docs))
    share = {k: sum(x * x for x in v[:-1]) / (len(v) - 1) / v[-1] ** 2 for k, v in profiles.items()}
    assert {k: v[:-1] for k, v in profiles.items()} == language.learned(docs)
    pred = language._predict({k: v[:-1] for k, v in profiles.items()}, 1024, 3, sizes=True)
    rows = docs.mapInArrow(pred, "doc_id long, lang string, lang_pred string, score double, grams long").where("grams > 0").collect()
    far = [r.score - float(language.expected_score(r.grams, share[r.lang_pred])) for r in rows]
    assert abs(sorted(far)[len(far) // 2]) < 0.03
