"""The stages of the pipeline, each against what it must keep and drop."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import classes, longest_copies


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        columns = docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == columns
            seen[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    before, after = seen["language"]
    assert {d for d, t in before.items() if any(c.isalpha() for c in t)} - set(after) == set()
    before, after = seen["lines"]
    rows = sorted(before.items())
    for (d, t), gone in zip(rows, longest_copies(rows, 50), strict=True):
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        assert after.get(d, "") == (left if left.strip() or not gone else "")
    before, after = seen["jaccard"]
    assert set(after) == {i for i, (_, c, _) in classes(before, 5, 80).items() if c == i}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = seen["decontaminate"]
    assert not any(q in t for t in after.values() for q in items) and {d for d, t in before.items() if any(q in t for q in items)} == set(before) - set(after)
    assert docs.agg(F.count_distinct("doc_id")).first()[0] == len(after)
