"""A training corpus from raw documents, in stages that are written and read again."""

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import decontaminate, jaccard, language, lines, packing
from tesselon.llm.common import Scratch, drop_since, scratch_mark


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the prototypes know; those without letters or likeness to any go, null and empty texts too.

    Equal rows stay or go together; an empty table stays empty. Columns stay as they are, as in all stages but the last."""
    return language.keep_known(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs of 50 words or more; documents left empty go.

    The copy of the least doc_id stays, a null one before all others; null texts stay; equal rows are one document."""
    return lines.without_copies(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets with a similarity of 0.8 or more: that of the least doc_id.

    Rows without doc_id or words stay; of equal rows one stays."""
    return jaccard.one_per_class(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; null and empty texts stay; without items all stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences for training; a null text is a document of its end id alone; no documents, no pieces."""
    return packing.pack(docs)


STAGES = [
    ("language", known_languages),
    ("lines", fresh_lines),
    ("jaccard", one_of_each),
    ("decontaminate", no_leaks),
    ("pack", packed),
]

#: Suffix doubling, exact set joins and tokenizers have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the written result of the one before."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        mark = scratch_mark()
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        drop_since(mark)  # what the stage itself had written
    return docs
