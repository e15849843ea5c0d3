"""From raw documents to token ids: quality, near-dedup, decontamination,
personal data, encoding. Each stage works on all that the one before it kept.

Rows are told apart by doc_id: a decision on an id holds for all its rows, and
near-dedup keeps one row of an id. Within a stage rows without an id have ids of
their own, above all others, and are judged like any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontam, minhash, pii, quality
from siftwell.llm._shared import small, spread, staged, table, written


#: The first id of rows that have none.
NO_ID = 1 << 62


def _named(docs: DataFrame) -> DataFrame:
    """``docs``, rows without an id under one of their own, written so that it
    stays the same; files without such rows are not read for it."""
    lost = docs.filter("doc_id is null").withColumn("doc_id", F.lit(NO_ID) + F.monotonically_increasing_id())
    lost = written(lost, "stage-unnamed")
    return docs.filter("doc_id is not null").unionByName(lost) if lost.head(1) else docs


def _unnamed(docs: DataFrame, like: DataFrame) -> DataFrame:
    ids = F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).cast(like.schema["doc_id"].dataType)
    return docs.withColumn("doc_id", ids).select(*like.columns)


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the ids of ``gone``."""
    return docs.join(small(written(gone.select("doc_id").distinct(), name)), "doc_id", "left_anti").select(*docs.columns)


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    rows = _named(docs)
    found = quality.scores(rows, quality.learning_labels(table(spark, sf_dir, "labels")))
    return _unnamed(_without(rows, found.filter(F.col("score") < quality.ACCEPT), "stage-rejected"), docs)


@staged
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    rows = _named(docs)
    found = written(minhash.classes(rows), "stage-classes")
    kept = _without(rows, found.filter("doc_id <> component_id"), "stage-copies")
    again = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"), "stage-repeated")
    if again.head(1):
        again = small(again.select("doc_id"))
        once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return _unnamed(kept, docs)


@staged
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = _named(docs)
    found = decontam.Index(rows, table(spark, sf_dir, "benchmark")).report()
    return _unnamed(_without(rows, found.filter("contaminated"), "stage-contaminated"), docs)


@staged
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@staged
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe encoding", bpe_stage),
]

#: The classifier cannot be told in SQL; tests hold the pipeline against a
#: plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{n}")
    return docs
