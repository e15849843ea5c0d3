"""Hybrid retrieval: reciprocal rank fusion of a vector and a keyword leg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Hybrid
from . import keyword, vector


def pool_size(k: int, multiplier: int) -> int:
    return max(k * max(multiplier, 1), k)


def rrf(vector_leg: DataFrame, keyword_leg: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Full outer merge of two ranked legs (qid, chunk_id, score or bm25, rank):
    fused score, match type and the k best. Ties: vector hits by rank, then
    keyword hits by rank."""
    v = vector_leg.select("qid", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vec_rank"))
    w = keyword_leg.select("qid", "chunk_id", F.col("bm25").alias("bm25_score"), F.col("rank").alias("kw_rank"))
    both = v.join(w, ["qid", "chunk_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    fused = both.withColumn("combined_score", part("vec_rank") + part("kw_rank")).withColumn(
        "match_type", F.when(F.col("vec_rank").isNull(), "KEYWORD").when(F.col("kw_rank").isNull(), "VECTOR").otherwise("HYBRID")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("combined_score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("kw_rank"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid_search(questions: DataFrame, chunks: DataFrame, k: int, index: DataFrame | None, stats: DataFrame | None, config: Hybrid = Hybrid(), analyzer: str = "simple") -> DataFrame:
    """``questions`` (qid, question, embedding). Without an index, or if the
    keyword leg is off, the vector leg alone is fused."""
    pool = pool_size(k, config.candidate_multiplier)
    near = vector.top_k(questions.select("qid", "embedding"), chunks.select("chunk_id", "embedding"), pool, config.min_vector_score)
    if not config.enabled or index is None or stats is None:
        none = near.limit(0).select("qid", "chunk_id", F.lit(0.0).alias("bm25"), "rank")
        return rrf(near, none, k, config.rrf_k)
    terms = keyword.question_terms(questions, analyzer)
    return rrf(near, keyword.bm25_top_k(terms, index, stats, pool, config), k, config.rrf_k)


def locator(sheet: Column, row_start: Column, row_end: Column) -> Column:
    """``sheet, Row n``, ``sheet, Rows a-b``, the sheet, or null."""
    rows = F.when(row_start.isNull(), sheet).when(row_end.isNull() | (row_start == row_end), F.concat(sheet, F.lit(", Row "), row_start)).otherwise(F.concat(sheet, F.lit(", Rows "), row_start, F.lit("-"), row_end))
    return F.when(sheet.isNotNull() & (F.trim(sheet) != ""), rows)


def field_summary(fields: Column) -> Column:
    """``k=v, k=v`` in the order of keys, or null."""
    said = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.when(F.size(fields) > 0, said)
