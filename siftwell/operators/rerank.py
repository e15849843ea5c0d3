"""Reranking: pluggable providers, merging back, and feedback-aware order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Rerank

#: Scores (question, passages) -> one number per passage; runs on executors.
Scorer = Callable[[str, list[str]], list[float]]
_providers: dict[str, Scorer] = {}


def register_provider(name: str, scorer: Scorer) -> None:
    _providers[name] = scorer


def provider_names() -> list[str]:
    return sorted([*_providers, "none"])


def parse_llm_score(reply: Column) -> Column:
    """First run of digits, held within 0 to 10; anything else is 0."""
    n = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"\d+", 0), F.lit("")).try_cast("int")
    return F.when(n.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), n)))


def merge(originals: DataFrame, reranked: DataFrame) -> DataFrame:
    """``originals`` (qid, chunk_id, rank, …) in the order of ``reranked`` (qid,
    chunk_id, rerank_score); unknown ids are dropped, originals that were not
    returned follow in their own order."""
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    out = originals.join(reranked.select("qid", "chunk_id", "rerank_score"), ["qid", "chunk_id"], "left")
    return out.withColumn("new_rank", F.row_number().over(order))


def rerank(matches: DataFrame, config: Rerank = Rerank()) -> DataFrame:
    """``matches`` (qid, question, chunk_id, text, score, rank) with new_rank.
    Off, ``none`` or an unknown provider keep the order; a failing provider
    keeps it too if ``fail_open``, else the job fails."""
    scorer = _providers.get(config.provider)
    if not config.enabled or scorer is None:
        return matches.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("new_rank", F.col("rank"))
    chars, fail_open = config.passage_chars, config.fail_open

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[["qid", "chunk_id"]].copy()
            out["rerank_score"] = float("nan")
            for question, own in f.groupby("question", sort=False, dropna=False):
                try:
                    out.loc[own.index, "rerank_score"] = scorer(question, [(t or "")[:chars] for t in own["text"]])
                except Exception:
                    if not fail_open:
                        raise
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}
    scored = matches.select("qid", "chunk_id", "question", "text").mapInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, rerank_score double")
    scored = scored.withColumn("rerank_score", F.nanvl("rerank_score", F.lit(None).cast("double")))
    single = F.count("*").over(Window.partitionBy("qid")) <= 1
    return merge(matches, scored).withColumn("new_rank", F.when(single, F.col("rank")).otherwise(F.col("new_rank")))


def feedback_order(matches: DataFrame, boosts: DataFrame, rank: str = "rank", k: int | None = None) -> DataFrame:
    """Positional score 1 - i/n of the current order plus the source's boost,
    sorted anew with the old order for ties; one match alone stays as it is."""
    w = Window.partitionBy("qid")
    n = F.count("*").over(w)
    out = matches.join(boosts.select("source", "boost"), "source", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    out = out.withColumn("adjusted", F.when(n > 1, 1.0 - (F.col(rank) - 1) / n + F.col("boost")).otherwise(F.lit(1.0)))
    out = out.withColumn("final_rank", F.row_number().over(w.orderBy(F.desc(F.round("adjusted", 12)), rank)))
    return out if k is None else out.filter(F.col("final_rank") <= k)
