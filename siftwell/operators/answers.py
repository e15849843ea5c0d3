"""From matches to answers: prompts, generation, sources, replies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt
from . import conversation

Generator = Callable[[list[str]], list[str]]


def extractive(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: the context's sentence that shares
    most words with the question."""
    out = []
    for p in prompts:
        context, _, rest = p.rpartition("\n\nQuestion: ")
        question = set(re.findall(r"\w+", rest.partition("\n\nAnswer:")[0].lower()))
        parts = re.split(r"(?<=[.!?])\s+|\n+", context.rpartition("Context:\n")[2])
        out.append(max(parts, key=lambda s: (len(question & set(re.findall(r"\w+", s.lower()))), -len(s)), default=""))
    return out


def generate_udf(generator: Generator = extractive):
    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(generator(list(prompts)), index=prompts.index)

    return generate


def source_list(matches: DataFrame, rank: str = "rank") -> DataFrame:
    """qid, references: source, type, vector score and excerpt in rank order."""
    one = F.struct(F.col(rank).alias("rank"), "source", "type", F.col("score").alias("score"), excerpt(F.col("text")).alias("excerpt"))
    return matches.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("references"))


def prompts(questions: DataFrame, matches: DataFrame, history: DataFrame | None = None, rank: str = "rank") -> DataFrame:
    """qid, question, prompt, sources; no matches give a null prompt."""
    out = questions.join(conversation.contexts(matches, rank), "qid", "left")
    if history is not None:
        out = out.join(history, "session_id", "left")
    else:
        out = out.withColumn("history", F.lit(None).cast("string"))
    p = conversation.prompt(F.col("question"), F.col("context"), F.col("history"))
    return out.withColumn("prompt", F.when(F.col("context").isNotNull(), p))


def answer(prompted: DataFrame, generator: Generator = extractive) -> DataFrame:
    """With ``answer``; questions without matches get the fixed sentence, no
    sources, and are not to be cached."""
    none = F.col("prompt").isNull()
    out = prompted.withColumn("_g", generate_udf(generator)(F.coalesce("prompt", F.lit(""))))
    return out.withColumn("answer", F.when(none, conversation.NO_ANSWER).otherwise(F.col("_g"))).withColumn("sources", F.when(none, F.array().cast("array<string>")).otherwise(F.col("sources"))).withColumn("cacheable", ~none).drop("_g")


def relabel(cached: DataFrame, requests: DataFrame) -> DataFrame:
    """Cached answers (key, answer, sources) given to requests (key,
    session_id, request_id), each with an interaction id of its own."""
    return requests.join(cached, "key").withColumn("interaction_id", F.sha2(F.concat_ws(":", "session_id", F.col("request_id").cast("string")), 256))


def reply_text(answer_text: Column, references: Column, hint: bool = True) -> Column:
    """Chat reply: the answer, a list of its sources, a hint to rate it."""
    lines = F.array_join(F.transform(references, lambda r: F.concat(F.lit("- "), r["source"], F.lit(" ("), r["type"], F.lit(")\n"))), "")
    out = F.concat(answer_text, F.when(F.size(references) > 0, F.concat(F.lit("\n\n**Sources:**\n"), lines)).otherwise(F.lit("")))
    return F.concat(out, F.lit("\n\n_Reply 👍 or 👎 to rate this answer._")) if hint else out


def answer_card(answer_text: Column, interaction_id: Column) -> Column:
    """An adaptive card with the answer and two rating buttons, as JSON."""
    button = lambda title, vote: F.struct(F.lit("Action.Submit").alias("type"), F.lit(title).alias("title"), F.struct(F.lit(vote).alias("rating"), interaction_id.alias("interactionId")).alias("data"))
    body = F.array(F.struct(F.lit("TextBlock").alias("type"), answer_text.alias("text"), F.lit(True).alias("wrap")))
    return F.to_json(F.struct(F.lit("AdaptiveCard").alias("type"), F.lit("1.3").alias("version"), body.alias("body"), F.array(button("👍", "UP"), button("👎", "DOWN")).alias("actions")))
