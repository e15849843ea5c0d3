"""Conversation memory: history blocks, questions behind answers, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Memory


def recent(messages: DataFrame, session: str, order: str, turns: int) -> DataFrame:
    """The last 2 * turns messages of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * turns).drop("_n")


def history_block(messages: DataFrame, session: str = "session_id", order: str = "created_at", config: Memory = Memory()) -> DataFrame:
    """session, history: speaker lines in time order, the end kept. Every role
    but USER speaks as Assistant."""
    kept = recent(messages, session, order, config.max_turns)
    line = F.concat(F.when(F.upper("role") == "USER", "User").otherwise("Assistant"), F.lit(": "), F.coalesce("content", F.lit("null")))
    lines = kept.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"))
    text = F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    cut = F.when(F.char_length(text) > config.max_history_chars, F.concat(F.lit("...\n"), F.right(text, F.lit(config.max_history_chars)))).otherwise(text)
    return lines.select(session, cut.alias("history"))


def preceding_question(messages: DataFrame, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """Assistant rows with the last user text at or before them."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = messages.withColumn("question", F.last(F.when(F.upper("role") == "USER", F.col("content")), ignorenulls=True).over(w))
    return out.filter(F.upper("role") == "ASSISTANT")


def latest_answer(messages: DataFrame, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """The last assistant row of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.filter(F.upper("role") == "ASSISTANT").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def follow_up(messages: DataFrame, session: str = "session_id", order: str = "created_at") -> DataFrame:
    """With ``is_follow_up``: the session has an earlier row."""
    return messages.withColumn("is_follow_up", F.row_number().over(Window.partitionBy(session).orderBy(order)) > 1)


def message_counts(messages: DataFrame, session: str = "session_id") -> DataFrame:
    return messages.groupBy(session).agg(F.count("*").alias("n_messages"))


def purge(messages: DataFrame, cutoff: datetime | Column, at: str = "created_at") -> DataFrame:
    """What stays when rows before the cutoff go."""
    return messages.filter(F.col(at) >= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff)))


def delete_session(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.filter(F.col("session_id") != session_id)


# The texts of a prompt and of an answer without matches.
NO_ANSWER = "I don't know based on the provided documents."
_HISTORY = "Conversation so far (for resolving references like \"it\"/\"that\"/\"the second one\" — do not treat this as source material):\n"
_TASK = "You are a helpful assistant. Use ONLY the context below to answer the question.\nIf the answer is not in the context, say \"I don't know based on the provided documents.\"\n\n"
SEPARATOR = "\n\n---\n\n"


def prompt(question: Column, context: Column, history: Column) -> Column:
    block = F.when(F.coalesce(F.trim(history), F.lit("")) != "", F.concat(F.lit(_HISTORY), history, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(_TASK), block, F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:\n"))


def contexts(matches: DataFrame, rank: str = "rank") -> DataFrame:
    """qid, context, sources: texts in rank order, distinct source names."""
    lists = matches.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), "text", "source"))).alias("m"))
    return lists.select(
        "qid", F.array_join(F.transform("m", lambda x: x["text"]), SEPARATOR).alias("context"), F.array_distinct(F.filter(F.transform("m", lambda x: x["source"]), lambda s: s.isNotNull())).alias("sources")
    )


def with_new_ids(asked: DataFrame, session: str = "session_id", interaction: str = "interaction_id") -> DataFrame:
    """``asked`` with a new session id where there is none or a blank one, and a new
    interaction id. They are drawn at random whenever the rows are worked out, so the
    result has to be written before it is used twice."""
    given = F.col(session) if session in asked.columns else F.lit(None).cast("string")
    return asked.withColumns({session: F.when(F.trim(given) != "", given).otherwise(F.expr("uuid()")), interaction: F.expr("uuid()")})
