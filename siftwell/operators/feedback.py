"""Votes on answers: latest per interaction, source boosts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Feedback


def latest(votes: DataFrame, key: str = "interaction_id", at: str = "created_at") -> DataFrame:
    """The view of an upsert: the last row per interaction."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return votes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def source_votes(votes: DataFrame) -> DataFrame:
    """source, up, down; a source named twice in one answer counts twice."""
    each = votes.select(F.explode("sources").alias("source"), "rating")
    return each.groupBy("source").agg(F.count_if(F.col("rating") == "UP").alias("up"), F.count_if(F.col("rating") == "DOWN").alias("down"))


def vote_deltas(votes: DataFrame, key: str = "interaction_id", at: str = "created_at") -> DataFrame:
    """source, up, down: what each vote changes, in signed numbers. It applies
    itself and undoes the vote before it on the same interaction, so the sums per
    source are source_votes() of latest() at any time."""
    old = F.lag(F.struct("rating", "sources")).over(Window.partitionBy(key).orderBy(at))
    both = votes.select(F.col("rating").alias("_r"), F.col("sources").alias("_s"), old.alias("_old"))
    signed = lambda sources, rating, n: F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.struct(s.alias("source"), rating.alias("rating"), F.lit(n).alias("n")))
    each = both.select(F.explode(F.concat(signed(F.col("_s"), F.col("_r"), 1), signed(F.col("_old.sources"), F.col("_old.rating"), -1))).alias("d"))
    of = lambda rating: F.when(F.col("d.rating") == rating, F.col("d.n")).otherwise(0).cast("bigint")
    return each.select("d.source", of("UP").alias("up"), of("DOWN").alias("down"))


def added(deltas: DataFrame) -> DataFrame:
    """source, up, down: signed votes summed; sources whose votes were all
    undone are as if they had none."""
    out = deltas.groupBy("source").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return out.filter("up <> 0 or down <> 0")


def boosts(counts: DataFrame, config: Feedback = Feedback()) -> DataFrame:
    """source, net, boost: weight per net vote within the cap."""
    net = F.col("up") - F.col("down")
    boost = F.greatest(F.lit(-config.max_boost), F.least(F.lit(config.max_boost), net * config.boost_weight))
    return counts.select("source", net.alias("net"), F.when(F.abs(net) >= config.min_votes, boost).otherwise(F.lit(0.0)).alias("boost"))


def totals(votes: DataFrame) -> DataFrame:
    return votes.groupBy("rating").agg(F.count("*").alias("n"))


def submit(answers: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, not found): votes joined with the answers they rate."""
    known = votes.join(answers.select("interaction_id", "session_id", F.col("content").alias("answer"), "sources"), "interaction_id")
    return known, votes.join(answers.select("interaction_id"), "interaction_id", "left_anti")


def add_comments(votes: DataFrame, comments: DataFrame) -> DataFrame:
    """Votes with the comment of (interaction_id, comment) put in; the rest of
    the row stays."""
    new = comments.select("interaction_id", F.col("comment").alias("_c"))
    return votes.join(new, "interaction_id", "left").withColumn("comment", F.coalesce("_c", "comment")).drop("_c")
