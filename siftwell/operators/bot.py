"""Chat bot: event routing, votes and comments, broadcast and webhook plans.

Nothing here calls a network: plans are tables that a sender works off.
"""

from __future__ import annotations

import hashlib
import hmac
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Feedback
from ..functions.classify import SKIP_COMMENT, feedback_shortcut, rating, trimmed
from .layout import small
from .scratch import stored

EVENT = "struct<id:string,name:string,resource:string,event:string,actorId:string,data:struct<id:string,roomId:string,personId:string,personEmail:string,text:string,type:string,inputs:map<string,string>>>"
OUT = "event_id bigint, room_id string, ts timestamp_ntz, action string, interaction_id string, rating string, text string"


def parse_events(raw: Column) -> Column:
    """A webhook event's JSON; unknown fields are ignored."""
    return F.from_json(raw, EVENT)


def strip_mention(text: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(text), r"^@\S+\s*", ""))


def relevant(events: DataFrame, own_id: str) -> DataFrame:
    """Messages and actions of others."""
    return events.filter(F.col("kind").isin("message", "action") & (F.col("person_id") != own_id))


def step(state: dict, event: dict, ttl_seconds: float) -> tuple[str, str | None, str | None, str | None]:
    """One event of a room -> (action, interaction id, rating, text).

    A pending request for a comment is used up by the next message. If it still
    holds, the message is the comment, even if it reads like a vote; if it ran
    out, the message counts as itself. ``latest`` is the last answer's id."""
    text = event["text"]
    if event["kind"] == "action":
        vote = event["rating"]
        if vote is None:
            return "reject", event["interaction_id"], None, None
        state["pending"] = (event["interaction_id"], event["ts"] + ttl_seconds)
        return "vote", event["interaction_id"], vote, None
    pending = state.pop("pending", None)
    if pending and event["ts"] < pending[1]:
        if not text or text.lower() in SKIP_COMMENT:
            return "skip", pending[0], None, None
        return "comment", pending[0], None, text
    if event["shortcut"]:
        if not state.get("latest"):
            return "nothing_to_rate", None, event["shortcut"], None
        state["pending"] = (state["latest"], event["ts"] + ttl_seconds)
        return "vote", state["latest"], event["shortcut"], None
    if not text:
        return "ignore", None, None, None
    state["latest"] = hashlib.sha256(f"{event['room_id']}:{event['event_id']}".encode()).hexdigest()
    return "question", state["latest"], None, text


def prepared(events: DataFrame) -> DataFrame:
    text = strip_mention(F.coalesce("text", F.lit("")))
    return events.select("event_id", "room_id", "ts", "kind", "interaction_id", rating(F.col("rating")).alias("rating"), text.alias("text"), feedback_shortcut(text).alias("shortcut"))


def route_events(events: DataFrame, config: Feedback = Feedback()) -> DataFrame:
    """event_id, room_id, ts, kind (message or action), interaction_id, rating,
    text -> one action per event, by an ordered fold over each room. Rooms are
    sorted inside partitions, so a hot room streams by with constant state."""
    ttl = max(config.comment_ttl_minutes, 1) * 60.0

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, state = object(), {}
        for frame in frames:
            out = []
            for e in frame.to_dict("records"):
                if e["room_id"] != room:
                    room, state = e["room_id"], {}
                when = e["ts"]
                action = step(state, e | {"ts": when.timestamp(), "rating": e["rating"] or None, "shortcut": e["shortcut"] or None}, ttl)
                out.append((e["event_id"], room, when, *action))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return prepared(events).repartition("room_id").sortWithinPartitions("room_id", "ts", "event_id").mapInPandas(fold, OUT)


# What the placeholder of an answer says, stage by stage.
THINKING = "🤔 Thinking about your question..."
CACHE_HIT = "⚡ I've answered something like this recently — pulling up that answer..."
SEARCHING = "🔎 Searching the knowledge base for relevant documents..."
FOUND, SOURCE, DRAFTING = "📚 Found ", " relevant source", " — drafting an answer..."


def status_edits(asked: DataFrame) -> DataFrame:
    """Outbox rows (qid, room_id, n, kind, text) of an answer's placeholder: it
    is sent, edited with each stage, and deleted when the answer is out.
    ``asked``: qid, room_id, cached, n_sources (null if no answer was drafted)."""
    row = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    drafting = F.concat(F.lit(FOUND), F.col("n_sources"), F.lit(SOURCE), F.when(F.col("n_sources") == 1, "").otherwise("s"), F.lit(DRAFTING))
    looked = F.array(row("edit", F.lit(SEARCHING)), row("edit", drafting))
    edits = F.when(F.col("cached"), F.array(row("edit", F.lit(CACHE_HIT)))).otherwise(F.filter(looked, lambda r: r["text"].isNotNull()))
    stages = F.concat(F.array(row("send", F.lit(THINKING))), edits, F.array(row("delete", F.lit(None))))
    return asked.select("qid", "room_id", F.posexplode(stages).alias("n", "r")).select("qid", "room_id", "n", "r.kind", "r.text")


def plan_broadcast(emails: DataFrame, rooms: DataFrame, known_rooms: DataFrame | None = None) -> DataFrame:
    """kind, target: distinct addresses and rooms, given and known ones."""
    r = rooms.select("target") if known_rooms is None else rooms.select("target").unionByName(known_rooms.select("target"))
    both = emails.select(F.lit("email").alias("kind"), trimmed(F.col("target")).alias("target")).unionByName(r.select(F.lit("room").alias("kind"), trimmed(F.col("target")).alias("target")))
    return both.filter(F.coalesce(F.col("target"), F.lit("")) != "").distinct()


def paced(sends: DataFrame, every_ms: int, burst: int = 1, by: str = "sender", at: str = "created_at", order: str = "id") -> DataFrame:
    """``sends`` with ``send_at``: each as early as its sender's token bucket, one
    token each ``every_ms``, ``burst`` of them at most, allows, in the order of
    ``at``, then ``order``.

    Send i of a sender spends its token until T(i) = max(t(i), T(i - 1)) + d, so T(i) is
    d * (i + 1) plus the largest t(j) - d * j up to i, a running maximum; the send waits
    for T(i - 1) - (burst - 1) * d. Ranges of sends are worked out at once, and what
    a range starts with, a count and a maximum, comes from those of the ranges before it,
    so one sender may have all sends."""
    d = F.lit(every_ms * 1000).cast("bigint")
    t = F.unix_micros(F.col(at).cast("timestamp"))
    dealt = sends.withColumn("_t", t).repartitionByRange(by, "_t", order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt)
    own = Window.partitionBy(by, "_part").orderBy("_t", order)
    rows = dealt.withColumn("_n", F.row_number().over(own) - 1).withColumn("_m", F.col("_t") - d * F.col("_n"))
    ends = rows.groupBy(by, "_part").agg(F.count("*").alias("_c"), F.max("_m").alias("_top"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    ends = ends.withColumn("_carry", F.max(F.col("_top") - d * F.col("_from")).over(before)).select(F.col(by).alias("_by"), F.col("_part").alias("_of"), "_from", "_carry")
    rows = rows.withColumn("_run", F.max("_m").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(small(ends), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    top = F.greatest(F.col("_carry"), F.col("_run") - d * F.col("_from"))
    free = top + d * (F.col("_from") + F.col("_n")) - (burst - 1) * d
    return rows.select(*sends.columns, F.timestamp_micros(F.greatest(F.col("_t"), free)).cast("timestamp_ntz").alias("send_at"))


def due_again(results: DataFrame, most: int = 3, first_ms: int = 1000) -> DataFrame:
    """target, attempt, not_before of the sends to try once more: those whose last
    of ``results`` (target, attempt, ok, finished_at) failed, ``most`` attempts at most,
    each after twice the time of the one before, up to a million times the first."""
    last = results.groupBy("target").agg(F.max_by(F.struct("attempt", "ok", "finished_at"), "attempt").alias("r")).select("target", "r.*")
    wait = F.lit(first_ms * 1000) * F.pow(F.lit(2), F.least(F.col("attempt") - 1, F.lit(20))).cast("bigint")
    at = F.timestamp_micros(F.unix_micros(F.col("finished_at").cast("timestamp")) + wait).cast("timestamp_ntz")
    return last.filter(~F.col("ok") & (F.col("attempt") < most)).select("target", (F.col("attempt") + 1).alias("attempt"), at.alias("not_before"))


def broadcast_results(plan: DataFrame, results: DataFrame) -> DataFrame:
    """kind, target, attempts, ok of a planned broadcast: what its sends came to;
    ok is null for what was not tried."""
    last = results.groupBy("target").agg(F.max("attempt").alias("attempts"), F.max_by("ok", "attempt").alias("ok"))
    return plan.join(last, "target", "left").select("kind", "target", F.coalesce("attempts", F.lit(0)).alias("attempts"), "ok")


def broadcast_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def plan_webhooks(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """name, action (create, update, keep, delete), id, target_url: the oldest
    of a name is kept and brought up to date, the others go."""
    w = Window.partitionBy("name").orderBy(F.asc_nulls_last("created"), "id")
    have = existing.withColumn("_n", F.row_number().over(w)).select("name", "id", F.col("target_url").alias("_have"), "status", "_n")
    out = wanted.select("name", "target_url").join(have, "name", "left")
    good = (F.col("_have") == F.col("target_url")) & (F.coalesce("status", F.lit("active")) == "active")
    action = F.when(F.col("id").isNull(), "create").when(F.col("_n") > 1, "delete").when(good, "keep").otherwise("update")
    return out.select("name", action.alias("action"), "id", "target_url")


def url_changes(polled: DataFrame) -> DataFrame:
    """Polls (ts, url) at which the address is another than before."""
    before = F.lag("url").over(Window.partitionBy("name").orderBy("ts"))
    return polled.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("url"))).drop("_b")


def first_tunnel(tunnels: DataFrame) -> DataFrame:
    """The first public https address of a tunnel list."""
    first = tunnels.filter(F.col("public_url").startswith("https")).agg(F.min_by(F.struct(*tunnels.columns), "position").alias("r"))
    return first.filter("r is not null").select("r.*")


def poll_tunnel(read: Callable[[], DataFrame], attempts: int = 10, wait_seconds: float = 3.0) -> str | None:
    """The first public address that ``read``, a tunnel list as of now, has in so
    many attempts; an error of it counts as one."""
    for n in range(attempts):
        if n:
            time.sleep(wait_seconds)
        try:
            found = first_tunnel(read()).head()
        except PySparkException:
            found = None
        if found is not None:
            return found.public_url
    return None


def signature_udf(secret: str | None):
    """(body, signature) -> whether the HMAC-SHA1 holds; without a secret all do."""

    @F.pandas_udf("boolean")
    def valid(body: pd.Series, signature: pd.Series) -> pd.Series:
        if not secret:
            return pd.Series([True] * len(body))
        return pd.Series([isinstance(s, str) and hmac.compare_digest(hmac.new(secret.encode(), (b or "").encode(), hashlib.sha1).hexdigest(), s.lower()) for b, s in zip(body, signature, strict=True)])

    return valid
