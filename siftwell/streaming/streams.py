"""Streams: files into the chunk table, chat events, event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Cache, Config, Feedback, Retrieval
from ..functions.classify import file_type, is_supported_file
from ..functions.embed import Embedder, hashed
from ..operators import bot, ingest


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New supported files of a folder, as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.withColumn("name", name).filter(is_supported_file(F.col("name"))).withColumn("type", file_type(F.col("name"))).select("path", "name", "type", "length", "content")


def ingest_stream(stream: DataFrame, root: str, checkpoint: str, config: Retrieval = Retrieval(), embedder: Embedder = hashed, name: str = "files", **trigger) -> StreamingQuery:
    """Every micro-batch of files into the tables of the engine below ``root``,
    as ingest_folder() puts them there; a batch that is tried again replaces
    itself. ``name`` tells streams into one engine apart."""
    from ..engine import Engine

    engine = Engine(stream.sparkSession, root, Config(retrieval=config), embedder)
    return stream.writeStream.foreachBatch(lambda df, epoch: engine.ingest_batch(df, name, epoch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def route_stream(events: DataFrame, config: Feedback = Feedback()) -> DataFrame:
    """The bot's state machine over a stream of events, per room."""
    ttl = max(config.comment_ttl_minutes, 1) * 60.0

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, pending, until = state.get if state.exists else (None, None, None)
        own = {"latest": latest} | ({"pending": (pending, until)} if pending else {})
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).to_dict("records"):
            action = bot.step(own, e | {"ts": e["ts"].timestamp(), "rating": e["rating"] or None, "shortcut": e["shortcut"] or None}, ttl)
            out.append((e["event_id"], key[0], e["ts"], *action))
        p = own.get("pending") or (None, None)
        state.update((own.get("latest"), p[0], p[1]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in bot.OUT.split(", ")])

    return bot.prepared(events).groupBy("room_id").applyInPandasWithState(fold, bot.OUT, "latest string, pending string, until double", "append", GroupStateTimeout.NoTimeout)


def cache_stream(requests: DataFrame, config: Cache = Cache()) -> DataFrame:
    """Hits and misses of a stream of (request_id, key, ts): entries live for
    the TTL from their writing, a hit does not extend it."""
    ttl = config.ttl_minutes * 60.0
    schema = "request_id bigint, key string, hit boolean"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        written = state.get[0] if state.exists else None
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts", "request_id"]).itertuples():
            now = e.ts.timestamp()
            hit = written is not None and now - written < ttl
            written = written if hit else now
            out.append((e.request_id, key[0], hit))
        state.update((written,))
        yield pd.DataFrame(out, columns=["request_id", "key", "hit"])

    return requests.groupBy("key").applyInPandasWithState(fold, schema, "written double", "append", GroupStateTimeout.NoTimeout)


def outbox_sink(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rows to be sent, as a table that a sender works off."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def votes_upsert(stream: DataFrame, path: str, checkpoint: str, name: str = "votes", **trigger) -> StreamingQuery:
    """Append votes to the stored table at ``path``; operators.feedback.latest()
    is the view of the upsert."""

    def put(df: DataFrame, epoch: int) -> None:
        ingest.put_batch(df.sparkSession, df, path, name, epoch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def vote_deltas(votes: DataFrame) -> DataFrame:
    """source, up, down of a stream of votes (interaction_id, rating, sources,
    created_at): each vote undoes the interaction's vote before it and applies
    itself. The state of an interaction is its latest vote; one that is older than
    that is late and changes nothing, as in latest(). A stream that begins with the
    stored votes rebuilds the counts."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rating, sources, at = state.get if state.exists else (None, [], None)
        changes: dict[tuple[str, str], int] = {}
        for v in pd.concat(list(frames)).sort_values("created_at").itertuples():
            now = int(v.created_at.value)
            if at is not None and now < at:
                continue
            new = [] if v.sources is None else list(v.sources)
            for own, how, n in ((sources, rating, -1), (new, v.rating, 1)):
                for s in own:
                    changes[s, how] = changes.get((s, how), 0) + n
            rating, sources, at = v.rating, new, now
        state.update((rating, sources, at))
        rows = [(s, n if how == "UP" else 0, n if how == "DOWN" else 0) for (s, how), n in changes.items() if n]
        yield pd.DataFrame(rows, columns=["source", "up", "down"])

    asked = votes.select("interaction_id", "rating", "sources", "created_at")
    return asked.groupBy("interaction_id").applyInPandasWithState(fold, "source string, up bigint, down bigint", "rating string, sources array<string>, at bigint", "append", GroupStateTimeout.NoTimeout)


def votes_stream(votes: DataFrame, root: str, checkpoint: str, config: Config = Config(), name: str = "votes", **trigger) -> tuple[StreamingQuery, StreamingQuery]:
    """A stream of votes (interaction_id, rating, comment, sources, created_at)
    into an engine's votes and into its running counts."""
    from ..engine import Engine

    engine, when = Engine(votes.sparkSession, root, config), trigger or {"availableNow": True}
    stored = votes.writeStream.foreachBatch(lambda df, epoch: engine._append("feedback", df, (name, epoch))).option("checkpointLocation", f"{checkpoint}/votes").trigger(**when).start()
    counted = vote_deltas(votes).writeStream.foreachBatch(lambda df, epoch: engine.count_votes(df, (name, epoch))).option("checkpointLocation", f"{checkpoint}/counts").outputMode("append").trigger(**when).start()
    return stored, counted


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Counts and sums per event-time window and type; late rows wait ``late``."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def drain(df: DataFrame, name: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into memory; for tests and shells."""
    name = name or "drained_" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


ProgressListener = Callable[[str, dict], None]


class StageListener(StreamingQueryListener):
    """Tells a listener of queries as they go: begun, each batch, idle, over."""

    def __init__(self, tell: ProgressListener):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell("started", {"name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell(f"batch {p.batchId}", {"rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.tell("idle", {})

    def onQueryTerminated(self, event) -> None:
        self.tell("over", {"error": event.exception})


@contextmanager
def told(spark: SparkSession, tell: ProgressListener):
    """While this holds, queries of the session tell ``tell`` of their progress."""
    listener = StageListener(tell)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def stage_log(query: StreamingQuery, tell: ProgressListener) -> None:
    """Hand the progress of a query's batches to a listener."""
    for p in query.recentProgress:
        tell(f"batch {p['batchId']}", {"rows": p.get("numInputRows", 0)})
