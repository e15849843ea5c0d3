"""Answer cache: keys, and what a log of requests would have hit."""

from __future__ import annotations

import hashlib
from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Cache
from .scratch import stored

#: Requests of a log that one task replays.
RANGE_ROWS = 50_000


def cache_key(question: Column, config: Cache = Cache()) -> Column:
    """Trimmed, white space collapsed, lower case, as configured."""
    q = F.coalesce(question, F.lit(""))
    if config.normalize_whitespace:
        q = F.trim(F.regexp_replace(q, r"[ \t\n\r\f\x0B]+", " "))
    return q if config.case_sensitive else F.lower(q)


def simulate(requests: DataFrame, config: Cache = Cache(), order: str = "request_id") -> DataFrame:
    """request_id, key, ts, kind (get, evict, clear) -> with ``hit``. Entries
    expire ``ttl`` after they were written; a hit does not extend them. The fold
    runs per key and stretch between two clears. A hot key is one ordered fold, of
    constant memory. The bound on the number of entries, which is
    global, is bounded()'s."""
    ttl = pd.Timedelta(minutes=config.ttl_minutes)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, written = None, None
        for frame in frames:
            hits = []
            for k, ts, kind in zip(zip(frame.pop("epoch"), frame["key"], strict=True), frame["ts"], frame["kind"], strict=True):
                if k != key:
                    key, written = k, None
                if kind in ("evict", "clear"):
                    written = None
                    hits.append(None)
                elif written is not None and ts - written < ttl:
                    hits.append(True)
                else:
                    written = ts
                    hits.append(False)
            frame["hit"] = pd.array(hits, dtype="boolean")
            yield frame

    log = _with_epochs(requests.select(order, "key", "ts", "kind"), order)
    spread = log.repartition("key", "epoch").sortWithinPartitions("key", "epoch", "ts", order)
    return spread.mapInPandas(fold, f"{order} {kinds[order]}, key string, ts {kinds['ts']}, kind string, hit boolean")


def _with_epochs(log: DataFrame, order: str) -> DataFrame:
    """``log`` with the number of clears up to each request. Ranges of time count
    their own, and begin with what the ranges before them have."""
    if not log.filter("kind = 'clear'").head(1):
        return log.withColumn("epoch", F.lit(0).cast("bigint"))
    dealt = stored(log.repartitionByRange("ts", order).withColumn("_part", F.spark_partition_id()))
    clear = (F.col("kind") == "clear").cast("bigint")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = dealt.groupBy("_part").agg(F.sum(clear).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.sum(clear).over(Window.partitionBy("_part").orderBy("ts", order))
    return dealt.withColumn("_own", own).join(F.broadcast(carry), "_part").withColumn("epoch", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


class Store:
    """The cache itself: entries that expire ``ttl`` after they were written, at
    most ``most`` of them, the least recently used one going first."""

    def __init__(self, ttl: int, most: int, entries=()):
        self.ttl, self.most = ttl, most
        self.entries = OrderedDict(entries)  # key -> when written, least recently used first
        self.ages = deque(sorted(((at, key) for key, at in self.entries.items()), key=lambda x: x[0]))

    def expire(self, now: int) -> None:
        while self.ages and now - self.ages[0][0] >= self.ttl:
            at, key = self.ages.popleft()
            if self.entries.get(key) == at:
                del self.entries[key]

    def step(self, key, now: int, kind: str) -> tuple[bool | None, int]:
        """Whether a get was a hit (null for control events), and how many
        entries it pushed out."""
        self.expire(now)
        if kind == "clear":
            self.entries.clear()
        elif kind == "evict":
            self.entries.pop(key, None)
        elif key in self.entries:
            self.entries.move_to_end(key)
            return True, 0
        else:
            self.entries[key] = now
            self.ages.append((now, key))
            if len(self.entries) > self.most:
                self.entries.popitem(last=False)
                return False, 1
            return False, 0
        return None, 0

    def digest(self) -> str:
        return hashlib.md5(repr(list(self.entries.items())).encode()).hexdigest()


def _with_written(log: DataFrame, ttl: int) -> DataFrame:
    """``log`` with the time at which each get's entry was written if no bound
    ever pushed it out; one ordered fold per key."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, written, begun = None, None, False
        for frame in frames:
            out = []
            for k, at, kind in zip(frame["key"], frame["at"], frame["kind"], strict=True):
                if not begun or k != key:
                    key, written, begun = k, None, True
                if kind != "get":
                    written = None
                elif written is None or at - written >= ttl:
                    written = at
                out.append(written)
            frame["written"] = pd.array(out, dtype="Int64")
            yield frame

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    return log.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(fold, f"{kinds}, written bigint")


def bounded(requests: DataFrame, config: Cache = Cache(), order: str = "request_id") -> DataFrame:
    """request_id, key, ts, kind (get, evict, clear) -> with ``hit``, ``evicted``
    (entries that this request pushed out) and ``size`` (entries after it) of one
    cache of at most ``max_size`` entries: those that expired are gone, beyond the
    bound the least recently used entry goes. Requests are taken in the order of
    ts, then ``order``.

    The log is cut into ranges of time, which are replayed at once, each from the
    cache that it is expected to find: the last keys of the range before, their
    times of writing from a fold per key that knows of no bound. A range whose
    expectation differs from what the range before it in fact left is replayed
    from that, until none differs. The first range begins empty, so each round
    settles one range at least and the result is that of one replay from end to
    end; a cache forgets what lies behind ``max_size`` keys, so few rounds do. Only
    a range's last ``max_size`` entries pass from range to range."""
    ttl, most = config.ttl_minutes * 60_000_000, max(config.max_size, 0)
    kind = requests.schema[order].dataType.simpleString()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    log = requests.select(F.col(order).alias("id"), "key", "ts", "kind", at.alias("at"))
    ranges = 1 + log.count() // RANGE_ROWS
    dealt = _with_written(log, ttl).repartitionByRange(ranges, "at", "id").sortWithinPartitions("at", "id")
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()))
    held = sorted(r.range for r in dealt.select("range").distinct().collect())
    if held != list(range(len(held))):  # some ranges are empty
        numbers = log.sparkSession.createDataFrame(list(enumerate(held)), "next int, range int")
        dealt = dealt.join(F.broadcast(numbers), "range").drop("range").withColumnRenamed("next", "range")
    schema = StructType.fromDDL(f"range int, id {kind}, key string, ts {log.schema['ts'].dataType.simpleString()}, kind string, hit boolean, evicted int, size int, place int, written bigint, before string")
    names = schema.names

    def tail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last keys of each range, for the next one to begin from."""
        last, own = None, OrderedDict()

        def out():
            rows = list(own.items())[-most:] if most else []
            return pd.DataFrame({"range": [last + 1] * len(rows), "place": range(len(rows)), "key": pd.Series([k for k, _ in rows], dtype=object), "written": pd.Series([w for _, w in rows], dtype="int64")})

        for frame in frames:
            for r, key, kind, written in zip(frame["range"], frame["key"], frame["kind"], frame["written"], strict=True):
                if r != last:
                    if last is not None:
                        yield out()
                    last, own = r, OrderedDict()
                if kind == "clear":
                    own.clear()
                elif kind == "evict":
                    own.pop(key, None)
                else:
                    own[key] = int(written)
                    own.move_to_end(key)
                    if len(own) > most:
                        own.popitem(last=False)
        if last is not None:
            yield out()

    def replay(events: pa.Table, state: pa.Table) -> pa.Table:
        events, state = events.sort_by([("at", "ascending"), ("id", "ascending")]), state.sort_by("place")
        n, columns = events.num_rows, dict.fromkeys(names)
        if n:
            store = Store(ttl, most, zip(state["key"].to_pylist(), state["written"].to_pylist(), strict=True))
            store.expire(events["at"][0].as_py())
            before, found = store.digest(), []
            for key, now, kind in zip(*(events[c].to_pylist() for c in ("key", "at", "kind")), strict=True):
                found.append((*store.step(key, now, kind), len(store.entries)))
            k = len(store.entries)
            columns = {c: events[c].to_pylist() + [None] * (k + 1) for c in ("id", "ts", "kind")}
            columns |= {c: [x[i] for x in found] + [None] * (k + 1) for i, c in enumerate(("hit", "evicted", "size"))}
            columns["range"] = [events["range"][0].as_py()] * (n + k + 1)
            columns["key"] = events["key"].to_pylist() + [*store.entries, None]
            columns["place"] = [None] * n + [*range(k), None]
            columns["written"] = [None] * n + [*store.entries.values(), None]
            columns["before"] = [None] * (n + k) + [before]
        types = dict(zip(events.column_names, events.schema.types, strict=True)) | {"hit": pa.bool_(), "evicted": pa.int32(), "size": pa.int32(), "place": pa.int32(), "written": pa.int64(), "before": pa.string()}
        return pa.table([pa.array(columns[c] or [], types[c]) for c in names], names=names)

    def replayed(events: DataFrame, states: DataFrame) -> DataFrame:
        return stored(events.groupBy("range").cogroup(states.groupBy("range")).applyInArrow(replay, schema))

    guess = dealt.sortWithinPartitions("range", "at", "id").mapInPandas(tail, "range int, place int, key string, written bigint")
    found = replayed(dealt, guess)
    while True:
        left = found.filter("place is not null").select((F.col("range") + 1).alias("range"), "place", "key", "written")
        firsts = dealt.groupBy("range").agg(F.min("at").alias("first"))
        ends = found.filter("before is not null").select("range", "before")
        # what the range before left, without what expires before this range's first request
        left = stored(left.join(firsts, "range").filter(F.col("first") - F.col("written") < ttl).drop("first"))
        wrong = stored(ends.join(_digests(left), "range", "left").filter(~F.col("before").eqNullSafe(F.coalesce("left", F.lit(Store(ttl, most).digest())))).select("range"))
        if not wrong.head(1):
            break
        again = replayed(dealt.join(F.broadcast(wrong), "range", "left_semi"), left.join(F.broadcast(wrong), "range", "left_semi"))
        found = found.join(F.broadcast(wrong), "range", "left_anti").unionByName(again)
    return found.filter("place is null and before is null").select(F.col("id").alias(order), "key", "ts", "kind", "hit", "evicted", "size")


def _digests(left: DataFrame) -> DataFrame:
    """range, left: the digest of the entries that a range finds."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return pd.DataFrame({"range": [key[0]], "left": [Store(0, 0, zip(frame["key"], map(int, frame["written"]), strict=True)).digest()]})

    return left.groupBy("range").applyInPandas(one, "range int, left string")


def stats(log: DataFrame, order: str = "request_id") -> DataFrame:
    """One row: hits, misses, hit rate, evictions and keys ever written; of a
    bounded() log, evictions are those for want of room, and ``size`` is that
    after the last request."""
    gets = F.col("kind") == "get"
    if "evicted" in log.columns:
        more = [F.sum("evicted").alias("evictions"), F.max_by("size", F.struct("ts", order)).alias("size")]
    else:
        more = [F.count_if(F.col("kind") == "evict").alias("evictions")]
    return log.agg(
        F.count_if(gets & F.col("hit")).alias("hits"), F.count_if(gets & ~F.col("hit")).alias("misses"), *more, F.countDistinct(F.when(gets & ~F.col("hit"), F.col("key"))).alias("keys")
    ).withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 6))
