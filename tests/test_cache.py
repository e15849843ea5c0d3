"""The bounded cache against a plain replay from end to end."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from siftwell.config import Cache
from siftwell.operators import cache

KIND = "request_id int, key string, ts timestamp_ntz, kind string"


def replay(log, ttl, most):
    """hit, evicted and size of each request: a list of entries, oldest use first."""
    held, out = [], {}
    for i, key, ts, kind in sorted(log, key=lambda r: (r[2], r[0])):
        held = [(k, at) for k, at in held if ts - at < ttl]
        own, rest = [e for e in held if e[0] == key], [e for e in held if e[0] != key]
        hit, evicted = None, 0
        if kind == "clear":
            held = []
        elif kind == "evict":
            held = rest
        else:
            hit, held = bool(own), rest + (own or [(key, ts)])
            evicted = max(len(held) - most, 0)
            held = held[evicted:]
        out[i] = (hit, evicted, len(held))
    return out


def requests(rng, n, keys, gap):
    at, out = datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=rng.randrange(gap))
        # few keys are asked all the time, many seldom
        key = f"k{int(keys * rng.random() ** 3)}"
        out.append((i, key, at, rng.choices(("get", "evict", "clear"), (95, 4, 0.3))[0]))
    return out


@pytest.mark.parametrize("seed,keys,most,ttl,gap", [(1, 40, 10, 60, 60), (2, 300, 50, 5, 20), (3, 12, 1, 600, 40), (4, 30, 500, 20, 90), (5, 25, 0, 20, 90)])
def test_bounded_cache_against_replay(spark, monkeypatch, seed, keys, most, ttl, gap):
    log = requests(random.Random(seed), 900, keys, gap)
    want = replay(log, timedelta(minutes=ttl), most)
    df = spark.createDataFrame(log, KIND).repartition(3)
    for rows in (70, cache.RANGE_ROWS):
        monkeypatch.setattr(cache, "RANGE_ROWS", rows)
        got = cache.bounded(df, Cache(ttl_minutes=ttl, max_size=most)).collect()
        assert {r.request_id: (r.hit, r.evicted, r.size) for r in got} == want


def test_equal_times_nulls_and_none(spark, monkeypatch):
    monkeypatch.setattr(cache, "RANGE_ROWS", 3)
    at = datetime(2024, 1, 1)
    log = [(i, None if i % 3 else f"k{i % 2}", at if i < 9 else at + timedelta(minutes=i), "get") for i in range(20)]
    got = cache.bounded(spark.createDataFrame(log, KIND), Cache(ttl_minutes=5, max_size=2)).collect()
    assert {r.request_id: (r.hit, r.evicted, r.size) for r in got} == replay(log, timedelta(minutes=5), 2)
    assert cache.bounded(spark.createDataFrame([], KIND)).count() == 0


def test_stats_of_bounded_log(spark):
    log = requests(random.Random(9), 300, 20, 60)
    want = replay(log, timedelta(minutes=60), 5)
    r = cache.stats(cache.bounded(spark.createDataFrame(log, KIND), Cache(ttl_minutes=60, max_size=5))).head()
    hits = [h for h, _, _ in want.values()]
    last = max(log, key=lambda r: (r[2], r[0]))[0]
    assert (r.hits, r.misses, r.evictions, r.size) == (hits.count(True), hits.count(False), sum(e for _, e, _ in want.values()), want[last][2])


def test_unbounded_cache_with_clears_against_replay(spark):
    log = [(i, key or "k", ts, kind) for i, key, ts, kind in requests(random.Random(11), 500, 15, 60)]
    log += [(1000 + n, "k0", log[n * 50][2], "clear") for n in range(8)]
    want = replay(log, timedelta(minutes=30), 10**6)
    for parts in (1, 5):
        got = cache.simulate(spark.createDataFrame(log, KIND).repartition(parts), Cache(ttl_minutes=30)).collect()
        assert {r.request_id: r.hit for r in got} == {i: h for i, (h, _, _) in want.items()}


def test_a_task_replays_few_requests():
    """A range of the log is in a worker's memory while it is replayed."""
    assert cache.RANGE_ROWS <= 50_000
