"""Paced sends against a token bucket in a loop; keys against brute force."""

from __future__ import annotations

import datetime as dt
import random
from itertools import combinations

import pytest

from siftwell.operators import bot, catalog


@pytest.mark.parametrize("burst,every,parts", [(1, 250, 1), (3, 400, 7), (5, 100, 13)])
def test_sends_are_paced(spark, burst, every, parts):
    rng, t0 = random.Random(burst), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choices(["hot", "b", None], (20, 3, 1))[0], t0 + dt.timedelta(milliseconds=rng.choice([rng.randrange(60_000), 1000]))) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.id: r for r in bot.paced(spark.createDataFrame(rows, "id int, sender string, created_at timestamp_ntz"), every, burst).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    d = dt.timedelta(milliseconds=every)
    for sender in ("hot", "b", None):
        free, sent = None, []
        for i, _, at in sorted((r for r in rows if r[1] == sender), key=lambda r: (r[2], r[0])):
            want = at if free is None else max(at, free - (burst - 1) * d)
            free = max(at, free or at) + d
            assert got[i].send_at == want
            sent.append(want)
        for n in range(len(sent) - burst):
            assert sent[n + burst] - sent[n] >= d  # no more than the bucket at any time
    assert len(got) == 400


def test_results_of_a_broadcast(spark):
    at = dt.datetime(2024, 1, 1)
    plan = spark.createDataFrame([("room", "a"), ("room", "b"), ("email", "c"), ("email", "d")], "kind string, target string")
    tried = spark.createDataFrame([("a", 1, False, at), ("a", 2, True, at), ("b", 1, False, at), ("b", 2, False, at), ("c", 1, False, at), ("c", 2, False, at), ("c", 3, False, at)], "target string, attempt int, ok boolean, finished_at timestamp_ntz")
    assert {tuple(r) for r in bot.due_again(tried, 3, 500).collect()} == {("b", 3, at + dt.timedelta(seconds=1))}
    results = bot.broadcast_results(plan, tried)
    assert {tuple(r) for r in results.collect()} == {("room", "a", 2, True), ("room", "b", 2, False), ("email", "c", 3, False), ("email", "d", 0, None)}
    s = bot.broadcast_summary(results).head()
    assert (s.total, s.succeeded, s.failed) == (4, 1, 2)


def test_keys_against_brute_force(spark):
    rng = random.Random(3)
    for n in (0, 1, 12, 40):
        rows = [(i, rng.randrange(4), rng.choice([None, "x", "y", "z"]), rng.randrange(12), i // 2, i % 2) for i in range(n)]
        df = spark.createDataFrame(rows, "id int, `a b` int, c string, d int, e int, f int").withColumn("l", bot.F.array("id"))
        names = [c for c in df.columns[:-1] if all(r[df.columns.index(c)] is not None for r in rows)]
        tells = lambda own: len({tuple(r[df.columns.index(c)] for c in own) for r in rows}) == n
        keys = []
        for size in (1, 2, 3):
            keys += [set(own) for own in combinations(names, size) if tells(own) and not any(k <= set(own) for k in keys)]
        assert sorted(map(sorted, keys)) == sorted(sorted(r.columns) for r in catalog.minimal_keys(df).collect())


def test_tunnels_are_polled(spark):
    lists = [[], None, [(0, "http://a")], [(1, "https://b"), (0, "https://c"), (2, "http://d")]]

    def read():
        now = lists.pop(0)
        return spark.table("no_such_table") if now is None else spark.createDataFrame(now, "position int, public_url string")

    assert bot.poll_tunnel(read, 10, 0.0) == "https://c" and not lists
    assert bot.poll_tunnel(lambda: spark.createDataFrame([], "position int, public_url string"), 2, 0.0) is None


def test_new_ids_and_secrets(spark):
    from siftwell import schema
    from siftwell.operators import conversation

    asked = spark.createDataFrame([(1, "s"), (2, " "), (3, None)], "qid int, session_id string")
    rows = {r.qid: r for r in conversation.with_new_ids(asked).collect()}
    assert rows[1].session_id == "s" and len({r.interaction_id for r in rows.values()}) == 3 and len(rows[2].session_id) == len(rows[3].session_id) == 36
    assert len(conversation.with_new_ids(asked.select("qid")).head().session_id) == 36
    assert schema.shown(spark.createDataFrame([("u", "x", "y")], "repo_url string, Credentials string, name string")).columns == ["repo_url", "name"]


def test_progress_is_told_while_a_query_runs(spark, tmp_path):
    import time

    from siftwell.streaming import streams

    spark.range(5).write.parquet(str(tmp_path / "in"))
    said = []
    with streams.told(spark, lambda stage, facts: said.append((stage, facts))):
        q = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).queryName("told").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if any(stage == "over" for stage, _ in said):
                break
            time.sleep(0.1)
    assert said[0] == ("started", {"name": "told"}) and ("batch 0", {"rows": 5}) in said and said[-1][0] == "over"
