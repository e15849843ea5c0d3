"""Queries of smaller functions: cells, keys, statuses, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, headers, text
from ..operators import answers, bot, cache, fusion, history, ingest, keyword, sheets
from . import standins as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 3 = 1 AS failed, CASE WHEN event_id % 3 = 0 THEN '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' ELSE '{}' END AS again FROM events")
def metadata_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata read leniently and strictly, and written again: of every three
    events one has its own, one a text that is no JSON, one a blank."""
    n = F.col("event_id") % 3
    raw = F.when(n == 0, F.col("props")).when(n == 1, "{broken").otherwise(" ")
    m = codec.metadata(F.col("raw"))
    return S.load(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), codec.metadata_error(F.col("raw")).isNotNull().alias("failed"), codec.metadata_json(m).alias("again"))


@query("SELECT doc_id, '[\"' || source || '\",\"' || lang || '\"]' AS raw, 2 AS n, lang AS last FROM documents")
def sources_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of sources as JSON and back."""
    raw = codec.sources_json(F.array("source", "lang"))
    back = codec.sources(F.col("raw"))
    return S.load(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", "raw", F.size(back).alias("n"), F.get(back, F.lit(1)).alias("last"))


@query("SELECT s_suppkey, 'db' || s_suppkey || '.example.com' AS host, CASE WHEN s_suppkey % 2 = 0 THEN 6000 + s_nationkey ELSE 5432 END AS port, 'n' || s_nationkey AS database FROM supplier")
def database_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database addresses with and without a port, taken apart."""
    port = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(":"), F.col("s_nationkey") + 6000)).otherwise("")
    url = F.concat(F.lit("jdbc:postgresql://db"), "s_suppkey", F.lit(".example.com"), port, F.lit("/n"), "s_nationkey")
    return S.load(spark, sf_dir, "supplier").select("s_suppkey", codec.database_parts(url).alias("p")).select("s_suppkey", "p.*")


@query(
    f"""WITH q AS (SELECT o_orderkey AS qid, o_orderkey % 4 = 0 AS cached, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderkey % 7 END AS k FROM orders)
SELECT qid, n, CASE n WHEN 0 THEN 'send' WHEN ends THEN 'delete' ELSE 'edit' END AS kind,
       CASE WHEN n = 0 THEN '{bot.THINKING}' WHEN n = ends THEN NULL WHEN cached THEN '{bot.CACHE_HIT.replace("'", "''")}' WHEN n = 1 THEN '{bot.SEARCHING}'
            ELSE '{bot.FOUND}' || k || '{bot.SOURCE}' || CASE WHEN k = 1 THEN '' ELSE 's' END || '{bot.DRAFTING}' END AS text
FROM (SELECT *, unnest(range(0, ends + 1)) AS n FROM (SELECT *, CASE WHEN cached OR k IS NULL THEN 2 ELSE 3 END AS ends FROM q))"""
)
def status_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as questions: cached ones, some without a draft, the rest."""
    k = F.col("o_orderkey")
    asked = S.load(spark, sf_dir, "orders").select(k.alias("qid"), F.lit("r").alias("room_id"), (k % 4 == 0).alias("cached"), F.when(k % 4 != 1, k % 7).alias("n_sources"))
    return bot.status_edits(asked).select("qid", "n", "kind", "text")


@query("SELECT s_suppkey AS repository_id, unnest([0, 1]) AS n, unnest([CASE WHEN s_suppkey % 3 = 0 THEN 'CLONING' ELSE 'SYNCING' END, CASE WHEN s_suppkey % 4 = 0 THEN 'FAILED' ELSE 'READY' END]) AS status FROM supplier")
def sync_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sync goes through: first ones and later ones, some failing."""
    k = F.col("s_suppkey")
    return history.sync_states(S.load(spark, sf_dir, "supplier").select(k.alias("repository_id"), F.when(k % 3 != 0, "h").alias("previous"), F.when(k % 4 == 0, "e").alias("error")))


@query("SELECT doc_id AS chunk_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x = 'the')) AS tf FROM documents WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'the')")
def exact_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with one exact term."""
    return keyword.exact_term(keyword.postings(S.chunks(spark, sf_dir)), "the")


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_size || '.0' WHEN 2 THEN 'true' WHEN 3 THEN 'A1+' || p_size ELSE '' END AS text, p_name AS base, substr(p_type, 1, 3) AS cut FROM part")
def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every kind as text; base names of paths; cut texts."""
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "string").when(k == 1, "number").when(k == 2, "boolean").when(k == 3, "formula").otherwise("error")
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_size").cast("string")).when(k == 2, "TRUE").when(k == 3, F.concat(F.lit("A1+"), "p_size")).otherwise("#REF!")
    return S.load(spark, sf_dir, "part").select("p_partkey", sheets.cell_text(kind, raw).alias("text"), sheets.base_name(F.concat(F.lit("C:\\x/"), "p_name")).alias("base"), history.truncated(F.col("p_type"), 3).alias("cut"))


@query("SELECT '=== Sheet: ' || sheet || ' ===' || chr(10) || string_agg(n || '.0 | ' || name, chr(10) ORDER BY n) AS part FROM (SELECT p_brand AS sheet, p_partkey AS n, trim(p_name) AS name FROM part) GROUP BY sheet")
def workbook_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks as flat text: a title per sheet, cells joined by bars."""
    p = S.load(spark, sf_dir, "part")
    values = F.array(F.struct(F.lit("number").alias("kind"), F.col("p_partkey").cast("string").alias("raw")), F.struct(F.lit("string").alias("kind"), F.col("p_name").alias("raw")))
    cells = p.select(F.col("p_brand").alias("workbook"), F.col("p_brand").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), F.posexplode(values).alias("col", "v")).select("workbook", "sheet", "row", "col", "v.kind", "v.raw")
    return sheets.flat_text(cells).select(F.col("text").alias("part"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'old' ELSE p_name END AS price_key, p_size % 3 = 2 AS kept FROM part")
def legacy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old key names renamed; a value under the new name wins."""
    k = F.col("p_size") % 3
    m = F.when(k == 0, F.create_map(F.lit("priceKeyId"), F.lit("old"), F.lit("priceKey"), F.lit(" "))).when(k == 1, F.create_map(F.lit("priceKeyId"), F.lit("old"), F.lit("priceKey"), "p_name")).otherwise(F.create_map(F.lit("priceKey"), F.col("p_name")))
    p = S.load(spark, sf_dir, "part").select("p_partkey", "p_size", m.alias("m"))
    return p.select("p_partkey", F.element_at(headers.reconcile_legacy(F.col("m")), F.lit("priceKey")).alias("price_key"), (F.col("p_size") % 3 == 2).alias("kept"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS first, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 5 AS VARCHAR) END AS last, 'Rule ID range: ' || p_size || CASE WHEN p_size % 2 = 0 THEN '-' || (p_size + 5) ELSE '' END AS note FROM part")
def range_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range notes in headers, as keys and as they stand."""
    h = F.concat(F.lit("Rule ID range: "), "p_size", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-"), F.col("p_size") + 5)).otherwise(F.lit("")))
    p = S.load(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("Name"), F.lit(None).cast("string"), h).alias("hs")).withColumn("m", headers.range_hints(F.col("hs")))
    return p.select("p_partkey", F.element_at("m", F.lit("ruleIdRangeStart")).alias("first"), F.element_at("m", F.lit("ruleIdRangeEnd")).alias("last"), headers.range_note(F.col("hs")).alias("note"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'FAILED' ELSE 'READY' END AS status, user_id + CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END AS total_commits, CASE WHEN event_id % 4 = 0 THEN 'before' WHEN event_id % 4 = 1 THEN 'before' ELSE 'new' END AS last_hash FROM events")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository states after sync runs of every outcome."""
    e = S.load(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    runs = e.select(F.col("event_id").alias("repository_id"), F.when(k == 0, "refused").alias("error"), F.col("event_id").alias("n_new"), F.col("user_id").alias("n_before"), F.when(k > 1, "new").alias("newest"), F.lit("before").alias("previous"))
    return history.sync_status(runs).select(F.col("repository_id").alias("event_id"), "status", "total_commits", "last_hash")


@query("SELECT count(*) AS total, count(*) FILTER (value > 5) AS succeeded, count(*) FILTER (NOT value > 5) AS failed FROM events")
def broadcast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bot.broadcast_summary(S.load(spark, sf_dir, "events").select((F.col("value") > 5).alias("ok")))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id || ':' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, n, ts AS written, ts, false AS hit FROM e WHERE n = 1
      UNION ALL SELECT e.key, e.n, CASE WHEN e.ts - r.written < INTERVAL 60 MINUTE THEN r.written ELSE e.ts END, e.ts, e.ts - r.written < INTERVAL 60 MINUTE FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT key) AS keys, CAST(0 AS BIGINT) AS evictions, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM r"""
)
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a simulated cache."""
    log = S.load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.lit("get").alias("kind"))
    return cache.stats(cache.simulate(log)).select("hits", "misses", "keys", "evictions", "hit_rate")


@query("SELECT event_id, ts + INTERVAL 1 HOUR AS local FROM events")
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committers' instants as their local time."""
    e = S.load(spark, sf_dir, "events")
    return e.select("event_id", history.wall_clock(F.col("ts").cast("timestamp"), F.lit("+01:00")).alias("local"))


@query(f"WITH {S.COMMITS_SQL} SELECT commit_hash, substr(commit_hash, 1, 8) AS short_hash, author_name, commit_date, short_message FROM k")
def commit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as a report lists them."""
    k = S.commits(spark, sf_dir).withColumns({"branch": F.lit("main"), "files_changed": F.lit(1), "deletions": F.lit(0)})
    return history.commit_listing(k).select("commit_hash", "short_hash", "author_name", "commit_date", "short_message")


@query("SELECT event_id, 'answer of ' || event_type AS answer, sha256(user_id || ':' || event_id) AS interaction_id FROM events")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared answers under interaction ids of their own."""
    e = S.load(spark, sf_dir, "events")
    cached = e.select(F.col("event_type").alias("key"), F.concat(F.lit("answer of "), "event_type").alias("answer"), F.array().cast("array<string>").alias("sources")).distinct()
    requests = e.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("request_id"))
    return answers.relabel(cached, requests).select(F.col("request_id").alias("event_id"), "answer", "interaction_id")


@query("SELECT doc_id, '{\"type\":\"AdaptiveCard\",\"version\":\"1.3\",\"body\":[{\"type\":\"TextBlock\",\"text\":\"Answer\",\"wrap\":true}],\"actions\":[{\"type\":\"Action.Submit\",\"title\":\"👍\",\"data\":{\"rating\":\"UP\",\"interactionId\":\"' || doc_id || '\"}},{\"type\":\"Action.Submit\",\"title\":\"👎\",\"data\":{\"rating\":\"DOWN\",\"interactionId\":\"' || doc_id || '\"}}]}' AS card FROM documents")
def answer_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load(spark, sf_dir, "documents").select("doc_id", answers.answer_card(F.lit("Answer"), F.col("doc_id").cast("string")).alias("card"))


@query("SELECT o_orderkey % 7 AS k, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN 40 ELSE 5 END AS pool FROM orders GROUP BY ALL")
def pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per leg: the multiple of k, never under k."""
    o = S.load(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 7).alias("k")).agg(F.count("*").alias("n"))
    return o.select("k", "n", F.when(F.col("n") % 2 == 0, fusion.pool_size(10, 4)).otherwise(fusion.pool_size(5, 0)).alias("pool"))


@query("WITH w AS (SELECT doc_id, greatest(CAST(ceil((length(text) - 10) / 490.0) AS BIGINT), 1) AS n FROM documents WHERE length(text) > 0) SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) IS NOT NULL AS counted FROM w")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that each document gives."""
    d = S.load(spark, sf_dir, "documents").filter("char_length(text) > 0")
    return d.select("doc_id", F.size(text.windows(F.col("text"))).cast("bigint").alias("n"), F.lit(True).alias("counted"))


@query("SELECT c_mktsegment AS source, CAST(count(*) AS INTEGER) AS kept FROM customer WHERE c_nationkey <> 3 GROUP BY ALL")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deleting keys leaves, counted."""
    c = S.load(spark, sf_dir, "customer")
    left = ingest.without(c, "c_nationkey", c.filter("c_nationkey = 3"))
    return left.groupBy(F.col("c_mktsegment").alias("source")).agg(F.count("*").cast("int").alias("kept"))
