"""Queries of ingestion, sheets, commit history, chat events and pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, headers, text
from ..operators import answers, bot, catalog, conversation, diffs, feedback, fusion, history, ingest, rerank, sheets
from ..operators.layout import spread
from ..sources import pages
from ..streaming import streams
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


FIRST = date(2024, 1, 1)


@query(
    f"""WITH {S.COMMITS_SQL}, d AS (SELECT CAST(min(commit_date) AS DATE) AS f, CAST(max(commit_date) AS DATE) AS l FROM k)
SELECT 'Sprint ' || (n + 1) AS name, f + CAST(n * 14 AS INTEGER) AS start_date, f + CAST(n * 14 + 13 AS INTEGER) AS end_date FROM (SELECT f, unnest(range(0, (l - f) // 14 + 1)) AS n FROM d)"""
)
def sprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprints from the first commit to the last."""
    return history.sprints_over(S.commits(spark, sf_dir)).select("name", "start_date", "end_date")


@query(
    """WITH e AS (SELECT event_id, event_type, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events),
m AS (SELECT *, max(t - n * 1200000000) OVER (PARTITION BY event_type ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT event_id, event_type, make_timestamp(CAST(greatest(t, coalesce(top + n * 1200000000 - 2400000000, t)) AS BIGINT)) AS send_at FROM m"""
)
def paced_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages, a sender for each type: one in twenty minutes, three at once."""
    e = S.load(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return bot.paced(e, 1_200_000, 3, "event_type", "ts", "event_id").select("event_id", "event_type", "send_at")


@query(
    """WITH r AS (SELECT user_id AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, value > 2 AS ok, ts FROM events),
l AS (SELECT target, max(attempt) AS attempt, arg_max(ok, attempt) AS ok, arg_max(ts, attempt) AS ts FROM r GROUP BY target)
SELECT target, CAST(attempt + 1 AS INTEGER) AS attempt, ts + to_microseconds(CAST(1000 * 2 ** least(attempt - 1, 20) AS BIGINT)) AS not_before FROM l WHERE NOT ok AND attempt < 500"""
)
def sends_due_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as results of sends to users: who is tried once more, and when."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = S.load(spark, sf_dir, "events").select(F.col("user_id").alias("target"), n.alias("attempt"), (F.col("value") > 2).alias("ok"), F.col("ts").alias("finished_at"))
    return bot.due_again(r, 500, 1)


def _subsets() -> str:
    from itertools import combinations

    names = ("conv_id", "turn", "role", "text")
    full = lambda own: " AND ".join(f"count({c}) = count(*)" for c in own)
    return " UNION ALL ".join(f"SELECT {list(own)} AS columns, count(DISTINCT ({', '.join(own)})) = count(*) AND {full(own)} AS u FROM conversations" for n in (1, 2, 3) for own in combinations(names, n))


@query(f"WITH s AS ({_subsets()}) SELECT columns FROM s WHERE u AND NOT EXISTS (SELECT 1 FROM s o WHERE o.u AND len(o.columns) < len(s.columns) AND list_has_all(s.columns, o.columns))")
def table_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sets of columns of conversations that tell its rows apart."""
    return catalog.minimal_keys(S.load(spark, sf_dir, "conversations"))


_IN = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'"


@query(f"WITH {S.COMMITS_SQL}, a AS (SELECT author_name, author_email, count(*) AS n FROM k WHERE {_IN.replace('ts', 'commit_date')} AND repository_id = 'click' GROUP BY ALL) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, string_agg(author_name || '=' || n, ',' ORDER BY n DESC, author_name, author_email) AS authors FROM a")
def date_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and authors of one repository between two days."""
    out = history.date_report(S.commits(spark, sf_dir), date(2024, 1, 5), date(2024, 1, 20), "click")
    said = F.array_join(F.transform("authors", lambda a: F.concat(a["author_name"], F.lit("="), a["n"])), ",")
    return out.select("total", F.when(F.size("authors") > 0, said).alias("authors"))


@query(f"WITH {S.COMMITS_SQL} SELECT author_name, author_email, count(*) AS n_commits FROM k WHERE {_IN.replace('ts', 'commit_date')} GROUP BY ALL")
def author_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.author_breakdown(history.in_range(S.commits(spark, sf_dir), date(2024, 1, 5), date(2024, 1, 20)))


@query(
    f"""WITH {S.COMMITS_SQL}, sp AS (SELECT n, 'Sprint ' || n AS name, DATE '2024-01-01' + CAST((n - 1) * 14 AS INTEGER) AS a, CASE WHEN n = 2 THEN 'click' END AS scope FROM (SELECT unnest(range(1, 5)) AS n)),
j AS (SELECT name, author_name, count(commit_hash) AS n FROM sp LEFT JOIN k ON commit_date >= a AND commit_date < a + 14 AND (scope IS NULL OR scope = repository_id) GROUP BY ALL)
SELECT name, CAST(sum(n) AS BIGINT) AS total, count(author_name) AS n_authors, arg_max(author_name, (n, author_name)) AS top_author FROM j GROUP BY name"""
)
def sprint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sprints in one range join; one is limited to a repository."""
    s = history.generate_sprints(spark, FIRST, 4).withColumn("repository_id", F.when(F.col("id") == "2", "click"))
    out = history.sprint_report(s, S.commits(spark, sf_dir))
    top = F.array_max(F.transform("authors", lambda a: F.struct(a["n"], a["author_name"])))["author_name"]
    return out.select("name", F.col("total").cast("bigint").alias("total"), F.size("authors").cast("bigint").alias("n_authors"), top.alias("top_author"))


@query(
    f"""WITH {S.COMMITS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY commit_date DESC, event_id DESC) AS n FROM k),
f AS (SELECT *, max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY repository_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS seen FROM o)
SELECT repository_id, commit_hash FROM f WHERE seen = 0 AND n <= 20000"""
)
def commit_sync_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commits before the first known one."""
    k = S.commits(spark, sf_dir).withColumn("position", F.struct((-F.unix_micros(F.col("commit_date").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("e")))
    return history.new_commits(k, k.filter("event_id % 97 = 0")).select("repository_id", "commit_hash")


@query("SELECT event_type AS repository_id, CAST(user_id AS VARCHAR) AS commit_hash, CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(DISTINCT event_id % 10) END AS INTEGER) AS files_changed, CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE sum(CAST(floor(value) AS BIGINT)) END AS INTEGER) AS insertions FROM events GROUP BY event_type, user_id")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines per commit; merges count nothing."""
    edits = S.load(spark, sf_dir, "events").select(F.col("event_type").alias("repository_id"), F.col("user_id").cast("string").alias("commit_hash"), F.when(F.col("user_id") % 5 == 0, 2).otherwise(1).alias("n_parents"), (F.col("event_id") % 10).alias("file"), F.floor("value").alias("insertions"), F.lit(0).alias("deletions"))
    return history.diff_stats(edits).select("repository_id", "commit_hash", "files_changed", "insertions")


@query("SELECT CAST(conv_id AS VARCHAR) AS repository_id, CAST(turn AS VARCHAR) AS commit_hash, 1 AS files_changed, CAST(1 + len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS INTEGER) AS insertions, 0 AS deletions FROM conversations")
def commit_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as repositories: a file of all that each role has said, and
    a commit for each turn; stats from the contents of the trees."""
    c = S.load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("repository_id"), "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("said"))
    before = F.lag("turn").over(Window.partitionBy("repository_id").orderBy("turn"))
    commits = c.select("repository_id", F.col("turn").cast("string").alias("commit_hash"), F.array_compact(F.array(before.cast("string"))).alias("parents"))
    upto = c.join(c.select("repository_id", F.col("turn").alias("at")), "repository_id").filter("turn <= at").groupBy("repository_id", "at", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("all"))
    versions = upto.select("repository_id", F.col("at").cast("string").alias("commit_hash"), F.concat(F.col("role"), F.lit(".txt")).alias("path"), F.array_join(F.transform("all", lambda x: x["said"]), "").alias("content"))
    return diffs.stats(versions, commits)


@query(f"WITH {S.COMMITS_SQL} SELECT commit_hash, substr(commit_hash, 1, 8) AS short_hash, 'Repository: ' || repository_id || chr(10) || 'Branch: main' || chr(10) || 'Commit: ' || substr(commit_hash, 1, 8) || chr(10) || 'Author: ' || author_name || ' <' || author_email || '>' || chr(10) || 'Date: ' || strftime(commit_date, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'Message: ' || short_message || chr(10) || 'Files changed: 1 (+' || insertions || ' / -0)' AS text FROM k")
def commit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.commits(spark, sf_dir).withColumns({"branch": F.lit("main"), "full_message": F.lit(" "), "files_changed": F.lit(1), "deletions": F.lit(0)})
    return k.select("commit_hash", F.substring("commit_hash", 1, 8).alias("short_hash"), history.commit_text(F.col("repository_id")).alias("text"))


@query("SELECT p_brand, p_type, CASE WHEN p_type IN ('ECONOMY') THEN 'general' ELSE 'general' END AS plain_type, CASE WHEN p_brand LIKE '%1' THEN 'optionalOffering' WHEN p_brand LIKE '%2' THEN 'complexFlatRule' WHEN p_brand LIKE '%3' THEN 'rule' WHEN p_brand LIKE '%4' THEN 'priceListItem' ELSE 'general' END AS sheet_type FROM part GROUP BY p_brand, p_type")
def sheet_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of sheets by parts of their names."""
    p = S.load(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    ends = lambda n: F.col("p_brand").endswith(n)
    name = F.concat("p_type", F.when(ends("1"), " PrP Optional Offering").when(ends("2"), " Complex-Flat Rules").when(ends("3"), " rule book").when(ends("4"), " Price List").otherwise(" misc"))
    return p.select("p_brand", "p_type", classify.sheet_type(F.col("p_type")).alias("plain_type"), classify.sheet_type(name).alias("sheet_type"))


@query(f"WITH {S.SHEETS_SQL}, k AS (SELECT * FROM (VALUES (0, 'ruleId'), (1, 'offeringName'), (2, 'priceKey'), (3, 'partCode')) AS x(col, key)) SELECT DISTINCT 'catalog.xlsx' AS workbook, sheet, key, CAST(col AS INTEGER) AS col FROM s, k")
def header_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column gives which metadata key, per sheet."""
    heads = sheets.header_rows(sheets.rows_of(S.cells(spark, sf_dir)))
    return headers.match_headers(heads.select("workbook", "sheet", F.inline("headers")))


@query(
    f"""WITH {S.SHEETS_SQL} SELECT sheet, sheet_type, CAST(row_start AS INTEGER) AS row_start, CAST(row_start AS INTEGER) AS row_end,
'Workbook: catalog.xlsx' || chr(10) || 'Sheet: ' || sheet || chr(10) || 'Row: ' || row_start || chr(10) || '  Rule ID: ' || n || '.0' || chr(10) || '  Offering Name: ' || name || chr(10) || CASE WHEN pk <> '' THEN '  Price Key Id: ' || pk || chr(10) ELSE '' END || '  Part Code: ' || code || chr(10) AS text,
n || '.0' AS rule_id, name AS offering, nullif(pk, '') AS price_key FROM s"""
)
def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per data row, with what its headers mean."""
    c = sheets.chunk_rows(S.cells(spark, sf_dir))
    at = lambda k: F.element_at("fields", F.lit(k))
    return c.select("sheet", "sheet_type", "row_start", "row_end", "text", at("ruleId").alias("rule_id"), at("offeringName").alias("offering"), at("priceKey").alias("price_key"))


@query(f"WITH {S.SHEETS_SQL} SELECT sheet, CAST(row_start AS INTEGER) AS row_start, 'ruleId=' || n || ' is outside its sheet''s documented range (100-900)' AS warnings FROM s WHERE warned")
def range_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose identifier is outside the range that the header notes."""
    c = sheets.chunk_rows(S.cells(spark, sf_dir)).withColumn("chunk_id", F.concat_ws(":", "sheet", "row_start"))
    return sheets.range_warnings(c, None).select("sheet", "row_start", "warnings")


@query(f"WITH {S.SHEETS_SQL} SELECT count(*) AS scanned, count(*) FILTER (n % 2 = 0 OR warned) AS updated, count(*) FILTER (n % 2 = 0) AS reconciled, count(*) FILTER (warned) AS new_warnings FROM s")
def backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of bringing stored metadata up to date."""
    p = S.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("sheet"))
    key = F.when(F.col("n") % 2 == 0, "priceKeyId").otherwise("priceKey")
    fields = F.create_map(key, F.lit("K1"), F.lit("ruleId"), F.col("n").cast("string"), F.lit("ruleIdRangeStart"), F.lit("100"), F.lit("ruleIdRangeEnd"), F.lit("900"))
    chunks = p.select("sheet", F.lit("EXCEL").alias("type"), F.lit("general").alias("sheet_type"), fields.alias("fields"))
    return sheets.backfill(chunks)[1]


@query(f"WITH {S.SHEETS_SQL} SELECT sheet, count(*) AS n_chunks FROM s WHERE sheet_type = 'general' GROUP BY sheet")
def unclassified_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.unclassified(sheets.chunk_rows(S.cells(spark, sf_dir))).select("sheet", "n_chunks")


_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<head[^>]*>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS title, trim(regexp_replace({_HTML}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text and title of every page."""
    return pages.page_documents(spread(S.load(spark, sf_dir, "pages"))).select("page_id", "title", "text")


@query("WITH d AS (SELECT doc_id, text, greatest(CAST(ceil((length(text) - 10) / 490.0) AS BIGINT), 1) AS k FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(n AS INTEGER) AS n, substr(text, n * 490 + 1, 500) AS chunk FROM (SELECT *, unnest(range(0, k)) AS n FROM d)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of 500 characters, overlapping by 10."""
    d = spread(S.load(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.explode(text.windows(F.col("text"), 500, 10)).alias("w")).select("doc_id", "w.n", F.col("w.text").alias("chunk"))


@query(f"WITH {S.FILES_SQL} SELECT name AS source, type, CAST(sum(CASE WHEN length(text) > 0 THEN greatest(CAST(ceil((length(text) - 10) / 490.0) AS BIGINT), 1) ELSE 0 END) AS INTEGER) AS chunk_count FROM c GROUP BY ALL")
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per source, as the registry counts them."""
    docs = S.chunks(spark, sf_dir).select(F.col("name").alias("source"), "name", "type", "text")
    return ingest.registry_of_texts(docs).select("source", "type", "chunk_count")


@query(
    """WITH o AS (SELECT o_custkey % 50 AS b, o_orderstatus AS s FROM orders), g AS (SELECT b, count(*) AS total, count(*) FILTER (s IN ('O', 'F') AND b % 3 <> 1) AS ok, count(*) FILTER (s = 'P' OR (b % 3 = 1 AND s <> 'P') ) AS bad, FROM o WHERE b % 3 <> 2 OR s <> 'P' GROUP BY b)
SELECT CAST(b AS VARCHAR) AS batch_id, total, ok AS success_count, bad AS failure_count, greatest(0, total - ok - bad) AS pending_count, CASE WHEN ok + bad < total THEN 'RUNNING' WHEN bad = 0 THEN 'COMPLETED' WHEN ok = 0 THEN 'FAILED' ELSE 'COMPLETED_WITH_ERRORS' END AS status FROM g"""
)
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as file outcomes of 50 batches: counts and status."""
    o = S.load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("b"), F.col("o_orderstatus").alias("s")).filter("b % 3 <> 2 or s <> 'P'")
    o = o.withColumn("batch_id", F.col("b").cast("string"))
    batches = o.groupBy("batch_id").agg(F.count("*").alias("total_files"))
    good = o.filter("s in ('O', 'F') and b % 3 <> 1")
    bad = o.filter("s = 'P' or b % 3 = 1")
    out = ingest.batch_report(batches, good, bad)
    return out.select("batch_id", F.col("total_files").alias("total"), "success_count", "failure_count", "pending_count", "status")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 3)")
def delete_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry without some sources."""
    d = S.load(spark, sf_dir, "documents").select("doc_id", "source")
    return ingest.without(d, "source", d.filter("doc_id < 3"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence as a semi-join."""
    known = S.load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return S.load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(known, "c_custkey", "left_semi")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'UP' WHEN turn % 3 = 1 THEN 'DOWN' END AS vote, CASE WHEN turn % 4 < 2 THEN upper(CASE WHEN turn % 4 = 0 THEN 'up' ELSE 'down' END) END AS rating FROM conversations")
def feedback_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are votes, and ratings as they are parsed."""
    t = F.col("turn")
    reply = F.when(t % 3 == 0, " Thumbs Up").when(t % 3 == 1, "👎🏽").otherwise(F.col("text"))
    raw = F.when(t % 4 == 0, " up ").when(t % 4 == 1, "Down").when(t % 4 == 2, "meh")
    return S.load(spark, sf_dir, "conversations").select("conv_id", "turn", classify.feedback_shortcut(reply).alias("vote"), classify.rating(raw).alias("rating"))


@query("SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN least(10, user_id) ELSE 7 END AS INTEGER) AS score FROM events")
def llm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from model replies of several shapes."""
    e = F.col("event_id") % 6
    reply = F.when(e == 0, "10/10").when(e == 1, "-5").when(e == 2, "none").when(e == 3, "99999999999").when(e == 4, F.concat(F.lit("score: "), "user_id")).otherwise("7.9")
    return S.load(spark, sf_dir, "events").select("event_id", rerank.parse_llm_score(reply).alias("score"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS n_first, CAST(1 AS INTEGER) AS n_other FROM part")
def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from the text form of a search vector."""
    raw = F.concat(F.lit("'it''s':"), F.array_join(F.transform(F.sequence(F.lit(1), "p_size"), lambda i: i.cast("string")), ","), F.lit(" 'code':3"))
    m = text.parse_vector_text(raw)
    return S.load(spark, sf_dir, "part").select("p_partkey", F.element_at(m, F.lit("it's")).alias("n_first"), F.element_at(m, F.lit("code")).alias("n_other"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ', Row ' || p_size WHEN p_size % 3 = 1 THEN p_brand || ', Rows ' || p_size || '-' || (p_size + 4) ELSE p_brand END AS locator, 'name=' || p_name || ', type=' || p_type AS summary, substr(p_name, 1, 200) || '...' AS excerpt FROM part")
def locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chunk stands in its workbook, its fields, its excerpt."""
    n = F.col("p_size")
    start, end = F.when(n % 3 < 2, n), F.when(n % 3 == 0, n).when(n % 3 == 1, n + 4)
    fields = F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name")
    return S.load(spark, sf_dir, "part").select("p_partkey", fusion.locator(F.col("p_brand"), start, end).alias("locator"), fusion.field_summary(fields).alias("summary"), text.excerpt(F.col("p_name")).alias("excerpt"))


_AZ = "chr(65 + CAST({0} AS INTEGER))"


@query(f"WITH p AS (SELECT p_partkey % 18278 AS n, p_partkey FROM part) SELECT p_partkey, n, CASE WHEN n < 26 THEN {_AZ.format('n')} WHEN n < 702 THEN {_AZ.format('n // 26 - 1')} || {_AZ.format('n % 26')} ELSE {_AZ.format('(n - 702) // 676')} || {_AZ.format('(n - 702) // 26 % 26')} || {_AZ.format('n % 26')} END AS letter FROM p")
def column_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of up to three letters, over and over."""
    n = F.col("p_partkey") % 18278
    return S.load(spark, sf_dir, "part").select("p_partkey", n.alias("n"), headers.column_letter(n).alias("letter"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'create' WHEN n_nationkey % 4 = 1 THEN 'keep' ELSE 'update' END AS action, CASE WHEN n_nationkey % 4 > 0 THEN 'w' || n_nationkey || 'a' END AS id FROM nation UNION ALL SELECT n_name, 'delete', 'w' || n_nationkey || 'b' FROM nation WHERE n_nationkey % 4 = 3")
def webhook_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as hooks: none, a current, a stale one, and duplicates."""
    n = S.load(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    have = n.filter(k % 4 > 0).select(F.col("n_name").alias("name"), F.concat(F.lit("w"), k, F.lit("a")).alias("id"), F.when(k % 4 == 1, "https://new").otherwise("https://old").alias("target_url"), F.lit("active").alias("status"), F.lit("2024-01-01").alias("created"))
    twice = n.filter(k % 4 == 3).select(F.col("n_name").alias("name"), F.concat(F.lit("w"), k, F.lit("b")).alias("id"), F.lit("https://new").alias("target_url"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("created"))
    return bot.plan_webhooks(n.select(F.col("n_name").alias("name"), F.lit("https://new").alias("target_url")), have.unionByName(twice)).select("name", "action", "id")


@query("SELECT DISTINCT 'email' AS kind, c_mktsegment || '@example.com' AS target FROM customer UNION SELECT DISTINCT 'room', 'room ' || c_nationkey FROM customer UNION SELECT DISTINCT 'room', 'room ' || s_nationkey FROM supplier")
def broadcast_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets of a broadcast."""
    room = lambda df, c: df.select(F.concat(F.lit(" room "), c).alias("target"))
    emails = S.load(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit("@example.com ")).alias("target"))
    return bot.plan_broadcast(emails, room(S.load(spark, sf_dir, "customer"), "c_nationkey"), room(S.load(spark, sf_dir, "supplier"), "s_nationkey"))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def url_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls at which the polled value changed."""
    e = S.load(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("url"), "event_id")
    return bot.url_changes(e).select("event_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours of events; an extension."""
    return streams.event_windows(S.load(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))



_NAMED = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    f"""WITH RECURSIVE s AS (SELECT event_id, CAST(user_id AS VARCHAR) AS room_id, ts, event_id % 11 = 0 AS act, CASE event_id % 5 WHEN 0 THEN 'what is this?' WHEN 1 THEN '👍' WHEN 2 THEN 'skip' WHEN 3 THEN 'not helpful' ELSE 'thank you' END AS text FROM events),
e AS (SELECT *, CASE WHEN text IN ({_NAMED(classify.THUMBS_UP)}) THEN 'UP' WHEN text IN ({_NAMED(classify.THUMBS_DOWN)}) THEN 'DOWN' END AS said, row_number() OVER (PARTITION BY room_id ORDER BY ts, event_id) AS i FROM s),
r AS (SELECT CAST(NULL AS BIGINT) AS event_id, room_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS BIGINT) AS i, '' AS action, CAST(NULL AS VARCHAR) AS interaction_id, CAST(NULL AS VARCHAR) AS rating, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS latest FROM (SELECT DISTINCT room_id FROM e)
      UNION ALL
      SELECT event_id, room_id, ts, i, action, CASE WHEN action IN ('comment', 'skip') THEN asked WHEN act THEN 'i' WHEN action = 'question' THEN own WHEN action = 'vote' THEN latest END,
             CASE WHEN act THEN 'UP' WHEN action IN ('vote', 'nothing_to_rate') THEN said END, CASE WHEN action IN ('comment', 'question') THEN text END, CASE WHEN action = 'question' THEN own ELSE latest END
      FROM (SELECT e.*, r.latest, r.interaction_id AS asked, sha256(e.room_id || ':' || e.event_id) AS own,
                   CASE WHEN e.act THEN 'vote' WHEN r.action = 'vote' AND e.ts < r.ts + INTERVAL 5 MINUTE THEN CASE WHEN e.text IN ({_NAMED(classify.SKIP_COMMENT)}) THEN 'skip' ELSE 'comment' END
                        WHEN e.said IS NOT NULL THEN CASE WHEN r.latest IS NULL THEN 'nothing_to_rate' ELSE 'vote' END ELSE 'question' END AS action
            FROM r JOIN e ON e.room_id = r.room_id AND e.i = r.i + 1))
SELECT event_id, room_id, ts, action, interaction_id, rating, text FROM r WHERE i > 0"""
)
def bot_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as chat events of one room per user, by the state machine."""
    e = F.col("event_id") % 5
    said = F.when(e == 0, "@bot what is this?").when(e == 1, "👍").when(e == 2, "skip").when(e == 3, "@bot not helpful").otherwise("thank you")
    src = S.load(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("room_id"), "ts", F.when(F.col("event_id") % 11 == 0, "action").otherwise("message").alias("kind"), F.lit("i").alias("interaction_id"), F.lit("up").alias("rating"), said.alias("text"), F.lit("p").alias("person_id"))
    return bot.route_events(bot.relevant(src, "me"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace('@bot  ' || text, '^@\\S+\\s*', ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS said FROM conversations")
def mention_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load(spark, sf_dir, "conversations").select("conv_id", "turn", bot.strip_mention(F.concat(F.lit(" @bot  "), "text")).alias("said"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of a JSON metadata bag."""
    return S.load(spark, sf_dir, "events").select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.lit("k")).alias("k"))


@query(f"WITH {S.MESSAGES_SQL} SELECT m.interaction_id, CASE WHEN created_at % 2 = 1 THEN 'UP' ELSE 'DOWN' END AS rating, created_at % 4 < 2 AS found FROM m WHERE role = 'ASSISTANT'")
def vote_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes matched with the answers they rate; the rest is not found."""
    m = S.messages(spark, sf_dir).filter("role = 'ASSISTANT'").withColumn("sources", F.array(F.lit("s")))
    v = m.select("interaction_id", F.when(F.col("created_at") % 2 == 1, "UP").otherwise("DOWN").alias("rating"))
    ok, lost = feedback.submit(m.filter("created_at % 4 < 2").select("interaction_id", "session_id", "content", "sources"), v)
    return ok.select("interaction_id", "rating", F.lit(True).alias("found")).unionByName(lost.select("interaction_id", "rating", F.lit(False).alias("found")))


@query("SELECT doc_id, 'Answer' || chr(10) || chr(10) || '**Sources:**' || chr(10) || '- ' || source || ' (' || lang || ')' || chr(10) || chr(10) || chr(10) || '_Reply 👍 or 👎 to rate this answer._' AS reply FROM documents")
def reply_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array(F.struct(F.col("source"), F.col("lang").alias("type")))
    return S.load(spark, sf_dir, "documents").select("doc_id", answers.reply_text(F.lit("Answer"), refs).alias("reply"))


@query("SELECT supplier.s_suppkey, 'Owner/' || s_name AS name FROM supplier")
def repository_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://git.example.com/Owner/"), F.regexp_replace("s_name", "/", "-"), F.when(F.col("s_suppkey") % 2 == 0, ".git").otherwise("/"))
    return S.load(spark, sf_dir, "supplier").select("s_suppkey", history.repository_name(url).alias("name"))


@query("SELECT p_partkey, p_name AS offering FROM part")
def business_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata without structural keys and blanks."""
    m = F.create_map(F.lit("source"), F.lit("x"), F.lit("offeringName"), "p_name", F.lit("bundleId"), F.lit(" "), F.lit("rowStart"), F.lit("3"))
    kept = headers.without_reserved(m)
    return S.load(spark, sf_dir, "part").select("p_partkey", F.when(F.size(kept) == 1, F.element_at(kept, F.lit("offeringName"))).alias("offering"))


@query(f"WITH {S.MESSAGES_SQL} SELECT session_id, created_at FROM m WHERE session_id <> 1")
def delete_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.delete_session(S.messages(spark, sf_dir), 1).select("session_id", "created_at")
