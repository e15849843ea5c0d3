"""Queries of retrieval, ranking, feedback and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Cache, Hybrid, Rerank, Retrieval
from ..functions import classify, text
from ..functions.embed import embed_udf
from ..operators import answers, cache, conversation, feedback, fusion, keyword, rerank, vector
from ..operators.layout import spread
from ..operators.scratch import stored
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


_PAIRS = f"""{S.VECTORS_SQL}, {S.QUESTIONS_SQL},
s AS (SELECT qid, intent, chunk_id, category, source, type, text, (1 + list_cosine_similarity(qe, e)) / 2 AS score FROM q, v)"""
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)"


@query(f"WITH {_PAIRS} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM s WHERE score >= 0.5) WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 5 above the score floor."""
    found = vector.top_k(S.questions(spark, sf_dir), S.vectors(spark, sf_dir).select("chunk_id", "embedding"), 5, 0.5)
    return found.select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_PAIRS} SELECT qid, chunk_id, category, rank, round(score, 6) AS score FROM (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM s WHERE category IN ('fds', 'rules')) WHERE rank <= 5")
def vector_topk_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 among two categories."""
    found = vector.top_k(S.questions(spark, sf_dir), S.vectors(spark, sf_dir).select("chunk_id", "category", "embedding"), 5, categories=("fds", "rules"))
    return found.select("qid", "chunk_id", "category", "rank", F.round("score", 6).alias("score"))


_FLOOR = 0.62
_ROUTED = f"""WITH {_PAIRS}, r AS (SELECT *, CASE WHEN intent = 'LOOKUP' THEN category = 'catalog' ELSE category IN ('fds', 'brd', 'rules', 'general') END AS inside FROM s WHERE score >= {_FLOOR}),
a AS (SELECT *, bool_or(inside) OVER (PARTITION BY qid) AS hit FROM r)
SELECT qid, intent, chunk_id, category, NOT hit AS fallback, rank, round(score, 6) AS score
FROM (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM a WHERE inside OR NOT hit) WHERE rank <= 5"""


@query(_ROUTED)
def routed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval by intent with fallback."""
    found = vector.routed(S.questions(spark, sf_dir), S.vectors(spark, sf_dir).select("chunk_id", "category", "embedding"), 5, Retrieval(min_score=_FLOOR))
    return found.select("qid", "intent", "chunk_id", "category", "fallback", "rank", F.round("score", 6).alias("score"))


_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_INDEX = f"""{S.FILES_SQL}, w AS (SELECT chunk_id, {_TOKENS} AS t FROM c), tok AS (SELECT chunk_id, len(list_distinct(t)) AS dl, unnest(t) AS term FROM w),
ix AS (SELECT term, chunk_id, dl, count(*) AS tf FROM tok GROUP BY ALL), st AS (SELECT greatest(count(*), 1) AS n, coalesce(nullif(avg(len(list_distinct(t))), 0), 1) AS a FROM w),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term)"""
_ASKED = "qt AS (SELECT qid, len(ts) AS nt, unnest(ts) AS term FROM (SELECT qid, list_distinct(list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda x: x <> '')) AS ts FROM t))"
_BM25 = f"""WITH {_INDEX}, {S.TERMS_SQL}, {_ASKED},
hit AS (SELECT qid, chunk_id, nt, count(*) AS m, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / a))) AS bm25
        FROM qt JOIN ix USING (term) JOIN df USING (term), st GROUP BY ALL),
kw AS (SELECT qid, chunk_id, bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, chunk_id) AS rank FROM hit WHERE bm25 > 0 AND {{0}})"""


@query(f"WITH {_INDEX} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, CAST(max(tf) AS BIGINT) AS max_tf FROM ix GROUP BY term")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings, added up per term."""
    return keyword.postings(S.chunks(spark, sf_dir)).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.max("tf").alias("max_tf"))


@query(f"WITH {_INDEX} SELECT CAST(n AS BIGINT) AS n_docs, round(a, 6) AS avg_dl FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.corpus_stats(S.chunks(spark, sf_dir)).select(F.col("n_docs").cast("bigint").alias("n_docs"), F.round("avg_dl", 6).alias("avg_dl"))


@query(f"WITH {_INDEX} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.doc_freq(keyword.postings(S.chunks(spark, sf_dir)))


def _bm25(spark, sf_dir, mode):
    docs = S.chunks(spark, sf_dir)
    terms = keyword.question_terms(S.term_questions(spark, sf_dir))
    found = keyword.bm25_top_k(terms, stored(keyword.postings(docs, only=terms)), keyword.corpus_stats(docs), 20, mode=mode)
    return found.select("qid", "chunk_id", "rank", F.round("bm25", 6).alias("bm25"))


@query(_BM25.format("m = nt") + " SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank, round(bm25, 6) AS bm25 FROM kw WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 of the chunks that hold all terms."""
    return _bm25(spark, sf_dir, "and")


@query(_BM25.format("true") + " SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank, round(bm25, 6) AS bm25 FROM kw WHERE rank <= 20")
def bm25_topk_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 of the chunks that hold any term."""
    return _bm25(spark, sf_dir, "or")


_COVERS = f"""po AS (SELECT chunk_id, unnest(t) AS term, generate_subscripts(t, 1) AS place FROM (SELECT chunk_id, {_TOKENS} AS t FROM c)),
ho AS (SELECT qid, nt, chunk_id, term, place, row_number() OVER w AS n FROM qt JOIN po USING (term) WINDOW w AS (PARTITION BY qid, chunk_id ORDER BY place)),
al AS (SELECT * FROM ho SEMI JOIN (SELECT qid, chunk_id FROM ho GROUP BY qid, chunk_id, nt HAVING count(DISTINCT term) = nt) g USING (qid, chunk_id)),
la AS (SELECT a.qid, a.chunk_id, a.n, a.place, max(CASE WHEN a.term = q.term THEN a.place END) OVER w AS lp, max(CASE WHEN a.term = q.term THEN a.n END) OVER w AS ln
       FROM al a JOIN qt q USING (qid) WINDOW w AS (PARTITION BY a.qid, a.chunk_id, q.term ORDER BY a.n)),
fi AS (SELECT qid, chunk_id, n, place, CASE WHEN count(lp) = count(*) THEN min(lp) END AS p, min(ln) AS b FROM la GROUP BY ALL),
co AS (SELECT *, p IS DISTINCT FROM lag(p) OVER (PARTITION BY qid, chunk_id ORDER BY n) AS new FROM fi),
de AS (SELECT qid, chunk_id, sum(CAST(0.1 AS DOUBLE) / (1 + (place - p) - (n - b))) AS density FROM co WHERE new AND p IS NOT NULL GROUP BY qid, chunk_id),
cr AS (SELECT qid, chunk_id, density, row_number() OVER (PARTITION BY qid ORDER BY round(density, 9) DESC, chunk_id) AS rank FROM de)"""


@query(f"WITH {S.FILES_SQL}, {S.TERMS_SQL}, {_ASKED}, {_COVERS} SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank, round(density, 6) AS density FROM cr WHERE rank <= 50")
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 chunks of a question in which its words stand closest."""
    terms = keyword.question_terms(S.term_questions(spark, sf_dir))
    found = keyword.coarse_top_k(terms, keyword.positional_postings(S.chunks(spark, sf_dir), only=terms), 50)
    return found.select("qid", "chunk_id", "rank", F.round("density", 6).alias("density"))


@query(
    _BM25.format("m = nt")
    + f""", {_COVERS} SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(kw.bm25, 9) DESC, chunk_id) AS INTEGER) AS rank, round(kw.bm25, 6) AS bm25
FROM kw JOIN (SELECT qid, chunk_id FROM cr WHERE rank <= 50) USING (qid, chunk_id)"""
)
def bm25_of_densest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortlist by density, ranked by BM25."""
    docs = S.chunks(spark, sf_dir)
    terms = keyword.question_terms(S.term_questions(spark, sf_dir))
    found = keyword.bm25_of_pool(terms, stored(keyword.positional_postings(docs, only=terms)), keyword.corpus_stats(docs), 50)
    return found.select("qid", "chunk_id", "rank", F.round("bm25", 6).alias("bm25"))


@query(
    _BM25.format("m = nt")
    + """, v AS (SELECT c.chunk_id, CAST(e.embedding AS DOUBLE[]) AS e FROM c JOIN embeddings e ON e.vec_id = c.chunk_id),
ve AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, (1 + list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), e)) / 2 AS s FROM t, v) WHERE s >= 0.5),
fu AS (SELECT qid, chunk_id, a.rank AS vr, b.rank AS kr FROM (SELECT * FROM ve WHERE rank <= 20) a FULL JOIN (SELECT * FROM kw WHERE rank <= 20) b USING (qid, chunk_id)),
sc AS (SELECT *, coalesce(CAST(1 AS DOUBLE) / (60 + vr), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + kr), 0) AS s, CASE WHEN vr IS NULL THEN 'KEYWORD' WHEN kr IS NULL THEN 'VECTOR' ELSE 'HYBRID' END AS match_type FROM fu)
SELECT qid, chunk_id, match_type, CAST(rank AS INTEGER) AS rank, round(s, 9) AS combined_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vr ASC NULLS LAST, kr ASC NULLS LAST, chunk_id) AS rank FROM sc) WHERE rank <= 5"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs, fused by reciprocal ranks."""
    q = S.term_questions(spark, sf_dir)
    docs = S.chunks(spark, sf_dir)
    found = fusion.hybrid_search(q, S.vectors(spark, sf_dir), 5, stored(keyword.postings(docs, only=keyword.question_terms(q))), keyword.corpus_stats(docs), Hybrid(min_vector_score=0.5))
    return found.select("qid", "chunk_id", "match_type", "rank", F.round("combined_score", 9).alias("combined_score"))


@query(
    f"""WITH q AS (SELECT conv_id, turn, regexp_replace({S.ASKED}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(q), '{classify.INTENT_LOOKUP.replace("'", "''")}') THEN 'LOOKUP' WHEN regexp_matches(lower(q), '{classify.INTENT_EXPLAIN.replace("'", "''")}') THEN 'EXPLANATION'
WHEN regexp_matches(lower(q), '{classify.INTENT_ID}') OR regexp_matches(lower(q), '{classify.INTENT_CODE}') THEN 'LOOKUP' ELSE 'EXPLANATION' END AS intent FROM q"""
)
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load(spark, sf_dir, "conversations").select("conv_id", "turn", classify.intent(F.expr(S.ASKED)).alias("intent"))


def _has(words):
    return "(" + " OR ".join(f"contains(q, '{w.lower()}')" for w in words) + ")"


@query(f"WITH q AS (SELECT conv_id, turn, lower({S.ASKED}) AS q FROM conversations) SELECT conv_id, turn, CASE WHEN {_has(classify.EXCEL_KEYWORDS)} THEN 'EXCEL' WHEN {_has(classify.DOCX_KEYWORDS)} THEN 'DOCX' END AS query_type FROM q")
def query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load(spark, sf_dir, "conversations").select("conv_id", "turn", classify.query_type(F.expr(S.ASKED)).alias("query_type"))


@query(f"WITH {S.FILES_SQL} SELECT chunk_id, name, type, category FROM c")
def doc_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(spark, sf_dir).select("chunk_id", "name", "type", "category")


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'PDF' WHEN regexp_matches(lower(url), '\\.docx?$') THEN 'DOCX' WHEN regexp_matches(lower(url), '\\.xlsx?$') THEN 'EXCEL' WHEN regexp_matches(lower(url), '^https?://') THEN 'URL' ELSE 'TXT' END AS type, regexp_matches(lower(url), '\\.(pdf|docx|doc|xlsx|xls|txt|md)$') AS supported FROM pages")
def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load(spark, sf_dir, "pages").select("page_id", classify.file_type(F.col("url")).alias("type"), classify.is_supported_file(F.col("url")).alias("supported"))


@query(f"WITH {S.COUNTS_SQL} SELECT source, net, round(boost, 6) AS boost FROM bo")
def source_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.boosts(feedback.source_votes(S.votes(spark, sf_dir))).withColumn("boost", F.round("boost", 6))


@query(f"WITH {S.COUNTS_SQL} SELECT rating AS what, count(*) AS up, CAST(0 AS BIGINT) AS down FROM vo GROUP BY rating UNION ALL SELECT source, up, down FROM co")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by rating, then votes by source."""
    v = S.votes(spark, sf_dir)
    return feedback.totals(v).select(F.col("rating").alias("what"), F.col("n").alias("up"), F.lit(0).cast("bigint").alias("down")).unionByName(feedback.source_votes(v).withColumnRenamed("source", "what"))


@query("WITH v AS (SELECT user_id, event_type, ts, event_id, value FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM v) SELECT user_id, event_type, event_id FROM l WHERE n = 1")
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert view: the last event per user and type."""
    e = S.load(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type")).withColumn("at", F.struct("ts", "event_id"))
    return feedback.latest(e, "key", "at").select("user_id", "event_type", "event_id")


@query(
    """WITH v AS (SELECT user_id * 10 + event_id % 7 AS interaction_id, CASE WHEN value > 5 THEN 'UP' ELSE 'DOWN' END AS rating, event_type AS source, ts, event_id FROM events),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT source, count(*) FILTER (rating = 'UP') AS up, count(*) FILTER (rating = 'DOWN') AS down FROM l GROUP BY source"""
)
def vote_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes given again and again: what each changes, added up per source."""
    votes = S.load(spark, sf_dir, "events").select(
        (F.col("user_id") * 10 + F.col("event_id") % 7).alias("interaction_id"), F.when(F.col("value") > 5, "UP").otherwise("DOWN").alias("rating"), F.array("event_type").alias("sources"), F.struct("ts", "event_id").alias("created_at")
    )
    return feedback.added(feedback.vote_deltas(votes))


_TOP10 = f"top AS (SELECT *, {_RANK} AS rank FROM s QUALIFY rank <= 10)"


@query(
    f"""WITH {_PAIRS}, {_TOP10}, {S.COUNTS_SQL},
ad AS (SELECT qid, chunk_id, rank, 1.0::DOUBLE - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY qid) + coalesce(boost, 0) AS adjusted FROM top LEFT JOIN bo USING (source))
SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(final_rank AS INTEGER) AS final_rank, round(adjusted, 6) AS adjusted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(adjusted, 12) DESC, rank) AS final_rank FROM ad) WHERE final_rank <= 5"""
)
def feedback_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool of 10, nudged by votes, cut to 5."""
    pool = vector.top_k(S.questions(spark, sf_dir).select("qid", "embedding"), S.vectors(spark, sf_dir).select("chunk_id", "source", "embedding"), 10)
    out = rerank.feedback_order(pool, feedback.boosts(feedback.source_votes(S.votes(spark, sf_dir))), k=5)
    return out.select("qid", "chunk_id", "rank", "final_rank", F.round("adjusted", 6).alias("adjusted"))


@query(
    f"""WITH {_PAIRS}, {_TOP10}, rr AS (SELECT qid, chunk_id, chunk_id % 7 AS sc FROM top WHERE chunk_id % 3 <> 0)
SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY sc DESC NULLS LAST, rank) AS INTEGER) AS new_rank FROM top LEFT JOIN rr USING (qid, chunk_id)"""
)
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's partial answer merged back; the rest follows in order."""
    pool = vector.top_k(S.questions(spark, sf_dir).select("qid", "embedding"), S.vectors(spark, sf_dir).select("chunk_id", "embedding"), 10)
    said = pool.filter("chunk_id % 3 <> 0").select("qid", "chunk_id", (F.col("chunk_id") % 7).cast("double").alias("rerank_score"))
    return rerank.merge(pool, said).select("qid", "chunk_id", "rank", "new_rank")


@query(
    f"""WITH {S.MESSAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS n FROM m),
h AS (SELECT session_id, regexp_replace(string_agg(CASE WHEN role = 'USER' THEN 'User' ELSE 'Assistant' END || ': ' || content, chr(10) ORDER BY created_at), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS t FROM r WHERE n <= 10 GROUP BY session_id)
SELECT session_id, CASE WHEN length(t) > 4000 THEN '...' || chr(10) || right(t, 4000) ELSE t END AS history FROM h"""
)
def history_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.history_block(S.messages(spark, sf_dir))


@query(f"WITH {S.MESSAGES_SQL} SELECT session_id, created_at, last_value(CASE WHEN role = 'USER' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question, role FROM m QUALIFY role = 'ASSISTANT'")
def preceding_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the last question at or before each answer."""
    return conversation.preceding_question(S.messages(spark, sf_dir)).select("session_id", "created_at", "question", "role")


@query(f"WITH {S.MESSAGES_SQL} SELECT session_id, created_at, interaction_id FROM m WHERE role = 'ASSISTANT' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) = 1")
def latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.latest_answer(S.messages(spark, sf_dir)).select("session_id", "created_at", "interaction_id")


@query(f"WITH {S.MESSAGES_SQL} SELECT session_id, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at) > 1 AS is_follow_up FROM m")
def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.follow_up(S.messages(spark, sf_dir)).select("session_id", "created_at", "is_follow_up")


@query(f"WITH {S.MESSAGES_SQL} SELECT session_id, count(*) AS n_messages FROM m GROUP BY session_id")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.message_counts(S.messages(spark, sf_dir))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge with a cutoff leaves."""
    return conversation.purge(S.load(spark, sf_dir, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "ts").select("event_id")


@query(
    f"""WITH {_PAIRS}, top AS (SELECT *, {_RANK} AS rank FROM s WHERE score >= 0.5 QUALIFY rank <= 5),
cx AS (SELECT qid, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(DISTINCT source) AS n_sources FROM top GROUP BY qid)
SELECT q.qid, n_sources, '{conversation._TASK.replace("'", "''")}' || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' || chr(10) AS prompt FROM q LEFT JOIN cx USING (qid)"""
)
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and prompt of every question."""
    q = S.questions(spark, sf_dir)
    found = vector.top_k(q.select("qid", "embedding"), S.vectors(spark, sf_dir).select("chunk_id", "text", "source", "embedding"), 5, 0.5)
    return answers.prompts(q.select("qid", "question"), found).select("qid", F.size("sources").cast("bigint").alias("n_sources"), "prompt")


@query(f"WITH {_PAIRS}, top AS (SELECT *, {_RANK} AS rank FROM s WHERE score >= 0.5 QUALIFY rank <= 5) SELECT qid, string_agg(source || ' ' || type || ' ' || substr(text, 1, 200) || '...', '|' ORDER BY rank) AS refs FROM top GROUP BY qid")
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source references of each answer, in rank order."""
    found = vector.top_k(S.questions(spark, sf_dir).select("qid", "embedding"), S.vectors(spark, sf_dir).select("chunk_id", "text", "source", "type", "embedding"), 5, 0.5)
    refs = answers.source_list(found)
    return refs.select("qid", F.array_join(F.transform("references", lambda r: F.concat_ws(" ", r["source"], r["type"], r["excerpt"])), "|").alias("refs"))


@query(f"WITH {S.MESSAGES_SQL} SELECT interaction_id, lower(trim(regexp_replace(content, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS key FROM m WHERE role = 'USER'")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.messages(spark, sf_dir).filter("role = 'USER'").select("interaction_id", cache.cache_key(F.col("content")).alias("key"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id || ':' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, n, event_id, ts, ts AS written, false AS hit FROM e WHERE n = 1
      UNION ALL SELECT e.key, e.n, e.event_id, e.ts, CASE WHEN e.ts - r.written < INTERVAL 60 MINUTE THEN r.written ELSE e.ts END, e.ts - r.written < INTERVAL 60 MINUTE FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT event_id AS request_id, key, hit FROM r"""
)
def cache_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache whose entries live an hour from their writing."""
    log = S.load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.lit("get").alias("kind"))
    return cache.simulate(log).select("request_id", "key", "hit")


#: A cache of 50 entries that live half a day, asked by users; every 41st request
#: drops an entry, every 997th all.
_BOUND = Cache(ttl_minutes=720, max_size=50)
_LRU = """WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS n, event_id AS request_id, user_id AS key, ts, CASE WHEN event_id % 997 = 0 THEN 'clear' WHEN event_id % 41 = 0 THEN 'evict' ELSE 'get' END AS kind FROM events),
log AS MATERIALIZED (SELECT list({'key': key, 'ts': ts, 'kind': CASE kind WHEN 'clear' THEN 0 WHEN 'evict' THEN 1 ELSE 2 END} ORDER BY n) AS l FROM e),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(key BIGINT, since TIMESTAMP)[]) AS held, CAST(NULL AS BOOLEAN) AS hit, CAST(0 AS BIGINT) AS size, CAST(0 AS INTEGER) AS evicted
      UNION ALL SELECT n, [held[i] FOR i IN generate_series(greatest(len(held) - 49, 1), len(held))], hit, least(len(held), 50), CASE WHEN len(held) > 50 THEN 1 ELSE 0 END
      FROM (SELECT n, x.kind, CASE WHEN x.kind = 2 THEN len(own) > 0 END AS hit,
                   CASE x.kind WHEN 0 THEN [] WHEN 1 THEN rest ELSE list_append(rest, {'key': x.key, 'since': coalesce(own[1].since, x.ts)}) END AS held
            FROM (SELECT n, x, list_filter(live, lambda h: h.key = x.key) AS own, list_filter(live, lambda h: h.key <> x.key) AS rest
                  FROM (SELECT r.n + 1 AS n, log.l[r.n + 1] AS x, list_filter(r.held, lambda h: log.l[r.n + 1].ts - h.since < INTERVAL 720 MINUTE) AS live FROM r, log WHERE r.n < len(log.l)))))"""


@query(_LRU + " SELECT request_id, kind, hit, evicted, CAST(size AS INTEGER) AS size FROM r JOIN e USING (n)")
def cache_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, entries pushed out and size of a cache of few entries."""
    return cache.bounded(_control_log(spark, sf_dir), _BOUND).select("request_id", "kind", "hit", "evicted", "size")


@query(
    _LRU
    + """ SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT CASE WHEN NOT hit THEN key END) AS keys, CAST(sum(evicted) AS BIGINT) AS evictions,
CAST(arg_max(size, n) AS INTEGER) AS size, round(count(*) FILTER (hit) / (count(*) FILTER (hit IS NOT NULL)), 6) AS hit_rate FROM r JOIN e USING (n)"""
)
def cache_bounded_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(cache.bounded(_control_log(spark, sf_dir), _BOUND)).select("hits", "misses", "keys", "evictions", "size", "hit_rate")


def _control_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 997 == 0, "clear").when(F.col("event_id") % 41 == 0, "evict").otherwise("get")
    return S.load(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("key"), "ts", kind.alias("kind"))


@query()
def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed retrieval, reranking, prompt and a deterministic generator."""
    q = S.questions(spark, sf_dir)
    docs = S.chunks(spark, sf_dir).select("chunk_id", "text", "source", "category")
    found = vector.routed(q, S.vectors(spark, sf_dir, vector.without(docs, "text", "source")), 10)
    found = vector.with_columns(found, docs, "text", "source")
    ranked = rerank.rerank(found, Rerank()).filter("new_rank <= 5").drop("rank").withColumnRenamed("new_rank", "rank")
    return answers.answer(answers.prompts(q.select("qid", "question"), ranked)).select("qid", "question", "answer", "sources", "cacheable")


@query()
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-hashed vectors of whole documents."""
    return S.load(spark, sf_dir, "documents").select("doc_id", embed_udf()("text").alias("embedding"))


def _recursive_sql(t: str, size: int, overlap: int, separators: tuple[str, ...], n: int = 0) -> str:
    """The nested fold of text.recursive_pieces() over an SQL expression."""
    whole = f"CASE WHEN length({t}) <= {size} THEN [{t}] ELSE "
    if not separators:
        step = size - overlap
        return f"{whole} [substr({t}, CAST(i AS BIGINT) * {step} + 1, {size}) FOR i IN range(0, CAST(ceil(greatest(length({t}) - {overlap}, 1) / {step}.0) AS BIGINT))] END"
    s, p, r = f"s{n}", f"p{n}", f"r{n}"
    full = f"({s}.held <> '' AND length({s}.held) + length({p}) > {size})"
    out = f"CASE WHEN {full} THEN list_append({s}.out, {s}.held) ELSE {s}.out END"
    held = f"CASE WHEN {full} THEN CASE WHEN length({p}) + {overlap} <= {size} THEN right({s}.held, {overlap}) ELSE '' END ELSE {s}.held END"
    long = f"length({p}) > {size}"
    inner = _recursive_sql(p, size, overlap, separators[1:], n + 1)
    sep = separators[0].replace("\n", "\\n").replace(".", "\\.")
    fold = f"""list_reduce(regexp_extract_all({t}, '(?s).*?{sep}|.+'), lambda {s}, {p}: {{'out': CASE WHEN {long} THEN list_concat({out}, {inner}) ELSE {out} END, 'held': CASE WHEN {long} THEN {held} ELSE ({held}) || {p} END}}, {{'out': CAST([] AS VARCHAR[]), 'held': ''}})"""
    return f"{whole} list_transform([{fold}], lambda {r}: CASE WHEN {r}.held <> '' THEN list_append({r}.out, {r}.held) ELSE {r}.out END)[1] END"


@query(f"SELECT doc_id, CAST(unnest(range(0, len(c))) AS INTEGER) AS n, unnest(c) AS chunk FROM (SELECT doc_id, {_recursive_sql('text', 500, 10, text.SEPARATORS)} AS c FROM documents WHERE length(text) > 0)")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive splitting of whole documents."""
    docs = spread(S.load(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(text.recursive_pieces(F.col("text"), 500, 10)).alias("n", "chunk"))
