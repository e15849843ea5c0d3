"""How the test tables stand in for the engine's own.

The tables hold no spreadsheets, commits, questions or votes. Each stand-in is
a fixed rule over whole tables, once as a DataFrame and once as SQL; none of
them is real data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import doc_category, file_type


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILE_NAME = "CASE lang WHEN 'de' THEN source || '_catalog.xlsx' WHEN 'fr' THEN source || '_FDS_v2.docx' WHEN 'es' THEN source || ' pricing rules.pdf' ELSE source || '.txt' END"
FILES_SQL = f"""f AS (SELECT doc_id AS chunk_id, text, source, {FILE_NAME} AS name FROM documents),
c AS (SELECT *, CASE WHEN name LIKE '%.xlsx' THEN 'EXCEL' WHEN name LIKE '%.docx' THEN 'DOCX' WHEN name LIKE '%.pdf' THEN 'PDF' ELSE 'TXT' END AS type,
      CASE WHEN name LIKE '%.xlsx' THEN 'catalog' WHEN name LIKE '%FDS%' THEN 'fds' WHEN name LIKE '%rule%' THEN 'rules' ELSE 'general' END AS category FROM f)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, text, source, name, type, category."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", F.expr(FILE_NAME).alias("name"))
    d = d.withColumn("type", file_type(F.col("name")))
    return d.withColumn("category", doc_category(F.col("name"), F.col("type")))


def vectors(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """embeddings paired with documents by id, an arbitrary pairing; ``docs`` are chunks() with other columns."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return (chunks(spark, sf_dir) if docs is None else docs).join(e, "chunk_id")


VECTORS_SQL = FILES_SQL + ", v AS (SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS e FROM c JOIN embeddings e ON e.vec_id = c.chunk_id)"

#: Every hundredth vector asks, so the questions grow with the table.
ASKS = "vec_id % 100 = 0"
QUESTION = "CASE CAST(floor(vec_id / 100) AS BIGINT) % 4 WHEN 0 THEN 'What is the Offering Id for CR-1029?' WHEN 1 THEN 'explain refunds' WHEN 2 THEN 'show SVC_007' ELSE 'refund policy' END"
QUESTIONS_SQL = f"q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qe, {QUESTION} AS question, CASE WHEN CAST(floor(vec_id / 100) AS BIGINT) % 2 = 0 THEN 'LOOKUP' ELSE 'EXPLANATION' END AS intent FROM embeddings WHERE {ASKS})"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with ids divisible by 100 ask questions: a stated query set."""
    return load(spark, sf_dir, "embeddings").filter(ASKS).select(F.col("vec_id").alias("qid"), "embedding", F.expr(QUESTION).alias("question"))


TERMS = ("the of and", "que de la", "der die und", "les du est", "trash idiot", "the the", "nosuchterm the", "?!")
TERM_QUESTION = f"CASE CAST(floor(vec_id / 100) AS BIGINT) % {len(TERMS)} " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(TERMS)) + " END"
TERMS_SQL = f"t AS (SELECT vec_id AS qid, embedding, {TERM_QUESTION} AS question FROM embeddings WHERE {ASKS})"


def term_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same query set asks for words."""
    return load(spark, sf_dir, "embeddings").filter(ASKS).select(F.col("vec_id").alias("qid"), "embedding", F.expr(TERM_QUESTION).alias("question"))


ASKED = "concat(CASE WHEN turn % 6 = 0 THEN 'What is Flat Offering? ' WHEN turn % 6 = 1 THEN 'show SVC_007 ' WHEN turn % 6 = 2 THEN 'explain CR-1029 ' WHEN turn % 6 = 3 THEN 'ID for this? ' WHEN turn % 6 = 4 THEN 'How do refunds work? ' ELSE '' END, text)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages; the turn is the order."""
    c = load(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.upper("role").alias("role"), F.col("text").alias("content"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("interaction_id"))


MESSAGES_SQL = "m AS (SELECT conv_id AS session_id, turn AS created_at, upper(role) AS role, text AS content, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS interaction_id FROM conversations)"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as votes on documents: quality 1 is UP, 0 is DOWN."""
    l = load(spark, sf_dir, "labels")  # noqa: E741
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    return l.join(d, "doc_id").select(F.col("doc_id").alias("interaction_id"), F.when(F.col("quality") == 1, "UP").otherwise("DOWN").alias("rating"), F.array("source").alias("sources"))


VOTES_SQL = "vo AS (SELECT doc_id AS interaction_id, CASE WHEN quality = 1 THEN 'UP' ELSE 'DOWN' END AS rating, source FROM labels JOIN documents USING (doc_id))"
COUNTS_SQL = VOTES_SQL + ", co AS (SELECT source, count(*) FILTER (rating = 'UP') AS up, count(*) FILTER (rating = 'DOWN') AS down FROM vo GROUP BY source), bo AS (SELECT source, up - down AS net, CASE WHEN abs(up - down) >= 1 THEN greatest(-0.2, least(0.2, CAST((up - down) * CAST(0.03 AS DOUBLE) AS DOUBLE))) ELSE 0 END AS boost FROM co)"

COMMIT = {
    "repository_id": "event_type",
    "commit_hash": "md5(CAST(event_id AS STRING))",
    "author_name": "concat('user ', CAST(user_id AS STRING))",
    "author_email": "concat('u', CAST(user_id AS STRING), '@example.com')",
    "commit_date": "ts",
    "short_message": "concat('event ', CAST(event_id AS STRING))",
    "insertions": "CAST(floor(value) AS INT)",
}
COMMITS_SQL = "k AS (SELECT " + ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {c}" for c, v in COMMIT.items()) + ", event_id FROM events)"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as commits: type is the repository, user the author."""
    return load(spark, sf_dir, "events").select(*[F.expr(v).alias(c) for c, v in COMMIT.items()], "event_id")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog sheet per brand: a header with a range note, then a
    row per part."""
    p = load(spark, sf_dir, "part")
    heads = ("Rule ID", "Offering Name", "Price Key Id", "Part Code", "Rule ID range: 100 to 900")
    sheet = F.when(F.col("p_brand").endswith("1"), F.concat("p_brand", F.lit(" Complex Flat Rules"))).otherwise(F.col("p_brand"))
    head = p.select(sheet.alias("sheet")).distinct().select("sheet", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, heads))).alias("col", "raw")).withColumn("kind", F.lit("string"))
    values = F.array(
        F.struct(F.lit("number").alias("kind"), F.col("p_partkey").cast("string").alias("raw")),
        F.struct(F.lit("string").alias("kind"), F.col("p_name").alias("raw")),
        F.struct(F.lit("string").alias("kind"), F.when(F.col("p_size") > 10, F.concat(F.lit("K"), "p_size")).otherwise(F.lit(" ")).alias("raw")),
        F.struct(F.lit("string").alias("kind"), F.col("p_type").alias("raw")),
    )
    body = p.select(sheet.alias("sheet"), (F.col("p_partkey") + 1).cast("int").alias("row"), F.posexplode(values).alias("col", "v")).select("sheet", "row", "col", "v.raw", "v.kind")
    return head.select("sheet", "row", "col", "raw", "kind").unionByName(body).withColumn("workbook", F.lit("catalog.xlsx"))


SHEETS_SQL = """p AS (SELECT CASE WHEN p_brand LIKE '%1' THEN p_brand || ' Complex Flat Rules' ELSE p_brand END AS sheet, p_partkey AS n, trim(p_name) AS name, trim(CASE WHEN p_size > 10 THEN 'K' || p_size ELSE ' ' END) AS pk, trim(p_type) AS code FROM part),
s AS (SELECT *, CASE WHEN sheet LIKE '%Complex Flat Rules' THEN 'complexFlatRule' ELSE 'general' END AS sheet_type, n + 2 AS row_start, n < 100 OR n > 900 AS warned FROM p)"""
