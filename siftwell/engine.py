"""The engine's API over tables below one root folder.

Writes append to a table's newest version, or write the next one; reads are lazy
DataFrames. Model calls (embedder, reranker, generator) are plug-ins.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import Config
from .functions.embed import Embedder, embed_udf, hashed
from .operators import answers, bot, cache, conversation, diffs, feedback, fusion, history, ingest, rerank, sheets, vector
from .operators.index import KeywordIndex
from .sources import files, pages

TABLES = {
    "chunks": schema.CHUNKS, "documents": schema.DOCUMENTS, "messages": schema.MESSAGES, "feedback": schema.FEEDBACK, "batches": schema.BATCHES, "success": schema.SUCCESSES,
    "failure": schema.FAILURES, "repositories": schema.REPOSITORIES, "commits": schema.COMMITS, "sprints": schema.SPRINTS, "vote_counts": schema.VOTE_COUNTS,
}


#: Tables that are laid out by columns which queries filter on.
PARTITIONS = {"chunks": ("category",), "commits": ("repository_id",)}


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder: Embedder = hashed, generator: answers.Generator = answers.extractive):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.embedder, self.generator = embedder, generator

    # tables

    def _path(self, name: str) -> str:
        return f"{self.root}/{schema.safe_name(name)}"

    def table(self, name: str) -> DataFrame:
        """A stored table; empty if nothing was written yet."""
        return self._read(name, ingest.folders(self.spark, self._path(name)))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        read = self.spark.read.schema(TABLES[name]).parquet
        # folders that are laid out by columns are roots of their own
        return reduce(DataFrame.unionByName, map(read, folders)) if name in PARTITIONS else read(*folders)

    def tables(self) -> DataFrame:
        """What the engine stores: table, column, type, whether it is there,
        and whether the column lays it out."""
        rows = []
        for name, ddl in TABLES.items():
            there = bool(ingest.folders(self.spark, self._path(name)))
            rows += [(name, f.name, f.dataType.simpleString(), there, f.name in PARTITIONS.get(name, ())) for f in self.spark.createDataFrame([], ddl).schema]
        return self.spark.createDataFrame(rows, "table string, column string, type string, stored boolean, partition boolean")

    def _append(self, name: str, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add rows; those of a stream's ``batch`` (name, epoch) once."""
        want = self.spark.createDataFrame([], TABLES[name]).schema
        have, laid = set(df.columns), PARTITIONS.get(name, ())
        df = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
        if batch is not None:
            ingest.put_batch(self.spark, df, self._path(name), *batch, laid)
            return
        at = ingest.current_snapshot(self.spark, self._path(name)) or f"{self._path(name)}/v00000000"
        df.write.mode("append").partitionBy(*laid).parquet(at)

    def _replace(self, name: str, change: Callable[[DataFrame], DataFrame] | DataFrame) -> None:
        """Write the next version: a table, or what ``change`` makes of this one."""
        read = ingest.folders(self.spark, self._path(name))
        df = change(self._read(name, read)) if callable(change) else change
        ingest.swap_snapshot(self.spark, df, self._path(name), PARTITIONS.get(name, ()), read)

    def compact(self, name: str) -> None:
        """Take the batches that streams wrote into one new version."""
        self._replace(name, lambda t: t)

    # keyword index

    @property
    def index(self) -> KeywordIndex:
        """The keyword index, which ingestion and deletion keep up with."""
        return KeywordIndex(self.spark, self._path("index"), self.config.hybrid.analyzer)

    def build_index(self) -> None:
        """Merge the index into one segment, or make it anew if there is none."""
        if self.index.available():
            self.index.merge(all_of_them=True)
        else:
            self.index.add(self.table("chunks").select("chunk_id", "text"))

    # ingestion

    def ingest_documents(self, docs: DataFrame, splitter: str = "recursive") -> None:
        """``docs``: source, name, type, text. Known sources are left out."""
        docs = docs.join(self.table("documents").select("source"), "source", "left_anti")
        self.ingest_chunks(ingest.chunk_documents(docs, self.config.retrieval, splitter))

    def ingest_chunks(self, chunks: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Chunks without vectors; nothing happens for none."""
        done = ingest.with_embeddings(chunks, self.embedder).persist()
        try:
            self._append("chunks", done, batch)
            if self.config.hybrid.enabled:
                self.index.add(done.select("chunk_id", "text"), batch)
            # last: what is new depends on this table, and is read anew once it changed
            self._append("documents", ingest.registry(done), batch)
        finally:
            done.unpersist()

    def ingest_pages(self, fetched: DataFrame) -> None:
        p = pages.page_documents(fetched, self.table("documents"))
        self.ingest_documents(p.select("source", F.col("title").alias("name"), F.lit("URL").alias("type"), "text"))

    def ingest_folder(self, folder: str, batch_id: str) -> DataFrame:
        """Every supported file below a folder; outcomes go to their queues.
        Returns the report of the batch."""
        self._ingest(files.scan(self.spark, folder), batch_id, folder)
        return self.batch_report(batch_id)

    def ingest_batch(self, found: DataFrame, stream: str, epoch: int) -> None:
        """The files of a stream's micro-batch, once however often it is tried."""
        self._ingest(found, f"{stream}-{epoch}", stream, (stream, epoch))

    def _ingest(self, found: DataFrame, batch_id: str, label: str, batch: tuple[str, int] | None = None) -> None:
        """Files (path, name, type, length, content): texts in pieces, workbooks
        by their rows, and the outcome of each."""
        book = F.lower("name").endswith(".xlsx")
        parsed, cells = files.parse(found.filter(~book)).persist(), files.cells(found).persist()
        try:
            ok = parsed.filter("status = 'OK'").select(F.col("path").alias("source"), "name", "type", "text")
            chunks = ingest.chunk_documents(ok, self.config.retrieval, "recursive")
            rows = sheets.chunk_rows(cells.filter("error is null").drop("error"), self.config.sheets)
            rows = rows.withColumn("chunk_id", F.sha2(F.concat_ws("\n", "source", "sheet", F.col("row_start").cast("string")), 256))
            chunks = chunks.unionByName(rows.select(*chunks.columns))
            # a workbook that cannot be read fails alone
            errors = cells.filter("error is not null").select(F.col("workbook").alias("path"), "error")
            books = found.filter(book).select("path", "name", "type").join(errors, "path", "left")
            outcomes = parsed.unionByName(books.select("path", "name", "type", F.when(F.col("error").isNull(), "OK").otherwise("FAILED").alias("status"), F.lit(None).cast("string").alias("text"), "error"))
            self.ingest_chunks(chunks, batch)
            good, bad = ingest.outcomes(outcomes, self.table("documents").select("source", "chunk_count"), batch_id)
            self._append("success", good.withColumn("completed_at", F.current_timestamp()), batch)
            self._append("failure", bad.withColumn("failed_at", F.current_timestamp()), batch)
            self._append("batches", found.agg(F.count("*").alias("total_files")).withColumns({"id": F.lit(batch_id), "folder_path": F.lit(label), "started_at": F.current_timestamp()}), batch)
        finally:
            parsed.unpersist()
            cells.unpersist()

    def batch_report(self, batch_id: str) -> DataFrame:
        b = self.table("batches").filter(F.col("id") == batch_id).select(F.col("id").alias("batch_id"), "folder_path", "total_files", "started_at")
        return ingest.batch_report(b, self.table("success"), self.table("failure"))

    def delete_document(self, document_id: str) -> None:
        """Forget a registry row; its chunks stay, as the registry is all that
        this removes. ``delete_chunks`` removes the rest."""
        self._replace("documents", lambda t: t.filter(F.col("id") != document_id))

    def delete_chunks(self, source: str) -> None:
        """Remove a source's chunks, from the keyword index too."""
        self.index.remove(self.table("chunks").filter(F.col("source") == source).select("chunk_id", "text"))
        self._replace("chunks", lambda t: t.filter(F.col("source") != source))

    # questions

    def _asked(self, questions: DataFrame) -> DataFrame:
        return questions if "embedding" in questions.columns else questions.withColumn("embedding", embed_udf(self.embedder)("question"))

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """``questions`` (qid, question) -> ranked matches with all steps of
        the live path: routing, fallback, reranking, votes, cut."""
        c = self.config
        q = self._asked(questions.select("qid", "question", *[x for x in questions.columns if x == "embedding"]))
        pool = max(c.rerank.pool_size, c.retrieval.max_results) if c.rerank.enabled else c.retrieval.max_results
        found = vector.routed(q, self.table("chunks"), pool, c.retrieval)
        found = rerank.rerank(found, c.rerank).drop("rank").withColumnRenamed("new_rank", "rank")
        boosts = feedback.boosts(feedback.source_votes(feedback.latest(self.table("feedback"))), c.feedback)
        return rerank.feedback_order(found, boosts, k=c.retrieval.max_results).drop("rank").withColumnRenamed("final_rank", "rank")

    def answer(self, questions: DataFrame) -> DataFrame:
        """``questions`` (qid, question, session_id) -> answers with sources."""
        matches = self.retrieve(questions)
        h = conversation.history_block(self.table("messages"), config=self.config.memory)
        prompted = answers.prompts(questions.select("qid", "question", "session_id"), matches, h)
        out = answers.answer(prompted, self.generator).join(answers.source_list(matches), "qid", "left")
        return out.withColumn("interaction_id", F.sha2(F.concat_ws(":", "session_id", F.col("qid").cast("string")), 256))

    def hybrid_search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """Both legs over the stored index; without one, the vector leg alone."""
        index = self.index
        there = index.available()
        h = self.config.hybrid
        return fusion.hybrid_search(self._asked(questions), self.table("chunks"), k or self.config.retrieval.max_results, index.postings() if there else None, index.stats() if there else None, h, h.analyzer)

    def save_messages(self, messages: DataFrame) -> None:
        self._append("messages", messages)

    def history(self, session_id: str) -> DataFrame:
        return self.table("messages").filter(F.col("session_id") == session_id).orderBy("created_at")

    def clear_session(self, session_id: str) -> None:
        self._replace("messages", lambda t: conversation.delete_session(t, session_id))

    def purge_messages(self, cutoff: datetime) -> None:
        self._replace("messages", lambda t: conversation.purge(t, cutoff))

    # votes

    def submit_feedback(self, votes: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """``votes`` (interaction_id, rating, comment, created_at); returns
        those whose answer is not known."""
        known = self.table("messages").filter("role = 'ASSISTANT'").select("interaction_id", "session_id", "content", "sources")
        ok, lost = feedback.submit(known, votes.filter(F.col("rating").isin("UP", "DOWN")))
        self._append("feedback", ok, batch)
        return lost

    def count_votes(self, deltas: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add signed votes (source, up, down), as streams.vote_deltas() makes
        them, to the running counts."""
        self._append("vote_counts", deltas.groupBy("source").agg(F.sum("up").alias("up"), F.sum("down").alias("down")), batch)

    def rebuild_vote_counts(self) -> None:
        """The running counts, from the stored votes."""
        self._replace("vote_counts", feedback.source_votes(feedback.latest(self.table("feedback"))))

    def source_counts(self) -> DataFrame:
        """source, up, down from the running counts: no stored vote is read."""
        return feedback.added(self.table("vote_counts"))

    def add_comment(self, comments: DataFrame) -> None:
        self._replace("feedback", lambda t: feedback.add_comments(feedback.latest(t), comments))

    def feedback_stats(self) -> tuple[DataFrame, DataFrame]:
        v = feedback.latest(self.table("feedback"))
        return feedback.totals(v), feedback.boosts(feedback.source_votes(v), self.config.feedback)

    def cache_stats(self, requests: DataFrame) -> DataFrame:
        return cache.stats(cache.bounded(requests, self.config.cache))

    def reranker_status(self) -> dict:
        r = self.config.rerank
        return {"enabled": r.enabled, "provider": r.provider, "available": rerank.provider_names(), "pool_size": r.pool_size, "fail_open": r.fail_open}

    # sheets

    def backfill_metadata(self) -> DataFrame:
        chunks = self.table("chunks").persist()
        try:
            new, counts = sheets.backfill(chunks)
            report = self.spark.createDataFrame(counts.collect(), counts.schema)
            self._replace("chunks", new.select(*chunks.columns).unionByName(chunks.filter("type <> 'EXCEL' or type is null")))
        finally:
            chunks.unpersist()
        return report

    def unclassified_sheets(self) -> DataFrame:
        return sheets.unclassified(self.table("chunks"))

    def range_warnings(self, limit: int = 200) -> DataFrame:
        return sheets.range_warnings(self.table("chunks"), limit)

    # commits

    def sync_commits(self, walked: DataFrame, position: str = "position") -> DataFrame:
        """Store the commits before the first known one; returns them, as
        written: they are kept as the table ``last_sync`` until the next sync."""
        at = self._path("last_sync")
        ingest.swap_snapshot(self.spark, history.new_commits(walked, self.table("commits"), self.config.commits.max_per_sync, position), at)
        new = self.spark.read.parquet(ingest.current_snapshot(self.spark, at))
        self._append("commits", new)
        return new

    def repositories(self) -> DataFrame:
        """The repositories, without what gives access to them."""
        return schema.shown(self.table("repositories"))

    def commit_stats(self, versions: DataFrame, commits: DataFrame) -> DataFrame:
        """files_changed, insertions and deletions from the trees' contents."""
        return diffs.stats(versions, commits)

    def date_report(self, first: date, last: date | None = None, repository_id: str | None = None) -> DataFrame:
        return history.date_report(self.table("commits"), first, last, repository_id)

    def create_sprint(self, name: str, start: date, end: date, repository_id: str | None = None) -> None:
        history.check_sprint(name, start, end)
        self._append("sprints", self.spark.createDataFrame([(name, name, start, end, repository_id)], "id string, name string, start_date date, end_date date, repository_id string"))

    def generate_sprints(self, start: date, count: int, length_days: int | None = None, prefix: str = "Sprint", repository_id: str | None = None) -> None:
        self._append("sprints", history.generate_sprints(self.spark, start, count, length_days or self.config.commits.sprint_length_days, prefix, repository_id))

    def delete_sprint(self, sprint_id: str) -> None:
        self._replace("sprints", lambda t: t.filter(F.col("id") != sprint_id))

    def sprint_report(self, sprint_id: str, repository_id: str | None = None) -> DataFrame:
        return history.sprint_report(self.table("sprints").filter(F.col("id") == sprint_id), self.table("commits"), repository_id)

    def all_sprint_reports(self, repository_id: str | None = None) -> DataFrame:
        return history.sprint_report(self.table("sprints"), self.table("commits"), repository_id).orderBy(F.desc("start_date"))

    # chat

    def route_events(self, events: DataFrame, own_id: str) -> DataFrame:
        return bot.route_events(bot.relevant(events, own_id), self.config.feedback)

    plan_broadcast = staticmethod(bot.plan_broadcast)
    plan_webhook_sync = staticmethod(bot.plan_webhooks)
