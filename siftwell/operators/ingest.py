"""Ingestion: chunks, registry, outcome queues and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions.classify import doc_category
from ..functions.embed import Embedder, embed_udf, hashed
from ..functions.text import recursive_pieces, window_count, windows

EMPTY_FIELDS = "cast(map() as map<string,string>)"


def chunk_documents(docs: DataFrame, config: Retrieval = Retrieval(), splitter: str = "fixed") -> DataFrame:
    """``docs`` (source, name, type, text) -> one row per chunk."""
    if splitter == "fixed":
        pieces = docs.withColumn("_p", F.explode(windows(F.col("text"), config.chunk_size, config.chunk_overlap))).withColumn("n", F.col("_p.n")).withColumn("chunk", F.col("_p.text"))
    else:
        pieces = docs.select("*", F.posexplode(recursive_pieces(F.col("text"), config.chunk_size, config.chunk_overlap)).alias("n", "chunk"))
    ident = F.sha2(F.concat_ws("\n", "source", F.col("n").cast("string")), 256)
    none = lambda kind: F.lit(None).cast(kind)
    return pieces.select(
        ident.alias("chunk_id"), F.col("chunk").alias("text"), "source", "type", doc_category(F.col("name"), F.col("type")).alias("category"), none("string").alias("workbook"), none("string").alias("sheet"),
        none("string").alias("sheet_type"), none("int").alias("row_start"), none("int").alias("row_end"), F.expr(EMPTY_FIELDS).alias("fields"),
    )


def with_embeddings(chunks: DataFrame, embedder: Embedder = hashed) -> DataFrame:
    return chunks.withColumn("embedding", embed_udf(embedder)("text"))


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append to the chunk table, laid out by category so that routed queries
    read their categories alone."""
    chunks.write.mode("append").partitionBy("category").parquet(path)


def registry(chunks: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per source with its number of chunks."""
    return _registered(chunks.groupBy("source", "type").agg(F.count("*").cast("int").alias("chunk_count")), at)


def registry_of_texts(docs: DataFrame, config: Retrieval = Retrieval(), at: Column | None = None) -> DataFrame:
    """registry() of the fixed windows of ``docs`` (source, name, type, text),
    counted from the lengths of the texts: none is cut."""
    n = F.sum(window_count(F.col("text"), config.chunk_size, config.chunk_overlap)).cast("int")
    return _registered(docs.groupBy("source", "type").agg(n.alias("chunk_count")).filter("chunk_count > 0"), at)


def _registered(out: DataFrame, at: Column | None) -> DataFrame:
    return out.select(F.sha2("source", 256).alias("id"), F.element_at(F.split("source", "/"), -1).alias("name"), "type", "source", "chunk_count", (at if at is not None else F.current_timestamp().cast("timestamp_ntz")).alias("ingested_at"))


def outcomes(parsed: DataFrame, chunk_counts: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """(success queue, failure queue) of one parsed batch."""
    ok = parsed.filter("status = 'OK'").join(chunk_counts.select(F.col("source").alias("path"), "chunk_count"), "path", "left")
    good = ok.select(F.lit(batch_id).alias("batch_id"), F.col("name").alias("file_name"), F.col("path").alias("file_path"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    bad = parsed.filter("status <> 'OK'").select(F.lit(batch_id).alias("batch_id"), F.col("name").alias("file_name"), F.col("path").alias("file_path"), F.substring("error", 1, 4000).alias("error_message"))
    return good, bad


def batch_status(total: Column, good: Column, bad: Column) -> Column:
    return F.when(good + bad < total, "RUNNING").when(bad == 0, "COMPLETED").when(good == 0, "FAILED").otherwise("COMPLETED_WITH_ERRORS")


def batch_report(batches: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """Each batch with its counts, status and what is pending."""
    g = good.groupBy("batch_id").agg(F.count("*").alias("success_count"))
    b = bad.groupBy("batch_id").agg(F.count("*").alias("failure_count"))
    out = batches.join(g, "batch_id", "left").join(b, "batch_id", "left").na.fill(0, ["success_count", "failure_count"])
    done = F.col("success_count") + F.col("failure_count")
    return out.withColumn("pending_count", F.greatest(F.lit(0), F.col("total_files") - done)).withColumn("status", batch_status(F.col("total_files"), F.col("success_count"), F.col("failure_count")))


def without(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The table without the keys of ``gone``; nothing else is touched."""
    return table.join(gone.select(key), key, "left_anti")


# A stored table is a folder of versions vNNNNNNNN, of which the newest finished one
# counts, of batches d-NAME-EPOCH that streams wrote since, and, for each version, of
# empty folders fNNNNNNNN/NAME-EPOCH that say up to which batch of each stream it
# has taken in. A batch that is tried again replaces itself, or is left out if a
# version has it.


def _names(spark: SparkSession, path: str, finished: bool = True) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = hadoop(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(n for n in names if not finished or fs.exists(hadoop(f"{path}/{n}/_SUCCESS")))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished versions below a table's folder, oldest first:
    Spark's mark of success is what finishes one."""
    return [n for n in _names(spark, path) if n.startswith("v") and n[1:].isdigit()]


def _epochs(names: list[str]) -> dict[str, int]:
    return {n.rpartition("-")[0]: int(n.rpartition("-")[2]) for n in names}


def _taken(spark: SparkSession, path: str, version: str | None) -> dict[str, int]:
    return _epochs(_names(spark, f"{path}/f{version[1:]}", finished=False)) if version else {}


def current_snapshot(spark: SparkSession, path: str) -> str | None:
    """Folder of a stored table's newest finished version, if there is one."""
    found = _versions(spark, path)
    return f"{path}/{found[-1]}" if found else None


def folders(spark: SparkSession, path: str) -> list[str]:
    """What a stored table is read from: its newest version and later batches."""
    names = _names(spark, path)
    version = max((n for n in names if n.startswith("v") and n[1:].isdigit()), default=None)
    taken = _taken(spark, path, version)
    later = [n for n in names if n.startswith("d-") and int(n.rpartition("-")[2]) > taken.get(n[2:].rpartition("-")[0], -1)]
    return [f"{path}/{n}" for n in ([version] if version else []) + later]


def put_batch(spark: SparkSession, df: DataFrame, path: str, stream: str, epoch: int, partition: tuple[str, ...] = ()) -> None:
    """Add a stream's batch to a stored table, once however often it is tried."""
    version = (_versions(spark, path) or [None])[-1]
    if epoch > _taken(spark, path, version).get(stream, -1):
        df.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/d-{stream}-{epoch:012d}")


def swap_snapshot(spark: SparkSession, df: DataFrame, path: str, partition: tuple[str, ...] = (), read: list[str] | None = None) -> None:
    """Replace a stored table by a new version of it. Readers see the one or the
    other, at no time none; what the version before was read from stays for those
    that read it. ``read`` are the folders() that ``df`` was made from: batches
    among them are in the new version, later ones come on top of it."""
    read = folders(spark, path) if read is None else read
    old = _versions(spark, path)
    number = f"{int(old[-1][1:]) + 1 if old else 0:08d}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = _taken(spark, path, old[-1] if old else None)
    taken = dict(before)
    for stream, epoch in ((n[2:].rpartition("-")[0], int(n.rpartition("-")[2])) for n in (f.rpartition("/")[2] for f in read) if n.startswith("d-")):
        taken[stream] = max(epoch, taken.get(stream, -1))
    fs.delete(hadoop(f"{path}/f{number}"), True)
    for stream, epoch in taken.items():
        fs.mkdirs(hadoop(f"{path}/f{number}/{stream}-{epoch:012d}"))
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/v{number}")
    gone = [n for v in old[:-1] for n in (v, f"f{v[1:]}")] + [n for n in _names(spark, path) if n.startswith("d-") and int(n.rpartition("-")[2]) <= before.get(n[2:].rpartition("-")[0], -1)]
    for name in gone:
        fs.delete(hadoop(f"{path}/{name}"), True)
