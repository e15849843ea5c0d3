"""What the training-data operators share: table access, the shared work
folder, size-checked broadcasts and small expression helpers."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows, and bytes as stored, up to which a written side may be broadcast; beyond
#: either, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

_made: list[tuple[SparkSession, str]] = []


#: Bytes up to which a table in fewer files than there are cores is dealt anew.
SPREAD_BYTES = 256 << 20
#: Rows of one key that go to one task in a join, at least, and keys with more
#: rows than that, at most.
KEY_ROWS, HOT_KEYS = 128, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table to all cores if it lies in fewer files,
    before costly work on each row; larger tables have files enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if stored_bytes(df) <= SPREAD_BYTES and 0 < len(df.inputFiles()) < cores else df


def stored_bytes(df: DataFrame) -> int:
    """Bytes of what ``df`` reads, as Spark estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def work_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is made only
    where the setting is absent on one machine. On a cluster that is an error:
    executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file:" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/siftwell/{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate; whatever reads it must be over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            forget(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


_over: list[tuple[SparkSession, str]] = []


def staged(function):
    """A pipeline stage whose intermediates go when the next stage begins: its
    result has been written by then. What the next stage's input itself reads
    stays."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _over:
            files = "\n".join(docs.inputFiles())
            for pair in [x for x in _over if x[1].rpartition("/")[2] not in files]:
                forget(*pair)
                _over.remove(pair)
                _made.remove(pair)
        before = len(_made)
        out = function(spark, docs, sf_dir)
        _over.extend(_made[before:])
        return out

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage
    ends there and a lost executor costs nothing that was done before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df``, read from a written table, has at most
    ``most`` rows and BROADCAST_BYTES; else leave it to a shuffled join."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES and df.count() <= most else df


def spread_join(rows: DataFrame, hubs: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join ``rows``, many of which may share a ``key``, with the one row of it
    in ``hubs``; both are written tables, ``how`` is inner or left. Few hubs are
    broadcast. Rows without a key are dealt to all tasks. Beyond, a key with more rows than go to one task is dealt to
    several by the hash of ``by``, its hub sent to each. So many rows are let go
    to one task that at most HOT_KEYS keys have more, which are broadcast."""
    hint = small(hubs)
    if hint is not hubs:
        return rows.join(hint, key, how)
    most = max(KEY_ROWS, rows.count() // HOT_KEYS + 1)
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") > most) & F.col(key).isNotNull())
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_salts")))
    one = F.coalesce("_salts", F.lit(1))
    own = F.when(F.col(key).isNull(), F.lit(HOT_KEYS)).otherwise(one)
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), own).cast("int")).drop("_salts")
    sent = hubs.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return dealt.join(sent, [key, "_salt"], how).drop("_salt")


#: Bytes of an Arrow batch, where the session has Spark's default, which is
#: more than a small executor's two workers should hold.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def tidy(function):
    """A function for mapInArrow that gives its memory back when it is done:
    workers are used again, and what one stage held counts for the next."""
    spark = SparkSession.getActiveSession()
    key, usual, ours = ARROW_BYTES
    if spark is not None and spark.conf.get(key, usual) == usual:
        spark.conf.set(key, ours)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def ascii_lower(col):
    """Lower-case A-Z alone."""
    return F.translate(col, UPPER, LOWER)


def fold(doc_id, n: int):
    """crc32(doc_id as text) mod n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
