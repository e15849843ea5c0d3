"""A stored keyword index that follows ingestion and deletion.

Each batch of chunks becomes a segment, a folder of postings in the order of their
terms; nothing that was written is written again. Deleted chunks are tombstones:
their ids with the number of the newest segment of that time, so that a chunk that
comes again later is seen. The statistics are sums: of the segments' numbers, less
those of the tombstones that are not yet taken off a merged segment's. Segments of like size are merged FAN at a time,
without what tombstones hide; a posting is rewritten once per size, of which there
are as many as powers of FAN. A small versioned table lists the segments that count,
so readers see a merge whole or not at all.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import ingest, keyword
from .layout import small

POSTINGS = "term string, chunk_id string, dl int, tf bigint, places array<int>"
SEGMENTS = "folder string, seq bigint, n_docs bigint, total_dl bigint, through map<string,bigint>"
GONE = "chunk_id string, seq bigint, dl int"
#: Segments of like size from which they are merged.
FAN = 8


class KeywordIndex:
    def __init__(self, spark: SparkSession, root: str, analyzer: str = "simple"):
        self.spark, self.root, self.analyzer = spark, root.rstrip("/"), analyzer

    def _table(self, name: str, schema: str) -> DataFrame:
        found = ingest.folders(self.spark, f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _put(self, name: str, df: DataFrame) -> None:
        ingest.swap_snapshot(self.spark, df, f"{self.root}/{name}")

    def segments(self) -> list:
        """The segments that count, oldest first; merges keep them few."""
        return sorted(self._table("segments", SEGMENTS).collect(), key=lambda s: s.seq)

    def available(self) -> bool:
        return bool(self.segments())

    def _list(self, segments: list[tuple]) -> None:
        self._put("segments", self.spark.createDataFrame(segments, SEGMENTS).coalesce(1))

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{self.root}/postings/{folder}")

    def add(self, chunks: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Index chunks (chunk_id, text); a stream's ``batch`` (name, epoch) once,
        however often it is tried."""
        now = self.segments()
        if batch is not None and any((s.through or {}).get(batch[0], -1) >= batch[1] for s in now):
            return
        n = F.size(F.array_distinct(tokens(F.col("text"), self.analyzer)))
        r = chunks.agg(F.count("*").alias("n"), F.sum(n).alias("dl")).head()
        if not r.n:
            return
        folder = uuid.uuid4().hex
        self._write(keyword.positional_postings(chunks, self.analyzer).select("term", F.col("chunk_id").cast("string").alias("chunk_id"), "dl", "tf", "places"), folder)
        seq = max((s.seq for s in now), default=0) + 1
        self._list([*map(tuple, now), (folder, seq, r.n, r.dl or 0, {batch[0]: batch[1]} if batch else {})])
        self.merge()

    def remove(self, chunks: DataFrame) -> None:
        """Hide indexed chunks (chunk_id, text) from now on."""
        now = self.segments()
        dl = F.size(F.array_distinct(tokens(F.col("text"), self.analyzer)))
        if now:
            new = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.lit(now[-1].seq).cast("bigint").alias("seq"), dl.alias("dl"))
            self._put("gone", self._gone(now).unionByName(new))

    def _gone(self, segments: list) -> DataFrame:
        """Tombstones that may hide something: none is older than all segments."""
        return self._table("gone", GONE).filter(F.col("seq") >= min((s.seq for s in segments), default=0))

    def _read(self, segments: list) -> DataFrame:
        """The postings of segments that no tombstone hides."""
        read = [self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings/{s.folder}").withColumn("_seq", F.lit(s.seq)) for s in segments]
        if not read:
            return self.spark.createDataFrame([], POSTINGS)
        rows = reduce(DataFrame.unionByName, read)
        gone = self._gone(self.segments()).groupBy("chunk_id").agg(F.max("seq").alias("_gone"))
        if gone.head(1):
            rows = rows.join(small(gone), "chunk_id", "left").filter("_gone is null or _gone < _seq")
        return rows.select("term", "chunk_id", "dl", "tf", "places")

    def postings(self) -> DataFrame:
        return self._read(self.segments())

    def stats(self) -> DataFrame:
        """One row: n_docs (1 at least) and avg_dl (1 if there is none)."""
        now = self.segments()
        gone = self._gone(now).agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
        n = F.lit(sum(s.n_docs for s in now)) - F.col("n")
        avg = (F.lit(sum(s.total_dl for s in now)) - F.coalesce("dl", F.lit(0))) / F.greatest(n, F.lit(1))
        return gone.select(F.greatest(n, F.lit(1)).cast("bigint").alias("n_docs"), F.when(avg > 0, avg).otherwise(F.lit(1.0)).alias("avg_dl"))

    def merge(self, all_of_them: bool = False) -> None:
        """Merge the segments of a size of which there are FAN, or all."""
        while True:
            now = self.segments()
            sizes: dict[int, list] = {}
            for s in now:
                size, n = 0, s.n_docs
                while n >= FAN:
                    size, n = size + 1, n // FAN
                sizes.setdefault(size, []).append(s)
            full = now if all_of_them else next((own for _, own in sorted(sizes.items()) if len(own) >= FAN), [])
            if len(full) < 2 and not (all_of_them and full):
                return
            folder, through = uuid.uuid4().hex, {}
            for s in full:
                for stream, epoch in (s.through or {}).items():
                    through[stream] = max(epoch, through.get(stream, -1))
            self._write(self._read(full), folder)
            left, seq = [s for s in now if s not in full], max(s.seq for s in full)
            # tombstones older than what is now the oldest segment come off its numbers
            old = self._gone(now).filter(F.col("seq") < min([s.seq for s in left] + [seq])).agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).head()
            self._list([*map(tuple, left), (folder, seq, sum(s.n_docs for s in full) - old.n, sum(s.total_dl for s in full) - (old.dl or 0), through)])
            self._forget(now)
            if all_of_them:
                return

    def _forget(self, before: list) -> None:
        """Remove folders that neither count nor did before the last change."""
        kept = {s.folder for s in (*self.segments(), *before)}
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = hadoop(f"{self.root}/postings")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for x in fs.listStatus(at):
            if x.getPath().getName() not in kept:
                fs.delete(x.getPath(), True)
