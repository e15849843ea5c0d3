"""Exact vector retrieval with category routing and an unfiltered fallback."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import Retrieval
from ..functions.classify import CATALOG, EXPLANATION_CATEGORIES, LOOKUP, intent
from .layout import small
from .scratch import stored

#: Questions up to which a block is sent to every executor.
BROADCAST_QUESTIONS = 10_000
#: Products that a task holds at once, pairs it works out anew at once, and how far a
#: product may be from the sum of its terms.
TILE, PAIRS, MARGIN = 1 << 20, 1 << 13, 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(questions: DataFrame, chunks: DataFrame, k: int, min_score: float | None = None, score_mode: str = "relevance", lookup: Column | None = None) -> DataFrame:
    """qid and the columns of questions and chunks without their vectors, score: the
    chunks that are, in each task, among the ``k`` best of a question; with
    ``lookup``, whether a question looks something up, among the ``k`` best within its
    categories or the ``k`` best without, told by ``_in``. The questions are one block.
    What has no usable vector is left out; lengths that differ do not meet.

    Questions and a batch of chunks are matrices, and a task multiplies them. What may
    be among the best by a product is worked out anew, term by term, so that equal
    vectors get equal scores and ties go to the smaller chunk id."""
    spark = questions.sparkSession
    asked = questions.select("*", *([] if lookup is None else [lookup.alias("_lookup")]))
    rows = asked.collect()
    local = spark.createDataFrame(rows, asked.schema).drop("embedding", "_lookup") if rows else asked.limit(0).drop("embedding", "_lookup")
    local = spark.createDataFrame([(i, *r) for i, r in enumerate(local.collect())], StructType([StructField("_qi", IntegerType()), *local.schema]))
    by_dim: dict[int, list] = {}
    for i, r in enumerate(rows):
        v = np.array([np.nan if x is None else x for x in r.embedding or ()], np.float64)
        norm = _norms(v[None])[0] if len(v) else 0.0
        if norm > 0 and np.isfinite(norm):
            by_dim.setdefault(len(v), []).append((i, v, norm, bool(lookup is not None and r["_lookup"])))
    sides = spark.sparkContext.broadcast({d: tuple(np.array(c) for c in zip(*own, strict=True)) for d, own in by_dim.items()})
    inside = [] if lookup is None else [F.coalesce(F.col("category") == CATALOG, F.lit(False)).alias("_catalog"), F.coalesce(F.col("category").isin(*EXPLANATION_CATEGORIES), F.lit(False)).alias("_told")]
    src = chunks.select(*[c for c in chunks.columns if c != "embedding"], *inside, F.col("embedding").cast("array<double>").alias("_v"))
    kept = [f for f in src.schema if f.name not in ("_v", "_catalog", "_told")]
    parted, relevance, at_id = lookup is not None, score_mode == "relevance", [f.name for f in kept].index("chunk_id")

    def run(batches):
        held: pa.Table | None = None
        best: dict[tuple[int, int], np.ndarray] = {}  # of a length and a group: the k-th score of each question
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("_v")), 0).to_numpy(zero_copy_only=False)
            for dim, (qi, q, qn, looks) in sides.value.items():
                own = np.flatnonzero(size == dim)
                x = batch.column("_v").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
                norms = _norms(x)
                fine = (norms > 0) & np.isfinite(norms)
                own, x, norms = own[fine], x[fine], norms[fine]
                flags = None if not parted else [batch.column(c).to_numpy(zero_copy_only=False)[own] for c in ("_catalog", "_told")]
                step, fresh = max(1, TILE // max(len(own), 1)), []
                for lo in range(0, len(qi) if len(own) else 0, step):
                    found = []
                    part = slice(lo, lo + step)
                    near = (q[part] / qn[part, None]) @ (x / norms[:, None]).T
                    groups = [None] if flags is None else _parted(looks[part], *flags)
                    for g, member in enumerate(groups):
                        near_g = near if member is None else np.where(member, near, -np.inf)
                        least = best.setdefault((dim, g), np.full(len(qi), -np.inf))
                        m = near_g.shape[1]
                        floor = np.maximum(np.partition(near_g, m - k, axis=1)[:, m - k] if m >= k else -np.inf, least[part]) - MARGIN
                        hit = near_g >= floor[:, None]
                        i, j = np.nonzero(hit if member is None else hit & member)
                        for at in range(0, len(i), PAIRS):
                            a, b = i[at : at + PAIRS] + lo, j[at : at + PAIRS]
                            cosine = np.cumsum(q[a] * x[b], axis=1)[:, -1] / (qn[a] * norms[b])
                            score = (1 + cosine) / 2 if relevance else cosine
                            good = score >= (-np.inf if min_score is None else min_score)
                            found.append((qi[a[good]], np.full(int(good.sum()), g), score[good], own[b[good]]))
                    if found:
                        # the best of these questions in the batch; their rows are taken once a batch
                        qs, gs, scores, at = (np.concatenate([f[c] for f in found]) for c in range(4))
                        ids = batch.column("chunk_id").take(pa.array(at))
                        fresh.append(_cut(pa.table([pa.array(qs, pa.int32()), pa.array(gs, pa.int32()), pa.array(scores), ids, pa.array(at)], names=["_qi", "_g", "score", "_id", "_at"]), k, 3))
                if fresh:
                    new = pa.concat_tables(fresh)
                    rows = batch.select([f.name for f in kept]).take(new["_at"].combine_chunks())
                    new = pa.table([*new.columns[:3], *rows.columns], names=["_qi", "_g", "score", *rows.schema.names])
                    held = _cut(new if held is None else pa.concat_tables([held, new]), k, at_id + 3)
                    # only what may still be among the best is looked at from now on
                    for g in range(2 if parted else 1):
                        _raise(best[dim, g], qi, held, g, k, relevance)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    found = src.mapInArrow(run, f"_qi int, _g int, score double, {kinds}")
    out = found.join(F.broadcast(local), "_qi")
    return out.drop("_qi", "_g") if lookup is None else out.withColumn("_in", F.col("_g") == 0).drop("_qi", "_g")


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def _parted(looks: np.ndarray, catalog: np.ndarray, told: np.ndarray) -> list[np.ndarray]:
    """Which chunks are within each question's categories, and which are not."""
    inside = np.where(looks[:, None], catalog[None], told[None])
    return [inside, ~inside]


def _cut(table: pa.Table, k: int, at_id: int) -> pa.Table:
    """The k best rows of each question and group, ties to the smaller chunk id."""
    order = pc.sort_indices(table, sort_keys=[("_qi", "ascending"), ("_g", "ascending"), ("score", "descending"), (table.column_names[at_id], "ascending")])
    table = table.take(order)
    key = table["_qi"].to_numpy().astype(np.int64) * 2 + table["_g"].to_numpy()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return table.take(pa.array(np.flatnonzero(place < k)))


def _raise(least: np.ndarray, qi: np.ndarray, held: pa.Table, g: int, k: int, relevance: bool) -> None:
    """Put the cosine of each question's k-th best into ``least``."""
    own = held["_g"].to_numpy() == g
    ids, score = held["_qi"].to_numpy()[own], held["score"].to_numpy()[own]
    n = np.bincount(ids, minlength=int(qi.max()) + 1)
    low = np.full(len(n), np.inf)
    np.minimum.at(low, ids, score)
    full = n[qi] >= k
    least[full] = 2 * low[qi[full]] - 1 if relevance else low[qi[full]]


def in_blocks(questions: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``ask`` finds for all questions. More than may be broadcast are dealt
    by the hash of their qid into blocks of half as many on average, so that
    none is too long; each block scans the chunks once."""
    n = questions.count()
    if n <= BROADCAST_QUESTIONS:
        return ask(questions)
    blocks = -(-2 * n // BROADCAST_QUESTIONS)
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [ask(questions.filter(block == i)) for i in range(blocks)])


def without(chunks: DataFrame, *names: str) -> DataFrame:
    """``chunks`` without some columns, which with_columns() gives back to what is
    found; ``_row`` tells apart rows of one id."""
    return chunks.withColumn("_row", F.xxhash64(*names)).drop(*names)


def with_columns(found: DataFrame, chunks: DataFrame, *names: str) -> DataFrame:
    """``found`` with the columns that without() took off: wide ones, texts say, are
    read for what was found and not held by the search."""
    found = stored(found)
    key = lambda a, b: a["chunk_id"].eqNullSafe(b["chunk_id"]) & (a["_row"] == b["_row"])
    ids = small(found.select("chunk_id", "_row").distinct())
    wide = chunks.select("chunk_id", *names).withColumn("_row", F.xxhash64(*names))
    wide = wide.join(ids, key(wide, ids), "left_semi").dropDuplicates(["chunk_id", "_row"])
    return found.join(wide, key(found, wide)).select(*[found[c] for c in found.columns if c != "_row"], *[wide[c] for c in names])


def ranked(df: DataFrame, k: int, score: str = "score", rank: str = "rank") -> DataFrame:
    """The k best per question; ties go to the smaller chunk id."""
    w = Window.partitionBy("qid").orderBy(F.desc(score), "chunk_id")
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_k(questions: DataFrame, chunks: DataFrame, k: int, min_score: float | None = None, categories: tuple[str, ...] | None = None, score_mode: str = "relevance") -> DataFrame:
    """Filtered exact top-k; the filter reaches the scan of the chunks."""
    if categories is not None:
        chunks = chunks.filter(F.col("category").isin(*categories))

    return in_blocks(questions, lambda block: ranked(nearest(block, chunks, k, min_score, score_mode), k))


def routed(questions: DataFrame, chunks: DataFrame, k: int, config: Retrieval = Retrieval()) -> DataFrame:
    """Retrieval by intent: lookups among the catalog, explanations among the
    narrative categories. A question whose categories give nothing above the
    floor is answered from all chunks, in the same job."""
    return in_blocks(questions, lambda block: _routed(block, chunks, k, config))


def _routed(questions: DataFrame, chunks: DataFrame, k: int, config: Retrieval) -> DataFrame:
    q = questions.withColumn("intent", intent(F.col("question")))
    if not config.routing:
        return ranked(nearest(q, chunks, k, config.min_score, config.score_mode), k).withColumn("fallback", F.lit(False))
    # the best of either set per question suffices: no window over all pairs
    found = nearest(q, chunks, k, config.min_score, config.score_mode, F.col("intent") == LOOKUP)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "_in").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)
    w = Window.partitionBy("qid")
    best = best.withColumn("_any", F.max("_in").over(w))
    kept = best.filter(F.col("_in") | (F.lit(config.fallback_when_empty) & ~F.col("_any")))
    return ranked(kept.drop("rank"), k).withColumn("fallback", ~F.col("_any")).drop("_in", "_any")
