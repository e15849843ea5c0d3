"""Exact nearest neighbours as a block matrix join over int8 tiles.

Every vector is scaled to unit length and quantised to int8 with its own scale;
the norm of what rounding lost is kept. Vectors are stored in blocks of up to
``TILE`` rows. Query blocks meet data blocks tile by tile, as int8 alone: an
integer matrix product gives approximate cosines, and
``|e_q| + (1 + |e_q|) |e_d|`` bounds their error. Each task keeps, per query of
the blocks it sees, the k largest lower bounds so far, and passes on the pairs
whose upper bound reaches the least of them. The bounds of all tasks are merged;
pairs under the merged bound go. For the others alone the original vectors are
fetched, block by block, the cosines recomputed in double precision and cut by a
heap per query and tile, and the heaps merged. No neighbour is lost, whatever
the data.

A few query blocks are broadcast and data is not moved at all. Beyond that a tile
key is (query block, data chunk): data rows are sent once per query block, a byte
a component, and query blocks once per chunk. No task holds more than a tile and
the bounds of its queries. Of equal vectors under many ids only the ``k + 1``
smallest ids can be among the nearest; the others are left out before.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component take no part, nor do null ids; vectors of different
lengths are not compared; rows that share a vec_id are one entity, so equal
rows count once, wherever they lie, and a row under the query's own id is no
candidate;
ties go to the smaller id; with fewer than k candidates all come back.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import small, spread_join, table, tidy, written

TILE = 2048
#: Pairs that are recomputed at once.
PAIRS = 1 << 16
#: Float32 products of int8 are exact up to this many dimensions.
EXACT_DIMS = 1040
#: Tiles that one cell of the grid holds, about.
CELL_TILES = 1024

BLOCK = "block bigint, dim int, ids binary, q8 binary, scales binary, errors binary, vecs binary"


def quantise(vectors: np.ndarray):
    """int8 rows, their scales, and the norms of the rounding errors."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in order, so that equal rows get equal values."""
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


def _firsts(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])


def _best(lows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, of an id the largest alone; without an id,
    and where there are fewer, minus infinity."""
    order = np.lexsort((-lows, ids), axis=1)
    lows, ids = np.take_along_axis(lows, order, 1), np.take_along_axis(ids, order, 1)
    again = np.zeros(lows.shape, dtype=bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    lows = np.where(again, -np.inf, lows)
    top = np.argsort(-lows, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(lows, top, 1), np.take_along_axis(ids, top, 1)


def _none(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), -np.inf), np.tile(np.arange(k) + np.iinfo(np.int64).min, (n, 1))


def _usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    plain = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & plain).filter((norm > 0) & (norm < float("inf")))


def _few_copies(rows: DataFrame, k: int) -> DataFrame:
    """Without the ids of equal vectors that can be nearest to nothing."""
    rows = rows.withColumn("same", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v"))))
    many = rows.groupBy("same").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1)
    many = written(many.select("same", F.lit(True).alias("many")), "ann-copies")
    if not many.head(1):
        return rows.select("id", "v")
    rows = spread_join(rows, many, "same", "id", "left")
    w = Window.partitionBy("same").orderBy("id")
    cut = rows.filter("many").dropDuplicates(["same", "id"]).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    return rows.filter("many is null").select("id", "v").unionByName(cut.select("id", "v"))


def _pack(rows: DataFrame, tile: int) -> DataFrame:
    """Blocks of up to ``tile`` rows of one length, in the order of ids. Blocks
    are made inside each partition, without a shuffle."""
    from pyspark import TaskContext

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(dim):
            nonlocal serial
            serial += 1
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, vecs = ids[order], vecs[order]
            q, scale, error = quantise(vecs)
            cells = [serial, dim, *(x.tobytes() for x in (ids, q, scale, error, vecs))]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                vecs = b.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for at in range(0, len(own), tile):
                    n = sum(len(x) for x, _ in held.get(dim, ()))
                    # at most a tile: fill up, then begin anew
                    for lo, hi in ((at, min(at + tile - n, len(own))), (at + tile - n, min(at + tile, len(own)))):
                        if lo < hi:
                            held.setdefault(dim, []).append((ids[own[lo:hi]], vecs[lo:hi]))
                            if sum(len(x) for x, _ in held[dim]) == tile:
                                yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(tidy(run), BLOCK)


def _tiles(q: DataFrame, d: DataFrame) -> DataFrame:
    """Every query block with every data block of its length, int8 alone. Query
    blocks that are too many to be sent to all tasks are dealt, with the data
    blocks, to the cells of a grid: a data block goes to each row of it once, a
    query block to each column, so with so many rows that both move as much,
    neither moves more often than the root of the cells."""
    cols = ["ids", "q8", "scales", "errors"]
    q = q.select("dim", F.col("block").alias("qb"), *[F.col(c).alias(f"q_{c}") for c in cols])
    d = d.select("dim", "block", *cols)
    hint = small(q)
    if hint is not q:
        return d.join(hint, "dim")
    rows, columns = grid(q.count(), d.count(), d.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = d.withColumn("column", F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int")).withColumn("row", every(rows))
    right = q.withColumn("row", F.pmod(F.xxhash64("qb"), F.lit(rows)).cast("int")).withColumn("column", every(columns))
    return left.join(right, ["row", "column", "dim"])


def grid(n_q: int, n_d: int, cores: int) -> tuple[int, int]:
    """Rows (of query blocks) and columns (of data blocks) of a grid with a cell
    for about CELL_TILES tiles, and a few for each core at least."""
    cells = max(4 * cores, n_q * n_d // CELL_TILES)
    rows = min(max(1, round((cells * n_q / max(n_d, 1)) ** 0.5)), max(n_q, 1))
    return rows, min(max(1, cells // rows), max(n_d, 1))


def _arrays(cells, kinds):
    return [np.frombuffer(c, t) for c, t in zip(cells, kinds, strict=True)]


def _bounds(tiles: DataFrame, k: int) -> DataFrame:
    """Per tile the pairs (i, j) that may be among the nearest, with their upper
    bounds; and per task and query block, without ``block``, the k largest lower
    bounds and their ids."""
    kinds = (np.int64, np.int8, np.float64, np.float64)
    names = ["qb", "block", "i", "j", "upper", "lows", "ids"]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]

    def row(*cells):
        return pa.RecordBatch.from_arrays([pa.array([c if not isinstance(c, np.ndarray) else c.tobytes()], t) for c, t in zip(cells, types, strict=True)], names=names)

    def run(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            for at in range(b.num_rows):
                dim, qb, block, *cells = (c[at].as_py() for c in b.columns)
                qi, q8, qs, qe = _arrays(cells[:4], kinds)
                di, d8, ds, de = _arrays(cells[4:], kinds)
                kind = np.float32 if dim <= EXACT_DIMS else np.float64
                near = (q8.reshape(-1, dim).astype(kind) @ d8.reshape(-1, dim).astype(kind).T).astype(np.float64) * qs[:, None] * ds[None, :]
                bound = qe[:, None] + (1 + qe[:, None]) * de[None, :]
                other = qi[:, None] != di[None, :]
                low, first = np.where(other, near - bound, -np.inf), _firsts(di)
                low = np.maximum.reduceat(low, first, axis=1)
                top = np.argpartition(-low, k - 1, axis=1)[:, :k] if low.shape[1] > k else np.tile(np.arange(low.shape[1]), (len(qi), 1))
                held = best.get(qb) or _none(len(qi), k)
                lows, ids = _best(np.hstack([held[0], np.take_along_axis(low, top, 1)]), np.hstack([held[1], di[first][top]]), k)
                best[qb] = lows, ids
                upper = near + bound
                i, j = np.nonzero((upper >= lows[:, -1:]) & other)
                if len(i):
                    yield row(qb, block, i.astype(np.int32), j.astype(np.int32), upper[i, j], None, None)
        for qb, (lows, ids) in best.items():
            yield row(qb, None, None, None, None, lows, ids)

    schema = "qb bigint, block bigint, i binary, j binary, upper binary, lows binary, ids binary"
    return tiles.select("dim", "qb", "block", "q_ids", "q_q8", "q_scales", "q_errors", "ids", "q8", "scales", "errors").mapInArrow(tidy(run), schema)


def _least(bounds: DataFrame, k: int) -> DataFrame:
    """Per query block the k-th largest lower bound of each of its queries."""

    def run(batches):
        rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()) for b in batches for i in range(b.num_rows))
        for qb, own in groupby(rows, key=lambda r: r[0]):
            held = None
            for _, lows, ids in own:
                new = np.frombuffer(lows).reshape(-1, k), np.frombuffer(ids, np.int64).reshape(-1, k)
                held = new if held is None else _best(np.hstack([held[0], new[0]]), np.hstack([held[1], new[1]]), k)
            yield pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), pa.array([held[0][:, -1].tobytes()], pa.binary())], names=["qb", "least"])

    own = bounds.filter("block is null").select("qb", "lows", "ids")
    return own.repartition("qb").sortWithinPartitions("qb").mapInArrow(tidy(run), "qb bigint, least binary")


def _survivors(bounds: DataFrame, least: DataFrame, d: DataFrame) -> DataFrame:
    """Per tile the pairs that reach the bound of all tiles, and the ids and
    original vectors of their data rows alone."""
    kinds = (np.int32, np.int32, np.float64, np.float64, np.int64, np.float64)
    names = ["qb", "block", "dim", "i", "j", "ids", "vecs"]

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                qb, block, dim, *cells = (c[at].as_py() for c in b.columns)
                i, j, upper, floor, ids, vecs = _arrays(cells, kinds)
                kept = upper >= floor[i]
                rows, place = np.unique(j[kept], return_inverse=True)
                if len(rows):
                    out = [i[kept], place.astype(np.int32), ids[rows], vecs.reshape(-1, dim)[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), pa.array([block], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in out)], names=names)

    tiles = spread_join(bounds.filter("block is not null").select("qb", "block", "i", "j", "upper"), least, "qb", "block")
    tiles = spread_join(tiles, d.select("block", "dim", "ids", "vecs"), "block", "qb")
    return tiles.select("qb", "block", "dim", "i", "j", "upper", "least", "ids", "vecs").mapInArrow(tidy(run), "qb bigint, block bigint, dim int, i binary, j binary, ids binary, vecs binary")


def _found(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _scored(pairs: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query in each tile."""
    kinds = (np.int32, np.int32, np.int64, np.float64, np.int64, np.float64)

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                dim, *cells = (c[at].as_py() for c in b.columns)
                i, j, ids, vecs, qi, qv = _arrays(cells, kinds)
                vecs, qv = vecs.reshape(-1, dim), qv.reshape(-1, dim)
                score = np.concatenate([cosines(qv[i[n : n + PAIRS]], vecs[j[n : n + PAIRS]]) for n in range(0, len(i), PAIRS)])
                # of rows of one id the best alone; pairs are in the order of i, then of ids
                first = _firsts(i.astype(np.int64) * (len(ids) + 1) + np.searchsorted(_firsts(ids), j, side="right"))
                score = np.maximum.reduceat(score, first)
                heaps: dict[int, list] = {}
                for a, v, x in zip(i[first].tolist(), ids[j[first]].tolist(), score.tolist(), strict=True):
                    heap = heaps.setdefault(a, [])
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (x, -v))
                yield _found([(int(qi[a]), -v, x) for a, heap in heaps.items() for x, v in heap], ["query_id", "vec_id", "score"], (pa.int64(), pa.int64(), pa.float64()))

    both = spread_join(pairs, q.select(F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")), "qb", "block")
    return both.select("dim", "i", "j", "ids", "vecs", "q_ids", "q_vecs").mapInArrow(tidy(run), "query_id bigint, vec_id bigint, score double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, a heap at a time."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for query, own in groupby(rows, key=lambda r: r[0]):
            heap: list = []
            for v, same in groupby(own, key=lambda r: r[1]):
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (max(r[2] for r in same), -v))
            best = sorted(heap, reverse=True)
            yield _found([(query, n + 1, -v, x) for n, (x, v) in enumerate(best)], ["query_id", "rank", "vec_id", "score"], (pa.int64(), pa.int32(), pa.int64(), pa.float64()))

    return found.repartition("query_id").sortWithinPartitions("query_id", "vec_id").mapInArrow(tidy(run), "query_id bigint, rank int, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec: str = "embedding", tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` rows of ``vectors`` nearest
    to each row of ``queries``; both have ``id_col`` and ``vec``."""
    asked = _usable(queries, id_col, vec).dropDuplicates()
    q = written(_pack(asked.repartition(1 + asked.count() // tile, F.xxhash64("id")), tile), "ann-queries")
    d = written(_pack(_few_copies(_usable(vectors, id_col, vec), k), tile), "ann-data")
    bounds = written(_bounds(_tiles(q, d), k), "ann-bounds")
    least = written(_least(bounds, k), "ann-least")
    pairs = written(_survivors(bounds, least, d), "ann-survivors")
    return _merged(_scored(pairs, q, k), k)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))


SQL = {
    "op6_ann": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(q.e, d.e) AS score
      FROM w q JOIN w d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""
}
