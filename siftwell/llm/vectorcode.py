"""Product codes of vectors, their codebooks trained with annular norm pruning.

Components become integers, so that distances and means are exact. A vector is
cut into PARTS consecutive parts; the codebook of a part begins as that part of
the first vectors by id, and each round assigns every part to its nearest entry
and moves the entry to the floor of its parts' mean.

A part x at distance d from some entry has its nearest entry c among those with
norms from |x| - d to |x| + d, since |c - x| >= ||c| - |x||. So the entries are
sorted by norm; the few next to |x| give the first d; the interval it allows is
found by binary search, both ends included; only this annulus is evaluated, and
exactly. Rows of a batch are taken in the order of their norms, so that the annuli
of a block of rows are nearly one slice of the codebook, one matrix product. Products
are in floats while these hold them exactly, else in integers.

The usable rows are written once. A round is one pass over them; what leaves a task are the sums of each entry,
added up by key over all tasks. The driver holds codebooks only: ENTRIES times a
vector's length.

Defined results: rows with a null vector, or a null or non-finite component, are
dropped. Vectors of different lengths have codebooks of their own. Where PARTS
does not divide the length, part i begins at i * length // PARTS; an empty part
is at distance 0 from entry 0. First vectors are those of the smallest ids, rows
without an id last, equal ids in the order of their vectors; repeated rows count
each. Components are held to a magnitude at which no distance overflows a long
(2^27 at 64 components). A sum of errors that overflows is null. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import spread_join, table, tidy, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries next in norm that give the first distance, and rows that share a slice.
NEXT, BLOCK = 4, 128


def finite(vec: str):
    """Whether an array holds no null and nothing that is not finite."""
    x = F.col(vec).cast("array<double>")
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def most(dim: int) -> int:
    """Magnitude of components at which sums of squared distances fit a long."""
    return isqrt((1 << 62) // max(dim, 1)) // 2


def by_length(cells: pa.Array):
    """(length, rows, matrix) of a batch's arrays of numbers."""
    size = pc.list_value_length(cells).to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield dim, own, cells.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    hold = float(most(x.shape[1]))
    return np.clip(np.floor(x.astype(np.float64) * scale), -hold, hold).astype(np.int64)


def edges(dim: int) -> list[int]:
    return [i * dim // PARTS for i in range(PARTS + 1)]


class Codebook:
    """Entries of one part in the order of their norms."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.index = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.index], norms[self.index]

    def _distances(self, x: np.ndarray, lo: int, hi: int, exact: bool) -> np.ndarray:
        c = self.entries[lo:hi]
        if not exact:
            return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] + (cf * cf).sum(axis=1)[None, :] - 2 * (xf @ cf.T)).astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry and its squared distance for each row, the
        smaller index among equals; and how many pairs the annuli held."""
        code, error, pairs = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        k = len(self.entries)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(norms, kind="stable")
        largest = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        exact = 4 * largest * largest * max(x.shape[1], 1) < 1 << 53
        for at in range(0, len(x), BLOCK):
            rows = order[at : at + BLOCK]
            own, n = x[rows], norms[rows]
            a = min(max(int(np.searchsorted(self.norms, n[len(n) // 2])) - NEXT // 2, 0), max(k - NEXT, 0))
            d = np.sqrt(self._distances(own, a, min(a + NEXT, k), exact).min(axis=1).astype(np.float64))
            slack = 1e-9 * (n + d + 1)
            lo = np.searchsorted(self.norms, n - d - slack, "left")
            hi = np.searchsorted(self.norms, n + d + slack, "right")
            first, last = int(lo.min()), int(hi.max())
            found = self._distances(own, first, last, exact)
            place = np.arange(first, last)
            inside = (place >= lo[:, None]) & (place < hi[:, None])
            pairs += int(inside.sum())
            found[~inside] = np.iinfo(np.int64).max
            best = found.min(axis=1)
            code[rows] = np.where(found == best[:, None], self.index[first:last][None, :], k).min(axis=1)
            error[rows] = best
        return code, error, pairs


Books = dict[int, list[np.ndarray]]


def _books(rows: DataFrame) -> Books:
    """The first vectors of each length, cut into parts."""
    out: Books = {}
    for (dim,) in rows.select("dim").distinct().collect():
        first = rows.filter(F.col("dim") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES)
        found = first.select("v").collect()
        x = integers(np.array([r.v for r in found], np.float64).reshape(len(found), dim), SCALE)
        out[dim] = [x[:, a:b] for a, b in zip(edges(dim), edges(dim)[1:], strict=False)]
    return out


def _moved(rows: DataFrame, books: Books) -> Books:
    """One round: entries at the floored means of the parts assigned to them."""
    sums = "dim int, part int, entry int, at int, n bigint, s bigint"
    names = [x.split()[0] for x in sums.split(", ")]

    def run(batches):
        ready = {dim: [Codebook(b) for b in own] for dim, own in books.items()}
        count = {dim: [np.zeros(len(b), np.int64) for b in own] for dim, own in books.items()}
        total = {dim: [np.zeros(b.shape, np.int64) for b in own] for dim, own in books.items()}
        for batch in batches:
            for dim, _, x in by_length(batch.column(0)):
                x, e = integers(x, SCALE), edges(dim)
                for p, book in enumerate(ready[dim]):
                    own = x[:, e[p] : e[p + 1]]
                    code = book.nearest(own)[0]
                    order = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                    count[dim][p] += np.bincount(code, minlength=len(count[dim][p]))
                    total[dim][p][code[order][starts]] += np.add.reduceat(own[order], starts, axis=0)
        for dim, own in count.items():
            for p, n in enumerate(own):
                used = np.flatnonzero(n)
                width = total[dim][p].shape[1]
                if len(used) and width:
                    cols = [np.full(len(used) * width, dim), np.full(len(used) * width, p), np.repeat(used, width), np.tile(np.arange(width), len(used)), np.repeat(n[used], width), total[dim][p][used].ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 4 else pa.int64()) for i, c in enumerate(cols)], names=names)

    added = rows.select("v").mapInArrow(tidy(run), sums).groupBy("dim", "part", "entry", "at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ns"])
    out = {dim: [b.copy() for b in own] for dim, own in books.items()}
    for r in added.collect():
        out[r.dim][r.part][r.entry, r.at] = int(r.s) // int(r.n)
    return out


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def codes(df: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vec: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, Books]:
    """``id_col``, the ``keep`` columns, code (two hex digits for each part),
    error (squared distance, summed over the parts) and codebooks_sha256 (of the
    codebooks of the row's length); and the codebooks."""
    names = [f"_keep{n}" for n in range(1 + len(keep))]
    src = df.filter(finite(vec)).select(*[F.col(c).alias(n) for c, n in zip((id_col, *keep), names, strict=True)], F.col(vec).alias("v"))
    src = written(src, "vectors")
    rows = src.select(F.col("_keep0").alias("id"), "v", F.size("v").alias("dim"))
    books = _books(rows)
    for _ in range(rounds):
        books = _moved(rows, books)
    digests = {dim: digest(b) for dim, b in books.items()}

    def run(batches):
        ready = {dim: [Codebook(b) for b in own] for dim, own in books.items()}
        for batch in batches:
            for dim, at, x in by_length(batch.column(len(names))):
                x, e = integers(x, SCALE), edges(dim)
                found = [book.nearest(x[:, e[p] : e[p + 1]]) for p, book in enumerate(ready[dim])]
                code = np.stack([c for c, _, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                cells = [pa.array([code[i : i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)], pa.string()), pa.array(sum(d for _, d, _ in found)), pa.array([digests[dim]] * len(at), pa.string())]
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *cells], names=[*names, "code", "error", "codebooks_sha256"])

    kinds = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)
    return src.mapInArrow(tidy(run), f"{kinds}, code string, error bigint, codebooks_sha256 string").toDF(id_col, *keep, "code", "error", "codebooks_sha256"), books


def with_sums(coded: DataFrame, by: str, name: str) -> DataFrame:
    """``coded`` with its errors summed over equal ``by``, nulls together; keys
    with many rows are dealt to several tasks."""
    key = F.when(F.col(by).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(by).cast("string")))
    rows = written(coded.withColumn("_key", key), "vector-codes")
    total = F.expr("try_cast(sum(CAST(error AS decimal(38,0))) AS bigint)")
    sums = written(rows.groupBy("_key").agg(total.alias(name)), "vector-sums")
    return spread_join(rows, sums, "_key", "code").select(*coded.columns, name)


def op11_vectorcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=("label",))
    return with_sums(coded, "label", "label_error").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The rounds written out one after another; distances in doubles, which
    hold these integers exactly."""
    near = """
d{n} AS MATERIALIZED (SELECT row, part, arg_min(entry, dist * 1024 + entry) AS entry, min(dist) AS dist
  FROM (SELECT x.row, x.part, c.entry, list_dot_product(x.e, x.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(x.e, c.e) AS dist
        FROM parts x JOIN b{n} c USING (part)) GROUP BY row, part),"""
    move = """
m{n} AS (SELECT part, entry, pos, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n
  FROM (SELECT part, d.entry, unnest(p.e) AS x, generate_subscripts(p.e, 1) AS pos FROM d{m} d JOIN parts p USING (row, part)) GROUP BY part, entry, pos),
b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(list(CAST((s - (((s % n) + n) % n)) // n AS DOUBLE) ORDER BY pos) FILTER (pos IS NOT NULL), any_value(b.e)) AS e
  FROM b{m} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry GROUP BY b.part, b.entry),"""
    sql = """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS e FROM v CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, e FROM parts WHERE row <= 256),"""
    for n in range(ROUNDS):
        sql += near.format(n=n) + move.format(n=n + 1, m=n)
    return sql + near.format(n=ROUNDS) + f"""
k AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM b{ROUNDS})),
r AS (SELECT v.row, v.vec_id, v.label, string_agg(format('{{:02x}}', d.entry), '' ORDER BY d.part) AS code, CAST(sum(d.dist) AS BIGINT) AS error
      FROM v JOIN d{ROUNDS} d USING (row) GROUP BY v.row, v.vec_id, v.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, k"""


SQL = {"op11_vectorcode": _sql()}
