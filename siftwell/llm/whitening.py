"""Whitening of embeddings from an exact integer scatter.

Entries c become integers floor(64 * c) + SHIFT, and lose the shift again before
anything is added up, which leaves every covariance as it is and numbers small. Tasks add up sums and cross-products in matrix products of
digits of DIGIT bits, in floats that hold these products exactly, and carry them
into integers of any size; the tasks' integers are added up a tree. From n, the
sums S and the cross-products XᵀX the driver forms n·XᵀX - SSᵀ exactly, n² times
the covariance; only then is it rounded to doubles and decomposed by eigh. The
driver and each task hold squares of a vector's length, whatever the rows.

A second pass adds up the covariance of what the rows are whitened to, the same
way for each row as in the result, for ``identity_error``.

Defined results: rows with a null vector, or a null or non-finite entry, are
dropped. Vectors of different lengths are fitted apart. A component whose
eigenvalue is not above the rounding of the largest (equal rows, fewer rows than
components, repeated dimensions) whitens to 0 and is left out of identity_error.
Entries are held to a magnitude of 2^60 after scaling. Empty vectors have no
components; repeated rows count each; rows without an id are rows; an empty
table gives no rows; other columns are not read. ``deviation`` is null where it
has more than 38 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, tidy, written
from .vectorcode import by_length, finite

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a digit and rows of a product: 2 * (DIGIT - 1) + 13 is under 53.
DIGIT, BLOCK = 20, 8192
HOLD = float(1 << 60)
#: Tasks whose integers one task adds up.
FAN_IN = 64
#: Rows whose components are made at once.
ROWS = 1024


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * scale), -HOLD, HOLD).astype(np.int64) + SHIFT


def digits(z: np.ndarray) -> list[np.ndarray]:
    """Digits of DIGIT bits with signs, the lowest first, as doubles."""
    out = []
    while True:
        low = ((z + (1 << (DIGIT - 1))) & ((1 << DIGIT) - 1)) - (1 << (DIGIT - 1))
        out.append(low.astype(np.float64))
        z = (z - low) >> DIGIT
        if not z.any():
            return out


class Scatter:
    """n, sums and cross-products of integer rows less SHIFT, exactly."""

    def __init__(self, dim: int):
        self.dim, self.n = dim, 0
        self.sums, self.products = (np.zeros(s, dtype=object) for s in (dim, (dim, dim)))
        self._held: dict[int, np.ndarray] = {}  # of each power of two, in longs
        self._blocks = 0

    def add(self, x: np.ndarray) -> None:
        z = x - SHIFT
        for at in range(0, len(z), BLOCK):
            parts = digits(z[at : at + BLOCK])
            for i, a in enumerate(parts):
                one = np.vstack([a.T @ b for b in parts[i:]] + [a.sum(axis=0)[None]]).astype(np.int64)
                own = one[:-1].reshape(len(parts) - i, self.dim, self.dim)
                for k, m in enumerate(own):
                    self._hold(DIGIT * (2 * i + k), m if k == 0 else m + m.T)
                self.sums += one[-1].astype(object) << (DIGIT * i)
            self.n += len(z[at : at + BLOCK])
            self._blocks += 1
            if self._blocks == 256:  # longs hold that many blocks and more
                self.carry()

    def _hold(self, power, m):
        self._held[power] = self._held.get(power, 0) + m

    def carry(self) -> None:
        for power, m in self._held.items():
            self.products += m.astype(object) << power
        self._held, self._blocks = {}, 0

    def packed(self) -> str:
        self.carry()
        return " ".join(map(str, [self.n, *self.sums, *self.products[np.triu_indices(self.dim)]]))

    @classmethod
    def unpacked(cls, dim: int, text: str) -> Scatter:
        out, numbers = cls(dim), np.array([int(x) for x in text.split(" ")], dtype=object)
        out.n, out.sums = int(numbers[0]), numbers[1 : 1 + dim]
        upper = np.triu_indices(dim)
        out.products[upper] = numbers[1 + dim :]
        out.products.T[upper] = numbers[1 + dim :]
        return out

    def merge(self, other: Scatter) -> None:
        other.carry()
        self.n, self.sums, self.products = self.n + other.n, self.sums + other.sums, self.products + other.products


def scatter(rows: DataFrame, scale: float = SCALE) -> dict[int, Scatter]:
    """The scatter of the arrays ``v``, for each length of vectors."""

    def sent(found):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([s.packed() for s in found.values()], pa.string())], names=["dim", "s"])

    def first(batches):
        found: dict[int, Scatter] = {}
        for batch in batches:
            for dim, _, x in by_length(batch.column(0)):
                found.setdefault(dim, Scatter(dim)).add(integers(x, scale))
        yield from sent(found)

    def merged(pairs):
        found: dict[int, Scatter] = {}
        for dim, text in pairs:
            found.setdefault(dim, Scatter(dim)).merge(Scatter.unpacked(dim, text))
        return found

    def more(batches):
        yield from sent(merged((d.as_py(), s.as_py()) for b in batches for d, s in zip(b.column(0), b.column(1), strict=True)))

    parts, left = rows.select("v").mapInArrow(tidy(first), "dim int, s string"), rows.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(tidy(more), "dim int, s string")
    return merged((r.dim, r.s) for r in parts.collect())


class Whitener:
    """Mean, components and eigenvalues of a scatter."""

    def __init__(self, s: Scatter, most: int = COMPONENTS):
        s.carry()
        self.n, self.sums = s.n, s.sums
        exact = s.n * s.products - np.outer(s.sums, s.sums)
        trace = int(sum(exact.diagonal()))
        v = exact.astype(np.float64) / float(s.n) ** 2 if s.dim else np.zeros((0, 0))
        values, vectors = np.linalg.eigh(v)
        self.values = values[::-1][:most]
        floor = s.dim * np.finfo(float).eps * max(float(values[-1]), 0.0) if s.dim else 0.0
        self.sound = self.values > floor
        weight = np.zeros(len(self.values))
        weight[self.sound] = 1 / np.sqrt(self.values[self.sound])
        self.weights = vectors[:, ::-1][:, :most] * weight
        total = trace / s.n**2
        self.explained = np.maximum(self.values, 0.0) / total if total else np.zeros(len(self.values))
        # the mean in whole numbers and a fraction, so that large ones cancel first
        self.whole = np.array([x // s.n for x in s.sums], dtype=np.int64)
        self.rest = np.array([(x % s.n) / s.n for x in s.sums], dtype=np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - SHIFT - self.whole).astype(np.float64) - self.rest) @ self.weights

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)² of each row, exactly."""
        z = x - SHIFT
        largest = self.n * (int(np.abs(z).max(initial=0))) + max((abs(int(x)) for x in self.sums), default=0)
        if z.shape[1] * largest**2 < 1 << 63:
            own = self.n * z - self.sums.astype(np.int64)
            return (own * own).sum(axis=1).tolist()
        own = self.n * z.astype(object) - self.sums
        return (own * own).sum(axis=1).tolist()


def whiten(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """``id_col``, n, deviation (decimal), whitened (array of double, by falling
    eigenvalue), explained (array, the same for all rows of a length) and
    identity_error of each usable row."""
    src = written(df.filter(finite(vec)).select(F.col(id_col).alias("_id"), F.col(vec).alias("v")), "vectors")
    models = {dim: Whitener(s, components) for dim, s in scatter(src, scale).items()}
    widths = {dim: len(m.values) for dim, m in models.items()}

    def moments(batches):
        sums = {dim: np.zeros((k + 1, k + 1)) for dim, k in widths.items()}
        for batch in batches:
            for dim, _, x in by_length(batch.column(0)):
                for at in range(0, len(x), ROWS):
                    w = models[dim].whitened(integers(x[at : at + ROWS], scale))
                    w = np.hstack([w, np.ones((len(w), 1))])
                    sums[dim] += w.T @ w
        for dim, s in sums.items():
            k, (i, j) = widths[dim], np.indices(s.shape).reshape(2, -1)
            cols = [np.full((k + 1) ** 2, dim), i, j]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array(s.ravel())], names=["dim", "i", "j", "s"])

    errors = dict.fromkeys(models, 0.0)
    found = {dim: np.zeros((k + 1, k + 1)) for dim, k in widths.items()}
    for r in src.select("v").mapInArrow(tidy(moments), "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
        found[r.dim][r.i, r.j] = r.s
    for dim, s in found.items():
        mean = s[:-1, -1] / models[dim].n
        off = np.abs(s[:-1, :-1] / models[dim].n - np.outer(mean, mean) - np.eye(widths[dim]))
        sound = models[dim].sound
        errors[dim] = float(off[np.ix_(sound, sound)].max(initial=0.0))

    def run(batches):
        for batch in batches:
            for dim, at, x in by_length(batch.column(1)):
                m = models[dim]
                for lo in range(0, len(at), ROWS):
                    own, k = integers(x[lo : lo + ROWS], scale), len(at[lo : lo + ROWS])
                    whitened = pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * widths[dim], m.whitened(own).ravel())
                    explained = pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * widths[dim], np.tile(m.explained, k))
                    deviation = pa.array([str(d) for d in m.deviations(own)], pa.string())
                    cells = [batch.column(0).take(pa.array(at[lo : lo + ROWS])), pa.array(np.full(k, m.n)), deviation, whitened, explained, pa.array(np.full(k, errors[dim]))]
                    yield pa.RecordBatch.from_arrays(cells, names=["_id", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(tidy(run), f"_id {kind}, n bigint, deviation string, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))")).withColumnRenamed("_id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = rows.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
