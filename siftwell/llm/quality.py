"""Quality classifier: kernel ridge over document statistics.

A pass over the whole texts gives each document a vector of statistics, which
is written. Random Fourier features approximate a Gaussian kernel over the
standardised vectors. Every partition sums its part of the normal equations;
the sums are added up a tree, ``FAN_IN`` at a time, and solved on the driver
(``FEATURES + 1`` squared, whatever the corpus). The equations are kept apart for ``FOLDS`` folds:
a label's own score comes from the solution without its fold, and isotonic
regression over bins of these scores calibrates the model. All labelled rows of
the learning folds are used.

Defined results: null and empty texts have statistics of zero and are scored;
labels other than 0 and 1, and labels of unknown documents, are left out; a
repeated label counts each time; without any label every score is 0.5; scores
do not depend on the id, language or source; extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textstats
from ._shared import fold, spread, table, tidy, written
from .textstats import Batch

FEATURES = 512
FOLDS = 3
RIDGE = 1e-3
#: Rows whose features are held at once, 4 kB each.
ROWS = 512
#: Sums that one task adds.
FAN_IN = 16
#: Words of the run that is looked at for the worst.
RUN = 64
SEED = 20_240
BINS = 400
ACCEPT = 0.7

STATISTICS = 26


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per text."""
    b = Batch(texts)
    size, words = np.maximum(b.sizes, 1), np.maximum(b.n_words, 1)
    kinds = [b.per_text(b.kind == k) for k in (textstats.LETTER, textstats.DIGIT, textstats.SPACE, textstats.STOP, textstats.LOUD, textstats.SYMBOL, textstats.OTHER)]
    letters = np.maximum(kinds[0] + b.per_text(b.kind == textstats.UPPER), 1)
    kinds[2] = kinds[2] - 1  # the closing line end is ours
    out = np.zeros((len(texts), STATISTICS))
    out[:, 0] = np.log1p(b.sizes)
    out[:, 1] = np.log1p(b.n_words)
    for i, k in enumerate(kinds):
        out[:, 2 + i] = np.sqrt(np.maximum(k, 0) / size)
    out[:, 9] = np.sqrt(b.per_text(b.caps) / letters)
    out[:, 10] = b.per_word(b.lengths) / words
    out[:, 11] = np.sqrt(b.per_word(np.square(b.lengths)) / words)
    same = np.zeros(len(b.words), dtype=bool)
    same[1:] = (b.words[1:] == b.words[:-1]) & (b.owner[1:] == b.owner[:-1])
    out[:, 12] = np.sqrt(b.per_word(same) / words)
    whole_caps = np.zeros(len(b.words), dtype=bool)
    if len(b.words):
        caps = np.concatenate([[0], np.cumsum(b.caps)])
        low = np.concatenate([[0], np.cumsum(b.data < 128)])
        plain = low[b.end] - low[b.begin]
        whole_caps = (b.lengths > 1) & (caps[b.end] - caps[b.begin] >= np.maximum(plain, 1))
    out[:, 13] = np.sqrt(b.per_word(whole_caps) / words)
    marked = np.zeros(len(b.words), dtype=bool)
    if len(b.words):
        after = np.minimum(b.end, len(b.kind) - 1)
        marked = b.kind[after] == textstats.SYMBOL
    out[:, 14] = np.sqrt(b.per_word(marked) / words)
    out[:, 15] = np.sqrt(b.per_text(b.data == ord("|")) / words)
    out[:, 16] = np.sqrt(b.per_text(b.data == ord(".")) / words)
    out[:, 17] = np.sqrt(np.maximum(b.per_text(b.data == 10) - 1, 0) / words)
    ends = np.cumsum(b.n_words)
    for i, text in enumerate(texts):
        n = int(b.n_words[i])
        if not n:
            continue
        own = b.words[ends[i] - n : ends[i]]
        kinds_n, counts = np.unique(own, return_counts=True)
        out[i, 18] = np.log(len(kinds_n)) / np.log(n + 1)
        out[i, 19] = np.sqrt(counts.max() / n)
        if n > 3:
            three = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
            out[i, 20] = 1 - len(np.unique(three)) / len(three)
        lines = [x for x in text.split("\n") if x]
        out[i, 21] = 1 - len(set(lines)) / max(1, len(lines))
        out[i, 22] = np.log1p(max(map(len, lines), default=0))
        raw = text.encode("utf-8", "surrogatepass")
        out[i, 23] = len(zlib.compress(raw, 1)) / (len(raw) + 20)
        # the worst run of words: marks, and words said again
        for at, flags in ((24, marked | whole_caps), (25, same)):
            total = np.concatenate([[0], np.cumsum(flags[ends[i] - n : ends[i]])])
            run = min(RUN, n)
            out[i, at] = (total[run:] - total[:-run]).max() / run
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stats: one row per row of ``docs``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for i, group in textstats.batches(part.column(1).to_pylist()):
                    x = statistics(group).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, len(group)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float32()))], names=["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, stats array<float>")


def _matrix(col) -> np.ndarray:
    flat = col.flatten() if not isinstance(col, pa.ChunkedArray) else col.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, STATISTICS)


@lru_cache(1)
def projection() -> tuple[np.ndarray, np.ndarray]:
    """The random directions and phases."""
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS), rng.uniform(0, 2 * np.pi, FEATURES)


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        w, phase = projection()
        z = np.clip((x - self.mean) / self.std, -6, 6) @ w + phase
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = [self.features(x[at : at + ROWS]) @ self.weights for at in range(0, len(x), ROWS)]
        return np.clip(np.interp(np.concatenate(raw) if raw else np.zeros(0), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of the means ``y`` of bins at ``x`` holding ``n``
    labels: pool adjacent violators. Ends of each level, and its value."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi, xi, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1][1] = b[1]
            blocks[-1][2] += b[2]
            blocks[-1][3] += b[3]
    knots, values = [], []
    for lo, hi, s, c in blocks:
        for at in dict.fromkeys((lo, hi)):
            knots.append(at)
            values.append(s / c)
    return np.array(knots), np.array(values)


def _summed(parts: DataFrame, n: int) -> np.ndarray:
    """Add the packed sums of partitions, FAN_IN at a time, the last few on the
    driver."""

    def add(batches):
        total = np.zeros(n)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    left = parts.rdd.getNumPartitions()
    while left > 2:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(tidy(add), "s binary")
    rows = parts.collect()
    return np.sum([np.frombuffer(r.s, np.float64) for r in rows], axis=0) if rows else np.zeros(n)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """``stats`` as written by measure(); ``labels`` (doc_id, label 0/1)."""
    rows = stats.join(labels.filter("label in (0, 1)").select("doc_id", F.col("label").cast("double").alias("label")), "doc_id")
    rows = written(rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), "label", "stats"), "quality-labelled")
    m = FEATURES + 1

    def moments(batches):
        total = np.zeros(1 + 2 * STATISTICS)
        for b in batches:
            x = _matrix(b.column(0))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    t = _summed(rows.select("stats").mapInArrow(tidy(moments), "s binary"), 1 + 2 * STATISTICS)
    if t[0] == 0:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.zeros(1), np.zeros(1))
    mean = t[1 : 1 + STATISTICS] / t[0]
    std = np.sqrt(np.maximum(t[1 + STATISTICS :] / t[0] - mean**2, 1e-6))
    model = Model(mean, std, None, np.zeros(1), np.zeros(1))

    def equations(batches):
        a = np.zeros((FOLDS, m, m + 1))
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = _matrix(b.column(2))
            for at in range(0, len(y), ROWS):
                z = np.hstack([model.features(x[at : at + ROWS]), y[at : at + ROWS, None]])
                for k in range(FOLDS):
                    own = z[f[at : at + ROWS] == k]
                    a[k] += own[:, :m].T @ own
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["s"])

    sums = _summed(rows.mapInArrow(tidy(equations), "s binary"), FOLDS * m * (m + 1)).reshape(FOLDS, m, m + 1)

    def solve(s):
        count = s[m - 1, m - 1]
        return np.linalg.solve(s[:, :m] + RIDGE * max(count, 1) * np.eye(m), s[:, m])

    total = sums.sum(axis=0)
    outside = np.array([solve(total - s) for s in sums])

    def binned(batches):
        n, s = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = _matrix(b.column(2))
            parts = [(model.features(x[at : at + ROWS]) * outside[f[at : at + ROWS]]).sum(axis=1) for at in range(0, len(y), ROWS)]
            raw = np.concatenate(parts) if parts else np.zeros(0)
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, weights=y, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([n, s]).tobytes()], pa.binary())], names=["s"])

    t = _summed(rows.mapInArrow(tidy(binned), "s binary"), 2 * BINS)
    n, s = t[:BINS], t[BINS:]
    x = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    knots, values = isotonic(x[n > 0], s[n > 0] / n[n > 0], n[n > 0])
    return Model(mean, std, solve(total), knots, values)


def apply(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "stats").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for every row of ``docs``, learnt from ``labels``."""
    stats = written(measure(docs), "quality-stats")
    return apply(stats, fit(stats, labels))


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold: crc32(doc_id) mod 4 is not 2."""
    return labels.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), learning_labels(table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
