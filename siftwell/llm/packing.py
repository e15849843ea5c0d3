"""Packing of documents into sequences by order-preserving dynamic programming.

The documents of a partition, in the order in which they are stored, are one
stream of tokens, each document ended by an id of its own. Windows of at most
``size`` tokens cut the stream, and each becomes a sequence. Windows may be cut
at the end of a document (free), at the end of a sentence (SENTENCE), and, where
neither comes for STEP tokens and near the end of a stream, between any tokens
(TOKEN). A sequence is padded to ``size``, except at a power of two. The cuts
minimise padding plus penalties: with f(j) the least cost of cutting at place
p(j),

    f(j) = penalty(j) + min( min f(i) + size - (p(j) - p(i))  over p(j) - p(i) <= size,
                             min f(i)                         over p(j) - p(i) a power of two )

The first minimum is that of f(i) + p(i) over a sliding window, held in a
monotone queue, so that each place enters and leaves once; the second looks up
to eleven places up. Among equal costs the longest window is taken.

A task holds about HORIZON tokens (or one longer document): the best cut within
the last window's reach is then final, what follows it goes on with the next
tokens. Nothing is shuffled, so a stream is what one task reads; tables in fewer
files than there are cores are first dealt by ranges of ``order``.

Defined results: a null or empty text is a document of its end id alone;
repeated rows and rows without an id are documents each; an empty table has no
pieces; special tokens' strings are their ids; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._shared import SPREAD_BYTES, stored_bytes, table, tidy

SIZE = 2048
#: The id that ends a document.
END = 1
#: What a cut inside a document costs, in tokens of padding.
SENTENCE, TOKEN = 2, 8
#: Tokens without an end of a sentence after which any place will do.
STEP = 32
#: Tokens that a task holds before it settles cuts.
HORIZON = 1 << 19


@lru_cache(2)
def marks(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By id: tokens that end a sentence whatever follows (lines, ideographic
    stops), those that do before white space, and those that begin with it."""
    enc = bpe.load(path)
    hard, soft, blank = (np.zeros(len(enc.size), bool) for _ in range(3))
    for i, t in enc.bytes.items():
        text = t.decode("utf-8", "replace")
        hard[i] = text.endswith(("\n", "。", "！", "？"))
        soft[i] = text.rstrip("\"')]”’»").endswith((".", "!", "?", "…"))
        blank[i] = text[:1].isspace()
    return hard, soft, blank


def sentence_ends(ids: np.ndarray, path: str) -> np.ndarray:
    """Places in ``ids``, a document with its end id, after the end of a
    sentence; none is the end of the document."""
    hard, soft, blank = marks(path)
    at = hard[ids[:-1]] | soft[ids[:-1]] & blank[ids[1:]]
    found = np.flatnonzero(at) + 1
    return found[found < len(ids) - 1]


def filled(places: np.ndarray, costs: np.ndarray, step: int, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """``places`` with others wherever two are more than ``step`` apart."""
    gap = np.diff(places)
    n = (gap - 1) // step
    more = np.repeat(places[:-1], n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    places, costs = np.concatenate([places, more]), np.concatenate([costs, np.full(len(more), cost)])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int) -> tuple[list[float], list[int]]:
    """Least cost of cutting at each place, and the place of the cut before;
    ``places`` begin at 0 and rise by at most ``size``, a power of two."""
    n = len(places)
    pairs_j, pairs_i = [], []
    for k in range(size.bit_length() - 1):
        at = np.searchsorted(places, places - (1 << k))
        hit = np.flatnonzero(places[at] == places - (1 << k))
        pairs_j.append(hit)
        pairs_i.append(at[hit])
    js, order = np.concatenate(pairs_j), np.argsort(np.concatenate(pairs_j), kind="stable")
    exact = np.concatenate(pairs_i)[order].tolist()
    first = np.searchsorted(js[order], np.arange(n + 1)).tolist()
    p, pen = places.tolist(), costs.tolist()
    f, before = [0.0] * n, [0] * n
    queue, keys, head = [0], [float(p[0])], 0
    for j in range(1, n):
        least = p[j] - size
        while p[queue[head]] < least:
            head += 1
        i = queue[head]
        cost = keys[head] + size - p[j]
        for x in exact[first[j] : first[j + 1]]:
            if f[x] < cost:
                cost, i = f[x], x
        cost += pen[j]
        f[j], before[j] = cost, i
        key = cost + p[j]
        while len(queue) > head and keys[-1] > key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    return f, before


class Stream:
    """Documents of one task on their way into sequences."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.serial = path, size, 0
        self.docs: list[list] = []  # number of the row, ids left, ids of the document before these, all its ids
        self.held = 0

    def add(self, row, ids: np.ndarray) -> None:
        self.docs.append([row, ids, 0, len(ids)])
        self.held += len(ids)

    def pieces(self, last: bool):
        """What can be settled: for each piece its row, its ids, where these
        begin in the document, the document's ids, sequence and offset."""
        if not self.docs:
            return
        begins = np.cumsum([0, *(len(d[1]) for d in self.docs)])
        places, costs = [np.zeros(1, np.int64)], [np.zeros(1)]
        for at, (_, ids, _, _) in zip(begins.tolist(), self.docs, strict=False):
            inner = sentence_ends(ids, self.path)
            places += [at + inner, [at + len(ids)]]
            costs += [np.full(len(inner), float(SENTENCE)), [0.0]]
        places, costs = filled(np.concatenate(places), np.concatenate(costs), STEP, TOKEN)
        if last:
            tail = np.searchsorted(places, places[-1] - self.size)
            own = filled(places[tail:], costs[tail:], 1, TOKEN)
            places, costs = np.concatenate([places[:tail], own[0]]), np.concatenate([costs[:tail], own[1]])
        f, before = best_cuts(places, costs, self.size)
        j = len(f) - 1
        if not last:
            near = int(np.searchsorted(places, places[-1] - self.size, "right"))
            j = min(range(near, len(f)), key=lambda x: (f[x], -x))
        cuts = [j]
        while j:
            j = before[j]
            cuts.append(j)
        cuts = places[np.array(cuts[::-1])]
        starts = np.unique(np.concatenate([cuts, begins[begins < cuts[-1]]]))
        window = np.searchsorted(cuts, starts[:-1], "right") - 1
        doc = np.searchsorted(begins, starts[:-1], "right") - 1
        for a, b, w, d in zip(starts[:-1].tolist(), starts[1:].tolist(), window.tolist(), doc.tolist(), strict=True):
            row, ids, done, n = self.docs[d]
            lo = a - int(begins[d])
            yield row, ids[lo : lo + b - a], done + lo, n, self.serial + w, a - int(cuts[w])
        self.serial += len(cuts) - 1
        d = int(np.searchsorted(begins, cuts[-1], "right")) - 1
        self.docs = self.docs[d:]
        if self.docs:
            row, ids, done, n = self.docs[0]
            used = int(cuts[-1] - begins[d])
            self.docs[0] = [row, ids[used:], done + used, n]
        self.held = int(begins[-1] - cuts[-1])


def pack(df: DataFrame, tokenizer: str | None = None, size: int = SIZE, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, end: int = END, horizon: int = HORIZON) -> DataFrame:
    """One row for each piece: the ``keep`` columns of its document, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, and its ``ids``. A
    sequence's pieces follow one another by offset."""
    from pyspark import TaskContext

    if size & (size - 1):
        raise ValueError("the size of sequences has to be a power of two")
    path = tokenizer or bpe.default_tokenizer()
    names = [f"_keep{n}" for n in range(len(keep))]
    src = df.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kinds = [src.schema[n].dataType.simpleString() for n in names]
    plain = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), *(f"{c} bigint" for c in plain), *["ids array<int>"] * ids])

    def run(batches):
        enc, stream, base = bpe.load(path), Stream(path, size), TaskContext.get().partitionId() << 40
        kept, types = [], None

        def settled(last):
            found = list(stream.pieces(last))
            if found:
                rows = [x[0] for x in found]
                cols = [pa.array([r[n] for r in rows], t) for n, t in enumerate(types)]
                numbers = [(start, len(own), zlib.crc32(own.astype("<u4").tobytes()), n, base + s, at) for _, own, start, n, s, at in found]
                cols += [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
                if ids:
                    cols.append(pa.array([own.astype(np.int32) for _, own, *_ in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *plain, *["ids"] * ids])

        for batch in batches:
            types = types or [c.type for c in batch.columns[:-1]]
            kept = [c.to_pylist() for c in batch.columns[:-1]]
            for i in range(batch.num_rows):
                found, _ = enc.encode(batch.column(len(keep))[i].as_py())
                stream.add(tuple(c[i] for c in kept), np.append(found, np.uint32(end)))
                if stream.held >= horizon:
                    yield from settled(False)
        yield from settled(True)

    return src.mapInArrow(tidy(run), schema).toDF(*keep, *plain, *["ids"] * ids)


def in_order(df: DataFrame, by: str) -> DataFrame:
    """A small table in fewer files than there are cores is dealt to them by
    ranges of ``by``; larger tables stay in the order of their files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = stored_bytes(df) <= SPREAD_BYTES and 0 < len(df.inputFiles()) < cores
    return df.repartitionByRange(cores, by).sortWithinPartitions(by) if few else df


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(in_order(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), ids=False)
