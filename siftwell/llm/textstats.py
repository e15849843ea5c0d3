"""Vectorised counts over batches of UTF-8 texts, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .minhash import _BASE, _byte_values, _mix, _powers, run_hashes

U = np.uint64
BATCH_BYTES = 1 << 19
PREFIXES = (4, 5, 6)

#: Classes of bytes: letters are ASCII letters and all beyond ASCII.
_KIND = np.zeros(256, dtype=np.uint8)
LETTER, UPPER, DIGIT, SPACE, STOP, LOUD, SYMBOL, OTHER = 1, 2, 3, 4, 5, 6, 7, 8
_KIND[:] = OTHER
_KIND[128:] = LETTER
_KIND[ord("a") : ord("z") + 1] = LETTER
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[[ord(c) for c in ".,;:'\"-"]] = STOP
_KIND[[ord(c) for c in "!?"]] = LOUD
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~()"]] = SYMBOL


class Batch:
    """Words and byte classes of several texts at once. Words are runs of
    letters and digits, hashed over lower-cased text."""

    def __init__(self, texts: list[str], marks: str = ""):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in raw])
        self.starts = self.ends - np.array([len(t) + 1 for t in raw])
        self.sizes = self.ends - self.starts - 1
        self.kind = _KIND[self.data]
        low = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8).copy()
        up = self.kind == UPPER
        low[up] += 32
        # the second byte of Latin-1 capitals in UTF-8
        second = np.zeros(len(low), dtype=bool)
        second[1:] = (self.data[:-1] == 0xC3) & (self.data[1:] >= 0x80) & (self.data[1:] <= 0x9E) & (self.data[1:] != 0x97)
        low[second] += 32
        self.caps = up | second
        word = (self.kind == LETTER) | up | (self.kind == DIGIT)
        edge = np.diff(np.concatenate([[False], word]).view(np.int8))
        self.begin = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.low = low
        self.words = run_hashes(low, self.begin, self.end)
        self.n_words = np.diff(np.searchsorted(self.begin, self.ends), prepend=0)
        self.owner = np.repeat(np.arange(self.n), self.n_words)
        self.lengths = self.end - self.begin

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first k bytes of words longer than that, and owners."""
        long = self.lengths > k
        at, power = self.begin[long], _powers(_BASE, 1 << 20)
        found = sum((_byte_values()[self.low[at + i]] * power[i] for i in range(k)), np.zeros(len(at), dtype=U))
        return _mix(_mix(found + U(k)) ^ U(k * 0x51ED270B)), self.owner[long]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of per-byte values over each text."""
        return np.add.reduceat(flags.astype(np.int64), self.starts)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=values, minlength=self.n)


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of about BATCH_BYTES at a time, or one longer text."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if group and size + len(t) > BATCH_BYTES:
            yield at, group
            at, group, size = i, [], 0
        group.append(t)
        size += len(t)
    if group:
        yield at, group
