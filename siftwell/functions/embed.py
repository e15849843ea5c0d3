"""Embedding of texts: pluggable, with a deterministic feature hash."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hashed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Signed feature hashing of words, unit length; empty texts are zero."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"[a-z0-9]+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            row[h % dim] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(row)
        if norm:
            row /= norm
    return out.tolist()


def embed_udf(embedder: Embedder = hashed):
    """Arrow-batched column function: text -> array<float>."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder(list(texts)), index=texts.index)

    return embed
