"""What can be told of stored tables: which columns are keys."""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a key, at most.
WIDEST = 3


def _plain(kind: str) -> bool:
    return not kind.startswith(("array", "map", "struct", "variant"))


def minimal_keys(df: DataFrame, widest: int = WIDEST) -> DataFrame:
    """columns (array): every set of up to ``widest`` columns in which no two rows
    agree and none of whose parts is one. A column with nulls, or of a kind without
    an order, is in no key. Sets are looked at by size; one is left out if a part of
    it is a key already, or if its columns have too few different values to tell all
    rows apart, which one pass counts; each other costs one grouping, which says
    whether a group has two rows."""
    names = [f.name for f in df.schema if _plain(f.dataType.simpleString())]
    col = {c: F.col(f"`{c}`") for c in names}
    counts = df.agg(F.count("*").alias("n"), *[F.count(col[c]).alias(f"n{i}") for i, c in enumerate(names)], *[F.countDistinct(col[c]).alias(f"d{i}") for i, c in enumerate(names)]).head()
    n = counts["n"]
    values = {c: counts[f"d{i}"] for i, c in enumerate(names) if counts[f"n{i}"] == n}
    found: list[tuple[str, ...]] = []
    for size in range(1, widest + 1):
        for own in combinations(values, size):
            if any(set(k) <= set(own) for k in found) or prod(values[c] for c in own) < n:
                continue
            if size == 1 or not df.groupBy(*(col[c] for c in own)).count().filter("count > 1").head(1):
                found.append(own)
    return df.sparkSession.createDataFrame([(list(k),) for k in found], "columns array<string>")
