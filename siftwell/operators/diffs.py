"""What commits change, worked out from the contents of their files.

A commit's tree is held against its first parent's: files of one path with other
contents are modified, the rest are added or deleted. A deleted and an added file
that are alike are one renamed file: of equal contents first, in the order of their
paths, then of lines that make up a share ALIKE of the larger file, the most alike
first. Lines are what lies between line feeds, and a modified file's insertions and
deletions are those of a shortest edit.

Files that may be alike are found by their lines, not by holding each against each: a
pair that shares so much shares one of the rarest lines that make up more than
1 - ALIKE of either file, so only these meet in a join. The greedy choice is made in
rounds, in each of which the pairs that are the best of both their files are taken.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Share of the larger file's bytes, in percent, from which files are alike.
ALIKE = 60


def shortest_edit(old: list, new: list) -> tuple[int, int]:
    """(insertions, deletions) of a shortest edit of a list into another: what a
    longest common subsequence leaves. Its length is counted in the bits of whole
    numbers, a bit for each old element."""
    a, b = 0, min(len(old), len(new))
    while a < b and old[a] == new[a]:
        a += 1
    z = 0
    while z < b - a and old[-1 - z] == new[-1 - z]:
        z += 1
    old, new = old[a : len(old) - z], new[a : len(new) - z]
    places: dict = {}
    for i, x in enumerate(old):
        places[x] = places.get(x, 0) | 1 << i
    every = free = (1 << len(old)) - 1
    for x in new:
        met = free & places.get(x, 0)
        free = (free + met | free - met) & every
    common = len(old) - free.bit_count()
    return len(new) - common, len(old) - common


def _lines(content):
    """Lines of a text; a line feed at its end begins none."""
    parts = F.split(content, "\n")
    return F.when(content == "", F.array().cast("array<string>")).when(content.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def changes(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """repository_id, commit_hash, kind (ADD, DELETE, MODIFY, RENAME), path,
    old_path, old, new (contents) of what each commit that is no merge changes.
    ``versions``: repository_id, commit_hash, path, content, the whole tree of
    each commit; ``commits``: repository_id, commit_hash, parents (array)."""
    keys = ["repository_id", "commit_hash"]
    own = commits.filter(F.size("parents") <= 1).select(*keys, F.get("parents", F.lit(0)).alias("parent"))
    tree = versions.select(*keys, "path", F.coalesce("content", F.lit("")).alias("content"))
    new = tree.join(own, keys).select(*keys, "path", F.col("content").alias("new"))
    old = tree.withColumnRenamed("commit_hash", "parent").join(own, ["repository_id", "parent"]).select(*keys, "path", F.col("content").alias("old"))
    both = stored(new.join(old, [*keys, "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new"))))
    added, gone = both.filter("old is null").drop("old"), both.filter("new is null").drop("new").withColumnRenamed("path", "old_path")
    renamed = stored(_renames(added, gone))
    known = renamed.select(*keys, "path", "old_path")
    plain = lambda df, kind: df.withColumn("kind", F.lit(kind))
    out = plain(both.filter("old is not null and new is not null").withColumn("old_path", F.col("path")), "MODIFY")
    out = out.unionByName(plain(added.join(known, [*keys, "path"], "left_anti").withColumn("old", F.lit("")), "ADD"), allowMissingColumns=True)
    rest = gone.join(known, [*keys, "old_path"], "left_anti").withColumns({"path": F.col("old_path"), "new": F.lit("")})
    out = out.unionByName(plain(rest, "DELETE")).unionByName(plain(renamed, "RENAME"))
    return out.select(*keys, "kind", "path", "old_path", "old", "new")


def _renames(added: DataFrame, gone: DataFrame) -> DataFrame:
    """repository_id, commit_hash, path, old_path, new, old."""
    keys = ["repository_id", "commit_hash"]
    mark = F.sha2("content", 256).alias("sha")
    nth = lambda path: F.row_number().over(Window.partitionBy(*keys, "sha").orderBy(path)).alias("nth")
    a = added.withColumnRenamed("new", "content").select(*keys, "path", "content", mark)
    g = gone.withColumnRenamed("old", "content").select(*keys, "old_path", "content", mark)
    same = a.select(*keys, "path", "sha", nth("path")).join(g.select(*keys, "old_path", "sha", nth("old_path")), [*keys, "sha", "nth"]).select(*keys, "path", "old_path")
    same = stored(same)
    # commits that leave both sides something
    a, g = a.join(same, [*keys, "path"], "left_anti"), g.join(same, [*keys, "old_path"], "left_anti")
    chosen = same.unionByName(_alike(a, g))
    return chosen.join(added, [*keys, "path"]).join(gone, [*keys, "old_path"])


def _alike(added: DataFrame, gone: DataFrame) -> DataFrame:
    keys = ["repository_id", "commit_hash"]
    files = added.select(*keys, F.lit("a").alias("side"), F.col("path").alias("file"), "content").unionByName(gone.select(*keys, F.lit("g").alias("side"), F.col("old_path").alias("file"), "content"))
    two = files.groupBy(*keys).agg(F.countDistinct("side").alias("n")).filter("n = 2").select(*keys)
    line = files.join(two, keys).select(*keys, "side", "file", F.explode(_lines(F.col("content"))).alias("line"))
    # what a line weighs in a file: its bytes with the line feed, as often as it is there
    line = line.groupBy(*keys, "side", "file", F.xxhash64("line").alias("h")).agg(F.sum(F.octet_length("line") + 1).alias("w"))
    line = stored(line)
    often = line.groupBy(*keys, "h").agg(F.count("*").alias("often"), F.countDistinct("side").alias("n"))
    by = Window.partitionBy(*keys, "side", "file")
    ranked = line.join(often, [*keys, "h"]).withColumn("size", F.sum("w").over(by)).withColumn("before", F.sum("w").over(by.orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)))
    rare = stored(ranked.filter((F.col("n") == 2) & (F.coalesce("before", F.lit(0)) * 100 <= (100 - ALIKE) * F.col("size"))).select(*keys, "side", "file", "h"))
    size = line.groupBy(*keys, "side", "file").agg(F.sum("w").alias("size"))
    sides = lambda df, **names: (df.filter("side = 'a'").drop("side").withColumnsRenamed({"file": "path"} | {c: f"a_{c}" for c in names}), df.filter("side = 'g'").drop("side").withColumnsRenamed({"file": "old_path"} | {c: f"g_{c}" for c in names}))
    x, y = sides(rare)
    pairs = stored(x.join(y, [*keys, "h"]).select(*keys, "path", "old_path").distinct())
    x, y = sides(line, w=1)
    shared = pairs.join(x, [*keys, "path"]).join(y, [*keys, "old_path", "h"]).groupBy(*keys, "path", "old_path").agg(F.sum(F.least("a_w", "g_w")).alias("common"))
    x, y = sides(size, size=1)
    score = F.col("common") * 100 / F.greatest("a_size", "g_size")
    left = stored(shared.join(x, [*keys, "path"]).join(y, [*keys, "old_path"]).withColumn("score", score).filter(F.col("score") >= ALIKE).select(*keys, "path", "old_path", "score"))
    chosen = None
    while left.head(1):
        best = F.struct(-F.col("score"), "path", "old_path")
        for_new, for_old = (F.min(best).over(Window.partitionBy(*keys, c)) for c in ("path", "old_path"))
        taken = stored(left.withColumns({"_n": for_new, "_o": for_old}).filter(best.eqNullSafe(F.col("_n")) & best.eqNullSafe(F.col("_o"))).select(*keys, "path", "old_path"))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = stored(left.join(taken, [*keys, "path"], "left_anti").join(taken, [*keys, "old_path"], "left_anti"))
    return left.select(*keys, "path", "old_path") if chosen is None else chosen


def edits(changed: DataFrame) -> DataFrame:
    """changes() with insertions and deletions instead of the contents."""
    kept = ["repository_id", "commit_hash", "kind", "path", "old_path"]
    lined = changed.select(*kept, _lines(F.col("old")).alias("old"), _lines(F.col("new")).alias("new"))

    def run(batches):
        for b in batches:
            found = [shortest_edit(o.as_py(), n.as_py()) for o, n in zip(b.column(len(kept)), b.column(len(kept) + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))], names=[*kept, "insertions", "deletions"])

    kinds = ", ".join(f"{c} {lined.schema[c].dataType.simpleString()}" for c in kept)
    return lined.mapInArrow(run, f"{kinds}, insertions bigint, deletions bigint")


def stats(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """repository_id, commit_hash, files_changed, insertions, deletions of every
    commit; merges, and commits that change nothing, have 0."""
    keys = ["repository_id", "commit_hash"]
    found = edits(changes(versions, commits)).groupBy(*keys).agg(F.count("*").alias("f"), F.sum("insertions").alias("i"), F.sum("deletions").alias("d"))
    out = commits.select(*keys).join(found, keys, "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).cast("int").alias(n) for c, n in (("f", "files_changed"), ("i", "insertions"), ("d", "deletions"))))
