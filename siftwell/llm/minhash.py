"""Near-duplicate classes with b-bit MinHash.

1. One pass over the texts hashes every word (64 bits), combines ``width``
   neighbours to a shingle, and takes the minima of ``PERMUTATIONS``
   permutations over the distinct shingles. The low ``BITS`` bits of the minima
   are packed as bit planes; the full minima of each band give its key.
2. Documents with equal shingle sets (128-bit fingerprint) form classes; only
   the smallest id of a class goes on. Groups of copies never meet in a task.
3. Documents that share a band key are candidates. In each bucket every member
   is first held against the bucket's smallest id only. The collision-corrected
   similarity from bit counts of the packed signatures drops pairs that are
   more than five standard errors under the threshold; the rest is confirmed
   on full sets.
4. Connected components of the confirmed links are found. Members that are not
   in their leader's component are then held, on full sets, against all others
   with that leader: members are dealt into blocks of ``BLOCK_SHINGLES`` and
   pairs of blocks are compared in place; a pair of blocks gives no more links
   than it joins components. Members so far from the leader that the triangle
   inequality of the Jaccard distance rules out a link with those linked to it
   meet the others alone. So a bucket of copies costs as many comparisons as it
   has members, and no pair that shares a key and could join two components is
   left out.

A pair at a threshold of 85 percent shares no key with probability
``(1 - 0.85^5)^25`` = 4e-7, one at 80 percent with ``(1 - 0.8^4)^31`` = 8e-8; a
pair under the estimate's margin is lost with less.

Defined results: a null or blank text has no shingles, is linked with nothing
and stays; fewer than ``width`` words are one shingle; repeated rows are copies
of each other; rows without an id link with nothing and have a null class;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import KEY_ROWS, small, spread, spread_join, table, tidy, written
from .graph import components

#: Words of a shingle and least similarity in percent; op9's contract has its own.
WIDTH, PERCENT = 5, 80
PERMUTATIONS, BITS = 125, 4
WORDS = (PERMUTATIONS + 63) // 64
#: Shingles of the members that are held against each other at once.
BLOCK_SHINGLES = 65_536
#: Bytes of text that are taken at once, and half of those that are hashed at once.
BATCH_BYTES = PIECE = 1 << 19

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


@lru_cache(1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(PERMUTATIONS, dtype=U)
    return _mix(seeds * U(0xD1342543DE82EF95) + U(1)) | U(1), _mix(seeds * U(0x9E3779B97F4A7C15) + U(77))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes ``begin`` to ``end``, which follow one another,
    in pieces of bounded size; a run that is longer is summed up piece by piece."""
    out = np.empty(len(begin), dtype=U)
    power, inverse, value = _powers(_BASE, 2 * PIECE), _powers(_INVERSE, 2 * PIECE), _byte_values()
    i = 0
    while i < len(begin):
        lo = int(begin[i])
        j = int(np.searchsorted(end, lo + 2 * PIECE, side="right"))
        if j <= i:
            parts = [(a, data[a : min(a + PIECE, int(end[i]))]) for a in range(lo, int(end[i]), PIECE)]
            out[i] = sum(int((value[p] * power[: len(p)]).sum(dtype=U)) * pow(_BASE, a - lo, 1 << 64) for a, p in parts) % (1 << 64)
            i += 1
            continue
        own = data[lo : int(end[j - 1])]
        total = np.zeros(len(own) + 1, dtype=U)
        np.cumsum(value[own] * power[: len(own)], out=total[1:])
        b, e = begin[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[b]) * inverse[b]
        i = j
    return _mix(out + (end - begin).astype(U))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's number of words."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data)
    edge = np.diff(np.concatenate([[True], _SPACE[data]]).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return run_hashes(data, begin, end), np.diff(np.searchsorted(begin, ends, side="left"), prepend=0)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    n = len(words)
    runs = words.copy()
    whole = [words]
    for k in range(1, width):
        nxt = np.zeros(n, dtype=U)
        if k < n:
            nxt[: n - k] = words[k:]
        runs = _mix(runs * U(0xD6E8FEB86659FD93) + nxt)
        whole.append(runs)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(runs[at : at + c - width + 1]))
        elif c:
            out.append(_mix(whole[c - 1][at : at + 1] + U(c)))
        else:
            out.append(np.zeros(0, dtype=U))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima under each permutation, one row per (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    a, b = _factors()
    out = np.empty((len(sets), PERMUTATIONS), dtype=U)
    for k in range(PERMUTATIONS):
        out[:, k] = np.minimum.reduceat((flat ^ b[k]) * a[k], starts)
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """Bit planes of the low bits of the (mixed) minima: BITS * WORDS words."""
    low = _mix(minima)
    pad = np.zeros((len(low), WORDS * 64 - PERMUTATIONS), dtype=U)
    planes = [np.packbits(np.hstack([(low >> U(j)) & U(1), pad]).astype(np.uint8), axis=1).view(np.int64) for j in range(BITS)]
    return np.hstack(planes)


def rows_of_band(percent: int) -> int:
    """Minima per band: few enough that no pair at the threshold is lost."""
    return 5 if percent >= 85 else 4


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    bands = PERMUTATIONS // rows
    keys = np.empty((len(minima), bands), dtype=U)
    for b in range(bands):
        h = np.full(len(minima), b + 1, dtype=U)
        for r in range(rows):
            h = _mix(h * U(0x9FB21C651E98DF25) + minima[:, b * rows + r])
        keys[:, b] = h
    return keys.view(np.int64)


def _groups(texts: list[str | None]):
    """(start, UTF-8 texts) of at most BATCH_BYTES, or one longer text."""
    at, group, size = 0, [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if group and size + len(data) > BATCH_BYTES:
            yield at, group
            at, group, size = i, [], 0
        group.append(data)
        size += len(data)
    if group:
        yield at, group


def sketch(docs: DataFrame, width: int = WIDTH, rows: int = rows_of_band(PERCENT)) -> DataFrame:
    """doc_id, n_shingles, fp (of the set; null without one), sig, bands."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for i, group in _groups(part.column(1).to_pylist()):
                    sets = shingle_sets(group, width)
                    full = [k for k, s in enumerate(sets) if len(s)]
                    fp, sig, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                    if full:
                        minima = signatures([sets[k] for k in full])
                        for k, p, q in zip(full, packed(minima).tolist(), band_keys(minima, rows).tolist(), strict=True):
                            fp[k], sig[k], bands[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), p, q
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "sig", "bands"]
                    )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, fp binary, sig array<bigint>, bands array<bigint>")


def estimate(a: str, b: str):
    """Collision-corrected similarity from the bit counts of two signatures."""
    differs = " + ".join("bit_count(" + " | ".join(f"({a}[{j * WORDS + w}] ^ {b}[{j * WORDS + w}])" for j in range(BITS)) + ")" for w in range(WORDS))
    c = 2.0**-BITS
    return F.expr(f"((1 - ({differs}) / {PERMUTATIONS}D) - {c}D) / {1 - c}D")


def least_estimate(threshold: float) -> float:
    """Five standard errors of the estimate under the threshold."""
    c = 2.0**-BITS
    p = c + (1 - c) * threshold
    return threshold - 5 * (p * (1 - p) / PERMUTATIONS) ** 0.5 / (1 - c)


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (u, v) of the written ``pairs`` whose full sets are as similar as
    asked. Each u is sent once per pair to where v's set is; a v with many
    partners is sent to several places."""
    salts = written(pairs.groupBy("v").agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("n_salts")), "minhash-salts")
    member = spread_join(pairs, salts, "v", "u").select(F.col("u").alias("doc_id"), F.col("v").alias("hub"), F.pmod(F.xxhash64("u"), F.col("n_salts")).cast("int").alias("salt"), F.lit(1).alias("part"))
    hub = salts.select(F.col("v").alias("doc_id"), F.col("v").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), F.lit(0).alias("part"))
    roles = small(written(member.unionByName(hub), "minhash-roles"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(roles, "doc_id").select("hub", "salt", "part", "doc_id", "text")

    def to_sets(batches):
        last, held = None, b""
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                out = []
                for text in piece.column(4).to_pylist():
                    if text != last:
                        last, held = text, shingle_sets([(text or "").encode("utf-8", "surrogatepass")], width)[0].tobytes()
                    out.append(held)
                yield pa.RecordBatch.from_arrays([*piece.columns[:4], pa.array(out, pa.binary())], names=["hub", "salt", "part", "doc_id", "set"])

    def compare(batches):
        key, own = None, np.zeros(0, dtype=U)
        for batch in batches:
            us, vs = [], []
            for h, s, p, d, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                h, s, d = h.as_py(), s.as_py(), d.as_py()
                found = np.frombuffer(data.as_py(), dtype=U)
                if p.as_py() == 0:
                    key, own = (h, s), found
                elif key == (h, s):
                    if min(len(own), len(found)) * 100 < percent * max(len(own), len(found)):
                        continue
                    at = np.searchsorted(own, found)
                    same = int((own[np.minimum(at, len(own) - 1)] == found).sum()) if len(own) else 0
                    if same and 100 * same >= percent * (len(own) + len(found) - same):
                        us.append(d)
                        vs.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    sets = rows.mapInArrow(tidy(to_sets), "hub bigint, salt int, part int, doc_id bigint, set binary")
    return sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "part").mapInArrow(tidy(compare), "u bigint, v bigint").distinct()


def _tile_links(rest, others, percent: int):
    """Links between ``rest`` (id, root, far, set) and ``others`` (id, root,
    direct, set) that join different components, one for each join at most. A
    far member cannot be linked to one that is linked to the leader itself."""
    flat = np.concatenate([x[3] for x in others])
    owner = np.repeat(np.arange(len(others)), [len(x[3]) for x in others])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(x[3]) for x in others])
    up: dict[int, int] = {}

    def top(r):
        while up.get(r, r) != r:
            r = up[r]
        return r

    for u, root, far, own in rest:
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(others))
        for k in np.flatnonzero((same > 0) & (100 * same >= percent * (len(own) + sizes - same))):
            v, other, direct, _ = others[k]
            if v == u or (far and direct):
                continue
            x, y = top(root), top(other)
            if x != y:
                up[max(x, y)] = min(x, y)
                yield u, v


def _rest_links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of members outside their leader's component with others that share
    the leader: ``members`` has leader, doc_id, root, rest, far, direct,
    n_shingles."""
    whole = members.groupBy("leader").agg(F.sum("n_shingles").alias("weight"), F.count_if("rest").alias("n_rest"), F.count_if(F.col("rest") & ~F.col("far")).alias("n_near"), F.count_if(~F.col("direct")).alias("n_loose"))
    hard = whole.filter("n_near > 0 or (n_rest > 0 and n_loose > 1)").select("leader", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int").alias("n_blocks"))
    members = spread_join(members, written(hard, "minhash-hard"), "leader", "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    members = small(written(members.select("leader", "block", "n_blocks", "doc_id", "root", "rest", "far", "direct"), "minhash-members"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(members, "doc_id").select("leader", "block", "n_blocks", "doc_id", "root", "rest", "far", "direct", "text")
    names = ["leader", "block", "n_blocks", "doc_id", "root", "rest", "far", "direct", "set"]

    def to_sets(batches):
        last, held = None, b""
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                out = []
                for text in piece.column(8).to_pylist():
                    if text != last:
                        last, held = text, shingle_sets([(text or "").encode("utf-8", "surrogatepass")], width)[0].tobytes()
                    out.append(held)
                yield pa.RecordBatch.from_arrays([*piece.columns[:8], pa.array(out, pa.binary())], names=names)

    sets = rows.mapInArrow(tidy(to_sets), "leader bigint, block int, n_blocks int, doc_id bigint, root bigint, rest boolean, far boolean, direct boolean, set binary")
    blocks = sets.groupBy("leader", "block", "n_blocks").agg(F.collect_list(F.struct("doc_id", "root", "rest", "far", "direct", "set")).alias("items"))
    blocks = written(blocks, "minhash-blocks")
    left = blocks.select("leader", F.expr("filter(items, x -> x.rest)").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).filter("size(a) > 0")
    tiles = left.join(blocks.select("leader", F.col("block").alias("other"), F.col("items").alias("b")), ["leader", "other"]).select("a", "b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].as_py() for k in (0, 1))
                rest = [(x["doc_id"], x["root"], x["far"], np.frombuffer(x["set"], dtype=U)) for x in a]
                found = list(_tile_links(rest, [(x["doc_id"], x["root"], x["direct"], np.frombuffer(x["set"], dtype=U)) for x in b], percent))
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["u", "v"])

    return tiles.mapInArrow(tidy(run), "u bigint, v bigint")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id,
    text). ``percent`` is the least similarity, from 80 on."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 80 percent or more")
    least = least_estimate(percent / 100)
    base = written(sketch(docs, width, rows_of_band(percent)), "minhash-sketch")
    # only sets that occur twice need a representative that is not the row itself
    again = base.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    again = written(again.filter("n > 1").select("fp", "rep"), "minhash-copies")
    assigned = spread_join(base.select("doc_id", "n_shingles", "fp"), again, "fp", "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    assigned = written(assigned, "minhash-classes")
    reps = spread_join(base.filter("fp is not null and doc_id is not null"), again, "fp", "doc_id", "left").filter("rep is null or rep = doc_id")
    reps = written(reps.select("doc_id", "n_shingles", "sig", "bands"), "minhash-reps")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(buckets.select("key", "leader"), "minhash-buckets")
    # a bucket may hold a third of all rows, and so may the members of a leader
    star = spread_join(keyed, buckets, "key", "doc_id").filter("doc_id <> leader").select("doc_id", "leader").distinct()
    sigs = reps.select("doc_id", "n_shingles", "sig")
    star = written(star.join(sigs, "doc_id"), "minhash-members-of")
    leaders = written(sigs.join(buckets.select(F.col("leader").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("leader"), F.col("sig").alias("sig2")), "minhash-leaders")
    star = spread_join(star, leaders, "leader", "doc_id")
    star = written(star.select("doc_id", "leader", "n_shingles", estimate("sig", "sig2").alias("near")), "minhash-star")
    pairs = written(star.filter(F.col("near") >= least).select(F.col("doc_id").alias("u"), F.col("leader").alias("v")), "minhash-pairs")
    links = written(confirm(docs, pairs, width, percent), "minhash-links")
    roots = components(links)

    def named(df, col, out):
        return spread_join(df, roots.select(F.col("node").alias(col), F.col("root").alias("_r")), col, "doc_id", "left").withColumn(out, F.coalesce("_r", col)).drop("_r")

    members = named(named(star, "leader", "leader_root"), "doc_id", "root").withColumn("rest", F.col("root") != F.col("leader_root"))
    # by the triangle inequality of the Jaccard distance, with the estimate's margin
    far = least_estimate(2 * percent / 100 - 1)
    direct = links.select(F.col("u").alias("doc_id"), F.col("v").alias("leader"), F.lit(True).alias("_d"))
    members = members.withColumn("far", F.col("rest") & (F.col("near") < far)).join(direct, ["doc_id", "leader"], "left").withColumn("direct", F.coalesce("_d", F.lit(False))).drop("_d")
    members = written(members, "minhash-judged")
    more = written(_rest_links(docs, members, width, percent), "minhash-rest")
    if more.head(1):
        roots = components(links.unionByName(more))
    roots = written(roots.select(F.col("node").alias("rep"), "root"), "minhash-components")
    return spread_join(assigned, roots, "rep", "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), width=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = {
    "op9_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
}
