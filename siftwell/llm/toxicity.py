"""Toxicity by weak supervision.

Voters look at the words of a text. Two are seed lexicons, of insults and of
contempt; two are patterns, pairs of hostile words and an address shortly before
a hit; lexicons of words and of word stems are mined from labelled rows; others
say how many and how dense their hits are, and how loud a text is. A generative
label model with two classes is fitted by EM to the vote patterns of all
documents. It estimates each voter's rates and the voters' correlations within a
class; voters that go together form a clique, whose votes have one joint
distribution in either class, so that what they say together counts once. A
linear classifier is trained on the posterior labels of a bounded sample and
scores every document.

Bounds: ``VOTERS`` yes/no voters make at most ``2 ** VOTERS`` patterns, so the
label model sees all documents through that many counts. A clique holds ``CLIQUE``
voters at most, whose joint table has 2 to that power of cells; further ones count as
independent. A mined entry needs the odds ``LIFT`` and the evidence ``EVIDENCE``, so
what few labelled rows show is not mined: small tables find less. Mining and the
classifier's fit take at most about ``SAMPLE_ROWS`` rows each, chosen by hash. A
mined entry has to occur in a share ``SUPPORT`` of the toxic rows that are no
near copies of each other, so there are at most ``1 / SUPPORT`` times as many
entries as such a row has different words and stems; all of them count.

Defined results: null and empty texts have no votes and are scored; labels
other than 0 and 1, and labels of unknown documents, are left out; without any
label only the seed and surface voters speak; scores do not depend on the id,
language or source; repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textstats
from ._shared import fold, small, spread, table, tidy, written
from .textstats import PREFIXES, Batch

SAMPLE_ROWS = 12_000
VOTERS = 12
FEATURES = 22
#: Least share of toxic rows that carry a mined entry, least odds ratio, and
#: least evidence, twice the logarithm of the likelihood ratio of its rows' labels:
#: about one in ten thousand entries without a bearing has as much.
SUPPORT, LIFT, EVIDENCE = 0.01, 8.0, 16.0
DENSE, LOUD, SHOUTED = 0.005, 0.05, 0.3
#: Words of abuse; seeds only, the mined lexicons go beyond them.
INSULTS = ("idiot", "idiots", "moron", "morons", "loser", "losers", "clown", "imbecile", "fool", "freak")
CONTEMPT = ("stupid", "dumb", "trash", "garbage", "scum", "pathetic", "worthless", "disgusting", "filth", "vermin", "ugly", "hate", "despise")
HOSTILE_PAIRS = (("shut", "up"), ("get", "lost"), ("drop", "dead"), ("you", "suck"), ("hate", "you"))
ADDRESS = ("you", "your", "youre", "tu", "toi", "vous", "du", "dich", "ihr", "usted", "eres")
#: Words between an address and a hit, at most.
NEAR = 4
#: Correlation within a class from which voters are one clique, and voters of
#: one, at most.
TOGETHER, CLIQUE = 0.2, 8
#: Rows that a clique's independent distribution counts for.
SMOOTH = 1.0

U = np.uint64


class Lexicon:
    """Sorted hashes of mined words and stems with their log odds."""

    def __init__(self, rows):
        self.of = {}
        for kind in (0, *PREFIXES):
            own = sorted((np.int64(h).astype(U), w) for k, h, w in rows if k == kind)
            self.of[kind] = (np.array([h for h, _ in own], dtype=U), np.array([w for _, w in own]))
        self.insults, self.contempt, self.address = (np.sort(Batch([" ".join(x)]).words) for x in (INSULTS, CONTEMPT, ADDRESS))
        pairs = Batch([" ".join(x) for x in HOSTILE_PAIRS]).words
        self.pairs = np.sort(_paired(pairs)[::2])

    def hits(self, kind, hashes):
        own, weight = self.of[kind]
        return _lookup(own, weight, hashes)


def _paired(words):
    """A hash for each word and the next."""
    return words[:-1] * U(0x9E3779B97F4A7C15) + words[1:]


def _among(own, hashes):
    return _lookup(own, np.ones(len(own)), hashes) > 0


def _lookup(own, weight, hashes):
    if not len(own) or not len(hashes):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    return np.where(own[at] == hashes, weight[at], 0.0)


def votes_and_features(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Bit patterns of the voters, and the classifier's features."""
    b = Batch(texts)
    n, words = b.n, np.maximum(b.n_words, 1)
    weight = lexicon.hits(0, b.words)
    hit = weight > 0
    insult, contempt = _among(lexicon.insults, b.words), _among(lexicon.contempt, b.words)
    said = insult | contempt
    seed = b.per_word(said)
    v = np.zeros((n, VOTERS), dtype=bool)
    v[:, 0] = b.per_word(insult) > 0
    v[:, 1] = b.per_word(contempt) > 0
    pair, address = np.zeros(len(b.words), dtype=bool), np.zeros(len(b.words), dtype=bool)
    if len(b.words) > 1:
        pair[1:] = _among(lexicon.pairs, _paired(b.words)) & (b.owner[1:] == b.owner[:-1])
        called = _among(lexicon.address, b.words)
        for gap in range(1, min(NEAR, len(b.words) - 1) + 1):
            address[gap:] |= called[:-gap] & (b.owner[gap:] == b.owner[:-gap])
    v[:, 2] = b.per_word(pair) > 0
    v[:, 3] = b.per_word(address & (hit | said)) > 0
    # the mined words without the seeds, which have voters of their own
    v[:, 4] = b.per_word(hit & ~said) > 0
    stems = np.zeros(n)
    stem_weight = np.zeros(n)
    for i, k in enumerate(PREFIXES):
        hashes, owner = b.prefixes(k)
        w = lexicon.hits(k, hashes)
        count = np.bincount(owner, weights=w > 0, minlength=n)
        v[:, 5 + i] = count > 0
        stems += count
        stem_weight += np.bincount(owner, weights=w, minlength=n)
    hits = b.per_word(hit)
    kinds = np.zeros(n)
    if hit.any():
        pairs = np.unique(np.stack([b.owner[hit].astype(U), b.words[hit]]), axis=1)
        kinds = np.bincount(pairs[0].astype(np.int64), minlength=n).astype(float)
    loud = b.per_text(b.kind == textstats.LOUD) / words
    letters = np.maximum(b.per_text(b.kind == textstats.LETTER) + b.per_text(b.kind == textstats.UPPER), 1)
    v[:, 8] = kinds >= 2
    v[:, 9] = (hits + stems / len(PREFIXES)) / words >= DENSE
    v[:, 10] = loud >= LOUD
    v[:, 11] = b.per_text(b.caps) / letters >= SHOUTED
    x = np.zeros((n, FEATURES), dtype=np.float32)
    x[:, :VOTERS] = v
    x[:, 12] = np.log1p(hits)
    x[:, 13] = np.log1p(stems)
    x[:, 14] = np.minimum(hits / words, 0.1) * 20
    x[:, 15] = np.minimum(stems / words, 0.3) * 10
    x[:, 16] = np.log1p(kinds)
    x[:, 17] = np.log1p(b.per_word(weight))
    x[:, 18] = np.log1p(stem_weight)
    x[:, 19] = np.log1p(seed)
    x[:, 20] = np.minimum(loud, 1)
    x[:, 21] = np.log1p(b.n_words) / 10
    return (v @ (1 << np.arange(VOTERS))).astype(np.int64), x


def _emitted(docs: DataFrame, schema: str, names, rows):
    """mapInArrow over (id, label?, text) in bounded batches of texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for i, group in textstats.batches(part.column(part.num_columns - 1).to_pylist()):
                    yield pa.RecordBatch.from_arrays(rows([c.slice(i, len(group)) for c in part.columns[:-1]], group), names=names)

    return docs.mapInArrow(tidy(run), schema)


def _near_copy_keys(b: Batch) -> np.ndarray:
    """Minimum over hashed word pairs: near copies mostly share it."""
    out = np.zeros(b.n, dtype=np.int64)
    ends = np.cumsum(b.n_words)
    for i, (end, n) in enumerate(zip(ends, b.n_words, strict=True)):
        own = b.words[end - n : end]
        if n:
            pairs = own[:-1] * U(0x9E3779B97F4A7C15) + own[1:] if n > 1 else own
            out[i] = (textstats._mix(pairs).min() >> U(1)).astype(np.int64)
    return out


def mine(sample: DataFrame) -> list[tuple[int, int, float]]:
    """(kind, hash, log odds) of words (kind 0) and stems whose presence goes
    with the label; ``sample`` has label, text and at most SAMPLE_ROWS rows."""

    def rows(cols, texts):
        b = Batch(texts)
        ends = np.cumsum(b.n_words)
        kinds, hashes = [[] for _ in texts], [[] for _ in texts]
        stems = [(k, *b.prefixes(k)) for k in PREFIXES]
        for i in range(b.n):
            for k, own in [(0, b.words[ends[i] - b.n_words[i] : ends[i]]), *((k, h[np.searchsorted(o, i) : np.searchsorted(o, i, "right")]) for k, h, o in stems)]:
                u = np.unique(own).view(np.int64)
                hashes[i].append(u)
                kinds[i].append(np.full(len(u), k, dtype=np.int32))
        flat = [np.concatenate(h) if h else np.zeros(0, np.int64) for h in hashes]
        return [cols[0], pa.array(_near_copy_keys(b)), pa.array([x.tolist() for x in flat], pa.list_(pa.int64())), pa.array([np.concatenate(k).tolist() for k in kinds], pa.list_(pa.int32()))]

    src = written(_emitted(sample.select("label", "text"), "label int, key bigint, hashes array<bigint>, kinds array<int>", ["label", "key", "hashes", "kinds"], rows), "toxic-mined")
    n = {r.label: r.n for r in src.groupBy("label").agg(F.countDistinct("key").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return []
    flat = src.select("label", "key", F.explode(F.arrays_zip("kinds", "hashes")).alias("e")).select("label", "key", F.col("e.kinds").alias("kind"), F.col("e.hashes").alias("hash"))
    pos = flat.filter("label = 1").groupBy("kind", "hash").agg(F.countDistinct("key").alias("a")).filter(F.col("a") >= max(3, int(SUPPORT * n1)))
    pos = small(written(pos, "toxic-positive"))
    neg = flat.filter("label = 0").join(pos, ["kind", "hash"], "left_semi").groupBy("kind", "hash").agg(F.count("*").alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (n1 + 1)) / ((F.coalesce("b", F.lit(0)) + 0.5) / (n0 + 1)))
    b = F.coalesce("b", F.lit(0))
    plus = lambda n, own: n * F.log(F.greatest(n, F.lit(1)) / (F.col("a") + b) / (own / (n1 + n0)))
    best = pos.join(neg, ["kind", "hash"], "left").withColumn("odds", odds).withColumn("evidence", 2 * (plus(F.col("a"), n1) + plus(b, n0)))
    best = best.filter((F.col("odds") >= float(np.log(LIFT))) & (F.col("evidence") >= EVIDENCE))
    return [(r.kind, r.hash, r.odds) for r in best.select("kind", "hash", "odds").collect()]


def cliques_of(rho: np.ndarray, least: float = TOGETHER, most: int = CLIQUE) -> list[list[int]]:
    """Voters joined along their strongest correlations, ``most`` at most."""
    own = {j: [j] for j in range(len(rho))}
    pairs = sorted(((-rho[i, j], i, j) for i in range(len(rho)) for j in range(i) if rho[i, j] >= least))
    for _, i, j in pairs:
        if own[i] is not own[j] and len(own[i]) + len(own[j]) <= most:
            both = sorted(own[i] + own[j])
            for x in both:
                own[x] = both
    return sorted({tuple(x) for x in own.values()})


def label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, steps: int = 40):
    """(posterior of class 1 for each vote pattern, rates, correlations within
    the classes, cliques). ``patterns`` (P, VOTERS) of 0/1, ``counts`` over all
    documents, ``known`` (P, 2) counts of learning labels, which hold the classes
    in place. EM with independent voters tells the correlations, and EM with a
    joint distribution of each clique's votes goes on from there."""
    v = patterns.astype(float)
    if known.sum():
        rate = (known.T @ v + 0.5) / (known.sum(axis=0)[:, None] + 1.0)
        prior = (known[:, 1].sum() + 1) / (known.sum() + 2)
    else:
        rate = np.tile([[0.02], [0.4]], (1, v.shape[1]))
        prior = 0.05
    cliques = [(j,) for j in range(v.shape[1])]
    codes = lambda: [patterns[:, c].astype(np.int64) @ (1 << np.arange(len(c))) for c in cliques]
    alone = lambda c, r: np.prod([np.where((np.arange(1 << len(c)) >> i) & 1, r[j], 1 - r[j]) for i, j in enumerate(c)], axis=0)
    at = codes()
    tables = [np.stack([alone(c, rate[y]) for y in (0, 1)]) for c in cliques]
    rho = np.zeros((v.shape[1], v.shape[1]))
    post = np.zeros(len(v))
    for step in range(steps):
        llr = sum(np.log(t[1][k] / t[0][k]) for t, k in zip(tables, at, strict=True))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + llr, -30, 30)))
        weights = np.stack([counts * (1 - post), counts * post], axis=1) + known
        total = weights.sum(axis=0)
        rate = np.clip((weights.T @ v + 0.5) / (total[:, None] + 1.0), 1e-4, 1 - 1e-4)
        prior = float(np.clip(total[1] / total.sum(), 1e-4, 0.5))
        if step == steps // 4:
            for y in (0, 1):
                d = v - rate[y]
                cov = (d * weights[:, y : y + 1]).T @ d / (total[y] + 1.0)
                sd = np.sqrt(rate[y] * (1 - rate[y]))
                rho = np.maximum(rho, np.clip(cov / np.outer(sd, sd), 0, 1))
            np.fill_diagonal(rho, 0)
            cliques = cliques_of(rho)
            at = codes()
        tables = []
        for c, k in zip(cliques, at, strict=True):
            seen = np.stack([np.bincount(k, weights=weights[:, y], minlength=1 << len(c)) for y in (0, 1)])
            tables.append(np.stack([(seen[y] + SMOOTH * alone(c, rate[y])) / (total[y] + SMOOTH) for y in (0, 1)]))
    return post, rate, rho, cliques


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 30) -> np.ndarray:
    """Weights of a linear classifier of soft labels ``y``, constant last."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + penalty * w / 10
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y) + np.diag(penalty / 10)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return w


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, votes for every row of ``docs``; ``labels`` (doc_id,
    label) are the rows to learn from."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = labels.filter("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    known = small(written(_sample(known, known.count(), SAMPLE_ROWS), "toxic-labels"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lexicon = Lexicon(mine(texts.join(known, "doc_id").select("label", "text")))

    def rows(cols, group):
        v, x = votes_and_features(group, lexicon)
        return [cols[0], pa.array(v.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))]

    base = written(_emitted(texts, f"doc_id {kind}, votes int, x array<float>", ["doc_id", "votes", "x"], rows), "toxic-votes")
    total = {r.votes: r.n for r in base.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    seen = np.array(sorted(total), dtype=np.int64)
    bits = (seen[:, None] >> np.arange(VOTERS)) & 1
    at = {int(p): i for i, p in enumerate(seen)}
    held = np.zeros((len(seen), 2))
    for r in base.join(known, "doc_id").groupBy("votes", "label").agg(F.count("*").alias("n")).collect():
        held[at[r.votes], r.label] = r.n
    weights = np.append(np.zeros(FEATURES), -2.0)
    if len(seen):
        post, *_ = label_model(bits, np.array([total[int(p)] for p in seen], dtype=float), held)
        fit = _sample(base, sum(total.values()), SAMPLE_ROWS).select("votes", "x").toPandas()
        if len(fit):
            weights = logistic(np.array(fit.x.tolist(), dtype=float), post[[at[int(p)] for p in fit.votes]])

    def apply(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))), b.column(1)], names=["doc_id", "score", "votes"])

    return base.mapInArrow(tidy(apply), f"doc_id {kind}, score double, votes int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    found = scores(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), labels)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
