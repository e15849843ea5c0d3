"""Vector codes and whitening against plain versions in exact numbers."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import vectorcode, whitening

from ..conftest import SF

KIND = "vec_id bigint, embedding array<float>, label int"
INF = float("inf")


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and isfinite(x) for x in r[1])]


def awkward(rng, dim=8, n=60):
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dim) * rng.choice([0.01, 1, 30])], int(rng.integers(3))) for i in rng.permutation(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * (dim - 1) + [None], 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [INF] + [0.0] * (dim - 1), 1), (None, [0.5] * dim, None), (5, [0.0] * dim, None), (5, [-0.001] * dim, 7)]
    return rows + [rows[0], rows[0], rows[3]]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, KIND).repartition(parts)
    for c in ("v", "code", "error", "dim", "n", "_key", "id", "whitened", "deviation"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def plain_codes(rows, entries, rounds):
    rows = usable(rows)
    xs = [[floor(1024 * x) for x in v] for _, v, _ in rows]
    dim = len(xs[0])
    cut = [i * dim // 4 for i in range(5)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[xs[i][a:b] for i in first] for a, b in zip(cut, cut[1:], strict=False)]

    def assigned():
        out = []
        for x in xs:
            own = []
            for p, book in enumerate(books):
                d = [sum((a - b) ** 2 for a, b in zip(x[cut[p] : cut[p + 1]], c, strict=True)) for c in book]
                own.append((d.index(min(d)), min(d)))
            out.append(own)
        return out

    for _ in range(rounds):
        found = assigned()
        for p, book in enumerate(books):
            for k in range(len(book)):
                own = [x[cut[p] : cut[p + 1]] for x, a in zip(xs, found, strict=True) if a[p][0] == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assigned()
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    by_label = defaultdict(int)
    for (_, _, label), a in zip(rows, found, strict=True):
        by_label[label] += sum(d for _, d in a)
    return sorted(((i, "".join(f"{k:02x}" for k, _ in a), sum(d for _, d in a), by_label[label], digest) for (i, _, label), a in zip(rows, found, strict=True)), key=repr)


@pytest.mark.parametrize("dim,n", [(8, 60), (7, 12), (2, 40), (16, 300)])
def test_codes_against_brute_force(spark, monkeypatch, dim, n):
    monkeypatch.setattr(vectorcode, "BLOCK", 16)
    rows = awkward(np.random.default_rng(dim), dim, n)
    coded, _ = vectorcode.codes(frame(spark, rows), keep=("label",))
    got = vectorcode.with_sums(coded, "label", "label_error").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, 256, 4)


def test_codes_of_lengths_apart_and_none(spark):
    rng = np.random.default_rng(1)
    rows, other = awkward(rng, 8, 30), [(i, [float(i)] * 4, 0) for i in range(5)]
    coded, books = vectorcode.codes(frame(spark, rows + other + [(9, [], 0)]))
    assert set(books) == {8, 4, 0} and coded.count() == len(usable(rows)) + 6
    assert {r.error for r in coded.filter("vec_id < 5 and error = 0").collect()} == {0}
    want = {(i, c, e, d) for i, c, e, _, d in plain_codes(rows, 256, 4)}
    assert want <= {(r.vec_id, r.code, r.error, r.codebooks_sha256) for r in coded.collect()}
    assert vectorcode.codes(spark.createDataFrame([], KIND))[0].count() == 0


def test_codes_of_extreme_numbers(spark):
    rows = [(i, [x, -x, x / 3, 1.0], 0) for i, x in enumerate([3e38, 1e30, 1e9, 1e5, 1e4, 0.0])]
    got = vectorcode.codes(spark.createDataFrame(rows, KIND))[0].collect()
    assert len(got) == 6 and all(r.error >= 0 for r in got)
    limit = vectorcode.most(4)
    held = [(i, [min(max(x, -limit / 1024), limit / 1024) for x in v], label) for i, v, label in usable([tuple(r) for r in spark.createDataFrame(rows, KIND).collect()])]
    assert sorted((r.vec_id, r.code) for r in got) == sorted((i, c) for i, c, *_ in plain_codes(held, 256, 4))


@pytest.mark.parametrize("large", [50, 1 << 27])
def test_annulus_holds_the_nearest(large):
    rng = np.random.default_rng(2)
    scales = np.array([[1.0], [0.1], [0.01]])[rng.integers(3, size=400)]
    x = (rng.normal(size=(400, 5)) * scales * large / 4).astype(np.int64)
    book = np.concatenate([x[:50], x[:20], x[7:9] + 1])
    code, error, pairs = vectorcode.Codebook(book).nearest(x)
    d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert error.tolist() == d.min(axis=1).tolist() and code.tolist() == [int(np.argmin(r.astype(float) if large == 50 else r)) for r in d]
    assert pairs < 0.7 * d.size


def plain_whitening(rows, components):
    rows = usable(rows)
    xs = np.array([[floor(64 * float(x)) + 1_000_000 for x in v] for _, v, _ in rows], dtype=object)
    n, s = len(xs), xs.sum(axis=0)
    c = n * xs - s
    v = np.array([[float(Fraction(int(x), n**3)) for x in r] for r in c.T @ c])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    centred = np.array([[float(Fraction(int(x), n)) for x in r] for r in c])
    return rows, n, (c * c).sum(axis=1).tolist(), centred @ vectors / np.sqrt(values), values / np.trace(v)


def same_up_to_sign(got, want):
    sign = np.sign((got * want).sum(axis=0))
    return np.allclose(got, want * sign, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("dim,n", [(6, 40), (40, 200), (1, 9)])
def test_whitening_against_plain_fractions(spark, dim, n):
    source = awkward(np.random.default_rng(dim), dim, n)
    df = frame(spark, source, 5)
    rows, count, deviations, whitened, explained = plain_whitening(source, 32)
    want = sorted(zip([r[0] for r in rows], deviations, whitened.tolist(), strict=True), key=lambda r: (repr(r[0]), r[1]))
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (repr(r.vec_id), int(r.deviation)))
    assert [(r.vec_id, int(r.deviation), r.n) for r in got] == [(i, d, count) for i, d, _ in want]
    assert same_up_to_sign(np.array([r.whitened for r in got]), np.array([w for *_, w in want]))
    assert all(np.allclose(r.explained, explained, rtol=1e-9) and r.identity_error < 1e-9 for r in got)


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows, n, deviations, whitened, explained = plain_whitening([(r.vec_id, r.embedding, None) for r in table.collect()], 32)
    got = whitening.op13_whitening(spark, SF).collect()
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    at = {r[0]: k for k, r in enumerate(rows)}
    found = np.zeros((n, 32))
    for r in got:
        found[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviations[at[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert same_up_to_sign(found, whitened)
    assert np.abs(np.cov(found.T, bias=True) - np.eye(32)).max() < 1e-9


def test_scatter_is_exact_for_large_numbers(monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(3)
    for bits in (5, 19, 21, 40, 60):
        x = rng.integers(-(1 << bits), 1 << bits, size=(3000, 4)) + whitening.SHIFT
        a, b = whitening.Scatter(4), whitening.Scatter(4)
        a.add(x[:1000])
        b.add(x[1000:])
        a.merge(whitening.Scatter.unpacked(4, b.packed()))
        a.carry()
        z = (x - whitening.SHIFT).astype(object)
        assert a.n == 3000 and (a.sums == z.sum(axis=0)).all() and (a.products == z.T @ z).all()


def test_whitening_of_degenerate_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(4)], KIND)
    assert {(tuple(r.whitened), r.identity_error, int(r.deviation)) for r in whitening.whiten(same).collect()} == {((0.0, 0.0, 0.0), 0.0, 0)}
    flat = spark.createDataFrame([(i, [float(i), float(2 * i), 5.0], 0) for i in range(6)], KIND)
    got = whitening.whiten(flat).collect()
    assert np.allclose(np.array([r.whitened for r in got]).T @ np.array([r.whitened for r in got]) / 6, np.diag([1.0, 0, 0])) and got[0].identity_error < 1e-9
    assert np.allclose(got[0].explained, [1, 0, 0])
    mixed = spark.createDataFrame([(1, [], 0), (2, [1.0], 0), (3, [2.0], 0), (None, [1.0, 3e38], 0), (5, [-1e30, 2.0], 0)], KIND)
    assert sorted(len(r.whitened) for r in whitening.whiten(mixed).collect()) == [0, 1, 1, 2, 2]
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0
