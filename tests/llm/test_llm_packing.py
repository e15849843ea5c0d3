"""Packing: the dynamic program against a plain one, and whole results."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import bpe, packing

from ..conftest import SF
from .test_llm_cases import awkward, empty, library


def padding(n: int, size: int) -> int:
    return 0 if n & (n - 1) == 0 else size - n


def test_cuts_against_all_transitions():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.choice([4, 8, 16, 64])
        places = np.cumsum([0, *(rng.randrange(1, rng.choice([3, size]) + 1) for _ in range(rng.randrange(1, 80)))])
        costs = np.array([float(rng.choice([0, 2, 8])) for _ in places])
        f, before = packing.best_cuts(places, costs, size)
        want = [0.0]
        for j in range(1, len(places)):
            want.append(costs[j] + min(want[i] + padding(int(places[j] - places[i]), size) for i in range(j) if places[j] - places[i] <= size))
            i = before[j]
            assert places[j] - places[i] <= size and f[j] == f[i] + costs[j] + padding(int(places[j] - places[i]), size)
        assert f == want


def test_filled_leaves_no_gap():
    places, costs = packing.filled(np.array([0, 5, 100, 101]), np.zeros(4), 32, 8.0)
    assert places.tolist() == [0, 5, 37, 69, 100, 101] and costs.tolist() == [0, 0, 8, 8, 0, 0]


def test_sentence_ends():
    path = bpe.default_tokenizer()
    enc = bpe.load(path)
    text = 'It cost 3.14 more. "Really?" Yes!\nAnd 文字。文字 e.g. this'
    ids = np.append(enc.encode(text)[0], np.uint32(1))
    cut = [enc.decode(ids[:n].tolist()).decode() for n in packing.sentence_ends(ids, path)]
    assert cut == ["It cost 3.14 more.", 'It cost 3.14 more. "Really?"', 'It cost 3.14 more. "Really?" Yes!', 'It cost 3.14 more. "Really?" Yes!\n', 'It cost 3.14 more. "Really?" Yes!\nAnd 文字。', text.removesuffix(" this")]


def held_against(rows, texts, size):
    """Every id once, pieces gapless in sequences of at most ``size`` tokens;
    returns padding and tokens. ``texts`` by doc_id, no id twice."""
    tok = library()
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(documents) == set(texts)
    for i, own in documents.items():
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    lost = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        lost += padding(at, size)
    return lost, sum(r.length for r in rows)


@pytest.mark.parametrize("horizon", [1, 3000, packing.HORIZON])
def test_pieces_are_whole(spark, horizon):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for size in (64, 2048):
        lost, total = held_against(packing.pack(docs.coalesce(1), size=size, ids=False, horizon=horizon).collect(), texts, size)
        assert lost <= (0.02 if horizon > 3000 and size > 64 else 0.2) * total


def test_order_is_kept(spark):
    docs = packing.in_order(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id")
    rows = packing.pack(docs).collect()
    order = [(r.doc_id, r.start) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
    text = {r.doc_id: r.text for r in docs.collect()}
    enc = bpe.load(bpe.default_tokenizer())
    for i in list(text)[:20]:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert enc.decode([x for r in own for x in r.ids][:-1]).decode() == text[i]


def test_packing_awkward(spark):
    df = awkward(spark).withColumn("start", F.lit("clash")).withColumn("sequence_id", F.lit("clash"))
    rows = packing.pack(df, ids=False).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 1 + len(library().encode("some text without an id", add_special_tokens=False).ids) + 1
    one = df.filter("doc_id is not null").dropDuplicates(["doc_id"])
    held_against(packing.pack(one, ids=False).collect(), {r.doc_id: r.text for r in one.collect()}, packing.SIZE)
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, size=1000)


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op12_packing(spark, SF).collect()
    lost, total = held_against(rows, docs, 2048)
    assert lost <= 0.02 * total
