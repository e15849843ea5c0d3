"""The kept-up keyword index against one made anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwell.config import Config, Hybrid
from siftwell.engine import Engine
from siftwell.operators import index as module
from siftwell.operators import keyword
from siftwell.operators.index import KeywordIndex

KIND = "chunk_id string, text string"


def same(spark, kept, live, analyzer):
    df = spark.createDataFrame(list(live.items()), KIND)
    rows = lambda d: sorted((r.term, r.chunk_id, r.dl, r.tf, tuple(r.places)) for r in d.collect())
    assert rows(kept.postings()) == rows(keyword.positional_postings(df, analyzer))
    got, want = kept.stats().head(), keyword.corpus_stats(df, analyzer).head()
    assert got.n_docs == want.n_docs and abs(got.avg_dl - want.avg_dl) < 1e-12


@pytest.mark.parametrize("analyzer", ["simple", "english"])
def test_index_after_adding_and_removing_is_a_fresh_one(spark, tmp_path, monkeypatch, analyzer):
    monkeypatch.setattr(module, "FAN", 3)
    rng, kept, live, epoch = random.Random(5), KeywordIndex(spark, str(tmp_path / "i"), analyzer), {}, 0
    assert not kept.available() and kept.stats().head().n_docs == 1
    say = lambda: " ".join(rng.choice(["cats", "running", "the", "dog", "x1", ""]) for _ in range(rng.randrange(12)))
    for turn in range(7):
        if turn % 3 == 2 and live:
            gone = rng.sample(sorted(live), min(3, len(live)))
            kept.remove(spark.createDataFrame([(i, live.pop(i)) for i in gone], KIND))
        else:
            # ids that were removed come again, with other words
            new = {f"c{rng.randrange(30)}": say() for _ in range(rng.randrange(1, 6))}
            new = {i: t for i, t in new.items() if i not in live}
            if not new:
                continue
            live |= new
            batch = spark.createDataFrame(list(new.items()), KIND)
            kept.add(batch, ("s", epoch))
            kept.add(batch, ("s", epoch))
            epoch += 1
        same(spark, kept, live, analyzer)
    assert len(kept.segments()) < epoch
    kept.merge(all_of_them=True)
    same(spark, kept, live, analyzer)
    assert len(kept.segments()) == 1
    kept.add(spark.createDataFrame([("again", "again")], KIND), ("s", epoch - 1))
    same(spark, kept, live, analyzer)


def test_search_follows_ingestion(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Config(hybrid=Hybrid(min_vector_score=0.99, analyzer="english")))
    docs = lambda *rows: spark.createDataFrame([(f"{n}.txt", f"{n}.txt", "TXT", t) for n, t in rows], "source string, name string, type string, text string")
    found = lambda q: {r.source for r in e.hybrid_search(spark.createDataFrame([(1, q)], "qid int, question string"), 5).filter("match_type = 'KEYWORD'").join(e.table("chunks").select("chunk_id", "source"), "chunk_id").collect()}
    assert not e.index.available()
    e.ingest_documents(docs(("one", "zebras are running far"), ("two", "other words stand here")))
    assert e.index.available() and found("zebra runs") == {"one.txt"}
    e.ingest_documents(docs(("three", "a zebra ran, a zebra runs")))
    assert found("zebra runs") == {"one.txt", "three.txt"}
    e.delete_chunks("one.txt")
    assert found("zebra runs") == {"three.txt"} and e.table("chunks").filter(F.col("source") == "one.txt").count() == 0
    e.build_index()
    assert found("zebra runs") == {"three.txt"} and len(e.index.segments()) == 1
