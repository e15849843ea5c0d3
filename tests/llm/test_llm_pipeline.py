"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import hashlib

import corpus_pipeline as P
from pyspark.sql import functions as F

from siftwell.llm import bpe
from siftwell.llm.quality import op7_quality

from ..conftest import SF
from .test_llm_cases import awkward, base_spans, brute_classes, empty


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "pii", "bpe encoding"]
    df = awkward(spark, ["mail a@b.c now"])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert stage(spark, empty(spark), SF).count() == 0
    assert P.STAGES[-1][1](spark, empty(spark), SF).count() == 0


def test_one_row_of_an_id_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (3, "x"), (3, "x"), (None, "x")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1) for r in P.dedup_stage(spark, df, SF).collect())
    assert got == [1, 3]


def test_rows_without_an_id_are_judged(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").head().text
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r.text for r in docs.join(P.decontamination_stage(spark, docs, SF).select("doc_id"), "doc_id").orderBy("doc_id").limit(3).collect()]
    rows = [(None, item), (5, item), (None, clean[0]), (7, clean[1]), (None, clean[2]), (None, clean[2]), (9, clean[2]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    assert key(P.decontamination_stage(spark, df, SF)) == sorted(rows[2:], key=repr)
    # copies without an id are copies; one with an id is the one that stays
    assert key(P.dedup_stage(spark, df, SF)) == sorted([(5, item), *rows[2:4], (9, clean[2]), (None, None), (None, "")], key=repr)
    told = lambda ids: sorted((r.text or "") for r in P.quality_stage(spark, df.withColumn("doc_id", ids), SF).collect())
    assert told(F.lit(None).cast("bigint")) == told(F.monotonically_increasing_id() + 10_000_000)


def test_pipeline_against_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in op7_quality(spark, SF).filter("predicted = 1").collect()}
    kept = {i: texts[i] for i in texts if i in good}
    kept = {i: kept[i] for i, (_, root) in brute_classes(kept, 5, 80).items() if i == root}
    from siftwell.llm.decontam import op4_decontaminate

    dirty = {r.doc_id for r in op4_decontaminate(spark, SF).filter("contaminated").collect()}
    kept = {i: t for i, t in kept.items() if i not in dirty}
    got = {r.doc_id: r.ids for r in P.run(spark, SF).collect()}
    assert set(got) == set(kept)
    tok = bpe.load(bpe.default_tokenizer())
    for i, ids in got.items():
        text = tok.decode(ids).decode()
        assert not base_spans(text.replace("[", " ").replace("]", " "))
        if not base_spans(kept[i]) and "token" not in kept[i].lower():
            assert hashlib.sha256(text.encode()).digest() == hashlib.sha256(kept[i].encode()).digest()


def test_registered_and_guarded():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 13


def test_a_task_of_the_encoder_holds_one_python_worker(spark):
    """Texts in parts, with special tokens and kept columns, as encoded whole; no
    stage has a Python function that is fed by another."""
    long = [" ".join(f"word{i * k}" for i in range(400)) for k in range(1, 5)]
    rows = [(n, t, f"k{n}" if n else None) for n, t in enumerate([*long, long[0] + "<|endoftext|>" + long[1], "", "short", None])] + [(None, long[2], None), (0, long[0], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")

    def chained(node, above=False):
        here = "InArrow" in node.nodeName()
        below = (node.children().apply(i) for i in range(node.children().size()))
        return (here and above) + sum(chained(c, (above or here) and "Exchange" not in node.nodeName()) for c in below)

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = bpe.encode(df, keep=("doc_id", "kind"), part_chars=500, leaf_chars=100, digests=True)
        assert "MapInArrow" in parts._jdf.queryExecution().executedPlan().toString()
        assert chained(parts._jdf.queryExecution().executedPlan()) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    whole = bpe.encode(df, keep=("doc_id", "kind"), digests=True)
    key = lambda d: sorted(map(tuple, d.drop("n_joins").collect()), key=repr)
    assert key(parts) == key(whole)
