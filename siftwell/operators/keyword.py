"""Keyword retrieval: postings, corpus statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Hybrid
from ..functions.text import tokens, words
from .layout import small, spread
from .scratch import stored


def postings(docs: DataFrame, analyzer: str = "simple", id_col: str = "chunk_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """term, chunk_id, tf, dl: the materialised index. dl counts distinct terms.
    With ``only`` (term), the postings of these terms: no other word leaves the
    task that reads its text."""
    base = spread(docs.select(F.col(id_col).alias("chunk_id"), F.col(text).alias("_x"))).select("chunk_id", tokens(F.col("_x"), analyzer).alias("_t"))
    # bound below the explode: once a text, not once a word. The outer one does
    # not cut the words a second time to drop texts without any
    base = base.withColumn("dl", F.size(F.array_distinct("_t")))
    each = _only(base.select("chunk_id", "dl", F.explode_outer("_t").alias("term")).filter("term is not null"), only)
    return each.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def _only(each: DataFrame, only: DataFrame | None) -> DataFrame:
    return each if only is None else each.join(small(only.select("term").distinct()), "term", "left_semi")


def positional_postings(docs: DataFrame, analyzer: str = "simple", id_col: str = "chunk_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """postings() with ``places``: where the term stands among the text's words,
    from 1, rising. A row holds the places of one term in one text."""
    base = spread(docs.select(F.col(id_col).alias("chunk_id"), F.col(text).alias("_x"))).select("chunk_id", words(F.col("_x"), analyzer).alias("_w"))
    base = base.withColumn("dl", F.size(F.array_distinct(F.transform("_w", lambda w: w["term"]))))
    each = base.select("chunk_id", "dl", F.explode_outer("_w").alias("w")).filter("w is not null")
    each = _only(each.select("chunk_id", "dl", "w.term", "w.place"), only)
    placed = each.groupBy("term", "chunk_id", "dl").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return placed.select("term", "chunk_id", "dl", F.size("places").cast("bigint").alias("tf"), "places")


def cover_density(terms: DataFrame, index: DataFrame, config: Hybrid = Hybrid()) -> DataFrame:
    """qid, chunk_id, density of the chunks that hold all terms of a question, as
    a database's text search ranks them: each shortest stretch that holds all
    terms, none within another, gives ``cover_weight`` / (1 + its other words).
    ``index`` has places.

    Every stretch ends at an occurrence of a term and begins at the least of the
    terms' last places before it; it is a new one if that beginning moved. So one
    fold over a chunk's occurrences, in order, with the last of each term in hand,
    finds them all."""
    own = small(terms)
    hits = index.join(small(terms.select("term").distinct()), "term", "left_semi").join(own, "term")
    # the number of a term within its question
    held = hits.groupBy("qid", "chunk_id", "n_terms").agg(F.sort_array(F.collect_list(F.struct("term", "places"))).alias("ts")).filter(F.size("ts") == F.col("n_terms"))
    places = F.array_sort(F.flatten(F.transform("ts", lambda t, k: F.transform(t["places"], lambda p: F.struct(p.alias("place"), k.alias("k"))))))
    start = F.struct(F.transform("ts", lambda t: F.struct(F.lit(0).alias("place"), F.lit(0).alias("n"))).alias("last"), F.lit(0).alias("begin"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        last = F.transform(s["last"], lambda e, k: F.when(k == x["k"], F.struct(x["place"].alias("place"), n.alias("n"))).otherwise(e))
        return F.transform(F.array(last), lambda now: _covered(s, now, x["place"], n))[0]

    def _covered(s: Column, last: Column, place: Column, n: Column) -> Column:
        first = F.array_min(last)  # no place is shared, so its n is that of the occurrence
        new = (first["place"] > 0) & (first["place"] > s["begin"])
        others = (place - first["place"]) - (n - first["n"])
        return F.struct(last.alias("last"), F.when(new, first["place"]).otherwise(s["begin"]).alias("begin"), n.alias("n"), (s["sum"] + F.when(new, F.lit(config.cover_weight) / (1 + others)).otherwise(0.0)).alias("sum"))

    return held.select("qid", "chunk_id", F.aggregate(places, start, step, lambda s: s["sum"]).alias("density"))


def coarse_top_k(terms: DataFrame, index: DataFrame, pool: int, config: Hybrid = Hybrid()) -> DataFrame:
    """The ``pool`` densest chunks of each question: the shortlist of a keyword
    search that ranks only these by BM25."""
    terms, same = alike(terms)
    return _for_each(_densest(terms, index, pool, config), same)


def _densest(terms: DataFrame, index: DataFrame, pool: int, config: Hybrid) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("density", 9)), "chunk_id")
    return cover_density(terms, index, config).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool)


def bm25_of_pool(terms: DataFrame, index: DataFrame, stats: DataFrame, pool: int, config: Hybrid = Hybrid()) -> DataFrame:
    """qid, chunk_id, bm25, rank: the shortlist of coarse_top_k(), by BM25. The
    frequencies are those of the whole index."""
    terms, same = alike(terms)
    freq = doc_freq(index.join(small(terms.select("term").distinct()), "term", "left_semi"))
    # a pool for each set of terms; only the postings of its chunks are scored
    listed = stored(_densest(terms, index, pool, config).select("qid", "chunk_id"))
    near = index.join(small(listed.select("chunk_id").distinct()), "chunk_id", "left_semi")
    found = bm25(terms, near, stats, config, "and", freq).join(small(listed), ["qid", "chunk_id"], "left_semi")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("bm25", 9)), "chunk_id")
    return _for_each(found.withColumn("rank", F.row_number().over(w)), same)


def corpus_stats(docs: DataFrame, analyzer: str = "simple", text: str = "text") -> DataFrame:
    """One row: n_docs (1 at least) and avg_dl (1 if there is none)."""
    n = F.size(F.array_distinct(tokens(F.col(text), analyzer)))
    found = spread(docs.select(text)).select(n.alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("a"))
    return found.select(F.greatest("n", F.lit(1)).alias("n_docs"), F.when(F.col("a") > 0, F.col("a")).otherwise(F.lit(1.0)).alias("avg_dl"))


def doc_freq(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, dl: Column, df: Column, n: Column, avg: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    a = F.greatest(avg, F.lit(1e-6))
    return idf(F.greatest(n, F.lit(1)), df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / a))


def question_terms(questions: DataFrame, analyzer: str = "simple") -> DataFrame:
    """qid, term, n_terms: the distinct terms of each question."""
    t = questions.select("qid", F.array_distinct(tokens(F.col("question"), analyzer)).alias("t"))
    return t.select("qid", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def alike(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``terms`` of one question of those that ask for the same; qid, _like: the
    question asked in the place of each). What is asked often is looked up once,
    so the work grows with the chunks times the different sets of terms."""
    each = terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n_terms", "term"))).alias("_set"))
    first = each.groupBy("_set").agg(F.min("qid").alias("_like"))
    return first.select(F.col("_like").alias("qid"), F.inline("_set")), each.join(first, "_set").select("qid", "_like")


def _for_each(found: DataFrame, same: DataFrame) -> DataFrame:
    """What alike()'s questions found, for each that asked."""
    found = found.withColumnRenamed("qid", "_like_found")
    return found.join(small(same), F.col("_like_found").eqNullSafe(F.col("_like"))).select("qid", *[c for c in found.columns if c != "_like_found"])


def bm25(terms: DataFrame, index: DataFrame, stats: DataFrame, config: Hybrid = Hybrid(), mode: str = "and", freq: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, bm25 of the chunks that hold all (``and``) or any
    (``or``) terms of a question, positive scores only. ``stats`` may be an
    older snapshot; terms it has too few documents for lower the score."""
    if mode not in ("and", "or"):
        raise ValueError(f"mode is and or or, not {mode!r}")
    # both uses of the index see the questions' terms alone
    asked = small(terms)
    index = index.join(small(terms.select("term").distinct()), "term", "left_semi")
    freq = doc_freq(index) if freq is None else freq
    # a row per question and term, so no more than asked
    known = terms.join(freq, "term")
    hits = index.join(known if asked is terms else F.broadcast(known), "term").crossJoin(F.broadcast(stats))
    part = bm25_term(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avg_dl"), config.k1, config.b)
    found = hits.groupBy("qid", "chunk_id", "n_terms").agg(F.sum(part).alias("bm25"), F.count("*").alias("_n"))
    if mode == "and":
        found = found.filter(F.col("_n") == F.col("n_terms"))
    return found.filter("bm25 > 0").select("qid", "chunk_id", "bm25")


def bm25_top_k(terms: DataFrame, index: DataFrame, stats: DataFrame, k: int, config: Hybrid = Hybrid(), mode: str = "and") -> DataFrame:
    terms, same = alike(terms)
    found = bm25(terms, index, stats, config, mode)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("bm25", 9)), "chunk_id")
    return _for_each(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), same)


def exact_term(index: DataFrame, term: str) -> DataFrame:
    """Chunks with exactly this term."""
    return index.filter(F.col("term") == term).select("chunk_id", "tf")
