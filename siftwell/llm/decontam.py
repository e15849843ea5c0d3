"""Benchmark decontamination over a distributed positional inverted index.

Documents are cut into words once and stored (row, words): the forward side.
Test items give windows of ``width`` words. Corpus frequencies of the test
vocabulary, over all documents, say which two words of each window are rarest;
the postings (term, row, position) of these terms are stored. A window's two
lists, shifted by the words' offsets to the window's start, are intersected;
what is left is compared word by word with the stored words of its row. For
proximity the lists may be a few positions apart. All of it is DataFrame code.

Defined results: null, empty and wordless texts have no words and no hits; an
item without words gives no window, one of fewer than ``width`` words gives
itself; repeated rows are judged each; equal windows of several items count for
each of them; other columns of either input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import HOT_KEYS, KEY_ROWS, ascii_lower, small, spread, spread_join, table, written

WIDTH = 10
#: After lower-casing, everything but words: ASCII letters and digits, and all beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def windows_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """len, win_words, item_ids of each distinct window."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    w = w.select("item_id", F.expr(f"explode(if(size(w) < {width}, array(w), transform(sequence(1, size(w) - {width - 1}), i -> slice(w, i, {width}))))").alias("win_words"))
    w = w.groupBy("win_words").agg(F.collect_set("item_id").alias("item_ids"))
    return w.select(F.size("win_words").alias("len"), "win_words", "item_ids")


class Index:
    """Forward words and postings of the corpus for one set of test windows."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = WIDTH):
        self.forward = written(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words_of(F.col("text")).alias("words")).select("row_id", "doc_id", F.size("words").cast("bigint").alias("n_words"), "words"), "index-forward")
        self.windows = written(windows_of(items, width).withColumn("win", F.monotonically_increasing_id()), "index-windows")
        terms = self.windows.select("win", F.posexplode("win_words").alias("offset", "term"))
        vocabulary = small(written(terms.select("term").distinct(), "index-vocabulary"))
        tokens = self.forward.select(F.explode("words").alias("term"))
        self.frequency = written(tokens.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("cf")), "index-frequency")
        # a window with a word the corpus lacks occurs nowhere: its lists are short of one
        known = terms.join(small(self.frequency), "term", "left").groupBy("win").agg(F.min(F.coalesce("cf", F.lit(0))).alias("least"), F.sort_array(F.collect_list(F.struct("cf", "offset", "term"))).alias("by"))
        rare = known.filter("least > 0").select("win", F.slice("by", 1, 2).alias("by"))
        self.anchors = written(rare.select("win", F.posexplode("by").alias("nth", "a")).select("win", "nth", "a.term", "a.offset"), "index-anchors")
        self.postings = written(self._postings(), "index-postings")

    def _postings(self) -> DataFrame:
        """Postings of the anchor terms, in one pass over the stored words. Terms
        that are too many to be sent to all tasks are met in a shuffled join, in
        which a term with more postings than go to one task is dealt to several."""
        terms = written(self.anchors.select("term").distinct().join(self.frequency, "term"), "index-terms")
        tokens = self.forward.select("row_id", F.posexplode("words").alias("pos", "term"))
        hint = small(terms)
        if hint is not terms:
            return tokens.join(hint, "term").select("term", "row_id", "pos")
        most = max(KEY_ROWS, (terms.agg(F.sum("cf")).head()[0] or 0) // HOT_KEYS + 1)
        salts = F.ceil(F.col("cf") / most).cast("int")
        hot = F.broadcast(terms.filter(F.col("cf") > most).select("term", salts.alias("salts")))
        dealt = tokens.join(hot, "term", "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("salts", F.lit(1))).cast("int"))
        sent = terms.select("term", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        return dealt.join(sent, ["term", "salt"]).select("term", "row_id", "pos")

    def starts(self, nth: int) -> DataFrame:
        """Offset-adjusted list of each window's nth rarest word."""
        a = written(self.anchors.filter(F.col("nth") == nth).select("term", "win", "offset"), f"index-anchors-{nth}")
        met = spread_join(self.postings, a, "term", "row_id")
        return met.select("win", "row_id", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")

    def phrases(self) -> DataFrame:
        """row_id, start, len, item_ids of each occurrence of a window."""
        single = self.windows.filter("len = 1").select("win")
        both = self.starts(0).join(self.starts(1), ["win", "row_id", "start"], "left_semi")
        cand = written(both.unionByName(self.starts(0).join(small(single), "win", "left_semi").select("win", "row_id", "start")), "index-candidates")
        win = small(self.windows)
        rows = written(cand.select("row_id").distinct(), "index-rows")
        words = self.forward.select("row_id", "words").join(small(rows), "row_id", "left_semi")
        cand = cand.join(win, "win").select("row_id", "start", "len", "win_words", "item_ids")
        same = words.join(cand, "row_id").filter("start + len <= size(words) and slice(words, start + 1, len) = win_words")
        return same.select("row_id", "start", "len", "item_ids")

    def near(self, slop: int) -> DataFrame:
        """doc_id, item_ids, start of the windows whose words all occur in
        their order with at most ``slop`` other words between them. The lists of
        the two rarest words meet if their shift is that small; what is left is
        checked on the stored words, from ``slop`` words before to after."""
        single = self.windows.filter("len = 1").select("win")
        a = self.starts(0)
        b = self.starts(1).select("win", "row_id", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start"))
        cand = a.join(b, ["win", "row_id", "start"], "left_semi").unionByName(a.join(small(single), "win", "left_semi"))
        cand = cand.join(small(self.windows), "win").select("row_id", "start", "len", "win_words", "item_ids")
        rows = self.forward.select("row_id", "doc_id", "words").join(cand, "row_id")
        rows = rows.withColumn("lo", F.greatest(F.col("start") - slop, F.lit(0))).withColumn("own", F.expr(f"slice(words, lo + 1, len + start - lo + {slop})"))
        # from each place on: the nearest next word, and the next, as far as a window reaches
        step = "if(s < 0 or array_position(slice(own, s + 1, size(own)), x) = 0, -1, s + array_position(slice(own, s + 1, size(own)), x))"
        ends = f"transform(sequence(0, least({2 * slop}, size(own) - 1)), i -> aggregate(win_words, cast(i as bigint), (s, x) -> {step}) - i)"
        at = F.array_position(F.expr(f"transform({ends}, n -> n > 0 and n <= len + {slop})"), True)
        found = rows.filter("size(own) > 0").withColumn("at", at).filter("at > 0")
        return found.select("row_id", "doc_id", "item_ids", (F.col("lo") + F.col("at") - 1).alias("start")).distinct().drop("row_id")

    def report(self) -> DataFrame:
        """A row per document row: n_words, n_hit, n_items, items, contaminated."""
        hits = written(self.phrases(), "index-hits")
        covered = hits.select("row_id", F.expr("explode(sequence(start, start + len - 1))").alias("p")).distinct().groupBy("row_id").agg(F.count("*").alias("n_hit"))
        items = hits.select("row_id", F.explode("item_ids").alias("item_id")).distinct().groupBy("row_id").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
        found = small(written(covered.join(items, "row_id"), "index-report"))
        out = self.forward.select("row_id", "doc_id", "n_words").join(found, "row_id", "left")
        return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Index(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark")).report()
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = {
    "op4_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, k AS n, list_slice(w, i, i + k - 1) AS x
         FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.r, g.i, g.n, w.item_id FROM grams g JOIN wins w ON g.x = w.x AND g.n = w.n),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""
}
