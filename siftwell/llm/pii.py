"""Personal data: base patterns, and contexts bootstrapped from them.

Base kinds are found by patterns and checked (parts of an address, digits and
checksum of a card, digits of a phone number). The base matches, and long
hexadecimal strings, are seeds. Every seed and every other token with a digit,
of ``ID_CHARS`` characters or more, is an instance; the words before it, and the
words around it, as far as they lie in the ``CONTEXT_CHARS`` characters before
and after, are its patterns; of a gap between matches, the ``GAP_CHARS`` characters next
to the instance are looked at, which are many times a context. They are cut from the whole text, in which every
word with a digit stands as one mark: items of a list share patterns, and a
short number nearby hides none. Spark scores the graph of patterns and instances in rounds, a
pattern by the share of its instances that are sensitive, an instance by the
patterns it occurs in, until a round makes no further instance confident.
Instances of confident patterns with enough different supporting values become
spans of kind ``id``. Base spans always stay; an ``id`` span never overlaps one.

Everything is DataFrame code. Positions come from the lengths of matches and of
the text between them, summed by a window over each document's own matches.

A value, or a pattern, may occur in a third of all rows: joins on either go
through ``spread_join``.

Defined results: null and empty texts have no spans; positions count code
points, the end is exclusive; repeated rows are searched each; equal values are
one instance of the graph, wherever they occur; extra columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import pieces
from ._shared import spread, spread_join, table, written

#: Patterns with guards that only save time: a match starts at the first
#: character of a run, or where the match before ended, and no run is split.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
KINDS = (("email", EMAIL, "instr(t, '@') > 0"), ("ip", IP, "t rlike '[0-9][.][0-9]'"), ("card", CARD, "t rlike '[0-9][ -]?[0-9]'"), ("phone", PHONE, "t rlike '[+][0-9]'"), ("id", TOKEN, "true"))
ORDER = "array_position(array('email', 'ip', 'card', 'phone', 'id'), kind)"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SEED_ID = "^[0-9a-fA-F]{32,}$"
#: Characters of the shortest identifier.
ID_CHARS = 6
CONTEXT_CHARS = 48
#: A word with a digit as contexts have it, and what becomes one: no text is
#: likely to hold the mark itself.
MARK = "\ue000"
MARKED = rf"(?<![A-Za-z0-9_{MARK}-])[A-Za-z_-]*+[0-9{MARK}][A-Za-z0-9_{MARK}-]*+"
#: Marks that only spaces and the signs of phone numbers part, one mark in all.
MARKS = rf"[+(]*+{MARK}(?:[\x20().+-]++{MARK})*+"
#: Characters of a gap that a context is cut from before words are marked;
#: between id tokens there is nothing to mark.
GAP_CHARS = 512
#: Matches beside an instance that a context can reach over: one of any kind and
#: the gap to the next are two characters at least.
NEAR = CONTEXT_CHARS // 2
ROUNDS = 3
SUPPORT, CONFIDENT = 3, 0.5
#: Names that no input has.
ROW, CUTS = "__pii_row", "__pii_cuts"


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _luhn(digits: str) -> str:
    """Of a string of digits, in SQL."""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if(i % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0))) % 10 = 0"


def _contexts() -> tuple[str, str]:
    """Text before and after match i, other matches and words with digits marked,
    in SQL over kind, gaps and hits. A side is added to, match by match, until it is long
    enough."""
    width = f"if(kind = 'id', {CONTEXT_CHARS}, {GAP_CHARS})"
    marked = lambda c: f"regexp_replace(regexp_replace({c}, {_q(MARKED)}, '{MARK}'), {_q(MARKS)}, '{MARK}')"
    back = f"if(i = 0, array(), sequence(i - 1, greatest(0, i - {NEAR}), -1))"
    ahead = f"if(i + 1 = size(hits), array(), sequence(i + 1, least(size(hits) - 1, i + {NEAR})))"
    before = f"aggregate({back}, right(gaps[i], {width}), (s, j) -> if(char_length(s) >= {width}, s, concat(right(gaps[j], {width}), '{MARK}', s)))"
    after = f"aggregate({ahead}, left(gaps[i + 1], {width}), (s, j) -> if(char_length(s) >= {width}, s, concat(s, '{MARK}', left(gaps[j + 1], {width}))))"
    # matches that are too short to stay need none
    kept = f"case kind when 'id' then char_length(h) >= {ID_CHARS} when 'card' then char_length(h) >= 13 when 'phone' then char_length(h) >= 10 else true end"
    return f"if({kept}, right({marked(before)}, {CONTEXT_CHARS}), '')", f"if({kept}, left({marked(after)}, {CONTEXT_CHARS}), '')"


def matches(docs: DataFrame) -> DataFrame:
    """row_id, kind, start, end, value, before, after of every base match that
    holds and of every identifier-like token."""
    t = docs.filter("t rlike '[0-9@]'")
    found = [F.expr(f"named_struct('kind', '{k}', 'gaps', if({guard}, split(t, {_q(p)}, -1), null), 'hits', if({guard}, regexp_extract_all(t, {_q(p)}, 0), null))") for k, p, guard in KINDS]
    rows = t.select("row_id", F.explode(F.array(*found)).alias("m")).select("row_id", "m.kind", "m.gaps", "m.hits").filter("size(hits) > 0")
    before, after = _contexts()
    one = f"transform(hits, (h, i) -> named_struct('n', i, 'gap', char_length(gaps[i]), 'value', h, 'before', {before}, 'after', {after}))"
    rows = rows.select("row_id", "kind", F.explode(F.expr(one)).alias("m")).select("row_id", "kind", "m.*").withColumn("size", F.char_length("value"))
    w = Window.partitionBy("row_id", "kind").orderBy("n")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w).cast("bigint")).withColumn("start", F.col("end") - F.col("size"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    rows = rows.withColumn("digits", F.when(F.col("kind").isin("card", "phone"), digits))
    good = (
        (F.col("kind") == "email")
        | F.expr(f"kind = 'ip' and value rlike {_q('^' + (OCTET + '[.]') * 3 + OCTET + '$')}")
        | F.expr(f"kind = 'card' and length(digits) between 13 and 19 and {_luhn('digits')}")
        | F.expr("kind = 'phone' and length(digits) between 9 and 15")
        | F.expr(f"kind = 'id' and size >= {ID_CHARS}")
    )
    return rows.filter(good).select("row_id", "kind", "start", "end", "value", "before", "after")


def apart(found: DataFrame) -> DataFrame:
    """Without the id tokens that overlap a base match of their row."""
    ahead = Window.partitionBy("row_id").orderBy("start", "end")
    back = Window.partitionBy("row_id").orderBy(F.desc("end"), F.desc("start"))
    base = F.col("kind") != "id"
    out = found.withColumn("reach", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(base, F.col("start"))).over(back))
    return out.filter(base | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end")))).drop("reach", "next")


def context_patterns(found: DataFrame) -> DataFrame:
    """pattern, value, seed: the distinct edges of the graph."""
    low = F.lower("before")
    three = F.regexp_extract(low, r"(\S+\s+\S+\s+\S+)\s*$", 1)
    two = F.regexp_extract(low, r"(\S+\s+\S+)\s*$", 1)
    after = F.regexp_extract(F.lower("after"), r"^\s*(\S+)", 1)
    tidy = lambda c: F.regexp_replace(c, r"\s+", " ")
    made = F.array(F.when(three != "", F.concat(F.lit("L3 "), tidy(three))), F.when((two != "") & (after != ""), F.concat(F.lit("LR "), tidy(two), F.lit(" _ "), after)))
    seed = (F.col("kind") != "id") | F.col("value").rlike(SEED_ID)
    edges = found.select(F.explode(made).alias("pattern"), F.concat("kind", F.lit(":"), F.lower("value")).alias("value"), seed.alias("seed")).filter("pattern is not null")
    return edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """value, score of the instances: ``rounds`` rounds over the graph with
    scores as shares, then rounds in which confident instances count whole and
    the others nothing, until one makes no further instance confident. Scores
    never fall, so that comes; shares alone would go on to raise each other."""
    edges = written(context_patterns(found), "pii-edges")
    score = written(edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score")), "pii-seeds")
    known = -1
    for n in itertools.count():
        sure = F.col("score") >= CONFIDENT
        joined = spread_join(edges, score, "value", "pattern")
        share = F.col("score") if n < rounds else sure.cast("double")
        patterns = joined.groupBy("pattern").agg(F.sum(share).alias("s"), F.count("*").alias("n"), F.count_if(sure).alias("support"))
        patterns = patterns.filter(F.col("support") >= SUPPORT).select("pattern", (F.col("s") / (F.col("n") + 1)).alias("confidence"))
        patterns = written(patterns, f"pii-patterns-{n}")
        told = spread_join(joined, patterns, "pattern", "value", "left").groupBy("value").agg(F.max("seed").alias("seed"), F.max(F.greatest("score", F.coalesce("confidence", F.lit(0.0)))).alias("best"))
        score = written(told.select("value", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("best")).alias("score")), f"pii-instances-{n}")
        last, known = known, score.filter(sure).count()
        if n >= rounds and known == last:
            return score


def detect(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the input with a row id in column ``ROW``; and row_id,
    kind, start, end, value of every span found."""
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "pii-rows")
    texts = rows.select(F.col(ROW).alias("row_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = written(apart(matches(texts)), "pii-matches")
    score = bootstrap(found)
    sure = score.filter((F.col("score") >= CONFIDENT) & F.col("value").startswith("id:")).select(F.expr("substring(value, 4)").alias("low"))
    ids = spread_join(found.filter("kind = 'id'").withColumn("low", F.lower("value")), written(sure, "pii-sure"), "low", "row_id").drop("low")
    return rows, found.filter("kind <> 'id'").unionByName(ids).select("row_id", "kind", "start", "end", "value")


def listed(spans: DataFrame) -> DataFrame:
    """row_id, counts and span lists of rows that have spans."""
    said = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    each = spans.select("row_id", F.struct(F.expr(ORDER).alias("o"), "start", "end", "kind").alias("x"))
    lists = each.groupBy("row_id").agg(F.sort_array(F.collect_list("x")).alias("xs"), *[F.count_if(F.col("x.kind") == k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")])
    return lists.select("row_id", "n_email", "n_ip", "n_card", "n_phone", F.expr(said.format("filter(xs, x -> x.kind <> 'id')")).alias("base"), F.expr(said.format("xs")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping
    spans are replaced together under the first one's kind. The other columns
    stay as they are."""
    rows, spans = detect(docs, text)
    w = Window.partitionBy("row_id").orderBy("start", F.desc("end"), F.expr(ORDER))
    marked = spans.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("first", F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)))
    runs = marked.withColumn("run", F.sum(F.col("first").cast("int")).over(w)).groupBy("row_id", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.min_by("kind", F.struct("start", (-F.col("end")).alias("e"))).alias("kind"))
    lists = runs.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "kind"))).alias("cuts"))
    begin = F.transform(CUTS, lambda c: c["b"].cast("int"))
    end = F.concat(F.transform(CUTS, lambda c: c["a"].cast("int")), F.array(F.char_length(text)))
    kept = pieces(F.col(text), F.zip_with(F.concat(F.array(F.lit(0)), begin), end, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    said = F.concat(F.transform(CUTS, lambda c: F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))), F.array(F.lit("")))
    clean = F.array_join(F.zip_with(kept, said, lambda a, b: F.concat(a, b)), "")
    out = rows.join(lists.select(F.col("row_id").alias(ROW), F.col("cuts").alias(CUTS)), ROW, "left")
    return out.withColumn(text, F.when(F.col(CUTS).isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(0).cast("bigint")
    out = rows.select(F.col(ROW).alias("row_id"), "doc_id").join(listed(spans), "row_id", "left")
    counts = [F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
