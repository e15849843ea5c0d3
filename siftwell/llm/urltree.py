"""URL filter: explicit rules, and a tree of path templates per host.

A path becomes a template level by level: segments that are numbers, hex or
mixed identifiers, or very long, become wildcards at once; a position below
one parent that takes many values, each of few pages, becomes ``*``. Sibling
branches whose labelled rates do not differ more than chance explains are
merged and pool their labels, however few they have. A template is rejected if
its smoothed share of bad labels, the purity, is high. With ``SUPPORT`` labels it
is smoothed towards the share of all; with fewer, towards the purity of the rest
of its parent, that towards the rest of the parent's parent, and so on from the
host, so that no label counts twice. Without labels of its own a template is
left alone.

Labels come from a column and not from the rules. ``weak_label`` makes one of a
page's host and content: hosts with a word of a seed list are bad, and so are
pages whose visible text is mostly signs, as in lists of keywords; pages of
running text are good, and those of fewer than ``WORDS`` words have no label.

Pages are counted per (host, template) before anything else, so a hot host is
as many rows as it has templates. A round takes every branch to where its paths
part next, however far down, so there are as many rounds as the most partings
that lie on one path, and what paths share costs none. A parent may have most of all
branches, and a template most of all pages: joins on them go through
``spread_join``.

Defined results: a null url, or one without ``://``, has empty host and path
and is allowed unless a rule says else; repeated urls are judged alike; ties in
the rules' length go to the one that is first in the list; extra columns stay,
but those named like a result (``RESULT``), which it takes the place of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text
from ._shared import ascii_lower, spread, spread_join, table, written

#: (host, path, verdict) of the contract's rules.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words of host names, between dots and hyphens, that mark unwanted sites; a
#: seed for labels.
BAD_HOST_WORDS = ("ads", "adult", "betting", "bets", "casino", "casinos", "malware", "phish", "phishing", "pills", "porn", "spam", "tracker", "viagra", "warez", "xxx")
#: Share of words without a letter or digit from which a page is no prose, and
#: words from which one is told.
SIGNS, WORDS = 0.15, 20
RESULT = ("host", "path", "rule", "template", "purity", "verdict")
#: A position with at least so many values, of at most so many pages each, is a wildcard.
MANY_VALUES, FEW_PAGES = 20, 5.0
SMOOTH, SUPPORT, PURITY = 2.0, 5, 0.8
#: Standard errors within which sibling rates count as the same.
SAME_RATE = 2.0


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(host == h) | host.endswith("." + h) for h, _, _ in order]
    rule = verdict = F.lit(None).cast("string")
    for fit, (h, p, v) in reversed(list(zip(fits, order, strict=True))):
        hit = fit & path.startswith(p)
        rule, verdict = F.when(hit, F.lit(h + p)).otherwise(rule), F.when(hit, F.lit(v)).otherwise(verdict)
    return rule, verdict


def typed(segment: Column) -> Column:
    """Wildcards for segments that vary by their form."""
    stem, ext = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 2)
    kind = (
        F.when(stem.rlike("^[0-9]+$"), F.lit("{n}"))
        .when(stem.rlike("^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.lit("{hex}"))
        .when(stem.rlike("[0-9]"), F.lit("{id}"))
        .when(F.char_length(stem) > 40, F.lit("{long}"))
        .otherwise(stem)
    )
    return F.concat(kind, ext)


def weak_label(host: Column, html: Column) -> Column:
    """1 bad, 0 good, null for what neither host nor content tells."""
    words = F.filter(F.split(html_text(html), " "), lambda w: w != "")
    signs = F.size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))) / F.size(words)
    told = F.when(F.size(words) >= WORDS, (signs >= SIGNS).cast("int"))
    return F.when(host.rlike(f"(^|[.-])({'|'.join(BAD_HOST_WORDS)})([.-]|$)"), 1).otherwise(told)


def _raw(host: Column, path: Column) -> Column:
    """The host, then the typed segments of the path."""
    return F.concat(F.array(host), F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), typed))


def _branch(key, level) -> Column:
    """The branch of a key at a level, the host being level 0, as text."""
    return F.to_json(F.slice(key, F.lit(1), level + 1))


def _fork() -> Column:
    """How many segments the keys of a group share, from its first and last."""
    return F.expr("coalesce(array_min(filter(transform(arrays_zip(lo, hi), (x, i) -> if(x.lo <=> x.hi, null, i)), i -> i is not null)), size(lo))")


def templates(pages: DataFrame) -> DataFrame:
    """raw (host and typed segments, as text), key (of the template), n, bad,
    good: from pages with host, path and label (1 bad, 0 good, null)."""
    base = pages.groupBy(_raw(F.col("host"), F.col("path")).alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    tree = written(base.select(F.to_json("key").alias("raw"), "key", "n", "bad", "good", _branch("key", F.lit(0)).alias("branch")), "url-level-0")
    done, level = tree.filter("size(key) = 1").drop("branch"), 0
    tree = tree.filter("size(key) > 1")
    while tree.head(1):
        # a branch goes on at once to where its paths part next; what is alone in
        # its branch has nothing to be merged with, nor has what ends there
        forks = tree.groupBy("branch").agg(F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        forks = written(forks.select("branch", F.when(F.col("rows") > 1, _fork()).alias("fork")), f"url-forks-{level}")
        tree = spread_join(tree, forks, "branch", "raw").drop("branch")
        over = F.col("fork").isNull() | (F.size("key") <= F.col("fork"))
        here = tree.withColumns({"over": over, "kid": F.when(~over, _branch("key", F.col("fork"))), "parent": F.when(~over, _branch("key", F.col("fork") - 1))})
        here = written(here, f"url-here-{level}")
        done = done.unionByName(here.filter("over").select(*done.columns))
        here = here.filter("not over").drop("over")
        kids = here.groupBy("kid", "parent").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("known"))
        kids = written(kids, f"url-kids-{level}")
        whole = kids.groupBy("parent").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"))
        whole = written(whole.filter("kinds > 1"), f"url-parents-{level}")
        judged = spread_join(kids, whole, "parent", "kid", "left")
        known, rate = F.nullif(F.col("known"), F.lit(0)), (F.col("all_bad") + 1) / (F.col("all_known") + 2)
        sd = F.sqrt(rate * (1 - rate) / known)
        many = (F.col("kinds") >= MANY_VALUES) & (F.col("all_n") <= FEW_PAGES * F.col("kinds"))
        alike = (F.abs(F.col("bad") / known - rate) <= SAME_RATE * sd) & (known < F.col("all_known"))
        turned = written(judged.select("kid", F.when(many, F.lit("*")).when(alike, F.lit("~")).alias("new")).filter("new is not null"), f"url-turned-{level}")
        here = spread_join(here, turned, "kid", "raw", "left")
        key = F.when(F.col("new").isNotNull(), F.concat(F.slice("key", F.lit(1), F.col("fork")), F.array("new"), F.slice("key", F.col("fork") + 2, F.size("key")))).otherwise(F.col("key"))
        step = here.select("raw", key.alias("key"), "n", "bad", "good", "fork")
        tree = written(step.select("raw", "key", "n", "bad", "good", _branch("key", F.col("fork")).alias("branch")), f"url-level-{level + 1}")
        level += 1
    return done


def rejected(tree: DataFrame) -> DataFrame:
    """key, purity of the templates that are rejected."""
    total = tree.agg(((F.sum("bad") + 1) / (F.sum(F.col("bad") + F.col("good")) + 2)).alias("prior"))
    own = tree.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("known"))
    own = written(own.filter("known > 0").crossJoin(F.broadcast(total)).withColumn("prior", F.least("prior", F.lit(0.5))), "url-own")
    enough = own.filter(F.col("known") >= SUPPORT).select("key", ((F.col("bad") + SMOOTH * F.col("prior")) / (F.col("known") + SMOOTH)).alias("purity"))
    # the labels of every branch, the host being the branch of level 0
    levels = F.explode(F.sequence(F.lit(0), F.size("key") - 1)).alias("level")
    on = own.select("key", "bad", "known", levels).withColumn("up", _branch("key", F.col("level")))
    few = own.filter(F.col("known") < SUPPORT).select("key", "prior", F.struct("bad", "known").alias("own"), levels).withColumn("up", _branch("key", F.col("level")))
    branches = on.groupBy("up").agg(F.sum("bad").alias("b"), F.sum("known").alias("k"))
    branches = written(branches.join(few.select("up").distinct(), "up", "left_semi"), "url-branches")
    few = spread_join(few, branches, "up", "key").groupBy("key", "prior", "own").agg(F.sort_array(F.collect_list(F.struct("level", F.col("b").alias("bad"), F.col("k").alias("known")))).alias("path"))
    # what each has beyond the next one down the path, and the template itself
    steps = "concat(transform(path, (x, i) -> named_struct('bad', x.bad - if(i + 1 < size(path), path[i + 1].bad, own.bad), 'known', x.known - if(i + 1 < size(path), path[i + 1].known, own.known))), array(own))"
    few = few.select("key", F.expr(f"aggregate({steps}, cast(prior as double), (p, x) -> (x.bad + {SMOOTH}D * p) / (x.known + {SMOOTH}D))").alias("purity"))
    return enough.unionByName(few).filter(F.col("purity") >= PURITY)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", label: Column | None = None) -> DataFrame:
    """The rows of ``pages`` with RESULT; template and purity are of rejected
    templates only. ``label`` is 1 bad, 0 good or null, an expression over
    ``pages``; without it no template is rejected."""
    host, path = split_url(F.col(url).cast("string"))
    names = {c: f"__url_{c}" for c in (*RESULT, "said", "raw", "label")}
    kept = [c for c in pages.columns if c not in RESULT]
    rows = pages.select(*kept, host.alias(names["host"]), path.alias(names["path"]), (F.lit(None) if label is None else label).cast("int").alias(names["label"]))
    at = {c: F.col(n) for c, n in names.items()}
    rule, verdict = rule_of(at["host"], at["path"], rules)
    rows = rows.withColumns({names["rule"]: rule, names["said"]: verdict, names["raw"]: F.to_json(_raw(at["host"], at["path"]))})
    tree = written(templates(rows.select(*(at[c].alias(c) for c in ("host", "path", "label")))), "url-tree")
    bad = rejected(tree)
    template = F.concat(F.lit("/"), F.array_join(F.slice("key", F.lit(2), F.size("key")), "/"))
    bad = written(tree.join(bad, "key").select(F.col("raw").alias(names["raw"]), template.alias(names["template"]), F.col("purity").alias(names["purity"])), "url-rejected")
    out = spread_join(rows, bad, names["raw"], names["path"], "left")
    told = F.coalesce(at["said"], F.when(at["purity"].isNotNull(), "block").otherwise("allow"))
    return out.select(*kept, *(at[c].alias(c) for c in RESULT[:-1]), told.alias("verdict"))


def op3_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    pages = written(pages.select("page_id", "url", weak_label(split_url(F.col("url"))[0], F.col("html")).alias("label")), "url-labels")
    return judge(pages, label=F.col("label")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
