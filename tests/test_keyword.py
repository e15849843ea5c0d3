"""Stems against published pairs, cover density against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import stem, text
from siftwell.operators import keyword

# Words of the published sample vocabularies with their stems.
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skis ski dying die news news generate generat general general communism communism arsenal arsenal proceed proceed exceeding exceed hopping hop hoping hope relational relat digitizer digit
happy happi cry cri by by say say enjoyment enjoy rational ration formality formal agreed agre tied tie ties tie cries cri gas gas this this kiwis kiwi gaps gap youth youth boy boy""".split()
GERMAN = """aufeinander aufeinand aufeinanderfolge aufeinanderfolg auferlegen auferleg auferlegt auferlegt auferlegten auferlegt auferstehen aufersteh auferstehung aufersteh aufgenommen aufgenomm
kategorie kategori kategorien kategori kategorisch kategor kater kat katze katz katzen katz kätzchen katzch häuser haus hauses haus freundlich freundlich freundlichkeit freundlich bedeutung bedeut
möglichkeiten moglich einigkeit einig verständnisse verstandnis straße strass schönste schon bauern bau langsamer langsam fähigkeit fahig""".split()


@pytest.mark.parametrize("stemmer,pairs", [(stem.english, ENGLISH), (stem.german, GERMAN)])
def test_stems_of_published_pairs(spark, stemmer, pairs):
    rows = spark.createDataFrame([(pairs[::2],), ([],), (["", "x", "12", "a1"],)], "w array<string>").select(stemmer(F.col("w")).alias("s")).collect()
    assert rows[0].s == pairs[1::2] and rows[1].s == [] and len(rows[2].s) == 4


@pytest.mark.parametrize("analyzer", ["simple", "unicode", "english", "german"])
def test_questions_and_texts_meet_in_their_terms(spark, analyzer):
    docs = spark.createDataFrame([(1, "Die Katzen der Bauern. The consolidated consoles were knocking, knocking"), (2, None), (3, "...")], "chunk_id bigint, text string")
    index = keyword.positional_postings(docs, analyzer)
    terms = keyword.question_terms(spark.createDataFrame([(1, "Katzen consolidated knocking")], "qid int, question string"), analyzer)
    assert [r.chunk_id for r in keyword.bm25(terms, index, keyword.corpus_stats(docs, analyzer)).collect()] == [1]
    plain = {(r.term, r.chunk_id, r.dl, r.tf) for r in keyword.postings(docs, analyzer).collect()}
    assert plain == {(r.term, r.chunk_id, r.dl, r.tf) for r in index.collect()}


def test_dropped_words_keep_their_places(spark):
    df = spark.createDataFrame([("the cat and the dogs",)], "t string")
    assert [tuple(w) for w in df.select(text.words(F.col("t"), "english").alias("w")).head().w] == [("cat", 2), ("dog", 5)]
    with pytest.raises(ValueError):
        text.words(F.col("t"), "latin")


def plain_density(words, asked):
    """Every stretch that holds all terms and has none such within it."""
    found = [(i, w) for i, w in enumerate(words, 1) if w in asked]
    covers = [(i, j) for i in range(len(found)) for j in range(i, len(found)) if {w for _, w in found[i : j + 1]} >= asked]
    least = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
    return sum(0.1 / (1 + (found[j][0] - found[i][0]) - (j - i)) for i, j in least)


def test_cover_density_against_plain_loops(spark):
    rng = random.Random(6)
    texts = {n: [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))] for n in range(60)}
    asked = {1: "a b", 2: "c", 3: "d e f g", 4: "a zz", 5: "h h a"}
    index = keyword.positional_postings(spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "chunk_id bigint, text string"))
    terms = keyword.question_terms(spark.createDataFrame(list(asked.items()), "qid int, question string"))
    got = {(r.qid, r.chunk_id): r.density for r in keyword.cover_density(terms, index).collect()}
    want = {(q, n): plain_density(t, set(a.split())) for q, a in asked.items() for n, t in texts.items() if set(a.split()) <= set(t)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and not any(q == 4 for q, _ in got)


def test_vector_search_against_plain_loops(spark, monkeypatch):
    """Batches and tiles of few rows; equal vectors, categories, lengths apart, unusable vectors."""
    import numpy as np

    from siftwell.config import Retrieval
    from siftwell.operators import vector

    rng = np.random.default_rng(7)
    monkeypatch.setattr(vector, "TILE", 50)
    monkeypatch.setattr(vector, "PAIRS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    base = rng.normal(size=(60, 5)).astype(np.float32)
    rows = [(f"c{i}", ["catalog", "rules", None, "other"][i % 4], v.tolist()) for i, v in enumerate(np.vstack([base, np.tile(base[:1], (30, 1)), base[:20] * 3]))]
    rows += [("n", "rules", None), ("z", "rules", [0.0] * 5), ("x", "rules", [float("nan")] * 5), ("e", "rules", [None] * 5), ("s", "rules", [1.0, 2.0])]
    asked = [(i, ["show SVC_007", "explain refunds"][i % 2], v.tolist()) for i, v in enumerate(np.vstack([base[:9], rng.normal(size=(9, 5))]).astype(np.float32))] + [(90, "show SVC_007", None), (91, "explain it", [2.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, category string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "qid int, question string, embedding array<float>")

    def scores(v):
        v = np.array(v, np.float64)
        ok = [(c, cat, np.array(e, np.float64)) for c, cat, e in rows if e is not None and len(e) == len(v) and None not in e and np.isfinite(e).all() and any(e)]
        norm = lambda x: np.sqrt(np.cumsum(x * x)[-1])
        return sorted(((-(1 + np.cumsum(v * e)[-1] / (norm(v) * norm(e))) / 2, c, cat) for c, cat, e in ok))

    try:
        got = {}
        for r in vector.top_k(q, chunks, 4, 0.5).collect():
            got.setdefault(r.qid, []).append((r.rank, r.chunk_id, r.score))
        routed = {}
        for r in vector.routed(q, chunks, 4, Retrieval(min_score=0.9)).collect():
            routed.setdefault(r.qid, []).append((r.rank, r.chunk_id, r.fallback))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, text, v in asked:
        if v is None:
            assert i not in got and i not in routed
            continue
        best = [(-s, c, cat) for s, c, cat in scores(v)]
        assert sorted(got.get(i, [])) == [(n + 1, c, s) for n, (s, c, _) in enumerate([x for x in best if x[0] >= 0.5][:4])]
        above = [x for x in best if x[0] >= 0.9]
        within = [x for x in above if x[2] in (("catalog",) if "SVC" in text else ("fds", "brd", "rules", "general"))]
        assert sorted(routed.get(i, [])) == [(n + 1, c, not within) for n, (_, c, _) in enumerate((within or above)[:4])]


def test_equal_questions_are_looked_up_once(spark, monkeypatch):
    """Each gets what it would get alone; the chunks meet a set of terms once, however many ask for it."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(n, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40)))) for n in range(50)], "chunk_id bigint, text string")
    kinds = ["a b", "b A", "c", "d e f", "a zz", "?!", "h h"]
    questions = spark.createDataFrame([(n, kinds[n % len(kinds)]) for n in range(70)] + [(None, "c")], "qid int, question string")
    terms, stats = keyword.question_terms(questions), keyword.corpus_stats(docs)
    index = keyword.positional_postings(docs, only=terms)
    seen = []
    for name in ("bm25", "cover_density"):
        plain = getattr(keyword, name)
        monkeypatch.setattr(keyword, name, lambda terms, *rest, plain=plain: seen.append(terms.select("qid").distinct().count()) or plain(terms, *rest))
    for ask, score in ((lambda t: keyword.bm25_top_k(t, index, stats, 4), "bm25"), (lambda t: keyword.bm25_top_k(t, index, stats, 4, mode="or"), "bm25"), (lambda t: keyword.coarse_top_k(t, index, 4), "density"), (lambda t: keyword.bm25_of_pool(t, index, stats, 4), "bm25")):
        seen.clear()
        got = {}
        for r in ask(terms).collect():
            got.setdefault(r.qid, set()).add((r.chunk_id, r["rank"], round(r[score], 9)))
        assert seen and set(seen) == {5}
        for n, kind in enumerate(kinds):
            alone = keyword.question_terms(spark.createDataFrame([(n, kind)], "qid int, question string"))
            want = {(r.chunk_id, r["rank"], round(r[score], 9)) for r in ask(alone).collect()}
            assert all(got.get(q, set()) == want for q in range(n, 70, len(kinds))) and (kind != "c" or got[None] == want)


def test_postings_of_asked_words_alone(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "c c"), (3, None), (2, "c c")], "chunk_id bigint, text string")
    only = spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "term string")
    for made in (keyword.postings, keyword.positional_postings):
        key = lambda r: tuple(map(str, r))
        assert sorted(made(docs, only=only).collect(), key=key) == sorted(made(docs).filter("term in ('a', 'c')").collect(), key=key)


def test_search_holds_little_of_a_batch_at_once():
    """A tile of products and the pairs worked out anew, of 64 numbers each, are 8 MB at most."""
    from siftwell.operators import vector

    assert 8 * vector.TILE <= 1 << 23 and 8 * 64 * vector.PAIRS <= 1 << 23


def test_answers_search_without_texts(spark, monkeypatch):
    import __spark_entry__ as entry
    from siftwell.operators import vector

    seen, plain = [], vector.nearest
    monkeypatch.setattr(vector, "nearest", lambda questions, chunks, *rest: seen.append(chunks.columns) or plain(questions, chunks, *rest))
    assert entry.queries()["answer"](spark, "/root/testdata/sf0.001").filter("size(sources) > 0").count() > 0
    assert seen and not any({"text", "source"} & set(columns) for columns in seen)


def test_columns_that_the_search_did_not_hold(spark):
    """Rows of one id keep their own; equal rows stay as many as were found."""
    from siftwell.operators import vector

    docs = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, None, "y"), (2, None, "y"), (None, "n", None), (3, "unfound", "z")], "chunk_id bigint, text string, source string")
    light = vector.without(docs, "text", "source")
    assert light.columns == ["chunk_id", "_row"]
    got = vector.with_columns(light.filter("chunk_id is null or chunk_id < 3"), docs, "text", "source")
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, docs.filter("chunk_id is null or chunk_id < 3").collect()))
