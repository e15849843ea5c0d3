"""Worked examples of single operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siftwell.functions import classify as C
from siftwell.functions import headers as H
from siftwell.functions import text as T
from siftwell.operators import answers, bot, cache, conversation, feedback, fusion, history, ingest, keyword, rerank, sheets, vector


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_intent(spark):
    asked = ["What is Flat Offering?", "What is the Offering Id for CR-1029?", "ID for CR-1029?", "show SVC_007", "covid19 policy", "What is CR-1029?", "explain refunds", "refund policy", " ", None, "what's an id", "\twhat is x"]
    assert each(spark, C.intent, asked) == ["LOOKUP"] * 5 + ["EXPLANATION"] * 7


def test_types_and_categories(spark):
    assert each(spark, C.sheet_type, ["Complex Flat Rules", "PrP Optional Offering", "", None, "Rule x", "PRICE-LIST"]) == ["complexFlatRule", "optionalOffering", "general", "general", "rule", "priceListItem"]
    assert each(spark, C.file_type, ["a.PDF", "b.doc", "c.XLSX", "https://x", "n", None]) == ["PDF", "DOCX", "EXCEL", "URL", "TXT", "TXT"]
    assert each(spark, lambda c: C.doc_category(c, F.lit("DOCX")), ["x_FDS_v2.docx", "offds.docx", "pricing rules.pdf", "a BRD.doc", "functional_design", None]) == ["fds", "general", "rules", "brd", "fds", "general"]
    assert each(spark, lambda c: C.doc_category(c, F.lit("EXCEL")), ["x_FDS.xlsx"]) == ["catalog"]
    assert each(spark, C.query_type, ["find it", "What is it", "none of them", None]) == ["EXCEL", "DOCX", None, None]
    assert each(spark, C.feedback_shortcut, [" 👍🏾 ", "Wrong answer", "good", ""]) == ["UP", "DOWN", None, None]
    assert each(spark, C.rating, [" up", "DOWN", "meh", None]) == ["UP", "DOWN", None, None]
    assert each(spark, C.is_supported_file, ["a.MD", "b.exe", None]) == [True, False, False]


def test_headers(spark):
    assert each(spark, H.dynamic_key, ["Price List Item Id", "Installment Plan Name", "RuleID", "", None, "##"]) == ["priceListItemId", "installmentPlanName", "ruleid", "", "", ""]
    assert each(spark, H.is_identifier, ["Characteristic #1 Id", "Paid", "Quantity", None]) == [False, True, False, False]
    df = spark.createDataFrame([("Discount ID range: 79200000 to 79299999 Rule ID range: 5-9",), ("Rule ID range: 71320000",), ("nothing",)], "h string")
    got = [r[0] for r in df.select(H.range_hints(F.array("h"))).collect()]
    assert got == [{"discountIdRangeStart": "79200000", "discountIdRangeEnd": "79299999", "ruleIdRangeStart": "5", "ruleIdRangeEnd": "9"}, {"ruleIdRangeStart": "71320000"}, {}]
    r = one(spark, H.check_range(F.lit("ruleId"), F.lit("71319999.0"), F.lit("71320000"), F.lit(None).cast("string")), H.check_range(F.lit("a"), F.lit("7"), F.lit("5"), F.lit("9")), H.check_range(F.lit("a"), F.lit("x"), F.lit("5"), F.lit("9")))
    assert r[0] == "ruleId=71319999 is below its sheet's documented range start (71320000)" and r[1] is None and r[2] is None
    letters = spark.createDataFrame([(n,) for n in (0, 25, 26, 701, 702, 18277)], "n int").select(H.column_letter(F.col("n"))).collect()
    assert [r[0] for r in letters] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]


def test_header_layers(spark):
    heads = ["Offering ID", "Flat Offering ID", "Rule Code", "Source", "TUTI", "Rule Code"]
    df = spark.createDataFrame([("w", "s", i, h) for i, h in enumerate(heads)], "workbook string, sheet string, col int, header string")
    got = {r.key: r.col for r in H.match_headers(df, {"Offering ID": "offeringId", "TUTI": "tuti"}).collect()}
    # the alias claims the first column, so the configured field has none left
    assert got == {"flatOfferingId": 0, "ruleCode": 2, "tuti": 4, "flatOfferingId": 0}


def test_backfill_is_idempotent(spark):
    fields = {"priceKeyId": "K", "ruleId": "3", "ruleIdRangeStart": "5"}
    df = spark.createDataFrame([("EXCEL", "Rules", None, fields), ("EXCEL", "x", "general", {"a": "b"})], "type string, sheet string, sheet_type string, fields map<string,string>")
    new, counts = sheets.backfill(df)
    assert counts.head().asDict() == {"scanned": 2, "updated": 1, "reconciled": 1, "new_warnings": 1}
    first = new.filter("sheet = 'Rules'").head()
    assert first.sheet_type == "rule" and first.fields["priceKey"] == "K" and first.fields["hasRangeWarning"] == "true" and "priceKeyId" not in first.fields
    assert sheets.backfill(new)[1].head().updated == 0


def test_cells_to_chunks(spark):
    rows = [("w.xlsx", "Rules", 1, 0, "string", "Rule ID"), ("w.xlsx", "Rules", 1, 1, "string", " "), ("w.xlsx", "Rules", 2, 0, "number", "71325001"), ("w.xlsx", "Rules", 2, 1, "formula", "A1+1"), ("w.xlsx", "Rules", 0, 0, "string", ""), ("w.xlsx", "Rules", 3, 0, "string", " "), ("w.xlsx", "Rules", 4, 0, "string", "x" * 2100)]
    cells = spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, kind string, raw string")
    got = sheets.chunk_rows(cells).orderBy("row_start").collect()
    assert [r.row_start for r in got] == [3, 5]
    assert got[0].text == "Workbook: w.xlsx\nSheet: Rules\nRow: 3\n  Rule ID: 7.1325001E7\n  B: A1+1\n" and got[0].fields["ruleId"] == "7.1325001E7"
    assert got[1].text.endswith("x" * 2000 + "...\n")


def test_bm25_numbers(spark):
    t = lambda tf, df, n=10: keyword.bm25_term(F.lit(tf), F.lit(5), F.lit(df), F.lit(n), F.lit(4.0))
    r = one(spark, t(2, 3), t(2, 3) + t(1, 9), t(1, 3, 1))
    assert [round(x, 6) for x in r] == [1.471119, 1.604120, -0.507693]


def test_rrf(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3)], "qid int, chunk_id int, score double, rank int")
    k = spark.createDataFrame([(1, 10, 5.0, 1), (1, 13, 4.0, 2)], "qid int, chunk_id int, bm25 double, rank int")
    got = fusion.rrf(v, k, 10).orderBy("rank").collect()
    assert [(r.chunk_id, r.match_type) for r in got] == [(10, "HYBRID"), (11, "VECTOR"), (13, "KEYWORD"), (12, "VECTOR")]
    assert round(got[0].combined_score, 6) == 0.032787
    swapped = fusion.rrf(k.withColumnRenamed("bm25", "score"), v.withColumnRenamed("score", "bm25"), 10)
    assert {r.chunk_id: r.combined_score for r in swapped.collect()} == {r.chunk_id: r.combined_score for r in got}


def test_fallback(spark):
    chunks = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, "catalog", [0.0, 1.0]), (3, "general", [1.0, 0.1]), (4, "general", [0.0, 0.0])], "chunk_id int, category string, embedding array<float>")
    q = spark.createDataFrame([(1, "show SVC_007", [1.0, 0.0]), (2, "refund policy", [1.0, 0.0])], "qid int, question string, embedding array<float>")
    from siftwell.config import Retrieval

    got = {(r.qid, r.chunk_id, r.fallback) for r in vector.routed(q, chunks, 5, Retrieval(min_score=0.6)).collect()}
    assert got == {(1, 1, True), (1, 3, True), (2, 3, False)}
    off = vector.routed(q, chunks, 5, Retrieval(min_score=0.6, fallback_when_empty=False)).collect()
    assert {(r.qid, r.chunk_id) for r in off} == {(2, 3)}
    assert vector.routed(q, chunks, 5, Retrieval(min_score=0.6, routing=False)).count() == 4


def test_boost_and_order(spark):
    c = spark.createDataFrame([("a", 3, 0), ("b", 10, 0), ("c", 0, 10), ("d", 1, 1)], "source string, up int, down int")
    assert {r.source: round(r.boost, 6) for r in feedback.boosts(c).collect()} == {"a": 0.09, "b": 0.2, "c": -0.2, "d": 0.0}
    m = spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate("xaxx")], "qid int, chunk_id int, source string, rank int")
    b = spark.createDataFrame([("a", 0.2)], "source string, boost double")
    got = rerank.feedback_order(m, b).orderBy("rank").collect()
    assert [round(r.adjusted, 6) for r in got] == [1.0, 0.95, 0.5, 0.25] and [r.final_rank for r in got] == [1, 2, 3, 4]


def test_rerank_is_a_permutation_and_fails_open(spark):
    from siftwell.config import Rerank

    m = spark.createDataFrame([(q, "q", i, f"text {i}", 0.5, i + 1) for q in (1, 2) for i in range(5)] + [(3, "q", 0, "t", 0.5, 1)], "qid int, question string, chunk_id int, text string, score double, rank int")
    rerank.register_provider("by_length", lambda q, ts: [float(-i) for i in range(len(ts))][::-1])
    got = rerank.rerank(m, Rerank(provider="by_length")).collect()
    assert {q: sorted(r.new_rank for r in got if r.qid == q) for q in (1, 2)} == {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5]}

    def fails(q, ts):
        raise OSError("down")

    rerank.register_provider("down", fails)
    assert all(r.new_rank == r.rank for r in rerank.rerank(m, Rerank(provider="down")).collect())
    with pytest.raises(Exception, match="down"):
        rerank.rerank(m, Rerank(provider="down", fail_open=False)).collect()
    assert each(spark, rerank.parse_llm_score, ["10/10", "-5", "none", "99999999999", None]) == [10, 5, 0, 0, 0]


def test_text(spark):
    assert each(spark, T.excerpt, ["a" * 300, "b"]) == ["a" * 200 + "...", "b..."]
    r = one(spark, T.parse_vector_text(F.lit("'error':1,7 'code':3 'it''s':2")), T.parse_vector_text(F.lit(" ")))
    assert r[0] == {"error": 2, "code": 1, "it's": 1} and r[1] == {}
    joined = each(spark, lambda c: T.recursive_pieces(c, 20, 0), ["a b c " * 20, "x" * 90, "p\n\nq. r s\n" * 9, "", "é日 " * 30])
    assert ["".join(x) for x in joined] == ["a b c " * 20, "x" * 90, "p\n\nq. r s\n" * 9, "", "é日 " * 30]
    assert all(len(p) <= 20 for x in joined for p in x)
    w = one(spark, T.windows(F.lit("abcdefghij"), 4, 1))[0]
    assert [x.text for x in w] == ["abcd", "defg", "ghij"]
    assert each(spark, T.html_text, ["<html><head><title>t</title></head><body><script>x<y</script><p>a&amp;b</p>\n<!-- c -->d</body>", None]) == ["a&b d", ""]
    assert each(spark, lambda c: F.array_join(T.tokens(c, "english"), " "), ["The cats were running boxes"]) == ["cat run box"]


def test_history_and_prompt(spark):
    rows = [("s", i, "USER" if i % 2 == 0 else "system", f"m{i}") for i in range(14)]
    m = spark.createDataFrame(rows, "session_id string, created_at int, role string, content string")
    assert conversation.history_block(m).head().history == "\n".join(f"{'User' if i % 2 == 0 else 'Assistant'}: m{i}" for i in range(4, 14))
    long = spark.createDataFrame([("s", 1, "USER", "x" * 5000)], m.schema)
    h = conversation.history_block(long).head().history
    assert h == "...\n" + "x" * 4000
    p = one(spark, conversation.prompt(F.lit("q"), F.lit("c"), F.lit(" ")), conversation.prompt(F.lit("q"), F.lit("c"), F.lit("User: a")))
    assert "Conversation so far" not in p[0] and "User: a\n\nContext:\nc\n\nQuestion: q\n\nAnswer:\n" in p[1]
    a = spark.createDataFrame([("s", 1, "ASSISTANT", "a"), ("s", 2, "USER", "q1"), ("s", 3, "USER", "q2"), ("s", 4, "ASSISTANT", "b")], m.schema)
    assert [r.question for r in conversation.preceding_question(a).orderBy("created_at").collect()] == [None, "q2"]
    none = answers.answer(answers.prompts(spark.createDataFrame([(1, "q")], "qid int, question string"), spark.createDataFrame([], "qid int, text string, source string, rank int"))).head()
    assert none.answer == conversation.NO_ANSWER and none.sources == [] and not none.cacheable


def test_commits_and_sprints(spark):
    s = history.generate_sprints(spark, dt.date(2024, 1, 1), 3).collect()
    assert [(r.start_date.day, r.end_date.isoformat()) for r in s] == [(1, "2024-01-14"), (15, "2024-01-28"), (29, "2024-02-11")]
    walked = spark.createDataFrame([("r", h, i) for i, h in enumerate("edcba")], "repository_id string, commit_hash string, position int")
    known = spark.createDataFrame([("r", "c")], "repository_id string, commit_hash string")
    assert [r.commit_hash for r in history.new_commits(walked, known).orderBy("position").collect()] == ["e", "d"]
    assert history.new_commits(walked, known, cap=1).count() == 1
    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 14, 23, 59, 59), dt.datetime(2024, 1, 15)]
    c = spark.createDataFrame([("r", str(i), "n", "e", t) for i, t in enumerate(at)], "repository_id string, commit_hash string, author_name string, author_email string, commit_date timestamp_ntz")
    sp = spark.createDataFrame([("1", dt.date(2024, 1, 1), dt.date(2024, 1, 14), " "), ("2", dt.date(2024, 1, 15), dt.date(2024, 1, 15), "q"), ("3", dt.date(2024, 1, 15), dt.date(2024, 1, 15), None)], "id string, start_date date, end_date date, repository_id string")
    assert {r.id: r.total for r in history.sprint_report(sp, c).collect()} == {"1": 2, "2": 0, "3": 1}
    assert {r.id: r.total for r in history.sprint_report(sp, c, "none").collect()} == {"1": 2, "2": 0, "3": 0}
    with pytest.raises(ValueError):
        history.in_range(c, dt.date(2024, 2, 1), dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        history.check_sprint(" ", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert each(spark, history.repository_name, ["https://h/a/b.git", "git@h:a/b", "x/"]) == ["a/b", "a/b", "x"]


def test_batch_status(spark):
    df = spark.createDataFrame([(2, 2, 0), (2, 0, 2), (2, 1, 1), (3, 1, 1)], "t int, g int, b int")
    assert [r[0] for r in df.select(ingest.batch_status(F.col("t"), F.col("g"), F.col("b"))).collect()] == ["COMPLETED", "FAILED", "COMPLETED_WITH_ERRORS", "RUNNING"]


def test_cache(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    log = [(1, "k", t(0), "get"), (2, "k", t(30), "get"), (3, "k", t(60), "get"), (4, "k", t(70), "evict"), (5, "k", t(71), "get"), (6, None, t(72), "clear"), (7, "k", t(73), "get"), (8, "j", t(73), "get")]
    got = {r.request_id: r.hit for r in cache.simulate(spark.createDataFrame(log, "request_id int, key string, ts timestamp_ntz, kind string")).filter("kind = 'get'").collect()}
    # written at 0, so 60 is a miss although 30 was a hit
    assert got == {1: False, 2: True, 3: False, 5: False, 7: False, 8: False}
    assert each(spark, cache.cache_key, ["  What \n is X? ", None]) == ["what is x?", ""]


def test_bot(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    e = [
        (1, "r", t(0), "message", None, None, "@bot what is this", "p"),
        (2, "r", t(1), "message", None, None, "👍", "p"),
        (3, "r", t(2), "message", None, None, "👍", "p"),
        (4, "r", t(3), "message", None, None, "👎", "p"),
        (5, "r", t(999), "message", None, None, "skip", "p"),
        (6, "r", t(1000), "action", "i9", "up", None, "p"),
        (7, "r", t(1001), "message", None, None, "skip", "p"),
        (8, "r", t(1002), "action", "i9", "bad", None, "p"),
        (9, "q", t(0), "message", None, None, "👎", "p"),
        (10, "q", t(0), "message", None, None, "mine", "me"),
    ]
    df = spark.createDataFrame(e, "event_id bigint, room_id string, ts timestamp_ntz, kind string, interaction_id string, rating string, text string, person_id string")
    got = {r.event_id: r.action for r in bot.route_events(bot.relevant(df, "me")).collect()}
    assert got == {1: "question", 2: "vote", 3: "comment", 4: "vote", 5: "question", 6: "vote", 7: "skip", 8: "reject", 9: "nothing_to_rate"}
    import hashlib
    import hmac

    sig = hmac.new(b"k", b"body", hashlib.sha1).hexdigest()
    s = spark.createDataFrame([("body", sig), ("body", "x"), ("body", None)], "b string, s string")
    assert [r[0] for r in s.select(bot.signature_udf("k")("b", "s")).collect()] == [True, False, False]
    assert [r[0] for r in s.select(bot.signature_udf(None)("b", "s")).collect()] == [True] * 3


def test_distances_are_symmetric(spark):
    assert math.isclose(one(spark, vector.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))[0], 11.0)
    with pytest.raises(ValueError):
        keyword.bm25(None, None, None, mode="xor")
