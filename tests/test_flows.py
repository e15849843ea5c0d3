"""Folders, streams and the engine end to end."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell.config import Config, Hybrid
from siftwell.engine import Engine
from siftwell.operators import bot, ingest
from siftwell.sources import files, office
from siftwell.streaming import streams


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f'<w:p><w:r><w:t>{line}</w:t></w:r></w:p>' for line in text.split("\n"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Rules" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Rule ID</t></si><si><t>Rule Name</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2"><f>A2+1</f><v>8</v></c><c r="C2" s="1"><v>45292</v></c><c r="AA2" t="b"><v>1</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in" / "sub"
    d.mkdir(parents=True)
    (d / "note.txt").write_text("plain words about refunds and returns")
    (d / "x_FDS_v2.docx").write_bytes(docx("functional design\nof refunds"))
    (d / "Rules.XLSX").write_bytes(xlsx())
    (d / "bad.docx").write_bytes(b"no zip")
    (d / "old.doc").write_bytes(b"\xd0\xcf")
    (d / "skip.exe").write_bytes(b"x")
    return tmp_path / "in"


def test_office():
    assert office.docx_text(docx("a\nb")) == "a\nb"
    cells = list(office.xlsx_cells(xlsx()))
    assert ("Rules", 1, 0, "number", "7") in cells and ("Rules", 1, 1, "formula", "A2+1") in cells and ("Rules", 1, 26, "boolean", "true") in cells
    assert ("Rules", 1, 2, "date", "2024-01-01T00:00:00") in cells
    assert office.flat_cells(cells) == "=== Sheet: Rules ===\nRule ID | Rule Name\n7.0 | A2+1 | 2024-01-01T00:00:00 | true"
    with pytest.raises(office.Unsupported):
        office.read_text("a.doc", "DOCX", b"")


def test_folder_to_answer(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    report = e.ingest_folder(str(folder), "b1").head()
    assert (report.total_files, report.success_count, report.failure_count, report.pending_count, report.status) == (5, 3, 2, 0, "COMPLETED_WITH_ERRORS")
    kinds = {r.category for r in e.table("chunks").select("category").distinct().collect()}
    assert kinds == {"catalog", "fds", "general"}
    assert e.table("failure").filter("error_message like '%installed%'").count() == 1
    q = spark.createDataFrame([(1, "refund policy", "s1"), (2, "show SVC_007", "s2")], "qid int, question string, session_id string")
    got = {r.qid: r for r in e.answer(q).collect()}
    assert got[1].cacheable and any("note.txt" in s for s in got[1].sources)
    asked = q.selectExpr("qid", "'plain words' as question")
    off = Engine(spark, str(tmp_path / "store"), Config(hybrid=Hybrid(enabled=False)))
    assert off.hybrid_search(asked, 3).filter("match_type <> 'VECTOR'").count() == 0
    assert e.hybrid_search(asked, 3).filter("match_type <> 'VECTOR'").count() > 0
    assert e.hybrid_search(q.selectExpr("qid", "'plain words' as question"), 3).count() > 0
    e.save_messages(spark.createDataFrame([("s1", "ASSISTANT", "a", "i1", ["x"], dt.datetime(2024, 1, 1))], "session_id string, role string, content string, interaction_id string, sources array<string>, created_at timestamp_ntz"))
    lost = e.submit_feedback(spark.createDataFrame([("i1", "UP", dt.datetime(2024, 1, 2)), ("i2", "UP", dt.datetime(2024, 1, 2))], "interaction_id string, rating string, created_at timestamp_ntz"))
    assert [r.interaction_id for r in lost.collect()] == ["i2"]
    e.add_comment(spark.createDataFrame([("i1", "fine")], "interaction_id string, comment string"))
    assert e.table("feedback").head().comment == "fine" and e.feedback_stats()[1].head().boost == 0.03
    assert e.backfill_metadata().head().scanned == 1 and e.unclassified_sheets().count() == 0 and e.range_warnings().count() == 0
    e.clear_session("s1")
    assert e.table("messages").count() == 0
    before = e.table("documents").count()
    e.ingest_documents(spark.createDataFrame([("new.txt", "new.txt", "TXT", "t")], "source string, name string, type string, text string"))
    e.ingest_documents(spark.createDataFrame([("new.txt", "new.txt", "TXT", "t")], "source string, name string, type string, text string"))
    assert e.table("documents").count() == before + 1
    e.delete_document(e.table("documents").filter("source = 'new.txt'").head().id)
    assert e.table("documents").count() == before and e.table("chunks").filter("source = 'new.txt'").count() == 1
    assert e.reranker_status()["provider"] == "none"
    e.generate_sprints(dt.date(2024, 1, 1), 2)
    assert e.all_sprint_reports().count() == 2
    with pytest.raises(ValueError):
        e.table("a b")


def test_workbooks_fail_alone_and_may_share_a_name(spark, tmp_path):
    for sub in ("a", "b"):
        (tmp_path / "in" / sub).mkdir(parents=True)
        (tmp_path / "in" / sub / "book.xlsx").write_bytes(xlsx())
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "in" / "note.txt").write_text("plain")
    e = Engine(spark, str(tmp_path / "store"))
    report = e.ingest_folder(str(tmp_path / "in"), "b1").head()
    assert (report.success_count, report.failure_count, report.status) == (3, 1, "COMPLETED_WITH_ERRORS")
    assert [r.file_name for r in e.table("failure").collect()] == ["bad.xlsx"]
    rows = e.table("chunks").filter("type = 'EXCEL'").collect()
    assert len({r.source for r in rows}) == 2 and {r.workbook for r in rows} == {"book.xlsx"} and len({r.chunk_id for r in rows}) == 2


def test_a_sync_returns_what_it_stored(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    walk = lambda lo, hi: spark.createDataFrame([("r", f"h{i}", hi - i) for i in range(lo, hi)], "repository_id string, commit_hash string, position int")
    assert e.sync_commits(walk(0, 500)).count() == 500
    assert {r.commit_hash for r in e.sync_commits(walk(0, 800)).collect()} == {f"h{i}" for i in range(500, 800)}
    assert e.sync_commits(walk(0, 800)).count() == 0
    assert e.table("commits").count() == 800 and e.table("commits").select("commit_hash").distinct().count() == 800


def test_a_replaced_table_is_there_at_all_times(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("d", "s")], "id string, source string")
    e._append("documents", one)
    before = e.table("documents")
    e.delete_document("d")
    assert before.count() == 1 and e.table("documents").count() == 0
    e._append("documents", one)
    e._replace("documents", e.table("documents").union(e.table("documents")))
    assert e.table("documents").count() == 2
    assert e.tables().filter("stored").select("table").distinct().count() == 1


def test_postings_cut_a_text_into_words_once(spark):
    from siftwell.operators import keyword

    words = [f"w{i % 5000}" for i in range(100_000)]
    index = keyword.postings(spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "a a b")], "chunk_id bigint, text string"))
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "array_distinct" not in plan[: plan.index("Generate")]
    assert index.filter("chunk_id = 1 and dl = 5000 and tf = 20").count() == 5000
    assert {(r.term, r.tf, r.dl) for r in index.filter("chunk_id = 3").collect()} == {("a", 2, 2), ("b", 1, 2)}


def test_windows_of_a_long_text(spark):
    from siftwell.functions import text

    long = "".join(chr(97 + i % 26) + "é🙂"[i % 2] for i in range(9000))
    got = spark.createDataFrame([(long,), ("x" * 4096,), ("",), (None,)], "t string").select(text.windows(F.col("t"), 700, 30).alias("w")).collect()
    for row, t in zip(got, [long, "x" * 4096], strict=False):
        assert [w.text for w in row.w] == [t[i : i + 700] for i in range(0, len(t) - 30, 670)]
    assert got[2].w is None and got[3].w is None


def test_empty_folder(spark, tmp_path):
    (tmp_path / "x.exe").write_bytes(b"")
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path))


def test_what_a_stream_ingests_the_engine_finds(spark, folder, tmp_path):
    root = str(tmp_path / "s")
    streams.ingest_stream(streams.file_stream(spark, str(folder)), root, str(tmp_path / "cp")).awaitTermination()
    e = Engine(spark, root)
    assert e.table("success").count() == 3 and e.table("failure").count() == 2
    found = e.retrieve(spark.createDataFrame([(1, "refunds and returns"), (2, "show Rule ID 7")], "qid int, question string")).collect()
    assert any("note.txt" in r.source for r in found if r.qid == 1) and any(r.type == "EXCEL" and r.fields for r in found if r.qid == 2)
    # the same tables as of a folder
    other = Engine(spark, str(tmp_path / "o"))
    other.ingest_folder(str(folder), "b")
    rows = lambda x: sorted((r.source.rpartition("/")[2], r.text, r.category, r.sheet or "", r.row_start or 0) for r in x.table("chunks").collect())
    assert rows(e) == rows(other)
    # another file, and batches that are tried again before and after they are taken in
    (folder / "more.txt").write_text("more words")
    streams.ingest_stream(streams.file_stream(spark, str(folder)), root, str(tmp_path / "cp")).awaitTermination()
    n = e.table("chunks").count()
    assert n == other.table("chunks").count() + 1
    batch = files.scan(spark, str(folder)).filter("name = 'more.txt'")
    e.ingest_batch(batch, "files", 1)
    assert e.table("chunks").count() == n
    e.compact("chunks")
    e.ingest_batch(batch, "files", 1)
    assert e.table("chunks").count() == n
    e.delete_chunks(e.table("documents").filter("name = 'more.txt'").head().source)
    e.ingest_batch(batch, "files", 2)
    assert e.table("chunks").count() == n and len([f for f in (tmp_path / "s" / "chunks").iterdir() if f.name.startswith("v")]) == 2


def test_bot_stream_equals_batch(spark, tmp_path):
    said = ["@bot hi", "👍", "because", "👎", "skip"]
    rows = [(i, f"r{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "message", None, None, said[(i // 3) % 5], "p") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, room_id string, ts timestamp_ntz, kind string, interaction_id string, rating string, text string, person_id string")
    df.repartition(1).write.parquet(str(tmp_path / "e"))
    got = streams.drain(streams.route_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))))
    want = bot.route_events(df)
    key = lambda d: sorted((r.event_id, r.action, r.interaction_id) for r in d.collect())
    assert key(got) == key(want)


def test_cache_and_window_streams(spark, tmp_path):
    rows = [(i, "k", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=25 * i), "click", 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "request_id bigint, key string, ts timestamp, event_type string, value double")
    df.repartition(1).write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    hits = {r.request_id: r.hit for r in streams.drain(streams.cache_stream(read())).collect()}
    assert hits == {0: False, 1: True, 2: True, 3: False, 4: True, 5: True}
    w = streams.drain(streams.event_windows(read()), mode="complete").collect()
    assert sorted(r.n for r in w) == [1, 2, 3] or sum(r.n for r in w) == 6
    streams.outbox_sink(read().select("request_id"), str(tmp_path / "o"), str(tmp_path / "oc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 6


def test_votes_and_progress_of_a_stream(spark, tmp_path):
    from siftwell.operators import feedback

    at = dt.datetime(2024, 1, 1)
    rows = [("i1", "s", "UP", "", ["a"], at), ("i1", "s", "DOWN", "", ["a"], at + dt.timedelta(seconds=1)), ("i2", "s", "UP", "", ["b"], at)]
    df = spark.createDataFrame(rows, "interaction_id string, session_id string, rating string, comment string, sources array<string>, created_at timestamp_ntz")
    df.repartition(1).write.parquet(str(tmp_path / "v"))
    query = streams.votes_upsert(spark.readStream.schema(df.schema).parquet(str(tmp_path / "v")), str(tmp_path / "o"), str(tmp_path / "c"))
    query.awaitTermination()
    assert {(r.interaction_id, r.rating) for r in feedback.latest(spark.read.parquet(*ingest.folders(spark, str(tmp_path / "o")))).collect()} == {("i1", "DOWN"), ("i2", "UP")}
    told = []
    streams.stage_log(query, lambda stage, facts: told.append((stage, facts["rows"])))
    assert ("batch 0", 3) in told


def plain_pieces(text, size, overlap, separators=("\n\n", "\n", ". ", " ")):
    import re

    if len(text) <= size:
        return [text] if text else []
    if not separators:
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), size - overlap)]
    out, held = [], ""
    for part in re.findall(f"(?s).*?{re.escape(separators[0])}|.+", text):
        if held and len(held) + len(part) > size:
            out.append(held)
            held = held[-overlap:] if overlap and len(part) + overlap <= size else ""
        if len(part) > size:
            out.extend(plain_pieces(part, size, overlap, separators[1:]))
        else:
            held += part
    return [*out, held] if held else out


@pytest.mark.parametrize("size,overlap", [(20, 0), (7, 0), (1, 0), (20, 4), (50, 10)])
def test_recursive_pieces_of_a_text(spark, size, overlap):
    import random

    from siftwell.functions.text import recursive_pieces

    rng = random.Random(size)
    texts = ["", "one", "A first line. And more.\nA second line\n\nA new paragraph, with a verylongwordwithoutanybreak in it.\n\n\n\n", "é🙂 " * 30, "\n" * 45]
    texts += ["".join(rng.choice(["a", "bc", "word", " ", " ", ". ", "\n", "\n\n", "é", "🙂"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", recursive_pieces(F.col("t"), size, overlap).alias("p")).collect()
    for text, got in rows:
        assert got == plain_pieces(text or "", size, overlap)
        assert all(0 < len(p) <= size for p in got)
        if not overlap:
            assert "".join(got) == (text or "")
        # a piece goes on where the one before ended, or says up to ``overlap`` of its end again
        ends = {0}
        for p in got:
            ends = {e - k + len(p) for e in ends for k in range(min(overlap, e) + 1) if text.startswith(p, e - k)}
        assert len(text or "") in ends


def test_plans(spark):
    ev = '{"resource":"messages","event":"created","data":{"roomId":"r","text":"t"},"unknown":1}'
    r = spark.range(1).select(bot.parse_events(F.lit(ev)).alias("e")).select("e.resource", "e.data.roomId").head()
    assert tuple(r) == ("messages", "r")
    tun = spark.createDataFrame([(0, "http://a"), (1, "https://b"), (2, "https://c")], "position int, public_url string")
    assert bot.first_tunnel(tun).head().public_url == "https://b"


@pytest.mark.parametrize("splits", [1, 3, 7])
def test_running_vote_counts_after_votes_again(spark, tmp_path, splits):
    import random

    from siftwell.operators import feedback

    rng, at = random.Random(splits), dt.datetime(2024, 1, 1)
    rows = [(f"i{rng.randrange(12)}", "s", rng.choice(["UP", "DOWN"]), "", rng.choice([["a"], ["a", "b"], ["b", "b"], [], None]), at + dt.timedelta(seconds=n)) for n in range(120)]
    kind = "interaction_id string, session_id string, rating string, comment string, sources array<string>, created_at timestamp_ntz"
    rng.shuffle(rows)  # some votes come late
    e = Engine(spark, str(tmp_path / "s"))
    want = lambda seen: {tuple(r) for r in feedback.source_votes(feedback.latest(spark.createDataFrame(seen, kind))).collect()}
    seen = []
    for n in range(splits):
        own = rows[n::splits]
        seen += own
        spark.createDataFrame(own, kind).repartition(1).write.mode("append").parquet(str(tmp_path / "v"))
        for q in streams.votes_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "v")), e.root, str(tmp_path / "c")):
            q.awaitTermination()
        assert {tuple(r) for r in e.source_counts().collect()} == want(seen)
    assert {tuple(r) for r in feedback.boosts(e.source_counts()).collect()} == {tuple(r) for r in e.feedback_stats()[1].collect()}
    assert {tuple(r) for r in feedback.added(feedback.vote_deltas(spark.createDataFrame(rows, kind))).collect()} == want(rows)
    e.rebuild_vote_counts()
    assert {tuple(r) for r in e.source_counts().collect()} == want(rows)


def test_range_warnings_are_worked_out_once(spark):
    from siftwell.functions import headers
    from siftwell.operators import sheets

    rows = [("1", {"ruleId": "950", "ruleIdRangeStart": "100", "ruleIdRangeEnd": "900"}), ("2", {"ruleId": "200", "ruleIdRangeStart": "100", "ruleIdRangeEnd": "900"}), ("3", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, fields map<string,string>").selectExpr("*", "'w' AS workbook", "'s' AS sheet", "1 AS row_start", "1 AS row_end")
    out = sheets.range_warnings(chunks.withColumn("fields", headers.with_warnings(chunks.fields)), None)
    assert [(r.chunk_id, r.warnings) for r in out.collect()] == [("1", "ruleId=950 is outside its sheet's documented range (100-900)")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("documented range (%s-%s)") == 1
