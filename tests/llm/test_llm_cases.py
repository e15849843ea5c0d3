"""Brute force, round trips, held-out accuracy and awkward input, operator by
operator."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import _shared, ann, bpe, decontam, graph, minhash, pii, preference, quality, textstats, toxicity, urltree, warc

from ..conftest import SF

#: Names that the operators use themselves.
CLASHES = "row_id string, t string, score string, votes string, stats string, sig string, rep string, root string, words string, ids string, n_tokens string, host2 string, label string, cuts string"


def awkward(spark, extra=()):
    """Nulls, empty, blank and long texts, repeats, clashing extra columns."""
    texts = [None, "", "  \n ", "a", "one two", "Same Words here again and so on to the end", "same words HERE again and so on to the end", "x" * 70_000, "word " * 30_000, "é日本 " * 50, *extra]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(3, "a", None, None, None), (None, None, None, None, None), (None, "some text without an id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHES.split(", "):
        df = df.withColumn(c.split()[0], F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def labels(spark, rows=(), name="label"):
    return spark.createDataFrame(list(rows), f"doc_id bigint, {name} int")


# bpe


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def stretches(rng):
    """Makers of text of about a length: unsplit runs of each kind, mixtures of
    contractions, spaces and marks, special tokens, any characters."""
    return [
        lambda n: "a" * n, lambda n: "".join(rng.choice("abcdeth") for _ in range(n)), lambda n: " " * n, lambda n: "".join(rng.choice("!?'s.,") for _ in range(n)),
        lambda n: "<|endoftext|>" * (n // 50) + " x", lambda n: "".join(rng.choice(["'re", " ", "\n", "x", "9", "　", "🙂"]) for _ in range(n)), lambda n: "日本語" * (n // 3),
        lambda n: "".join(rng.choice("0123456789") for _ in range(n)), lambda n: "".join(rng.choice(["one ", "two, ", "it's ", "don't", "12", "\n\n", "。", "中文字符"]) for _ in range(n // 3)),
        lambda n: "éèüñ" * (n // 4), lambda n: "ءآأ" * (n // 3), lambda n: "=-" * (n // 2), lambda n: "\t \n" * (n // 3), lambda n: "".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x1F900)])) for _ in range(n // 8)),
    ]


def test_tree_concatenation_is_exact():
    tok, enc, rng = library(), bpe.load(bpe.default_tokenizer()), random.Random(7)
    parts = stretches(rng)
    for _ in range(800):
        text = "".join(rng.choice(parts)(rng.randrange(1, 1500)) for _ in range(rng.randrange(1, 4)))
        leaf = rng.choice([5, 17, 64, 700])
        ids, joins = enc.encode(text, leaf)
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
        assert "<|endoftext|>" in text or joins >= len(text) // leaf - 1


def test_joins_of_unsplit_text_encode_little_anew(monkeypatch):
    """In a run without any border a join encodes a window, not the sides."""
    enc, done = bpe.load(bpe.default_tokenizer()), []
    again = bpe.Encoder._agreed

    def counted(self, left, right, text, mid, w):
        done.append(w)
        return again(self, left, right, text, mid, w)

    monkeypatch.setattr(bpe.Encoder, "_agreed", counted)
    rng = random.Random(3)
    for letters in ("etaoinshr", "0123456789", "=-+*/", "日本語中文"):
        done.clear()
        text = "".join(rng.choice(letters) for _ in range(60_000))
        ids, joins = enc.encode(text)
        assert enc.decode(ids.tolist()).decode() == text and joins == 31
        assert max(done) <= 512 and len(done) < 3 * joins


def test_scan_is_the_library_s_for_every_character():
    tok, enc = library(), bpe.load(bpe.default_tokenizer())
    texts = ["".join(f"a{c}a 1{c}1 {c}!{c} {c}{c}  x" for c in map(chr, range(at, min(at + 64, 0x110000))) if not 0xD800 <= ord(c) < 0xE000) for at in range(0, 0x110000, 64)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for e, t in zip(tok.encode_batch_fast(part, add_special_tokens=False), part, strict=True):
            assert enc.encode(t, 1 << 20)[0].tolist() == e.ids


def test_other_tokenizers_are_refused(tmp_path):
    import json

    spec = json.load(open(bpe.default_tokenizer(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "t.json"))


def test_texts_over_4096_characters_are_made_by_the_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = bpe.encode(docs, ids=False).join(docs, "doc_id").withColumn("n", F.char_length("text"))
    assert got.filter("n > 4096").count() == got.filter("n > 4096 and n_joins > 1").count() == 144
    assert got.filter("n <= 2048 and n_joins > 0").count() == 0


def test_bpe_round_trip(spark):
    df = awkward(spark, ["<|endoftext|>", "'re <|endoftext|> x"])
    ids = bpe.encode(df, leaf_chars=1000, keep=("doc_id",))
    back = {(r.doc_id, r.text) for r in bpe.decode(ids).collect()}
    assert back == {(r.doc_id, r.text or "") for r in df.collect()}
    tok = library()
    texts = {r.doc_id: r.text for r in df.filter("doc_id is not null").collect()}
    for r in bpe.encode(df.filter("doc_id is not null"), ids=False, digests=True).collect():
        want = np.array(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(empty(spark)).count() == 0


def test_decoding_is_the_library_s():
    tok, enc, rng = library(), bpe.load(bpe.default_tokenizer()), random.Random(5)
    for _ in range(500):
        ids = [rng.randrange(rng.choice([300, 50_257])) for _ in range(rng.randrange(40))]
        assert enc.decode(ids).decode() == tok.decode(ids, skip_special_tokens=False)
    assert enc.decode([50_256, 10**6, 72]).decode() == tok.decode([50_256, 10**6, 72], skip_special_tokens=False)


def test_long_texts_are_encoded_by_several_tasks(spark):
    tok, rng = library(), random.Random(8)
    parts = stretches(rng)
    texts = ["".join(rng.choice(parts)(rng.randrange(1, 4000)) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    texts += ["some plain words, said again and again " * 5_000, "q" * 100_000, "short", "", None, "<|endoftext|>" * 400]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id bigint, text string").withColumn("row", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    for size in (700, 30_000):
        got = bpe.encode(df, part_chars=size, leaf_chars=300).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            assert r.ids == tok.encode(texts[4 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids
    long = df.filter("doc_id = 25").select(F.lit(0).cast("bigint").alias("row"), F.col("text").alias("_text"))
    tasks = bpe._parts_of(long, bpe.default_tokenizer(), 30_000).withColumn("task", F.spark_partition_id())
    assert tasks.count() == 7 and tasks.select("task").distinct().count() > 1


# warc


def test_warc_segments_and_chunks(spark, tmp_path, monkeypatch):
    long = "é<p>日</p>\r\n\r\n0\r\n" * 20_000
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "u\r\nInjected: 1", long), (4, "u", long), (4, "u", long), (None, "n", "y" * 2000), (5, "n", "y" * 2000), (6, "s", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_archive(df, path, segment_bytes=5000, records_per_file=7)
    read = warc.read_archive(spark, path).cache()
    assert read.count() == len(rows) and read.filter("not ok").count() == 0
    got = {r.page_id: (r.record_type, r.refers_to) for r in read.collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("revisit", 5), 5: ("response", None), 6: ("response", None)}
    assert bytes(read.filter("page_id = 4").head().payload) == long.encode()
    d = {r.page_id: r for r in warc.digest_rows(read).collect()}
    assert d[3].payload_bytes == len(long.encode()) and d[3].payload_digest == hashlib.sha1(long.encode()).hexdigest()
    monkeypatch.setattr(warc, "RUN_BYTES", 1)
    parts = warc.read_records(spark, path).filter("segment is not null").cache()
    assert parts.filter("segment > 1").count() > 50
    assert warc.reassemble(parts).filter("block is not null").count() == 2
    assert warc.reassemble(parts.filter("segment <> 3")).filter("block is not null").count() == 0
    assert warc.reassemble(parts.unionByName(parts.filter("segment = 2"))).filter("block is not null").count() == 0
    assert warc.reassemble(parts.filter("total_length is null")).filter("block is not null").count() == 0
    assert warc.dechunked(b"5\r\nab") is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"2;x\r\nab\r\n0\r\n\r\n") == b"ab"


def small_archive():
    """Content of a file, where each record ends, and how many pages are whole by then."""
    rows = [(1, "http://a/", "x"), (2, "http://b/", "é<p>" * 300), (3, None, ""), (4, "http://d/", "y" * 700)]
    data, ends, whole = b"", [], []
    for serial, (i, url, html) in enumerate(rows, 1):
        records = list(warc.page_records(i, url, html, hashlib.sha1(html.encode()).hexdigest(), None, serial, 300))
        for n, r in enumerate(records, 1):
            data += r.encode() + b"\r\n\r\n"
            ends.append(len(data) - 4)
            whole.append(serial if n == len(records) else serial - 1)
    return data, ends, whole


def test_warc_cut_at_every_byte():
    data, ends, whole = small_archive()
    every = list(warc.parse(data))
    assert len(every) == len(ends) and all(b is not None for _, b in every)
    for cut in range(len(data)):
        got = list(warc.parse(data[:cut]))
        n = sum(e <= cut for e in ends)
        assert got[:n] == every[:n] and len(got) <= n + 1 and all(b is None for _, b in got[n:])
        # a damaged byte costs the record that it lies in, at most
        hurt = list(warc.parse(data[:cut] + bytes([data[cut] ^ 1]) + data[cut + 1 :]))
        at = sum(e + 4 <= cut for e in ends)
        assert hurt[:at] == every[:at] and hurt[len(hurt) - len(every) + at + 2 :] == every[at + 2 :]
        for x in (data[:cut], hurt):
            list(warc.records_of(x if isinstance(x, bytes) else data[:cut][::-1]))


def test_warc_files_cut_short_do_not_stop_a_read(spark, tmp_path):
    import gzip

    data, ends, whole = small_archive()
    packed = gzip.compress(data)
    for n, cut in enumerate([0, 10, ends[0] - 1, ends[0] + 2, ends[2] + 30, ends[3] + 1, len(data) // 2, len(data) - 200, len(data)]):
        (tmp_path / f"c{n}").mkdir()
        (tmp_path / f"c{n}" / "part-0").write_bytes(data[:cut])
        rows = warc.read_archive(spark, str(tmp_path / f"c{n}")).collect()
        done = max((w for e, w in zip(ends, whole, strict=True) if e <= cut), default=0)
        assert sorted(r.page_id for r in rows if r.ok) == list(range(1, done + 1)) and all(r.payload is None for r in rows if not r.ok)
        assert len(rows) - done in (0, 1, 2)
    # files of one archive: whole, packed and cut short, without the first segment of a record, no archive
    d = tmp_path / "many"
    d.mkdir()
    other = data.replace(b"urn:x-page:", b"urn:y-page:").replace(b"X-Page-Id: ", b"X-Page-Id: 1")
    for name, content in (("part-0", data), ("part-1", gzip.compress(other)[: len(packed) // 2]), ("part-2", data.replace(b"urn:x-page:", b"urn:z-page:")[ends[1] + 4 : ends[2] + 4]), ("part-3", b"no archive at all"), ("part-4", b"")):
        (d / name).write_bytes(content)
    rows = warc.read_archive(spark, str(d)).collect()
    assert {r.page_id for r in rows if r.ok} >= {1, 2, 3, 4} and any(r.record_id.startswith("urn:z-page:2") and not r.ok and r.record_type is None for r in rows if r.record_id)
    assert any(r.record_id is None and not r.ok for r in rows) and len([r for r in rows if r.ok and r.page_id < 5]) == 4
    assert warc.digest_rows(warc.read_archive(spark, str(d))).filter("payload_digest is not null").count() == len([r for r in rows if r.ok])


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


# neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    vecs = np.vstack([base, base + rng.normal(size=base.shape) * 1e-4, np.tile(base[:1], (30, 1)), rng.normal(size=(200, 16)) * 1e6]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, [1.0, 2.0]), (905, [None] * 16), (906, []), (None, [1.0] * 16), (5, vecs[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    q = df.filter("vec_id % 7 = 0 or vec_id >= 900")
    for tile in (16, 2048):
        got = {}
        for r in ann.nearest(df, q, 5, tile=tile).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        x = vecs.astype(np.float64)
        for i in range(0, len(vecs), 7):
            s = ann.cosines(np.tile(x[i], (len(x), 1)), x)
            order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], j))[:5]
            assert sorted(got[i]) == [(n + 1, j, s[j]) for n, j in enumerate(order)]
        assert not set(got) & set(range(900, 907))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 0.0)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_on_a_grid(spark, monkeypatch):
    """Query blocks that are too many for a broadcast: each data block moves once
    for each row of the grid, not for each query block."""
    monkeypatch.setattr(ann, "small", lambda df: df)
    monkeypatch.setattr(ann, "CELL_TILES", 4)
    x = np.random.default_rng(4).normal(size=(400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, [1.0, 2.0]) for i in range(3)], "vec_id bigint, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df, df, 3, tile=32).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    v = x.astype(np.float64)
    for i in range(400):
        s = ann.cosines(np.tile(v[i], (400, 1)), v)
        assert sorted(got[i]) == [(n + 1, j) for n, j in enumerate(sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:3])]
    assert sorted(got[900]) == [(1, 901), (2, 902)]
    monkeypatch.undo()
    for q, d, cores in ((1, 1, 8), (10, 1000, 8), (1000, 10, 8), (5000, 50_000, 6000)):
        rows, columns = ann.grid(q, d, cores)
        assert 1 <= rows <= q and 1 <= columns <= d
    assert rows * 50_000 < 2 * 10 * columns * 5000 and rows < 5000 // 5


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(30, 8)).astype(np.float32)
    schema = "vec_id bigint, embedding array<float>"
    once = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], schema)
    found = lambda df, q: sorted(map(tuple, ann.nearest(df.coalesce(1), q, 5).collect()))
    want = found(once, once.filter("vec_id < 6"))
    assert len(want) == 30
    for times in (2, 5, 9):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs) for _ in range(times)], schema)
        assert found(df, df.filter("vec_id < 6")) == want
    # equal scores of one id under vectors that are not equal
    scaled = spark.createDataFrame([(i, (v * 2.0**n).tolist()) for i, v in enumerate(vecs) for n in range(6)], schema)
    assert [r[:3] for r in found(scaled, once.filter("vec_id < 6"))] == [r[:3] for r in want]


def test_neighbours_in_large_groups_of_copies(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    vecs = [base] * 60 + [base + rng.normal(size=8) * 1e-5 for _ in range(60)] + list(rng.normal(size=(20, 8)))
    rows = [(i * 3 % 140, [float(x) for x in np.float32(v)]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows + rows[:5] * 30, "vec_id bigint, embedding array<float>").repartition(5)
    x, ids = np.array([v for _, v in rows], dtype=np.float64), [i for i, _ in rows]
    want = {}
    for i, v in zip(ids, x, strict=True):
        s = ann.cosines(np.tile(v, (len(x), 1)), x)
        want[i] = sorted(((-a, j) for a, j in zip(s.tolist(), ids, strict=True) if j != i))[:5]
    for broadcast in (200_000, 0):
        monkeypatch.setattr(_shared.small, "__defaults__", (broadcast,))
        monkeypatch.setattr(_shared, "KEY_ROWS", 1 if broadcast == 0 else 128)
        got = {}
        for r in ann.nearest(df, df, 5, tile=16).collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert {q: sorted(found) for q, found in got.items()} == want


# near-duplicates


def brute_classes(texts, width, percent):
    def words(t):
        return (t or "").encode().lower().split()

    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in texts}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 120, 300]))]
        last = base
        for k in range(14):
            own = list(base if k % 2 else last)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 16])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            last = own
            texts[len(texts)] = " ".join(own)
    df = awkward(spark, list(texts.values()))
    known = {r.doc_id: r.text for r in df.filter("doc_id is not null").collect()}
    got = minhash.classes(df, width, percent).collect()
    assert len(got) == df.count()
    want = brute_classes(known, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert minhash.classes(empty(spark)).count() == 0


def test_block_tiles_join_every_component(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.choice([2, 5, 7, 9])):
            own[rng.randrange(100)] = f"v{rng.randrange(30)}"
        texts += [" ".join(own), " ".join([*own[:99], "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(df, 3, 85).collect()}
    assert got == brute_classes(dict(enumerate(texts)), 3, 85)


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch, tmp_path):
    rows = [(i, 7 if i % 3 else i % 11) for i in range(300)] + [(i, None) for i in range(300, 340)]
    rows = _shared.written(spark.createDataFrame(rows, "i int, k int"), "t-rows")
    hubs = _shared.written(spark.createDataFrame([(k, f"h{k}") for k in range(9)] + [(None, "none")], "k int, h string"), "t-hubs")
    want = {how: sorted(map(tuple, rows.join(hubs, "k", how).select("i", "k", "h").collect()), key=repr) for how in ("inner", "left")}
    for broadcast, most in ((500_000, 500), (0, 500), (0, 5)):
        monkeypatch.setattr(_shared, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(_shared.small, "__defaults__", (broadcast,))
        monkeypatch.setattr(_shared, "KEY_ROWS", most)
        for how in want:
            out = _shared.spread_join(rows, hubs, "k", "i", how)
            assert sorted(map(tuple, out.select("i", "k", "h").collect()), key=repr) == want[how]
    edges = [(0, i) for i in range(1, 80)] + [(i, i + 1000) for i in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert set(got.values()) == {0} and len(got) == 120


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(_shared.small, "__defaults__", (0,))
    monkeypatch.setattr(_shared, "KEY_ROWS", 3)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 12
    for _ in range(25):
        own = list(base)
        for _ in range(rng.choice([1, 2, 4])):
            own[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(df, 3, 85).collect() if r.doc_id is not None}
    assert got == brute_classes(dict(enumerate(texts)), 3, 85)


def test_hashes_do_not_depend_on_the_pieces(monkeypatch):
    texts = [b"ab cd  EF", b"", b"x" * 500, b"q " * 300, "é日本 ".encode() * 40]
    want = minhash.word_hashes(texts)
    batch = textstats.Batch([t.decode() for t in texts])
    monkeypatch.setattr(minhash, "PIECE", 16)
    got = minhash.word_hashes(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert (textstats.Batch([t.decode() for t in texts]).words == batch.words).all()


def test_work_folder_has_to_be_shared(spark, monkeypatch):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://h:1"})

    with pytest.raises(ValueError):
        _shared.work_dir(Far)


def test_estimate_is_close(spark):
    a = ["%d" % i for i in range(1000)]
    pairs = [(k, minhash.shingle_sets([" ".join(a).encode(), " ".join(a[k:] + ["x%d" % i for i in range(k)]).encode()], 1)) for k in (0, 50, 150)]
    for k, sets in pairs:
        p = minhash.packed(minhash.signatures(sets)).tolist()
        j = (1000 - k) / (1000 + k)
        e = spark.createDataFrame([(p[0], p[1])], "a array<bigint>, b array<bigint>").select(minhash.estimate("a", "b")).head()[0]
        assert abs(e - j) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 150)] + [(7, 7), (200, 100)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 200: 100}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# decontamination


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(_shared.small, "__defaults__", (0,))
        monkeypatch.setattr(_shared, "KEY_ROWS", 3)
        monkeypatch.setattr(decontam, "KEY_ROWS", 3)
    rng = random.Random(2)
    vocab = ["the", "of", "a", "x", "y", *[f"r{i}" for i in range(30)]]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([25, 10, 11, 3, 1, 9, 40])] + [(90, None), (91, "!?"), (92, "Rare, RARE; words"), (92, "rare rare words")]
    texts = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        t = (items[k % 7][1] or "").split()
        w[rng.randrange(len(w) + 1) : 0] = t[: rng.randrange(1, len(t) + 1)]
        texts.append("; ".join(w).upper() if k % 3 else " ".join(w))
    df = awkward(spark, [*texts, "it says rare-rare WORDS twice rare rare words", "r1"])
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("win", F.lit("clash"))

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)

    def judge(t):
        w, hit, found = words(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= own
        return len(w), len(hit), sorted(map(str, found)), bool(hit)

    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items, r.contaminated) for r in decontam.Index(df, bench).report().collect())
    assert got == sorted((str(r.doc_id), *judge(r.text)) for r in df.collect())
    assert decontam.Index(empty(spark), bench).report().count() == 0
    assert decontam.Index(df, bench.limit(0)).report().filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha q beta z gamma"), (3, "gamma q q q q q q q alpha"), (4, "alpha alpha")], "doc_id bigint, text string")
    near = decontam.Index(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string"))
    assert {r.doc_id for r in near.near(0).collect()} == {1}
    assert {r.doc_id for r in near.near(1).collect()} == {1}
    assert {r.doc_id for r in near.near(2).collect()} == {1, 2}


def test_proximity_against_brute_force(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "d", "e"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(80)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 4, 5])]

    def holds(text, item, slop):
        t, w = text.split(), item.split()
        for i in range(len(t)):
            at = i - 1
            for x in w:
                at = next((j for j in range(at + 1, len(t)) if t[j] == x), None)
                if at is None:
                    break
            if at is not None and at - i + 1 <= len(w) + slop:
                return True
        return False

    index = decontam.Index(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    for slop in (0, 1, 3):
        got = {(r.doc_id, i) for r in index.near(slop).collect() for i in r.item_ids}
        assert got == {(d, i) for d, t in docs for i, x in items if holds(t, x, slop)}


# personal data

BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(s):
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in BASE:
        for m in pattern.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def pii_texts():
    rng = random.Random(11)
    bits = ["a.b@c.d", "a@b.c_d@e.f", "@x.y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.255", "4465758382889437", "4465 7583-8288 9437", "1234567890123", "+1 (523) 555-1055", "+1-", "+12345678901234567", "é", "日", "🙂", " ", "-", ".", "+", "@", "x", "0", "a@b-.c..d", "+1 (5) ", "7", "a@a@a.b"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["1" * 3000 + "." * 10, "a" * 30_000, "a." * 8000 + "@x.y", "1.2.3.4 " * 900, "x@y" + ".z" * 6000, "+" + "1 " * 9000]


def test_pii_base_against_brute_force(spark):
    df = awkward(spark, pii_texts())
    rows, spans = pii.detect(df)
    texts = {r[pii.ROW]: r.text for r in rows.collect()}
    got = {}
    for r in spans.collect():
        assert texts[r.row_id][r.start : r.end] == r.value
        if r.kind != "id":
            got.setdefault(r.row_id, []).append((r.kind, r.start, r.end))
    order = {k: n for n, (k, _) in enumerate(BASE)}
    for i, t in texts.items():
        assert sorted(got.get(i, []), key=lambda s: (order[s[0]], s[1])) == base_spans(t), t
    assert pii.detect(empty(spark))[1].count() == 0


def test_pii_bootstrap_finds_what_stands_like_seeds(spark):
    known = [f'call me at number +1 (523) 555-{1000 + i} or so' for i in range(6)]
    hidden = ["call me at number AB-99-12345 or so", "a plain 2024-05-17 date", "version 1234567 here"]
    df = spark.createDataFrame(list(enumerate(known + hidden)), "doc_id bigint, text string")
    _, spans = pii.detect(df)
    assert {r.value for r in spans.filter("kind = 'id'").collect()} == {"AB-99-12345"}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "call me at number [PHONE] or so" and clean[6] == "call me at number [ID] or so" and clean[7] == hidden[1]


def test_pii_contexts_reach_over_other_tokens(spark):
    known = [f"in room 4 badge +1 (523) 555-{1000 + i} was found" for i in range(6)]
    lists = [f"account number is +1 (523) 555-{2000 + i}, +1 (523) 555-{3000 + i} and +1 (523) 555-{4000 + i} today" for i in range(6)]
    hidden = ["in room 4 badge QX-88213 was found", "in room 17 badge QX-88214 was found", f"account number is AB12345, AB12346 and {'AB12347' * 9} today", "a plain 2024-05-17 date, 2024-05-18 and 2024-05-19 too"]
    df = spark.createDataFrame(list(enumerate(known + lists + hidden)), "doc_id bigint, text string")
    rows, spans = pii.detect(df)
    assert {r.value for r in spans.filter("kind = 'id'").collect()} == {"QX-88213", "QX-88214", "AB12345", "AB12346", "AB12347" * 9}
    texts = rows.select(F.col(pii.ROW).alias("row_id"), F.col("text").alias("t"))
    assert pii.matches(texts).filter("trim(before) = '' or trim(after) = ''").count() == 0


def test_pii_rounds_go_on_while_they_find(spark):
    # a chain: the contexts of each four values are told by the four before
    rows = [(p, k, n) for k in range(8) for n in range(4) for p in (f"p{k}{'aabb'[n]}", f"p{k + 1}a", f"p{k + 1}b")]
    found = spark.createDataFrame([(f"{p} b c", "id" if k else "ip", f"v{k}-{n}", "") for p, k, n in rows], "before string, kind string, value string, after string")
    assert pii.bootstrap(found).filter("score >= 0.5").count() == 32


def test_pii_of_long_values_and_without_broadcasts(spark, monkeypatch):
    known = [f"call me at number +1 (523) 555-{1000 + i} or so" for i in range(6)] * 3
    hidden = ["call me at number " + "Q7" * 900 + " or so", "version 1234567 here"]
    df = spark.createDataFrame(list(enumerate(known + hidden)), "doc_id bigint, text string")
    want = sorted(map(tuple, pii.detect(df)[1].collect()))
    assert any(r[-1] == "Q7" * 900 for r in want)
    monkeypatch.setattr(_shared.small, "__defaults__", (0,))
    monkeypatch.setattr(_shared, "KEY_ROWS", 2)
    assert sorted(map(tuple, pii.detect(df)[1].collect())) == want


def test_redaction_of_a_long_text(spark):
    text = "é🙂 " * 3000 + " ".join(f"u{i}@a.bc x🙂{'y' * (i % 90)}" for i in range(900))
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).head().text
    assert out == re.sub(r"u\d+@a\.bc", "[EMAIL]", text)


def test_redaction_keeps_all_else(spark):
    df = awkward(spark, ["x a@b.c y 1.2.3.4", "1.2.3.4a@b.cc"])
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    got = sorted(((r.doc_id, r.text, r.t) for r in out.collect()), key=repr)
    want = sorted(((r.doc_id, {"x a@b.c y 1.2.3.4": "x [EMAIL] y [IP]", "1.2.3.4a@b.cc": "[EMAIL]"}.get(r.text, r.text), r.t) for r in df.collect()), key=repr)
    assert got == want


# classifiers


def held_out(spark, query, label, n, r):
    got = {x.doc_id: x for x in query(spark, SF).collect()}
    for i, x in got.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % n == r) and 0 <= x.score <= 1
    return got, {x.doc_id: x[label] for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_holds_out(spark):
    got, want = held_out(spark, quality.op7_quality, "quality", 4, 2)
    assert all(x.predicted == (x.score >= 0.7) for x in got.values())
    own = [i for i in want if got[i].held_out]
    assert len(got) == 200 and sum(got[i].predicted == want[i] for i in own) >= 0.85 * len(own)


def test_quality_learns_on_more(spark):
    sf = "/root/testdata/sf0.01"
    got = {x.doc_id: x for x in quality.op7_quality(spark, sf).collect()}
    want = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [i for i in want if got[i].held_out]
    assert sum(got[i].predicted == want[i] for i in own) >= 0.95 * len(own)


def test_quality_awkward(spark):
    df = awkward(spark)
    none = quality.scores(df, labels(spark))
    assert none.count() == df.count() and none.filter("score <> 0.5").count() == 0
    some = quality.scores(df, labels(spark, [(i, i % 2) for i in range(8)] + [(1, None), (2, 7), (None, 1), (999, 1), (3, 1)]))
    assert some.count() == df.count() + 0 and some.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.scores(empty(spark), labels(spark, [(1, 1)])).count() == 0
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.6, 0.4, 1.0]), np.array([1.0, 1, 1, 1]))
    assert x.tolist() == [0, 1, 2, 3] and y.tolist() == [0, 0.5, 0.5, 1]


def test_kernel_ridge_equals_direct_solution(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["ab", "CD!!", "ef."], 20))) for i in range(200)], "doc_id bigint, text string")
    stats = quality.measure(docs).cache()
    lab = {i: int(i % 3 > 0) for i in range(200)}
    model = quality.fit(stats, labels(spark, lab.items()))
    rows = stats.collect()
    x, y = np.array([r.stats for r in rows], dtype=float), np.array([lab[r.doc_id] for r in rows], dtype=float)
    z = model.features(x)
    direct = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ direct, z @ model.weights, atol=1e-6)


def test_worst_run_sees_the_end_of_a_text():
    plain = " ".join(f"w{i}" for i in range(100))
    clean, junk = quality.statistics([plain + " " + " ".join(f"v{i}" for i in range(40)), plain + " same" * 40])
    assert clean[25] == 0 and junk[25] == 39 / quality.RUN
    assert quality.statistics(["a a", "", "x"])[:, 25].tolist() == [0.5, 0, 0]


def test_sums_up_a_tree(spark):
    import pyarrow as pa

    one = np.arange(5.0).tobytes()
    parts = spark.range(70).repartition(40).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([one] * b.num_rows, pa.binary())], names=["s"]) for b in bs), "s binary")
    assert quality._summed(parts, 5).tolist() == (np.arange(5.0) * 70).tolist()


def test_toxicity_holds_out(spark):
    got, want = held_out(spark, toxicity.op1_toxicity, "toxic", 5, 0)
    assert all(x.predicted == (x.score >= 0.5) for x in got.values())
    assert len(got) == 200 and sum(got[i].predicted == want[i] for i in want) >= 0.85 * len(want)


def test_toxicity_finds_toxic_rows_and_leaves_clean_ones(spark):
    """On rows it did not learn from; a constant prediction fails one or the other."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op1_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity_mines_unseen_words(spark):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(60)]
    rows, lab = [], {}
    for i in range(400):
        w = [rng.choice(plain) + rng.choice("abc") for _ in range(40)]
        if i % 8 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zorgl" + rng.choice("abcdefgh"))
        rows.append((i, " ".join(w)))
        lab[i] = int(i % 8 == 0)
    rows += [(400, "zorgla word1a zorglh word2b"), (401, "word1a word2b"), (402, None)]
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), labels(spark, lab.items())).collect()}
    assert got[400] > 0.5 > got[401] and got[402] < 0.5
    assert sum((got[i] >= 0.5) == lab[i] for i in lab) >= 396


def test_label_model_tells_voters_apart():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.1
    v = np.zeros((4000, toxicity.VOTERS), dtype=int)
    for j in range(toxicity.VOTERS):
        v[:, j] = rng.random(4000) < np.where(y, 0.7 if j < 6 else 0.1, 0.02 if j < 6 else 0.1)
    v[:, 1] = v[:, 0]
    seen, counts = np.unique(v, axis=0, return_counts=True)
    post, rate, rho, cliques = toxicity.label_model(seen, counts.astype(float), np.zeros((len(seen), 2)))
    at = {tuple(p): x for p, x in zip(seen.tolist(), post, strict=True)}
    assert np.mean([(at[tuple(r)] > 0.5) == t for r, t in zip(v.tolist(), y, strict=True)]) > 0.97
    assert rate[1, 0] > 0.5 > rate[0, 0] and rho[0, 1] > 0.9 > rho[0, 2]
    assert any({0, 1} <= set(c) for c in cliques)


def test_label_model_against_plain_em():
    """The model on counted patterns equals EM in loops over single rows."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        y = rng.random() < 0.3
        v = [int(rng.random() < (0.7 if y else 0.1)) for _ in range(4)]
        rows.append((*v[:2], v[1], *v[2:]))
    gold = [(rows[i], i % 2) for i in range(10)]
    seen = sorted(set(rows))
    counts = np.array([rows.count(p) for p in seen], dtype=float)
    known = np.array([[sum(g == (p, y) for g in gold) for y in (0, 1)] for p in seen], dtype=float)
    steps = 12
    post, rate, rho, cliques = toxicity.label_model(np.array(seen), counts, known, steps)
    assert any({1, 2} <= set(c) for c in cliques)
    n = [sum(y == c for _, y in gold) for c in (0, 1)]
    r = [[(sum(v[j] for v, y in gold if y == c) + 0.5) / (n[c] + 1) for j in range(5)] for c in (0, 1)]
    prior, groups = (n[1] + 1) / (len(gold) + 2), [(j,) for j in range(5)]

    def alone(c, votes, rates):
        return np.prod([rates[j] if votes[j] else 1 - rates[j] for j in c])

    table = {(c, tuple(v[j] for j in c), y): alone(c, v, r[y]) for c in groups for v in rows for y in (0, 1)}
    for step in range(steps):
        told = []
        for v in rows:
            odds = np.log(prior / (1 - prior)) + sum(np.log(table[c, tuple(v[j] for j in c), 1] / table[c, tuple(v[j] for j in c), 0]) for c in groups)
            told.append(1 / (1 + np.exp(-odds)))
        whole = [(v, p) for v, p in zip(rows, told, strict=True)] + [(v, float(y)) for v, y in gold]
        weight = [sum(1 - p for _, p in whole), sum(p for _, p in whole)]
        share = lambda test, y: sum((p if y else 1 - p) for v, p in whole if test(v))
        r = [[min(max((share(lambda v, j=j: v[j], y) + 0.5) / (weight[y] + 1), 1e-4), 1 - 1e-4) for j in range(5)] for y in (0, 1)]
        prior = min(max(weight[1] / sum(weight), 1e-4), 0.5)
        if step == steps // 4:
            groups = cliques
        table = {(c, tuple(v[j] for j in c), y): (share(lambda u, c=c, v=v: all(u[j] == v[j] for j in c), y) + toxicity.SMOOTH * alone(c, v, r[y])) / (weight[y] + toxicity.SMOOTH) for c in groups for v in seen for y in (0, 1)}
    want = dict(zip(rows, told, strict=True))
    assert all(abs(want[p] - x) < 1e-9 for p, x in zip(seen, post, strict=True))
    assert np.allclose(rate, r)


def test_toxicity_awkward(spark):
    df = awkward(spark, ["you stupid idiot, you moron"])
    for lab in ([], [(i, i % 2) for i in range(9)] + [(1, None), (None, 1), (999, 1)]):
        out = toxicity.scores(df, labels(spark, lab))
        assert out.count() == df.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.scores(empty(spark), labels(spark)).count() == 0


# urls


def test_url_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.EXAMPLE.com/en/7?x=/y", "https://example.com/en/71", "https://com/en/", "x://Example.net/de/8#f", "a://b.net/de", "a://b.net/de/", "http://é.org/es/x", "http://org?/es/", "http://notexample.com/en/7", "a://b://c.com/en/1", "http://h.org/es\n/x", "ftp://user@h.com/EN/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None)], "page_id bigint, url string").withColumn("raw", F.lit("clash"))

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p) for h, p, _ in urltree.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None

    verdicts = {h + p: v for h, p, v in urltree.RULES}
    for name in (*urltree.RESULT, "label", "kid", "key", "n"):
        df = df.withColumn(name, F.lit("clash"))
    judged = urltree.judge(df)
    assert judged.columns == ["page_id", "url", "raw", "label", "kid", "key", "n", *urltree.RESULT]
    out = judged.collect()
    assert len(out) == len(urls) + 1 and {r.raw for r in out} == {r.label for r in out} == {"clash"}
    for r in out:
        want = brute(r.url)
        assert (r.host, r.path, r.rule) == want and r.verdict == (verdicts[want[2]] if want[2] else "allow")


def test_url_rules_are_those_of_the_contract(spark):
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for h, p, v in urltree.RULES} == said
    urls = {"http://a.com/en/1": "com/en/", "http://www.example.com/en/71": "example.com/en/7", "http://casino.net/de/1": "net/de/", "http://example.net/de/80": "example.net/de/8", "http://x.org/es/": "org/es/"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    out = {r.url: (r.rule, r.verdict) for r in urltree.judge(pages, label=F.lit(1)).collect()}
    assert out == {u: (rule, said[rule]) for u, rule in urls.items()}


def test_url_templates_are_rejected_by_purity(spark):
    rows = [(f"http://h.xyz/user/{i}/spam-{'abc'[i % 3]}", 1) for i in range(30)] + [(f"http://h.xyz/news/{i}", 0) for i in range(30)] + [(f"http://h.xyz/mixed/{i}", i % 2) for i in range(30)]
    rows += [(f"http://h.xyz/tag/t{chr(97 + i)}{chr(97 + j)}/page", 1 if i < 20 else None) for i in range(26) for j in range(2)]
    rows += [("http://h.xyz/user/999/spam-a", None), ("http://h.xyz/news/999", None), ("http://h.xyz/mixed/999", None), ("http://h.xyz/tag/zz/page", None), ("http://h.xyz/other/1", None), ("http://g.xyz/user/1/spam-a", None)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, y int")
    out = {r.url: r.verdict for r in urltree.judge(df, label=F.col("y")).collect()}
    got = {u.split("xyz")[1]: out[u] for u, _ in rows[-6:-1]}
    assert got == {"/user/999/spam-a": "block", "/news/999": "allow", "/mixed/999": "allow", "/tag/zz/page": "block", "/other/1": "allow"}
    assert out["http://g.xyz/user/1/spam-a"] == "allow"


def test_url_small_branches_of_a_host_are_judged_together(spark):
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu", "hen"]
    rows = [(f"http://bad.xyz/{w}/{v}", 1) for w in words for v in words[:2]] + [(f"http://good.xyz/{w}/{v}", 0) for w in words for v in words[:2]]
    rows += [(f"http://odd.xyz/{w}/x", int(w == "ant")) for w in words] + [("http://one.xyz/ant/x", 1), ("http://bad.xyz/new/x", None)]
    # small branches that are too unlike to merge: the host's other labels decide
    rows += [(f"http://rest.xyz/big/{w}", 0) for w in words for _ in range(3)] + [("http://rest.xyz/ant/x", 1)] * 3 + [("http://foul.xyz/p/x", 1)] * 4 + [("http://foul.xyz/q/r/x", 1)] * 4
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, y int")
    got = {}
    for r in urltree.judge(df, label=F.col("y")).collect():
        got.setdefault(r.host + ("/new" if "/new/" in r.url else ""), set()).add(r.verdict)
    assert got == {"bad.xyz": {"block"}, "bad.xyz/new": {"allow"}, "foul.xyz": {"block"}, **{f"{h}.xyz": {"allow"} for h in ("good", "odd", "one", "rest")}}


def plain_tree(rows):
    """What the tree makes of (host, segments, label): purity of each rejected
    (host, segments), worked out in plain loops."""
    from collections import defaultdict

    def typed(x):
        stem, ext = re.fullmatch(r"(.*?)(\.[A-Za-z]{2,5})?", x).groups()
        kind = "{n}" if re.fullmatch("[0-9]+", stem) else "{hex}" if re.fullmatch("[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem) else "{id}" if re.search("[0-9]", stem) else "{long}" if len(stem) > 40 else stem
        return kind + (ext or "")

    raws = defaultdict(lambda: [0, 0, 0])
    for host, segments, label in rows:
        r = raws[(host, *map(typed, segments))]
        r[0] += 1
        r[1] += label == 1
        r[2] += label == 0
    key = {raw: raw for raw in raws}
    for level in range(max(map(len, raws)) - 1):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for raw, k in key.items():
            if len(k) > level + 1:
                got = kids[k[: level + 1]][k[level + 1]]
                got[0], got[1], got[2] = got[0] + raws[raw][0], got[1] + raws[raw][1], got[2] + raws[raw][1] + raws[raw][2]
        new = {}
        for parent, own in kids.items():
            total = [sum(x[i] for x in own.values()) for i in range(3)]
            rate = (total[1] + 1) / (total[2] + 2)
            for seg, (_, bad, known) in own.items():
                if len(own) >= urltree.MANY_VALUES and total[0] <= urltree.FEW_PAGES * len(own):
                    new[(*parent, seg)] = "*"
                elif len(own) > 1 and 0 < known < total[2] and abs(bad / known - rate) <= urltree.SAME_RATE * (rate * (1 - rate) / known) ** 0.5:
                    new[(*parent, seg)] = "~"
        for raw, k in key.items():
            if k[: level + 2] in new and len(k) > level + 1:
                key[raw] = (*k[: level + 1], new[k[: level + 2]], *k[level + 2 :])
    own, branch = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for raw, k in key.items():
        if raws[raw][1] + raws[raw][2]:
            own[k][0] += raws[raw][1]
            own[k][1] += raws[raw][1] + raws[raw][2]
    for k, (bad, known) in own.items():
        for level in range(len(k)):
            branch[k[: level + 1]][0] += bad
            branch[k[: level + 1]][1] += known
    everything = [sum(x[i] for x in own.values()) for i in range(2)]
    prior = min(0.5, (everything[0] + 1) / (everything[1] + 2))
    purity = {}
    for k, (bad, known) in own.items():
        p = prior
        if known < urltree.SUPPORT:
            path = [branch[k[: i + 1]] for i in range(len(k))] + [[bad, known]]
            for up, down in zip(path, path[1:], strict=False):
                p = (up[0] - down[0] + urltree.SMOOTH * p) / (up[1] - down[1] + urltree.SMOOTH)
        purity[k] = (bad + urltree.SMOOTH * p) / (known + urltree.SMOOTH)
    return {(host, *segments): purity[key[(host, *map(typed, segments))]] for host, segments, _ in rows if purity.get(key[(host, *map(typed, segments))], 0) >= urltree.PURITY}


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_tree_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(_shared.small, "__defaults__", (0,))
        monkeypatch.setattr(_shared, "KEY_ROWS", 3)
    rng = random.Random(12)
    rows = []
    for h in range(6):
        for _ in range(120):
            segments = [rng.choice(["a", "b", "news", "p7", "12", "x" * 50, f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randrange(7))]
            bad = rng.random() < (0.95 if segments[4:5] == ["b"] or segments[:1] == ["b"] or h == 5 else 0.1)
            rows.append((f"h{h}.xyz", segments, None if rng.random() < 0.3 else int(bad)))
    # parted from the fifth segment on
    rows += [("deep.xyz", ["a", "b", "c", "d", kind, f"u{chr(97 + i)}"], int(kind == "bad")) for kind in ("bad", "good") for i in range(8)]
    df = spark.createDataFrame([(i, "http://" + "/".join([h, *p]), y) for i, (h, p, y) in enumerate(rows)], "page_id bigint, url string, y int")
    want = plain_tree(rows)
    got = {(rows[r.page_id][0], *rows[r.page_id][1]): r.purity for r in urltree.judge(df, label=F.col("y")).filter("verdict = 'block'").collect()}
    assert set(got) == set(want) and 20 < len(want) < 700
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {k[5] for k in got if k[0] == "deep.xyz"} == {"bad"}


def test_url_awkward(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urltree.judge(none, label=F.lit(1)).count() == 0
    long = spark.createDataFrame([(1, "http://h.xyz/" + "a/" * 3000 + "b"), (2, "http://h.xyz/" + "z" * 200_000), (3, None), (4, "http://g.xyz")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in urltree.judge(long, label=F.lit(0)).collect()} == dict.fromkeys(range(1, 5), "allow")


def test_url_rounds_follow_partings_not_depth(spark, monkeypatch):
    made = []
    monkeypatch.setattr(urltree, "written", lambda df, name: made.append(name) or _shared.written(df, name))
    deep = "a/b/" * 1500
    rows = [(f"http://h.xyz/{deep}{kind}/{w}", int(kind == "bad")) for kind in ("bad", "good") for w in ("ant", "bee", "cat", "dog", "eel", "fox")]
    rows += [("http://trap.xyz/" + "a/" * n, 0) for n in (300, 301, 302)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id bigint, url string, y int")
    got = urltree.judge(df, label=F.col("y")).collect()
    assert {(r.verdict, "/bad/" in r.url) for r in got} == {("block", True), ("allow", False)}
    assert len([n for n in made if n.startswith("url-level-")]) <= 5


def test_url_verdicts_part_within_a_host_without_seed_words(spark, tmp_path):
    """Labels of pages' content, on hosts that no word tells anything of."""
    prose, junk = "<p>" + "plain words of a text that goes on and on to its end. " * 5 + "</p>", "<p>" + "cheap -- >> ## | buy :: !! now .. ** " * 6 + "</p>"
    rows = [(f"https://www.garden.example/{part}/{w}", junk if part == "lists" else prose) for part in ("lists", "essays") for w in range(7)]
    rows += [("https://www.garden.example/lists/99", None), ("https://www.garden.example/essays/99", None), ("https://casino-x.example/a", prose)]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {rows[r.page_id][0].split("://")[1]: r.verdict for r in urltree.op3_url(spark, str(tmp_path)).collect()}
    assert got["www.garden.example/lists/99"] == "block" and got["www.garden.example/essays/99"] == "allow"
    assert {v for u, v in got.items() if "/lists/" in u} == {"block"} and {v for u, v in got.items() if "/essays/" in u} == {"allow"}


def test_url_query_rejects_templates(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = {r.page_id: r.y for r in pages.select("page_id", urltree.weak_label(urltree.split_url(F.col("url"))[0], F.col("html")).alias("y")).collect()}
    out = urltree.op3_url(spark, "/root/testdata/sf0.1").collect()
    want = plain_tree([(r.host, [x for x in r.path.split("/") if x], labels[r.page_id]) for r in out])
    verdicts = {h + p: v for h, p, v in urltree.RULES}
    for r in out:
        own = (r.host, *[x for x in r.path.split("/") if x])
        assert r.verdict == (verdicts[r.rule] if r.rule else "block" if own in want else "allow")
    assert any(r.rule is None and r.verdict == "block" for r in out)


# preferences


def test_preference_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 5, "user", "r"), (1, 6, "assistant", "bäd"), (1, 6, "assistant", "bäd")]
    rows += [(2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, None, None), (5, 0, "user", "z"), (6, 0, "user", "alone"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("r", F.lit("clash"))
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 6, 7)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    for name in ("a", "b", "differs", "n_prefix", "turns", "conv_id"):
        pairs = pairs.withColumn(name, F.lit("clash"))
    got = {r.pair_id: r for r in preference.format_pairs(turns, pairs).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].n_prefix == 3 and got[0].prompt.count("<|user|>") == 2
    for side in ("chosen", "rejected"):
        text, spans = got[0][side], got[0][f"{side}_spans"]
        a, z = map(int, spans.split(":"))
        assert text[a:z] == {"chosen": "good", "rejected": "bäd"}[side] + preference.END
    assert (got[1].n_prefix, got[1].chosen, got[1].rejected, got[1].chosen_spans) == (1, "", "", "")
    assert got[2].n_prefix == 0 and got[2].prompt == "" and got[2].chosen == "<|unknown|>\n<|end|>\n"
    assert preference.format_pairs(turns.limit(0), pairs).count() == 0


def test_preference_with_swapped_answers(spark):
    long = "日本🙂 " * 30_000
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "good"), (0, 4, "user", "thanks"), (1, 0, "user", "x"), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "user", "no answer"), (3, 0, "assistant", "first"), (4, 0, None, None), (5, 0, "assistant", "same"), (6, 0, "assistant", "same"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("a", "b", "last", "answer", "donor", "turns"):
        turns = turns.withColumn(name, F.lit("clash"))
    got = {r.pair_id: r for r in preference.format_swapped(turns).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, None}
    shown = lambda role, text: f"<|{role}|>\n{text}{preference.END}"
    assert (got[0].n_prefix, got[0].rejected_id, got[0].prompt) == (3, 1, shown("user", "q") + shown("assistant", "a") + shown("user", "r"))
    assert got[0].chosen == shown("assistant", "good") + shown("user", "thanks") and got[0].rejected == shown("assistant", long)
    a, z = map(int, got[0].rejected_spans.split(":"))
    assert got[0].rejected[a:z] == long + preference.END
    assert (got[1].n_prefix, got[1].rejected, got[1].rejected_id) == (1, "", None)
    assert (got[2].n_prefix, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].n_prefix, got[3].prompt, got[3].rejected) == (0, "", "")
    assert (got[5].n_prefix, got[5].chosen, got[5].rejected) == (1, "", "")
    assert preference.format_swapped(turns.limit(0)).count() == 0


def test_preference_query_has_prompts(spark):
    out = preference.op2_preference(spark, SF)
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert out.count() == n and out.filter("n_prefix > 0 and prompt <> ''").count() > 0.8 * n


@pytest.mark.parametrize("op", ["preference", "decontam", "pii"])
def test_native_operators_run_no_python(spark, op):
    from siftwell.llm import registry

    name = {"preference": "op2_preference", "decontam": "op4_decontaminate", "pii": "op10_pii"}[op]
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
