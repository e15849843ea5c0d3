"""Byte-level BPE encoding and decoding with tree concatenation.

A text of at most ``leaf_chars`` characters is encoded whole. A longer one is
cut in halves until these are that short; the halves are encoded on their own and
joined up the tree. Texts of more than ``part_chars`` are rows of parts: these
are dealt to all tasks and encoded in parallel, each by a tree of its own, and
each level above is a round that joins neighbours, in tasks of their own, and
writes what they gave. At each join a window around the cut is encoded again and
grown until both sides agree exactly:

* where characters of two kinds meet (a word and the space behind it, a letter
  and a digit) every scan of the pre-tokeniser has a border, whatever stands
  around. A window from the last such border before the cut to the first behind
  it is encoded as in the whole text, if both are token borders of the sides;
* in unsplit text, a run of one kind that is longer than the window, the window
  begins and ends with tokens of the sides, and what is encoded anew has to begin
  with the left side's own token and to end with the right side's. A BPE
  sequence is the encoding of its text exactly if each two neighbours are, so
  agreement on these two suffices.

The scan and the merges are those of a byte-level vocabulary in the order of its
merges; other kinds of tokenizer files are an error. The results are those of
the tokenizers library, which tests hold them against.

Defined results: null and empty texts have no ids and decode to the empty
text; strings of special tokens become their ids, as the library does it;
repeated rows are encoded each; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import spread, table, tidy, written

LEAF_CHARS = 2048
#: Characters of a part of a text that several tasks encode.
PART_CHARS = 32_768
FIRST_WINDOW = 32

# The pre-tokeniser's pattern. A fixed value of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters whose kind no version of Unicode changes: letters, digits, others
#: (without the apostrophe, which may begin a contraction), white space.
_L, _N, _O, _S = "A-Za-zÀ-ÖØ-öø-ÿЀ-ҁぁ-ゖァ-ヺ一-龥가-힣", "0-9", r"!-&(-/:-@\[-`{-~、。！，：；？「」", r" \t\n\r"
_BORDER = re.compile(f"(?<=[{_L}{_N}{_O}'])(?=[{_S}])|(?<=[{_L}])(?=[{_N}{_O}'])|(?<=[{_N}])(?=[{_L}{_O}'])|(?<=[{_O}])(?=[{_L}{_N}])")
_UNSPLIT = re.compile(f"[{_L}]+|[{_N}]+|[{_O}]+|[{_S}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def load(path: str) -> Encoder:
    return Encoder(path)


def _kept(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind that Encoder takes."""
    model, scan = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    pairs = (x if isinstance(x, list) else x.split(" ") for x in model.get("merges", ()))
    ids = [model["vocab"]["".join(p)] for p in pairs]
    strict = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec.get("added_tokens", ()))
    return plain and strict and not spec.get("normalizer") and scan.get("type") == "ByteLevel" and scan.get("use_regex", True) and not scan.get("add_prefix_space") and all(a < b for a, b in zip(ids, ids[1:], strict=False))


class Encoder:
    """The vocabulary of a tokenizer file. Characters of its tokens stand for one
    byte each, by the rule of byte-level vocabularies: printable Latin-1 for
    itself, the others in order from 256 on."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _kept(spec):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("siftwell", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = np.zeros(max(self.bytes) + 1, np.int64)
        for i, t in self.bytes.items():
            self.size[i] = len(t)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special tokens, and these with their ids."""
        found = self._cut.split(text) if self._cut else [text]
        return [(p, self.special.get(p)) for p in found if p]

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), np.uint32)

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> tuple[np.ndarray, int]:
        """Ids of a text of any length, and how many joins made them."""
        if len(text) <= leaf_chars:
            return np.array(self.bpe.encode(text, allowed_special="all"), np.uint32), 0
        out = [self.tree(p, leaf_chars) if i is None else (np.array([i], np.uint32), 0) for p, i in self.pieces(text)]
        return np.concatenate([ids for ids, _ in out]), sum(n for _, n in out)

    def tree(self, text: str, leaf_chars: int) -> tuple[np.ndarray, int]:
        if len(text) <= leaf_chars:
            return self.plain(text), 0
        mid = len(text) // 2
        (left, m), (right, n) = self.tree(text[:mid], leaf_chars), self.tree(text[mid:], leaf_chars)
        return self.join(left, right, text, mid), m + n + 1

    def join(self, left: np.ndarray, right: np.ndarray, text: str, mid: int) -> np.ndarray:
        """The encoding of ``text`` from those of its sides before and from ``mid``."""
        w = FIRST_WINDOW
        while (found := self._agreed(left, right, text, mid, w)) is None:
            w *= 2
        i, m, j = found
        return np.concatenate([left[:i], m, right[j:]])

    def _agreed(self, left, right, text, mid, w):
        """(i, m, j): left[:i], m and right[j:] are the encoding of the joined
        text; None if the window is too small to tell. A window over the whole
        text can always tell."""
        lo, hi = max(0, mid - w), min(len(text), mid + w)
        b = max((x.start() for x in _BORDER.finditer(text, max(lo, 1), mid)), default=None if lo else 0)
        first = _BORDER.search(text, mid + 1, hi)
        e = first.start() if first else None if hi < len(text) else hi
        before = len(text[lo if b is None else b : mid].encode())
        behind = len(text[mid : hi if e is None else e].encode())
        # bytes from a token's border to the cut, of as many tokens as can matter
        ends = np.cumsum(self.size[left[len(left) - min(before, len(left)) :][::-1]])
        starts = np.cumsum(self.size[right[:behind]])
        i, j = (int(np.searchsorted(x, n, "right")) for x, n in ((ends, before), (starts, behind)))
        if (b is not None and (not i or ends[i - 1] != before)) or (e is not None and (not j or starts[j - 1] != behind)):
            return None
        if b is not None and e is not None:
            return len(left) - i, self.plain(text[b:e]), j
        run = text[max(0, lo - 2) if b is None else b + (text[b] == " ") : min(len(text), hi + 2) if e is None else e]
        if not i or not j or not _UNSPLIT.fullmatch(run):
            return None
        old = np.concatenate([left[len(left) - i :], right[:j]])
        m = np.array(self.bpe._encode_single_piece(b"".join(map(self.bytes.__getitem__, old.tolist()))), np.uint32)
        if len(m) < 2 or (b is None and m[0] != old[0]) or (e is None and m[-1] != old[-1]):
            return None
        return len(left) - i, m, j

    def decode(self, ids: list[int]) -> bytes:
        """The text of the ids in UTF-8, as the library decodes them, special
        tokens included; unknown ids stand for nothing."""
        try:
            raw = b"".join(map(self.bytes.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.bytes.get(i, b"") for i in ids)
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


#: A node of the trees: which text, which piece between special tokens, its
#: place among the piece's ``n``, its text, its ids, and the joins below it.
NODE = "row bigint, piece int, at int, n int, text string, ids binary, joins bigint"
_NAMES = [x.split()[0] for x in NODE.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64()]


def _node(*cells):
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, _TYPES, strict=True)], names=_NAMES)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _parts_of(texts: DataFrame, path: str, part_chars: int) -> DataFrame:
    """Nodes without an encoding: parts of the ``_text`` of each ``row``, dealt
    to as many tasks as there is work for."""

    def cut(batches):
        for row, text in _rows(batches):
            for piece, (p, special) in enumerate(load(path).pieces(text)):
                if special is not None:
                    yield _node(row, piece, 0, 1, p, np.array([special], np.uint32).tobytes(), 0)
                    continue
                n = -(-len(p) // part_chars)
                for at in range(n):
                    yield _node(row, piece, at, n, p[at * part_chars : (at + 1) * part_chars], None, 0)

    parts = written(texts.select("row", "_text").mapInArrow(tidy(cut), NODE), "bpe-parts")
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, 1 + parts.count() // 64)
    return parts.repartition(tasks, "row", "piece", "at")


def _tree_ids(texts: DataFrame, path: str, part_chars: int, leaf_chars: int) -> DataFrame:
    """row, piece, ids, joins of each piece, from the tree of its parts: a round
    per level, neighbours meeting in one task."""

    def leaf(batches):
        for row, piece, at, n, text, ids, joins in _rows(batches):
            if ids is None:
                found, joins = load(path).tree(text, leaf_chars)
                ids = found.tobytes()
            yield _node(row, piece, at, n, text, ids, joins)

    def pair(batches):
        held = None
        for row, piece, at, n, text, ids, joins in _rows(batches):
            if at % 2 == 0 and at + 1 < n:
                held = (text, ids, joins)
                continue
            if at % 2:
                before, left, more = held
                whole = before + text
                ids = load(path).join(np.frombuffer(left, np.uint32), np.frombuffer(ids, np.uint32), whole, len(before)).tobytes()
                text, joins, held = whole, joins + more + 1, None
            yield _node(row, piece, at >> 1, (n + 1) >> 1, text, ids, joins)

    nodes = written(_parts_of(texts, path, part_chars).mapInArrow(tidy(leaf), NODE), "bpe-level-0")
    ended = ("row", "piece", "ids", "joins")
    done, level = nodes.filter("n = 1").select(*ended), 0
    nodes = nodes.filter("n > 1")
    while nodes.head(1):
        level += 1
        dealt = nodes.withColumn("up", F.shiftright("at", 1)).repartition("row", "piece", "up").sortWithinPartitions("row", "piece", "at").drop("up")
        step = written(dealt.mapInArrow(tidy(pair), NODE), f"bpe-level-{level}")
        done = done.unionByName(step.filter("n = 1").select(*ended))
        nodes = step.filter("n > 1")
    return done


def encode(df: DataFrame, tokenizer: str | None = None, leaf_chars: int = LEAF_CHARS, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False, part_chars: int = PART_CHARS) -> DataFrame:
    """``keep`` columns, n_tokens, n_joins (the joins that made the encoding)
    and, for each text, ``ids`` (array of int) or the digests of ids and of the
    text decoded from them. ``tokenizer`` is the file of a byte-level BPE
    tokenizer, which each worker reads once."""
    path = tokenizer or default_tokenizer()
    names = [f"_keep{n}" for n in range(len(keep))]
    src = df.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kinds = [f"{n} {src.schema[n].dataType.simpleString()}" for n in names]
    outs = [*names, "n_tokens", "n_joins", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    schema = ", ".join([*kinds, "n_tokens bigint", "n_joins bigint", *["ids array<int>"] * ids, *["ids_sha256 string, decoded_sha256 string"] * digests])

    def result(kept, found):
        cols = [*kept, pa.array([len(x) for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
        if ids:
            cols.append(pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())))
        if digests:
            cols.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x, _ in found], pa.string()))
            cols.append(pa.array([hashlib.sha256(load(path).decode(x.tolist())).hexdigest() for x, _ in found], pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=outs)

    def short(batches):
        enc = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield result(part.columns[:-1], [enc.encode(t.as_py(), leaf_chars) for t in part.column(len(keep))])

    def strung(batches):
        row, kept, held, joins = None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r, x, n = (c[i].as_py() for c in batch.columns[:3])
                if r != row:
                    if held:
                        yield result(kept, [(np.frombuffer(b"".join(held), np.uint32), joins)])
                    row, kept, held, joins = r, batch.slice(i, 1).columns[3:], [], 0
                held.append(x)
                joins += n
        if held:
            yield result(kept, [(np.frombuffer(b"".join(held), np.uint32), joins)])

    few = src.filter(F.char_length("_text") <= part_chars).mapInArrow(tidy(short), schema)
    long = written(src.filter(F.char_length("_text") > part_chars).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    if long.head(1):
        # one Python function in the stage: with two, each core would hold two workers
        pieces = _tree_ids(long, path, part_chars, leaf_chars).join(long.drop("_text"), "row")
        lists = pieces.repartition("row").sortWithinPartitions("row", "piece").select("row", "ids", "joins", *names)
        few = few.unionByName(lists.mapInArrow(tidy(strung), schema))
    return few.toDF(*keep, *outs[len(keep) :])


def decode(df: DataFrame, tokenizer: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text`` decoded from the ``ids`` column."""
    path = tokenizer or default_tokenizer()
    src = df.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))
    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep) + ", text string"

    def run(batches):
        for batch in batches:
            found = [load(path).decode(x or []).decode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.string())], names=[*keep, "text"])

    return src.mapInArrow(tidy(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ids=False, digests=True)
