"""Text functions: analyzers, splitting, excerpts, HTML to text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import english, german

# Words that the english and german analyzers drop.
ENGLISH_STOP = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
GERMAN_STOP = (
    "aber", "als", "am", "an", "auch", "auf", "aus", "bei", "bin", "bis", "bist", "da", "damit", "dann", "das", "dass", "daß", "dein", "dem", "den", "der", "des", "dich", "die", "dir", "du", "ein", "eine", "einem",
    "einen", "einer", "eines", "er", "es", "für", "hab", "habe", "haben", "hat", "hatte", "hatten", "ich", "ihr", "ihm", "ihn", "im", "in", "ist", "ja", "kann", "mein", "mich", "mir", "mit", "nach", "nicht",
    "noch", "nun", "nur", "ob", "oder", "ohne", "sein", "sich", "sie", "sind", "so", "über", "um", "und", "uns", "unter", "vom", "von", "vor", "war", "waren", "was", "weil", "wenn", "wie", "wir", "wird", "zu",
    "zum", "zur",
)
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Analyzer: what parts words, which words are dropped, and what makes stems.
ANALYZERS = {"simple": ("[^a-z0-9]+", (), None), "unicode": (r"[^\p{L}\p{N}]+", (), None), "english": ("[^a-z0-9]+", ENGLISH_STOP, english), "german": (r"[^\p{L}\p{N}]+", GERMAN_STOP, german)}


def words(text: Column, analyzer: str = "simple") -> Column:
    """Array of (term, place): the terms of a text with their places among its
    words, from 1; dropped words keep theirs."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"no analyzer {analyzer!r}")
    parts, stop, stems = ANALYZERS[analyzer]
    out = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), parts), "")
    if not stop:
        return F.transform(out, lambda t, i: F.struct(t.alias("term"), (i + 1).alias("place")))
    kept = F.filter(F.transform(out, lambda t, i: F.struct(t.alias("term"), (i + 1).alias("place"))), lambda x: ~x["term"].isin(*stop))
    stemmed = stems(F.transform(kept, lambda x: x["term"]))
    return F.transform(F.arrays_zip(stemmed.alias("term"), F.transform(kept, lambda x: x["place"]).alias("place")), lambda x: F.struct(x["term"].alias("term"), x["place"].alias("place")))


def tokens(text: Column, analyzer: str = "simple") -> Column:
    """Terms of a text. ``simple``: runs of ASCII letters and digits, lower
    case; ``unicode``: runs of any letters and digits; ``english`` and
    ``german``: without common words, the rest cut to their stems."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"no analyzer {analyzer!r}")
    parts, stop, stems = ANALYZERS[analyzer]
    out = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), parts), "")
    return stems(F.filter(out, lambda t: ~t.isin(*stop))) if stems else out


def parse_vector_text(text: Column) -> Column:
    """Counts of a text-search vector ``'term':1,7 'other':3``: term -> number
    of positions; doubled quotes are one, repeated terms add up, blank is empty."""
    terms = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"'((?:[^']|'')*)'(?::([0-9A-D,]+))?"), F.lit(1))
    places = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"'((?:[^']|'')*)'(?::([0-9A-D,]+))?"), F.lit(2))
    pairs = F.arrays_zip(F.transform(terms, lambda t: F.replace(t, F.lit("''"), F.lit("'"))).alias("t"), F.transform(places, lambda p: F.when(p == "", 1).otherwise(F.size(F.split(p, ",")))).alias("n"))
    names = F.array_distinct(F.transform(pairs, lambda p: p["t"]))
    return F.map_from_entries(F.transform(names, lambda t: F.struct(t, F.aggregate(F.filter(pairs, lambda p: p["t"] == t), F.lit(0), lambda s, p: s + p["n"]))))


def excerpt(text: Column, chars: int = 200) -> Column:
    return F.concat(F.substring(text, 1, chars), F.lit("..."))


#: Characters of the blocks that long texts are cut into once, so that a piece
#: is not looked for from the start of the text.
BLOCK = 4096


def pieces(text: Column, spans: Column) -> Column:
    """The substrings of ``text`` at an array of (a, b), from 0, end exclusive.
    The text is cut into blocks in one pass; a piece is put together from the
    blocks it touches."""
    from .headers import let

    def cut(blocks, s):
        first, last = F.floor(s["a"] / BLOCK).cast("int"), F.floor((s["b"] - 1) / BLOCK).cast("int")
        near = F.when(first == last, blocks[first]).otherwise(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
        return F.when(s["b"] > s["a"], F.substring(near, (s["a"] - first * BLOCK + 1).cast("int"), (s["b"] - s["a"]).cast("int"))).otherwise(F.lit(""))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: F.transform(spans, lambda s: cut(blocks, s)))


def window_count(text: Column, size: int = 500, overlap: int = 10) -> Column:
    """How many windows() a text has, from its length alone."""
    n = F.greatest(F.ceil((F.char_length(text) - overlap) / F.lit(size - overlap)), F.lit(1)).cast("int")
    return F.when(F.char_length(text) > 0, n).otherwise(0)


def windows(text: Column, size: int = 500, overlap: int = 10) -> Column:
    """Array of (n, text): fixed windows of characters, each ``overlap`` into
    the one before. Empty texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be under the size")
    step = size - overlap
    n = F.greatest(F.ceil((F.char_length(text) - overlap) / F.lit(step)), F.lit(1)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("a"), F.least(i * step + size, F.char_length(text)).alias("b")))
    cut = F.transform(pieces(text, spans), lambda t, i: F.struct(i.alias("n"), t.alias("text")))
    return F.when(F.char_length(text) > 0, cut)


def recursive_pieces(text: Column, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of the pieces of a text, of at most ``size`` characters, cut at
    paragraphs, else lines, sentences, words, characters. Parts, each with the
    separator that ends it, are put together as long as they fit; a piece begins
    with the last ``overlap`` characters of the one before, if these and the next part
    fit. A part that is itself too long is cut at the next separator, without overlap
    with what is before. Null and empty texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be under the size")
    return F.when(F.char_length(text) > 0, _recursive(text, size, overlap, separators)).otherwise(F.array().cast("array<string>"))


def _recursive(text: Column, size: int, overlap: int, separators: tuple[str, ...]) -> Column:
    whole = F.when(F.char_length(text) <= size, F.array(text))
    if not separators:
        step = size - overlap
        last = F.ceil(F.greatest(F.char_length(text) - overlap, F.lit(1)) / F.lit(step)).cast("int") - 1
        return whole.otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size))))

    def take(s: Column, part: Column) -> Column:
        n = F.char_length(part)
        full = (s["held"] != "") & (F.char_length(s["held"]) + n > size)
        out = F.when(full, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])
        again = F.right(s["held"], F.lit(overlap)) if overlap else F.lit("")
        held = F.when(full, F.when(n + overlap <= size, again).otherwise("")).otherwise(s["held"])
        long = n > size
        out = F.when(long, F.concat(out, _recursive(part, size, overlap, separators[1:]))).otherwise(out)
        return F.struct(out.alias("out"), F.when(long, held).otherwise(F.concat(held, part)).alias("held"))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).*?{re.escape(separators[0])}|.+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    return whole.otherwise(F.aggregate(parts, start, take, lambda s: F.when(s["held"] != "", F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, the
    usual entities decoded, white space collapsed."""
    h = F.coalesce(html, F.lit(""))
    h = F.regexp_replace(h, r"(?is)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?is)<head[^>]*>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        h = F.replace(h, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(h, r"[ \t\n\r\f\x0B]+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\n\r\f\x0B]+", " "))
