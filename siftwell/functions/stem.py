"""Suffix stripping in the manner of the published Snowball algorithms, as
column expressions.

A word is a struct of its letters and where its regions begin: R1 is what follows
the first non-vowel after a vowel, R2 the same within R1. Each step of an
algorithm is a function of such a struct, and a stemmer is a chain of them over an
array of words, so no step repeats the expression of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the English algorithm.
EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
EN_PREFIXES = ("gener", "commun", "arsen")
EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EN_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
EN_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
EN_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
EN_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
# Fixed values of the German algorithm.
DE_VOWELS = "aeiouyäöü"
DE_S, DE_ST = "bdfghklmnrt", "bdfghklmnt"

Step = Callable[[Column], Column]


def _word(letters: Column, r1: Column, r2: Column) -> Column:
    return F.struct(letters.alias("w"), r1.alias("r1"), r2.alias("r2"))


def _with(x: Column, letters: Column) -> Column:
    return _word(letters, x["r1"], x["r2"])


def _less(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _in(x: Column, region: str, n: int | Column) -> Column:
    """Whether the last ``n`` letters lie in a region."""
    return F.length(x["w"]) - n >= x[region]


def _longest(w: Column, suffixes: dict[str, Column], other: Column) -> Column:
    """What is said of the longest suffix that the word has."""
    out = other
    for s in sorted(suffixes, key=len):
        out = F.when(w.endswith(s), suffixes[s]).otherwise(out)
    return out


def _regions(vowels: str, least: int = 0, prefixes: tuple[str, ...] = ()) -> Step:
    pattern = f"^[^{vowels}]*[{vowels}]+[^{vowels}]"
    after = lambda w: F.coalesce(F.nullif(F.length(F.regexp_extract(w, pattern, 0)), F.lit(0)), F.length(w))

    def one(w: Column) -> Column:
        r1 = after(w)
        for p in prefixes:
            r1 = F.when(w.startswith(p), len(p)).otherwise(r1)
        return F.struct(w.alias("w"), r1.alias("r1"))

    def two(x: Column) -> Column:
        rest = F.substring(x["w"], x["r1"] + 1, F.length(x["w"]))
        return _word(x["w"], F.greatest(x["r1"], F.least(F.lit(least), F.length(x["w"]))), x["r1"] + after(rest))

    return lambda words: F.transform(F.transform(words, one), two)


def _chain(words: Column, steps: list[Step]) -> Column:
    for step in steps:
        words = F.transform(words, step)
    return words


# English


def _en_1a(x: Column) -> Column:
    w = x["w"]
    ie = F.when(F.length(w) > 4, _less(w, 2)).otherwise(_less(w, 1))
    out = _longest(w, {"sses": _less(w, 2), "ied": ie, "ies": ie, "us": w, "ss": w, "s": F.when(w.rlike("[aeiouy].+s$"), _less(w, 1)).otherwise(w)}, w)
    return _with(x, out)


def _en_1b(x: Column) -> Column:
    w, cut = x["w"], lambda n: F.when(_less(x["w"], n).rlike("[aeiouy]"), _less(x["w"], n))
    ee = lambda n, k: F.when(_in(x, "r1", n), _less(w, k)).otherwise(w)
    # what is cut goes on to _en_1b_end, marked by a bar
    mark = lambda n: F.coalesce(F.concat(cut(n), F.lit("|")), w)
    return _with(x, _longest(w, {"eed": ee(3, 1), "eedly": ee(5, 3), "ed": mark(2), "edly": mark(4), "ing": mark(3), "ingly": mark(5)}, w))


def _en_1b_end(x: Column) -> Column:
    w = _less(x["w"], 1)
    short = w.rlike(EN_SHORT) & (F.length(w) <= x["r1"])
    out = F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(f"({'|'.join(EN_DOUBLES)})$"), _less(w, 1)).when(short, F.concat(w, F.lit("e"))).otherwise(w)
    return _with(x, F.when(x["w"].endswith("|"), out).otherwise(x["w"]))


def _en_1c(x: Column) -> Column:
    return _with(x, F.regexp_replace(x["w"], "(?<=.[^aeiouy])[yY]$", "i"))


def _swapped(x: Column, table: dict[str, str]) -> dict[str, Column]:
    w = x["w"]
    return {s: F.when(_in(x, "r1", len(s)), F.concat(_less(w, len(s)), F.lit(t))).otherwise(w) for s, t in table.items()}


def _en_2(x: Column) -> Column:
    w = x["w"]
    more = {"ogi": F.when(_in(x, "r1", 3) & w.endswith("logi"), _less(w, 1)).otherwise(w), "li": F.when(_in(x, "r1", 2) & w.rlike("[cdeghkmnrt]li$"), _less(w, 2)).otherwise(w)}
    return _with(x, _longest(w, _swapped(x, EN_STEP_2) | more, w))


def _en_3(x: Column) -> Column:
    w = x["w"]
    return _with(x, _longest(w, _swapped(x, EN_STEP_3) | {"ative": F.when(_in(x, "r2", 5), _less(w, 5)).otherwise(w)}, w))


def _en_4(x: Column) -> Column:
    w = x["w"]
    gone = {s: F.when(_in(x, "r2", len(s)), _less(w, len(s))).otherwise(w) for s in EN_STEP_4}
    return _with(x, _longest(w, gone | {"ion": F.when(_in(x, "r2", 3) & w.rlike("[st]ion$"), _less(w, 3)).otherwise(w)}, w))


def _en_5(x: Column) -> Column:
    w = x["w"]
    e = _in(x, "r2", 1) | (_in(x, "r1", 1) & ~_less(w, 1).rlike(EN_SHORT))
    return _with(x, F.when(w.endswith("e") & e, _less(w, 1)).when(w.endswith("ll") & _in(x, "r2", 1), _less(w, 1)).otherwise(w))


def english(words: Column) -> Column:
    """Stems of an array of lower-case English words."""
    marked = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "(?<=[aeiouy])y", "Y"))
    stemmed = _chain(_regions("aeiouy", prefixes=EN_PREFIXES)(marked), [_en_1a])
    rest = _chain(stemmed, [_en_1b, _en_1b_end, _en_1c, _en_2, _en_3, _en_4, _en_5])

    def whole(x: Column) -> Column:
        w = x["w"]
        out = F.lower(F.when(x["kept"]["w"].isin(*EN_KEPT), x["kept"]["w"]).otherwise(x["s"]["w"]))
        out = F.when(F.length(w) <= 2, w).otherwise(out)
        for k, v in EN_WHOLE.items():
            out = F.when(w == k, F.lit(v)).otherwise(out)
        return out

    return F.transform(F.arrays_zip(words.alias("w"), stemmed.alias("kept"), rest.alias("s")), whole)


# German


def _de_1(x: Column) -> Column:
    w, gone = x["w"], lambda n: F.when(_in(x, "r1", n), _less(x["w"], n)).otherwise(x["w"])
    b = lambda n: F.regexp_replace(F.when(_in(x, "r1", n), F.concat(_less(w, n), F.lit("|"))).otherwise(w), "(?<=nis)s\\|$|\\|$", "")
    s = F.when(w.rlike(f"[{DE_S}]s$") & _in(x, "r1", 1), _less(w, 1)).otherwise(w)
    return _with(x, _longest(w, {"em": gone(2), "ern": gone(3), "er": gone(2), "e": b(1), "en": b(2), "es": b(2), "s": s}, w))


def _de_2(x: Column) -> Column:
    w, gone = x["w"], lambda n: F.when(_in(x, "r1", n), _less(x["w"], n)).otherwise(x["w"])
    st = F.when(w.rlike(f"...[{DE_ST}]st$") & _in(x, "r1", 2), _less(w, 2)).otherwise(w)
    return _with(x, _longest(w, {"en": gone(2), "er": gone(2), "est": gone(3), "st": st}, w))


def _de_3(x: Column) -> Column:
    """Marks the first suffix that goes, for _de_3_end to look before it."""
    w, gone = x["w"], lambda n, mark: F.when(_in(x, "r2", n), F.concat(_less(x["w"], n), F.lit(mark))).otherwise(x["w"])
    no_e = lambda n: F.when(_in(x, "r2", n) & ~_less(w, n).endswith("e"), _less(w, n)).otherwise(w)
    return _with(x, _longest(w, {"end": gone(3, "1"), "ung": gone(3, "1"), "ig": no_e(2), "ik": no_e(2), "isch": no_e(4), "lich": gone(4, "2"), "heit": gone(4, "2"), "keit": gone(4, "3")}, w))


def _de_3_end(x: Column) -> Column:
    w, mark = F.regexp_replace(x["w"], "[123]$", ""), F.regexp_extract(x["w"], "[123]$", 0)
    y = _with(x, w)
    one = F.when(w.rlike("(?<!e)ig$") & _in(y, "r2", 2), _less(w, 2)).otherwise(w)
    two = F.when(w.rlike("e[rn]$") & _in(y, "r1", 2), _less(w, 2)).otherwise(w)
    three = F.when(w.endswith("lich") & _in(y, "r2", 4), _less(w, 4)).when(w.endswith("ig") & _in(y, "r2", 2), _less(w, 2)).otherwise(w)
    return _with(x, F.when(mark == "1", one).when(mark == "2", two).when(mark == "3", three).otherwise(w))


def german(words: Column) -> Column:
    """Stems of an array of lower-case German words."""
    v = f"[{DE_VOWELS}]"
    between = lambda w, c: F.regexp_replace(w, f"(?<={v}){c}(?={v})", c.upper())
    marked = F.transform(words, lambda w: between(between(F.regexp_replace(w, "ß", "ss"), "u"), "y"))
    # digits in words are none of the marks
    stemmed = _chain(_regions(DE_VOWELS, least=3)(marked), [_de_1, _de_2, _de_3, _de_3_end])
    done = F.transform(stemmed, lambda x: F.translate(F.lower(x["w"]), "äöü", "aou"))
    return F.transform(F.arrays_zip(words.alias("w"), done.alias("s")), lambda x: F.when(x["w"].rlike("[0-9]"), x["w"]).otherwise(x["s"]))
