"""Spreadsheet headers: canonical keys, dynamic keys, range notes and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STRUCTURAL_KEYS

# Canonical keys with the headers that mean them.
SYNONYMS = {
    "offeringName": ("offering name", "offeringname", "offering"),
    "externalId": ("external id", "externalid", "ext id"),
    "flatOfferingId": ("flat offering id", "flatofferingid", "flat offering", "fo id", "foid", "offering id", "offeringid"),
    "changeRequestId": ("change request id", "cr id", "changerequestid", "crid", "change request"),
    "bundleId": ("bundle id", "bundleid"),
    "bundleName": ("bundle name", "bundlename"),
    "tariffName": ("tariff name", "tariffname"),
    "discountId": ("discount id", "discountid", "disc id", "discid"),
    "discountName": ("discount name", "discountname"),
    "ruleId": ("rule id", "ruleid"),
    "ruleName": ("rule name", "rulename"),
    "relationId": ("relation id", "relationid"),
    "priceKey": ("price key", "pricekey", "price key id", "pricekeyid"),
}
LEGACY_KEYS = {"priceKeyId": "priceKey"}
TAB_HEADER, RANGE_NOTE, RANGE_WARNINGS, HAS_WARNING = "tabHeader", "idRangeNote", "rangeWarnings", "hasRangeWarning"
START, END, WARNING = "RangeStart", "RangeEnd", "RangeWarning"
RANGE = r"(?i)([A-Za-z][A-Za-z .]*?)\s+range\s*:?\s*(\d+)(?:\s*(?:-|–|to)\s*(\d+))?"
NUMBER = r"(\d+(?:\.\d+)?)"


def normalize(header: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), "[^a-z0-9]", "")


def is_identifier(header: Column) -> Column:
    """Normalised header ends like an identifier; repeated ones (#) do not count."""
    return F.coalesce(~header.contains("#") & normalize(header).rlike("(id|name|key|code)$"), F.lit(False))


def dynamic_key(header: Column) -> Column:
    tokens = F.filter(F.split(F.coalesce(header, F.lit("")), "[^A-Za-z0-9]+"), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t, i: F.when(i == 0, F.lower(t)).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20))))), "")


def is_reserved(key: Column) -> Column:
    fixed = [*STRUCTURAL_KEYS, *SYNONYMS, TAB_HEADER, RANGE_NOTE, RANGE_WARNINGS, HAS_WARNING, *LEGACY_KEYS]
    return key.isin(*fixed) | key.endswith(START) | key.endswith(END) | key.endswith(WARNING)


def match_keys(headers: Column, business_fields: dict[str, str] | None = None) -> Column:
    """Array of (col, header) in the order of columns -> array of (key, col):
    canonical keys first, configured fields next, dynamic identifiers last; a
    column is claimed once and the first column of a key wins."""
    plain = lambda text: "".join(c for c in text.lower() if c.isalnum())
    fixed = {plain(name): key for key, names in SYNONYMS.items() for name in names}
    fields = {plain(k): v for k, v in (business_fields or {}).items() if plain(k) and v and v.strip() and v not in STRUCTURAL_KEYS and v != TAB_HEADER}

    def looked_up(words: dict[str, str], norm: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in words.items() for x in pair)), norm) if words else F.lit(None).cast("string")

    def candidate(h):
        key = dynamic_key(h["header"])
        own = let(key, lambda k: F.when(is_identifier(h["header"]) & (k != "") & ~is_reserved(k), k))
        return let(normalize(h["header"]), lambda n: F.struct(h["col"].alias("col"), looked_up(fixed, n).alias("fixed"), looked_up(fields, n).alias("field"), own.alias("own")))

    def claim(left: Column, kind: str, gone: Column, body) -> Column:
        """body(the first of each key of a kind, the columns that are left)."""
        keys = F.transform(left, lambda x: x[kind])

        def first(ks, x, i):
            return F.coalesce((F.array_position(ks, x[kind]) == i + 1) & ~F.array_contains(gone, x[kind]), F.lit(False))

        taken = lambda ks: F.transform(F.filter(left, lambda x, i: first(ks, x, i)), lambda x: F.struct(x[kind].alias("key"), x["col"].alias("col")))
        rest = lambda ks: F.filter(left, lambda x, i: ~first(ks, x, i))
        return let(keys, lambda ks: let(taken(ks), lambda t: let(rest(ks), lambda r: body(t, r))))

    none = F.array().cast("array<string>")
    names = lambda taken: F.transform(taken, lambda t: t["key"])
    last = lambda a, b: lambda c, _: F.concat(a, b, c)
    second = lambda a: lambda b, r: claim(r, "own", names(b), last(a, b))
    return let(F.transform(headers, candidate), lambda c: claim(c, "fixed", none, lambda a, r: claim(r, "field", names(a), second(a))))


def match_headers(headers: DataFrame, business_fields: dict[str, str] | None = None) -> DataFrame:
    """match_keys() of ``headers`` (workbook, sheet, col, header), one row per
    key: workbook, sheet, key, col."""
    whole = headers.groupBy("workbook", "sheet").agg(F.sort_array(F.collect_list(F.struct("col", "header"))).alias("h"))
    return whole.select("workbook", "sheet", F.inline(match_keys(F.col("h"), business_fields)))


def range_hints(headers: Column) -> Column:
    """Map of <key>RangeStart / <key>RangeEnd from all range notes in an array
    of headers; the first note of a key wins."""
    joined = F.array_join(F.transform(F.filter(headers, lambda h: h.isNotNull()), lambda h: h), "\n|\n")
    labels, starts, ends = (F.regexp_extract_all(joined, F.lit(RANGE), F.lit(g)) for g in (1, 2, 3))
    notes = F.arrays_zip(labels.alias("label"), starts.alias("a"), ends.alias("b"))
    entries = F.flatten(
        F.transform(
            notes,
            lambda n: F.filter(
                F.array(
                    F.struct(F.concat(dynamic_key(n["label"]), F.lit(START)).alias("k"), n["a"].alias("v")),
                    F.struct(F.concat(dynamic_key(n["label"]), F.lit(END)).alias("k"), F.when(n["b"] != "", n["b"]).alias("v")),
                ),
                lambda e: e["v"].isNotNull(),
            ),
        )
    )

    def first(es):
        keys = F.transform(es, lambda e: e["k"])
        places = F.transform(es, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), (i + 1).alias("i")))
        return let(keys, lambda ks: F.map_from_entries(F.transform(F.filter(places, lambda e: F.array_position(ks, e["k"]) == e["i"]), lambda e: F.struct(e["k"], e["v"]))))

    return let(entries, first)


def range_note(headers: Column) -> Column:
    """All range notes of an array of headers as they stand, joined."""
    notes = F.flatten(F.transform(F.filter(headers, lambda h: h.isNotNull()), lambda h: F.regexp_extract_all(h, F.lit(RANGE), F.lit(0))))
    return F.array_join(F.transform(notes, lambda n: F.trim(n)), "; ")


def first_number(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, NUMBER, 1), F.lit("")).try_cast("double")


def trim_number(raw: Column) -> Column:
    """The first number without a trailing .0; the text itself without one."""
    v = first_number(raw)
    return F.when(v.isNull(), raw).when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def check_range(key: Column, value: Column, start: Column, end: Column) -> Column:
    """Message of a value outside its documented range, else null."""
    outside = F.format_string("%s=%s is outside its sheet's documented range (%s-%s)", key, trim_number(value), trim_number(start), trim_number(end))
    below = F.format_string("%s=%s is below its sheet's documented range start (%s)", key, trim_number(value), trim_number(start))
    numbers = F.struct(first_number(value).alias("v"), first_number(start).alias("a"), first_number(end).alias("b"))
    return let(numbers, lambda n: F.when(n["b"].isNotNull(), F.when((n["v"] < n["a"]) | (n["v"] > n["b"]), outside)).when(n["v"] < n["a"], below))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def warnings_of(fields: Column) -> Column:
    """(key, message) of every checkable field of a metadata map."""
    fixed = [*STRUCTURAL_KEYS, TAB_HEADER, RANGE_NOTE, RANGE_WARNINGS, HAS_WARNING]

    def one(e):
        k = e["key"]
        plain = ~(k.isin(*fixed) | k.endswith(START) | k.endswith(END) | k.endswith(WARNING))
        say = check_range(k, e["value"], F.element_at(fields, F.concat(k, F.lit(START))), F.element_at(fields, F.concat(k, F.lit(END))))
        return F.struct(k.alias("key"), F.when(plain & (F.trim(e["value"]) != ""), say).alias("message"))

    return F.array_sort(F.filter(F.transform(F.map_entries(fields), one), lambda e: e["message"].isNotNull()))


def with_warnings(fields: Column) -> Column:
    """The map with a warning per field, all of them joined, and a flag.
    Warnings that no longer hold stay; a second run changes nothing."""

    def put(f, found):
        own = F.map_from_entries(F.transform(found, lambda e: F.struct(F.concat(e["key"], F.lit(WARNING)), e["message"])))
        total = F.create_map(F.lit(RANGE_WARNINGS), F.array_join(F.transform(found, lambda e: e["message"]), "; "), F.lit(HAS_WARNING), F.lit("true"))
        merged = let(F.map_concat(own, total), lambda new: F.map_concat(F.map_filter(f, lambda k, _: ~F.map_contains_key(new, k)), new))
        return F.when(F.size(found) > 0, merged).otherwise(f)

    return let(fields, lambda f: let(warnings_of(f), lambda found: put(f, found)))


def reconcile_legacy(fields: Column) -> Column:
    """Old key names renamed; a canonical value that is not blank stays."""
    for old, new in LEGACY_KEYS.items():
        fields = let(fields, _renamer(old, new))
    return fields


def _renamer(old: str, new: str):
    def rename(fields: Column) -> Column:
        had, own = F.element_at(fields, F.lit(old)), F.element_at(fields, F.lit(new))
        rest = F.map_filter(fields, lambda k, _: ~k.isin(old, new))
        kept = F.when(F.coalesce(F.trim(own), F.lit("")) != "", own).otherwise(had)
        return F.when(F.map_contains_key(fields, F.lit(old)), F.map_concat(rest, F.create_map(F.lit(new), kept))).otherwise(fields)

    return rename


def without_reserved(fields: Column) -> Column:
    """Business metadata: no structural keys, no blank values."""
    return F.map_filter(fields, lambda k, v: ~k.isin(*STRUCTURAL_KEYS) & (F.coalesce(F.trim(v), F.lit("")) != ""))


def column_letter(index: Column) -> Column:
    """0 -> A, 26 -> AA, up to three letters."""
    digit = lambda n: F.chr((n % 26 + 65).cast("bigint"))
    one = digit(index)
    two = F.concat(digit(F.floor(index / 26) - 1), digit(index))
    three = F.concat(digit(F.floor((index - 702) / 676)), digit(F.floor((index - 702) / 26) % 26), digit(index))
    return F.when(index < 26, one).when(index < 702, two).otherwise(three)
