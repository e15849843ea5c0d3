"""Rule-based classifiers as column expressions; the order of rules decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOKUP, EXPLANATION = "LOOKUP", "EXPLANATION"

# Phrases and prefixes of the question intents.
LOOKUP_PHRASES = (
    "offering name", "flat offering id", "flat offering", "offering id", "external id", "cr id", "change request id", "product id", "service id", "bundle id", "bundle name",
    "discount id", "discount name", "rule id", "rule name", "relation id", "tariff name", "price key", "price list item", "offering template", "design task", "tuti",
)
EXPLANATION_PREFIXES = ("what is", "what are", "what's", "explain", "describe", "how does", "how do", "how is", "how are", "why does", "why is", "why do", "define", "tell me about")

# Keywords of the two question types.
EXCEL_KEYWORDS = ("flat offering", "offering id", "offering name", "external id", "relation id", "rule id", "discount id", "price key", "offering template", "design task", "find")
DOCX_KEYWORDS = ("what is", "what are", "how does", "how do", "how is", "explain", "why does", "why is", "describe")

# Sheet types by parts of the normalised name, most specific first.
SHEET_TYPES = (
    ("optionalOffering", ("optionaloffering",)),
    ("relationsOverride", ("relationsoverride", "relationoverride")),
    ("characteristicsOverride", ("characteristicsoverride", "characteristicoverride")),
    ("priceListItem", ("pricelist",)),
    ("complexFlatRule", ("complexflatrule", "complexrule")),
    ("refill", ("refill",)),
    ("discount", ("discount",)),
    ("rule", ("rule",)),
    ("offering", ("offering",)),
)

# Replies that rate an answer, and that decline a comment.
THUMBS_UP = ("👍", "👍🏻", "👍🏼", "👍🏽", "👍🏾", "👍🏿", "+1", "thumbsup", "thumbs up", "good answer", "helpful", "great answer")
THUMBS_DOWN = ("👎", "👎🏻", "👎🏼", "👎🏽", "👎🏾", "👎🏿", "-1", "thumbsdown", "thumbs down", "bad answer", "not helpful", "unhelpful", "wrong answer")
SKIP_COMMENT = ("skip", "no", "no thanks", "nope", "nvm", "none", "nothing", "cancel", "n/a")

CATALOG = "catalog"
EXPLANATION_CATEGORIES = ("fds", "brd", "rules", "general")
SUPPORTED_SUFFIXES = ("pdf", "docx", "doc", "xlsx", "xls", "txt", "md")

#: ASCII word borders without look-around, so that other engines can run them.
_EDGE, _END = "(^|[^a-z0-9_])", "([^a-z0-9_]|$)"
INTENT_LOOKUP = _EDGE + "(" + "|".join(LOOKUP_PHRASES) + ")" + _END
INTENT_EXPLAIN = "^(" + "|".join(EXPLANATION_PREFIXES) + ")" + _END
INTENT_ID = _EDGE + "id" + _END
INTENT_CODE = _EDGE + "[a-z]{1,6}[-_]?[0-9]{2,}" + _END


def trimmed(c: Column) -> Column:
    """Without leading and trailing characters up to the space."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def intent(question: Column) -> Column:
    q = F.lower(trimmed(F.coalesce(question, F.lit(""))))
    hit = F.lit(LOOKUP)
    return F.when(q.rlike(INTENT_LOOKUP), hit).when(q.rlike(INTENT_EXPLAIN), F.lit(EXPLANATION)).when(q.rlike(INTENT_ID) | q.rlike(INTENT_CODE), hit).otherwise(F.lit(EXPLANATION))


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def query_type(question: Column, excel=EXCEL_KEYWORDS, docx=DOCX_KEYWORDS) -> Column:
    """EXCEL, DOCX or null by the first list with a keyword in the question."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.when(_any(q, [k.lower() for k in excel]), "EXCEL").when(_any(q, [k.lower() for k in docx]), "DOCX")


def doc_category(name: Column, kind: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    word = lambda w: n.rlike(f"(^|[^a-z]){w}([^a-z]|$)")
    return (
        F.when(kind == "EXCEL", CATALOG)
        .when(word("fds") | n.contains("functional design") | n.contains("functional_design"), "fds")
        .when(word("brd") | n.contains("business requirement"), "brd")
        .when(n.contains("rule"), "rules")
        .otherwise("general")
    )


def sheet_type(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    out = F.lit("general")
    for kind, parts in reversed(SHEET_TYPES):
        out = F.when(_any(n, parts), kind).otherwise(out)
    return out


def file_type(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.endswith(".pdf"), "PDF").when(n.rlike(r"\.docx?$"), "DOCX").when(n.rlike(r"\.xlsx?$"), "EXCEL").when(n.rlike("^https?://"), "URL").otherwise("TXT")


def is_supported_file(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"\.(" + "|".join(SUPPORTED_SUFFIXES) + ")$"), F.lit(False))


def feedback_shortcut(reply: Column) -> Column:
    r = F.lower(trimmed(reply))
    return F.when(r.isin(*THUMBS_UP), "UP").when(r.isin(*THUMBS_DOWN), "DOWN")


def rating(raw: Column) -> Column:
    """UP or DOWN, null for anything else: those go to the rejects."""
    r = F.upper(trimmed(raw))
    return F.when(r.isin("UP", "DOWN"), r)
