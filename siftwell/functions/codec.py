"""JSON columns, metadata maps and lists of sources, and database addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"
#: Port of a database address that names none.
DATABASE_PORT = 5432


def metadata(raw: Column) -> Column:
    """The map in a JSON text, without null values; empty for blanks and for
    what is no JSON object."""
    return F.coalesce(F.map_filter(F.from_json(raw, MAP), lambda _, v: v.isNotNull()), F.expr(f"cast(map() as {MAP})"))


def metadata_error(raw: Column) -> Column:
    """The strict reading's complaint about a text that is neither blank nor a
    JSON object, else null."""
    bad = F.from_json(raw, MAP).isNull() & (F.trim(F.coalesce(raw, F.lit(""))) != "")
    return F.when(bad, F.concat(F.lit("unparseable metadata JSON: "), F.substring(raw, 1, 80)))


def metadata_json(fields: Column) -> Column:
    return F.to_json(F.coalesce(fields, F.expr(f"cast(map() as {MAP})")))


def sources_json(sources: Column) -> Column:
    """A list of sources as JSON; null is the empty list."""
    return F.to_json(F.coalesce(sources, F.expr("cast(array() as array<string>)")))


def sources(raw: Column) -> Column:
    """The list in a JSON text; empty for blanks and for what does not parse."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.expr("cast(array() as array<string>)"))


def database_parts(url: Column) -> Column:
    """host, port and database of ``jdbc:kind://host[:port]/database``."""
    parts = F.split(F.regexp_replace(url, "^jdbc:[a-z0-9]+://", ""), "/")
    host = F.split(F.get(parts, F.lit(0)), ":")
    return F.struct(F.get(host, F.lit(0)).alias("host"), F.coalesce(F.get(host, F.lit(1)).try_cast("int"), F.lit(DATABASE_PORT)).alias("port"), F.get(parts, F.lit(1)).alias("database"))
