"""Fetched web pages as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text, html_title


def page_documents(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """page_id, source, title, text of pages; known sources are left out."""
    out = pages.select("page_id", F.col("url").alias("source"), html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"))
    return out if known is None else out.join(known.select("source"), "source", "left_anti")
