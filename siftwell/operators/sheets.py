"""Spreadsheets as cells: rows, chunks, metadata, and maintenance of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Sheets
from ..functions import headers as H
from ..functions.classify import sheet_type

SHEET = ["workbook", "sheet"]


def cell_text(kind, raw):
    """Strings as they are; numbers as doubles print; dates and formulas as
    they stand; booleans in lower case; anything else empty."""
    return F.when(kind == "number", raw.try_cast("double").cast("string")).when(kind.isin("string", "date", "formula"), raw).when(kind == "boolean", F.lower(raw)).otherwise(F.lit(""))


def base_name(path):
    """Last part of a path of either kind of slash."""
    return F.coalesce(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), F.lit("unknown"))


def clipped(value, chars: int):
    return F.when(F.char_length(value) > chars, F.concat(F.substring(value, 1, chars), F.lit("..."))).otherwise(value)


def rows_of(cells: DataFrame) -> DataFrame:
    """workbook, sheet, row, cells (col -> trimmed text, in order), blank."""
    text = F.trim(cell_text(F.col("kind"), F.col("raw")))
    each = cells.select(*SHEET, "row", F.struct("col", text.alias("text")).alias("c"))
    out = each.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    return out.withColumn("blank", ~F.exists("cells", lambda c: c["text"] != ""))


def header_rows(rows: DataFrame) -> DataFrame:
    """The first row of each sheet that is not blank."""
    first = rows.filter(~F.col("blank")).groupBy(*SHEET).agg(F.min_by("cells", "row").alias("cells"), F.min("row").alias("header_row"))
    return first.select(*SHEET, "header_row", F.transform("cells", lambda c: F.struct(c["col"].alias("col"), F.when(c["text"] != "", c["text"]).otherwise(H.column_letter(c["col"])).alias("header"))).alias("headers"))


def flat_text(cells: DataFrame) -> DataFrame:
    """workbook, text: sheets one after the other, cells joined by bars."""
    rows = rows_of(cells).withColumn("line", F.array_join(F.transform("cells", lambda c: c["text"]), " | "))
    sheets = rows.groupBy(*SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("body"))
    own = sheets.withColumn("part", F.concat(F.lit("=== Sheet: "), "sheet", F.lit(" ===\n"), "body"))
    return own.groupBy("workbook").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "part"))), lambda p: p["part"]), "\n").alias("text"))


def chunk_rows(cells: DataFrame, config: Sheets = Sheets()) -> DataFrame:
    """One chunk per group of data rows: text and metadata of each. What a
    sheet's header means is worked out once a sheet; a group of one row needs
    neither a window nor a second grouping. A workbook given by its path is told
    apart by it, as ``source``, and named by its last part."""
    rows = rows_of(cells)
    names = F.transform("headers", lambda h: h["header"])
    heads = header_rows(rows).withColumns({"keys": H.match_keys(F.col("headers"), config.business_fields), "hints": H.range_hints(names), "note": H.range_note(names), "header": F.array_join(names, ", "), "names": F.map_from_entries("headers"), "sheet_type": sheet_type(F.col("sheet"))})
    heads = heads.select(*SHEET, "header_row", F.struct("keys", "hints", "note", "header", "names", "sheet_type").alias("head"))
    data = rows.join(heads, SHEET).filter(F.col("row") > F.col("header_row"))
    if config.skip_blank_rows:
        data = data.filter(~F.col("blank"))
    many = config.rows_per_chunk > 1
    if many:
        order = Window.partitionBy(*SHEET).orderBy("row")
        data = data.withColumn("grp", F.floor((F.row_number().over(order) - 1) / config.rows_per_chunk).cast("int"))
        groups = data.groupBy(*SHEET, "grp").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"), F.first("head").alias("head"))
    else:
        groups = data.select(*SHEET, F.array(F.struct("row", "cells")).alias("rows"), "head")
    groups = groups.select(*SHEET, "rows", "head.*")

    def lines(row):
        return F.array_join(F.transform(F.filter(row["cells"], lambda c: c["text"] != ""), lambda c: F.concat(F.lit("  "), F.coalesce(F.element_at(F.col("names"), c["col"]), H.column_letter(c["col"])), F.lit(": "), clipped(c["text"], config.max_cell_length), F.lit("\n"))), "")

    first, last = F.col("rows")[0]["row"] + 1, F.element_at("rows", -1)["row"] + 1
    label = F.when(first == last, F.concat(F.lit("Row: "), first)).otherwise(F.concat(F.lit("Rows: "), first, F.lit("-"), last))
    one = F.size("rows") == 1
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.when(one | F.lit(not many), F.lit("")).otherwise(F.concat(F.lit("Row "), r["row"] + 1, F.lit(":\n"))), lines(r))), "")
    out = groups.withColumn("text", F.concat(F.lit("Workbook: "), base_name(F.col("workbook")), F.lit("\nSheet: "), "sheet", F.lit("\n"), label, F.lit("\n"), body)).withColumn("row_start", first).withColumn("row_end", last)

    def value(key):
        cells_of = F.flatten(F.transform("rows", lambda r: F.filter(r["cells"], lambda c: (c["col"] == key["col"]) & (c["text"] != ""))))
        return F.struct(key["key"].alias("key"), F.get(F.transform(cells_of, lambda c: c["text"]), F.lit(0)).alias("value"))

    fields = F.map_from_entries(F.filter(F.transform("keys", value), lambda e: e["value"].isNotNull()))
    noted = F.when(F.col("note") != "", F.create_map(F.lit(H.RANGE_NOTE), "note")).otherwise(F.expr("cast(map() as map<string,string>)"))
    fields = H.reconcile_legacy(F.map_concat(fields, "hints", noted))
    out = out.withColumn("fields", H.with_warnings(fields) if config.range_validation else fields)
    return out.select(F.col("workbook").alias("source"), base_name(F.col("workbook")).alias("workbook"), "sheet", "sheet_type", "row_start", "row_end", "text", "fields", "header", F.lit("EXCEL").alias("type"), F.lit("catalog").alias("category"))


def backfill(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with renamed legacy keys, a sheet type and range warnings;
    one row of counters). Running it again changes nothing."""
    new = H.with_warnings(H.reconcile_legacy(F.col("fields")))
    own = chunks.filter("type = 'EXCEL'")
    after = own.withColumn("_new", new).withColumn("_type", F.coalesce("sheet_type", sheet_type(F.col("sheet"))))
    same = lambda a, b: F.to_json(F.array_sort(F.map_entries(a))) == F.to_json(F.array_sort(F.map_entries(b)))
    changed = ~same("fields", "_new") | ~F.col("_type").eqNullSafe(F.col("sheet_type"))
    renamed = F.exists(F.map_keys("fields"), lambda k: k.isin(*H.LEGACY_KEYS))
    warned = F.map_contains_key("_new", F.lit(H.HAS_WARNING)) & ~F.map_contains_key("fields", F.lit(H.HAS_WARNING))
    counts = after.agg(F.count("*").alias("scanned"), F.count_if(changed).alias("updated"), F.count_if(renamed).alias("reconciled"), F.count_if(warned).alias("new_warnings"))
    return after.withColumn("fields", F.col("_new")).withColumn("sheet_type", F.col("_type")).drop("_new", "_type"), counts


def unclassified(chunks: DataFrame) -> DataFrame:
    """Sheets without a type of their own: workbook, sheet, header, chunks."""
    own = chunks.filter("type = 'EXCEL' and coalesce(sheet_type, 'general') = 'general'")
    return own.groupBy("workbook", "sheet", F.element_at("fields", F.lit(H.TAB_HEADER)).alias("header")).agg(F.count("*").alias("n_chunks")).orderBy(F.desc("n_chunks"), "workbook", "sheet")


def range_warnings(chunks: DataFrame, limit: int | None = 200) -> DataFrame:
    """The first chunks with warnings by workbook, sheet and row; all, in no
    order, without a limit."""
    # a filter on the fields would work them out twice, below and above it
    warned = F.filter(F.array("fields"), lambda f: F.element_at(f, F.lit(H.HAS_WARNING)) == "true")
    own = chunks.select("chunk_id", "workbook", "sheet", "row_start", "row_end", F.explode_outer(warned).alias("fields")).filter("fields is not null")
    if limit is not None:
        own = own.orderBy("workbook", "sheet", F.col("row_start").cast("int")).limit(max(limit, 1))
    return own.select("chunk_id", "workbook", "sheet", "row_start", "row_end", F.element_at("fields", F.lit(H.RANGE_WARNINGS)).alias("warnings"))
