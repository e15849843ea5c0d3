"""Folders of files as tables: scan, dispatch by kind, text, cells, outcomes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import file_type, is_supported_file
from ..schema import CELLS
from . import office

PARSED = "path string, name string, type string, status string, text string, error string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, type, length, content of the supported files below a folder.
    A folder that is missing or has none is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    found = found.withColumn("name", name).filter(is_supported_file(F.col("name"))).withColumn("type", file_type(F.col("name")))
    if not found.select("path").head(1):
        raise ValueError(f"no supported files in {folder}")
    return found.select("path", "name", "type", "length", "content")


def parse(files: DataFrame) -> DataFrame:
    """One row per file: its text, or the error; the message of an error
    without one is its class. Files of bounded size, a few at a time."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                path, name, kind, content = (b.column(c)[i].as_py() for c in range(4))
                try:
                    text, error = office.read_text(path, kind, content), None
                except Exception as x:  # noqa: BLE001  a file's error is its outcome
                    text, error = None, str(x) or type(x).__name__
                yield pa.RecordBatch.from_pylist([{"path": path, "name": name, "type": kind, "status": "FAILED" if error else "OK", "text": text, "error": error and error[:4000]}], schema=pa.schema([(c, pa.string()) for c in ("path", "name", "type", "status", "text", "error")]))

    return files.select("path", "name", "type", "content").mapInArrow(run, PARSED)


def cells(files: DataFrame) -> DataFrame:
    """Cells of the .xlsx files among ``files``, or one row with the error of a
    file that cannot be read. The workbook is the file's path: names repeat."""
    names = ("workbook", "sheet", "row", "col", "kind", "raw", "error")
    schema = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                path, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                try:
                    rows = [(path, *cell, None) for cell in office.xlsx_cells(content)]
                except Exception as x:  # noqa: BLE001  a file's error is its outcome
                    rows = [(path, *[None] * 5, (str(x) or type(x).__name__)[:4000])]
                for at in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 50_000], strict=True), schema, strict=True)], schema=schema)

    return files.filter(F.lower("name").endswith(".xlsx")).select("path", "content").mapInArrow(run, f"{CELLS}, error string")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """A commit log written as JSON lines or Parquet."""
    from ..schema import COMMITS

    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(COMMITS).json(path)
