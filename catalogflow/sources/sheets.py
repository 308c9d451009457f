"""S1 delimited sheets and S2 workbooks.

CSV: header row, every column read as text (keys must never be inferred as
numbers), ``"`` escaping, UTF-8 with the BOM removed from the first header.
Workbooks: files are found and read by Spark (``binaryFile``), one row per file;
what turns a file's bytes into rows of cell texts is the caller's plug-in, as
with document extraction.  A file is one unit of work and must fit in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import trim_headers

Parser = Callable[[bytes], Iterable[list]]

PORTION = 1000   # rows of a workbook that leave a task at a time


def read_sheet(spark: SparkSession, path: str, kind: str | None = None, multi_line: bool = True,
               parse: Parser | None = None) -> DataFrame:
    """Read a sheet by suffix (``.csv`` case-insensitive -> CSV, else workbook).
    Empty cells read as null (quoted or not), as spreadsheet readers do.

    ``multi_line``: cells may hold line breaks (HTML does).  A file is then read
    by one task; without it Spark splits large files."""
    kind = kind or ("csv" if path.lower().endswith(".csv") or path.lower().endswith(".csv/") else "xlsx")
    if kind == "csv":
        df = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path))
        return trim_headers(df)
    if parse is None:
        raise ValueError("workbooks need parse=, a function from a file's bytes to its rows")
    return cells_to_columns(read_workbooks(spark, path, parse))


def read_workbooks(spark: SparkSession, glob: str, parse: Parser) -> DataFrame:
    """Every workbook under ``glob`` -> (path, row_no, cells map<header, text>).

    ``parse`` gives the rows of a file's sheet as lists of cell texts (None for
    an empty cell), the header first; files without rows give nothing."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = iter(parse(bytes(content)))
                header = [(h or "").replace("\ufeff", "").strip() for h in next(rows, [])]
                numbered = enumerate(rows, start=1)
                # a sheet of any length leaves the task in portions
                while part := [(path, i, {h: (r[j] if j < len(r) else None) for j, h in enumerate(header) if h})
                               for i, r in islice(numbered, PORTION)]:
                    yield pd.DataFrame(part, columns=["path", "row_no", "cells"])

    return files.mapInPandas(run, "path string, row_no int, cells map<string,string>")


def cells_to_columns(df: DataFrame, columns=None, most: int = 2000) -> DataFrame:
    """Project the cell map onto columns: the given ones, or all headers seen in
    any file, in order of name (one job of distinct headers).  Files that have
    more than ``most`` headers between them are an error: name the columns then."""
    if columns is None:
        keys = df.select(F.explode(F.map_keys("cells")).alias("k")).distinct().limit(most + 1).collect()
        if len(keys) > most:
            raise ValueError(f"more than {most} different headers; say which columns to read")
        columns = sorted(r.k for r in keys)
    return df.select("path", "row_no", *[F.col("cells")[c].alias(c) for c in columns])
