"""S4 leaflet documents: staged files -> page texts -> one text per document.

The extractor is a plug-in ``extract(bytes) -> list[str]`` (pages); the
built-in one decodes plain text and splits pages on form feeds.  Extraction
runs once per distinct file in Python workers; concatenation is native:
pages are sorted inside each document's own (bounded) group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_text_pages(content: bytes) -> list[str]:
    return content.decode("utf-8", errors="replace").split("\f")


def extract_pages(spark: SparkSession, glob: str, extractor=plain_text_pages,
                  key_from_path: str = r"([^/]+?)(\.[^./]*)?$") -> DataFrame:
    """Files -> (doc_key, page, text); doc_key is the file name stem."""
    files = spark.read.format("binaryFile").load(glob).select(
        F.regexp_extract("path", key_from_path, 1).alias("doc_key"), "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for key, content in zip(pdf["doc_key"], pdf["content"]):
                try:
                    pages = extractor(bytes(content))
                except Exception:  # noqa: BLE001  unreadable file -> no pages (routed as empty text)
                    pages = []
                rows.extend((key, i, p) for i, p in enumerate(pages))
            yield pd.DataFrame(rows, columns=["doc_key", "page", "text"])

    return files.mapInPandas(run, "doc_key string, page int, text string")


def concat_pages(pages: DataFrame, doc_key: str = "doc_key", page: str = "page", text: str = "text",
                 sep: str = "", skip_blank: bool = True, terminate: bool = False) -> DataFrame:
    """Pages of each document in page order joined into one text.
    ``skip_blank`` drops null/empty pages (compact variant); ``terminate``
    appends ``sep`` after every page (the "page + newline" variant)."""
    val = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(sep)) if terminate else F.coalesce(F.col(text), F.lit(""))
    item = F.struct(F.col(page), val.alias("_v"))
    if skip_blank:  # blank pages leave the list, the document stays (as '')
        item = F.when(F.col(text).isNotNull() & (F.col(text) != ""), item)
    g = pages.groupBy(doc_key).agg(F.array_sort(F.collect_list(item)).alias("_ps"))
    joiner = "" if terminate else sep
    return g.select(doc_key, F.array_join(F.transform("_ps", lambda x: x["_v"]), joiner).alias("text"),
                    F.size("_ps").alias("n_pages"))
