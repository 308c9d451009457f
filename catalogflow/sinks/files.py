"""Sinks: run-scoped sheet exports (K1-K4), base64 payloads (K5) and the
append-only ledger (K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import run_stamp

KINDS = ("draft", "approved", "rejected")


def append_ledger(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K6: append-only; never rewrites existing files (no lost updates).  Times
    keep their microseconds in JSON, too."""
    w = df.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") \
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    (w.json(path) if fmt == "json" else w.parquet(path))


def append_ledger_stream(batch_df: DataFrame, batch_id: int, path: str, query_id: str) -> None:
    """foreachBatch body: idempotent per micro-batch -- a retried batch
    rewrites only its own (``query_id``, ``batch_id``) partition, so neither a
    second run nor another job with the same output loses rows."""
    (batch_df.withColumn("query_id", F.lit(query_id)).withColumn("batch_id", F.lit(batch_id)).write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("query_id", "batch_id").parquet(path))


MARKER = "_ROWS"   # file that makes a written sheet count; holds the number of rows that were required


def write_sheet(df: DataFrame, base: str, kind: str, run_id: str, fmt: str = "parquet",
                order_col: str | None = "input_seq", require_rows: bool | Column = True) -> str | None:
    """K1-K3: write under ``{base}/kind={kind}/run_id={run_id}``; refuses to
    overwrite.  ``require_rows``: a sheet without rows does not count -- or, given
    a condition, one in which no row meets it: a draft is the whole sheet but
    counts only if the run had a result.

    The rows are counted while they are written (one evaluation of ``df``).  A
    sheet counts once its marker stands, which is written last; one that holds
    nothing is removed again, and None is returned."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    path = f"{base.rstrip('/')}/kind={kind}/run_id={run_id}"
    out = df.sortWithinPartitions(order_col) if order_col and order_col in df.columns else df
    seen = Observation()
    if require_rows is not False:
        wanted = F.lit(True) if require_rows is True else F.coalesce(require_rows, F.lit(False))
        out = out.observe(seen, F.count_if(wanted).alias("rows"))
    w = out.write.mode("errorifexists")
    if fmt == "csv":
        # keep cell values exactly (the CSV writer trims blanks by default)
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)
    rows = seen.get["rows"] if require_rows is not False else None
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if rows == 0:
        fs.delete(folder, True)
        return None
    mark = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}"), True)
    mark.write(bytearray(str(rows if rows is not None else "").encode()))
    mark.close()
    return path


def stamped_name(prefix: str, ts: Column, ext: str) -> Column:
    """K4: `{prefix}_yyyyMMdd_HHmmss.{ext}` from a passed-in timestamp."""
    return F.concat(F.lit(prefix + "_"), run_stamp(ts), F.lit("." + ext))


def payload_base64(content: Column) -> Column:
    """K5: bytes -> base64 text on one line (Spark may chunk base64 into
    76-character MIME lines depending on configuration; the CRLFs go)."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def payload_decode(text: Column) -> Column:
    return F.unbase64(text)
