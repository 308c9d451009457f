"""Streaming jobs over a file source of frame chunks / review events / pages.

* ``decode_stream`` (ST2): JSON files of ``(key, chunk, text)`` -> decoded events;
  ``reassembled_stream`` carries a key's open frame from chunk to chunk, so a
  transport may cut anywhere and deliver out of order.
* ``log_counts_stream`` (ST5): severity counts, complete mode;
  ``log_windows_stream`` by event-time windows with a watermark, append mode.
* ``review_latest_stream`` (ST6): latest state per key with ``max_by`` --
  built-in aggregation state, one row per key, no custom state store.
* ``scores_stream`` (ST7): stateless scoring, appended per micro-batch with
  the batch id as partition (a retried batch overwrites only itself).

``run_available_now`` drives a query to completion with
``trigger(availableNow=True)`` and the caller's checkpoint folder; outputs are Parquet (never the driver-memory sink)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyzer import analyze_html, analysis_scores
from ..operators.events import decode_frames
from ..sinks.files import append_ledger_stream

CHUNK_SCHEMA = "user_id bigint, chunk bigint, text string"


def chunk_stream(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA, max_files: int | None = None) -> DataFrame:
    src = spark.readStream.schema(schema)
    if max_files:  # only if a caller wants small batches
        src = src.option("maxFilesPerTrigger", max_files)
    return src.json(path)


def reassembled_stream(chunks: DataFrame, key: str = "user_id", chunk: str = "chunk", text: str = "text") -> DataFrame:
    """(key, frame_no, text): every frame once its blank line has come, in its
    key's order, from chunks numbered 0, 1, ... per key.

    State per key: the next chunk's number, the number of frames given, the open
    frame's text, and chunks that came too early.  A chunk that came before
    (a repeated delivery) changes nothing.  Append mode."""
    key_type = chunks.schema[key].dataType.simpleString()

    def carry(group, batches, state):
        at, given, tail, early = state.get if state.exists else (0, 0, "", "{}")
        early = {int(k): v for k, v in json.loads(early).items()}
        for pdf in batches:
            for n, said in zip(pdf[chunk], pdf[text]):
                if n >= at:
                    early[int(n)] = said or ""
        out, parts = [], [tail]
        while at in early:
            parts.append(early.pop(at))
            at += 1
        blocks = "".join(parts).split("\n\n")
        for block in blocks[:-1]:
            block = block.strip("\n")
            if block.strip(" "):
                out.append((given, block))
                given += 1
        state.update((at, given, blocks[-1], json.dumps(early)))
        yield pd.DataFrame({key: [group[0]] * len(out), "frame_no": [n for n, _ in out], "text": [b for _, b in out]})

    return chunks.groupBy(key).applyInPandasWithState(
        carry, f"{key} {key_type}, frame_no long, text string", "at long, given long, tail string, early string", "append", "NoTimeout")


def decode_stream(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA, key: str = "user_id",
                  max_files: int | None = None) -> DataFrame:
    return decode_frames(chunk_stream(spark, path, schema, max_files), "text", id_cols=[key, "chunk"])


def log_counts_stream(decoded: DataFrame) -> DataFrame:
    return (decoded.where(F.col("event") == "log").groupBy(F.col("payload.type").alias("type"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def log_windows_stream(decoded: DataFrame, at: str = "received_at", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ST5 by event time: log lines per severity and tumbling window of ``width``,
    for append mode.  A window is given once, when no line may come any more: a
    line more than ``late`` behind the latest one seen is left out if its window is over."""
    rows = decoded.where(F.col("event") == "log").select(F.col(at), F.col("payload.type").alias("type")).withWatermark(at, late)
    counts = rows.groupBy(F.window(at, width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "type", "n_events")


def review_latest_stream(events: DataFrame, key: str = "item_key", order=("ts", "seq")) -> DataFrame:
    others = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
    return events.groupBy(key).agg(last.alias("_last")).select(key, *[F.col("_last." + c).alias(c) for c in others])


def scores_stream(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return analysis_scores(analyze_html(pages, html_col)).drop(html_col)


def run_available_now(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> str:
    """Run to the end of the available input and stop.

    ``checkpoint`` is the caller's folder for this job: a later run with the
    same folder goes on where the last one ended and reads new files only.
    Append- and update-mode batches land in a partition of their own, named by
    the job (its checkpoint folder) and the batch; in update mode a
    batch holds the keys that changed, and ``read_latest`` folds them.
    In complete mode every batch is a whole result beside the last one, which
    stays until the new one stands; ``read_complete`` takes the newest."""
    def sink(batch_df: DataFrame, batch_id: int):
        append_ledger_stream(batch_df, batch_id, out_path, query_id)
        if mode == "complete":
            _drop_older(batch_df.sparkSession, f"{out_path.rstrip('/')}/query_id={query_id}", batch_id)

    query_id = _query_id(checkpoint)
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out_path


def _drop_older(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Removes whole results older than the one before ``batch_id``'s."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("batch_id=") and int(name.split("=")[1]) < batch_id - 1:
                fs.delete(status.getPath(), True)


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole result of a complete-mode output (one job's)."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("query_id", "batch_id")


def _query_id(checkpoint: str) -> str:
    """A stable name for the job that owns a checkpoint folder."""
    import hashlib
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def read_latest(spark: SparkSession, path: str, key: str = "item_key") -> DataFrame:
    """The last state per key of an update-mode output (one job's)."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (key, "query_id", "batch_id")]
    last = F.max_by(F.struct(*[F.col(c) for c in others]), F.col("batch_id"))
    return rows.groupBy(key).agg(last.alias("_last")).select(key, *[F.col("_last." + c).alias(c) for c in others])
