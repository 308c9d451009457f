"""Registered checks: sheet source (S1), leaflet pages (S4) and the
streaming jobs (ST2, ST5, ST6, ST7) -- each streaming result, after all
available input, must equal its batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as EV
from ..session import scratch_path
from ..sources.documents import concat_pages
from ..sources.sheets import read_sheet
from ..streaming import frames as S
from ..streaming.review_store import ReviewStore, run_reviews
from .checks_events import ORACLE as EV_ORACLE
from .checks_html import ORACLE as HTML_ORACLE
from .checks_merge import ORACLE as MERGE_ORACLE
from .checks_merge import reviews_with_reload
from .standins import std_frames, std_items, table, with_ctes

ITEM_COLS = ["input_seq", "item_key", "product_name", "seo_title", "meta_description", "html_content", "o_orderstatus"]


def read_csv_sheet_q(spark, d):
    """Items written as a CSV sheet (padded headers, quoted HTML-safe cells) and read back."""
    path = scratch_path(spark, "items_csv") + ".csv"
    items = std_items(spark, d)
    items.select(*[F.col(c).alias(f" {c} ") for c in items.columns]).write \
        .option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    back = read_sheet(spark, path)
    return back.select(F.col("input_seq").cast("bigint").alias("input_seq"), *ITEM_COLS[1:])


def leaflet_concat_pages_q(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_key"),
                        F.posexplode(F.split("text", "\n")).alias("page", "text"))
    nl = concat_pages(pages, sep="\n", skip_blank=False, terminate=True).select(
        "doc_key", F.md5("text").alias("text_nl_md5"))
    compact = concat_pages(pages, sep="", skip_blank=True).select(
        F.col("doc_key").alias("_k"), F.md5("text").alias("text_compact_md5"), "n_pages")
    return nl.join(compact, F.col("doc_key") == F.col("_k")).drop("_k")


def _frames_source(spark, d):
    path = scratch_path(spark, "frame_chunks")
    EV.frame_chunks(std_frames(spark, d), "user_id", "event_id").write.json(path)
    return path


def cut_stream(spark, d):
    """Every user's frames in pieces of 7 to 96 characters, which cut frames, words and line ends."""
    return EV.cut_chunks(std_frames(spark, d), "user_id", "event_id", (F.lit(7) + F.col("user_id") % 90).cast("int"))


def _decoded_frames(frames):
    x = EV.decode_frames(frames, "text", id_cols=["user_id", "frame_no"])
    return x.select("user_id", "frame_no", "event", F.col("payload.message").alias("message"), F.col("payload.type").alias("type"),
                    F.col("payload.final_score").alias("final_score"))


def event_reassembly_q(spark, d):
    return _decoded_frames(EV.reassemble(cut_stream(spark, d), "user_id"))


def stream_event_decode_q(spark, d):
    """The pieces arrive in two portions, the later ones of some users first."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("pieces", "decoded", "checkpoint"))
    pieces = cut_stream(spark, d)
    late = (F.col("chunk") + F.col("user_id")) % 3 == 0
    for portion in (pieces.where(late), pieces.where(~late)):
        portion.write.mode("append").json(src)
        S.run_available_now(_decoded_frames(S.reassembled_stream(S.chunk_stream(spark, src))), out, checkpoint)
    return spark.read.parquet(out).drop("query_id", "batch_id")


def stream_log_counts_q(spark, d):
    out = scratch_path(spark, "log_counts")
    S.run_available_now(S.log_counts_stream(S.decode_stream(spark, _frames_source(spark, d))), out, scratch_path(spark, "checkpoint"),
                        "complete")
    return S.read_complete(spark, out)


def stream_log_windows_q(spark, d):
    """Log lines by day.  Every second line of one user in seven arrives late, in a
    second portion: those within two days of the latest line still count, older
    ones whose day is over do not.  A last line far in the future ends the days."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("lines", "windows", "checkpoint"))
    late = (F.col("user_id") % 7 == 3) & (F.col("event_id") % 2 == 0)
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("received_at"))
    frames = std_frames(spark, d).join(events, "event_id").select("event_id", "user_id", "received_at", F.col("frame").alias("text"))
    last = frames.agg(F.max("received_at").alias("t")).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("user_id"), (F.col("t") + F.expr("INTERVAL 40 DAYS")).alias("received_at"),
        F.lit('event: log\ndata: {"message": "end", "type": "info"}\n\n').alias("text"))
    for portion in (frames.where(~late), frames.where(late), last):
        portion.write.mode("append").parquet(src)
        stream = spark.readStream.schema("event_id long, user_id long, received_at timestamp, text string").parquet(src)
        decoded = EV.decode_frames(stream, "text", id_cols=["received_at"])
        S.run_available_now(S.log_windows_stream(decoded, width="1 day", late="2 days"), out, checkpoint)
    return spark.read.parquet(out).select(F.unix_micros("window_start").alias("window_start"), "type", "n_events")


def stream_review_latest_q(spark, d):
    """Reviews in eight portions and a draft reload after the fifth, folded by a
    job that compacts every third batch and that crashed twice while doing so."""
    src, path, checkpoint = (scratch_path(spark, n) for n in ("reviews", "review_store", "checkpoint"))
    events = reviews_with_reload(spark, d).withColumn("part", F.col("seq") % 8)
    schema = events.drop("part").schema
    store = ReviewStore(spark, path)
    for part in range(8):
        events.where(F.col("part") == part).drop("part").write.mode("append").parquet(src)
        run_reviews(spark.readStream.schema(schema).parquet(src), store, checkpoint, compact_every=3)
        if part in (3, 6):
            try:
                store.compact(_crash="before" if part == 3 else "after")
            except RuntimeError:
                pass
    return store.latest().withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


def _page_files(spark, d, src, part):
    p = table(spark, d, "pages").where(F.col("page_id") % 2 == part)
    p.select(F.lit("page").alias("src"), F.col("page_id").alias("id"), "html").write.mode("append").json(src)


def stream_scores_q(spark, d):
    """The pages arrive in two portions; a run after each, with one checkpoint."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("pages", "scores", "checkpoint"))
    for part in (0, 1):
        _page_files(spark, d, src, part)
        stream = spark.readStream.schema("src string, id bigint, html string").json(src)
        S.run_available_now(S.scores_stream(stream), out, checkpoint)
    return spark.read.parquet(out).drop("query_id", "batch_id")


QUERIES = {
    "read_csv_sheet": read_csv_sheet_q,
    "leaflet_concat_pages": leaflet_concat_pages_q,
    "event_reassembly": event_reassembly_q,
    "stream_event_decode": stream_event_decode_q,
    "stream_log_counts": stream_log_counts_q,
    "stream_log_windows": stream_log_windows_q,
    "stream_review_latest": stream_review_latest_q,
    "stream_scores": stream_scores_q,
}

# the frames as they were before anything cut them
_WHOLE_FRAMES = with_ctes("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, event,
  json_extract_string(data, '$.message') AS message, json_extract_string(data, '$.type') AS type,
  CAST(json_extract(data, '$.final_score') AS DOUBLE) AS final_score
FROM (SELECT *, regexp_extract(frame, 'data: (.+)', 1) AS data FROM std_frames)""", "std_frames")

ORACLE = {
    # an empty cell reads back as null, as spreadsheet readers do
    "read_csv_sheet": with_ctes("SELECT input_seq, " + ", ".join(f"nullif({c}, '') AS {c}" for c in ITEM_COLS[1:])
                                + " FROM std_items", "std_items"),
    "leaflet_concat_pages": """
WITH pages AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_key,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS page,
         unnest(string_split(text, chr(10))) AS p FROM documents)
SELECT doc_key, md5(string_agg(p || chr(10), '' ORDER BY page)) AS text_nl_md5,
       md5(coalesce(string_agg(p, '' ORDER BY page) FILTER (WHERE p <> ''), '')) AS text_compact_md5,
       CAST(count(*) FILTER (WHERE p <> '') AS INTEGER) AS n_pages
FROM pages GROUP BY doc_key""",
    "event_reassembly": _WHOLE_FRAMES,
    "stream_event_decode": _WHOLE_FRAMES,
    "stream_log_counts": EV_ORACLE["log_counts"],
    "stream_log_windows": with_ctes("""
SELECT epoch_us(date_trunc('day', ts)) AS window_start, type, count(*) AS n_events
FROM (SELECT e.ts, json_extract_string(regexp_extract(f.frame, 'data: (.+)', 1), '$.type') AS type,
             f.user_id % 7 = 3 AND f.event_id % 2 = 0 AS late,
             max(e.ts) FILTER (WHERE f.event = 'log' AND NOT (f.user_id % 7 = 3 AND f.event_id % 2 = 0)) OVER () AS seen
      FROM std_frames f JOIN events e ON f.event_id = e.event_id WHERE f.event = 'log')
WHERE NOT late OR date_trunc('day', ts) + INTERVAL 1 DAY > seen - INTERVAL 2 DAY
GROUP BY ALL""", "std_frames"),
    "stream_review_latest": MERGE_ORACLE["review_reload"],
    "stream_scores": HTML_ORACLE["analyze_html"].replace(
        "FROM scores", "FROM scores WHERE src = 'page'"),
}


def _csv_rows(content: bytes):
    """A plug-in for delimited files: rows of cell texts, empty cells as None."""
    import csv
    import io
    for row in csv.reader(io.StringIO(content.decode("utf-8"), newline="")):
        yield [c or None for c in row]


def read_workbooks_q(spark, d):
    """Items written by Spark as sheet files of 5,000 rows at most and read
    back through the workbook source with a parser plug-in, one task per file."""
    from ..sources.sheets import cells_to_columns, read_workbooks
    out = scratch_path(spark, "workbooks")
    std_items(spark, d).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).option("maxRecordsPerFile", 5000).csv(out)
    wb = cells_to_columns(read_workbooks(spark, f"{out}/*.csv", _csv_rows), ITEM_COLS)
    return wb.select(F.col("input_seq").cast("bigint").alias("input_seq"), *ITEM_COLS[1:])


def trim_headers_q(spark, d):
    """Padded / BOM-prefixed headers trimmed back to names."""
    from ..operators.keys import trim_headers
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    padded = o.toDF(*[("﻿" if i == 0 else "") + f"  {c} " for i, c in enumerate(o.columns)])
    return trim_headers(padded)


def ledger_append_q(spark, d):
    """K6: the derived ledger appended twice as Parquet (never rewritten), read back."""
    from ..sinks.files import append_ledger
    from ..sources.ledger import read_ledger
    from .standins import std_ledger
    path = scratch_path(spark, "ledger_parquet")
    led = std_ledger(spark, d)
    append_ledger(led, path, fmt="parquet")
    append_ledger(led, path, fmt="parquet")
    return read_ledger(spark, path, fmt="parquet").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


QUERIES.update({"read_workbooks": read_workbooks_q, "trim_headers": trim_headers_q, "ledger_append": ledger_append_q})
ORACLE["read_workbooks"] = ORACLE["read_csv_sheet"]
ORACLE["trim_headers"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders"
ORACLE["ledger_append"] = with_ctes("""
SELECT seq, strategy, product_type, score_before, score_after, delta, epoch_us(ts) AS ts, CAST(NULL AS INTEGER) AS rows_read
FROM std_ledger, range(2)""", "std_ledger")
