"""Event frames: ``event: X\\ndata: {json}\\n\\n`` text as the edge format,
typed columns everywhere else.

* ``encode_frame`` (K7) / ``decode_frames`` (ST2): batch and streaming.
  Decoding splits on blank lines, takes the ``event:`` / ``data:`` lines,
  drops incomplete frames and parses the JSON payload.
* ``reassemble``: the frames of streams that a transport cut anywhere.
* ``frame_chunks``: frames of one key concatenated in bounded chunks
  (``chunk_size`` frames per chunk -- a key's whole history is never
  gathered into one row).
* ``done_to_sheet`` (P6, ST3), ``done_enrich`` (ST4), ``log_counts`` (ST5),
  ``outcome_log`` (P8), ``event_rows`` (ST1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import number_rows

EVENTS = ("log", "done", "error", "review_item", "finished")
SEVERITIES = ("info", "success", "warning", "error")

PAYLOAD_SCHEMA = ("message string, type string, final_score double, final_content string, "
                  "seo_title string, meta_description string, item_key string, product_name string")
DONE_SCHEMA = "final_score int, final_content string, seo_title string, meta_description string"


def encode_frame(event, data_json) -> Column:
    e = event if isinstance(event, Column) else F.col(event)
    d = data_json if isinstance(data_json, Column) else F.col(data_json)
    return F.concat(F.lit("event: "), e, F.lit("\ndata: "), d, F.lit("\n\n"))


def frame_chunks(frames: DataFrame, key: str, order: str, frame_col: str = "frame",
                 chunk_size: int = 50) -> DataFrame:
    """Concatenate each key's frames (in ``order``) into chunks of at most
    ``chunk_size`` consecutive order values."""
    chunk = F.floor(F.col(order) / chunk_size).cast("bigint").alias("chunk")
    g = frames.groupBy(key, chunk).agg(F.array_sort(F.collect_list(F.struct(order, frame_col))).alias("_fs"))
    return g.select(key, "chunk", F.array_join(F.transform("_fs", lambda x: x[frame_col]), "").alias("text"))


def decode_frames(df: DataFrame, text_col: str = "text", id_cols=(), schema: str = PAYLOAD_SCHEMA) -> DataFrame:
    ids = list(id_cols)
    parts = df.select(*ids, F.posexplode(F.split(F.col(text_col), "\n\n")).alias("pos", "block"))
    ev = F.regexp_extract("block", r"event: (.+)", 1)
    data = F.regexp_extract("block", r"data: (.+)", 1)
    parts = parts.where(F.trim("block") != "").select(*ids, "pos", ev.alias("event"), data.alias("data"))
    parts = parts.where((F.col("event") != "") & (F.col("data") != ""))
    return parts.withColumn("payload", F.from_json("data", schema))


def cut_chunks(frames: DataFrame, key: str, order: str, size: Column, frame_col: str = "frame", chunk_size: int = 50) -> DataFrame:
    """Frames as a transport delivers them: each key's text in pieces of ``size``
    characters, whatever they cut, numbered 0, 1, ... per key (``chunk``)."""
    whole = frame_chunks(frames, key, order, frame_col, chunk_size).withColumn("_size", size)
    pieces = whole.select(key, F.col("chunk").alias("_c"), F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.col("_size")).cast("int")),
        lambda i: F.substring(F.col("text"), (i * F.col("_size") + 1).cast("int"), F.col("_size")))).alias("_i", "text"))
    return number_rows(pieces, [F.col("_c"), F.col("_i")], (key,), "chunk").select(key, "chunk", "text")


def reassemble(chunks: DataFrame, key: str, order: str = "chunk", text: str = "text") -> DataFrame:
    """ST2 over transport chunks: the frames of every key's stream, whichever way
    it was cut: (key, ``frame_no``, ``chunk`` in which the frame begins, ``text``).

    Line ends and blank lines before a chunk are counted by ranges of the stream
    (``number_rows``), so the pieces of a line, and then the lines of a frame, meet
    by their number; no task holds a key's stream.  A frame that no blank line
    ends is incomplete and left out.  Null texts are empty."""
    c = chunks.select(key, F.col(order).alias("_at"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    c = c.withColumn("_ends", F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))))
    c = number_rows(c, [F.col("_at")], (key,), "_n", sums={"_line": "_ends"})
    pieces = c.select(key, "_n", "_at", "_line", "_line_total", F.posexplode(F.split("_text", "\n")).alias("_i", "_piece"))
    lines = pieces.groupBy(key, (F.col("_line") + F.col("_i")).alias("_line"), "_line_total").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_piece"))), lambda x: x["_piece"]), "").alias("_text"),
        F.min_by("_at", F.when(F.length("_piece") > 0, F.col("_n")).otherwise(F.col("_n") + (1 << 40))).alias("_at"))
    lines = lines.where("_line < _line_total").withColumn("_blank", (F.trim("_text") == "").cast("int"))
    lines = number_rows(lines.drop("_line_total"), [F.col("_line")], (key,), "_l", sums={"_frame": "_blank"})
    said = lines.where("_blank = 0 and _frame < _frame_total")
    frames = said.groupBy(key, "_frame").agg(F.array_sort(F.collect_list(F.struct("_line", "_text"))).alias("_ls"), F.min_by("_at", "_line").alias("chunk"))
    return frames.select(key, F.col("_frame").alias("frame_no"), "chunk", F.array_join(F.transform("_ls", lambda x: x["_text"]), "\n").alias("text"))


def done_to_sheet(decoded: DataFrame, id_cols=()) -> DataFrame:
    """P6/ST3: done events projected onto the sheet's content columns."""
    p = F.col("payload")
    return decoded.where(F.col("event") == "done").select(
        *id_cols, "pos", p["final_content"].alias("html_content"), p["seo_title"].alias("seo_title"),
        p["meta_description"].alias("meta_description"), p["final_score"].alias("final_score"))


def done_enrich(decoded: DataFrame, key: Column, name: Column, id_cols=()) -> DataFrame:
    """ST4: add the item key and name to every done payload, re-encode the frame."""
    d = F.from_json("data", DONE_SCHEMA)
    enriched = d.withField("item_key", key).withField("product_name", name)
    return decoded.where(F.col("event") == "done").select(
        *id_cols, "pos", encode_frame(F.lit("done"), F.to_json(enriched)).alias("frame"))


def log_counts(decoded: DataFrame, by=("type",)) -> DataFrame:
    """ST5 (batch form): log lines per severity."""
    return (decoded.where(F.col("event") == "log")
            .groupBy(*[F.col("payload")[c].alias(c) for c in by]).agg(F.count(F.lit(1)).alias("n_events")))


# Per-route outcome severity
ROUTE_SEVERITY = {"no_key": "warning", "not_found": "warning", "not_validated": "info",
                  "no_link": "warning", "empty_text": "error", "ready": "success"}
ROUTE_TEXT = {"no_key": "row without key, skipped", "not_found": "not found in the catalog, skipped",
              "not_validated": "leaflet link not validated, skipped", "no_link": "leaflet link missing, skipped",
              "empty_text": "leaflet text is empty", "ready": "queued for generation"}


def outcome_log(routed: DataFrame, key: str = "item_key", route: str = "route") -> DataFrame:
    """One (message, type) line per item outcome."""
    sev = F.lit(None).cast("string")
    txt = F.lit(None).cast("string")
    for r in ROUTE_SEVERITY:
        sev = F.when(F.col(route) == r, F.lit(ROUTE_SEVERITY[r])).otherwise(sev)
        txt = F.when(F.col(route) == r, F.lit(ROUTE_TEXT[r])).otherwise(txt)
    msg = F.format_string("<b>[SKU: %s]</b> %s", F.coalesce(F.col(key), F.lit("-")), txt)
    return routed.withColumn("message", msg).withColumn("type", sev)


def event_rows(routed: DataFrame, key: str = "item_key", name: str = "product_name",
               id_cols=("input_seq",)) -> DataFrame:
    """ST1: the ordered log events of every item (start line + outcome line)
    as rows, with their encoded frames."""
    logged = outcome_log(routed, key)
    start = F.struct(F.lit(0).alias("pos"), F.lit("log").alias("event"),
                     F.format_string("Starting '%s'", F.coalesce(F.col(name), F.lit(""))).alias("message"),
                     F.lit("info").alias("type"))
    outcome = F.struct(F.lit(1).alias("pos"), F.lit("log").alias("event"), F.col("message"), F.col("type"))
    ex = logged.select(*id_cols, F.explode(F.array(start, outcome)).alias("e")).select(*id_cols, "e.*")
    data = F.to_json(F.struct("message", "type"))
    return ex.withColumn("frame", encode_frame(F.col("event"), data))


def content_events(audited: DataFrame, key: str, name: str = "product_name", title: str = "seo_title",
                   meta: str = "meta_description", html: str = "html_content", audit: str = "audit",
                   target: float = 95) -> DataFrame:
    """ST1/P8: the ordered events of every produced item: start, one line per
    audit rule, score, approval, ``done`` with the content and ``review_item``
    with the pending sheet row; an item without content has start and ``error``.
    One ``finished`` row with a null key closes the run.

    Columns: key, pos, event, type, message, frame.  One explode per item, no
    shuffle but for the run's count."""
    from .audit import RULES
    score, entries = F.col(audit)["seo_score"], F.col(audit)["score_breakdown"]
    null = F.lit(None).cast("string")

    def event(pos: int, kind: str, message=null, severity=null, data=None):
        body = F.to_json(F.struct(message.alias("message"), severity.alias("type"))) if data is None else data
        return F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("event"), severity.alias("type"), message.alias("message"),
                        encode_frame(F.lit(kind), body).alias("frame"))

    def rule(pos: int, k: str):
        e = entries[k]
        return event(pos, "log", F.format_string(f"{k}: %s of %s", e["score"], e["max_score"]),
                     F.when(e["score"] == e["max_score"], F.lit("success")).otherwise(F.lit("warning")))

    start = event(0, "log", F.format_string("start: %s", F.coalesce(F.col(name), F.lit(""))), F.lit("info"))
    n = len(RULES)
    passed = score >= target
    content = [F.col(c).alias(a) for c, a in ((html, "final_content"), (title, "seo_title"), (meta, "meta_description"))]
    full = F.array(
        start, *[rule(i, k) for i, k in enumerate(RULES, 1)],
        event(n + 1, "log", F.format_string("score: %s", score), F.lit("info")),
        event(n + 2, "log", F.when(passed, F.lit("approved")).otherwise(F.lit("below target")),
              F.when(passed, F.lit("success")).otherwise(F.lit("warning"))),
        event(n + 3, "done", data=F.to_json(F.struct(score.alias("final_score"), *content))),
        event(n + 4, "review_item", data=F.to_json(F.struct(F.col(key).cast("string").alias("item_key"), F.col(name).alias("product_name"),
                                                            F.lit("pending").alias("status")))))
    failed = F.array(start, event(1, "error", F.lit("no content to review"), F.lit("error")))
    nothing = F.col(title).isNull() & F.col(meta).isNull() & F.col(html).isNull()
    rows = audited.select(F.col(key), F.explode(F.when(nothing, failed).otherwise(full)).alias("e")).select(key, "e.*")
    total = audited.agg(F.count(F.lit(1)).alias("n"))
    end = total.select(F.lit(None).cast(audited.schema[key].dataType).alias(key),
                       event(0, "finished", F.format_string("%d items", F.col("n")), F.lit("info")).alias("e")).select(key, "e.*")
    return rows.unionByName(end)
