"""Registered checks: event frames (K7, ST1-ST5, P6, P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import events as EV
from . import sqlfrag as Q
from .checks_enrich import _ROUTED
from .standins import std_catalog, std_documents, std_frames, std_items, with_ctes


def _decoded(spark, d):
    chunks = EV.frame_chunks(std_frames(spark, d), "user_id", "event_id")
    return EV.decode_frames(chunks, "text", id_cols=["user_id", "chunk"])


def event_encode_q(spark, d):
    return std_frames(spark, d).select("event_id", "event", "frame")


def event_decode_q(spark, d):
    x = _decoded(spark, d)
    return x.select("user_id", "chunk", "pos", "event", F.col("payload.message").alias("message"),
                    F.col("payload.type").alias("type"), F.col("payload.final_score").alias("final_score"))


def done_to_sheet_q(spark, d):
    return EV.done_to_sheet(_decoded(spark, d), id_cols=["user_id", "chunk"])


def done_enrich_q(spark, d):
    x = _decoded(spark, d)
    out = EV.done_enrich(x, F.col("user_id").cast("string"), F.concat(F.lit("P"), F.col("user_id").cast("string")),
                         id_cols=["user_id", "chunk"])
    return out


def log_counts_q(spark, d):
    return EV.log_counts(_decoded(spark, d))


def _routed(spark, d):
    return E.route_items(std_items(spark, d), std_catalog(spark, d), std_documents(spark, d))


def outcome_log_q(spark, d):
    return EV.outcome_log(_routed(spark, d)).select("input_seq", "cat_catalog_seq", "route", "message", "type")


def event_rows_q(spark, d):
    r = _routed(spark, d)
    return EV.event_rows(r, id_cols=["input_seq", "cat_catalog_seq"]).select(
        "input_seq", "cat_catalog_seq", "pos", "event", "type", "frame")


QUERIES = {
    "event_encode": event_encode_q,
    "event_decode": event_decode_q,
    "done_to_sheet": done_to_sheet_q,
    "done_enrich": done_enrich_q,
    "log_counts": log_counts_q,
    "outcome_log": outcome_log_q,
    "event_rows": event_rows_q,
}

_DEC = """chunks AS (SELECT user_id, CAST(floor(event_id / 50) AS BIGINT) AS chunk,
                       string_agg(frame, '' ORDER BY event_id) AS text FROM std_frames GROUP BY ALL),
blocks AS (SELECT user_id, chunk, CAST(generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS INTEGER) AS pos,
                  unnest(string_split(text, chr(10) || chr(10))) AS block FROM chunks),
dec AS (SELECT user_id, chunk, pos, regexp_extract(block, 'event: (.+)', 1) AS event,
               regexp_extract(block, 'data: (.+)', 1) AS data FROM blocks WHERE trim(block) <> ''),
ok AS (SELECT * FROM dec WHERE event <> '' AND data <> '')"""

_SEV = " ".join(f"WHEN route = '{r}' THEN '{s}'" for r, s in EV.ROUTE_SEVERITY.items())
_TXT = " ".join(f"WHEN route = '{r}' THEN {Q.lit(t)}" for r, t in EV.ROUTE_TEXT.items())
_OUT = f"""outl AS (SELECT input_seq, cat_catalog_seq, route, item_key,
  '<b>[SKU: ' || coalesce(item_key, '-') || ']</b> ' || CASE {_TXT} END AS message, CASE {_SEV} END AS type FROM routed),
nm AS (SELECT input_seq, product_name FROM std_items)"""


def _frame(msg: str, typ: str) -> str:
    return ("'event: log' || chr(10) || 'data: ' || CAST(to_json(struct_pack(message := " + msg + ", type := " + typ
            + ")) AS VARCHAR) || chr(10) || chr(10)")


ORACLE = {
    "event_encode": with_ctes("SELECT event_id, event, frame FROM std_frames", "std_frames"),
    "event_decode": with_ctes("""
SELECT user_id, chunk, pos, event, json_extract_string(data, '$.message') AS message,
       json_extract_string(data, '$.type') AS type, CAST(json_extract(data, '$.final_score') AS DOUBLE) AS final_score
FROM ok""", "std_frames", ctes=_DEC),
    "done_to_sheet": with_ctes("""
SELECT user_id, chunk, pos, json_extract_string(data, '$.final_content') AS html_content,
       json_extract_string(data, '$.seo_title') AS seo_title,
       json_extract_string(data, '$.meta_description') AS meta_description,
       CAST(json_extract(data, '$.final_score') AS DOUBLE) AS final_score
FROM ok WHERE event = 'done'""", "std_frames", ctes=_DEC),
    "done_enrich": with_ctes("""
SELECT user_id, chunk, pos, 'event: done' || chr(10) || 'data: ' || CAST(to_json(struct_pack(
    final_score := CAST(json_extract(data, '$.final_score') AS INTEGER),
    final_content := json_extract_string(data, '$.final_content'),
    seo_title := json_extract_string(data, '$.seo_title'),
    meta_description := json_extract_string(data, '$.meta_description'),
    item_key := CAST(user_id AS VARCHAR), product_name := 'P' || CAST(user_id AS VARCHAR))) AS VARCHAR)
  || chr(10) || chr(10) AS frame
FROM ok WHERE event = 'done'""", "std_frames", ctes=_DEC),
    "log_counts": with_ctes("""
SELECT json_extract_string(data, '$.type') AS type, count(*) AS n_events FROM ok WHERE event = 'log' GROUP BY 1""",
                            "std_frames", ctes=_DEC),
    "outcome_log": with_ctes("SELECT input_seq, cat_catalog_seq, route, message, type FROM outl",
                             "std_items", "std_catalog", "std_documents", ctes=_ROUTED + ", " + _OUT),
    "event_rows": with_ctes(f"""
SELECT o.input_seq, o.cat_catalog_seq, 0 AS pos, 'log' AS event, 'info' AS type,
  {_frame("'Starting ''' || coalesce(n.product_name, '') || ''''", "'info'")} AS frame
FROM outl o JOIN nm n ON o.input_seq = n.input_seq
UNION ALL
SELECT input_seq, cat_catalog_seq, 1, 'log', type, {_frame('message', 'type')} FROM outl""",
                            "std_items", "std_catalog", "std_documents", ctes=_ROUTED + ", " + _OUT),
}
