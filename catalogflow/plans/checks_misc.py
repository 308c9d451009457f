"""Registered checks: attempt selection (W5), JSON answers (H10, H11, P11),
fallbacks and gates (H12, F6-F8), defaults (P4, P5), prompt rendering
(H9, J8), request payloads (S3, J6), run stamps and payloads (K4, K5),
elapsed time (P9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.html import base_name
from ..functions.prompts import ESCAPES, render
from ..functions.text import default_if_empty, default_if_missing, elapsed_hms
from ..operators.attempts import select_attempt
from ..session import scratch_path
from ..sinks.files import payload_base64, payload_decode, stamped_name
from ..sources.requests import json_request_rows, positional_pairs
from ..sources.templates import load_templates, template_map
from . import sqlfrag as Q
from .standin_html import _base_cols, made_content, made_html
from .standins import table, with_ctes


def std_attempts(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", (F.col("turn") + 1).alias("attempt"),
                    (F.length("text") % 101).cast("double").alias("score"), F.md5("text").alias("content_md5"))


def made_responses(spark, d):
    t = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    resp = (F.when(F.col("doc_id") % 23 == 0, F.lit(None).cast("string"))
             .when(F.col("doc_id") % 17 == 0, F.concat(F.lit('{"error": "quota exceeded for '), i, F.lit('"}')))
             .when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit('\n```json\n{"seo_title": "T'), i,
                                                      F.lit('", "meta": {"d": "x"}, "html_content": "<p>ok</p>"}\n```')))
             .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('x {"seo_title": "T'), i,
                                                      F.lit('", "html_content": "<h2>a</h2>"} y '), F.col("text")))
             .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('{"seo_title": "T'), i,
                                                      F.lit('", "nested": {"a": 1}, "html_content": "h"}'), F.col("text")))
             .when(F.col("doc_id") % 5 == 3, F.col("text"))
             .otherwise(F.concat(F.lit('{x} then ```json {"seo_title": "T'), i, F.lit('"} ```'), F.col("text"))))
    return t.select("doc_id", resp.alias("response"))


def _extract(spark, d, mode):
    r = made_responses(spark, d)
    x = J.extract_json_text("response", mode)
    r = r.withColumn("x", x)
    ok = J.is_json("x")
    return r.select("doc_id", F.length("x").cast("bigint").alias("extracted_len"), F.md5("x").alias("extracted_md5"),
                    ok.alias("parsed"), F.when(ok, F.get_json_object("x", "$.seo_title")).alias("seo_title"))


def attempt_last_q(spark, d):
    return select_attempt(std_attempts(spark, d), "conv_id", target=95, max_attempts=2, select="last")


def attempt_best_q(spark, d):
    return select_attempt(std_attempts(spark, d), "conv_id", target=95, max_attempts=2, select="best")


def extract_json_shortest_q(spark, d):
    return _extract(spark, d, "shortest")


def extract_json_outermost_q(spark, d):
    return _extract(spark, d, "outermost")


def model_errors_q(spark, d):
    r = made_responses(spark, d).withColumn("x", J.extract_json_text("response", "outermost"))
    e = J.json_error("x")
    return r.where(e.isNotNull()).select("doc_id", e.alias("error"), F.lit("model_error").alias("route"))


def json_quarantine_q(spark, d):
    r = made_responses(spark, d).withColumn("x", J.extract_json_text("response", "shortest"))
    return r.where(F.col("x").isNotNull() & ~J.is_json("x")).select("doc_id", J.reject_sample("x").alias("sample"))


def fallback_meta_q(spark, d):
    h = made_html(spark, d)
    return h.select("doc_id", J.fallback_title("product_name").alias("seo_title"),
                    J.fallback_description("product_name").alias("meta_description"),
                    F.md5(J.fallback_html("html")).alias("html_md5"))


def length_gate_q(spark, d):
    c = made_content(spark, d)
    return c.select("doc_id", J.generated_ok("html_content").alias("generated_ok"),
                    F.length(J.fallback_html("html_content")).cast("bigint").alias("fallback_len"))


def score_bands_q(spark, d):
    a = std_attempts(spark, d)
    return a.select("conv_id", "attempt", J.score_band("score").alias("band"))


def default_fill_q(spark, d):
    c = made_content(spark, d)
    return c.select(
        "doc_id",
        default_if_empty("seo_title", F.col("product_name")).alias("title_or"),
        default_if_empty("meta_description", J.DEFAULT_META).alias("meta_or"),
        F.md5(default_if_empty("html_content", J.DEFAULT_HTML)).alias("html_or_md5"),
        default_if_missing("seo_title", J.DRAFT_ERROR).alias("title_get"),
        default_if_empty(F.lit(None).cast("string"), J.DEFAULT_KEYWORDS).alias("keywords"))


PROMPT = ("Task: write the product page.\nProduct: {{ product_name }}\nBase name: {{base_name}}\n"
          "Keywords: {{ keywords }}\nLeaflet:\n---\n{{ leaflet }}\n---\nAnswer with one JSON object.")


def render_prompts_q(spark, d):
    b = _base_cols(table(spark, d, "documents"))
    p = render(PROMPT, {"product_name": "product_name", "base_name": base_name("product_name"),
                        "leaflet": "text"}, escape=True)
    return b.select("doc_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_len"))


def template_set_q(spark, d):
    """A folder with a template per language of the documents (and
    files that are none), read as a template set; every document is rendered with
    its language's template."""
    folder = scratch_path(spark, "templates")
    files = {"broken.yml": "template: [unclosed", "empty.yaml": "name: nothing here", "notes.txt": "template: not a template file"}
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    # a template set is small by its nature: one file per language
    for r in docs.select("lang").where("lang is not null").distinct().collect():
        files[f"{r.lang}.yaml"] = ("name: %s\ndescription: texts in %s\ntemplate: |-\n  Language %s, document {{ id }}:\n  {{text}}{{ undefined }}\n"
                                   % ((r.lang,) * 3))
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text in files.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()
    templates = load_templates(spark, folder)
    prompt = F.lit(None).cast("string")
    for name, text in sorted(template_map(templates).items()):
        prompt = F.when(F.col("lang") == name, render(text, {"id": "doc_id", "text": "text"})).otherwise(prompt)
    rows = docs.select("lang", "doc_id", F.md5(prompt).alias("prompt_md5"))
    out = rows.join(templates, F.col("template_name") == F.col("lang"), "full")
    return out.select("template_name", "description", F.col("error").isNull().alias("ok"), "doc_id", "prompt_md5")


def std_requests(spark, d):
    o = table(spark, d, "orders")
    n_docs = table(spark, d, "documents").agg(F.count(F.lit(1))).scalar()
    o = o.withColumn("doc", (F.col("o_orderkey") % n_docs).cast("string"))
    g = F.floor(F.col("o_orderkey") / 100).cast("bigint").alias("g")
    lists = o.groupBy(g).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", "doc"))).alias("xs"))
    return lists.select(
        "g",
        F.to_json(F.transform("xs", lambda x: x["o_custkey"].cast("string"))).alias("skus_json"),
        F.transform("xs", lambda x: x["o_custkey"]).alias("skus"),
        F.transform("xs", lambda x: x["doc"]).alias("docs"))


def json_request_rows_q(spark, d):
    return json_request_rows(std_requests(spark, d), "skus_json", id_cols=["g"])


def positional_pairs_q(spark, d):
    return positional_pairs(std_requests(spark, d), "skus", "docs", id_cols=["g"])


def run_stamp_q(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", stamped_name("catalog_final", F.col("ts"), "xlsx").alias("filename"))


def payload_base64_q(spark, d):
    t = table(spark, d, "documents")
    b64 = payload_base64(F.encode("text", "UTF-8"))
    return t.select("doc_id", F.md5(b64).alias("b64_md5"), F.length(b64).cast("bigint").alias("b64_len"),
                    (F.decode(payload_decode(b64), "UTF-8") == F.col("text")).alias("roundtrip"))


def elapsed_hms_q(spark, d):
    e = table(spark, d, "events")
    # difference taken on the zone-free timestamps: no session time zone involved
    g = e.groupBy("user_id").agg(
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1000).cast("bigint").alias("ms"))
    return g.select("user_id", "ms", elapsed_hms("ms").alias("elapsed"))


QUERIES = {
    "attempt_last": attempt_last_q,
    "attempt_best": attempt_best_q,
    "extract_json_shortest": extract_json_shortest_q,
    "extract_json_outermost": extract_json_outermost_q,
    "model_errors": model_errors_q,
    "json_quarantine": json_quarantine_q,
    "fallback_meta": fallback_meta_q,
    "length_gate": length_gate_q,
    "score_bands": score_bands_q,
    "default_fill": default_fill_q,
    "render_prompts": render_prompts_q,
    "template_set": template_set_q,
    "json_request_rows": json_request_rows_q,
    "positional_pairs": positional_pairs_q,
    "run_stamp": run_stamp_q,
    "payload_base64": payload_base64_q,
    "elapsed_hms": elapsed_hms_q,
}

# ---------------------------------------------------------------- oracle SQL
_ATT = """att AS (SELECT conv_id, turn + 1 AS attempt, CAST(length(text) % 101 AS DOUBLE) AS score,
                      md5(text) AS content_md5 FROM conversations WHERE turn + 1 <= 2),
fp AS (SELECT conv_id, min(attempt) AS fa FROM att WHERE score >= 95 GROUP BY conv_id),
la AS (SELECT conv_id, max(attempt) AS la FROM att GROUP BY conv_id),
best AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, attempt ASC) = 1)"""

_RESP = """resp AS (SELECT doc_id, CASE
  WHEN doc_id % 23 = 0 THEN NULL
  WHEN doc_id % 17 = 0 THEN '{"error": "quota exceeded for ' || CAST(doc_id AS VARCHAR) || '"}'
  WHEN doc_id % 5 = 0 THEN text || chr(10) || '```json' || chr(10) || '{"seo_title": "T' || CAST(doc_id AS VARCHAR)
       || '", "meta": {"d": "x"}, "html_content": "<p>ok</p>"}' || chr(10) || '```'
  WHEN doc_id % 5 = 1 THEN 'x {"seo_title": "T' || CAST(doc_id AS VARCHAR) || '", "html_content": "<h2>a</h2>"} y ' || text
  WHEN doc_id % 5 = 2 THEN '{"seo_title": "T' || CAST(doc_id AS VARCHAR) || '", "nested": {"a": 1}, "html_content": "h"}' || text
  WHEN doc_id % 5 = 3 THEN text
  ELSE '{x} then ```json {"seo_title": "T' || CAST(doc_id AS VARCHAR) || '"} ```' || text END AS response
FROM documents)"""


def _x_sql(mode: str) -> str:
    if mode == "shortest":
        return (f"coalesce(nullif(regexp_extract(response, {Q.lit(J.SHORTEST)}, 1), ''), "
                f"nullif(regexp_extract(response, {Q.lit(J.SHORTEST)}, 2), ''))")
    return (f"coalesce(nullif(regexp_extract(response, {Q.lit(J.OUTERMOST_FENCED)}, 1), ''), "
            f"nullif(regexp_extract(response, {Q.lit(J.OUTERMOST)}, 1), ''))")


def _extract_sql(mode: str) -> str:
    return with_ctes(f"""
SELECT doc_id, length(x) AS extracted_len, md5(x) AS extracted_md5, coalesce(json_valid(x), false) AS parsed,
       CASE WHEN coalesce(json_valid(x), false) THEN json_extract_string(x, '$.seo_title') END AS seo_title
FROM (SELECT doc_id, {_x_sql(mode)} AS x FROM resp)""", ctes=_RESP)


def _esc(e: str) -> str:
    for a, b in ESCAPES:
        e = f"replace({e}, {Q.lit(a)}, {Q.lit(b)})"
    return e


_BC = ("bc AS (SELECT doc_id, text, 'Remedio' || upper(lang) || ' ' || CAST(doc_id % 90 + 10 AS VARCHAR) "
       "|| 'mg + 5mg' AS product_name FROM documents)")
_PROMPT_SQL = ("'Task: write the product page.' || chr(10) || 'Product: ' || " + _esc("coalesce(product_name, '')")
               + " || chr(10) || 'Base name: ' || " + _esc(f"coalesce({Q.base_name('product_name')}, '')")
               + " || chr(10) || 'Keywords: ' || chr(10) || 'Leaflet:' || chr(10) || '---' || chr(10) || "
               + _esc("coalesce(text, '')") + " || chr(10) || '---' || chr(10) || 'Answer with one JSON object.'")


def _hms(ms: str) -> str:
    def two(e):
        return f"(CASE WHEN {e} < 10 THEN '0' ELSE '' END || CAST({e} AS VARCHAR))"
    return (f"{two(f'({ms}) // 3600000')} || ':' || {two(f'(({ms}) // 60000) % 60')} || ':' || "
            f"{two(f'(({ms}) // 1000) % 60')}")


ORACLE = {
    "attempt_last": with_ctes("""
SELECT la.conv_id, a.attempt, a.score, a.content_md5, coalesce(fp.fa, la.la) AS attempts_run
FROM la LEFT JOIN fp ON la.conv_id = fp.conv_id
JOIN att a ON a.conv_id = la.conv_id AND a.attempt = coalesce(fp.fa, la.la)""", ctes=_ATT),
    "attempt_best": with_ctes("""
SELECT la.conv_id, coalesce(p.attempt, b.attempt) AS attempt, coalesce(p.score, b.score) AS score,
       coalesce(p.content_md5, b.content_md5) AS content_md5, coalesce(fp.fa, la.la) AS attempts_run
FROM la LEFT JOIN fp ON la.conv_id = fp.conv_id
LEFT JOIN att p ON p.conv_id = fp.conv_id AND p.attempt = fp.fa
JOIN best b ON b.conv_id = la.conv_id""", ctes=_ATT),
    "extract_json_shortest": _extract_sql("shortest"),
    "extract_json_outermost": _extract_sql("outermost"),
    "model_errors": with_ctes(f"""
SELECT doc_id, json_extract_string(x, '$.error') AS error, 'model_error' AS route
FROM (SELECT doc_id, {_x_sql('outermost')} AS x FROM resp)
WHERE coalesce(json_valid(x), false) AND json_extract_string(x, '$.error') IS NOT NULL""", ctes=_RESP),
    "json_quarantine": with_ctes(f"""
SELECT doc_id, substring(x, 1, 500) AS sample
FROM (SELECT doc_id, {_x_sql('shortest')} AS x FROM resp)
WHERE x IS NOT NULL AND NOT coalesce(json_valid(x), false)""", ctes=_RESP),
    "fallback_meta": with_ctes(f"""
SELECT doc_id, product_name || ' - Para que serve e como usar' AS seo_title,
  'Encontre aqui informações essenciais sobre ' || product_name || ': para que serve, como funciona, '
    || 'como usar e mais. Consulte a bula e um profissional de saúde.' AS meta_description,
  md5(CASE WHEN html IS NULL OR length(html) < 20 THEN {Q.lit(J.FALLBACK_HTML_ERROR)} ELSE html END) AS html_md5
FROM made_html""", "made_html"),
    "length_gate": with_ctes(f"""
SELECT doc_id, coalesce(length(html_content) > 50, false) AS generated_ok,
  length(CASE WHEN html_content IS NULL OR length(html_content) < 20 THEN {Q.lit(J.FALLBACK_HTML_ERROR)}
              ELSE html_content END) AS fallback_len
FROM made_content""", "made_html", "made_content"),
    "score_bands": """
SELECT conv_id, turn + 1 AS attempt,
  CASE WHEN length(text) % 101 >= 95 THEN 'approved_quality' WHEN length(text) % 101 >= 70 THEN 'ok'
       ELSE 'below_target' END AS band
FROM conversations""",
    "default_fill": with_ctes(f"""
SELECT doc_id, coalesce(nullif(seo_title, ''), product_name) AS title_or,
  coalesce(nullif(meta_description, ''), {Q.lit(J.DEFAULT_META)}) AS meta_or,
  md5(coalesce(nullif(html_content, ''), {Q.lit(J.DEFAULT_HTML)})) AS html_or_md5,
  coalesce(seo_title, {Q.lit(J.DRAFT_ERROR)}) AS title_get, {Q.lit(J.DEFAULT_KEYWORDS)} AS keywords
FROM made_content""", "made_html", "made_content"),
    "render_prompts": with_ctes(f"""
SELECT doc_id, md5(p) AS prompt_md5, length(p) AS prompt_len FROM (SELECT doc_id, {_PROMPT_SQL} AS p FROM bc)""",
                                ctes=_BC),
    "template_set": """
SELECT lang AS template_name, 'texts in ' || lang AS description, true AS ok, doc_id,
       md5('Language ' || lang || ', document ' || doc_id || ':' || chr(10) || coalesce(text, '')) AS prompt_md5
FROM documents
UNION ALL SELECT unnest(['broken', 'empty']), NULL, false, NULL, NULL""",
    "json_request_rows": """
SELECT CAST(o_orderkey // 100 AS BIGINT) AS g,
  CAST(row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
  o_custkey AS value
FROM orders""",
    "positional_pairs": """
SELECT CAST(o_orderkey // 100 AS BIGINT) AS g,
  CAST(row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
  o_custkey AS skus, CAST(o_orderkey % (SELECT count(*) FROM documents) AS VARCHAR) AS docs
FROM orders""",
    "run_stamp": "SELECT event_id, 'catalog_final_' || strftime(ts, '%Y%m%d_%H%M%S') || '.xlsx' AS filename FROM events",
    "payload_base64": """
SELECT doc_id, md5(to_base64(encode(text))) AS b64_md5, length(to_base64(encode(text))) AS b64_len,
       decode(from_base64(to_base64(encode(text)))) = text AS roundtrip
FROM documents""",
    "elapsed_hms": f"""
SELECT user_id, ms, {_hms('ms')} AS elapsed
FROM (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY user_id)""",
}


def pretty_labels_q(spark, d):
    from ..functions.text import pretty_label
    c = table(spark, d, "conversations")
    k = F.concat(F.col("role"), F.lit("_turn_"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", pretty_label(k).alias("label"))


QUERIES["pretty_labels"] = pretty_labels_q
ORACLE["pretty_labels"] = """
SELECT conv_id, turn, array_to_string(list_transform(string_split(role || ' turn ' || CAST(turn AS VARCHAR), ' '),
       lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label
FROM conversations"""
