"""Stand-in inputs over the driver tables (see FIXTURES.md part C).

Each stand-in has a Spark builder and the same derivation as DuckDB SQL
(``SQL[name]``), so a registered check compares an operator's Spark result
with an independent SQL formulation over identical inputs.  All stand-ins
read whole tables; none samples or caps rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NBSP = "\u00a0"
EM_SPACE = "\u2003"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c):
    return F.col(c).cast("string")


def std_items(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ck = _s("o_custkey")
    raw = (F.when(k % 17 == 0, F.lit(None).cast("string"))
             .when(k % 19 == 0, F.lit(" \t "))
             .when(k % 5 == 0, F.concat(ck, F.lit(".0")))
             .when(k % 5 == 1, F.concat(F.lit(" "), ck, F.lit("  ")))
             .when(k % 5 == 2, F.concat(F.lit(NBSP), ck, F.lit(EM_SPACE)))
             .otherwise(ck))
    return o.select(
        k.alias("input_seq"),
        raw.alias("item_key"),
        F.col("o_orderpriority").alias("product_name"),
        F.when(k % 4 == 0, F.concat(F.lit("Old title "), _s("o_orderkey"))).alias("seo_title"),
        F.when(k % 6 == 0, F.lit("")).alias("meta_description"),
        F.lit(None).cast("string").alias("html_content"),
        F.col("o_orderstatus"),
    )


def std_catalog(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 5 != 4)
    # links reach all documents, however many there are
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    ck = _s("c_custkey")
    base = c.select(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), ck)).otherwise(ck).alias("barcode"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("string"))
         .when(F.col("c_custkey") % 7 == 1, F.lit(""))
         .otherwise((F.col("c_custkey") % n_docs).cast("string")).alias("leaflet_link"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(" Sim "))
         .when(F.col("c_custkey") % 3 == 1, F.lit("NÃO"))
         .otherwise(F.lit("SIM")).alias("link_valid"),
        (F.col("c_custkey") * 2).alias("catalog_seq"),
        F.col("c_name"),
    )
    copy = c.where(F.col("c_custkey") % 11 == 0).select(
        ck.alias("barcode"),
        ((F.col("c_custkey") + 7) % n_docs).cast("string").alias("leaflet_link"),
        F.lit("sim").alias("link_valid"),
        (F.col("c_custkey") * 2 + 1).alias("catalog_seq"),
        F.col("c_name"),
    )
    return base.unionByName(copy)


def std_documents(spark, sf_dir) -> DataFrame:
    """Every document, some blank, some followed by a second text of the same key."""
    d = table(spark, sf_dir, "documents")
    base = d.select(
        _s("doc_id").alias("doc_key"),
        F.when(F.col("doc_id") % 26 == 0, F.lit(""))
         .when(F.col("doc_id") % 13 == 0, F.lit(" \n "))
         .otherwise(F.col("text")).alias("text"),
        (F.col("doc_id") * 2).alias("doc_seq"))
    later = d.where(F.col("doc_id") % 3 == 0).select(
        _s("doc_id").alias("doc_key"), F.when(F.col("doc_id") % 2 == 0, F.lit("A later leaflet")).otherwise(F.lit("")).alias("text"),
        (F.col("doc_id") * 2 + 1).alias("doc_seq"))
    return base.unionByName(later)


def std_original(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cols = lambda seq: [
        _s("doc_id").alias("doc_key"), seq.alias("orig_seq"), F.col("lang"), F.col("source"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("T"), _s("doc_id"))).alias("title"),
        F.col("n_chars")]
    base = d.select(*cols(F.col("doc_id") * 2))
    copy = d.where(F.col("doc_id") % 50 == 0).select(*cols(F.col("doc_id") * 2 + 1))
    return base.unionByName(copy)


def std_updates(spark, sf_dir) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select(
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("u"), _s("doc_id"))).otherwise(_s("doc_id")).alias("doc_key"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
         .when(F.col("doc_id") % 3 == 1, F.lit(""))
         .otherwise(F.concat(F.lit("q"), _s("quality"))).alias("lang"),
        F.when(F.col("toxic") == 1, F.lit("toxic"))
         .when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("upd"), _s("doc_id"))).alias("title"),
        F.lit("x").alias("extra"),
        F.col("doc_id").alias("upd_pos"),
    )


def std_updates_dup(spark, sf_dir) -> DataFrame:
    u = std_updates(spark, sf_dir)
    lb = table(spark, sf_dir, "labels").where(F.col("doc_id") % 9 == 0)
    late = lb.select(_s("doc_id").alias("doc_key"), F.lit("late").alias("lang"),
                     F.lit(None).cast("string").alias("title"), F.lit("y").alias("extra"),
                     (F.col("doc_id") + 1000000000).alias("upd_pos"))
    return u.unionByName(late)


def std_reviews(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        _s("user_id").alias("item_key"),
        F.when(F.col("event_type") == "purchase", F.lit("approved"))
         .when(F.col("event_type") == "error", F.lit("disapproved"))
         .otherwise(F.lit("pending")).alias("status"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.concat(F.col("event_type"), F.lit(" "), _s("user_id")).alias("seo_title"),
        F.col("props").alias("meta_description"),
        F.concat(F.lit("<p>"), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("</p>")).alias("html_content"),
    )


SQL = {
    "std_items": """
SELECT o_orderkey AS input_seq,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderkey % 19 = 0 THEN ' ' || chr(9) || ' '
       WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0'
       WHEN o_orderkey % 5 = 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || '  '
       WHEN o_orderkey % 5 = 2 THEN chr(160) || CAST(o_custkey AS VARCHAR) || chr(8195)
       ELSE CAST(o_custkey AS VARCHAR) END AS item_key,
  o_orderpriority AS product_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Old title ' || CAST(o_orderkey AS VARCHAR) END AS seo_title,
  CASE WHEN o_orderkey % 6 = 0 THEN '' END AS meta_description,
  CAST(NULL AS VARCHAR) AS html_content,
  o_orderstatus
FROM orders""",
    "std_catalog": """
SELECT CASE WHEN c_custkey % 2 = 0 THEN ' ' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS barcode,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '' ELSE CAST(c_custkey % (SELECT count(*) FROM documents) AS VARCHAR) END AS leaflet_link,
  CASE WHEN c_custkey % 3 = 0 THEN ' Sim ' WHEN c_custkey % 3 = 1 THEN 'NÃO' ELSE 'SIM' END AS link_valid,
  c_custkey * 2 AS catalog_seq, c_name
FROM customer WHERE c_custkey % 5 <> 4
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), CAST((c_custkey + 7) % (SELECT count(*) FROM documents) AS VARCHAR), 'sim', c_custkey * 2 + 1, c_name
FROM customer WHERE c_custkey % 5 <> 4 AND c_custkey % 11 = 0""",
    "std_documents": """
SELECT CAST(doc_id AS VARCHAR) AS doc_key,
  CASE WHEN doc_id % 26 = 0 THEN '' WHEN doc_id % 13 = 0 THEN ' ' || chr(10) || ' ' ELSE text END AS text, doc_id * 2 AS doc_seq
FROM documents
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 'A later leaflet' ELSE '' END, doc_id * 2 + 1
FROM documents WHERE doc_id % 3 = 0""",
    "std_original": """
SELECT CAST(doc_id AS VARCHAR) AS doc_key, doc_id * 2 AS orig_seq, lang, source,
  CASE WHEN doc_id % 3 <> 0 THEN 'T' || CAST(doc_id AS VARCHAR) END AS title, n_chars
FROM documents
UNION ALL
SELECT CAST(doc_id AS VARCHAR), doc_id * 2 + 1, lang, source,
  CASE WHEN doc_id % 3 <> 0 THEN 'T' || CAST(doc_id AS VARCHAR) END, n_chars
FROM documents WHERE doc_id % 50 = 0""",
    "std_updates": """
SELECT CASE WHEN doc_id % 7 = 0 THEN 'u' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS doc_key,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'q' || CAST(quality AS VARCHAR) END AS lang,
  CASE WHEN toxic = 1 THEN 'toxic' WHEN doc_id % 4 = 0 THEN NULL ELSE 'upd' || CAST(doc_id AS VARCHAR) END AS title,
  'x' AS extra, doc_id AS upd_pos
FROM labels""",
    "std_updates_dup": """
SELECT * FROM std_updates
UNION ALL
SELECT CAST(doc_id AS VARCHAR), 'late', CAST(NULL AS VARCHAR), 'y', doc_id + 1000000000
FROM labels WHERE doc_id % 9 = 0""",
    "std_reviews": """
SELECT CAST(user_id AS VARCHAR) AS item_key,
  CASE WHEN event_type = 'purchase' THEN 'approved' WHEN event_type = 'error' THEN 'disapproved' ELSE 'pending' END AS status,
  event_id AS seq, ts,
  event_type || ' ' || CAST(user_id AS VARCHAR) AS seo_title,
  props AS meta_description,
  '<p>' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || '</p>' AS html_content
FROM events""",
}


def _all_sql():
    from .standin_html import SQL as HTML_SQL
    out = dict(SQL)
    out.update(HTML_SQL)
    return out


def with_ctes(body: str, *names: str, ctes: str = "") -> str:
    """Prefix ``body`` (a SELECT) with the stand-in CTEs it uses plus extra
    CTE definitions ``ctes`` (``a AS (...), b AS (...)``)."""
    sql = _all_sql()
    parts = [f"{n} AS ({sql[n]}\n)" for n in names]
    if ctes.strip():
        parts.append(ctes.strip())
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def std_ledger(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    before = (F.col("user_id") % 101).cast("int")
    after = (F.floor(F.col("value")) % 101).cast("int")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("s"), _s("user_id")).alias("strategy"),
                    F.col("event_type").alias("product_type"), before.alias("score_before"),
                    after.alias("score_after"), (after - before).alias("delta"), F.col("ts"))


def std_requested_types(spark, sf_dir) -> DataFrame:
    """Every event type plus the document languages (types absent from the ledger)."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("product_type"))
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("product_type"))
    return ev.union(langs).distinct()


SQL["std_ledger"] = """
SELECT event_id AS seq, 's' || CAST(user_id AS VARCHAR) AS strategy, event_type AS product_type,
  CAST(user_id % 101 AS INTEGER) AS score_before, CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) AS score_after,
  CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) - CAST(user_id % 101 AS INTEGER) AS delta, ts
FROM events"""
SQL["std_requested_types"] = """
SELECT DISTINCT product_type FROM (SELECT event_type AS product_type FROM events UNION ALL SELECT lang FROM documents)"""


def std_frames(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    event = F.when(et == "error", F.lit("error")).when(et == "purchase", F.lit("done")).otherwise(F.lit("log"))
    typ = (F.when(et == "view", F.lit("info")).when(et == "click", F.lit("success"))
            .when(et == "signup", F.lit("warning")).otherwise(F.lit("error")))
    done = F.to_json(F.struct(F.floor("value").cast("int").alias("final_score"),
                              F.concat(F.lit("<p>"), _s("user_id"), F.lit("</p>")).alias("final_content"),
                              F.concat(F.lit("T"), _s("user_id")).alias("seo_title"),
                              F.col("props").alias("meta_description")))
    log = F.to_json(F.struct(F.concat(F.lit("value "), F.col("value").cast("decimal(12,2)").cast("string")).alias("message"),
                             typ.alias("type")))
    data = F.when(et == "purchase", done).otherwise(log)
    from ..operators.events import encode_frame
    return e.select("event_id", "user_id", event.alias("event"), encode_frame(event, data).alias("frame"))


SQL["std_frames"] = """
SELECT event_id, user_id,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'done' ELSE 'log' END AS event,
  'event: ' || CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'done' ELSE 'log' END
  || chr(10) || 'data: ' || CASE WHEN event_type = 'purchase' THEN
      CAST(to_json(struct_pack(final_score := CAST(floor(value) AS INTEGER), final_content := '<p>' || CAST(user_id AS VARCHAR) || '</p>',
                               seo_title := 'T' || CAST(user_id AS VARCHAR), meta_description := props)) AS VARCHAR)
    ELSE CAST(to_json(struct_pack(message := 'value ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR),
      type := CASE WHEN event_type = 'view' THEN 'info' WHEN event_type = 'click' THEN 'success'
                   WHEN event_type = 'signup' THEN 'warning' ELSE 'error' END)) AS VARCHAR) END
  || chr(10) || chr(10) AS frame
FROM events"""
