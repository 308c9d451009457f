"""Registered checks: ingest, enrichment, routing, lookups, reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators.keys import normalize_keys
from . import sqlfrag as Q
from .standins import std_catalog, std_documents, std_items, with_ctes


def normalize_keys_q(spark, d):
    items = std_items(spark, d)
    return normalize_keys(items.withColumn("raw_key", F.col("item_key")), "item_key") \
        .select("input_seq", "raw_key", "item_key")


def enrich_items_q(spark, d):
    items = normalize_keys(std_items(spark, d), "item_key")
    return E.enrich_items(items, std_catalog(spark, d)).select(
        "input_seq", "item_key", "product_name", "cat_barcode", "cat_leaflet_link",
        "cat_link_valid", "cat_catalog_seq")


def valid_items_q(spark, d):
    return E.valid_items(enrich_items_q(spark, d))


def route_items_q(spark, d):
    r = E.route_items(std_items(spark, d), std_catalog(spark, d), std_documents(spark, d))
    return r.select("input_seq", "item_key", "cat_catalog_seq", "cat_leaflet_link", "route")


def route_counts_q(spark, d):
    r = E.route_items(std_items(spark, d), std_catalog(spark, d), std_documents(spark, d))
    return E.route_counts(r)


def _numbered(spark, d):
    """Items with gaps and repeats in their sequence, numbered."""
    items = normalize_keys(std_items(spark, d).withColumn("input_seq", F.expr("input_seq * 3 div 4 * 5")), "item_key")
    return E.number_items(items)


def chunk_summary_q(spark, d):
    return E.chunk_summary(E.route_items(_numbered(spark, d), std_catalog(spark, d), std_documents(spark, d)))


def unresolved_keys_q(spark, d):
    items = normalize_keys(std_items(spark, d), "item_key")
    cat = std_catalog(spark, d).withColumn("barcode", F.col("barcode"))
    from ..functions.text import normalize_key
    cat = cat.withColumn("barcode", normalize_key("barcode"))
    return E.unresolved_keys(items, cat, "item_key", "barcode").select("input_seq", "item_key")


def lookup_first_q(spark, d):
    from ..functions.text import normalize_key
    items = normalize_keys(std_items(spark, d), "item_key").select("input_seq", "item_key", "product_name")
    cat = std_catalog(spark, d).withColumn("barcode", normalize_key("barcode"))
    return E.lookup_first(items, cat, "item_key", "barcode", "catalog_seq").select(
        "input_seq", "item_key", "leaflet_link", "link_valid", "catalog_seq")


def attach_documents_q(spark, d):
    from ..functions.text import normalize_key
    items = normalize_keys(std_items(spark, d), "item_key").select("input_seq", "item_key")
    cat = std_catalog(spark, d).withColumn("barcode", normalize_key("barcode"))
    first = E.lookup_first(items, cat, "item_key", "barcode", "catalog_seq")
    out = E.attach_documents(first, std_documents(spark, d), "leaflet_link")
    return out.select("input_seq", "leaflet_link",
                      F.length("doc_text").cast("bigint").alias("text_chars"),
                      F.md5("doc_text").alias("text_md5"))


def progress_label_q(spark, d):
    items = normalize_keys(std_items(spark, d).withColumn("input_seq", F.expr("input_seq * 3 div 4 * 5")), "item_key")
    whole = E.progress_label(items, key="item_key").select("input_seq", "item_key", "o_orderstatus", "progress")
    runs = E.progress_label(items, run_col="o_orderstatus", key="item_key").select("input_seq", "item_key", "o_orderstatus", "progress")
    return whole.withColumn("scope", F.lit("all")).unionByName(runs.withColumn("scope", F.lit("run"))).drop("o_orderstatus")


QUERIES = {
    "normalize_keys": normalize_keys_q,
    "enrich_items": enrich_items_q,
    "valid_items": valid_items_q,
    "route_items": route_items_q,
    "route_counts": route_counts_q,
    "chunk_summary": chunk_summary_q,
    "unresolved_keys": unresolved_keys_q,
    "lookup_first": lookup_first_q,
    "attach_documents": attach_documents_q,
    "progress_label": progress_label_q,
}

_NI = f"SELECT input_seq, item_key AS raw_key, {Q.norm_key('item_key')} AS item_key, product_name FROM std_items"
_NC = (f"SELECT {Q.norm_key('barcode')} AS cat_barcode, leaflet_link AS cat_leaflet_link, "
       f"link_valid AS cat_link_valid, catalog_seq AS cat_catalog_seq FROM std_catalog")
_BASE = f"ni AS ({_NI}), nc AS ({_NC})"
_ENR = """SELECT ni.input_seq, ni.item_key, ni.product_name, nc.cat_barcode, nc.cat_leaflet_link,
       nc.cat_link_valid, nc.cat_catalog_seq
FROM ni LEFT JOIN nc ON ni.item_key = nc.cat_barcode WHERE ni.item_key IS NOT NULL"""

_ROUTED = _BASE + f""",
nd AS (SELECT doc_key, first(text ORDER BY doc_seq) AS doc_text FROM std_documents GROUP BY doc_key),
routed AS (
  SELECT ni.input_seq, ni.item_key, nc.cat_catalog_seq, nc.cat_leaflet_link,
    CASE WHEN ni.item_key IS NULL THEN 'no_key'
         WHEN nc.cat_barcode IS NULL THEN 'not_found'
         WHEN NOT {Q.flag_is('nc.cat_link_valid')} THEN 'not_validated'
         WHEN nullif(nc.cat_leaflet_link, '') IS NULL THEN 'no_link'
         WHEN {Q.blank_to_null('nd.doc_text')} IS NULL THEN 'empty_text'
         ELSE 'ready' END AS route
  FROM ni LEFT JOIN nc ON ni.item_key = nc.cat_barcode
          LEFT JOIN nd ON nc.cat_leaflet_link = nd.doc_key)"""

_FIRST = f"""ni AS ({_NI}),
nc1 AS (SELECT {Q.norm_key('barcode')} AS barcode, leaflet_link, link_valid, catalog_seq FROM std_catalog),
firstc AS (SELECT * FROM nc1 WHERE barcode IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY catalog_seq) = 1),
fm AS (SELECT ni.input_seq, ni.item_key, firstc.leaflet_link, firstc.link_valid, firstc.catalog_seq
       FROM ni JOIN firstc ON ni.item_key = firstc.barcode WHERE ni.item_key IS NOT NULL)"""

_IC = ("std_items", "std_catalog")
_ICD = ("std_items", "std_catalog", "std_documents")

_NUM = """num AS (SELECT ni.input_seq, ni.input_seq * 3 // 4 * 5 AS seq, ni.item_key, i.o_orderstatus,
  row_number() OVER (ORDER BY ni.input_seq * 3 // 4 * 5, ni.item_key) - 1 AS item_no
  FROM ni JOIN std_items i USING (input_seq) WHERE ni.item_key IS NOT NULL)"""

ORACLE = {
    "normalize_keys": with_ctes("SELECT input_seq, raw_key, item_key FROM ni WHERE item_key IS NOT NULL",
                                "std_items", ctes=f"ni AS ({_NI})"),
    "enrich_items": with_ctes(_ENR, *_IC, ctes=_BASE),
    "valid_items": with_ctes(_ENR + f" AND {Q.flag_is('nc.cat_link_valid')}", *_IC, ctes=_BASE),
    "route_items": with_ctes("SELECT * FROM routed", *_ICD, ctes=_ROUTED),
    "route_counts": with_ctes("""
SELECT CAST(floor(input_seq / 500) AS BIGINT) AS chunk_no, route, count(*) AS n_rows
FROM routed GROUP BY ALL""", *_ICD, ctes=_ROUTED),
    "chunk_summary": with_ctes(f"""
SELECT CAST(floor(item_no / 500) AS BIGINT) AS chunk_no, count(DISTINCT item_no) AS n_items,
       count(*) FILTER (WHERE route NOT IN ('no_key', 'not_found', 'not_validated')) AS n_valid,
       count(*) FILTER (WHERE route = 'ready') AS n_ready,
       least(CAST(floor(item_no / 500) AS BIGINT) * 500 + 500, (SELECT count(*) FROM num)) AS processed_count
FROM (SELECT num.item_no, any_value(routed.route) AS route FROM num JOIN routed USING (input_seq) GROUP BY num.item_no, routed.cat_catalog_seq)
GROUP BY 1""", *_ICD, ctes=_ROUTED + ", " + _NUM),
    "unresolved_keys": with_ctes(f"""
SELECT input_seq, item_key FROM ni
WHERE item_key IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM std_catalog c WHERE {Q.norm_key('c.barcode')} = ni.item_key)""",
                                 *_IC, ctes=f"ni AS ({_NI})"),
    "lookup_first": with_ctes("SELECT * FROM fm", *_IC, ctes=_FIRST),
    "attach_documents": with_ctes("""
SELECT fm.input_seq, fm.leaflet_link, length(nd.doc_text) AS text_chars, md5(nd.doc_text) AS text_md5
FROM fm LEFT JOIN nd ON fm.leaflet_link = nd.doc_key""", *_ICD,
                                  ctes=_FIRST + ", nd AS (SELECT doc_key, first(text ORDER BY doc_seq) AS doc_text FROM std_documents GROUP BY doc_key)"),
    "progress_label": with_ctes(f"""
SELECT seq AS input_seq, item_key, '(' || (item_no + 1) || '/' || (SELECT count(*) FROM num) || ')' AS progress, 'all' AS scope FROM num
UNION ALL
SELECT seq, item_key, '(' || row_number() OVER (PARTITION BY o_orderstatus ORDER BY seq, item_key) || '/'
  || count(*) OVER (PARTITION BY o_orderstatus) || ')', 'run' FROM num""", "std_items", ctes=f"ni AS ({_NI}), {_NUM}"),
}
