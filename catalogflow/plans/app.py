"""Entry-point compositions of the application.

* ``build_draft`` (E1): items x catalog -> validated, routed, documents
  attached -> content pipeline on ready keys -> merged back into the sheet.
* ``review_set`` (E2): explicit (sku, document) request lists -> first-match
  rows -> pipeline -> review items with their quality band.
* ``finalize_approved`` / ``finalize_rejected`` (E3/E4) live in
  ``operators.review``; ``reprocess`` (E5) re-runs rejected keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import has_text, normalize_key
from ..operators import enrich as E
from ..operators.completions import produce_content
from ..operators.events import encode_frame
from ..operators.keys import normalize_keys
from ..operators.merge import merge_updates
from ..operators.review import latest_reviews, review_split
from ..session import materialize
from ..sources.requests import positional_pairs

CONTENT_COLS = ("seo_title", "meta_description", "html_content")


def document_texts(documents: DataFrame, link: str, doc_key: str = "doc_key", text: str = "text",
                   doc_order: str | None = "doc_seq", wanted: DataFrame | None = None) -> DataFrame:
    """(``link``, leaflet_text): the first text of every document, stored for the
    stages that read it.  With ``wanted``, of the documents its ``link`` names only."""
    docs = E.first_document(documents, F.col(text), doc_key, text, doc_order)
    docs = docs.select(F.col("_doc_key").cast("string").alias(link), F.col("_first").alias("leaflet_text"))
    if wanted is not None:
        docs = docs.join(wanted.select(F.col(link).cast("string").alias("_wk")), F.col(link) == F.col("_wk"), "left_semi")
    return materialize(docs, "texts", "zstd")


def ready_items(items: DataFrame, catalog: DataFrame, documents: DataFrame, key: str = "item_key",
                dedupe_catalog: bool = True, name: str = "product_name") -> DataFrame:
    """Validated items whose leaflet has text, one row per key (first by
    ``input_seq``), with the link to it: the model is called once per product.

    An item's route follows from its key, so each key is routed once, by its first
    item: the other rows of the sheet meet neither catalog nor documents."""
    cat = catalog
    if dedupe_catalog:
        cat = E.dedupe_first(cat.withColumn("barcode", normalize_key("barcode")), "barcode", "catalog_seq")
    first = E.dedupe_first(normalize_keys(items.select("input_seq", key, name), key), key, "input_seq")
    routed = E.route_items(first, cat, documents, key)
    ready = routed.where(F.col("route") == "ready").select("input_seq", key, name, "cat_leaflet_link")
    return ready if dedupe_catalog else E.dedupe_first(ready, key, "input_seq")


def draft_products(items: DataFrame, catalog: DataFrame, documents: DataFrame, key: str = "item_key",
                   name: str = "product_name") -> tuple[DataFrame, DataFrame]:
    """What a draft asks for, both stored: the ready items (see ``ready_items``) and
    the texts of the documents they link to (``cat_leaflet_link``, leaflet_text)."""
    ready = materialize(ready_items(items, catalog, documents, key, name=name), "ready")
    return ready, document_texts(documents, "cat_leaflet_link", wanted=ready)


def build_draft(items: DataFrame, catalog: DataFrame, documents: DataFrame, completion_fn,
                key: str = "item_key", name: str = "product_name",
                products: tuple[DataFrame, DataFrame] | None = None, **kw) -> DataFrame:
    """The draft sheet -- every item row, generated columns merged in
    with update-preserve semantics (duplicate item keys all get the result).

    ``products``: the ``draft_products`` of the same sheet, catalog and documents,
    where the caller has them; they are made here otherwise."""
    items = normalize_keys(items, key)
    ready, texts = products or draft_products(items, catalog, documents, key, name)
    done = produce_content(ready, key, name, "leaflet_text", completion_fn, link="cat_leaflet_link", texts=texts, **kw)
    updates = done.select(key, "seo_title", "meta_description", F.col("final_content").alias("html_content"))
    return merge_updates(items, updates, key, columns=list(CONTENT_COLS), duplicates="unique")


def routed_pairs(sheet: DataFrame, requests: DataFrame, documents: DataFrame, request: str,
                 sku_list: str = "skus", doc_list: str = "docs", sku: str = "sku", order: str = "input_seq",
                 name: str = "product_name", keywords: str = "keywords", doc_key: str = "doc_key",
                 text: str = "text", doc_order: str | None = "doc_seq") -> DataFrame:
    """E2 up to the texts: one row per requested (sku, document) pair, by request
    and position, with the first sheet row of the sku, default keywords (P4) and
    a ``route``: unknown_sku, empty_text or ready.  Nothing disappears."""
    pairs = positional_pairs(requests, sku_list, doc_list, id_cols=[request])
    pairs = pairs.select(request, "pos", F.col(sku_list).cast("bigint").alias("_sku"), F.col(doc_list).alias("doc"))
    first = E.dedupe_first(sheet.withColumn(sku, F.col(sku).cast("bigint")), sku, order)
    rows = E.left_join_spread_nulls(pairs, first, "_sku", sku)
    given = F.nullif(F.col(keywords), F.lit("")) if keywords in sheet.columns else F.lit(None).cast("string")
    rows = rows.withColumn(keywords, F.coalesce(given, F.lit(J.DEFAULT_KEYWORDS)))
    rows = E.left_join_spread_nulls(rows, E.document_flags(documents, doc_key, text, doc_order), "doc", "_doc_key")
    route = (F.when(F.col(sku).isNull(), F.lit("unknown_sku"))
              .when(~F.coalesce(F.col("_has_text"), F.lit(False)), F.lit("empty_text")).otherwise(F.lit("ready")))
    return rows.select(request, "pos", F.col("_sku").alias(sku), "doc", F.col(order), F.col(name), keywords, route.alias("route"))


def review_pairs(sheet: DataFrame, requests: DataFrame, documents: DataFrame, request: str, doc_key: str = "doc_key",
                 text: str = "text", doc_order: str | None = "doc_seq", **columns) -> DataFrame:
    """``routed_pairs`` with the text of every pair's document."""
    pairs = routed_pairs(sheet, requests, documents, request, doc_key=doc_key, text=text, doc_order=doc_order, **columns)
    return E.attach_documents(pairs, documents, "doc", doc_key, text, doc_order).withColumnRenamed("doc_text", "leaflet_text")


def _product(name: str, keywords: str):
    return F.to_json(F.struct(name, keywords, "doc"))


def review_products(pairs: DataFrame, name: str = "product_name", keywords: str = "keywords") -> DataFrame:
    """What the ready pairs ask for: (product, name, keywords, doc), a row for each
    name, keywords and document, however many pairs share them."""
    ready = pairs.where(F.col("route") == "ready").select(name, keywords, "doc").distinct()
    return ready.select(_product(name, keywords).alias("product"), name, keywords, "doc")


def review_set(sheet: DataFrame, requests: DataFrame, documents: DataFrame, completion_fn, request: str,
               sku: str = "sku", name: str = "product_name", keywords: str = "keywords", review_score: float = 70,
               **kw) -> DataFrame:
    """Every requested pair with its content, score and quality band (F8).

    Pairs of equal name, keywords and document have equal prompts: they are
    produced once, however often they are asked for.  Pairs with another route
    come back without content."""
    pairs = materialize(routed_pairs(sheet, requests, documents, request, sku=sku, name=name, keywords=keywords), "pairs", "zstd")
    done = produce_content(review_products(pairs, name, keywords), "product", name, "leaflet_text", completion_fn, keywords=keywords,
                           texts=document_texts(documents, "doc"), link="doc", **kw)
    out = pairs.withColumn("_product", F.when(F.col("route") == "ready", _product(name, keywords)))
    out = E.left_join_spread_nulls(out, done, "_product", "product")
    ready_ = F.col("route") == "ready"
    return out.select(
        request, "pos", sku, "doc", name, "route",
        F.when(ready_, F.coalesce(F.nullif("final_content", F.lit("")), F.lit(J.DEFAULT_HTML))).alias("html_content"),
        F.when(ready_, F.coalesce(F.nullif("seo_title", F.lit("")), F.col(name))).alias("seo_title"),
        F.when(ready_, F.coalesce(F.nullif("meta_description", F.lit("")), F.lit(J.DEFAULT_META))).alias("meta_description"),
        "final_score", F.when(ready_, J.score_band("final_score", review=review_score)).alias("band"),
        F.when(ready_, F.when(F.col("final_score") >= review_score, F.lit("success")).otherwise(F.lit("info"))).alias("type"))


def reprocess_queue(events: DataFrame, catalog: DataFrame, documents: DataFrame, key: str = "item_key",
                    order=("ts", "seq")) -> DataFrame:
    """E5 up to the model call: latest-disapproved keys -> first catalog row
    (no validity filter here) -> document text."""
    rejected = review_split(latest_reviews(events, key, order, ("status",)), "disapproved").select(key)
    cat = catalog.withColumn("barcode", normalize_key("barcode"))
    first = E.lookup_first(rejected.withColumn(key, normalize_key(key)), cat, key, "barcode", "catalog_seq")
    return E.attach_documents(first, documents, "leaflet_link")


def reprocess(events: DataFrame, catalog: DataFrame, documents: DataFrame, names: DataFrame,
              completion_fn, key: str = "item_key", name: str = "product_name", **kw) -> DataFrame:
    """E5: rejected items regenerated; done payloads carry key and name
    (ST4) and sheet column names (P6); every row returns as `pending`."""
    q = reprocess_queue(events, catalog, documents, key).where(has_text(F.col("doc_text")))
    q = q.join(names.select(F.col(key).alias("_nk"), name), F.col(key) == F.col("_nk"), "left").drop("_nk")
    q = q.withColumn(name, F.coalesce(F.col(name), F.col(key)))
    done = produce_content(q.select(key, name, F.col("doc_text").alias("leaflet_text")), key, name,
                            "leaflet_text", completion_fn, **kw)
    done = done.join(q.select(F.col(key).alias("_k"), name), F.col(key) == F.col("_k")).drop("_k")
    payload = F.to_json(F.struct(F.col("final_score"), F.col("final_content"), F.col("seo_title"),
                                 F.col("meta_description"), F.col(key).alias("item_key"), F.col(name).alias("product_name")))
    return done.select(key, name, F.col("final_content").alias("html_content"), "seo_title", "meta_description",
                       "final_score", F.lit("pending").alias("status"),
                       encode_frame(F.lit("done"), payload).alias("frame"))
