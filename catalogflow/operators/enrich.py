"""Enrichment: catalog join (J1), validated-link filter (F1), routing
(F2, F4, F5), first-match lookup (J2), document attach (J7), chunk and
route reporting (W4, A2, A7) and progress labels (P7).

Join strategy: equi-joins are left to Catalyst + AQE.  AQE converts a
sort-merge join into a broadcast hash join only from *measured* shuffle
sizes, and splits skewed partitions of the streamed side, so a hot item key
(a third of all items) does not land in one task.  Lookups that need "first
row per key" use an aggregate (``min_by``) with map-side partial combine
instead of a window, so a hot key is pre-reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flag_is, has_text, normalize_key
from .numbering import number_rows

ROUTES = ("no_key", "not_found", "not_validated", "no_link", "empty_text", "ready")


def left_join_spread_nulls(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer equi-join where left rows with a null key -- which never
    match -- are spread over the reducers instead of all hashing to the one
    partition of ``null`` (a third of the rows may have no key / no link).

    Exact: the join is on (coalesce(key, sentinel), key IS NULL) against
    (key, false), so a sentinel can never equal a real key.  The sentinel is a
    hash of the row's content: a recomputed task deals every row to the same
    reducer again."""
    content = F.xxhash64(*[F.col(c) for c in left.columns])
    lk = F.coalesce(F.col(left_key).cast("string"), F.concat(F.lit("\u0000null:"), content.cast("string")))
    l2 = left.withColumn("_jk", lk).withColumn("_jnull", F.col(left_key).isNull())
    r2 = right.withColumn("_rjk", F.col(right_key).cast("string")).withColumn("_rjnull", F.lit(False))
    cond = (F.col("_jk") == F.col("_rjk")) & (F.col("_jnull") == F.col("_rjnull"))
    return l2.join(r2, cond, "left").drop("_jk", "_jnull", "_rjk", "_rjnull")


def prefix_columns(df: DataFrame, prefix: str, keep=()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def enrich_items(items: DataFrame, catalog: DataFrame, item_key: str = "item_key",
                 barcode: str = "barcode", prefix: str = "cat_") -> DataFrame:
    """Left join items to the catalog on normalised keys.

    Duplicate barcodes fan out (one output row per catalog match), as a plain
    equi-join does; catalog columns get ``prefix`` so same-named columns never
    collide.  Null item keys never match.
    """
    cat = prefix_columns(catalog, prefix).withColumn(
        prefix + barcode, normalize_key(F.col(prefix + barcode)))
    left = items.withColumn(item_key, normalize_key(F.col(item_key)))
    return left_join_spread_nulls(left, cat, item_key, prefix + barcode)


def valid_items(enriched: DataFrame, flag_col: str = "cat_link_valid", expected: str = "sim") -> DataFrame:
    """Rows whose validation flag reads ``sim`` after strip + lower."""
    return enriched.where(flag_is(flag_col, expected))


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: the one with the smallest ``order`` (sheet order).

    ``min_by`` over a struct is a partial aggregate, so each map task keeps one
    row per key before the shuffle, whatever the key skew.
    """
    others = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_first")
    return df.groupBy(key).agg(first).select(key, *[F.col("_first." + c).alias(c) for c in others])


def lookup_first(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 order: str, how: str = "inner") -> DataFrame:
    """For each left row, the *first* right row (by ``order``) with the same key;
    left rows without a match are dropped (``how='inner'``) or kept (``'left'``)."""
    first = dedupe_first(right, right_key, order)
    if how == "left":
        return left_join_spread_nulls(left, first.withColumnRenamed(right_key, "_first_key"), left_key,
                                      "_first_key").withColumnRenamed("_first_key", right_key)
    return left.join(first, left[left_key] == first[right_key], how)


def unresolved_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left rows whose key is absent from the lookup (anti join).  Rows
    without a key are unresolved too; they skip the join, so they cannot meet
    in one task."""
    keyed = left.where(F.col(left_key).isNotNull()).join(
        right.select(F.col(right_key).alias("_rk")), F.col(left_key) == F.col("_rk"), "left_anti")
    return keyed.unionByName(left.where(F.col(left_key).isNull()))


def first_document(documents: DataFrame, value, doc_key: str, text_col: str, order: str | None):
    """``value`` of the first document per key: by ``order`` where the table has
    that column, else by text.  Routing and attaching both go by this one."""
    by = order if order and order in documents.columns else text_col
    return documents.groupBy(F.col(doc_key).alias("_doc_key")).agg(F.min_by(value, F.col(by)).alias("_first"))


def attach_documents(df: DataFrame, documents: DataFrame, link_col: str,
                     doc_key: str = "doc_key", text_col: str = "text", order: str | None = "doc_seq") -> DataFrame:
    """Left join each row to its document text by link.

    The first document per key counts (see ``first_document``); the join is an
    equi-join that AQE may broadcast when the measured side is small.
    """
    docs = first_document(documents, F.col(text_col), doc_key, text_col, order).withColumnRenamed("_first", "_doc_text")
    return (left_join_spread_nulls(df, docs, link_col, "_doc_key")
            .drop("_doc_key").withColumnRenamed("_doc_text", "doc_text"))


def document_flags(documents: DataFrame, doc_key: str = "doc_key", text_col: str = "text",
                   order: str | None = "doc_seq") -> DataFrame:
    """One row per document key: does its first document hold text?  Computed
    once per document, so routing joins a flag instead of shipping leaflet
    texts through the item shuffle."""
    flags = first_document(documents, has_text(F.col(text_col)), doc_key, text_col, order)
    return flags.withColumnRenamed("_first", "_has_text")


def route_items(items: DataFrame, catalog: DataFrame, documents: DataFrame,
                item_key: str = "item_key", barcode: str = "barcode",
                link: str = "leaflet_link", flag: str = "link_valid",
                doc_key: str = "doc_key", text_col: str = "text") -> DataFrame:
    """Every input item (x catalog match) with a ``route`` column:

    no_key -> not_found -> not_validated -> no_link -> empty_text -> ready.

    Nothing disappears: routes partition the joined rows, so counts add up.
    Texts are not attached here (see ``attach_documents``)."""
    enriched = enrich_items(items, catalog, item_key, barcode)
    cat_link = "cat_" + link
    flags = document_flags(documents, doc_key, text_col)
    with_doc = left_join_spread_nulls(enriched, flags, cat_link, "_doc_key").drop("_doc_key")
    route = (F.when(F.col(item_key).isNull(), F.lit("no_key"))
               .when(F.col("cat_" + barcode).isNull(), F.lit("not_found"))
               .when(~flag_is("cat_" + flag), F.lit("not_validated"))
               .when(F.nullif(F.col(cat_link), F.lit("")).isNull(), F.lit("no_link"))
               .when(~F.coalesce(F.col("_has_text"), F.lit(False)), F.lit("empty_text"))
               .otherwise(F.lit("ready")))
    return with_doc.withColumn("route", route).drop("_has_text")


def chunk_of(seq_col: str = "input_seq", chunk_size: int = 500):
    return F.floor(F.col(seq_col) / F.lit(chunk_size)).cast("bigint")


def route_counts(routed: DataFrame, seq_col: str = "input_seq", chunk_size: int = 500) -> DataFrame:
    """Rows per (chunk, route)."""
    return (routed.withColumn("chunk_no", chunk_of(seq_col, chunk_size))
                  .groupBy("chunk_no", "route").agg(F.count(F.lit(1)).alias("n_rows")))


def number_items(items: DataFrame, key: str = "item_key", seq_col: str = "input_seq") -> DataFrame:
    """Items with a key, with their place among them: ``item_no`` (0, 1,
    ... in input order, ties by key) and ``item_total``.  Gaps and repeats in
    ``seq_col`` do not matter; rows without a key are dropped first, as they take
    no place.  Counted by ranges of the order, without a global window."""
    return number_rows(items.where(F.col(key).isNotNull()), [F.col(seq_col), F.col(key)], out="item_no", total="item_total")


def chunk_summary(routed: DataFrame, chunk_size: int = 500) -> DataFrame:
    """Per chunk of ``chunk_size`` items (routed from ``number_items``):
    items read, validated rows, ready rows and the running ``processed_count``,
    min(items up to the chunk's end, total)."""
    return (routed.groupBy(chunk_of("item_no", chunk_size).alias("chunk_no"))
            .agg(F.count_distinct("item_no").alias("n_items"),
                 F.count_if(~F.col("route").isin("no_key", "not_found", "not_validated")).alias("n_valid"),
                 F.count_if(F.col("route") == "ready").alias("n_ready"),
                 F.max("item_total").alias("_total"))
            .withColumn("processed_count", F.least((F.col("chunk_no") + 1) * chunk_size, F.col("_total")))
            .drop("_total"))


def progress_label(df: DataFrame, seq_col: str = "input_seq", run_col: str | None = None, key: str | None = None) -> DataFrame:
    """`(i/total)` per row: its place in the order of ``seq_col`` (ties by
    ``key``) among the rows of its run.  With ``key``, rows without one are
    dropped first.  The places are counted by ranges (``number_rows``), so a huge
    run is never sorted in one task."""
    rows = df.where(F.col(key).isNotNull()) if key else df
    order = [F.col(seq_col), *([F.col(key)] if key else [])]
    out = number_rows(rows, order, (run_col,) if run_col else (), "_no", "_total")
    return out.withColumn("progress", F.format_string("(%d/%d)", F.col("_no") + 1, F.col("_total"))).drop("_no", "_total")
