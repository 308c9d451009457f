"""Registered checks: merges (J3-J5), review fold and gates (W6, A3, F11),
finalise compositions (E3, E4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import review as R
from ..operators.keys import normalize_keys
from . import sqlfrag as Q
from .standins import (std_items, std_original, std_reviews, std_updates,
                       std_updates_dup, table, with_ctes)

ITEM_COLS = ["item_key", "input_seq", "product_name", "seo_title", "meta_description",
             "html_content", "o_orderstatus"]


def merge_updates_q(spark, d):
    return M.merge_updates(std_original(spark, d), std_updates(spark, d), "doc_key")


def merge_updates_last_q(spark, d):
    return M.merge_updates(std_original(spark, d), std_updates_dup(spark, d), "doc_key",
                           duplicates="last", order="upd_pos")


def merge_first_match_q(spark, d):
    return M.merge_first_match(std_original(spark, d), std_updates_dup(spark, d), "doc_key",
                               order="orig_seq", update_order="upd_pos", columns=["lang", "title"])


def rejected_rows_q(spark, d):
    rejected = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc_key"))
    return M.rejected_rows(std_original(spark, d), rejected, "doc_key")


def review_latest_q(spark, d):
    latest = R.latest_reviews(std_reviews(spark, d), "item_key")
    return latest.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


def reviews_with_reload(spark, d):
    """All reviews, and a draft that was reloaded at the middle one: items of two
    users in three, so some reviewed items are gone and some start anew."""
    r = std_reviews(spark, d)
    half = r.agg(F.floor(F.max("seq") / 2)).scalar()
    seq = r.where(F.col("seq") <= half).agg(F.max("seq")).scalar()
    ts = r.where(F.col("seq") == seq).agg(F.max("ts")).scalar()
    draft = r.where(F.col("item_key").cast("bigint") % 3 != 0).select("item_key").distinct().select(
        "item_key", F.concat(F.lit("draft "), F.col("item_key")).alias("seo_title"), F.lit(None).cast("string").alias("meta_description"),
        F.lit("<p>draft</p>").alias("html_content"))
    return r.withColumn("kind", F.lit("review")).unionByName(R.reload_events(draft, {"seq": seq, "ts": ts}))


def review_reload_q(spark, d):
    latest = R.latest_after_reloads(reviews_with_reload(spark, d), "item_key")
    return latest.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


def review_gates_q(spark, d):
    return R.review_gates(R.latest_reviews(std_reviews(spark, d), "item_key", columns=("status",)))


def review_split_q(spark, d):
    latest = R.latest_reviews(std_reviews(spark, d), "item_key", columns=("status", "seq"))
    return R.review_split(latest, "approved").unionByName(R.review_split(latest, "disapproved")) \
        .select("item_key", "status", "seq")


def _items(spark, d):
    return normalize_keys(std_items(spark, d), "item_key")


def finalize_approved_q(spark, d):
    return R.finalize_approved(_items(spark, d), std_reviews(spark, d), "item_key").select(*ITEM_COLS)


def finalize_rejected_q(spark, d):
    """Rejected rows written as a sheet of their kind and reread."""
    from ..session import scratch_path
    from ..sinks.files import write_sheet
    out = R.finalize_rejected(_items(spark, d), std_reviews(spark, d), "item_key").select(*ITEM_COLS)
    path = write_sheet(out, scratch_path(spark, "sheets"), "rejected", "r1")
    return spark.read.parquet(path) if path else out.limit(0)


QUERIES = {
    "merge_updates": merge_updates_q,
    "merge_updates_last": merge_updates_last_q,
    "merge_first_match": merge_first_match_q,
    "rejected_rows": rejected_rows_q,
    "review_latest": review_latest_q,
    "review_reload": review_reload_q,
    "review_gates": review_gates_q,
    "review_split": review_split_q,
    "finalize_approved": finalize_approved_q,
    "finalize_rejected": finalize_rejected_q,
}

_LATEST = """latest AS (SELECT * FROM std_reviews
  QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY ts DESC, seq DESC) = 1)"""
_NI = f"""ni AS (SELECT {Q.norm_key('item_key')} AS item_key, input_seq, product_name, seo_title,
  meta_description, html_content, o_orderstatus FROM std_items)"""

ORACLE = {
    "merge_updates": with_ctes("""
SELECT o.doc_key, o.orig_seq, coalesce(u.lang, o.lang) AS lang, o.source,
       coalesce(u.title, o.title) AS title, o.n_chars
FROM std_original o LEFT JOIN std_updates u ON o.doc_key = u.doc_key""", "std_original", "std_updates"),
    "merge_updates_last": with_ctes("""
SELECT o.doc_key, o.orig_seq, coalesce(u.lang, o.lang) AS lang, o.source,
       coalesce(u.title, o.title) AS title, o.n_chars
FROM std_original o LEFT JOIN lastu u ON o.doc_key = u.doc_key""", "std_original", "std_updates", "std_updates_dup",
        ctes="""lastu AS (SELECT * FROM std_updates_dup
  QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY upd_pos DESC) = 1)"""),
    "merge_first_match": with_ctes("""
SELECT o.doc_key, o.orig_seq,
       CASE WHEN o.orig_seq = t.first_seq THEN t.lang ELSE o.lang END AS lang, o.source,
       CASE WHEN o.orig_seq = t.first_seq THEN t.title ELSE o.title END AS title, o.n_chars
FROM std_original o LEFT JOIN t ON o.doc_key = t.doc_key""", "std_original", "std_updates", "std_updates_dup",
        ctes="""lastu AS (SELECT * FROM std_updates_dup
  QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY upd_pos DESC) = 1),
firsts AS (SELECT doc_key, min(orig_seq) AS first_seq FROM std_original GROUP BY doc_key),
t AS (SELECT f.doc_key, f.first_seq, l.lang, l.title FROM firsts f JOIN lastu l ON f.doc_key = l.doc_key)"""),
    "rejected_rows": with_ctes("""
SELECT * FROM std_original
WHERE doc_key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""", "std_original"),
    "review_latest": with_ctes("SELECT * REPLACE (epoch_us(ts) AS ts) FROM latest", "std_reviews", ctes=_LATEST),
    "review_reload": with_ctes("""
SELECT l.* EXCLUDE (review) REPLACE (epoch_us(l.ts) AS ts) FROM (
  SELECT * FROM (SELECT item_key, status, seq, ts, seo_title, meta_description, html_content, 1 AS review FROM std_reviews
                 UNION ALL SELECT DISTINCT item_key, 'pending', rseq, rts, 'draft ' || item_key, NULL, '<p>draft</p>', 0
                 FROM std_reviews, mid WHERE CAST(item_key AS BIGINT) % 3 <> 0)
  QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY ts DESC, seq DESC, review DESC) = 1) l, mid
WHERE l.ts > rts OR (l.ts = rts AND l.seq >= rseq)""", "std_reviews", ctes="""mid AS (
  SELECT ts AS rts, seq AS rseq FROM std_reviews WHERE seq = (
    SELECT max(seq) FROM std_reviews WHERE seq <= (SELECT max(seq) // 2 FROM std_reviews)))"""),
    "review_gates": with_ctes("""
SELECT count(*) AS n_items,
       count(*) FILTER (WHERE status = 'pending') AS n_pending,
       count(*) FILTER (WHERE status = 'approved') AS n_approved,
       count(*) FILTER (WHERE status = 'disapproved') AS n_disapproved,
       count(*) FILTER (WHERE status = 'pending') > 0 AS has_pending,
       count(*) FILTER (WHERE status = 'approved') > 0 AS has_approved,
       count(*) FILTER (WHERE status = 'disapproved') > 0 AS has_disapproved,
       count(*) FILTER (WHERE status = 'pending') = 0 AND count(*) FILTER (WHERE status = 'approved') > 0 AS can_finalize,
       count(*) > 0 AS show_review_panel,
       count(*) FILTER (WHERE status = 'disapproved') > 0 AS show_disapproved_panel
FROM latest""", "std_reviews", ctes=_LATEST),
    "review_split": with_ctes("""
SELECT item_key, status, seq FROM latest WHERE status IN ('approved', 'disapproved')""",
                              "std_reviews", ctes=_LATEST),
    "finalize_approved": with_ctes("""
SELECT ni.item_key, ni.input_seq, ni.product_name,
       coalesce(a.seo_title, ni.seo_title) AS seo_title,
       coalesce(a.meta_description, ni.meta_description) AS meta_description,
       coalesce(a.html_content, ni.html_content) AS html_content, ni.o_orderstatus
FROM ni LEFT JOIN (SELECT * FROM latest WHERE status = 'approved') a ON ni.item_key = a.item_key
WHERE ni.item_key IS NOT NULL""", "std_items", "std_reviews", ctes=_LATEST + ", " + _NI),
    "finalize_rejected": with_ctes("""
SELECT ni.* FROM ni
WHERE ni.item_key IS NOT NULL
  AND ni.item_key IN (SELECT item_key FROM latest WHERE status = 'disapproved')""",
                                   "std_items", "std_reviews", ctes=_LATEST + ", " + _NI),
}


def merge_updates_empty_string_q(spark, d):
    """J4 on the rows whose update value is '' (it must replace, unlike null)."""
    m = M.merge_updates(std_original(spark, d), std_updates(spark, d), "doc_key")
    empties = std_updates(spark, d).where(F.col("lang") == "").select(F.col("doc_key").alias("_k"))
    return m.join(empties, F.col("doc_key") == F.col("_k"), "left_semi").select("doc_key", "orig_seq", "lang")


def write_draft_q(spark, d):
    """K1: the finalised sheet written under kind=approved/run_id=... and read back."""
    from ..session import scratch_path
    from ..sinks.files import write_sheet
    out = write_sheet(finalize_approved_q(spark, d), scratch_path(spark, "sheets"), "approved", "r1")
    return spark.read.parquet(out)


QUERIES["merge_updates_empty_string"] = merge_updates_empty_string_q
QUERIES["write_draft"] = write_draft_q
ORACLE["merge_updates_empty_string"] = with_ctes("""
SELECT o.doc_key, o.orig_seq, coalesce(u.lang, o.lang) AS lang
FROM std_original o JOIN std_updates u ON o.doc_key = u.doc_key WHERE u.lang = ''""", "std_original", "std_updates")
ORACLE["write_draft"] = ORACLE["finalize_approved"]
