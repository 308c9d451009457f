"""Registered checks: strategy ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyzer as A
from ..operators import ledger as L
from ..session import scratch_path
from ..sources.ledger import read_ledger
from ..sinks.files import append_ledger
from . import sqlfrag as Q
from .checks_html import TOTAL_SQL, feat_cte, scores_cte
from .standin_html import made_html
from .standins import std_ledger, std_requested_types, table, with_ctes

FIX_SPARK = lambda: F.concat(
    F.coalesce(F.col("html"), F.lit("")),
    F.when(F.col("doc_id") % 2 == 0, F.lit("<ul><li>x</li></ul>")).otherwise(F.lit("")),
    F.when(F.col("doc_id") % 3 == 0, F.lit("<h2>Extra</h2>")).otherwise(F.lit("")),
    F.when(F.col("doc_id") % 5 == 4, F.lit("<h1>bad</h1>")).otherwise(F.lit("")))
FIX_SQL = ("coalesce(plain, '') || (CASE WHEN doc_id % 2 = 0 THEN '<ul><li>x</li></ul>' ELSE '' END)"
           " || (CASE WHEN doc_id % 3 = 0 THEN '<h2>Extra</h2>' ELSE '' END)"
           " || (CASE WHEN doc_id % 5 = 4 THEN '<h1>bad</h1>' ELSE '' END)")


def _before_after(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("product_type"))
    h = made_html(spark, d).join(docs, "doc_id")
    before = A.analyze_html(h, "html")
    after = A.analyze_html(h.withColumn("html", FIX_SPARK()), "html")
    return before, after


def ledger_entries_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("product_type"))
    h = made_html(spark, d).join(docs, "doc_id").withColumn("after", FIX_SPARK())
    out = L.ledger_entries_versions(h, "doc_id", "product_type", "html", "after", A.analyze_html, at=F.lit("2024-01-01").cast("timestamp"))
    return out.withColumn("ts", F.unix_micros("ts"))


def feedback_resolved_q(spark, d):
    b, a = _before_after(spark, d)
    e = L.ledger_entries(b, a, "doc_id", "product_type", keep_zero=True)
    return e.select("doc_id", "strategy")


def strategy_top_q(spark, d):
    return L.strategy_top(std_ledger(spark, d), 3).select(
        "product_type", F.col("rank").cast("bigint").alias("rank"), "seq", "strategy", "delta")


def strategy_failed_q(spark, d):
    return L.strategy_failed(std_ledger(spark, d), 3).select(
        "product_type", F.col("rank").cast("bigint").alias("rank"), "seq", "strategy", "delta")


def strategy_fallback_q(spark, d):
    e = L.strategy_entries(std_ledger(spark, d), std_requested_types(spark, d), 3)
    top = e.select("product_type", "scope", F.explode("top").alias("x"))
    return top.select("product_type", "scope", F.col("x.seq").alias("seq"), F.col("x.delta").alias("delta"))


def strategy_text_q(spark, d):
    return L.strategy_advice(std_ledger(spark, d), std_requested_types(spark, d), 3)


def ledger_union_q(spark, d):
    led = std_ledger(spark, d).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    extra = (table(spark, d, "labels")
             .select(F.col("doc_id").alias("seq"), F.lit("manual").alias("strategy"),
                     F.lit("audit").alias("product_type"), F.col("quality").alias("score_before"),
                     F.col("toxic").alias("score_after"), (F.col("toxic") - F.col("quality")).alias("delta"),
                     F.lit(1).alias("rows_read")))
    return L.ledger_union(led, extra)


def ledger_read_q(spark, d):
    """S5 + K6: append the derived ledger twice as JSON lines, add a corrupt
    file, read back tolerant -- every good row twice, the corrupt line kept aside."""
    path = scratch_path(spark, "ledger")
    led = std_ledger(spark, d)
    append_ledger(led, path)
    append_ledger(led, path)
    spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)
    return read_ledger(spark, path).withColumn("ts", F.unix_micros("ts"))


QUERIES = {
    "ledger_entries": ledger_entries_q,
    "feedback_resolved": feedback_resolved_q,
    "strategy_top": strategy_top_q,
    "strategy_failed": strategy_failed_q,
    "strategy_fallback": strategy_fallback_q,
    "strategy_text": strategy_text_q,
    "ledger_union": ledger_union_q,
    "ledger_read": ledger_read_q,
}

_T = L.AdviceText()
_MSG = A.Messages()
_BA = (f"ba AS (SELECT 'made' AS src, m.doc_id AS id, m.plain, d.lang AS product_type FROM made_html m "
       f"JOIN documents d ON m.doc_id = d.doc_id), "
       f"ab AS (SELECT 'made' AS src, m.doc_id AS id, {FIX_SQL} AS plain FROM made_html m), "
       + feat_cte("fb", "ba") + ", " + feat_cte("fa", "ab") + ", " + scores_cte("sb", "fb") + ", "
       + scores_cte("sa", "fa"))


def _fset(alias: str) -> str:
    return (f"CASE WHEN NOT {alias}.valid THEN [{Q.lit(_MSG.invalid)}] ELSE ["
            f"CASE WHEN {alias}.has_h1 THEN {Q.lit(_MSG.h1_forbidden)} WHEN NOT {alias}.has_h2 THEN {Q.lit(_MSG.no_h2)} "
            f"ELSE {Q.lit(_MSG.headings_ok)} END, "
            f"CASE WHEN {alias}.has_list THEN {Q.lit(_MSG.list_ok)} ELSE {Q.lit(_MSG.no_list)} END, "
            f"CASE WHEN {alias}.faq_ok THEN {Q.lit(_MSG.faq_ok)} ELSE {Q.lit(_MSG.faq_missing)} END] END")


_PAIR = ("pair AS (SELECT sb.id AS doc_id, ba.product_type, "
         + TOTAL_SQL.replace("s_", "sb.s_") + " AS score_before, "
         + TOTAL_SQL.replace("s_", "sa.s_") + " AS score_after, "
         + f"list_min(list_filter({_fset('sb')}, lambda x: NOT list_contains({_fset('sa')}, x))) AS gone "
         + "FROM sb JOIN sa ON sb.id = sa.id JOIN ba ON ba.id = sb.id)")
_STRAT = (f"CASE WHEN gone IS NULL THEN {Q.lit(_T.generic)} "
          f"ELSE {Q.lit(_T.fix_applied.split('%s')[0])} || gone || {Q.lit(_T.fix_applied.split('%s')[1])} END")

_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY delta DESC, seq ASC) AS rank
  FROM std_ledger)"""
_RANKED_F = """rankedf AS (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY delta DESC, seq ASC) AS rank
  FROM std_ledger WHERE delta <= 0)"""
_SCOPE = """scope AS (SELECT r.product_type,
    CASE WHEN r.product_type IN (SELECT product_type FROM std_ledger) THEN 'type' ELSE 'global' END AS scope
  FROM std_requested_types r),
gtop AS (SELECT * FROM (SELECT * FROM std_ledger ORDER BY delta DESC, seq ASC LIMIT 3) WHERE delta > 0),
gfail AS (SELECT * FROM std_ledger WHERE delta <= 0 ORDER BY delta DESC, seq ASC LIMIT 3),
tops AS (SELECT s.product_type, s.scope, r.seq, r.strategy, r.delta FROM scope s
           JOIN ranked r ON s.scope = 'type' AND r.product_type = s.product_type AND r.rank <= 3 AND r.delta > 0
         UNION ALL
         SELECT s.product_type, s.scope, g.seq, g.strategy, g.delta FROM scope s JOIN gtop g ON s.scope = 'global'),
fails AS (SELECT s.product_type, s.scope, r.seq, r.strategy, r.delta FROM scope s
           JOIN rankedf r ON s.scope = 'type' AND r.product_type = s.product_type AND r.rank <= 3
          UNION ALL
          SELECT s.product_type, s.scope, g.seq, g.strategy, g.delta FROM scope s JOIN gfail g ON s.scope = 'global')"""


def _bullet_sql(fmt: str) -> str:
    pre, rest = fmt.split("%s")
    mid, post = rest.split("%d")
    return f"{Q.lit(pre)} || strategy || {Q.lit(mid)} || CAST(delta AS VARCHAR) || {Q.lit(post)}"


ORACLE = {
    "ledger_entries": with_ctes(f"""
SELECT doc_id, {_STRAT} AS strategy, product_type, score_before, score_after, score_after - score_before AS delta,
  CAST(1704067200000000 AS BIGINT) AS ts
FROM pair WHERE score_after <> score_before""", "made_html", ctes=_BA + ", " + _PAIR),
    "feedback_resolved": with_ctes(f"SELECT doc_id, {_STRAT} AS strategy FROM pair", "made_html", ctes=_BA + ", " + _PAIR),
    "strategy_top": with_ctes("""
SELECT product_type, rank, seq, strategy, delta FROM ranked WHERE rank <= 3 AND delta > 0""",
                              "std_ledger", ctes=_RANKED),
    "strategy_failed": with_ctes("""
SELECT product_type, rank, seq, strategy, delta FROM rankedf WHERE rank <= 3""", "std_ledger", ctes=_RANKED_F),
    "strategy_fallback": with_ctes("SELECT product_type, scope, seq, delta FROM tops",
                                   "std_ledger", "std_requested_types", ctes=_RANKED + ", " + _RANKED_F + ", " + _SCOPE),
    "strategy_text": with_ctes(f"""
SELECT s.product_type, s.scope,
  coalesce((SELECT string_agg({_bullet_sql(_T.improved)}, chr(10) ORDER BY delta DESC, seq ASC) FROM tops t
            WHERE t.product_type = s.product_type), {Q.lit(_T.no_success)}) AS successful,
  coalesce((SELECT string_agg({_bullet_sql(_T.worsened)}, chr(10) ORDER BY delta DESC, seq ASC) FROM fails f
            WHERE f.product_type = s.product_type), {Q.lit(_T.no_failure)}) AS failed
FROM scope s""", "std_ledger", "std_requested_types", ctes=_RANKED + ", " + _RANKED_F + ", " + _SCOPE),
    "ledger_union": with_ctes("""
SELECT seq, strategy, product_type, score_before, score_after, delta, epoch_us(ts) AS ts, CAST(NULL AS INTEGER) AS rows_read FROM std_ledger
UNION ALL
SELECT doc_id, 'manual', 'audit', quality, toxic, toxic - quality, NULL, 1 FROM labels""", "std_ledger"),
}

# the derived ledger appended twice, read back tolerant (the corrupt line is set aside)
ORACLE["ledger_read"] = with_ctes("""
SELECT seq, strategy, product_type, score_before, score_after, delta, epoch_us(ts) AS ts, CAST(NULL AS INTEGER) AS rows_read
FROM std_ledger, range(2)""", "std_ledger")
