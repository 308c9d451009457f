"""Strategy ledger: which correction raised a score by how much.

* ``feedback_set`` (A5) / ``resolved_feedback`` (X1): per analysis pair, the
  category feedback that disappeared; ``array_min`` names it deterministically.
* ``ledger_entries`` (E6, F9): before/after analyses joined per item, zero
  deltas dropped, one append-only record each.
* ``strategy_top`` / ``strategy_failed`` (W1, W2): per product type, ranked by
  delta desc with ledger order (``seq``) breaking ties.  ``row_number() <= n``
  is planned as a WindowGroupLimit: each map task keeps its top n per type
  before the shuffle, so a type holding a third of the ledger is reduced
  locally first.
* ``strategy_advice`` (E7, W3, A6): bullet text per requested type; types
  without rows use the global ranking (computed once, attached through a
  scalar subquery -- no cross join).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LEDGER_COLUMNS = ("seq", "strategy", "product_type", "score_before", "score_after", "delta", "ts")


@dataclass(frozen=True)
class AdviceText:
    improved: str = "+ %s, by %d points"
    worsened: str = "- %s, by %d points"
    no_success: str = "(nothing has raised a score so far)"
    no_failure: str = "(nothing to avoid so far)"
    fix_applied: str = "cleared: %s"
    generic: str = "unspecific rewrite"


def feedback_set(analysis: Column) -> Column:
    """Distinct union of the per-category feedback lists of an analysis
    (the overall list is not included, as in the reference)."""
    per_cat = F.transform(F.map_values(analysis["breakdown"]), lambda e: F.coalesce(e["feedback"], F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(per_cat))


def resolved_feedback(before: Column, after: Column, text: AdviceText = AdviceText()) -> Column:
    first = F.array_min(F.array_except(feedback_set(before), feedback_set(after)))
    return F.when(first.isNull(), F.lit(text.generic)).otherwise(F.format_string(text.fix_applied, first))


def ledger_entries_paired(df: DataFrame, key: str, type_col: str, before: str = "before",
                          after: str = "after", at: Column | None = None,
                          text: AdviceText = AdviceText(), keep_zero: bool = False) -> DataFrame:
    """E6 when both analyses of an item are already columns of one row (e.g.
    read back from a table): no join, no shuffle.  delta = after - before
    total; zero deltas are not logged (F9).  Do not stack two ``analyze_html``
    calls in one projection chain to feed it: the optimizer inlines both
    scorers into one method beyond the 64 KB code limit; score the versions
    separately (``ledger_entries`` joins them) or persist the analyses first."""
    sb = F.coalesce(F.col(before)["total_score"], F.lit(0))
    sa = F.coalesce(F.col(after)["total_score"], F.lit(0))
    out = df.select(
        F.col(key), resolved_feedback(F.col(before), F.col(after), text).alias("strategy"),
        F.col(type_col).alias("product_type"), sb.alias("score_before"), sa.alias("score_after"),
        (sa - sb).alias("delta"), (at if at is not None else F.current_timestamp()).alias("ts"))
    return out if keep_zero else out.where(F.col("delta") != 0)


def ledger_entries(before: DataFrame, after: DataFrame, key: str, type_col: str,
                   analysis_col: str = "analysis", at: Column | None = None,
                   text: AdviceText = AdviceText(), keep_zero: bool = False) -> DataFrame:
    """E6 from two frames of analyses: equi-join on ``key``, then as
    ``ledger_entries_paired``."""
    b = before.select(key, type_col, F.col(analysis_col).alias("_b"))
    a = after.select(F.col(key).alias("_ak"), F.col(analysis_col).alias("_a"))
    j = b.join(a, F.col(key) == F.col("_ak"), "inner")
    return ledger_entries_paired(j, key, type_col, "_b", "_a", at, text, keep_zero)


def ledger_entries_versions(df: DataFrame, key: str, type_col: str, before: str, after: str, analyze, at: Column | None = None,
                            text: AdviceText = AdviceText(), keep_zero: bool = False) -> DataFrame:
    """E6 from two versions of a text in one row: both become rows, are scored by
    one pass of ``analyze(df, column)`` (which adds ``analysis``) and meet again
    by ``key`` in one aggregate.  One scan, one exchange; keys are unique."""
    rows = df.select(key, type_col, F.posexplode(F.array(before, after)).alias("_v", "_text"))
    scored = analyze(rows, "_text").select(key, type_col, "_v", "analysis")
    pairs = scored.groupBy(key).agg(F.min(type_col).alias(type_col), F.min_by("analysis", "_v").alias("_b"), F.max_by("analysis", "_v").alias("_a"))
    return ledger_entries_paired(pairs, key, type_col, "_b", "_a", at, text, keep_zero)


def _ranked(ledger: DataFrame, n: int, where: Column | None) -> DataFrame:
    src = ledger if where is None else ledger.where(where)
    w = Window.partitionBy("product_type").orderBy(F.col("delta").desc(), F.col("seq").asc())
    return src.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def strategy_top(ledger: DataFrame, n: int = 3) -> DataFrame:
    """Top n by delta per type, *then* keep improvements (> 0)."""
    return _ranked(ledger, n, None).where(F.col("delta") > 0)


def strategy_failed(ledger: DataFrame, n: int = 3) -> DataFrame:
    """Among non-improvements (<= 0), the first n in the same order
    (the least bad first)."""
    return _ranked(ledger, n, F.col("delta") <= 0)


_ENTRY = ("rank", "seq", "strategy", "delta")


def strategy_entries(ledger: DataFrame, requested_types: DataFrame, n: int = 3,
                     type_col: str = "product_type") -> DataFrame:
    """Per requested type, its own top/failed lists, or the global lists
    when the ledger has no row of that type (``scope`` says which).

    The ledger is read twice, once per ranking.  What the rankings leave, at
    most ``n`` rows per type and list, is stored; all else comes from that: a
    type is known if it has a ranked row, and the first n of all types are
    among the first n of each."""
    ranked = _ranked(ledger, n, None).select("product_type", *_ENTRY, F.lit("top").alias("list"))
    ranked = ranked.unionByName(_ranked(ledger, n, F.col("delta") <= 0).select("product_type", *_ENTRY, F.lit("failed").alias("list")))
    ranked = materialize(ranked, "strategy-ranks")
    shown = (F.col("list") == "failed") | (F.col("delta") > 0)
    entry = F.struct(*_ENTRY)
    own = ranked.groupBy("product_type").agg(*[
        F.collect_list(F.when((F.col("list") == k) & shown, entry)).alias(k) for k in ("top", "failed")])

    def everywhere(kind: str) -> Column:
        """Scalar subquery: the global list as one array of at most n entries."""
        first = ranked.where(F.col("list") == kind).orderBy(F.col("delta").desc(), F.col("seq").asc()).limit(n).where(shown)
        return first.agg(F.collect_list(F.struct(F.lit(0).alias("rank"), "seq", "strategy", "delta"))).scalar()

    req = requested_types.select(F.col(type_col).alias("product_type")).distinct()
    j = req.join(own.withColumn("_known", F.lit(True)), "product_type", "left")
    is_known = F.coalesce(F.col("_known"), F.lit(False))
    return j.select("product_type", F.when(is_known, F.lit("type")).otherwise(F.lit("global")).alias("scope"),
                    *[F.when(is_known, F.col(k)).otherwise(everywhere(k)).alias(k) for k in ("top", "failed")])


def _bullets(entries: Column, fmt: str, default: str) -> Column:
    ordered = F.array_sort(entries, lambda x, y: F.when(x["delta"] > y["delta"], -1)
                           .when(x["delta"] < y["delta"], 1)
                           .when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0))
    lines = F.transform(ordered, lambda e: F.format_string(fmt, e["strategy"], e["delta"]))
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit(default))


def strategy_advice(ledger: DataFrame, requested_types: DataFrame, n: int = 3,
                    text: AdviceText = AdviceText(), type_col: str = "product_type") -> DataFrame:
    """(successful, failed) advice text for every requested type in one pass."""
    e = strategy_entries(ledger, requested_types, n, type_col)
    return e.select("product_type", "scope",
                    _bullets(F.col("top"), text.improved, text.no_success).alias("successful"),
                    _bullets(F.col("failed"), text.worsened, text.no_failure).alias("failed"))


def ledger_union(ledger: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append rows by name; an extra column (e.g. rows_read) is kept, missing ones are null."""
    return ledger.unionByName(new_rows, allowMissingColumns=True)
