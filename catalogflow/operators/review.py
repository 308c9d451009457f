"""Review state: latest state per key (W6), roll-up gates (A3), status
split (F11) and the finalise operators (E3 approve, E4 reject export).

Review *events* (key, status, order, edited content) are folded with
``max_by`` -- a partial aggregate, so one key with millions of events is
pre-reduced in every map task before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import merge_updates, rejected_rows

STATUSES = ("pending", "approved", "disapproved")


def latest_reviews(events: DataFrame, key: str = "item_key", order=("ts", "seq"), columns=None) -> DataFrame:
    """Last event per key by ``order`` (a tuple of columns compared left to right).

    ``columns`` limits what is carried through the aggregate: fields inside
    the ``max_by`` struct are not pruned by the optimizer, so callers that
    need only the status should say so (the scan then skips the content)."""
    if columns is not None:
        events = events.select(key, *dict.fromkeys([*columns, *order]))
    others = [c for c in events.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order])
    last = F.max_by(F.struct(*[F.col(c) for c in others]), ordering).alias("_last")
    return events.groupBy(key).agg(last).select(key, *[F.col("_last." + c).alias(c) for c in others])


def review_gates(latest: DataFrame, run_col: str | None = None) -> DataFrame:
    """Finalise/panel gates: any pending / approved / disapproved,
    ``can_finalize = not pending and approved``, panel shown when any item."""
    keys = [run_col] if run_col else []
    agg = [
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("status") == "pending").alias("n_pending"),
        F.count_if(F.col("status") == "approved").alias("n_approved"),
        F.count_if(F.col("status") == "disapproved").alias("n_disapproved"),
    ]
    g = latest.groupBy(*keys).agg(*agg)
    return (g.withColumn("has_pending", F.col("n_pending") > 0)
             .withColumn("has_approved", F.col("n_approved") > 0)
             .withColumn("has_disapproved", F.col("n_disapproved") > 0)
             .withColumn("can_finalize", (F.col("n_pending") == 0) & (F.col("n_approved") > 0))
             .withColumn("show_review_panel", F.col("n_items") > 0)
             .withColumn("show_disapproved_panel", F.col("n_disapproved") > 0))


def review_split(latest: DataFrame, status: str) -> DataFrame:
    return latest.where(F.col("status") == status)


def reset_pending(draft: DataFrame) -> DataFrame:
    """The rows of a re-read draft, all `pending`."""
    return draft.withColumn("status", F.lit("pending"))


KIND, RELOADED = "kind", "reloaded_at"   # "review" sorts behind "reload"


def reload_events(draft: DataFrame, at: dict[str, Column]) -> DataFrame:
    """S7 as events: one `pending` row per item of a re-read draft, all with the
    reload's place in the order (``at``: order column -> value).  What was said
    before the reload counts no more; items that the draft lacks are gone."""
    return reset_pending(draft).withColumns(at).withColumn(KIND, F.lit("reload"))


def fold(events: DataFrame, key: str = "item_key", order=("ts", "seq"), columns=None) -> DataFrame:
    """W6/ST6 with reloads: a key's last event with its ``kind`` and, as
    ``reloaded_at``, the order of its last reload (null without one).  Batch and
    streaming alike; one partial aggregate, no state but a row per key.  Events
    without a ``kind`` are reviews; a review beats a reload of the same order."""
    kind = F.coalesce(F.col(KIND), F.lit("review")) if KIND in events.columns else F.lit("review")
    events = events.withColumn(KIND, kind)
    if columns is not None:
        events = events.select(key, *dict.fromkeys([*columns, *order, KIND]))
    others = [c for c in events.columns if c != key]
    place = F.struct(*[F.col(c) for c in order])
    last = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order], KIND))
    out = events.groupBy(key).agg(last.alias("_last"), F.max(F.when(F.col(KIND) == "reload", place)).alias(RELOADED))
    return out.select(key, *[F.col("_last." + c).alias(c) for c in others], RELOADED)


def live(states: DataFrame, order=("ts", "seq")) -> DataFrame:
    """The folded states that count: those not older than the last reload of any
    key (all of them, if there was none).  The last reload is one value."""
    last = states.agg(F.max(RELOADED)).scalar()
    return states.where(last.isNull() | (F.struct(*[F.col(c) for c in order]) >= last))


def latest_after_reloads(events: DataFrame, key: str = "item_key", order=("ts", "seq"), columns=None) -> DataFrame:
    """The review items after all reloads, one row per key."""
    return live(fold(events, key, order, columns), order).drop(RELOADED, KIND)


def require_rows(df: DataFrame, what: str) -> None:
    """an empty approved / rejected set is an error (``limit(1)``, not a count)."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no {what} item was sent")


def finalize_approved(original: DataFrame, events: DataFrame, key: str = "item_key",
                      columns=("seo_title", "meta_description", "html_content"),
                      order=("ts", "seq"), require: bool = False) -> DataFrame:
    """Approved edits (latest state per key) merged into the original
    with update-preserve semantics; only ``columns`` are taken from reviews.
    ``require=True`` raises when nothing is approved (F12)."""
    approved = review_split(latest_reviews(events, key, order, ("status", *columns)), "approved").select(key, *columns)
    if require:
        require_rows(approved, "approved")
    # latest_reviews yields one row per key: no uniqueness check needed
    return merge_updates(original, approved, key, columns=list(columns), duplicates="unique")


def finalize_rejected(original: DataFrame, events: DataFrame, key: str = "item_key",
                      order=("ts", "seq"), require: bool = False) -> DataFrame:
    """Original rows whose latest review status is `disapproved`."""
    rejected = review_split(latest_reviews(events, key, order, ("status",)), "disapproved").select(key)
    if require:
        require_rows(rejected, "disapproved")
    return rejected_rows(original, rejected, key)
