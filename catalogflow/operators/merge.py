"""Merges of reviewed values back into the original sheet.

* ``merge_updates`` (J4) - update-preserve: for every column present in both
  frames a non-null update value replaces the original, a null keeps it, ''
  does replace; update-only keys/columns are ignored; every duplicate original
  key is updated; duplicate update keys are an error (or ``duplicates='last'``).
* ``merge_first_match`` (J5) - per key the *last* update overwrites only the
  *first* original row (nulls included).
* ``rejected_rows`` (J3) - original rows whose key is in a rejected set.

All three are single equi-joins on the key (left / left-semi).  The update
side has at most one row per key, so no join fans out; a hot original key is
split by AQE's skew handling of the streamed side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _key_text(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.col(key).cast("string"))


def unique_per_key(df: DataFrame, key: str) -> DataFrame:
    """The rows, one per key; a key that repeats fails the job that reads them
    (the check is part of the plan, so nothing runs twice)."""
    others = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*[F.col(c) for c in others])).alias("_row"))
    message = F.concat(F.lit("duplicate update keys: "), F.coalesce(F.col(key), F.lit("null")))
    checked = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(key))
    return one.select(checked.alias(key), *[F.col("_row." + c).alias(c) for c in others])


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (partial aggregate)."""
    others = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_last")
    return df.groupBy(key).agg(last).select(key, *[F.col("_last." + c).alias(c) for c in others])


def merge_updates(original: DataFrame, updates: DataFrame, key: str, columns=None,
                  duplicates: str = "error", order: str | None = None) -> DataFrame:
    """Update-preserve merge; the key column comes first, other columns keep
    their original order (row order is carried by the caller's sequence column)."""
    original = _key_text(original, key)
    updates = _key_text(updates, key)
    shared = [c for c in updates.columns if c != key and c in original.columns]
    if columns is not None:
        shared = [c for c in shared if c in set(columns)]
    if duplicates == "error":
        upd = unique_per_key(updates, key)
    elif duplicates == "unique":  # caller guarantees one row per key
        upd = updates
    elif duplicates == "last":
        if order is None:
            raise ValueError("duplicates='last' needs an order column")
        upd = last_per_key(updates, key, order)
    else:
        raise ValueError(f"unknown duplicates mode {duplicates!r}")
    from .enrich import left_join_spread_nulls
    u = upd.select(F.col(key).alias("_ukey"), *[F.col(c).alias("_u_" + c) for c in shared])
    joined = left_join_spread_nulls(original, u, key, "_ukey")
    out = [F.col(key)]
    for c in original.columns:
        if c == key:
            continue
        out.append(F.coalesce(F.col("_u_" + c), F.col(c)).alias(c) if c in shared else F.col(c))
    return joined.select(*out)


def merge_first_match(original: DataFrame, updates: DataFrame, key: str, order: str,
                      update_order: str, columns) -> DataFrame:
    """First-match overwrite: ``columns`` of the first original row per key
    (smallest ``order``) are replaced by the last update (greatest
    ``update_order``) for that key -- null values included.  The original is
    read twice: key and order only, for the first row per key, then whole."""
    original = _key_text(original, key)
    updates = _key_text(updates, key)
    lastu = last_per_key(updates.select(key, update_order, *columns), key, update_order)
    firsts = original.groupBy(key).agg(F.min(order).alias("_first"))
    target = firsts.join(lastu, key, "inner").select(
        F.col(key).alias("_tkey"), "_first", *[F.col(c).alias("_u_" + c) for c in columns])
    from .enrich import left_join_spread_nulls
    joined = left_join_spread_nulls(original, target, key, "_tkey")
    hit = F.coalesce(F.col(order) == F.col("_first"), F.lit(False))
    out = []
    for c in original.columns:
        out.append(F.when(hit, F.col("_u_" + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
    return joined.select(*out)


def rejected_rows(original: DataFrame, rejected: DataFrame, key: str, rejected_key: str | None = None) -> DataFrame:
    """Original rows (all columns) whose key appears in ``rejected`` (left semi join)."""
    rk = rejected_key or key
    r = rejected.select(F.col(rk).cast("string").alias("_rk"))
    return original.join(r, F.col(key).cast("string") == F.col("_rk"), "left_semi")
