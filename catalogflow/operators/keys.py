"""Header and key hygiene at ingest (P1 trim headers, P2 normalise keys,
P3 required columns, F3 null-key drop)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, normalize_key, strict_int_key


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip every column name (also a UTF-8 BOM left on the first header)."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def require_columns(df: DataFrame, required) -> None:
    """Raise ValueError naming *all* missing required columns (driver-side, schema only)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")


def normalize_keys(df: DataFrame, key: str = "item_key", out: str | None = None,
                   drop_null: bool = True, integer: bool = False) -> DataFrame:
    """Normalise ``key`` in place (or into ``out``) and drop rows whose key is
    null or blank.  ``integer=True`` gives the strict bigint variant."""
    out = out or key
    if integer:
        df = df.withColumn(out, strict_int_key(key))
        return df.where(F.col(out).isNotNull()) if drop_null else df
    # a key is null exactly where its text is blank: the plainer test spares a
    # filter that would normalise every key again, several times
    if drop_null:
        df = df.where(has_text(F.col(key).cast("string")))
    return df.withColumn(out, normalize_key(key))
