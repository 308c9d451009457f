"""S3 JSON request payloads and J6 positional pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_request_rows(df: DataFrame, payload: str, element: str = "string",
                      id_cols=(), cast: str | None = "bigint") -> DataFrame:
    """Array payload -> one row per element with its position; ``cast``
    converts each element (``int()`` of every SKU)."""
    arr = F.from_json(F.col(payload), f"array<{element}>")
    ids = list(id_cols)
    out = df.select(*ids, F.posexplode(arr).alias("pos", "value"))
    return out.withColumn("value", F.col("value").cast(cast)) if cast else out


def positional_pairs(df: DataFrame, left: str, right: str, id_cols=(), strict: bool = True) -> DataFrame:
    """I-th element of ``left`` with the i-th of ``right`` (arrays in the
    same row).  ``strict``: raise when any row's lengths differ."""
    if strict:
        bad = df.where(F.size(left) != F.size(right)).limit(1).count()
        if bad:
            raise ValueError("request lists differ in length")
    ids = list(id_cols)
    z = df.select(*ids, F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("pos", "p"))
    return z.select(*ids, "pos", F.col("p.l").alias(left), F.col("p.r").alias(right))
