"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogflow.session import checkpoint_dir, materialize, scratch_path  # noqa: F401

# A word, as every operator here counts them: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, wherever ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def fresh_name(base: str, taken) -> str:
    """``base``, or ``base`` with underscores until no column in ``taken`` has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base
