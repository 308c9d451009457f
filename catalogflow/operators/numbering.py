"""Row numbers without a global window.

The rows are dealt over the cluster by ranges of their order, stored once,
counted per range, and numbered inside each range; a range starts at the sum of
the counts before it.  What meets in one place is one count per range, never
the rows of a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def number_rows(df: DataFrame, order: list[Column], group: tuple[str, ...] = (), out: str = "position",
                total: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """``out``: 0-based position of every row in ``order`` within its ``group``
    (the whole table without one); ``total``: the group's number of rows;
    ``sums``: {new column: column of numbers} gives the sum over the rows before
    this one, and under the name ``<new column>_total`` the group's.

    Nulls in ``group`` are a group of their own.  Rows that ``order`` does not
    tell apart get consecutive numbers in no particular order.  The input is
    evaluated once and stored under the shared checkpoint folder, so numbers do
    not move when a lost executor's work is repeated."""
    by, sums = list(group), sums or {}
    rng, at, n, before = "_cf_range", "_cf_at", "_cf_rows", "_cf_before"
    stored = materialize(df.repartitionByRange(*[F.col(f"`{c}`") for c in by], *order).withColumn(rng, F.spark_partition_id()), "numbered")
    counts = stored.groupBy(rng, *by).agg(F.count(F.lit(1)).alias(n), *[F.sum(c).alias(f"_cf_{o}") for o, c in sums.items()])
    # one row per (range, group): the window orders ranges, not rows
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = window.orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    counts = counts.select(
        rng, *by, F.coalesce(F.sum(n).over(upto), zero).alias(before), *([F.sum(n).over(window).alias(total)] if total else []),
        *[F.coalesce(F.sum(f"_cf_{o}").over(upto), zero).alias(f"_before_{o}") for o in sums],
        *[F.coalesce(F.sum(f"_cf_{o}").over(window), zero).alias(f"{o}_total") for o in sums])
    inside = Window.partitionBy(rng, *by).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn(at, F.row_number().over(inside) - 1)
    for o, c in sums.items():
        local = local.withColumn(o, F.coalesce(F.sum(c).over(earlier), zero))
    j = local.join(counts, _same(local, counts, [rng, *by]))
    return j.select(*[local[c] for c in df.columns], *([counts[total]] if total else []),
                    (local[at] + counts[before]).cast("long").alias(out),
                    *[(local[o] + counts[f"_before_{o}"]).alias(o) for o in sums], *[counts[f"{o}_total"] for o in sums])
