"""Connected components of large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _smallest(sides: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the least of u's v and u itself; a partial
    aggregate and a join that AQE splits, so a hub is never one task's group."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return sides.join(least, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Links -> (node, component), component being the least node reachable.

    Alternates large-star and small-star steps until the link table no longer
    changes.  Each round is written to the shared folder; the driver sees a
    count and a checksum.  Self links, repeats and nulls change nothing (a null
    end is dropped); nodes without a link are not listed.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = materialize(e, "links"), None
    for _ in range(max_rounds):
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v")
        s = _smallest(large)
        small = s.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = materialize(small.where("u > v").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    # a star forest: every node but the centres stands on the left once
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
