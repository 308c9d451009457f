"""Temporal URL lists: every capture against the entries active when it was fetched.

Dated entries (add or remove a domain on a list) become validity intervals;
captures find the intervals of their host and its parent domains by an as-of
join.  Native.  What could be large is reduced first: entries to one state per
(list, domain, day), so a much-listed domain has at most one row per day;
captures to distinct (host, day).  Intervals are dealt to time buckets, so the
join is an equi-join on (domain, bucket) with a range condition and a host
with a third of all captures spreads over its buckets and days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without trailing dots; null where the URL has none."""
    h = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(h != "", h)


def day_of(time: Column) -> Column:
    """Days since 1970 of a time in epoch seconds."""
    return F.floor(time / DAY)


def suffixes(host: Column) -> Column:
    """The host and its parent domains: array of (domain, labels)."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("domain"), (F.size(parts) - i + 1).alias("labels")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, allow, domain, action, day) -> list, allow, domain, day_from, day_to.

    An entry holds from its day until the next entry of its (list, domain);
    day_to is null while there is none.  Of entries on one day 'add' wins, and
    an allowing one among those.  Entries without list, domain, day or with
    another action are left out; repeated entries change nothing.
    """
    e = entries.where("list is not null and domain is not null and day is not null and action in ('add', 'remove')")
    daily = e.groupBy("list", F.lower("domain").alias("domain"), "day").agg(
        F.max(F.col("action") == "add").alias("listed"),
        F.max(F.coalesce(F.col("allow"), F.lit(False)) & (F.col("action") == "add")).alias("allow"))
    after = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return daily.withColumn("day_to", after).where("listed").select("list", "allow", "domain", F.col("day").alias("day_from"), "day_to")


def evaluate(captures: DataFrame, intervals: DataFrame, url: str = "url", time: str = "fetch_time",
             bucket_days: int = 64) -> DataFrame:
    """Every capture with host, fetch_day, n_active (entries that hold for it),
    list and domain of the deciding entry, and blocked.

    The deciding entry is the one with the most labels, an allowing one among
    those, then the first by list name.  Captures without host or time have no
    active entry and are not blocked.  An empty list or table is no special
    case.  The five added columns replace captures' own columns of those names.
    """
    own = [c for c in captures.columns if c.lower() not in ("host", "fetch_day", "n_active", "matched_list", "matched_domain", "blocked")]
    c = captures.select(*[F.col(f"`{x}`") for x in own], host_of(F.col(f"`{url}`")).alias("host"),
                        day_of(F.col(f"`{time}`")).alias("fetch_day"))
    usable = F.col("host").isNotNull() & F.col("fetch_day").isNotNull()
    asked = c.where(usable).select("host", "fetch_day").distinct()
    last = asked.agg(F.max("fetch_day").alias("d")).first()["d"]
    ends = F.least(F.coalesce(F.col("day_to") - 1, F.lit(last)), F.lit(last)).cast("long")
    first, final = F.floor(F.col("day_from") / bucket_days), F.floor(ends / bucket_days)
    dealt = intervals.where(ends >= F.col("day_from")).withColumn("bucket", F.explode(F.sequence(first, final)))
    q = asked.withColumn("s", F.explode(suffixes(F.col("host")))).select(
        "host", "fetch_day", F.col("s.domain").alias("domain"), F.col("s.labels").alias("labels"),
        F.floor(F.col("fetch_day") / bucket_days).alias("bucket"))
    hit = q.join(dealt, ["domain", "bucket"]).where("day_from <= fetch_day and (day_to is null or fetch_day < day_to)")
    verdict = hit.groupBy("host", "fetch_day").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.min(F.struct((-F.col("labels")).alias("k"), (~F.col("allow")).alias("block"), "list", "domain")).alias("best"))
    verdict = verdict.select("host", "fetch_day", "n_active", F.col("best.list").alias("matched_list"),
                             F.col("best.domain").alias("matched_domain"), F.col("best.block").alias("blocked"))
    # captures without a key take no part in the join, so they cannot meet in one task
    found = c.where(usable).join(verdict, ["host", "fetch_day"], "left")
    none = c.where(~usable).select("*", F.lit(None).cast("long").alias("n_active"), F.lit(None).cast("string").alias("matched_list"),
                                   F.lit(None).cast("string").alias("matched_domain"), F.lit(None).cast("boolean").alias("blocked"))
    out = found.unionByName(none)
    return out.withColumn("n_active", F.coalesce("n_active", F.lit(0).cast("long"))).withColumn(
        "blocked", F.coalesce("blocked", F.lit(False)))
