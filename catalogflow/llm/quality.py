"""Robust multivariate outliers among document statistics (native).

``base_statistics`` counts words, symbols, repeated lines and repeated word
windows of whole texts with built-in functions.  ``mcd_outliers`` fits a
minimum-covariance-determinant location and scatter per (language, source) and
rejects rows whose squared Mahalanobis distance is too large.

The estimate is computed for all groups at once.  Statistic vectors are
transformed, rounded to fixed-point integers and stored once; every
concentration step is then one aggregation of that small table by
(group, start, distance bucket): the partial sums meet map-side, so a group
with a third of all rows costs one row per task and bucket.  The running sum
over the (bounded number of) buckets gives the h-subset's count, mean and
scatter.  All sums are over integers, so reruns agree bit for bit.

Groups with too few rows use the estimate of their language, and languages
with too few rows the estimate of all rows; null languages and sources are
groups of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, words_of

# ---------------------------------------------------------------- statistics

SYMBOLS = "[^#*$%&|<>]+"


def base_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` plus n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (long) of every whole text.

    Null, empty and blank texts have zero everywhere.  A line counts as repeated
    if it holds a word and equals an earlier line; a word counts as repeated if
    it lies in a window of three words that occurs twice or more in the text.
    Windows are found by sorting one integer per window (the window's hash,
    rounded to a multiple of the word count, plus its position); equal
    neighbours are then compared as strings, so hash collisions change nothing.
    """
    has_word = r"[^\x20\x09-\x0D]"
    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(
        *[f"`{c}`" for c in keep], words_of(F.col("_t")).alias("_w"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(has_word)).alias("_l"))
    d = d.select(
        *[f"`{c}`" for c in keep], "n_symbols", "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    # bits that hold a position; the rest of the integer holds the hash
    d = d.withColumn("_b", F.ceil(F.log2(F.greatest(F.col("n_words"), F.lit(2)).cast("double"))).cast("int"))
    d = d.withColumn("_m", F.expr("shiftleft(1L, _b)"))
    d = d.withColumn("_s", F.when(F.col("n_words") >= 4, F.sort_array(F.expr(
        "transform(sequence(0, int(n_words) - 3), i -> "
        "(shiftright(xxhash64(_w[i], _w[i + 1], _w[i + 2]), 1) div _m) * _m + i)"))))
    d = d.withColumn("_e", F.when(F.col("n_words") >= 4, F.expr(
        "filter(sequence(0, int(n_words) - 4), j -> shiftrightunsigned(_s[j] ^ _s[j + 1], _b) = 0L)")))
    d = d.withColumn("_c", F.when(F.size("_e") > 0, F.expr(
        "sort_array(transform(array_distinct(flatten(transform(_e, j -> array(j, j + 1)))), j -> "
        "named_struct('g', concat_ws(' ', _w[int(pmod(_s[j], _m))], _w[int(pmod(_s[j], _m)) + 1], "
        "_w[int(pmod(_s[j], _m)) + 2]), 'p', int(pmod(_s[j], _m)))))")))
    d = d.withColumn("_r", F.when(F.size("_c") > 1, F.expr(
        "sort_array(array_distinct(flatten(transform(filter(sequence(0, size(_c) - 2), "
        "j -> _c[j].g = _c[j + 1].g), j -> array(_c[j].p, _c[j + 1].p)))))")))
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(
        "aggregate(_r, named_struct('n', 0L, 'last', -3), (a, p) -> "
        "named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)"), F.lit(0).cast("long"))).drop(
        "_w", "_b", "_m", "_s", "_e", "_c", "_r")


def base_failed() -> Column:
    """Too short, or more than half of the words repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# ----------------------------------------------- minimum covariance determinant

UNIT = 1024          # fixed-point steps per unit of a transformed statistic
P = 4                # dimensions
SALTS = 32           # parts in which a group's rows may meet its parameters
ALPHA = 0.75         # share of a group's rows in the h-subset
# Chi-square values for four degrees of freedom (fixed values): consistency of
# the 75 % subset, the 97.5 % reweighting limit and its consistency factor, and
# the rejection limit, which a clean row exceeds once in 10,000.
SUBSET_FACTOR, WEIGHT_LIMIT, WEIGHT_FACTOR, REJECT_LIMIT = 1.486, 11.143, 1.0646, 23.51
# Smallest spread of each transformed statistic.  Most clean texts have no
# symbol and no repeated line at all; without a floor their scatter is singular.
FLOORS = (0.08, 0.15, 0.06, 0.25)
TRI = [(i, j) for i in range(P) for j in range(i + 1)]


def transformed() -> list[Column]:
    """Log mean word length, root symbol rate, root repeated-line rate and
    arcsine-root share of repeated words, in fixed point.  Length itself is no
    coordinate: a long text is not an outlier for being long."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = F.least(F.col("n_repeat_words") / n, F.lit(1.0))
    xs = [F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))), F.sqrt(F.col("n_symbols") / n),
          F.sqrt(F.col("n_dup_lines") / n), F.asin(F.sqrt(share))]
    return [F.round(F.least(x, F.lit(8.0)) * UNIT).cast("long").alias(f"z{i}") for i, x in enumerate(xs)]


def _key(level: int, *parts: Column) -> Column:
    """One unambiguous string per group; null is a group of its own."""
    said = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.concat(F.lit(f"{level}|"), *said) if said else F.lit(f"{level}|")


def _solved(moments: DataFrame, factor: float) -> DataFrame:
    """group, start, n -> mean m*, rows of the inverse Cholesky factor q*, log determinant."""
    d = moments.select("gid", "start", "rows_all", *[(F.col(f"s{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(P)],
                       *[(F.col(f"s{i}{j}") / F.col("n") / (UNIT * UNIT)).alias(f"c{i}{j}") for i, j in TRI])
    d = d.select("gid", "start", "rows_all", *[f"m{i}" for i in range(P)], *[
        (F.greatest(F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0) if i == j else F.lit(-1e300)) * factor
         + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in TRI])
    return _factored(d)


def _factored(d: DataFrame) -> DataFrame:
    """c* (lower triangle) -> q* with q q' = inverse, plus the log determinant."""
    for i in range(P):  # Cholesky, one column a row at a time so that nothing is inlined twice
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(P):  # inverse of the factor
        for j in range(i + 1):
            if i == j:
                d = d.withColumn(f"q{i}{j}", 1.0 / F.col(f"l{i}{i}"))
            else:
                dot = reduce(lambda a, k: a + F.col(f"l{i}{k}") * F.col(f"q{k}{j}"), range(j, i), F.lit(0.0))
                d = d.withColumn(f"q{i}{j}", -dot / F.col(f"l{i}{i}"))
    logdet = reduce(lambda a, i: a + 2.0 * F.log(F.col(f"l{i}{i}")), range(P), F.lit(0.0))
    return d.select("gid", "start", "rows_all", *[f"m{i}" for i in range(P)],
                    *[f"q{i}{j}" for i, j in TRI], logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of z* from m* under q*."""
    x = [F.col(f"z{i}") / F.lit(float(UNIT)) - F.col(f"m{i}") for i in range(P)]
    ys = [reduce(lambda a, j: a + F.col(f"q{i}{j}") * x[j], range(i + 1), F.lit(0.0)) for i in range(P)]
    return reduce(lambda a, y: a + y * y, ys, F.lit(0.0))


def _bucket(d2: Column) -> Column:
    """Sixteen steps per doubling; at most some 700 values."""
    return F.floor(F.log2(d2 + F.lit(2.0 ** -10)) * 16).cast("int")


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(P)],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}{j}") for i, j in TRI])


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in TRI]]]


def _met(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with their group's parameters.  Where the parameters are too many to
    broadcast, a group's rows are dealt by salt, so that the group of all rows is
    no task of its own; what follows aggregates before it shuffles."""
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["gid", "salt"]).drop("salt")


def _concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One C-step: moments of the ALPHA share of rows nearest to the estimate."""
    by = _moments(_met(rows, params).withColumn("bucket", _bucket(_distance())), "gid", "start", "bucket")
    w = Window.partitionBy("gid", "start")
    run = by.withColumn("rows_all", F.sum("n").over(w)).withColumn(
        "before", F.coalesce(F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return run.where(F.col("before") < F.ceil(F.col("rows_all") * ALPHA)).groupBy("gid", "start", "rows_all").agg(*_sums())


def mcd_outliers(stats: DataFrame, language: str = "lang", source: str = "source",
                 steps: int = 4, min_rows: int = 200, limit: float = REJECT_LIMIT) -> DataFrame:
    """Adds base_failed, mahalanobis2 (double; null where nothing was fitted or
    the base rules failed) and kept to the output of ``base_statistics``.

    The estimate starts from two places, the coordinate-wise medians with
    quartile spreads and the plain mean and covariance, concentrates each for
    ``steps`` C-steps, keeps the one with the smaller determinant and reweights
    it once.  Rows that fail the base rules take no part.  Tables in which no
    level has ``min_rows`` rows reject by the base rules alone; an empty table
    gives an empty result; repeated rows are judged alike.
    """
    v = stats.withColumn("base_failed", base_failed())
    v = materialize(v.select("*", *transformed(), _key(1, F.col(f"`{language}`"), F.col(f"`{source}`")).alias("gid1"),
                             _key(2, F.col(f"`{language}`")).alias("gid2")), "mcd-vectors")
    fit = v.where(~F.col("base_failed")).select(
        F.explode(F.array("gid1", "gid2", _key(3))).alias("gid"), *[f"z{i}" for i in range(P)],
        (F.rand(1) * SALTS).cast("int").alias("salt"))
    plain = _solved(_moments(fit, "gid").withColumn("rows_all", F.col("n")).withColumn("start", F.lit(0)), 1.0)
    quart = fit.groupBy("gid").agg(F.count(F.lit(1)).alias("rows_all"), *[
        F.percentile(f"z{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(P)])
    spread = _factored(quart.select("gid", F.lit(1).alias("start"), "rows_all",
                                    *[(F.col(f"p{i}")[1] / UNIT).alias(f"m{i}") for i in range(P)], *[
        (F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / (UNIT * 1.349), F.lit(FLOORS[i])) ** 2 if i == j
         else F.lit(0.0)).alias(f"c{i}{j}") for i, j in TRI]))
    # rebalanced into few files, so that Spark sees the table's real size and may broadcast it
    params = materialize(plain.unionByName(spread).hint("rebalance"), "mcd-start")
    for k in range(steps):
        params = materialize(_solved(_concentrated(fit, params), SUBSET_FACTOR).hint("rebalance"), f"mcd-step{k}")
    best = params.groupBy("gid").agg(F.min_by(F.struct("*"), F.struct("logdet", "start")).alias("b")).select("b.*")
    near = _met(fit, best).where(_distance() <= WEIGHT_LIMIT)
    last = _solved(_moments(near, "gid").join(best.select("gid", "start", "rows_all"), "gid"), WEIGHT_FACTOR)
    last = materialize(last.where(F.col("rows_all") >= min_rows).drop("start", "logdet").hint("rebalance"), "mcd-final")
    named = [c for c in last.columns if c not in ("gid", "rows_all")]

    def at(level: int) -> DataFrame:
        return last.select(F.col("gid").alias(f"gid{level}"), F.struct(*named).alias(f"e{level}"))

    groups = v.groupBy("gid1", "gid2").agg(F.count(F.lit(1)).alias("n")).withColumn("gid3", _key(3))
    for level in (1, 2, 3):
        groups = groups.join(at(level), f"gid{level}", "left")
    chosen = materialize(groups.select("gid1", F.coalesce("e1", "e2", "e3").alias("e")).select("gid1", "e.*").hint("rebalance"), "mcd-chosen")
    out = v.join(chosen, "gid1").withColumn("mahalanobis2", F.when(~F.col("base_failed"), _distance()))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("mahalanobis2") <= limit, F.lit(True))).select(
        *stats.columns, "base_failed", "mahalanobis2", "kept")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "mahalanobis2", "kept")


def quality_outliers(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                     language: str = "lang", source: str = "source") -> DataFrame:
    """Statistics and verdict for every document (``keep`` columns carried along).

    Language and source are carried under fresh names, so ``keep`` may hold them.
    Kept columns that are named like a result are replaced by it."""
    keep = tuple(c for c in keep if c.lower() not in RESULTS)
    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{language}`").alias("_lang"),
                    F.col(f"`{source}`").alias("_source"), F.col(f"`{text}`").alias("_text"))
    stats = base_statistics(d, "_text", (*keep, "_lang", "_source"))
    return mcd_outliers(stats, "_lang", "_source").drop("_lang", "_source")
