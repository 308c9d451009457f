"""Line dedup by a log-template tree (native).

A line's path in the tree is its token count and its first tokens, with tokens
that hold a digit read as a variable.  The rest of the line fills up to eight
slots (one token each in short lines, runs of tokens in long ones).  Within a
leaf, a slot whose most frequent content makes up more than half of the leaf's
lines is constant, any other is a variable field; lines that agree with all
constant slots share the leaf's template if enough of the line is constant,
other lines are templates of their own.  Templates found in many documents are
dropped.

The tree of the classic parser depends on the order of lines; this one is a few
aggregations, each partial before its shuffle, so a line that opens a third of
all documents costs one row per task.  Texts are shuffled once, to meet the list
of their dropped lines; all else moves fixed-size hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialize

WS = r"\x20\x09-\x0D"
#: From a token's first character on only, so that time stays linear in the text.
VARIABLE = rf"(?<![^{WS}])[^{WS}0-9]*+[0-9][^{WS}]*+"
DEPTH, SLOTS = 4, 8


def parsed_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, hash, text) -> a row per line with a token: key, hash, line_no, leaf,
    n (tokens), s0..s7 (hashes of the slots)."""
    masked = F.regexp_replace("text", VARIABLE, "<*>")
    d = docs.where("text is not null").select("key", "hash", F.posexplode(F.split(masked, "\n")).alias("line_no", "line"))
    d = d.withColumn("line", F.trim("line", F.lit(" \t\x0b\x0c\r"))).where("line <> ''")
    d = d.withColumn("tokens", F.split("line", rf"[{WS}]+")).withColumn("n", F.size("tokens"))
    d = d.withColumn("rest", F.slice("tokens", depth + 1, F.greatest(F.col("n") - depth, F.lit(0))))
    size = F.size("rest")

    def slot(g: int) -> Column:
        start = F.floor(size * g / SLOTS).cast("int")
        return F.hash(F.slice("rest", start + 1, F.floor(size * (g + 1) / SLOTS).cast("int") - start)).alias(f"s{g}")

    return d.select("key", "hash", "line_no", F.xxhash64("n", F.slice("tokens", 1, depth)).alias("leaf"), "n",
                    *[slot(g) for g in range(SLOTS)])


def recurring_lines(docs: DataFrame, min_docs: int = 5, depth: int = DEPTH, similarity: float = 0.6,
                    keep_first: bool = True) -> DataFrame:
    """(key, hash, text) -> key, hash, dropped (array of line numbers).

    A template recurs if it occurs in ``min_docs`` documents.  With
    ``keep_first`` the document with the least key (null keys come last) keeps
    its lines, so no passage is lost from the corpus.  Rows that repeat key and
    text count as one document.
    """
    lines = materialize(parsed_lines(docs, depth), "template-lines")
    slots = [f"s{g}" for g in range(SLOTS)]
    busy = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_docs)
    lines = materialize(lines.join(busy, "leaf"), "template-candidates")
    values = lines.select("leaf", "c", F.posexplode(F.array(*slots)).alias("g", "v")).groupBy("leaf", "c", "g", "v").agg(
        F.count(F.lit(1)).alias("k")).where(F.col("k") * 2 > F.col("c"))
    constant = values.groupBy("leaf").agg(*[F.max(F.when(F.col("g") == g, F.col("v"))).alias(f"c{g}") for g in range(SLOTS)])
    x = lines.join(constant, "leaf", "left")
    rest = F.greatest(F.col("n") - depth, F.lit(0))
    fixed = reduce(lambda a, g: a + F.when(F.col(f"c{g}").isNotNull(), F.floor(rest * (g + 1) / SLOTS) - F.floor(
        rest * g / SLOTS)).otherwise(F.lit(0)), range(SLOTS), F.least(F.col("n"), F.lit(depth)))
    agrees = reduce(lambda a, g: a & F.coalesce(F.col(f"c{g}") == F.col(f"s{g}"), F.lit(True)), range(SLOTS), F.lit(True))
    shared = agrees & (fixed >= similarity * F.col("n"))
    x = x.select("key", "hash", "line_no", F.when(shared, F.xxhash64("leaf", F.lit("leaf"))).otherwise(
        F.xxhash64("leaf", *slots)).alias("template"))
    seen = x.groupBy("template", "key", "hash").agg(F.lit(1).alias("one")).groupBy("template").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("first"))
    seen = seen.where(F.col("docs") >= min_docs).select("template", F.col("first.key").alias("fk"), F.col("first.hash").alias("fh"))
    drop = x.join(seen, "template")
    if keep_first:
        drop = drop.where(~(F.col("key").eqNullSafe(F.col("fk")) & (F.col("hash") == F.col("fh"))))
    return drop.groupBy("key", "hash").agg(F.collect_set("line_no").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 5,
                         original: str | None = None, **options) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus n_lines (lines
    with a token), n_dropped and emptied (true if no line with a token is left
    of some).

    Null texts stay null with no lines; blank lines always stay.  All other
    columns are carried along; own columns named like the three are replaced.
    ``original`` names a further column that holds the text of emptied rows as it
    was (null for others).
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "emptied")]
    k, h, dk, dh = (fresh_name(c, own) for c in ("_key", "_hash", "_dkey", "_dhash"))
    lines_, drop_ = fresh_name("_lines", own), fresh_name("dropped", own)
    d = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{key}`").cast("long").alias(k),
                    F.xxhash64(F.col(f"`{text}`")).alias(h))
    found = recurring_lines(d.select(F.col(k).alias("key"), F.col(h).alias("hash"), F.col(f"`{text}`").alias("text")),
                            min_docs, **options)
    found = found.select(F.col("key").alias(dk), F.col("hash").alias(dh), F.col("dropped").alias(drop_))
    x = d.join(found, F.col(k).eqNullSafe(F.col(dk)) & (F.col(h) == F.col(dh)), "left").withColumn(
        lines_, F.split(F.col(f"`{text}`"), "\n"))
    gone = F.coalesce(F.size(drop_), F.lit(0))
    gone = F.when(F.col(drop_).isNull(), F.lit(0)).otherwise(gone)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(drop_))
    new = F.when(F.col(drop_).isNull(), F.col(f"`{text}`")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.col(lines_)[i]), "\n"))
    filled = F.coalesce(F.size(F.filter(lines_, lambda s: s.rlike(f"[^{WS}]"))), F.lit(0))
    filled = F.when(F.col(lines_).isNull(), F.lit(0)).otherwise(filled)
    x = x.withColumn("n_lines", filled.cast("long")).withColumn("n_dropped", gone.cast("long"))
    emptied = (F.col("n_dropped") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    was = [F.when(emptied, F.col(f"`{text}`")).alias(original)] if original else []
    return x.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in own], "n_lines", "n_dropped", emptied.alias("emptied"), *was)


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without recurring lines, and without the documents whose every
    line another document keeps word for word.

    A document of which nothing is left but whose lines only resemble others (a
    variable field differs) holds text that no other does: it stays, as it was."""
    was, line, i = (fresh_name(c, docs.columns) for c in ("_was", "_line", "_row"))
    out = materialize(drop_recurring_lines(docs, key, text, original=was, **options).withColumn(
        i, F.monotonically_increasing_id()), "template-texts", "zstd")

    def lines(rows: DataFrame, of: str) -> DataFrame:
        each = F.filter(F.transform(F.split(F.col(f"`{of}`"), "\n"), lambda s: F.trim(s, F.lit(" \t\x0b\x0c\r"))), lambda s: s != "")
        return rows.select(i, F.explode(F.transform(each, lambda s: F.xxhash64(s))).alias(line))

    empty = out.where("emptied")
    theirs = lines(empty, was).distinct()
    held = lines(out.where("not emptied"), text).select(line).join(theirs.select(line).distinct(), line, "left_semi").distinct()
    own = theirs.join(held, line, "left_anti").select(i).distinct()
    left = out.where("not emptied").unionByName(
        empty.join(own, i, "left_semi").withColumn(text, F.col(f"`{was}`")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
