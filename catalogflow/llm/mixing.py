"""Mixing sources to target weights by fixed-length blocks.

The words of a source's documents, in key order, are packed into blocks of
``block_words``; a block is (source, index).  The mix is a table of output
slots: every shard draws how many of its slots each source fills (whole
expected parts, plus a multinomial draw for the remainders), the slots of a
source are numbered through all shards, and number i takes block
``permutation(i mod blocks)`` of pass ``i div blocks``.  The permutation is a
keyed four-round Feistel network over the index range, so no list of indexes is
shuffled or kept.  Blocks meet slots by a join on (source, index).

A source with a third of all words is spread: word offsets come from sums per
(source, bucket) and running sums inside buckets; slots are exploded per
(shard, source); block and slot tables are keyed by index.  Everything follows
from keys and the seed, so reruns agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialize, words_of

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0      # the mix's size against all words; a source's target against its own
BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
SLOTS_A_TASK = 1 << 18   # slots that one task writes out
BUCKETS = 4096
MAX_SOURCES = 100_000      # rows of the source table that the shard draws may broadcast


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, hash, size (words; null and blank texts 0)."""
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{source}`").cast("string").alias("source"),
                       F.xxhash64(t).alias("hash"), F.size(words_of(t)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, rank, source_size, weight, target.

    Sources in code-point order, null last, take the weights in turn.  They
    share ``share`` times all words by weight; a target stops at ``cap`` times
    its source's size and what is over goes to the others, until none is above.
    Solved directly: by rising size per weight, a source is at its cap if the
    cap is below what the words left give it.  The table has one row per source
    and may be ordered in one task.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = s.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    rising = Window.orderBy(F.col("top") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("words", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(whole))
    s = s.withColumn("level", (F.col("words") - F.coalesce(F.sum("top").over(rising), F.lit(0.0)))
                     / (F.col("all_weight") - F.coalesce(F.sum("weight").over(rising), F.lit(0))))
    s = s.withColumn("free", F.col("top") > F.col("level") * F.col("weight"))
    # all sources after the first free one are free and share its level
    s = s.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("top") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    return s.select("source", "rank", "source_size", "weight", F.when(
        F.col("level").isNull() | (F.col("top") <= F.col("level") * F.col("weight")), F.col("top")).otherwise(
        F.col("level") * F.col("weight")).alias("target"))


def offsets(sized: DataFrame, ranks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds rank and start (words of the source before the document).

    The order inside a source is by bucket (a hash of the key), key and text
    hash; rows that repeat all of that follow one another."""
    d = sized.join(ranks.select(F.col("source").alias("_s"), "rank"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("key", "hash"), F.lit(buckets)))
    sums = d.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "hash").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(sums, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "bucket")


def _rng(seed: int, *what) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *what)).encode()).digest()[:8], "big"))


def permuted(index: np.ndarray, size: np.ndarray, rank: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of [0, size) per (seed, rank), applied to each index: Feistel
    rounds over the least even number of bits that holds size, walked on while
    the result lies outside."""
    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    size = size.astype(np.uint64)
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.uint64), np.uint64(2))
    bits += (size > (np.uint64(1) << bits)).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = mixed(rank.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mixed(right + k + np.uint64((0x632BE59BD9B4E019 * (r + 1)) & (2 ** 64 - 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def drawn(shard: int, slots: int, chances: np.ndarray, seed: int) -> np.ndarray:
    """How many of a shard's slots each source fills."""
    exact = chances * slots
    whole = np.floor(exact).astype(np.int64)
    left, rest = int(slots - whole.sum()), exact - whole
    if left and rest.sum() > 0:
        whole += _rng(seed, "shard", shard).multinomial(left, rest / rest.sum())
    return whole


def slots(sources: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, rank, pass, block, one row per output slot.

    A source whose draws exceed its blocks times the cap leaves those slots
    empty, so that no block is taken more often than the cap allows."""
    spark = sources.sparkSession
    s = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    # slots, not words: a source's last block may be short
    s = materialize(s.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size")).withColumn(
        "most", F.floor(F.lit(CAP) * F.col("blocks"))).select("rank", "blocks", "want", "most"), "mix-sources")
    many, want = s.agg(F.count(F.lit(1)), F.sum("want")).first()
    if many > MAX_SOURCES:
        raise ValueError(f"{many} sources; the shard draws take at most {MAX_SOURCES}")
    total = int(round(want or 0))
    shards = -(-total // shard_slots)
    table = spark.sparkContext.broadcast(s.orderBy("rank").toPandas())

    def draws(frames):
        t = table.value
        p = t["want"].to_numpy() / t["want"].sum()
        for f in frames:
            for shard in f["id"]:
                n = drawn(int(shard), min(shard_slots, total - int(shard) * shard_slots), p, seed)
                took = np.flatnonzero(n)
                yield pd.DataFrame({"shard": shard, "rank": t["rank"].to_numpy()[took], "n": n[took]})

    counts = spark.range(0, shards, 1, max(1, min(shards, 256))).mapInPandas(draws, "shard long, rank int, n long")
    counts = materialize(counts, "mix-draws")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(s.select("rank", "blocks", "most"), "rank")
    # a row becomes as many as it has slots: the number of tasks follows the slots, not the rows
    tasks = max(1, -(-total // SLOTS_A_TASK))
    x = counts.repartition(tasks, "shard", "rank").select("shard", "rank", "blocks", "most", F.explode(
        F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i")).where("i < most")

    @F.pandas_udf("long")
    def block(i: pd.Series, n: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(permuted(i.to_numpy(), n.to_numpy(), rank.to_numpy(), seed))

    return x.select("shard", "rank", F.expr("i div blocks").alias("pass"), block(F.col("i") % F.col("blocks"), "blocks", "rank").alias("block"))


def taken(placed: DataFrame, mix: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents' word ranges in the mix: key, hash, pass, from_word, n_words."""
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
    low = F.greatest(F.col("block") * block_words, F.col("start"))
    high = F.least((F.col("block") + 1) * block_words, end)
    pieces = pieces.select("rank", "block", "key", "hash", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))
    # both sides grow with the data; sizes of exploded tables are underrated, so the join is named
    uses = mix.select("rank", "block", "pass").hint("merge")
    return pieces.join(uses, ["rank", "block"]).select("key", "hash", "pass", "from_word", "n_words")


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                  seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, ranges): per row key, hash, source, size, source_size, target,
    taken; and the word ranges that the mix takes (see ``taken``).

    Rows that repeat key and text share their key's ranges: each reports the
    mean of what the copies have.  Empty documents take nothing; an empty table
    gives empty results.  Null keys and null sources are values like others.
    """
    sized = materialize(sizes(docs, key, source, text), "mix-sizes")
    sources = materialize(targets(sized), "mix-targets")
    placed = materialize(offsets(sized, sources), "mix-offsets")
    ranges = materialize(taken(placed, slots(sources, seed)), "mix-ranges")
    sums = ranges.groupBy("key", "hash").agg(F.sum("n_words").alias("t"))
    copies = placed.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"))
    per = copies.join(sums.withColumnRenamed("key", "k").withColumnRenamed("hash", "h"),
                      F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left")
    per = per.select(F.col("key").alias("k"), F.col("hash").alias("h"), F.expr("coalesce(t, 0) div n").alias("taken"))
    out = placed.drop("start").join(per, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))).drop("k", "h")
    return out.join(sources.select("rank", "source_size", "target"), "rank"), ranges


def mixed_texts(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1) -> DataFrame:
    """The mix as documents: a row of ``docs`` per pass in which the mix takes
    words of it, with those words as its text (the text itself if all are taken)
    and the columns of ``docs``.

    Documents without words have none to give and are left out.  Rows that
    repeat key and text get each what the mix takes of any of them."""
    _, ranges = mix_documents(docs, key, source, text, seed)
    k, h, rk, rh, w, parts = (fresh_name(c, docs.columns) for c in ("_key", "_hash", "_rkey", "_rhash", "_words", "_parts"))
    per = ranges.groupBy(F.col("key").alias(rk), F.col("hash").alias(rh), "pass").agg(
        F.array_sort(F.collect_set(F.struct("from_word", "n_words"))).alias(parts)).drop("pass")
    t = F.col(f"`{text}`")
    d = docs.withColumn(k, F.col(f"`{key}`").cast("long")).withColumn(h, F.xxhash64(t))
    x = d.join(per, F.col(k).eqNullSafe(F.col(rk)) & (F.col(h) == F.col(rh))).withColumn(w, words_of(t))
    got = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n_words"])
    cut = F.array_join(F.transform(parts, lambda p: F.array_join(
        F.slice(F.col(w), (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")), " ")), " ")
    return x.select(*[F.when(got >= F.size(w), t).otherwise(cut).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
