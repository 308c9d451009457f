"""Prefix trie of conversations as balanced parentheses, shard by shard.

Distinct turn sequences are dealt over the cluster by ranges of their order, so
a shard's sequences are neighbours in the trie and equal conversations are one
weighted sequence.  A shard writes its part of the trie's depth-first walk as
parentheses; a range min-max tree over their excess finds the close that ends a
subtree, the rank of adjacent pairs counts its leaves, and differences of
cumulative arrays give members and savings.  Nodes that a neighbouring shard
continues (the spine) give partial sums, which merge by key.  A shard learns from
its neighbours only their nearest sequence.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 32                  # characters of a turn's hash in a sequence
SHARD_LEAST, SHARD_MOST = 256 << 10, 64 << 20   # characters of sequences that a shard holds
IDS = 4096                  # conversation ids (and so bytes) that one text of ids covers
ROOT = "root"


def turn_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): a conversation's turns in order (null turn numbers first,
    ties by content) as hashes and text sizes.  Null role and text are empty;
    rows without a conversation id belong to no conversation."""
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.col(f"`{turn}`")
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").alias("conv"), F.struct(n.isNotNull().alias("numbered"), n.alias("turn"), F.md5(F.concat(
            F.length(r).cast("string"), F.lit(":"), r, t)).alias("hash"), F.octet_length(t).alias("bytes")).alias("t"))
    listed = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv", F.transform("t", lambda x: F.struct(x["hash"].alias("hash"), x["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(hashed: DataFrame, base: Column, taken: Column) -> DataFrame:
    """(conv, turns): the first ``taken`` turns of conversation ``base`` (none if
    it is absent), then the conversation's own after its first ``taken``."""
    own = hashed.withColumn("base", base).withColumn("h", taken)
    other = hashed.select(F.col("conv").alias("base"), F.col("turns").alias("first"))
    j = own.join(other, "base", "left")
    mine = F.when(F.size("turns") > F.col("h"), F.expr("slice(turns, h + 1, size(turns))"))
    none = F.array().cast(hashed.schema["turns"].dataType)
    return j.select("conv", F.concat(F.coalesce(F.expr("slice(first, 1, h)"), none), F.coalesce(mine, none)).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(path, bytes, conv, n, ends): the distinct sequences, their least
    conversation, number of conversations and the SHA-256 of those ids, ascending
    and joined by commas.  Ids meet as texts of at most ``IDS`` ids in one sorted
    stream; no list of all copies is held."""
    c = convs.select("conv", F.array_join(F.transform("turns", lambda x: x["hash"]), "").alias("path"),
                     F.transform("turns", lambda x: x["bytes"].cast("long")).alias("bytes"))
    part = c.groupBy(F.md5("path").alias("k"), F.floor(F.col("conv") / IDS).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.min("path").alias("path"), F.first("bytes").alias("bytes"))

    def joined(batches):
        last, h = None, None
        for pdf in batches:
            done = []
            for k, ids, n, conv, path, sizes in zip(pdf["k"], pdf["ids"], pdf["n"], pdf["conv"], pdf["path"], pdf["bytes"]):
                if last is None or k != last[0]:
                    if last is not None:
                        done.append((*last[1:], h.hexdigest()))
                    last, h = [k, path, sizes, conv, n], hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
                    last[4] += n
            yield pd.DataFrame(done, columns=["path", "bytes", "conv", "n", "ends"])
        if last is not None:
            yield pd.DataFrame([(*last[1:], h.hexdigest())], columns=["path", "bytes", "conv", "n", "ends"])

    ordered = part.repartition("k").sortWithinPartitions("k", "part").select("k", "ids", "n", "conv", "path", "bytes")
    return ordered.mapInPandas(joined, "path string, bytes array<long>, conv long, n long, ends string")


class Parens:
    """Balanced parentheses (+1, -1) with a range min-max tree over blocks of
    their excess."""

    BLOCK = 64

    def __init__(self, steps: np.ndarray):
        self.excess = np.cumsum(steps, dtype=np.int64)
        n, b = len(steps), self.BLOCK
        blocks = max(1, -(-n // b))
        padded = np.full(blocks * b, np.iinfo(np.int64).max)
        padded[:n] = self.excess
        self.levels = [padded.reshape(blocks, b).min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int64).max)
                self.levels[-1] = low
            self.levels.append(low.reshape(-1, 2).min(axis=1))
        # one array for all levels: level l's block i stands at start[l] + i
        self.start = np.cumsum([0] + [len(x) for x in self.levels[:-1]])
        self.tree = np.concatenate(self.levels)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The matching close of every open: the next place where the excess
        falls below the open's."""
        want = self.excess[opens] - 1
        out = np.full(len(opens), -1, np.int64)
        todo = np.arange(len(opens))
        todo = self._scan(todo, opens + 1, want, out)
        if not len(todo):
            return out
        level, at, goal = np.zeros(len(todo), np.int64), opens[todo] // self.BLOCK + 1, want[todo]
        up = np.ones(len(todo), bool)
        while up.any():       # towards the right, by ever larger runs of blocks
            m = self.tree[self.start[level] + at] > goal
            up &= m
            odd = up & (at % 2 == 1)
            at = np.where(odd, (at + 1) // 2, np.where(up, at + 1, at))
            level = np.where(odd, level + 1, level)
        while (level > 0).any():
            down = level > 0
            below = np.where(down, level - 1, 0)
            first = self.tree[self.start[below] + np.where(down, 2 * at, 0)] <= goal
            at = np.where(down, 2 * at + ~first, at)
            level = below
        place = np.zeros(len(opens), np.int64)
        place[todo] = at * self.BLOCK
        self._scan(todo, place, want, out)
        return out

    def _scan(self, todo, place, want, out):
        """Walks on inside the block of ``place``; returns those that found nothing there."""
        left, p, stop = todo, place[todo], (place[todo] // self.BLOCK + 1) * self.BLOCK
        rest = []
        while len(left):
            inside = (p < stop) & (p < len(self.excess))
            rest.append(left[~inside])
            left, p, stop = left[inside], p[inside], stop[inside]
            hit = self.excess[p] == want[left]
            out[left[hit]] = p[hit]
            left, p, stop = left[~hit], p[~hit] + 1, stop[~hit]
        # an open at its block's very end starts the walk in the next block
        return np.sort(np.concatenate(rest)) if rest else left


def common(a: str, b: str) -> int:
    """Number of leading turns that two sequences share."""
    n = min(len(a), len(b)) // WIDTH
    for d in range(n):
        if a[d * WIDTH:(d + 1) * WIDTH] != b[d * WIDTH:(d + 1) * WIDTH]:
            return d
    return n


class Minima:
    """Least value of any range of an array (doubling windows)."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half = 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for d in np.unique(k):
            m = k == d
            row = self.rows[d]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - 2 ** d])
        return out


NODE = ("key string, depth long, parent_key string, spine boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, path_bytes long, own_bytes long, above_bytes long, ends string")
NEVER = np.iinfo(np.int64).max


def shard_nodes(seqs: pd.DataFrame, before: str | None, after: str | None) -> pd.DataFrame:
    """The nodes of one shard's part of the walk.

    ``before`` and ``after`` are the neighbours' nearest sequences.  A node that
    was open before, or stays open after, is marked ``spine``: its numbers count
    this shard's share only."""
    seqs = seqs.sort_values("path")
    depth, key, parent, above, own, real = [], [], [], [], [], []
    ends_at, steps, stack = [], [], []
    first = seqs["path"].iloc[0]
    last_path, last_bytes = "", None

    def push(path, sizes, d, opened):
        up = stack[-1] if stack else -1
        size = int(sizes[d - 1]) if d else 0
        k = hashlib.md5((key[up] + path[(d - 1) * WIDTH:d * WIDTH]).encode()).hexdigest() if d else ROOT
        stack.append(len(depth))
        depth.append(d)
        key.append(k)
        parent.append(up)
        above.append(above[up] + own[up] if d > 1 else 0)
        own.append(size)
        real.append(opened)
        steps.append(1)

    opened_before = common(before, first) if before is not None else -1
    for path, sizes in zip(seqs["path"], seqs["bytes"]):
        if last_bytes is None:
            for d in range(opened_before + 1):
                push(path, sizes, d, False)
            shared = opened_before
        else:
            shared = common(last_path, path)
        while len(stack) > shared + 1:
            stack.pop()
            steps.append(-1)
        for d in range(shared + 1, len(path) // WIDTH + 1):
            push(path, sizes, d, True)
        ends_at.append(stack[-1])
        last_path, last_bytes = path, sizes
    open_after = common(last_path, after) if after is not None else -1
    n = len(depth)
    spine = np.zeros(n, bool)
    spine[:opened_before + 1] = True
    spine[stack[:open_after + 1]] = True
    steps.extend([-1] * len(stack))

    steps = np.array(steps, np.int8)
    opens = np.nonzero(steps > 0)[0]
    close = Parens(steps).find_close(opens)
    lo = np.arange(n)
    hi = lo + (close - opens + 1) // 2       # preorder numbers of a subtree: [lo, hi)
    real, own, above, parent = np.array(real), np.array(own, np.int64), np.array(above, np.int64), np.array(parent)

    def summed(values):
        c = np.concatenate([[0], np.cumsum(values)])
        return c[hi] - c[lo]

    ends_at = np.array(ends_at)
    members, least = np.zeros(n, np.int64), np.full(n, NEVER)
    members[ends_at], least[ends_at] = seqs["n"].to_numpy(), seqs["conv"].to_numpy()
    leaf = (steps[opens] > 0) & (close == opens + 1) & ~spine
    ends = np.full(n, None, object)
    ends[ends_at] = seqs["ends"].to_numpy()
    least = Minima(least).least(lo, hi)
    up_known = (parent >= 0) & ~spine[parent]
    return pd.DataFrame({
        "key": key, "depth": depth, "parent_key": [key[p] if p >= 0 else None for p in parent], "spine": spine,
        "conv_id": pd.Series(np.where(least == NEVER, 0, least)).astype("Int64").mask(least == NEVER),
        "parent_conv_id": pd.Series(np.where(up_known, least[parent], 0)).astype("Int64").mask(~up_known),
        "n_convs": summed(members), "n_children": np.bincount(parent[real & (parent >= 0)], minlength=n), "n_leaves": summed(leaf),
        "path_bytes": summed(members * (above + own)), "own_bytes": summed(np.where(real, own, 0)),
        "above_bytes": above, "ends": ends})


def shards_of(n_chars: int, tasks: int) -> int:
    """One shard per task, but none under ``SHARD_LEAST`` or over ``SHARD_MOST`` characters on average."""
    return max(1, math.ceil(n_chars / SHARD_MOST), min(tasks, math.ceil(n_chars / SHARD_LEAST)))


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``sequences``: ``key``, ``depth``,
    ``parent_key``, ``conv_id`` (least member), ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved`` (bytes that sharing saves in the
    subtree) and ``ends`` (null where no conversation ends).

    No sequences give no nodes, not even a root."""
    spark = seqs.sparkSession
    seqs = materialize(seqs, "trie-sequences")
    chars = seqs.agg(F.sum(F.length("path") + WIDTH)).first()[0] or 0
    n = shards_of(chars, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(seqs.repartitionByRange(n, "path").withColumn("shard", F.spark_partition_id()), "trie-shards")
    # one row per shard: only the sequences next to a border cross it
    w = Window.orderBy("shard")
    borders = placed.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    borders = borders.select("shard", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))

    def build(mine, border):
        if not len(mine):
            return shard_nodes_none()
        return shard_nodes(mine, *border[["before", "after"]].iloc[0])

    nodes = materialize(placed.groupBy("shard").cogroup(borders.groupBy("shard")).applyInPandas(build, NODE), "trie-nodes")
    spine = nodes.where("spine").groupBy("key", "depth", "parent_key").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "path_bytes", "own_bytes")],
        F.min("above_bytes").alias("above_bytes"), F.max("ends").alias("ends"))
    # a spine node's parent is on the spine, so it is a leaf in no shard: children decide
    spine = materialize(spine.withColumn("parent_conv_id", F.lit(None).cast("long")), "trie-spine")
    whole = nodes.where("not spine").drop("spine")
    settled = whole.where(F.col("parent_conv_id").isNotNull())
    loose = whole.where(F.col("parent_conv_id").isNull()).unionByName(spine)
    ups = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    loose = loose.join(ups, "parent_key", "left").withColumn("parent_conv_id", F.col("up")).drop("up")
    return settled.unionByName(loose).select(
        "key", "depth", "parent_key", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("path_bytes") - F.col("n_convs") * F.col("above_bytes") - F.col("own_bytes")).alias("saved"), "ends")


def shard_nodes_none() -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: [] for c in NODE.split(", ")})
