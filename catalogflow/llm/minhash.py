"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Per set a task computes 128 MinHash values, 32 band keys of four values each (a
pair at similarity 0.75 shares no band with probability 5e-6) and an odd
sketch: every (slot, value) flips one of 512 bits, so that the XOR of two
sketches has few bits where many slots agree, and its population count gives
high similarities precisely from 64 bytes.

Equal sets are one class.  Classes that share a band key with the bucket's representative are linked to
it, and the components of those links are clusters: whatever two classes share
a band, they are in one cluster.  A cluster's members are compared in memory,
in tasks of bounded size; a large cluster is cut into tiles and a task gets two
of them.  The odd sketches rule out all pairs that are clearly less similar,
the rest is confirmed on full sets, nearest first, leaving out pairs that are
linked already through others.  Only links become rows, at most one per class
and task, so neither a hot bucket nor a group of near copies is ever expanded
into its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialize
from .graph import connected_components

WORDS = 5
SLOTS, BAND, BITS = 128, 4, 512
#: XOR bits at a similarity of 0.50: a pair at 0.75 exceeds them with probability 2e-7.
SKETCH_LIMIT = 100
TILE = 1024          # classes of a tile, in expectation
PERCENT = 75

_rng = np.random.default_rng(20250801)
_ODD = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    A-Z are lowered; words are separated by ASCII white space.  With fewer than
    five words the whole sequence is one shingle; null and blank texts have none."""
    from xxhash import xxh3_64_intdigest
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(h))):
        out += h[i:i + n] * _ODD[i]
    return np.unique(_mix(out))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the 128 slots; the set must not be empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i:i + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One key per band, distinct between bands."""
    m = mins.astype(np.uint64).reshape(-1, BAND)
    key = np.arange(1, len(m) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(BAND):
        key = _mix(key ^ m[:, j])
    return key.view(np.int64)


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (slot, value) pairs, as eight 64-bit integers."""
    at = _mix(mins.astype(np.uint64) + (np.arange(1, SLOTS + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def similarity_of(xor_bits):
    """Estimated similarity of two sets from the population count of their
    sketches' XOR; a number or an array."""
    return 1 + BITS / (4.0 * SLOTS) * np.log(np.maximum(1 - 2 * np.asarray(xor_bits) / BITS, 1e-9))


def linked(sketches: np.ndarray, sets: list[np.ndarray], first: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets: pairs of indexes.

    With ``first`` below the number of sets only pairs of one of the first so
    many with one of the others are compared, else all pairs."""
    n, root, out = len(sets), list(range(len(sets))), []
    size = np.array([len(x) for x in sets])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, min(first, n), 256):
        rows = np.arange(a, min(a + 256, first, n))
        others = np.arange(first, n) if first < n else np.arange(a + 1, n)
        bits = np.zeros((len(rows), len(others)), np.int64)
        for k in range(sketches.shape[1]):
            bits += np.bitwise_count(sketches[rows, k][:, None] ^ sketches[others, k])
        near = (bits <= SKETCH_LIMIT) & (100 * np.minimum(size[rows][:, None], size[others])
                                         >= percent * np.maximum(size[rows][:, None], size[others]))
        if first >= n:
            near &= rows[:, None] < others
        i, j = np.nonzero(near)
        order = np.argsort(bits[i, j], kind="stable")
        for x, y in zip(rows[i[order]].tolist(), others[j[order]].tolist()):
            u, v = find(x), find(y)
            if u != v:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[y] - both):
                    root[max(u, v)] = min(u, v)
                    out.append((x, y))
    return out


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hash (of the text), n_shingles, node (64-bit class of the set; null
    where empty), bands, k0..k7 (sketch)."""
    def signed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = {"n": [], "node": [], "bands": [], "k": []}
                for t in part.column(1):
                    s = shingle_set(t.as_py())
                    rows["n"].append(len(s))
                    if len(s):
                        m = min_hashes(s)
                        sums = np.array([s.sum(), _mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)
                        whole = _mix(_mix(sums * _ODD[:2] + np.uint64(len(s))).cumsum()[1:])
                        rows["node"].append(int(whole.view(np.int64)[0]))
                        rows["bands"].append(band_keys(m))
                        rows["k"].append(odd_sketch(m))
                    else:
                        rows["node"].append(None), rows["bands"].append(None), rows["k"].append([None] * 8)
                ks = [pa.array([None if k[i] is None else int(k[i]) for k in rows["k"]], pa.int64()) for i in range(8)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(rows["n"], pa.int64()), pa.array(rows["node"], pa.int64()),
                     pa.array(rows["bands"], pa.list_(pa.int64())), *ks],
                    ["key", "hash", "n_shingles", "node", "bands", *[f"k{i}" for i in range(8)]])

    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), t.alias("text"), F.xxhash64(t).alias("hash")).mapInArrow(
        signed, "key long, hash long, n_shingles long, node long, bands array<long>, " + ", ".join(f"k{i} long" for i in range(8)))


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, text) -> (node, shingles)."""
    @F.pandas_udf("array<long>")
    def hashed(texts):
        return pd.Series([shingle_set(t).view(np.int64) for t in texts])

    return docs.select("node", hashed("text").alias("shingles"))


def cluster_links(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cluster, node, k0..k7, shingles) -> links (a, b) between nodes of a
    cluster, enough of them to connect what is linked."""
    ks = [f"k{i}" for i in range(8)]
    sizes = materialize(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "minhash-cluster-sizes")
    small = sizes.where(F.col("size") <= TILE).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    x = members.join(sizes, "cluster").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    x = x.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(5)), F.col("tiles")).cast("int"))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # small clusters share tasks; a tile of a large one meets every tile, itself once
    shared = F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-small // TILE))))
    x = x.withColumn("task", F.when(F.col("tiles") == 1, F.concat(F.lit("s"), shared)).otherwise(
        F.concat_ws(":", "cluster", F.least("tile", "with"), F.greatest("tile", "with"))))
    x = x.select("task", "cluster", (F.col("tile") > F.col("with")).alias("second"), "node", *ks, "shingles")

    def compared(g: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, c in g.sort_values(["cluster", "second", "node"]).groupby("cluster", sort=False):
            node, n = c["node"].to_numpy(), int((~c["second"]).sum())
            pairs = linked(c[ks].to_numpy(np.int64).view(np.uint64), c["shingles"].tolist(), n or len(c), percent)
            links += [(node[i], node[j]) for i, j in pairs]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return x.groupBy("task").applyInPandas(compared, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, hash (of the text), n_shingles, component, component_id, kept: one
    row per input row; component is an internal number of the group, null where
    the set is empty.

    component_id is the least key among the documents reachable over links, the
    row's own included; kept marks the rows whose key that is.  Empty sets link
    with nothing, not even each other.  Null keys are never the least; a
    component of null keys alone has a null component_id and keeps its rows.
    Rows that repeat a document are copies like any others.
    """
    d = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    signed = materialize(signatures(d, "key"), "minhash-signatures")
    ks = [f"k{i}" for i in range(8)]
    classes = signed.where("node is not null").groupBy("node").agg(
        F.min("key").alias("top"), F.any_value(F.struct("bands", *ks)).alias("s"))
    classes = materialize(classes.select("node", "top", "s.*"), "minhash-classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    company = banded.join(buckets, "band").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    clusters = materialize(connected_components(company), "minhash-clusters").withColumnRenamed("component", "cluster")
    needed = clusters.select("node")
    # One text per class that has company, found by key and text hash.  Rows that
    # repeat both are the only ones found twice; they are brought down to one.
    shown = signed.join(needed, "node", "left_semi").groupBy("node", "key", "hash").agg(F.count(F.lit(1)).alias("m"))
    shown = shown.groupBy("node").agg(F.min(F.struct("key", "hash", "m")).alias("s")).select("node", "s.*")
    # both sides of these joins grow with the data, so they are the same joins at every size
    shown = materialize(shown, "minhash-shown").hint("merge").alias("s")
    found = d.withColumn("hash", F.xxhash64("text")).alias("d").join(
        shown, F.col("d.key").eqNullSafe(F.col("s.key")) & (F.col("d.hash") == F.col("s.hash"))).select("node", "text", "m")
    texts = found.where("m = 1").select("node", "text").unionByName(
        found.where("m > 1").groupBy("node").agg(F.any_value("text").alias("text")))
    sets = materialize(full_sets(texts), "minhash-sets")

    members = sets.join(clusters.hint("merge"), "node").join(classes.select("node", *ks).hint("merge"), "node")
    links = materialize(cluster_links(members, percent), "minhash-links")
    labels = materialize(connected_components(links), "minhash-components")
    of = classes.select("node", "top").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("top").alias("least"))
    of = materialize(of.join(least, "component").select("node", "component", "least"), "minhash-least")
    out = signed.where("node is not null").join(of, "node").select(
        "key", "hash", "n_shingles", "component", F.col("least").alias("component_id"))
    out = out.unionByName(signed.where("node is null").select(
        "key", "hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("key").alias("component_id")))
    return out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one
    with the least key (then text hash; null keys come last), of rows that
    repeat it one, and every document without words."""
    rows = materialize(near_duplicates(docs, key, text, percent), "minhash-rows")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("f")
    stay = rows.where("component is not null").groupBy("component").agg(first).select("f.key", "f.hash")
    copies = rows.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("m"), F.max("n_shingles").alias("n"))
    same = F.col("s.key").eqNullSafe(F.col("c.key")) & (F.col("s.hash") == F.col("c.hash"))
    stay = stay.alias("s").join(copies.alias("c"), same).select("c.key", "c.hash", F.col("c.m").alias("m"))
    stay = stay.unionByName(copies.where("n = 0").select("key", "hash", F.lit(1).cast("long").alias("m")))
    k, h, sk, sh, m = (fresh_name(c, docs.columns) for c in ("_key", "_hash", "_skey", "_shash", "_copies"))
    stay = materialize(stay.toDF(sk, sh, m), "minhash-stay")
    d = docs.withColumn(k, F.col(f"`{key}`").cast("long")).withColumn(h, F.xxhash64(F.col(f"`{text}`")))
    x = d.join(stay, F.col(k).eqNullSafe(F.col(sk)) & (F.col(h) == F.col(sh)))
    out = x.where(F.col(m) == 1).unionByName(x.where(F.col(m) > 1).dropDuplicates([k, h]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
