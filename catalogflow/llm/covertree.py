"""All pairs of vectors above a cosine, by dual traversal of cover trees.

On unit vectors a cosine of c is a distance of sqrt(2 - 2 c).  Vectors go to
the nearest of at most ``MAX_CELLS`` centres, a farthest-first cover of a
bounded sample; every vector is dealt, the sample only shapes the cells.  The
driver keeps one centre and covering radius per cell and prunes cell pairs by
the covering-radius bound.  Cells are split into parts of bounded size, so a
cell with a third of all vectors is many parts; a task gets two parts.

Inside a task each part becomes cover trees: nested levels with radii 2, 1, 1/2
and 1/4, the centre of a node being one of its vectors and of one of its
children, and every node knowing its real covering radius.  The traversal
descends both trees a level at a time.  A node pair too far apart is dropped, a
pair that is near enough as a whole is linked as a whole, the others go on to
their children; what is left are single vectors, compared in double precision.

Equal vectors are one class with a weight and are never expanded.  Of the links
only counts per class and a spanning forest leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

SAMPLE = 4096        # vectors that shape the cells
MAX_CELLS = 2048
PART = 8192          # vectors of a part, in expectation
LEAF = 1024          # vectors of one tree
RADII = (1.0, 0.5, 0.25)
SLACK = 1e-9         # bounds are kept this much on the safe side


def prepared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, dim, vec (little-endian bytes); vec is null for a vector that is
    null, empty, zero or holds a null or non-finite component."""
    double = dict(vectors.dtypes)[vector].lower() != "array<float>"
    kind = np.dtype("<f8" if double else "<f4")

    def packed(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                x = v.as_py()
                if x is None or not x or None in x:
                    out.append(None)
                    continue
                a = np.array(x, kind)
                out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
            dims = pa.array([None if v is None else len(v) // kind.itemsize for v in out], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), dims, pa.array(out, pa.binary())], ["key", "dim", "vec"])

    v = F.col(f"`{vector}`")
    return vectors.select(F.col(f"`{key}`").cast("long").alias("key"), v if not double else v.cast("array<double>")).mapInArrow(
        packed, "key long, dim int, vec binary")


def units(vecs, dim: int) -> np.ndarray:
    """Unit vectors in double precision of packed vectors of one dimension."""
    kind = "<f4" if len(vecs[0]) == 4 * dim else "<f8"
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of at most k centres, each the row farthest from those before it."""
    chosen, near = [0], 1 - x @ x[0]
    while len(chosen) < min(k, len(x)):
        i = int(near.argmax())
        if near[i] <= 1e-12:
            break
        chosen.append(i)
        near = np.minimum(near, 1 - x @ x[i])
    return x[chosen]


class Tree:
    """Cover tree of some unit vectors.  ``levels[l]`` holds for the nodes of a
    level: centre (row), radius, first and last row + 1, and the first child's
    number (one more at the end).  Rows are reordered so that a node's are
    contiguous; ``order`` maps them back.  A node of one vector stays itself."""

    def __init__(self, x: np.ndarray):
        rows, bounds, plans = np.arange(len(x)), [(0, len(x))], []
        for radius in RADII:
            new_bounds, first = [], []
            for a, b in bounds:
                first.append(len(new_bounds))
                if b - a == 1:
                    new_bounds.append((a, b))
                    continue
                own = rows[a:b]
                near = 2 - 2 * (x[own] @ x[own].T)
                free, groups = np.ones(len(own), bool), []
                close = near <= radius * radius
                alone = close.sum(axis=1) == 1
                for i in range(len(own)):  # the node's centre is first, so it is a child's centre too
                    if alone[i]:
                        groups.append(own[i:i + 1])
                    elif free[i]:
                        got = np.flatnonzero(free & close[i])
                        got = np.concatenate([[i], got[got != i]])
                        free[got] = False
                        groups.append(own[got])
                rows[a:b] = np.concatenate(groups)
                for g in groups:
                    new_bounds.append((a, a + len(g)))
                    a += len(g)
            plans.append((bounds, [*first, len(new_bounds)]))
            bounds = new_bounds
        plans.append((bounds, np.concatenate([[0], np.cumsum([b - a for a, b in bounds])])))
        n = np.arange(len(x) + 1)
        plans.append(([(i, i + 1) for i in n[:-1]], n))
        self.order, self.x, self.levels = rows, x[rows], []
        for spans, child in plans:
            a, b = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
            owner = np.repeat(np.arange(len(a)), b - a)
            far = 2 - 2 * np.einsum("ij,ij->i", self.x, self.x[a][owner])
            radius = np.sqrt(np.maximum(np.maximum.reduceat(far, a), 0)) + SLACK
            radius[b - a == 1] = 0.0
            self.levels.append((a, radius, a, b, np.asarray(child)))


def traverse(s: Tree, t: Tree, cosine: float):
    """Links between two trees: (rows of s, rows of t) of single pairs, and the
    list of (first, last + 1, first, last + 1) of node pairs linked as a whole."""
    limit = np.sqrt(2 - 2 * cosine)
    whole, left, right = [], [], []
    i, j = np.array([0]), np.array([0])       # the nodes of the level that are still asked
    asked = None                              # which pairs of them; None: all
    for depth in range(len(RADII) + 2):
        (cs, rs, as_, bs, ks), (ct, rt, at, bt, kt) = s.levels[depth], t.levels[depth]
        dots = s.x[cs[i]] @ t.x[ct[j]].T
        near = dots >= cosine                  # right for two single vectors
        ri, rj = rs[i], rt[j]
        for f in np.flatnonzero(ri):           # larger nodes are asked how near their vectors may be
            near[f] = dots[f] >= 1 - np.minimum(limit + ri[f] + rj + SLACK, 2.0) ** 2 / 2 - SLACK
        for f in np.flatnonzero(rj):
            near[:, f] = dots[:, f] >= 1 - np.minimum(limit + ri + rj[f] + SLACK, 2.0) ** 2 / 2 - SLACK
        if asked is not None:
            near &= asked
        p, q = np.nonzero(near)
        one = (ri[p] == 0) & (rj[q] == 0)
        if one.any():  # a node whose vectors coincide with its centre has radius 0 only if it is single
            left.append(as_[i[p[one]]])
            right.append(at[j[q[one]]])
        p, q = p[~one], q[~one]
        if not len(p):
            break
        d = np.sqrt(np.maximum(2 - 2 * dots[p, q], 0))
        all_ = d + ri[p] + rj[q] <= limit - SLACK
        whole += list(zip(as_[i[p[all_]]].tolist(), bs[i[p[all_]]].tolist(), at[j[q[all_]]].tolist(), bt[j[q[all_]]].tolist()))
        p, q = p[~all_], q[~all_]
        if not len(p):
            break
        up, uq = np.unique(p), np.unique(q)
        still = np.zeros((len(up), len(uq)), bool)
        still[np.searchsorted(up, p), np.searchsorted(uq, q)] = True
        i, pi = _children(ks, i[up])
        j, pj = _children(kt, j[uq])
        asked = None if still.all() else still[pi][:, pj]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), whole


def _children(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first[nodes + 1] - first[nodes]
    parent = np.repeat(np.arange(len(nodes)), n)
    return np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + first[nodes][parent], parent


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges (a, b) on n nodes: (node, root)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            moved = np.flatnonzero(root != np.arange(n))
            return moved, root[moved]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def linked(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray | None, cosine: float):
    """Links inside x (y is None) or between x and y: counts for the rows of x
    then y, and forest edges over those rows."""
    same = y is None
    tx = [(a, Tree(x[a:a + LEAF])) for a in range(0, len(x), LEAF)]
    ty = tx if same else [(len(x) + a, Tree(y[a:a + LEAF])) for a in range(0, len(y), LEAF)]
    weight = weight_x if same else np.concatenate([weight_x, weight_y])
    count, ea, eb = np.zeros(len(weight), np.int64), [], []

    def add(rows, others):
        np.add.at(count, rows, weight[others])

    for k, (ox, s) in enumerate(tx):
        for oy, t in ty[k:] if same else ty:
            a, b, whole = traverse(s, t, cosine)
            a, b = ox + s.order[a], oy + t.order[b]
            if s is t:
                a, b = a[a != b], b[a != b]
            add(a, b)
            if s is not t:
                add(b, a)
            ea.append(a), eb.append(b)
            for p, q, u, v in whole:
                m, n = ox + s.order[p:q], oy + t.order[u:v]
                count[m] += weight[n].sum()
                if s is not t:
                    count[n] += weight[m].sum()
                elif (p, q) == (u, v):
                    count[m] -= weight[m]  # a vector is no link of itself
                ea += [m, np.full(len(n), m[0])]
                eb += [np.full(len(m), n[0]), n]
    a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (ea, eb))
    return count, forest(a, b, len(weight))


def cosine_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """key, n_links, component_id, kept: one row per input row.

    n_links counts the other rows at a cosine of at least ``cosine``;
    component_id is the least key reachable over links, the row's own included.
    Vectors that ``prepared`` rejects link with nothing, vectors of different
    length never link.  Repeated rows are links of each other like any equal
    vectors.  Null keys are never the least.
    """
    spark = vectors.sparkSession
    rows = materialize(prepared(vectors, key, vector).withColumn("node", F.xxhash64("vec")), "cover-rows")
    classes = rows.where("vec is not null").groupBy("node", "dim", "vec").agg(F.min("key").alias("top"), F.count(F.lit(1)).alias("w"))
    n = rows.where("vec is not null").count()
    sample = rows.where("vec is not null").select("dim", "vec", "node").distinct().orderBy("node").limit(SAMPLE).toPandas()
    centres = {int(d): farthest_first(units(g["vec"].tolist(), int(d)), max(1, min(MAX_CELLS, n // PART)))
               for d, g in sample.groupby("dim")}
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, far double")
    def placed(dim: pd.Series, vec: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(dim), np.int32), np.full(len(dim), 2.0)
        for d in dim.unique():
            at = np.flatnonzero(dim.to_numpy() == d)
            if int(d) in shared.value:  # else the one cell of an unsampled dimension
                dots = units(vec.iloc[at].tolist(), int(d)) @ shared.value[int(d)].T
                cell[at] = dots.argmax(axis=1)
                far[at] = np.sqrt(np.maximum(2 - 2 * dots.max(axis=1), 0))
        return pd.DataFrame({"cell": cell, "far": far})

    classes = materialize(classes.select("*", placed("dim", "vec").alias("p")).select(
        "node", "dim", "vec", "top", "w", "p.cell", "p.far"), "cover-classes")
    cells = classes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas()
    plan, limit = [], np.sqrt(2 - 2 * cosine)
    for d, g in cells.groupby("dim"):
        c, r = g["cell"].to_numpy(), g["far"].to_numpy()
        x = centres.get(int(d))
        apart = np.sqrt(np.maximum(2 - 2 * x[c] @ x[c].T, 0)) if x is not None else np.zeros((len(c), len(c)))
        near = apart <= limit + r[:, None] + r + SLACK
        parts = np.ceil(g["n"].to_numpy() / PART).astype(int)
        plan += [(int(d), int(c[i]), int(c[j]), int(parts[i]), int(parts[j])) for i, j in zip(*np.nonzero(near)) if i <= j]
    # one row per side of every pair of cells that the bound leaves
    sides = [(d, a, f"{d}:{a}:{b}", 0, m, k, a == b) for d, a, b, m, k in plan]
    sides += [(d, b, f"{d}:{a}:{b}", 1, k, m, False) for d, a, b, m, k in plan if a != b]
    sides = spark.createDataFrame(sides, "dim int, cell int, pair string, side int, own int, other int, same boolean")
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("own")).cast("int")
    x = classes.join(sides, ["dim", "cell"]).withColumn("part", part)
    # a part of one cell meets the parts from its own number on, itself once; else all parts of the other cell
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    low, high = F.least("part", "with"), F.greatest("part", "with")
    x = x.withColumn("task", F.concat_ws(":", "pair", *[
        F.when(F.col("same"), s).when(F.col("side") == 0, a).otherwise(b) for s, a, b in (
            (low, F.col("part"), F.col("with")), (high, F.col("with"), F.col("part")))]))
    x = x.withColumn("side", F.when(F.col("same"), (F.col("part") > F.col("with")).cast("int")).otherwise(F.col("side")))

    def compared(g: pd.DataFrame) -> pd.DataFrame:
        d = int(g["dim"].iloc[0])
        a, b = g[g["side"] == 0].sort_values("node"), g[g["side"] == 1].sort_values("node")
        if len(a) and len(b):
            got, (u, v) = linked(units(a["vec"].tolist(), d), units(b["vec"].tolist(), d), a["w"].to_numpy(), b["w"].to_numpy(), cosine)
        elif bool(g["lone"].iloc[0]):
            g = a if len(a) else b
            a, b = g, g.iloc[:0]
            got, (u, v) = linked(units(a["vec"].tolist(), d), None, a["w"].to_numpy(), None, cosine)
        else:
            return pd.DataFrame({"node": [], "n": [], "to": []})
        nodes = np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
        to = np.full(len(nodes), -1, np.int64)
        to[u] = v
        some = (got > 0) | (to >= 0)
        return pd.DataFrame({"node": nodes[some], "n": got[some], "to": pd.array(
            [int(nodes[k]) if k >= 0 else None for k in to[some]], "Int64")})

    x = x.withColumn("lone", F.col("same") & (F.col("part") == F.col("with")))
    found = materialize(x.select("task", "dim", "side", "lone", "node", "vec", "w").groupBy("task").applyInPandas(
        compared, "node long, n long, to long"), "cover-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    of = classes.select("node", "top", "w").join(counts, "node", "left").join(parts, "node", "left")
    of = of.withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("top").alias("least"))
    of = materialize(of.join(least, "component").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.col("least").alias("component_id")), "cover-classes-linked")
    good, bad = rows.where("vec is not null").join(of, "node"), rows.where("vec is null")
    out = good.select("key", "n_links", "component_id").unionByName(
        bad.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
    return out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
