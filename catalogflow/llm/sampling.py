"""SentencePiece segmentations sampled without replacement (Gumbel top-k).

A segmentation's weight is the product over its pieces of
exp(alpha * score - piece_cost); the lattice of a text normalises the weights
to probabilities.  Giving every segmentation its log probability plus Gumbel
noise and taking the k largest draws k distinct segmentations without
replacement.  They are found by best-first search that never lists the
segmentations: the largest value of a set of segmentations is itself Gumbel
distributed around the set's log mass, so a set can be queued with its exact
bound.  Taking a set from the queue samples its best member top-down; what is
left of it falls apart at the member's pieces into one set per piece (the ways
that leave the member there), each queued with a value truncated at the
member's.  The k-th and following bound gives every sample its probability of
inclusion, 1 - exp(-exp(log_prob - threshold)).

No piece holds a blank mark behind another character, so a text's lattice is a
chain of small ones, one per word; equal words share one lattice.  All words of
a slice of documents are handled in lockstep by numpy.  Random numbers are
hashes of seed, row key, sample and place: results do not depend on how rows
are dealt to tasks.
"""

from __future__ import annotations

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
ALPHA, PIECE_COST = 5e-4, 3.0
SLICE = 125_000           # characters handled at a time: their arrays stay in a core's cache
POOL = 600_000            # places of word lattices kept from slice to slice
# what the pool holds: of units (places, first place), of places (character,
# first arc) and of arcs (piece or -2 for none, characters, log chance, running sum)
_KEPT = {"size": np.int32, "first": np.int32, "points": np.uint32, "arc": np.int32,
         "ids": np.int32, "lengths": np.int16, "logs": np.float64, "upto": np.float64}
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Edges:
    """A trie's edges by (node << 21 | character), in a sparse table of slots: one
    look finds most of them."""

    def __init__(self, keys: np.ndarray, nodes: np.ndarray):
        bits = int(np.ceil(np.log2(4 * len(keys) + 4)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, -1, np.int32)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):           # every round, one key settles in each free slot that is asked for
            free = todo[self.nodes[slot[todo]] < 0]
            _, which = np.unique(slot[free], return_index=True)
            won = free[which]
            self.keys[slot[won]], self.nodes[slot[won]] = keys[won], nodes[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The node each edge leads to, or -1."""
        slot = self.slot(keys)
        seen, out = self.keys[slot], self.nodes[slot]
        todo = np.flatnonzero((seen != keys) & (out >= 0))       # another key's slot: the next ones
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.nodes[at]
            todo = todo[(self.keys[at] != keys[todo]) & (out[todo] >= 0)]
        return out


class Sampler:
    """Lattices and samples of one model; see the module."""

    def __init__(self, model: bytes, alpha: float = ALPHA, piece_cost: float = PIECE_COST, seed: int = 1):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.seed = np.uint64(seed)
        sp, n = self.sp, self.sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (
            sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces that go on behind a blank are not supported")
        self.bytes = {bytes.fromhex(sp.id_to_piece(i)[3:5])[0]: i for i in range(n) if sp.is_byte(i)}
        self.unknown, self.spelt = sp.unk_id(), {}
        self.longest = max(map(len, pieces), default=1)
        trie, self.ends = {}, [-1]
        for p, i in pieces.items():
            at = 0
            for c in p:
                key = at << 21 | ord(c)
                if key not in trie:
                    trie[key] = len(self.ends)
                    self.ends.append(-1)
                at = trie[key]
            self.ends[at] = i
        self.ends = np.array(self.ends)
        self.trie = Edges(np.array(list(trie), np.uint64), np.array(list(trie.values()), np.int32))
        lowest = -float(n)
        self.weight = np.array([alpha * max(sp.get_score(i), lowest) - piece_cost for i in range(n)])
        self.rare = alpha * lowest - piece_cost
        self.cost = piece_cost
        self.clear()

    def uniform(self, key: np.ndarray, *places) -> np.ndarray:
        h = _mix(key ^ _mix(np.full(1, self.seed, np.uint64)))
        for p in places:
            h = self.then(h, p)
        return self.share(h)

    @staticmethod
    def then(h: np.ndarray, place) -> np.ndarray:
        """A hash with one more place in it."""
        return _mix(h + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))

    @staticmethod
    def share(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)

    # ----------------------------------------------------------- the lattices

    def clear(self) -> None:
        self.known = collections.defaultdict(itertools.count().__next__)
        self.units = self.places = self.arcs = 0                   # how many the pool holds
        for name, kind in _KEPT.items():                           # emptied arrays keep their room
            setattr(self, name, getattr(self, name, np.zeros(1, kind)))
        self.arc[0] = 0

    def add(self, name: str, at: int, values: np.ndarray) -> None:
        """Writes values behind the first ``at`` of a pool array, which grows by
        halves: adding to the pool does not copy it each time."""
        kept, end = getattr(self, name), at + len(values)
        if end > len(kept):
            grown = np.empty(max(end, len(kept) * 3 // 2), kept.dtype)
            grown[:at] = kept[:at]
            setattr(self, name, grown)
        getattr(self, name)[at:end] = values

    def lattices(self, units: list[str]) -> None:
        """Adds units to the pool: an arc for every piece at every place, longest
        first, with its log chance given the place."""
        size = np.array([len(u) for u in units])
        first = np.cumsum(size) - size
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        total, width = len(points), min(self.longest, int(size.max()))
        left = np.repeat(first + size, size) - np.arange(total)    # characters to the unit's end
        node, alive, arcs = np.zeros(total, np.uint64), np.arange(total), []    # nodes of the places still alive
        fan = np.zeros(total, np.int64)                            # arcs of a place so far; in the end it has one at least
        for k in range(width):
            if k:
                inside = left[alive] > k
                alive, node = alive[inside], node[inside]
            to = self.trie.find(node << np.uint64(21) | points[alive + k])
            hit = to >= 0
            alive, to = alive[hit], to[hit]
            node = to.astype(np.uint64)
            end = self.ends[to]
            here = end >= 0
            at, end = alive[here], end[here]
            arcs.append((at, fan[at], end, np.full(len(at), k + 1), self.weight[end]))
            fan[at] += 1
            if k == 0:
                bare = np.flatnonzero(fan == 0)
                many = 1 + (points[bare] > 0x7F).astype(int) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF)
                arcs.append((bare, fan[bare], np.full(len(bare), -2), np.ones(len(bare), int),
                             self.rare - self.cost * (np.where(bool(self.bytes), many, 1) - 1)))
                fan[bare] = 1
        start = np.cumsum(fan) - fan
        place = np.repeat(np.arange(total), fan)
        ids, length, weight = np.empty(len(place), np.int32), np.empty(len(place), np.int64), np.empty(len(place))
        for at, rank, *values in arcs:                             # the shortest comes last
            to = start[at] + fan[at] - 1 - rank
            ids[to], length[to], weight[to] = values
        # log mass of what follows a place, from the units' ends on; one entry more per unit for its end
        after = np.zeros(total + len(units))
        at = np.arange(total) + np.repeat(np.arange(len(units)), size)
        by_left = np.argsort(left.astype(np.uint16) if size.max() < 1 << 16 else left, kind="stable")    # short numbers sort faster
        n = fan[by_left]
        seg = np.append(0, np.cumsum(n))
        turn = np.repeat(start[by_left] - seg[:-1], n) + np.arange(seg[-1])
        w, to = weight[turn], (at[place] + length)[turn]
        bounds = np.searchsorted(left[by_left], np.arange(1, int(size.max()) + 2))
        for p, q in zip(bounds[:-1], bounds[1:]):
            a, b, cut = seg[p], seg[q], seg[p:q] - seg[p]
            x = w[a:b] + after[to[a:b]]
            top = np.maximum.reduceat(x, cut)
            mass = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n[p:q])), cut))
            after[at[by_left[p:q]]] = mass
            w[a:b] = x - np.repeat(mass, n[p:q])
        weight[turn] = w
        run = np.cumsum(np.exp(weight))
        upto = run - np.repeat(run[start] - np.exp(weight[start]), fan)
        upto[start + fan - 1] = 1.0
        for name, at, values in (
                ("first", self.units, first + self.places), ("size", self.units, size), ("points", self.places, points),
                ("arc", self.places + 1, np.cumsum(fan) + self.arcs), ("ids", self.arcs, ids), ("lengths", self.arcs, length),
                ("logs", self.arcs, weight), ("upto", self.arcs, upto)):
            self.add(name, at, values)
        self.units, self.places, self.arcs = self.units + len(units), self.places + total, self.arcs + len(ids)

    def pick(self, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc of each place whose stretch of the running sum holds u."""
        arc = self.arc[rows]
        todo = np.flatnonzero(self.upto[arc] < u)
        while len(todo):
            arc[todo] += 1
            todo = todo[self.upto[arc[todo]] < u[todo]]
        return arc

    # ------------------------------------------------------------ the samples

    def walk(self, occ, unit, pos, step, key, place, sample):
        """Top-down samples of units from given places on: parallel arrays occ,
        step, place in the pool and arc of all pieces (in no order)."""
        out = []
        rows, stop = self.first[unit] + pos, self.first[unit] + self.size[unit]
        # all of a draw's hash but the step is the same along a unit
        h = self.then(self.then(_mix(key ^ _mix(np.full(1, self.seed, np.uint64))), sample), place)
        while len(occ):
            arc = self.pick(rows, self.share(self.then(h, step)))
            out.append((occ, step, rows, arc))
            rows, step = rows + self.lengths[arc], step + 1
            go = rows < stop
            occ, rows, stop, step, h = (a[go] for a in (occ, rows, stop, step, h))
        return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), (), ()))]

    def samples(self, texts: list[str], keys: np.ndarray, k: int):
        """Per text a list of at most k dicts: ids, log_prob, perturbed, inclusion."""
        shown = [self.sp.normalize(t) if t else "" for t in texts]
        split = [_UNIT.findall(s) for s in shown]
        count = np.array([len(s) for s in split])
        some = np.flatnonzero(count)
        if not len(some):
            return [[] for _ in texts]
        if self.places > POOL:
            self.clear()
        known, old = self.known, len(self.known)
        unit = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(count.sum()))
        if len(known) > old:
            self.lattices(list(itertools.islice(known, old, None)))
        n = len(some)
        begin = np.cumsum(count[some]) - count[some]                 # first occurrence of each document
        doc = np.repeat(np.arange(n), count[some])
        place = np.arange(len(unit)) - begin[doc]
        key = keys[some].astype(np.int64).view(np.uint64)
        best = -np.log(-np.log(self.uniform(key, 0, 0)))             # the largest perturbed value
        # queued sets, parallel arrays: document, value, log mass, path they leave, piece index there, arcs not to take
        queue = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        paths, result = [], [[] for _ in texts]
        now, barred = np.arange(n), np.zeros(n, np.int64)            # documents sampled in this round, barred arcs (bits)
        split_at, parent = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for s in range(k + 1):
            if s:
                # the best queued set of every document still running
                d, value, path, index, bars = queue
                if not len(d):
                    break
                order = np.lexsort((-value, d))
                top = order[np.append(True, d[order][1:] != d[order][:-1])]
                now, best, parent, split_at, barred = d[top], value[top], path[top], index[top], bars[top]
                gone = np.zeros(len(d), bool)
                gone[top] = True
                queue = [a[~gone] for a in queue]
                threshold = np.full(n, -np.inf)
                threshold[now] = best
                if s == k:
                    break
            new = self.path(s, now, parent, split_at, barred, paths, unit, doc, place, key, begin)
            paths.append(new)
            occ, step, rows, arc, bar, bounds = new
            logs = self.logs[arc]
            owner = doc[occ]
            run = np.cumsum(logs)
            base = np.zeros(n)
            base[now] = run[bounds[:-1]] - logs[bounds[:-1]]
            before = run - logs - base[owner]
            whole = np.zeros(n)
            whole[now] = run[bounds[1:] - 1] - base[now]
            value_of = np.full(n, -np.inf)
            value_of[now] = best
            self.emit(result, some, now, new, whole, value_of)
            # what is left beside every piece from the split on
            rest = -np.expm1(logs)
            taken = bar | (np.int64(1) << (arc - self.arc[rows]))
            few = np.flatnonzero((rest < 1e-9) | (bar > 0))           # summed, as the difference would be rounding
            rest[few] = self.open(rows[few], taken[few])[0]
            first_new = np.zeros(n, np.int64)
            first_new[now] = bounds[:-1] + np.maximum(split_at, 0)
            ask = np.flatnonzero((np.arange(len(occ)) >= first_new[owner]) & (rest > 0))
            mass = before[ask] + np.log(rest[ask])
            t = value_of[owner[ask]]
            u = self.uniform(key[owner[ask]], 1000 + s, place[occ[ask]], step[ask])
            with np.errstate(over="ignore"):
                bound = mass - np.log(np.exp(np.minimum(mass - t, 700)) - np.log(u))
            # only the best of a document can still be taken
            keep = self.leading(owner[ask], bound, k - s)
            ask, bound = ask[keep], bound[keep]
            local = ask - bounds[np.searchsorted(now, owner[ask])]
            queue = [np.concatenate([a, b]) for a, b in zip(queue, (
                owner[ask], bound, np.full(len(ask), s), local, taken[ask]))]
        d, value = queue[0], queue[1]
        threshold = np.full(n, -np.inf)
        if len(paths) == k and s == k and len(now):
            threshold[now] = best
        for i, at in enumerate(some):
            for one in result[at]:
                gap = one["log_prob"] - threshold[i]
                one["inclusion"] = 1.0 if threshold[i] == -np.inf else float(-np.expm1(-np.exp(min(gap, 700.0))))
        return result

    def open(self, rows: np.ndarray, barred: np.ndarray):
        """Of places: the mass of the arcs that are not barred, the running sums
        of those chances over all their arcs, and which place each sum is of."""
        fan = self.arc[rows + 1] - self.arc[rows]
        back, to = np.repeat(np.arange(len(rows)), fan), np.cumsum(fan) - fan
        k = np.arange(len(back)) - to[back]
        chance = np.where((barred[back] >> k) & 1 == 1, 0.0, np.exp(self.logs[self.arc[rows][back] + k]))
        mass = np.add.reduceat(chance, to) if len(rows) else np.zeros(0)
        run = np.cumsum(chance)
        return mass, run - (run[to] - chance[to])[back], back

    @staticmethod
    def leading(owner: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
        """Indexes of the m largest values of each owner (owners ascending)."""
        got, open_ = [], value.copy()
        if not len(owner):
            return np.zeros(0, np.int64)
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for _ in range(m):
            top = np.maximum.reduceat(open_, start)
            hit = np.flatnonzero(open_ == np.repeat(top, np.diff(np.append(start, len(open_)))))
            hit = hit[open_[hit] > -np.inf]
            if not len(hit):
                break
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            got.append(hit)
            open_[hit] = -np.inf
        return np.sort(np.concatenate(got)) if got else np.zeros(0, np.int64)

    def path(self, s, now, parent, split_at, barred, paths, unit, doc, place, key, begin):
        """The pieces of sample s of the documents ``now``, in text order: occ,
        step, rows, arc, barred arcs and the documents' bounds."""
        ends = np.append(begin[1:], len(unit))
        parts = []
        if s == 0:
            occ = np.arange(len(unit))
            zero = np.zeros(len(occ), np.int64)
            parts.append((*self.walk(occ, unit, zero, zero, key[doc], place, s), None))
        else:
            for which in np.unique(parent):
                docs = np.flatnonzero(parent == which)
                occ, step, rows, arc, bar, bounds = paths[which]
                of = np.unique(doc[occ])                              # documents of that path, ascending
                at = np.searchsorted(of, now[docs])
                a, i = bounds[at], bounds[at] + split_at[docs]
                m = i - a
                kept = np.repeat(a, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                parts.append((occ[kept], step[kept], rows[kept], arc[kept], bar[kept]))
                # another piece at the split, then on from behind it
                mass, run, back = self.open(rows[i], barred[docs])
                u = self.uniform(key[now[docs]], s, place[occ[i]], step[i]) * mass
                # the first arc whose running sum exceeds u
                other = self.arc[rows[i]] + np.add.reduceat((run <= u[back]).astype(np.int64), np.flatnonzero(np.append(True, back[1:] != back[:-1])))
                other = np.minimum(other, self.arc[rows[i] + 1] - 1)
                parts.append((occ[i], step[i], rows[i], other, barred[docs]))
                pos = rows[i] - self.first[unit[occ[i]]] + self.lengths[other]
                go = pos < self.size[unit[occ[i]]]
                follow = occ[i] + 1
                f = ends[now[docs]] - follow
                later = np.repeat(follow, f) + np.arange(f.sum()) - np.repeat(np.cumsum(f) - f, f)
                o = np.concatenate([occ[i][go], later])
                zero = np.zeros(len(later), np.int64)
                parts.append((*self.walk(o, unit[o], np.concatenate([pos[go], zero]), np.concatenate([step[i][go] + 1, zero]),
                                         key[doc[o]], place[o], s), None))
        occ, step, rows, arc = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in range(4))
        bar = np.concatenate([np.zeros(len(p[0]), np.int64) if p[4] is None else p[4] for p in parts])
        # place the pieces in text order: by occurrence, then step
        per = np.bincount(occ, minlength=len(unit))
        to = (np.cumsum(per) - per)[occ] + step
        out = []
        for a in (occ, step, rows, arc, bar):
            b = np.empty(len(a), np.int64)
            b[to] = a
            out.append(b)
        d = np.bincount(doc[out[0]], minlength=len(begin))[now]
        return (*out, np.append(0, np.cumsum(d)))

    def emit(self, result, some, now, path, whole, value):
        _, _, rows, arc, _, bounds = path
        ids = self.ids[arc]
        bare = np.flatnonzero(ids < 0)
        if len(bare):  # a character without piece becomes its bytes
            extra = [self.fallback(c) for c in "".join(map(chr, self.points[rows[bare]].tolist()))]
            many = np.ones(len(ids), np.int64)
            many[bare] = [len(e) for e in extra]
            to = np.cumsum(many) - many
            ids = np.repeat(ids, many)
            ids[ids < 0] = [i for e in extra for i in e]
            bounds = np.append(to, len(ids))[bounds]
        for d, a, b, w, v in zip(some[now].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), whole[now].tolist(), value[now].tolist()):
            result[d].append({"ids": ids[a:b], "log_prob": w, "perturbed": v})

    def fallback(self, char: str) -> list[int]:
        got = self.spelt.get(char)
        if got is None:
            got = self.spelt[char] = [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]
        return got


_MADE: dict = {}


def sampler(model: bytes, *options) -> Sampler:
    """One per worker process, model and options."""
    key = (hash(model), *options)
    if key not in _MADE:
        _MADE[key] = Sampler(model, *options)
    return _MADE[key]


SAMPLE = "array<struct<ids: array<int>, log_prob: double, perturbed: double, inclusion: double>>"


def _packed(rows: list[list[dict]]) -> pa.Array:
    """Samples as an Arrow array of type SAMPLE."""
    flat = [s for r in rows for s in r]
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s["ids"]) for s in flat)]), pa.int32()),
                                   pa.array(np.concatenate([np.zeros(0, np.int32), *(s["ids"] for s in flat)]).astype(np.int32)))
    values = [pa.array([s[k] for s in flat], pa.float64()) for k in ("log_prob", "perturbed", "inclusion")]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()),
                                    pa.StructArray.from_arrays([ids, *values], ["ids", "log_prob", "perturbed", "inclusion"]))


def sampled(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", k: int = 2,
            alpha: float = ALPHA, piece_cost: float = PIECE_COST, seed: int = 1) -> DataFrame:
    """key, text, samples, decoded: at most ``k`` distinct segmentations of each
    whole text, by falling perturbed value, and what the first decodes to.

    A text with fewer segmentations has them all, each with inclusion 1.  Null
    and empty texts have none (and decode to themselves).  Rows are seeded by
    their key, null keys by a hash of the text; repeated rows repeat their
    samples.  ``k`` is at least 1.  Other columns are not carried.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def drawn(batches):
        made = sampler(model.value, alpha, piece_cost, seed)
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(upto):
                before = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + SLICE, "right")))
                part = batch.slice(at, end - at)
                texts = part.column(1).to_pylist()
                got = made.samples(texts, part.column(2).to_numpy(zero_copy_only=False), k)
                back = made.sp.decode([s[0]["ids"].tolist() if s else [] for s in got])
                back = [b if t else t for b, t in zip(back, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _packed(got), pa.array(back, pa.string())],
                                                 ["key", "text", "samples", "decoded"])
                at = end

    t = F.col(f"`{text}`")
    k_ = F.col(f"`{key}`").cast("long")
    return docs.select(k_.alias("key"), t.alias("text"), F.when(k_.isNull(), F.xxhash64(t)).otherwise(F.xxhash64(k_)).alias("seed")).mapInArrow(
        drawn, f"key long, text string, samples {SAMPLE}, decoded string")


def restored(text: Column, decoded: Column) -> Column:
    """Does the decoded text equal the text?  (The model writes blanks as its
    mark, so a mark in the text comes back as a blank.)"""
    return decoded.eqNullSafe(F.replace(text, F.lit(MARK), F.lit(" ")))
