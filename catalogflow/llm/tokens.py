"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic machines give exactly the library's token boundaries:

* The **splitter** (eight states over eight symbols) marks where the
  pre-tokenizer starts a piece.  What its pattern looks ahead for is put into
  the symbols.  All fixed-length chunks of a batch run in lockstep from every
  state; the resulting state maps compose by a parallel prefix scan, and a
  second run from the known start states writes the marks.
* The **merger** reads the bytes of a piece.  Its state is what later bytes can
  still change: the open positions (those from which the text is a prefix of a
  vocabulary entry) with the token that ends there and the token count relative
  to the newest position.  A transition carries the change in the count.  It
  rests on two facts of BPE: every prefix of an encoding is the encoding of its
  text, and a sequence is an encoding if and only if each neighbouring pair is.
  States are compiled when first met and kept in a hash table; chunks that
  begin at piece starts run through it in lockstep.

Texts stay where they are read: there is no shuffle, and the work and memory of
a task are bounded by slices of ``SLICE`` characters.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 2 << 20        # characters handled at a time
CHUNK = 128            # characters (splitter) and bytes (merger) of a chunk
MAX_STATES = 300_000   # beyond this many the merger's table starts afresh from the states in use
#: The split pattern of byte-level BPE (a fixed value): contractions, letters,
#: numbers, other signs, white space.
CONTRACTIONS = (("s", "t", "m", "d"), ("re", "ve", "ll"))

L, N, O, O2, O3, SPACE, GAP, BLANK = range(8)             # symbols
ANY, IN_L, IN_N, IN_O, PREFIX, IN_WS, LEFT1, LEFT2 = range(8)  # states


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here" for state x symbol; symbols from 8
    on are the same at the start of a text."""
    nxt, cut = np.zeros((8, 16), np.uint8), np.ones((8, 16), bool)
    for s in range(8):
        for x in range(8):
            to, new = {L: (IN_L, True), N: (IN_N, True), O: (IN_O, True), O2: (LEFT1, True), O3: (LEFT2, True),
                       SPACE: (PREFIX, True), GAP: (ANY, True), BLANK: (IN_WS, True)}[x]
            if s in (LEFT1, LEFT2) and x in (L, N, O):
                to, new = (ANY if s == LEFT1 else LEFT1), False
            elif x in (L, N) and s in (to, PREFIX) or x == BLANK and s == IN_WS:
                new = False
            elif x in (O, O2, O3) and s in (IN_O, PREFIX):
                to, new = IN_O, False
            nxt[s, x], cut[s, x] = to, new
    nxt[:, 8:] = nxt[ANY, :8]
    return nxt, cut


def _classes() -> np.ndarray:
    """Symbol class of every code point: letter, number, white space (BLANK) or other."""
    import regex
    out = np.full(0x110000, O, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]):ord(m[0][0]) + len(m[0])] = cls
    return out


class Transducer:
    """Counts tokens as the tokenizer file's library does; see the module."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer or added prefix is needed")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        raw = lambda s: bytes(shown[c] for c in s)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.ranks = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[raw(a), raw(b)] = r
        self.trie, self.ends = [{}], [None]
        for word in model["vocab"]:
            if word in self.special:
                continue
            at = 0
            for b in raw(word):
                if b not in self.trie[at]:
                    self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                at = self.trie[at][b]
            self.ends[at] = raw(word)
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.classes, (self.next, self.cut) = _classes(), _splitter()
        self.clear()

    # ------------------------------------------------------------ the merger

    def clear(self) -> None:
        self.states, self.known, self.pairs = {((0, None, 0),): 0}, [((0, None, 0),)], {}
        self.size = 0
        self.room(1 << 16)

    def room(self, slots: int) -> None:
        """A hash table of so many slots with what was in the old one."""
        old = (self.keys[k := self.keys >= 0], self.to[k], self.step[k]) if self.size else None
        self.mask, self.shift = slots - 1, np.uint64(64 - (slots - 1).bit_length())
        self.keys, self.to, self.step = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int16)
        self.size = 0
        for key, to, step in zip(*old) if old else ():
            self.put(int(key), int(to), int(step))

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def put(self, key: int, to: int, step: int) -> None:
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[at] >= 0:
            at = (at + 1) & self.mask
        self.keys[at], self.to[at], self.step[at] = key, to, step
        self.size += 1

    def paired(self, a: bytes, b: bytes) -> bool:
        """Is a, b the encoding of its own bytes?"""
        got = self.pairs.get((a, b))
        if got is None:
            text, ranks = a + b, self.ranks
            parts = [text[i:i + 1] for i in range(len(text))]
            while len(parts) > 1:
                r, i = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
                if r == 1 << 30:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            got = self.pairs[a, b] = parts == [a, b]
        return got

    def compile(self, key: int) -> None:
        """The transition of one state on one byte."""
        state, byte = divmod(key, 256)
        still, token, count = [], None, 0
        for node, last, at in self.known[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            end = self.ends[child]
            if token is None and end is not None and (last is None or self.paired(last, end)):
                token, count = end, at + 1
            if self.trie[child]:
                still.append((child, last, at))
        new = (*((n, t, a - count) for n, t, a in still), (0, token, 0))
        to = self.states.setdefault(new, len(self.known))
        if to == len(self.known):
            self.known.append(new)
        self.put(key, to, count)

    def afresh(self, states: np.ndarray) -> np.ndarray:
        """Empties the table of all but these states; their new numbers."""
        used, at = np.unique(states, return_inverse=True)
        kept = [self.known[s] for s in used.tolist()]
        self.clear()
        for state in kept:
            if self.states.setdefault(state, len(self.known)) == len(self.known):
                self.known.append(state)
        return np.array([self.states[state] for state in kept], np.int64)[at]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the transitions, compiled where they are new."""
        while True:
            at = self.hashed(keys)
            open_ = np.flatnonzero(self.keys[at] != keys)
            missing = []
            while len(open_):
                free = self.keys[at[open_]] < 0
                missing.append(open_[free])
                open_ = open_[~free]
                at[open_] = (at[open_] + 1) & self.mask
                open_ = open_[self.keys[at[open_]] != keys[open_]]
            new = np.unique(keys[np.concatenate(missing)]) if missing else ()
            if not len(new):
                return at
            for key in new.tolist():
                self.compile(key)
            if self.size * 2 > self.mask:
                self.room((self.mask + 1) * 4)

    def merged(self, data: np.ndarray, piece: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Token count of each text.  piece: where in data pieces start; text_at: where texts start."""
        first = np.zeros(len(piece), bool)
        first[1:] = piece[1:] // CHUNK != piece[:-1] // CHUNK
        first[np.searchsorted(piece, text_at)] = True
        start = piece[first]
        length = np.diff(np.append(start, len(data)))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        fresh = np.zeros(len(data), bool)
        fresh[piece] = True
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        state, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for j, k in enumerate(active):
            at = start[:k] + j
            from_ = np.where(fresh[at], 0, state[:k])
            if len(self.known) > MAX_STATES:  # between bytes, so that a byte adds one state a chunk at most
                from_ = self.afresh(from_)
            slot = self.find(from_ * 256 + data[at])
            state[:k] = self.to[slot]
            count[:k] += self.step[slot]
        return np.bincount(np.searchsorted(text_at, start, side="right") - 1, count, len(text_at)).astype(np.int64)

    # ---------------------------------------------------------- the splitter

    def symbols(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        cls = self.classes[points]
        last = np.zeros(len(points), bool)
        last[begins[1:] - 1] = True
        last[-1:] = True
        after = np.append(cls[1:], BLANK)
        after[last] = BLANK  # at a text's end white space stays together
        sym = cls.copy()
        gap = (cls == BLANK) & (after != BLANK)
        sym[gap] = GAP
        sym[gap & (points == 32)] = SPACE
        quote = np.flatnonzero((points == 39) & ~last)
        if len(quote):
            one = points[quote + 1]
            two = np.where(last[quote + 1], 0, points[np.minimum(quote + 2, len(points) - 1)])
            sym[quote[np.isin(one, [ord(c) for c in CONTRACTIONS[0]])]] = O2
            for a, b in CONTRACTIONS[1]:
                sym[quote[(one == ord(a)) & (two == ord(b))]] = O3
        sym[begins] += 8
        return sym

    def pieces(self, sym: np.ndarray) -> np.ndarray:
        """Marks where pieces start, by chunk state maps and a prefix scan."""
        rows = -(-len(sym) // CHUNK)
        grid = np.zeros(rows * CHUNK, np.uint8)
        grid[:len(sym)] = sym
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        nxt, cut = self.next.reshape(-1), self.cut.reshape(-1)
        maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
        one, live = np.zeros(rows, np.uint8), np.arange(rows)
        for column in grid:  # from every state, until all lead to the same
            one = nxt.take(one * 16 + column)
            if len(live):
                m = nxt.take(maps[live] * 16 + column[live, None])
                maps[live], one[live] = m, m[:, 0]
                live = live[(m != m[:, :1]).any(axis=1)]
        done = np.ones(rows, bool)
        done[live] = False
        maps[done] = one[done, None]
        step = 1
        while step < rows:  # after the round that reaches 2 * step chunks back, maps[i] is their composition
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            step *= 2
        state = np.append(np.uint8(ANY), maps[:-1, ANY])
        marks = np.empty((CHUNK, rows), bool)
        for j, column in enumerate(grid):
            at = state * 16 + column
            marks[j], state = cut.take(at), nxt.take(at)
        return marks.T.reshape(-1)[:len(sym)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Token counts of non-empty texts that hold no special string."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        marks = self.pieces(self.symbols(points, begins))
        byte_at = np.flatnonzero((data & 0xC0) != 0x80)
        return self.merged(data, byte_at[marks], byte_at[begins])

    def certain(self, text: str, at: int) -> int:
        """The first place from ``at`` on where a piece starts whatever stands
        around it, or the text's end: the class changes, but not after white
        space or an apostrophe, which may belong to what follows."""
        while at < len(text):
            points = np.frombuffer(text[at - 1:at + 4095].encode("utf-32-le"), np.uint32)
            cls = self.classes[points]
            found = np.flatnonzero((cls[1:] != cls[:-1]) & (cls[:-1] != BLANK) & (points[:-1] != 39))
            if len(found):
                return at + int(found[0])
            at += len(points) - 1
        return len(text)

    def parts(self, text: str):
        """Parts that can be counted apart, and the number of special strings between them.

        Beyond that, a long text is cut where a piece starts whatever stands around it."""
        found = self.split.split(text) if self.split else [text]
        out = []
        for part in found:
            at = 0
            while len(part) - at > SLICE:
                end = self.certain(part, at + SLICE // 2)
                out.append(part[at:end])
                at = end
            out.append(part[at:])
        return [p for p in out if p], len(found) - 1

    def counts(self, texts) -> np.ndarray:
        total, held, owner, size = np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            nonlocal size
            if held:
                np.add.at(total, owner, self.count(held))
            held.clear(), owner.clear()
            size = 0

        for i, text in enumerate(texts):
            parts, total[i] = self.parts(text)
            for p in parts:
                if size and size + len(p) > SLICE:
                    flush()
                held.append(p)
                owner.append(i)
                size += len(p)
        flush()
        return total


_MADE: dict[int, Transducer] = {}


def transducer(content: bytes) -> Transducer:
    """One per worker process and file."""
    key = hash(content)
    if key not in _MADE:
        _MADE[key] = Transducer(content)
    return _MADE[key]


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", added: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``added`` (long), which replaces one of that name.

    Counts are those of the file's library without begin, end or added tokens;
    special strings inside a text count as the one token they stand for.  Null
    and empty texts have 0 tokens.  The file is read once, by the driver.
    """
    with open(tokenizer_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def counted(texts):
        import pandas as pd
        return pd.Series(transducer(content.value).counts(texts.fillna("").tolist()))

    return docs.withColumn(added, counted(F.col(f"`{text}`")))
