"""Conversation structure repair: the cheapest edits that make a conversation
alternate.

A conversation's turns are aligned to the grammar strings ``""``, ``(ua)^k`` and
``s(ua)^k`` (initials of system, user, assistant) by Wagner-Fischer tables:
keep 0, rerole 2, insert 2, delete 3, and 1 more for a truncated turn that
stays.  Blank and repeated turns can only be deleted.  All lengths end alike, so
a table filled from the last turn holds every feasible length at once; cells
outside Ukkonen's band, which an incumbent repair's cost bounds, are not
computed.  Every cheapest length is traced back and the least audit taken.

Turns are numbered and letters joined by Spark; only a string of one letter per
turn is ever held for a conversation.  Texts are shuffled once, when the audit
is applied to a conversation's turns in order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogflow.operators.numbering import number_rows

from .common import fresh_name

KEEP, REROLE, INSERT, DELETE, CUT = 0, 2, 2, 3, 1
ROLES = {"u": "user", "a": "assistant"}
FRAGMENT = 4096        # letters that one aggregation buffer joins
MEMO = 20_000          # short structures whose repair a task remembers
CELLS = 1 << 25        # cells of a table held at once; beyond, rows are recomputed from every so manieth
FAR = np.int32(1 << 29)

# A turn's letter: the role's initial (s, u, a, else x), and how it stands:
# sound, truncated, blank, repeated.
INITIALS, STATES = "suax", ("sound", "truncated", "blank", "duplicate")
LETTERS = "".join(chr(ord("A") + i) for i in range(len(INITIALS) * len(STATES)))


def letter(initial: Column, state: Column) -> Column:
    """The letter of a turn from its role's initial and its state."""
    i = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    s = F.when(state == STATES[0], 0).when(state == STATES[1], 1).when(state == STATES[2], 2).otherwise(3)
    return F.substring(F.lit(LETTERS), (i * 4 + s + 1).cast("int"), F.lit(1))


class Alignment:
    """The tables of one conversation, filled from its last turn.

    ``plain[i][r]`` is the least cost of making turns i.. the last r letters of
    ``uaua...``; ``led[i][r]`` that of making them an s and r such letters."""

    def __init__(self, structure: str):
        codes = np.frombuffer(structure.encode(), np.uint8).astype(np.int32) - ord("A")
        self.initial, state = codes // 4, codes % 4
        self.n, self.gone, self.cut = len(codes), state >= 2, (state == 1).astype(np.int32)
        self.left = np.concatenate([np.cumsum((~self.gone)[::-1])[::-1], [0]]).astype(np.int64)
        floor = int(np.where(self.gone, DELETE, self.cut).sum())
        spare = self._incumbent() - floor
        # each insertion costs 2, each avoidable deletion 2 more than keeping
        self.band = spare // 2 + 1
        self.width = int(self.left[0] + self.band + 2)
        span = min(self.width, 2 * self.band + 4)
        self.step = 1 if (self.n + 1) * span <= CELLS else math.isqrt(self.n) + 1
        self.kept: dict[int, tuple] = {}
        self.block: dict[int, tuple] = {}
        row = self._last()
        self.kept[self.n] = row
        for i in range(self.n - 1, -1, -1):
            row = self._row(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def _incumbent(self) -> int:
        """Cost of a plain repair: what does not fit is reroled, gaps are filled."""
        cost, want, first = 0, "u", True
        everything = DELETE * self.n
        for i, gone, cut in zip(self.initial, self.gone, self.cut):
            if gone:
                cost += DELETE
                continue
            c = INITIALS[i]
            if c == "s" and first:
                cost += KEEP + int(cut)
            elif c == want:
                cost, want = cost + KEEP + int(cut), "a" if want == "u" else "u"
            elif c in "ua":
                cost += INSERT + KEEP + int(cut)
            else:
                cost, want = cost + REROLE + int(cut), "a" if want == "u" else "u"
            first = False
        if want == "a":
            cost += INSERT
        elif not first and self.left[0] == 1:
            cost += 2 * INSERT
        return min(cost, everything)

    def _bounds(self, i: int) -> tuple[int, int]:
        k = int(self.left[i])
        return max(0, k - self.band - 1), min(self.width, k + self.band + 1)

    def _last(self):
        lo, hi = self._bounds(self.n)
        r = np.arange(lo, hi + 1, dtype=np.int32)
        return lo, INSERT * r, np.full(len(r), FAR, np.int32)

    @staticmethod
    def _slice(values, lo, frm, to):
        """values[frm..to] of a row that starts at lo; FAR outside it."""
        out = np.full(to - frm + 1, FAR, np.int32)
        a, b = max(frm, lo), min(to, lo + len(values) - 1)
        if a <= b:
            out[a - frm:b - frm + 1] = values[a - lo:b - lo + 1]
        return out

    def _row(self, i: int, below):
        plo, pplain, pled = below
        lo, hi = self._bounds(i)
        r = np.arange(lo, hi + 1, dtype=np.int32)
        plain = self._slice(pplain, plo, lo, hi) + DELETE
        led = self._slice(pled, plo, lo, hi) + DELETE
        if not self.gone[i]:
            c = self.initial[i]
            fits = (c == 2) & (r % 2 == 1) | (c == 1) & (r % 2 == 0)
            diag = self._slice(pplain, plo, lo - 1, hi - 1) + np.where(fits, KEEP, REROLE).astype(np.int32) + self.cut[i]
            if lo == 0:
                diag[0] = FAR
            plain = np.minimum(plain, diag)
            if c == 0:
                kept = self._slice(pplain, plo, lo, hi) + KEEP + self.cut[i]
                kept[(r % 2 == 1) | (r == 0)] = FAR
                led = np.minimum(led, kept)
        plain = np.minimum.accumulate(plain - INSERT * r) + INSERT * r
        return lo, np.minimum(plain, FAR), np.minimum(led, FAR)

    def row(self, i: int):
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            top = min(((i // self.step) + 1) * self.step, self.n)
            row, self.block = self.kept[top], {}
            for j in range(top - 1, (i // self.step) * self.step, -1):
                row = self._row(j, row)
                self.block[j] = row
        return self.block[i]

    def at(self, i: int, r: int, led: bool) -> int:
        lo, plain, s = self.row(i)
        values = s if led else plain
        return int(values[r - lo]) if 0 <= r - lo < len(values) else int(FAR)

    def best(self) -> tuple[int, str]:
        """(cost, audit): the least cost over all target lengths, and of the
        audits that reach it the least."""
        lo, plain, led = self.row(0)
        even = (np.arange(lo, lo + len(plain)) % 2) == 0
        plain, led = np.where(even, plain, FAR), np.where(even, led, FAR)
        cost = int(min(plain.min(), led.min()))
        ends = [(lo + int(k), False) for k in np.nonzero(plain == cost)[0]] + [(lo + int(k), True) for k in np.nonzero(led == cost)[0]]
        return cost, min(self.trace(r, s) for r, s in ends)

    def trace(self, r: int, led: bool) -> str:
        """The least audit among the cheapest ways to the target of this length."""
        i, out = 0, []
        while i < self.n or r > 0 or led:
            here = self.at(i, r, led)
            if i < self.n and self.at(i + 1, r, led) + DELETE == here:
                out.append("D")
                i += 1
            elif led:
                out.append("K")
                i, led = i + 1, False
            elif r > 0 and self.at(i, r - 1, False) + INSERT == here:
                out.append("I")
                r -= 1
            else:
                fits = self.initial[i] == (2 if r % 2 == 1 else 1)
                out.append("K" if fits else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def repaired_structure(structure: str) -> tuple[int, int, int, int, int, str]:
    """(blank, duplicate, truncated, illegal, cost, audit) of a string of letters."""
    codes = [ord(c) - ord("A") for c in structure]
    states = [c % 4 for c in codes]
    initials = "".join(INITIALS[c // 4] for c in codes)
    illegal = sum(initials[k:k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
    cost, audit = Alignment(structure).best()
    return states.count(2), states.count(3), states.count(1), illegal, cost, audit


def key_of(c: str) -> Column:
    """A conversation's key as text; a null id has one of its own."""
    return F.coalesce(F.concat(F.lit("k"), F.col(f"`{c}`").cast("string")), F.lit("n"))


def _standing(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    t, r = F.coalesce(F.col(f"`{text}`"), F.lit(" ")), F.coalesce(F.col(f"`{role}`"), F.lit(" "))
    return turns.select(key_of(conv).alias("k"), F.col(f"`{turn}`").alias("turn"), r.alias("role"), t.alias("text"),
                        F.md5(F.concat(r, F.lit("\x00"), t)).alias("h"))


ORDER = ("turn", "role", "h")   # a conversation's order: turn (nulls first), ties by role and content


def reports(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``k`` (its key as text), ``n_turns``, ``gaps``,
    ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    A null conversation id is a conversation of its own; null role and text are
    one space (a blank turn).  Turns are taken by turn number, nulls first, ties
    by role and content.  An empty table gives no rows.  Other columns, whatever
    their names, play no part."""
    rows = _standing(turns, conv, turn, role, text)
    narrow = rows.select(
        "k", "turn", "role", "h", F.substring("role", 1, 1).alias("initial"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
         .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("sound").alias("state"))
    placed = number_rows(narrow, [F.col(c) for c in ORDER], ("k",), "pos")
    first = placed.groupBy("k", "h").agg(F.min("pos").alias("first"))
    placed = placed.join(first, ["k", "h"])
    state = F.when((F.col("state") != "blank") & (F.col("pos") > F.col("first")), F.lit("duplicate")).otherwise(F.col("state"))
    lettered = placed.select("k", "turn", "pos", letter(F.col("initial"), state).alias("c"))
    part = lettered.groupBy("k", (F.col("pos") / FRAGMENT).cast("long").alias("f")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("s"),
        F.min("turn").alias("lo"), F.max("turn").alias("hi"),
        F.array_size(F.collect_set("turn")).cast("long").alias("d"), F.count(F.lit(1)).alias("n"))
    # a turn number that two fragments share counts once: fragments are in turn order
    w = Window.partitionBy("k").orderBy("f")
    part = part.withColumn("d", F.col("d") - F.coalesce((F.lag("hi").over(w) == F.col("lo")).cast("long"), F.lit(0)))
    whole = part.groupBy("k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "s"))), lambda x: x["s"]), "").alias("structure"),
        F.sum("n").alias("n_turns"), F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("d"), F.lit(0)).cast("long").alias("gaps"))

    def align(batches):
        memo: dict[str, tuple] = {}
        for pdf in batches:
            found = []
            for s in pdf["structure"]:
                hit = memo.get(s)
                if hit is None:
                    hit = repaired_structure(s)
                    if len(s) <= 64 and len(memo) < MEMO:
                        memo[s] = hit
                found.append(hit)
            out = pdf[["k", "n_turns", "gaps"]].copy()
            for j, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost", "audit")):
                out[name] = pd.Series([x[j] for x in found], index=out.index, dtype=object if name == "audit" else "int64")
            yield out

    return whole.select("k", "n_turns", "gaps", "structure").mapInPandas(
        align, "k string, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(turns: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """The turns of the repaired conversations: ``k``, ``seq``, ``edit`` (K, R or
    I), ``turn`` (null if inserted), ``role``, ``text``.

    A conversation's audit comes before its turns in one sorted stream, so a
    task holds one audit and one batch of turns, however long the conversation.
    Rows come partitioned by ``k`` and in order."""
    rows = _standing(turns, conv, turn, role, text)
    turn_type = rows.schema["turn"].dataType
    heads = report.select("k", F.lit(0).alias("kind"), F.lit(None).cast(turn_type).alias("turn"), F.lit("").alias("role"),
                          F.lit("").alias("h"), F.col("audit").alias("text"))
    stream = heads.unionByName(rows.withColumn("kind", F.lit(1))).repartition("k").sortWithinPartitions("k", "kind", *ORDER)

    def apply(batches):
        state = Edits()
        for pdf in batches:
            for k, kind, number, who, said in zip(pdf["k"], pdf["kind"], pdf["turn"], pdf["role"], pdf["text"]):
                if kind == 0:
                    state.finish()
                    state.start(k, said)
                else:
                    state.take(number, who, said)
            yield state.rows()
        state.finish()
        yield state.rows()

    out = stream.select("k", "kind", F.col("turn").cast("string").alias("turn"), "role", "text").mapInPandas(
        apply, "k string, seq long, edit string, turn string, role string, text string")
    return out.withColumn("turn", F.col("turn").cast(turn_type))


class Edits:
    """An audit applied to turns as they come."""

    COLUMNS = ("k", "seq", "edit", "turn", "role", "text")

    def __init__(self):
        self.key, self.audit, self.i, self.seq, self.out = None, "", 0, 0, []
        self.left = 0

    def start(self, key, audit):
        self.key, self.audit, self.i, self.seq = key, audit, 0, 0
        self.left = len(audit) - audit.count("D")   # letters of the target still to come

    def _emit(self, edit, number, role, text):
        self.out.append((self.key, self.seq, edit, number, role, text))
        self.seq, self.left = self.seq + 1, self.left - 1

    def _wanted(self):
        return ROLES["a" if self.left % 2 == 1 else "u"]

    def _inserts(self):
        while self.i < len(self.audit) and self.audit[self.i] == "I":
            self.i += 1
            self._emit("I", None, self._wanted(), "")

    def take(self, number, role, text):
        self._inserts()
        edit = self.audit[self.i]
        self.i += 1
        if edit == "K":
            self._emit("K", number, role, text)
        elif edit == "R":
            self._emit("R", number, self._wanted(), text)

    def finish(self):
        if self.key is not None:
            self._inserts()

    def rows(self):
        done, self.out = self.out, []
        return pd.DataFrame(done, columns=list(self.COLUMNS))


def repair(turns: DataFrame, conv: str = "conv_id", **names) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns); the report is stored, as both results read it."""
    from .common import materialize
    report = materialize(reports(turns, conv, **names), "repair")
    return report, repaired(turns, report, conv, **names)


def digests(rows: DataFrame, out: str = "sha256") -> DataFrame:
    """``k`` and the SHA-256 of a conversation's ``role:text`` lines joined by
    line ends, from rows that come partitioned by ``k`` and in order."""
    name = fresh_name(out, ["k"])

    def hashed(batches):
        import hashlib
        key, h = None, None
        for pdf in batches:
            done = []
            for k, who, said in zip(pdf["k"], pdf["role"], pdf["text"]):
                if k != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{who}:{said}".encode())
            yield pd.DataFrame(done, columns=["k", name])
        if key is not None:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["k", name])

    return rows.select("k", "role", "text").mapInPandas(hashed, f"k string, {name} string")
