"""Conversation repair and prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pytest

from catalogflow.llm import prefixtrie, registered, repair
from catalogflow.llm.common import scratch_path, table

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


# -------------------------------------------------------------------- repair

def cheapest(rows):
    """(cost, audit) for (initial, state) rows: all edits tried from every grammar state."""
    n, far = len(rows), (10 ** 9, "")

    @lru_cache(None)
    def go(i, last, inserted):
        best = (0, "") if i == n and last in ("", "a") else far
        if i < n:
            initial, state = rows[i]
            c, a = go(i + 1, last, 0)
            best = min(best, (c + 3, "D" + a))
            if state in ("sound", "truncated"):
                for to in "sua":
                    if to == "s" and last != "" or to == "u" and last not in ("", "s", "a") or to == "a" and last != "u":
                        continue
                    if initial != to and to == "s":
                        continue
                    c, a = go(i + 1, to, 0)
                    edit = ("K", 0) if initial == to else ("R", 2)
                    best = min(best, (c + edit[1] + (state == "truncated"), edit[0] + a))
        if inserted < 4:
            c, a = go(i, "a" if last == "u" else "u", inserted + 1)
            best = min(best, (c + 2, "I" + a))
        return best

    return go(0, "", 0)


def as_rows(structure):
    codes = [ord(c) - ord("A") for c in structure]
    return tuple((repair.INITIALS[c // 4], repair.STATES[c % 4]) for c in codes)


def test_repairs_are_the_cheapest_and_least(monkeypatch):
    rnd = random.Random(3)
    for n in (0, 1, 2):
        for s in product(repair.LETTERS, repeat=n):
            assert repair.Alignment("".join(s)).best() == cheapest(as_rows(s)), s
    likely = "EEIIEEII" + repair.LETTERS
    some = ["".join(rnd.choice(likely) for _ in range(rnd.randint(3, 40))) for _ in range(120)]
    for s in some:
        assert repair.Alignment(s).best() == cheapest(as_rows(s)), s
    monkeypatch.setattr(repair, "CELLS", 100)  # rows of the table recomputed in blocks
    for s in some:
        assert repair.Alignment(s).best() == cheapest(as_rows(s)), s


def plain_repair(turns, damage=True):
    """What op12 returns, conversation by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        p = zlib.crc32(key.encode()) % 20 if damage else 9
        if p == 0:
            continue
        text = "" if p == 1 else re.sub("[.!?]", "", text) if p == 2 else text
        role = "user" if p == 4 else role
        for _ in range(2 if p == 3 else 1):
            convs[conv].append((turn, role, text))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            kept = re.sub("[\x20\x09-\x0D]", "", text)
            state = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "sound"
            seen.add((role, text))
            faults.append((role[:1] if role[:1] in ("s", "u", "a") else "x", state))
        cost, audit = cheapest(tuple(faults))
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        states = [f[1] for f in faults]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        lines, i, left = [], 0, len(audit) - audit.count("D")
        for e in audit:
            want = "assistant" if left % 2 else "user"
            if e == "I":
                lines.append(f"{want}:")
            else:
                if e != "D":
                    lines.append(f"{rows[i][1] if e == 'K' else want}:{rows[i][2]}")
                i += 1
            left -= e != "D"
        out[conv] = (gaps, states.count("blank"), states.count("duplicate"), states.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_every_conversation_as_repaired_by_hand(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in registered.op12_conversation_repair(spark, SF).collect()}
    assert got == plain_repair(rows)


SCHEMA = "conv_id long, turn long, role string, text string, k string, seq int, audit string"


def test_odd_turns_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(repair, "FRAGMENT", 7)
    rnd = random.Random(8)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", ""), (1, None, "assistant", "x"), (2, 5, "user", "Q?"),
            (2, 5, "user", "Q?"), (2, 5, "assistant", "A!"), (3, 1, "", "t."), (4, 0, "tool", " \t"), (5, -3, "system", "S."),
            (6, 9007199254740993, "user", "big."), (6, 9007199254740995, "assistant", "big."), (7, 1, "user", "long " * 200000 + ".")]
    rows += [(8, t // 2, rnd.choice(["user", "assistant", "system", "umpire"]), rnd.choice(["a.", "b.", "c", "", "d!"])) for t in range(90)]
    path = scratch_path(spark, "turns")
    spark.createDataFrame([(*r, "k", 1, "x") for r in rows], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in registered.op12_conversation_repair(spark, path).collect()}
    assert got == plain_repair(rows)
    empty = scratch_path(spark, "turns")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/conversations.parquet")
    assert registered.op12_conversation_repair(spark, empty).collect() == []
    report, turns = repair.repair(spark.createDataFrame([(1, 1, "assistant", "Hello."), (1, 2, "user", "No end"), (2, 1, "user", "")],
                                                        "conv_id long, turn long, role string, text string"))
    assert [(r.k, r.audit, r.cost) for r in report.orderBy("k").collect()] == [("k1", "IKD", 5), ("k2", "D", 3)]
    assert [(r.edit, r.turn, r.role, r.text) for r in turns.orderBy("k", "seq").collect()] == [("I", None, "user", ""), ("K", 1, "assistant", "Hello.")]


# ---------------------------------------------------------------------- trie

def plain_trie(turns):
    """What op13 returns, from a dictionary of all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c, mine in own.items():
        own[c] = sorted(mine, key=lambda r: (r[0], r[1], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    for c in list(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(r[2:] for r in own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}

    def walk(p):
        leaves, saved = (0 if kids[p] else 1), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for q in kids[p]:
            a, b = walk(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in members[p] if len(seqs[c]) == len(p))
        out[p] = (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves, saved,
                  hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        walk(())
    return Counter(out.values())


def test_find_close_over_many_blocks(monkeypatch):
    rnd = random.Random(4)
    for block, n in ((2, 400), (8, 3000), (64, 9000), (64, 10)):
        monkeypatch.setattr(prefixtrie.Parens, "BLOCK", block)
        for lean in (.5, .9, .1):
            steps, depth = [1], 1
            while len(steps) < n - depth:
                step = 1 if depth == 1 or rnd.random() < (lean if len(steps) < n / 3 else .5) else -1
                steps.append(step)
                depth += step
            steps += [-1] * depth
            stack, want = [], {}
            for i, s in enumerate(steps):
                if s > 0:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            opens = np.array(sorted(want))
            assert prefixtrie.Parens(np.array(steps, np.int8)).find_close(opens).tolist() == [want[i] for i in opens]


@pytest.mark.parametrize("least", [64, 1 << 18])
def test_every_node_as_counted_from_all_prefixes(spark, monkeypatch, least):
    monkeypatch.setattr(prefixtrie, "SHARD_LEAST", least)
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, registered.op13_prefix_trie(spark, SF).collect())) == plain_trie(rows)
    rnd = random.Random(least)
    rows = [(None, 1, "user", "lost"), (-7, 1, "u", "é"), (-5, 1, None, None), (10 ** 15 + 3, None, "u", ""), (10 ** 15, 2, "u", "b" * 300000)]
    for c in range(260):
        rows += [(c, t if rnd.random() > .1 else None, rnd.choice("ua"), rnd.choice(["same", "other", "é"])) for t in range(rnd.choice([1, 2, 3, 12]))]
    rows += [(c, t, "user", "copied") for c in range(1000, 1300) for t in range(3)] + [(2001, t, "user", f"t{t % 7}") for t in range(600)]
    path = scratch_path(spark, "turns")
    spark.createDataFrame([(*r, "h", 1, "p") for r in rows], "conv_id long, turn long, role string, text string, hash string, n int, path string").write.parquet(
        f"{path}/conversations.parquet")
    assert Counter(map(tuple, registered.op13_prefix_trie(spark, path).collect())) == plain_trie(rows)


def test_no_conversations_make_no_nodes(spark):
    path = scratch_path(spark, "turns")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    assert registered.op13_prefix_trie(spark, path).collect() == []
