"""WARC revisits, cover trees, mixing, URL lists, MinHash, line templates, pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogflow.llm import covertree, graph, minhash, mixing, templates, urllists, warc
from catalogflow.llm.common import scratch_path

WS = "[\x20\x09-\x0D]+"


def words(t):
    return [w for w in re.split(WS, t or "") if w]


def syllables(rnd, n):
    return " ".join("".join(rnd.choice(["an", "er", "on", "th", "is", "ou"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


# ---------------------------------------------------------------------- WARC

def test_archives_round_trip(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1 x" * 100, "y" * 999
    rows = [(1, "http://a/ b\r\nWARC-Type: x", big), (5, "http://b", big), (3, None, big), (2, "u", other), (4, "u", other),
            (6, "u", None), (7, "u", ""), (8, "u", "z" * 1000), (9, "u", "z" * 5000000), (None, "u", big), (5, "again", big)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch_path(spark, "warc-test")
    warc.write_deduplicated(warc.records_of(df), path, archive_bytes=20_000)
    read = warc.read_archives(spark, path)
    got = read.collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    held = Counter(bytes(r.payload).decode() for r in got if r.record_type == "response")
    assert held == Counter([big, other, other, "", "", "z" * 1000, "z" * 5000000])
    types = Counter((r.key, r.record_type, r.refers_to, r.n_bytes) for r in warc.resolved(read).collect())
    n = len(big.encode())
    want = [(1, "revisit", 5, n), (5, "response", None, n), (5, "revisit", 5, n), (3, "revisit", 5, n), (None, "revisit", 5, n),
            (2, "response", None, 999), (4, "response", None, 999), (6, "response", None, 0), (7, "response", None, 0),
            (8, "response", None, 1000), (9, "response", None, 5000000)]
    assert types == Counter(want)
    empty = scratch_path(spark, "warc-test")
    warc.write_deduplicated(warc.records_of(df.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_revisit_records_resolve_to_their_original(spark):
    pages = spark.createDataFrame([(1, "u", "short"), (2, "v", "long" * 300)], "page_id long, url string, html string")
    first = scratch_path(spark, "warc-test")
    warc.write_deduplicated(warc.records_of(pages), first)
    read = warc.read_archives(spark, first).select("key", "uri", F.col("payload").cast("string").alias("payload"), "digest",
                                                   "n_bytes", F.col("record_type").alias("given_type"))
    again = read.select((F.col("key") + 10).alias("key"), "uri", F.lit("").alias("payload"), "digest",
                        F.lit(0).cast("long").alias("n_bytes"), F.lit("revisit").alias("given_type"))
    path = scratch_path(spark, "warc-test")
    warc.write_deduplicated(read.unionByName(again), path)
    got = {r.key: (r.record_type, r.refers_to, r.n_bytes) for r in warc.resolved(warc.read_archives(spark, path)).collect()}
    assert got == {1: ("response", None, 5), 2: ("response", None, 1200), 11: ("revisit", 1, 5), 12: ("revisit", 2, 1200)}


# ---------------------------------------------------------------- cover tree

def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_cosine_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(covertree, "PART", 120)
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(30, 16))
    x = np.concatenate([rnd.normal(size=(150, 16)), *[b + rnd.normal(size=(12, 16)) * s for b, s in zip(base, np.linspace(0.02, 0.5, 30))],
                        np.repeat(base[:1], 40, axis=0), 7 * base[:1]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(len(x) + i, v) for i, v in enumerate(bad)] + [(None, [3.0, 6.0, 1.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, node string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = components(len(x), zip(*np.nonzero(near)))
    want = {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}
    want |= {len(x) + i: (0, len(x) + i, True) for i in range(6)}
    want |= {len(x) + 6: (1, len(x) + 6, True), len(x) + 7: (1, len(x) + 6, False), None: (0, None, True)}
    got = {r.key: (r.n_links, r.component_id, r.kept) for r in covertree.cosine_links(df).collect()}
    assert got == want


@pytest.mark.parametrize("cosine", [0.6, 0.95])
def test_dual_traversal_in_memory(cosine):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=(300, 8)), rnd.normal(size=8) + 0.05 * rnd.normal(size=(200, 8)), rnd.normal(size=8) + 0.3 * rnd.normal(size=(200, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rnd.integers(1, 4, len(x))
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    count, (a, b) = covertree.linked(x, None, w, None, cosine)
    np.testing.assert_array_equal(count, near @ w)
    assert components(len(x), zip(a, b)) == components(len(x), zip(*np.nonzero(near)))
    count, _ = covertree.linked(x[:350], x[350:], w[:350], w[350:], cosine)
    np.testing.assert_array_equal(count, np.concatenate([near[:350, 350:] @ w[350:], near[350:, :350] @ w[:350]]))


def test_cosine_links_of_an_empty_table(spark):
    assert covertree.cosine_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(5, 5), (None, 3), (7, 6)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


# -------------------------------------------------------------------- mixing

def water(size, weight, share=1.5, cap=2.0):
    total, top, full = share * sum(size), [cap * s for s in size], set()
    while True:
        left, w = total - sum(top[i] for i in full), sum(x for i, x in enumerate(weight) if i not in full)
        over = {i for i in range(len(size)) if i not in full and top[i] <= left * weight[i] / w} if w else set()
        if not over:
            return [top[i] if i in full else left * weight[i] / w for i in range(len(size))]
        full |= over


def test_mix_meets_targets(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        source = rnd.choice(["b", "b", "b", "b", "a", "Z", "é", None])
        rows.append((i, rnd.choice([None, "", " ", syllables(rnd, rnd.randint(1, 600))] if i % 9 == 0 else [syllables(rnd, rnd.randint(1, 600))]), source, 1))
    rows += [rows[5], rows[5], (None, "null key words", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = [r.asDict() for r in mixing.mix_documents(df)[0].collect()]
    again = [r.asDict() for r in mixing.mix_documents(df.repartition(7))[0].collect()]
    order = lambda rs: sorted(map(repr, rs))
    assert len(out) == len(rows) and order(out) == order(again)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in size if s is not None)) + [None]
    assert {r["key"]: r["size"] for r in out} == {d: len(words(t)) for d, t, _, _ in rows}
    want = water([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, w in zip(names, want):
        assert target[s] == pytest.approx(w)
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS + 0.01 * target[s]
    texts = mixing.mixed_texts(df).collect()
    assert sum(len(words(r.text)) for r in texts) >= sum(taken.values()) - 3 * 1200
    assert {r.text for r in texts} & {t for _, t, _, _ in rows if t}
    assert mixing.mix_documents(df.limit(0))[0].count() == 0


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 4, 5, 64, 65, 1000, 4097):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 3), 7)
        assert sorted(got.tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, r), 7) for r in (1, 2))
    assert (a == b).mean() < 0.02 and (a == np.arange(1000)).mean() < 0.02


def test_draws_fill_the_shard():
    p = np.array([0.5, 0.3, 0.2])
    got = np.array([mixing.drawn(i, 1001, p, 1) for i in range(300)])
    assert (got.sum(axis=1) == 1001).all() and np.allclose(got.mean(axis=0) / 1001, p, atol=1e-3)


# ----------------------------------------------------------------- URL lists

def test_captures_meet_the_entries_of_their_day(spark):
    rnd = random.Random(9)
    domains = ["com", "a.com", "b.a.com", "c.b.a.com", "x.org"]
    entries = [(rnd.choice(["l1", "l2", "l3"]), rnd.random() < 0.3, rnd.choice(domains), rnd.choice(["add", "remove"]), rnd.randint(100, 400)) for _ in range(120)]
    entries += [(None, False, "a.com", "add", 1), ("l1", False, None, "add", 1), ("l1", False, "a.com", "other", 1), ("l1", False, "A.com", "add", None)]
    urls = ["http://C.b.a.com/x", "https://u:p@a.com.:80/?q", "http://b.a.com", "http://x.org#f", "mailto:x", "", None, "http://z.net", "http://"]
    captures = [(i, rnd.choice(urls), rnd.choice([None, *range(8_000_000, 40_000_000, 777_777)]), "clash") for i in range(300)]
    cap = spark.createDataFrame(captures, "page_id long, url string, fetch_time long, host string")
    ent = spark.createDataFrame(entries, "list string, allow boolean, domain string, action string, day long")
    out = urllists.evaluate(cap, urllists.validity_intervals(ent), bucket_days=7).collect()
    state = defaultdict(dict)
    for lst, allow, domain, action, day in entries:
        if None not in (lst, domain, day) and action in ("add", "remove"):
            old = state[lst, domain.lower()].get(day, (False, False))
            state[lst, domain.lower()][day] = (old[0] or action == "add", old[1] or allow and action == "add")
    assert len(out) == len(captures)
    for r in out:
        found = []
        if r.host and r.fetch_day is not None:
            for (lst, domain), days in state.items():
                past = [d for d in days if d <= r.fetch_day]
                if past and days[max(past)][0] and ("." + r.host).endswith("." + domain):
                    found.append((-domain.count("."), not days[max(past)][1], lst, domain))
        best = min(found, default=(0, False, None, None))
        assert (r.n_active, r.matched_list, r.matched_domain, r.blocked) == (len(found), best[2], best[3], best[1])
    assert {r.host for r in out} == {"c.b.a.com", "a.com", "b.a.com", "x.org", None, "z.net"}
    assert urllists.evaluate(cap.limit(0), urllists.validity_intervals(ent)).count() == 0
    assert urllists.evaluate(cap, urllists.validity_intervals(ent.limit(0))).where("n_active > 0").count() == 0


# ------------------------------------------------------------------- MinHash

def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def copies(rnd):
    docs = [None, None, "", " \n", "one two", "One  TWO", "É a b c d", "é a b c d"]
    for _ in range(25):
        w = syllables(rnd, rnd.randint(30, 200)).split()
        docs.append(" ".join(w))
        for _ in range(rnd.randint(0, 14)):
            v = list(w)
            for _ in range(rnd.randint(0, 6)):
                v[rnd.randrange(len(v))] = "x%d" % rnd.randrange(10 ** 6)
            docs.append(" ".join(v))
    return docs


@pytest.mark.parametrize("tile", [1024, 5])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)  # clusters of one tile, and of many
    docs = copies(random.Random(10))
    sets = [shingles(t) for t in docs]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and sets[j]
             and 100 * len(a & sets[j]) >= 75 * len(a | sets[j])]
    comp = components(len(docs), pairs)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, node string")
    got = {r.key: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in range(len(docs))}


def test_one_of_each_group_stays(spark):
    text = syllables(random.Random(1), 60)
    rows = [(3, text), (2, text), (2, text), (None, text + " end"), (None, "alone in the world here"), (7, None), (8, ""), (9, "w")]
    out = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(2, text), (0, "alone in the world here"), (7, ""), (8, ""), (9, "w")])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketches_estimate_the_similarity():
    rnd = np.random.default_rng(2)
    for share in (0.6, 0.75, 0.9):
        got, n = [], 2000
        for _ in range(60):
            x = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = round(n * (1 - share) / (1 + share))
            y = np.concatenate([x[cut:], rnd.integers(0, 1 << 63, cut, dtype=np.uint64)])
            a, b = (minhash.odd_sketch(minhash.min_hashes(s)).view(np.uint8) for s in (x, y))
            bits = int(np.unpackbits(a ^ b).sum())
            got.append(float(minhash.similarity_of(bits)))
        assert abs(np.mean(got) - share) < 0.03


# ------------------------------------------------------------ line templates

def test_recurring_templates_go_and_variables_generalise(spark):
    rnd = random.Random(12)
    body = lambda: syllables(rnd, 40)
    docs = []
    for i in range(12):
        lines = [body(), f"posted by user {i} on 2020-01-{i + 1} in the forum", "share this page with your friends today"]
        if i < 8:
            lines.append(f"you may read more about {rnd.choice(['cats', 'dogs', 'owls', 'bees'])} in our big weekly letter now")
        docs.append((i, "\n".join(lines) + "\n\n", i))
    docs += [(20, None, 0), (21, "", 0), (22, "share this page with your friends today", 0), (23, "share this page with your friends today\n" * 9, 0),
             (None, "share  this page\twith your friends today\n" + body(), 0), (1, docs[1][1], 0)]
    out = templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string, n_lines int")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(docs) and got[0].text == docs[0][1]           # the first document keeps its lines
    for i in range(1, 12):
        assert got[i].text == docs[i][1].split("\n")[0] + "\n\n", i
        assert (got[i].n_lines, got[i].n_dropped) == (4, 3) if i < 8 else (3, 2)
    assert got[20].text is None and got[21].text == "" and not got[21].emptied
    assert got[22].emptied and got[23].n_dropped == 9 and got[None].n_dropped == 1
    assert templates.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_that_only_share_their_head_stay(spark):
    rnd = random.Random(13)
    docs = [(i, "the one and only " + syllables(rnd, 12)) for i in range(30)]
    out = templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert out.agg(F.sum("n_dropped")).first()[0] == 0


def test_native_operators_run_no_python(spark):
    from catalogflow.llm import quality
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s")] * 3, "doc_id long, text string, lang string, source string")
    for df in (quality.quality_outliers(docs), templates.drop_recurring_lines(docs.select("doc_id", "text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ pipeline

def test_pipeline_on_planted_documents(spark):
    import corpus_pipeline
    rnd = random.Random(14)
    make = {"aa": ["an", "er", "on", "th"], "bb": ["ko", "zu", "mi", "ra"]}
    text = lambda lang, n: " ".join("".join(rnd.choice(make[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, f"{text(lang := rnd.choice(['aa', 'bb']), 60)}\nsubscribe to the letter now", lang, rnd.choice(["s1", "s2"]), 0) for i in range(120)]
    long = text("aa", 120)
    rows += [(200 + i, long + f" tail{i}", "aa", "s1", 0) for i in range(4)] + [(300, "12 34 !!", "aa", "s1", 0), (301, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path, kept = scratch_path(spark, "pipeline-test"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, path)
        if name != "sentencepiece":
            assert docs.columns == before.columns
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = docs.collect()
    ids = {n: [r.doc_id for r in k] for n, k in kept.items()}
    assert not {300, 301} & set(ids["language_id"]) and set(range(120)) <= set(ids["language_id"])
    shared = [r.doc_id for r in kept["line_dedup"] if "subscribe" in r.text]
    assert shared == [0] and len(ids["line_dedup"]) == 124
    assert set(ids["near_dedup"]) == {*range(120), 200}
    got, size = Counter(), Counter()
    for r in kept["near_dedup"]:
        size[r.source] += len(words(r.text))
    for r in kept["source_mix"]:
        got[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = dict(zip(["s1", "s2"], water([size["s1"], size["s2"]], [5, 2])))
    assert all(abs(got[s] - want[s]) <= 3 * mixing.BLOCK_WORDS for s in want)
    assert len(kept["sentencepiece"]) == len(kept["source_mix"]) and all(r.round_trip for r in kept["sentencepiece"])


def test_odd_sketches_hardly_turn_true_pairs_away():
    # exact: each slot that differs flips two random bits
    bits, k = minhash.BITS, np.arange(minhash.BITS + 1)
    p, lost = np.eye(1, bits + 1)[0], 0.0
    for d in range(minhash.SLOTS + 1):
        lost += math.comb(minhash.SLOTS, d) * 0.25 ** d * 0.75 ** (minhash.SLOTS - d) * p[minhash.SKETCH_LIMIT + 1:].sum()
        for _ in range(2):
            p = np.append(0, (p * (bits - k) / bits)[:-1]) + np.append((p * k / bits)[1:], 0)
    assert lost < 1e-6
