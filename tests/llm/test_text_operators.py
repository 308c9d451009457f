"""Quality statistics, outliers, token counts, language ID and segmentations."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalogflow.llm import langid, quality, sampling, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WS = "[\x20\x09-\x0D]+"


def words(t):
    return [w for w in re.split(WS, t or "") if w]


def statistics(t):
    w = words(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit))


def odd_texts(n=150):
    rnd = random.Random(3)
    out = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\nx ", "é𝄞 #$%\x85x\xa0y", "w " * 5000, "\r\n\x0b\x0cA\x0bB"]
    for _ in range(n):
        out.append("".join(rnd.choice(["ab", "c", " ", " ", "\n", "d e f", "é", "#", "'s", "12"]) for _ in range(rnd.randint(1, 120))))
    return out


def test_base_statistics_match_a_plain_count(spark):
    texts = odd_texts()
    df = spark.createDataFrame([Row(doc_id=i, text=t, _t="clash", n_words="clash") for i, t in enumerate(texts)],
                               "doc_id long, text string, _t string, n_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality.base_statistics(df, keep=("doc_id",)).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def mcd(z, steps=4):
    """The same estimate in numpy: two starts, C-steps on distance buckets, one reweighting."""
    x, p = z / quality.UNIT, quality.P
    floor = np.diag(np.array(quality.FLOORS) ** 2)
    cov = lambda a, f: np.cov(a.T, bias=True).reshape(p, p) * f + floor
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    runs = [(x.mean(0), cov(x, 1.0)), (q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, quality.FLOORS) ** 2))]
    best = []
    for m, c in runs:
        for _ in range(steps):
            b = np.floor(np.log2(dist(m, c) + 2.0 ** -10) * 16)
            top = np.sort(b)[math.ceil(len(b) * quality.ALPHA) - 1]
            h = x[b <= top]
            m, c = h.mean(0), cov(h, quality.SUBSET_FACTOR)
        best.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(best, key=lambda t: t[0])
    near = x[dist(m, c) <= quality.WEIGHT_LIMIT]
    return dist(near.mean(0), cov(near, quality.WEIGHT_FACTOR))


def test_outliers_match_numpy_and_find_the_planted(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(700):
        n = int(rnd.integers(60, 900))
        odd = i % 50 == 0
        rows.append((i, "en" if i < 400 else None, "s1" if i % 3 else "s2", n, int(n * rnd.normal(4.2, 0.12)),
                     int(n * 2.5) if odd else int(rnd.integers(0, 2)), int(rnd.integers(0, 2)), int(n * rnd.uniform(0, 0.2))))
    rows += [(1000, "en", "s1", 3, 9, 0, 0, 0), (1001, "xx", "s9", 100, 420, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
                                     "n_dup_lines long, n_repeat_words long")
    got = {r.doc_id: r for r in quality.mcd_outliers(df).collect()}
    assert {i for i, r in got.items() if not r.kept} == {*range(0, 700, 50), 1000}
    assert got[1000].mahalanobis2 is None and got[1000].base_failed
    z = np.array([list(r) for r in df.where("doc_id < 400 and source = 's1'").select(*quality.transformed()).collect()])
    ids = [r.doc_id for r in df.where("doc_id < 400 and source = 's1'").collect()]
    np.testing.assert_allclose([got[i].mahalanobis2 for i in ids], mcd(z), rtol=1e-6, atol=1e-9)


def test_outliers_of_empty_and_small_tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert quality.quality_outliers(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, None, None, None), (2, "w" * 9 + " x" * 60, "en", None), (2, "a b " * 40, "en", "s")], schema)
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in quality.quality_outliers(df).collect())
    assert got == [(1, True, False), (2, True, False), (2, True, False)]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rnd = random.Random(1)
    signs = list("aAsStTmMdDlLrReEvV'''  \n\t  .!?-—é日😀0١²_") + ["<|endoftext|>", "<|endof"]
    texts = [None, "", "don't we'll 's !'s", " \n\n x\t\ty 　z ", "x" * 3000, "-" * 2000 + " " * 500, "日本語" * 200, "\x00\x1c\x85"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 90))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, path).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts_of_long_texts_and_a_full_table():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, made = Tokenizer.from_file(path), tokens.Transducer(open(path, "rb").read())
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(20000))
    want = len(lib.encode(text, add_special_tokens=False).ids)
    assert made.counts([text]).tolist() == [want]
    old = tokens.SLICE, tokens.MAX_STATES
    try:
        tokens.SLICE, tokens.MAX_STATES = 5000, 4000  # many parts; a table that is emptied again and again
        made.clear()
        assert made.counts([text[:40000]]).tolist() == [len(lib.encode(text[:40000], add_special_tokens=False).ids)]
    finally:
        tokens.SLICE, tokens.MAX_STATES = old
    with pytest.raises(ValueError):
        tokens.Transducer(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())


def test_token_counts_where_one_slice_overfills_the_table(monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, made = Tokenizer.from_file(path), tokens.Transducer(open(path, "rb").read())
    monkeypatch.setattr(tokens, "MAX_STATES", 300)
    clear, cleared = made.clear, []

    def counted():
        cleared.append(1)
        assert len(cleared) < 2000, "starts again without end"
        clear()

    monkeypatch.setattr(made, "clear", counted)
    rnd = random.Random(4)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(rnd.choices(signs, k=6000)), "".join(rnd.choices(signs[:52], k=2000)), "it's", "日本語x1" * 300]
    assert made.counts(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(cleared) > 5


def test_long_texts_without_blanks_are_cut(monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, made = Tokenizer.from_file(path), tokens.Transducer(open(path, "rb").read())
    monkeypatch.setattr(tokens, "SLICE", 64)
    rnd = random.Random(5)
    for signs in (["ab", "\n", "\n", "c'll", "d"], ["a", "Z", "7", "+", "/"], ["'s", "'re", "'", "x", "!", "\u3000", " ", "\x1c"]):
        text = "".join(rnd.choices(signs, k=4000))
        assert max(map(len, made.parts(text)[0])) < 128
        assert made.counts([text]).tolist() == [len(lib.encode(text, add_special_tokens=False).ids)]


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(docs.where(part != 2))
    held = docs.where(part == 2).select("lang", langid.predict(docs, model).alias("p")).collect()
    assert len(held) > 20 and sum(r.lang == r.p.lang_pred for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(None,), ("",), ("123 !!",), ("\x01\x01",), ("zq xj vv kk qq zx wq jx " * 40,)], "text string")
    got = [r.p for r in odd.select(langid.predict(odd, model).alias("p")).collect()]
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got[:4])
    assert got[4].rejected and got[4].lang_pred in model.languages
    assert all(0 <= r.p.score <= 1 for r in held)


def invented(rnd, letters, n):
    vocabulary = ["".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(60)]
    return lambda: " ".join(rnd.choices(vocabulary, k=n))


def test_units_fill_the_share_of_every_language(spark):
    rnd = random.Random(6)
    short, long, other = invented(rnd, "abcdef", 30), invented(rnd, "klmnop", 60000), invented(rnd, "stuvwx", 30)
    rows = [("copied text " * 100, "copies")] * 3000 + [(short(), "copies") for _ in range(300)]
    rows += [(long(), "long"), (long(), "long")] + [(other(), "other") for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = langid.fit(docs, sample_chars=60000)
    got = docs.distinct().select("lang", langid.predict(docs, model)["lang_pred"].alias("p")).groupBy("lang").agg(
        F.avg((F.col("lang") == F.col("p")).cast("int")).alias("right")).collect()
    assert {r.lang: r.right >= 0.97 for r in got} == {"copies": True, "long": True, "other": True}
    found = langid.units(docs.withColumn("upto", F.lit(1 << 30))).groupBy("hash").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda u: u["text"]), "").alias("text"))
    assert {r.text for r in found.collect()} == {t for t, _ in rows}
    some = langid.units(docs.where("lang = 'long'").withColumn("upto", F.lit((1 << 30) // 10))).agg(F.sum(F.length("text"))).first()[0]
    assert 0.05 < some / sum(len(t) for t, x in rows if x == "long") < 0.15


def test_rejection_limits_of_rare_and_of_many_languages(spark):
    # uniform over 2,000 letters: some 6 nats a character, beyond any fixed limit for alphabets
    rnd = random.Random(7)
    ideographs = [chr(0x4E00 + i) for i in range(2000)]
    text = lambda n: "".join(rnd.choices(ideographs, k=n))
    latin = invented(rnd, "abcdefgh", 40)
    for n in (5, 60):  # too few units for a limit; enough to fit one on folds
        rows = [(text(450), "zh") for _ in range(n)] + [(latin(), "en") for _ in range(400)]
        model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
        got = model.answers([text(450) for _ in range(40)])
        assert (got["lang_pred"] == "zh").all() and not got["rejected"].any()
        assert np.isinf(model.usual[0, 1]) == (n == 5)
    assert model.answers(["", "12 !"])["rejected"].all()
    rows = [(invented(rnd, chr(0x400 + 8 * c) + chr(0x401 + 8 * c) + "abcd", 80)(), f"l{c}") for c in range(6) for _ in range(300)]
    limits = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample_chars=30000).usual
    assert np.isfinite(limits).all()


def test_language_id_without_labels(spark):
    none = spark.createDataFrame([(None, "en"), ("abc", None)], "text string, lang string")
    model = langid.fit(none)
    assert [tuple(r.p) for r in none.select(langid.predict(none, model).alias("p")).collect()] == [("und", 0.0, True)] * 2
    assert langid.fit(none.limit(0)).languages == []


def gram_counts(texts):
    points, _ = langid.characters(texts)
    return Counter("".join(map(chr, points[i:i + langid.ORDER])) for i in range(len(points) - langid.ORDER + 1)
                   if points[i + langid.ORDER - 1] != 1)


def as_arrays(grams):
    return langid._points("".join(grams)), np.array(list(grams.values()))


def plain_kneser_ney(grams, kinds):
    """log p(character after context) of one language, from its counts in dictionaries."""
    by_order, now = {}, dict(grams)
    for k in range(langid.ORDER, 0, -1):
        by_order[k] = now
        seen = Counter(g[1:] for g in now)
        now = {g: n for g, n in seen.items() if not g.endswith("\x01")}

    def p(gram, floor):
        k = len(gram)
        if not k:
            return floor
        t = by_order[k]
        n1, n2 = sum(n == 1 for n in t.values()), sum(n == 2 for n in t.values())
        d = min(0.95, max(0.05, n1 / max(n1 + 2 * n2, 1) if n1 else 0.5))
        after = {g: n for g, n in t.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        low = p(gram[1:], floor)
        if not total:
            return low
        return max(t.get(gram, 0) - d, 0) / total + d * len(after) / total * low
    return lambda gram: math.log(p(gram, 1 / (kinds + 1000)))


def test_every_probability_as_kneser_and_ney_define_it():
    texts = {"en": ["the cat sat on the mat then ran", "a cat and that hat", "the the the"], "de": ["der hund und die katze", "das ist der hund"],
             "xx": ["q"]}
    counts = {x: gram_counts(t) for x, t in texts.items()}
    model = langid.kneser_ney({x: as_arrays(c) for x, c in counts.items()})
    kinds = len({g[-1] for c in counts.values() for g in c})
    assert model.languages == ["de", "en", "xx"] and math.isclose(model.floor, -math.log(kinds + 1000))
    read = ["the cat sat", "der hund sat on die mat", "zzz qqq", "éa the", "q"]
    points, _ = langid.characters(read)
    places = np.flatnonzero(points[langid.ORDER - 1:] != 1)
    got = model.logs(points, places)
    for c, x in enumerate(model.languages):
        plain = plain_kneser_ney(counts[x], kinds)
        for row, at in zip(got[:, c], places):
            assert abs(float(row) - plain("".join(map(chr, points[at:at + langid.ORDER])))) < 1e-4


def test_long_texts_are_read_in_portions():
    texts = {"en": ["the cat sat on the mat then ran"], "de": ["der hund und die katze"]}
    model = langid.kneser_ney({x: as_arrays(gram_counts(t)) for x, t in texts.items()})
    long = " ".join(["the cat und der hund"] * 150_000)     # 3 million characters, two portions
    h, n = model.entropies(["the cat", long, "", "der hund"])
    short, m = model.entropies([" ".join(["the cat und der hund"] * 50)])
    points, _ = langid.characters([long])
    assert n[1] == (points != 1).sum() and n[2] == 0 and np.allclose(h[1], short[0], rtol=.02)
    assert np.allclose(h[[0, 3]], model.entropies(["the cat", "der hund"])[0])


def test_kneser_ney_is_a_distribution():
    grams = gram_counts(["the cat sat on the mat then ran", "a cat and that hat"])
    model = langid.kneser_ney({"en": as_arrays(grams)})
    seen = sorted({g[-1] for g in grams})
    for context in ("the ", "at o", "zzzz"):
        points = np.concatenate([np.array([*map(ord, context + c)], np.uint32) for c in seen])
        p = [math.exp(float(model.logs(points[i * 5:i * 5 + 5], np.array([0]))[0, 0])) for i in range(len(seen))]
        assert 0.5 < sum(p) < 1.0001  # the rest is for characters never seen
        assert min(p) > 0


def lattice(made, text):
    s, found = made.sp.normalize(text), {}

    def walk(at, ids, w):
        if at == len(s):
            found[tuple(ids)] = w
            return
        bare = True
        for n in range(1, made.longest + 1):
            i = made.sp.piece_to_id(s[at:at + n]) if at + n <= len(s) else made.sp.unk_id()
            if i != made.sp.unk_id() and not made.sp.is_byte(i) and not made.sp.is_control(i):
                bare &= n > 1
                walk(at + n, ids + [i], w + made.weight[i])
        if bare:
            walk(at + 1, ids + made.fallback(s[at]), w + made.rare - made.cost * (len(s[at].encode()) - 1))

    walk(0, [], 0.0)
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


@pytest.fixture(scope="module")
def made():
    return sampling.Sampler(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())


@pytest.mark.parametrize("text", ["the cat", "hello", "a", "日ж本", "  x", "\n"])
def test_samples_follow_the_lattice_distribution(made, text):
    want, n = lattice(made, text), 4000
    got = made.samples([text] * n, np.arange(n), 3)
    assert all(len({tuple(s["ids"].tolist()) for s in r}) == len(r) == min(3, len(want)) for r in got)
    first = Counter(tuple(r[0]["ids"].tolist()) for r in got)
    assert all(abs(first[k] / n - math.exp(v)) < 0.04 for k, v in want.items())
    assert all(abs(s["log_prob"] - want[tuple(s["ids"].tolist())]) < 1e-8 for r in got for s in r)
    assert all(r[i]["perturbed"] >= r[i + 1]["perturbed"] for r in got for i in range(len(r) - 1))
    # weighting by inclusion is unbiased: the probabilities of all segmentations sum to 1
    mass = np.mean([sum(math.exp(s["log_prob"]) / s["inclusion"] for s in r) for r in got])
    assert abs(mass - 1) < 0.05


def test_samples_do_not_depend_on_the_batch(made):
    texts = ["the cat sat", "", "on\nthe mat", "x"]
    keys = np.array([5, 6, 7, 8])
    whole = made.samples(texts, keys, 2)
    for i in range(4):
        alone = made.samples(texts[i:i + 1], keys[i:i + 1], 2)[0]
        assert [s["ids"].tolist() for s in alone] == [s["ids"].tolist() for s in whole[i]]


def test_segmentations_decode_to_the_text(spark):
    texts = [None, "", " ", "the cat", "tab\tand\nline", "日本 é 😀", "a  b   c", "word " * 3000, "▁x"]
    df = spark.createDataFrame([(i if i != 3 else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, samples string")
    rows = sampling.sampled(df, public_tokenizers.path("piece_bpe_32k.model"), k=2).select(
        "*", sampling.restored(F.col("text"), F.col("decoded")).alias("ok")).collect()
    assert len(rows) == len(texts) and all(r.ok for r in rows)
    assert [len(r.samples) for r in rows if not r.text] == [0, 0]
    assert sampling.sampled(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pool_is_emptied(made):
    before = sampling.POOL
    try:
        sampling.POOL = 3
        a = made.samples(["one two", "three four"], np.arange(2), 2)
        b = made.samples(["one two", "three four"], np.arange(2), 2)
    finally:
        sampling.POOL = before
    assert [[s["ids"].tolist() for s in r] for r in a] == [[s["ids"].tolist() for s in r] for r in b]
    assert os.path.exists(SF)


def test_edges_find_what_was_put_in():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = sampling.Edges(keys, np.arange(len(keys), dtype=np.int32))
    asked = np.concatenate([keys, keys + np.uint64(1)])
    known = dict(zip(keys.tolist(), range(len(keys))))
    assert table.find(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]
    assert sampling.Edges(keys[:0], np.zeros(0, np.int32)).find(keys[:3]).tolist() == [-1] * 3


def test_pool_grows_in_place(made):
    made.clear()
    made.samples([" ".join(f"word{i}" for i in range(400))], np.arange(1), 2)
    made.samples(["grow the arrays " * 3 + "once"], np.arange(1), 2)
    held, n = made.logs, made.arcs
    made.samples(["zq"], np.arange(1), 2)
    assert made.arcs > n and (made.logs is held or len(made.logs) >= len(held) * 3 // 2)
    assert len(made.known) == made.units and made.arc[made.places] == made.arcs
