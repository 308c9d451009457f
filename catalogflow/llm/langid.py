"""Language ID by character language models with interpolated Kneser-Ney smoothing.

One five-character model per language is counted by Spark over a bounded sample
of the labelled rows (``SAMPLE_CHARS`` characters, shared by the languages; copies
of a text count once, and units of ``UNIT`` characters enter by a hash of their
text and place, so that no text fills a share or misses it as a whole).  The model's size is bounded by
that sample, so the driver turns the counts into probabilities and broadcasts
them.  It is stored once for all languages: per order a sorted array of 64-bit
n-gram hashes, found through an index over their leading bits, with a row of
log probabilities (one per language) and, for contexts, of back-off weights.

A text is read as its lower-case letters, with one blank for whatever stands
between words.  Its language is the one with the least cross-entropy per
character.  Units that were not counted, a quota of each language, calibrate two
things: the score (probability that the answer is right, a logistic function of
the margin to the second language) and the rejection limit (cross-entropy that
texts of a language hardly exceed at their length).  A language with too little
text for that is counted whole and takes its limit from models of seven eighths
of its units, read on the last eighth.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ORDER = 5
SAMPLE_CHARS = 8_000_000
UNIT = 500                 # characters that enter the sample together
MAX_LANGUAGES = 2000       # rows that the driver may get of the table of languages
PAD = "\x01"
UNKNOWN = "und"
CALIBRATION_UNITS = 1000   # units of each language scored to calibrate, in expectation
FEW_UNITS = 240            # a language with fewer is learnt whole and its limit cross-fitted
LEAST_UNITS = 20           # with fewer scored, a language's texts are rejected only where they hold no letter
FOLDS = 8
_MULTIPLIERS = np.random.default_rng(6).integers(0, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _letter_table() -> np.ndarray:
    import regex
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in regex.finditer(r"[\p{L}\p{M}]+", every):
        out[ord(m[0][0]):ord(m[0][0]) + len(m[0])] = True
    return out


_TABLE: list[np.ndarray] = []


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as the models see them, and the text each belongs to.

    Every text starts with ORDER - 1 pads; only what follows them is scored."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    shown = [PAD * (ORDER - 1) + t.lower().replace(PAD, " ") for t in texts]
    points = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(shown)), [len(t) for t in shown])
    pad, letter = points == ord(PAD), _TABLE[0][points]
    points = np.where(letter | pad, points, 32).astype(np.uint32)
    keep = letter | pad
    keep[1:] |= letter[:-1]  # one blank after a word
    return points[keep], owner[keep]


def hashes(points: np.ndarray, k: int, end: int = 0) -> np.ndarray:
    """Hash of the k characters that end ``end`` places before each position
    (positions from ORDER - 1 on)."""
    h = np.full(len(points) - ORDER + 1, k, np.uint64)
    for j in range(k):
        a = ORDER - 1 - end - j
        h += points[a:a + len(h)].astype(np.uint64) * _MULTIPLIERS[j]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Rows:
    """Sorted hashes with a row of values each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        bits = max(1, int(np.ceil(np.log2(max(2, len(keys))))))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.deep = int(np.diff(self.first).max(initial=0))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        out = np.full(len(asked), -1, np.int64)
        lead = (asked >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        todo = np.flatnonzero(at < end)
        for _ in range(self.deep):
            if not len(todo):
                break
            same = self.keys[at[todo]] == asked[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


@dataclass
class Model:
    languages: list[str]
    grams: list[Rows]        # by order, from 1
    contexts: list[Rows]     # by length, from 0
    floor: float
    margin: tuple[float, float] = (0.0, 1.0)
    usual: np.ndarray | None = None   # mean cross-entropy, spread of one character, slack; by language

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character under each language, and characters scored."""
        n, width = len(texts), len(self.languages)
        sums, counts = np.zeros((n, width)), np.zeros(n, np.int64)
        held, at, size = [], 0, 0

        def flush(a, b):
            points, owner = characters(texts[a:b])
            # a portion at a time: its values take some 16 MB, whatever a text's
            # length and the number of languages
            step = max(1 << 12, (1 << 22) // max(1, width))
            for at in range(0, len(points) - ORDER + 1, step):
                part = points[at:at + step + ORDER - 1]
                scored = np.flatnonzero(part[ORDER - 1:] != ord(PAD))
                logs = self.logs(part, scored)
                who = owner[at + ORDER - 1:][scored]
                counts[a:b] += np.bincount(who, minlength=b - a)
                for c in range(width):
                    sums[a:b, c] += np.bincount(who, logs[:, c], b - a)

        for i, t in enumerate(texts):
            if size and size + len(t) > 1 << 20:
                flush(at, i)
                at, size = i, 0
            size += len(t)
        flush(at, n)
        letters = np.array([any(ch.isalpha() for ch in t) for t in texts], bool)
        return -sums / np.maximum(counts, 1)[:, None], np.where(letters, counts, 0)

    def logs(self, points: np.ndarray, scored: np.ndarray) -> np.ndarray:
        out = np.zeros((len(scored), len(self.languages)), np.float32)
        rest = np.arange(len(scored))
        for k in range(ORDER, 0, -1):
            row = self.grams[k - 1].find(hashes(points, k)[scored[rest]])
            hit = row >= 0
            out[rest[hit]] += self.grams[k - 1].values[row[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            row = self.contexts[k - 1].find(hashes(points, k - 1, 1)[scored[rest]])
            hit = row >= 0
            out[rest[hit]] += self.contexts[k - 1].values[row[hit]]
        out[rest] += self.floor
        return out

    def answers(self, texts: list[str]) -> pd.DataFrame:
        """lang_pred, score, rejected for each text."""
        if not self.languages:
            return pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "rejected": True}, index=range(len(texts)))
        h, n = self.entropies(texts)
        order = np.argsort(h, axis=1, kind="stable")
        best = order[:, 0]
        low = h[np.arange(len(h)), best]
        gap = (h[np.arange(len(h)), order[:, 1]] - low if h.shape[1] > 1 else np.ones(len(h))) * np.sqrt(n)
        score = 1 / (1 + np.exp(-np.clip(self.margin[0] + self.margin[1] * gap, -30, 30)))
        rejected = n == 0
        if self.usual is not None:
            mean, spread, slack = self.usual[:, best]
            rejected |= low > mean * (1 + slack) + 4 * spread / np.sqrt(np.maximum(n, 1))
        names = np.array(self.languages, object)[best]
        return pd.DataFrame({"lang_pred": np.where(n > 0, names, UNKNOWN), "score": np.where(n > 0, score, 0.0), "rejected": rejected})


def _strings(points: np.ndarray) -> np.ndarray:
    """Rows of k code points as strings of k characters, for sorting and grouping."""
    return np.ascontiguousarray(points, np.uint32).view(f"<U{points.shape[1]}").ravel()


def _grouped(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the number of each row's; rows of no characters are one group."""
    if not points.shape[1]:
        return points[:1], np.zeros(len(points), np.int64)
    _, first, number = np.unique(_strings(points), return_index=True, return_inverse=True)
    return points[first], number.ravel()


def _summed(values: np.ndarray, number: np.ndarray, groups: int) -> np.ndarray:
    return np.stack([np.bincount(number, values[:, c], groups) for c in range(values.shape[1])], axis=1)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """{language: (n-grams of ORDER code points, a row each; how often)} -> the models.

    Orders below the highest use continuation counts (distinct characters seen
    before the n-gram); every order is discounted by n1 / (n1 + 2 n2) and
    interpolated with the one below, the lowest with a uniform distribution.
    Everything is arrays of code points and numbers, some hundred bytes for an
    n-gram of the sample and language."""
    languages = sorted(counts)
    points, number = _grouped(np.concatenate([counts[x][0] for x in languages]))
    c = np.zeros((len(points), len(languages)))
    at = 0
    for j, x in enumerate(languages):
        n = len(counts[x][0])
        np.add.at(c[:, j], number[at:at + n], counts[x][1])
        at += n
    tables = []
    for k in range(ORDER, 0, -1):
        tables.append((points, c))
        if k == 1:
            break
        lower, number = _grouped(points[:, 1:])
        c = _summed((c > 0).astype(np.float64), number, len(lower))
        real = lower[:, -1] != ord(PAD)
        points, c = lower[real], c[real]
    tables.reverse()
    floor = float(-np.log(len(tables[0][0]) + 1000)) if len(tables[0][0]) else -10.0
    below, lower, grams, contexts = None, None, [], []
    for k, (points, c) in enumerate(tables, 1):
        n1, n2 = (c == 1).sum(0), (c == 2).sum(0)
        d = np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        d = np.clip(d, 0.05, 0.95)
        ctx, number = _grouped(points[:, :-1])
        total, kinds = _summed(c, number, len(ctx)), _summed((c > 0).astype(np.float64), number, len(ctx))
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        if k == 1:
            under = np.exp(floor)
        else:       # both are sorted, and every n-gram's end is an n-gram of the order below
            under = lower[np.searchsorted(below, _strings(points[:, 1:]))]
        p = np.where(total[number] > 0, np.maximum(c - d, 0) / np.maximum(total[number], 1), 0.0) + weight[number] * under
        below, lower = _strings(points), p
        grams.append(Rows(_of(points), np.log(p)))
        contexts.append(Rows(_of(ctx), np.log(np.maximum(weight, 1e-9))))
    return Model(languages, grams, contexts, floor)


def _of(points: np.ndarray) -> np.ndarray:
    """Hashes of rows of k code points, as ``hashes`` gives them for places in a text."""
    k = points.shape[1]
    if not k:
        return hashes(np.zeros(ORDER, np.uint32), 0).repeat(len(points))
    h = np.full(len(points), k, np.uint64)
    for j in range(k):
        h += points[:, k - 1 - j].astype(np.uint64) * _MULTIPLIERS[j]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _points(grams: str) -> np.ndarray:
    """n-grams of ORDER characters written one after another -> their code points, a row each."""
    return np.frombuffer(grams.encode("utf-32-le"), np.uint32).reshape(-1, ORDER)


def _limit(own: np.ndarray, size: np.ndarray) -> tuple[float, float, float]:
    """Mean cross-entropy, spread of one character and slack, from the
    cross-entropies and sizes of a language's texts; no limit where they are few."""
    if len(own) < LEAST_UNITS:
        return np.inf, 0.0, 0.0
    mean = np.average(own, weights=np.minimum(size, 2000))
    spread = np.sqrt(np.median(((own - mean) ** 2) * size) / 0.455)
    over = (own - 4 * spread / np.sqrt(size)) / mean - 1
    return mean, spread, max(0.25, 1.5 * np.quantile(over, 0.999))


def _grams(texts: list[str]) -> pd.DataFrame | None:
    """gram, n: the n-grams of ORDER characters of some texts, if they have any."""
    points, _ = characters(texts)
    if len(points) < ORDER:
        return None
    windows = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    windows = np.ascontiguousarray(windows[windows[:, -1] != ord(PAD)])
    if not len(windows):
        return None
    gram, n = np.unique(windows.view(f"<U{ORDER}").ravel(), return_counts=True)
    return pd.DataFrame({"gram": gram.astype(object), "n": n})


def _cross_fitted(f: pd.DataFrame) -> pd.DataFrame:
    """The units of one language -> lang, mean, spread, slack of its limit, each
    unit read by a model of the other folds."""
    lang, own, size = f["lang"].iloc[0], [], []
    texts = f.sort_values(["hash", "at"])["text"].tolist()
    for k in range(FOLDS):
        grams = _grams([t for i, t in enumerate(texts) if i % FOLDS != k])
        held = texts[k::FOLDS]
        if grams is not None and held:
            h, n = kneser_ney({lang: (_points("".join(grams["gram"])), grams["n"].to_numpy())}).entropies(held)
            own += h[n > 0, 0].tolist()
            size += n[n > 0].tolist()
    return pd.DataFrame([(lang, *map(float, _limit(np.array(own), np.array(size))))], columns=["lang", "mean", "spread", "slack"])


def _calibrated(model: Model, texts: list[str], truth: list[str], fitted: dict[str, tuple] | None = None) -> Model:
    """Sets the score's logistic function and the rejection limits; ``fitted``
    has limits that are known already."""
    width, fitted = len(model.languages), fitted or {}
    usual = np.array([fitted.get(x, (np.inf, 0.0, 0.0)) for x in model.languages]).reshape(width, 3).T.copy()
    if texts and width:
        h, n = model.entropies(texts)
        lang = np.array([model.languages.index(x) if x in model.languages else -1 for x in truth])
        ok = (n > 0) & (lang >= 0)
        h, n, lang = h[ok], n[ok], lang[ok]
        for c, x in enumerate(model.languages):
            if x not in fitted:
                usual[:, c] = _limit(h[lang == c, c], n[lang == c])
        if width > 1 and len(h):
            order = np.argsort(h, axis=1, kind="stable")
            rows = np.arange(len(h))
            x = (h[rows, order[:, 1]] - h[rows, order[:, 0]]) * np.sqrt(n)
            right = order[:, 0] == lang
            y = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
            a, b = 0.0, 1.0
            for _ in range(100):  # damped Newton steps, ridge on both
                p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
                w = np.maximum(p * (1 - p), 1e-9)
                g = np.array([(p - y).sum() + 0.01 * a, ((p - y) * x).sum() + 0.01 * b])
                m = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
                step = np.clip(np.linalg.solve(m, g), -1, 1)
                a, b = a - step[0], max(1e-3, b - step[1])
            model.margin = (float(a), float(b))
    model.usual = usual
    return model


def units(texts: DataFrame) -> DataFrame:
    """(lang, text, upto) -> lang, hash (of the text), at, text: its units whose
    hash is below ``upto``, those of copies once.

    Only texts with such a unit are cut, in one pass over the text."""
    def chosen(h: Column, at: Column) -> Column:
        return F.pmod(F.xxhash64(h, at), F.lit(1 << 30)) < F.col("upto")

    last = F.greatest(F.floor((F.length("text") - 1) / UNIT).cast("int"), F.lit(0))
    places = let(F.xxhash64("text"), lambda h: F.struct(h.alias("hash"), F.filter(F.sequence(F.lit(0), last), lambda i: chosen(h, i)).alias("at")))
    cut = F.when(F.length("text") <= UNIT, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{UNIT}}}+"), F.lit(0)))
    x = texts.select("lang", "text", places.alias("p")).where("size(p.at) > 0")
    x = x.select("lang", "p.hash", F.explode(let(cut, lambda c: F.transform("p.at", lambda i: F.struct(i.alias("at"), c[i].alias("text"))))).alias("u"))
    return x.select("lang", "hash", "u.*").distinct()


def fit(rows: DataFrame, text: str = "text", language: str = "lang", sample_chars: int = SAMPLE_CHARS) -> Model:
    """The models of all languages in ``rows``; rows without text or language
    teach nothing, and no rows give a model that knows no language.

    The sample is bounded by ``sample_chars`` characters in expectation, an
    equal share for each language, filled where its distinct texts have so many;
    the hash of a text and a unit's place in it decide whether the unit is in.
    One unit in eight is kept for calibration instead of being counted, with a
    quota of its own for each language; of languages with few units none is."""
    r = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{language}`").alias("lang")).where("text is not null and lang is not null")
    distinct = r.select("lang", F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("chars")).distinct()
    totals = distinct.groupBy("lang").agg(F.sum("chars").alias("chars"), F.sum(
        F.ceil(F.col("chars") / UNIT)).alias("units")).limit(MAX_LANGUAGES + 1).toPandas()
    if totals.empty or totals["chars"].sum() == 0:
        return Model([], [], [], -10.0)
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"{len(totals)} languages; a model takes at most {MAX_LANGUAGES}")
    share = sample_chars / len(totals)
    spark = rows.sparkSession
    rate = lambda part: int(min(1.0, part) * (1 << 30))
    limits = spark.createDataFrame([
        (str(x), rate(share / max(1, int(c))), int(u) < FEW_UNITS, rate(8 * CALIBRATION_UNITS / max(1, int(u))))
        for x, c, u in zip(totals["lang"], totals["chars"], totals["units"])], "lang string, counted long, few boolean, tested long")
    # at most MAX_LANGUAGES rows, made here: a bound that allows the broadcast
    labelled = r.join(F.broadcast(limits.withColumn("upto", F.greatest("counted", F.when(~F.col("few"), F.col("tested"))))), "lang")
    sample = units(labelled).join(F.broadcast(limits), "lang").withColumn(
        "test", ~F.col("few") & (F.pmod(F.xxhash64("hash", "at", F.lit(1)), F.lit(8)) == 0))
    place = F.pmod(F.xxhash64("hash", "at"), F.lit(1 << 30))

    def counted(frames):
        for f in frames:
            for lang, texts in f.groupby("lang")["text"]:
                grams = _grams(texts.tolist())
                if grams is not None:
                    yield grams.assign(lang=lang)[["lang", "gram", "n"]]

    counts = sample.where(~F.col("test") & (place < F.col("counted"))).select("lang", "text").mapInPandas(counted, "lang string, gram string, n long")
    # counted by Spark; a language's n-grams come as one text and its counts as one
    # array, bounded by the sample and a tenth of what a row each would take
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list(F.struct("gram", "n")).alias("g"))
    counts = counts.select("lang", F.array_join(F.transform("g", lambda x: x["gram"]), "").alias("grams"), F.transform("g", lambda x: x["n"]).alias("n"))
    counted_ = counts.toArrow()
    if not counted_.num_rows:
        return Model([], [], [], -10.0)
    model = kneser_ney({counted_["lang"][i].as_py(): (_points(counted_["grams"][i].as_py()), counted_["n"][i].values.to_numpy())
                        for i in range(counted_.num_rows)})
    del counted_
    tests = sample.where(F.col("test") & (place < F.col("tested"))).select("lang", "text").toPandas()
    few = sample.where("few").select("lang", "hash", "at", "text") if (totals["units"] < FEW_UNITS).any() else None
    fitted = [] if few is None else few.groupBy("lang").applyInPandas(
        _cross_fitted, "lang string, mean double, spread double, slack double").collect()
    return _calibrated(model, tests["text"].tolist(), tests["lang"].tolist(), {f["lang"]: tuple(f[1:]) for f in fitted})


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column: lang_pred, score, rejected.  Texts that are null or hold
    no letter are ``und`` with score 0, and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def answered(texts: pd.Series) -> pd.DataFrame:
        return shared.value.answers(texts.fillna("").tolist())

    return answered(F.col(f"`{text}`"))
