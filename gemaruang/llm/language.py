r"""Language of each text and of each stretch in another language, with a confidence.

Method: sparse multinomial logistic regression on TF-IDF character n-grams, trained by follow-the-regularised-leader with
elastic-net penalties, then temperature calibration.

*Features.* Each word is a TF-IDF vector of its n-grams (1 to 4 characters, with marks at both ends); a run of words is the
sum of its words' vectors divided by the root of the sum of their squared lengths. So a word's share of every
class score is fixed, computed once per task, and all runs of a text are scored from prefix sums.

*Training.* The delivered labels teach the model although some are wrong: of each language a bounded sample of labelled rows
(``sample`` rows, chosen by a hash of their key) is cut into windows of words. Windows whose label a first model
contradicts are left out of the second. Only the fit is sampled; every row is classified.

*Segments.* The best sequence of runs of at least ``MIN_WORDS`` words under the calibrated scores, changes of language being
cheaper at the ends of sentences; one word's share is bounded, so a borrowed word, name or place makes no run of its own.

Words are runs without white space that hold a letter; links, mentions, hashtags and a leading ``RT`` are none. Null, empty and
word-less texts have no language (null) and no segments. Ties go to the language that comes first in ``LANGUAGES``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemaruang.functions.text import strip
from gemaruang.llm.canonical import canonical
from gemaruang.session import spread

LANGUAGES = ("id", "en", "jv", "es", "nl")
MIN_WORDS = 4
#: Codes of two and three letters, old codes and English names of the languages (fixed values).
LABELS = {
    "id": ("id", "in", "ind", "indonesian"),
    "en": ("en", "eng", "english"),
    "jv": ("jv", "jw", "jav", "javanese"),
    "es": ("es", "spa", "spanish", "castilian"),
    "nl": ("nl", "nld", "dut", "dutch", "flemish"),
}
_SWITCH, _SWITCH_AT_END, _WORD_BOUND = 6.0, 3.5, 2.5
_NO_WORD = re.compile(r"^[^\w@#]*(?:https?://|www\.|@\w|#\w)", re.I)
_ENDS = re.compile(r"[.!?…;/|:)\"]\W*$")


def canonical_label(c: Column | str) -> Column:
    """The language a label names, whatever its case, region suffix or kind of code; null where it names none of ``LANGUAGES``."""
    base = F.split(F.lower(strip(c)), "[-_ (]")[0]
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(base.isin(*names), F.lit(lang)).otherwise(out)
    return out


def words_of(text: str | None) -> tuple[list[str], list[bool]]:
    """The words of a text in its one form, lower case, and whether a sentence or line ends after each."""
    if not text:
        return [], []
    out, ends = [], []
    first = True
    for line in canonical(text).splitlines():
        for token in line.split():
            if first and token.strip(":,").upper() == "RT":
                continue
            first = False
            if not token.isalpha() and (_NO_WORD.match(token) or not any(map(str.isalpha, token))):
                if ends:
                    ends[-1] = True
                continue
            if token.isalpha():
                out.append(token.lower())
                ends.append(False)
            else:
                out.append(token.lower())
                ends.append(_ENDS.search(token) is not None)
        if ends:
            ends[-1] = True
    return out, ends


_TRIM = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def ngrams(word: str, longest: int = 4) -> list[str]:
    """Character n-grams of a word between marks; of very long words every part counts."""
    marked = f"^{_TRIM.sub('', word)}$"
    return [marked[i : i + n] for n in range(1, longest + 1) for i in range(len(marked) - n + 1)]


class Ftrl:
    """Multinomial FTRL-proximal with L1 and L2 penalties over sparse rows."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.02) -> None:
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        n2 = n + g * g
        self.z[at] += g - (np.sqrt(n2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n2


class Model:
    """Weights of the n-grams, their inverse document frequencies and the temperature; what a task needs to score words."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.vocabulary, self.idf, self.w, self.temperature = vocabulary, idf, weights, temperature
        self.cache: dict[str, tuple[list[float], float]] = {}

    def vector(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(indices, TF-IDF values) of a word."""
        at, tf = np.unique([i for g in ngrams(word) if (i := self.vocabulary.get(g)) is not None], return_counts=True)
        at = at.astype(np.int64)
        return at, (1 + np.log(tf)) * self.idf[at] if len(at) else np.zeros(0)

    def word(self, word: str) -> tuple[list[float], float, list[float], int, int]:
        """(share of each class score, squared length, bounded share in a window of six at the temperature, class it prefers, letters)."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            at, x = self.vector(word)
            score, square = ((x @ self.w[at]).tolist(), float(x @ x)) if len(at) else ([0.0] * self.w.shape[1], 0.0)
            scale = 1.5 / ((math.sqrt(6 * square) or 1.0) * self.temperature)
            mean = sum(score) / len(score)
            share = [max(-_WORD_BOUND, min(_WORD_BOUND, (s - mean) * scale)) for s in score]
            got = self.cache[word] = (score, square, share, share.index(max(share)), sum(map(str.isalpha, word)))
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        parts = [self.word(w) for w in words]
        norm = math.sqrt(sum(p[1] for p in parts)) or 1.0
        return np.array([sum(p[0][k] for p in parts) for k in range(self.w.shape[1])]) / norm

    def probabilities(self, words: list[str]) -> np.ndarray:
        s = self.scores(words) / self.temperature
        p = np.exp(s - s.max())
        return p / p.sum()

    def segments(self, words: list[str], ends: list[bool]) -> list[tuple[int, int, int]]:
        """(first, beyond, class) of the best runs of at least MIN_WORDS words; one run where the text is too short for two."""
        n, classes = len(words), range(self.w.shape[1])
        if not n:
            return []
        parts = [self.word(w) for w in words]
        share = [p[2] for p in parts]
        total = [sum(column) for column in zip(*share)]
        one = total.index(max(total))
        if n < 2 * MIN_WORDS or all(p[3] == one for p in parts):
            return [(0, n, one)]
        # nothing to part where every window of the shortest length prefers the same class
        run = [0.0] * len(classes)
        same = True
        for i in range(n):
            for k in classes:
                run[k] += share[i][k] - (share[i - MIN_WORDS][k] if i >= MIN_WORDS else 0.0)
            if i >= MIN_WORDS - 1 and run[one] + 1e-9 < max(run):
                same = False
                break
        if same:
            return [(0, n, one)]
        prefix = [[0.0] * len(classes)]
        for row in share:
            prefix.append([p + s for p, s in zip(prefix[-1], row)])
        none = -1e18
        best = [[none] * len(classes) for _ in range(n + 1)]
        back = [[0] * len(classes) for _ in range(n + 1)]
        open_at = [(0.0, 0)] * len(classes)  # best start of a run of each class: value less its prefix, and where
        for i in range(MIN_WORDS, n + 1):
            j = i - MIN_WORDS
            if j:
                top = sorted(range(len(classes)), key=lambda k: -best[j][k])[:2]
                cost = _SWITCH_AT_END if ends[j - 1] else _SWITCH
                for k in classes:
                    before = best[j][top[1] if top[0] == k else top[0]]
                    value = before - cost - prefix[j][k]
                    if before > none / 2 and value > open_at[k][0]:
                        open_at[k] = (value, j)
            for k in classes:
                best[i][k] = open_at[k][0] + prefix[i][k]
                back[i][k] = open_at[k][1]
        out, i = [], n
        k = max(classes, key=lambda c: (best[n][c], -c))
        while True:
            j = back[i][k]
            out.append((j, i, k))
            if j == 0:
                break
            before = k
            k = max((c for c in classes if c != before), key=lambda c: (best[j][c], -c))
            i = j
        return out[::-1]


def fit(texts: list[str], labels: list[str], window: int = 6, epochs: int = 2, least_df: int = 3) -> Model:
    """The model of labelled texts; one in five windows calibrates the temperature."""
    rows: list[tuple[list[str], int]] = []
    for text, label in zip(texts, labels):
        ws = words_of(text)[0]
        for i in range(0, len(ws), window):
            if len(ws) - i >= 3:
                rows.append((ws[i : i + window], LANGUAGES.index(label)))
    df: dict[str, int] = {}
    for ws, _ in rows:
        for g in {g for w in ws for g in ngrams(w)}:
            df[g] = df.get(g, 0) + 1
    kept = sorted(g for g, n in df.items() if n >= least_df)
    vocabulary = {g: i for i, g in enumerate(kept)}
    idf = np.array([math.log((1 + len(rows)) / (1 + df[g])) + 1 for g in kept])
    model = Model(vocabulary, idf, np.zeros((len(kept), len(LANGUAGES))), 1.0)
    words = {w: model.vector(w) for ws, _ in rows for w in ws}

    def features(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([words[w][0] for w in ws])
        x = np.concatenate([words[w][1] for w in ws])
        square = sum(float(words[w][1] @ words[w][1]) for w in ws)
        at, where = np.unique(at, return_inverse=True)
        return at, np.bincount(where, x, len(at)) / (math.sqrt(square) or 1.0)

    data = [(*features(ws), y) for ws, y in rows]
    held = [i % 5 == 0 for i in range(len(data))]
    order = np.random.default_rng(7).permutation(len(data))
    trusted = [True] * len(data)
    for _ in range(2):
        learner = Ftrl(len(kept), len(LANGUAGES))
        for _ in range(epochs):
            for i in order:
                if trusted[i] and not held[i] and len(data[i][0]):
                    learner.learn(*data[i])
        w = learner.weights()
        scores = np.array([x @ w[at] if len(at) else np.zeros(len(LANGUAGES)) for at, x, _ in data])
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        y = np.array([d[2] for d in data])
        # a label that the model contradicts does not teach the next one
        trusted = list((p.argmax(1) == y) | (p.max(1) < 0.6))
    model.w = w
    check = np.array(held) & np.array(trusted)

    def loss(t: float) -> float:
        s = scores[check] / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[check]]).mean())

    if check.any():
        model.temperature = float(min(np.geomspace(0.1, 4, 60), key=loss))
    model.cache.clear()
    return model


def train(df: DataFrame, key: str = "row_id", text: str = "text", label: str = "lang", sample: int = 1200) -> Model:
    """Fit on at most about ``sample`` labelled rows of each language, chosen by a hash of the key; all rows are counted to find the share.

    Without any labelled row the model knows nothing: every text gets the first language with equal confidence.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), canonical_label(label).alias("l")).filter(F.col("l").isNotNull() & (F.length("t") >= 20))
    # spellings of labels are few: they are counted as they are and then read
    spelled = df.filter(F.length(text) >= 20).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["l"]: r["n"] for r in spelled.select(canonical_label(label).alias("l"), "n").filter(F.col("l").isNotNull()).groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return Model({}, np.zeros(0), np.zeros((0, len(LANGUAGES))), 1.0)
    spot = F.pmod(F.xxhash64("k"), F.lit(1_000_003))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("l") == lang, F.lit(int(1_000_003 * min(1.0, sample / n)))).otherwise(share)
    # the hash is tested against the largest share before any label is read
    largest = int(1_000_003 * min(1.0, sample / min(counts.values())))
    picked = rows.filter((spot < largest) & (spot < share)).orderBy(spot, "k").limit(2 * sample * len(LANGUAGES)).collect()
    return fit([r["t"] for r in picked], [r["l"] for r in picked])


def languages(df: DataFrame, model: Model, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, words, lang, confidence, segments) of every row; segments: lang, confidence, words and letters of each run in reading order."""
    shared = df.sparkSession.sparkContext.broadcast((model.vocabulary, model.idf, model.w, model.temperature))

    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32()), ("letters", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            count, main, sure, runs = [], [], [], []
            for t in b.column(1).to_pylist():
                ws, ends = words_of(t)
                letters = [0] * len(LANGUAGES)
                parts = []
                for i, j, k in m.segments(ws, ends):
                    n = sum(m.word(w)[4] for w in ws[i:j])
                    letters[k] += n
                    parts.append({"lang": LANGUAGES[k], "confidence": float(m.probabilities(ws[i:j])[k]), "words": j - i, "letters": n})
                top = LANGUAGES[max(range(len(LANGUAGES)), key=lambda c: (letters[c], -c))] if ws else None
                count.append(len(ws))
                main.append(top)
                sure.append(max((p["confidence"] for p in parts if p["lang"] == top), default=None))
                runs.append(parts)
            yield pa.record_batch([b.column(0), pa.array(count, pa.int32()), pa.array(main, pa.string()), pa.array(sure, pa.float64()), pa.array(runs, kind)], names=["k", "words", "lang", "confidence", "segments"])

    rows = spread(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")))
    out = rows.mapInArrow(run, "k long, words int, lang string, confidence double, segments array<struct<lang:string,confidence:double,words:int,letters:int>>")
    return out.withColumnRenamed("k", key)


def wrong_labels(df: DataFrame, model: Model | None = None, key: str = "row_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, seg, lang): seg 0 and the main language where the label is missing or names another; seg 1, 2, ... for the stretches of mixed texts.

    The label travels with the text, so no join is needed.
    """
    model = model or train(df, key, text, label)
    packed = df.select(F.col(key).cast("long").alias("__k"), F.struct(F.col(text).alias("t"), canonical_label(label).alias("l")).alias("__s"))
    shared = df.sparkSession.sparkContext.broadcast((model.vocabulary, model.idf, model.w, model.temperature))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for b in batches:
            keys, segs, langs = [], [], []
            for key_, t, named in zip(b["__k"], b["t"], b["l"]):
                ws, ends = words_of(t)
                if len(ws) < MIN_WORDS:
                    continue
                runs = m.segments(ws, ends)
                letters = [0] * len(LANGUAGES)
                for i, j, k in runs:
                    letters[k] += sum(m.word(w)[4] for w in ws[i:j])
                main = LANGUAGES[max(range(len(LANGUAGES)), key=lambda c: (letters[c], -c))]
                if named != main:
                    keys.append(key_)
                    segs.append(0)
                    langs.append(main)
                if len(runs) > 1:
                    for s, (_, _, k) in enumerate(runs, 1):
                        keys.append(key_)
                        segs.append(s)
                        langs.append(LANGUAGES[k])
            yield pd.DataFrame({"k": pd.Series(keys, dtype="int64"), "seg": pd.Series(segs, dtype="int64"), "lang": pd.Series(langs, dtype=object)})

    rows = spread(packed.select("__k", F.col("__s.t").alias("t"), F.col("__s.l").alias("l")))
    return rows.mapInPandas(run, "k long, seg long, lang string").withColumnRenamed("k", key)
