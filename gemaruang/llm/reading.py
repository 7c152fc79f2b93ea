r"""Reading level of each document, comparable to graded text.

Method: regularised ordinal regression (proportional odds) over lexical diversity, word rarity, connectives, a proxy for clause depth,
and length features, calibrated to the levels people gave.

Word rarity needs the corpus: in how many documents each word occurs, counted over all documents. Words in at least a share
``COMMON`` of the documents are broadcast; a document of at most ``w`` distinct words adds at most ``w`` to the sum of all
frequencies, so there are at most (mean distinct words / ``COMMON``) of them whatever the corpus. Every other word is by definition rare,
with one rarity. Features are centred and scaled within the document's language, as the classifier of language labels tells it, over all documents, so that long words of one
language do not count as hard in another.

The fit uses at most ``most_labels`` labelled documents, chosen by a hash of the key; several ratings of one document are
averaged into weights over levels. Null, empty and short texts get features too, but ``reading_levels`` gives rows only
for documents of at least ``least_words`` words. Ties between levels go to the lower one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.llm import language
from gemaruang.session import cut, spread

LEVELS = 4
COMMON = 1e-4
FEATURES = (
    "word_length", "long_words", "very_long_words", "sentence_words", "sentence_letters", "diversity", "pair_diversity", "rarity", "rare_words", "connectives", "clauses", "commas", "long_sentences", "length_spread",
)

#: Words that open a clause (fixed values).
CLAUSE_WORDS = frozenset(
    "yang sehingga sepanjang mengingat karena meskipun walaupun ketika supaya agar sebagaimana apabila bilamana sebab bahwa kendatipun selama sejak sebelum setelah which that because although since whereas insofar thereby given while so who whose when before after unless kang supaya saéngga awit amarga senajan kamangka sawisé nganti que porque aunque cuando dado mientras cuyo donde si desde para die dat omdat terwijl zodat doordat waardoor hoewel waarbij sinds voordat nadat als".split()
)
#: Connecting adverbs and conjunctions between sentences as grammars list them, by language: Indonesian, English, Javanese, Spanish, Dutch; chosen without the graded texts (fixed values).
CONNECTIVES = frozenset(
    """namun tetapi sedangkan sementara melainkan padahal selanjutnya kemudian akhirnya lantas selain demikian akibatnya sebaliknya misalnya contohnya bahkan apalagi terlebih adapun kendati alhasil singkatnya ringkasnya jelasnya
    accordingly additionally also besides consequently conversely finally furthermore hence however indeed instead likewise meanwhile moreover nevertheless nonetheless notwithstanding otherwise similarly specifically still subsequently then thereafter therefore thus
    nanging dene mula mulané banjur saliyané kejaba sanadyan senajan mangkono malah apamanèh wusanané pungkasané tegesé upamané
    además ahora así asimismo consecuentemente consiguiente contrario embargo entonces finalmente incluso luego mientras obstante pues sino también tampoco tanto
    bovendien daarentegen daarna daardoor daarom derhalve desalniettemin desondanks dus echter eveneens immers integendeel kortom niettemin nochtans overigens tevens toch trouwens uiteindelijk vervolgens voorts""".split()
)

_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?;…]+(?=\s|$)|\n+")
_RARITY = math.log(1 / COMMON)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def main_language(words: list[str], model: language.Model | None) -> str:
    """The language with the largest share of the words' scores; '' without a model."""
    if model is None:
        return ""
    total = [0.0] * len(language.LANGUAGES)
    for w in words:
        for k, x in enumerate(model.word(w)[2]):
            total[k] += x
    return language.LANGUAGES[total.index(max(total))]


def features(text: str | None, rarity: dict[str, float]) -> tuple[list[str], list[float]]:
    """(words, values of FEATURES); a text without words has zeros."""
    words = words_of(text)
    if not words:
        return words, [0.0] * len(FEATURES)
    n = len(words)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    sentences = [s for part in _SENTENCE.split(text) if (s := len(_WORDS.findall(part)))]
    count = len(sentences) or 1
    rare = [rarity.get(w, _RARITY) for w in words]
    return words, [
        mean,
        sum(s >= 9 for s in sizes) / n,
        sum(s >= 12 for s in sizes) / n,
        n / count,
        sum(sizes) / count,
        len(set(words)) / math.sqrt(n),
        len(set(zip(words, words[1:]))) / n,
        sum(rare) / n,
        sum(r > 0.5 * _RARITY for r in rare) / n,
        sum(w in CONNECTIVES for w in words) / count,
        sum(w in CLAUSE_WORDS for w in words) / count,
        text.count(",") / count,
        sum(s > 16 for s in sentences) / count,
        math.sqrt(sum((s - mean) ** 2 for s in sizes) / n),
    ]


class Ordinal:
    """Proportional-odds regression with an L2 penalty: P(level <= k) = sigmoid(cut_k - x·w)."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray) -> None:
        self.w, self.cuts = weights, cuts

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        """The features and their squares, both bounded."""
        x = np.clip(x, -4, 4)
        return np.hstack([x, 0.25 * x * x])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - (self.expand(x) @ self.w)[:, None], -40, 40)))
        return np.diff(np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))]), axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 400, rate: float = 0.05) -> Ordinal:
        """``y`` counts levels from 0. Adam on the penalised likelihood; cuts are kept in order by their logarithmic gaps."""
        z = cls.expand(x)
        theta = np.concatenate([np.zeros(z.shape[1]), [-1.0], np.zeros(LEVELS - 2)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = weight.sum() or 1.0
        d = z.shape[1]
        rows = np.arange(len(y))
        for t in range(1, steps + 1):
            gaps = np.exp(theta[d + 1 :])
            cuts = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
            s = z @ theta[:d]
            c = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -30, 30)))
            c = np.hstack([np.zeros((len(s), 1)), c, np.ones((len(s), 1))])
            p = np.maximum(c[rows, y + 1] - c[rows, y], 1e-9)
            slope = c * (1 - c)
            up, low = slope[rows, y + 1] / p * weight, slope[rows, y] / p * weight
            g_s = up - low  # of the negative likelihood by the score
            g_cut = np.zeros(LEVELS - 1)
            for k in range(LEVELS - 1):
                g_cut[k] = -(up[y == k].sum() - low[y == k + 1].sum())
            tail = np.cumsum(g_cut[::-1])[::-1]
            g = np.concatenate([z.T @ g_s + l2 * theta[:d], [tail[0]], tail[1:] * gaps]) / total
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        gaps = np.exp(theta[d + 1 :])
        return cls(theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(gaps)]))


def common_words(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """-log of the share of documents that hold a word, for words in at least ``COMMON`` of all documents with text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for b in batches:
            for t in b["t"]:
                if t:
                    counts[""] = counts.get("", 0) + 1
                    for w in set(words_of(t)):
                        counts[w] = counts.get(w, 0) + 1
            if len(counts) > 500_000:
                yield pd.DataFrame({"w": list(counts), "n": list(counts.values())})
                counts.clear()
        yield pd.DataFrame({"w": list(counts), "n": list(counts.values())}, columns=["w", "n"]).astype({"w": "str", "n": "int64"})

    table = spread(docs.select(F.col(text).alias("t"))).mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).cache()
    try:
        total = table.filter("w = ''").agg(F.sum("n")).first()[0] or 0
        return {r["w"]: -math.log(r["n"] / total) for r in table.filter((F.col("w") != "") & (F.col("n") >= max(1, COMMON * total))).collect()}
    finally:
        table.unpersist()


def document_features(docs: DataFrame, rarity: dict[str, float], key: str = "doc_id", text: str = "text", model: language.Model | None = None) -> DataFrame:
    """(key, language, words, features) of every document; words are separated by white space."""
    shared = docs.sparkSession.sparkContext.broadcast((rarity, model and (model.vocabulary, model.idf, model.w, model.temperature)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, parts = shared.value
        told = language.Model(*parts) if parts else None
        for b in batches:
            got = [features(t, known) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "words": [len(t.split()) if t else 0 for t in b["t"]], "language": [main_language(g[0], told) for g in got], "features": [g[1] for g in got]})

    rows = spread(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")))
    return rows.mapInPandas(run, "k long, words int, language string, features array<double>").withColumnRenamed("k", key)


def language_scales(feats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each feature by language over all documents with words; a few rows."""
    size = range(len(FEATURES))
    sums = [F.avg(F.col("features")[i]).alias(f"m{i}") for i in size] + [F.stddev_pop(F.col("features")[i]).alias(f"s{i}") for i in size]
    rows = feats.filter("words > 0").groupBy("language").agg(*sums).collect()
    return {r["language"]: (np.array([r[f"m{i}"] for i in size]), np.maximum([r[f"s{i}"] for i in size], 1e-6)) for r in rows}


def fit_levels(feats: DataFrame, labels: DataFrame, scales: dict, key: str = "doc_id", level: str = "reading_level", most_labels: int = 20_000) -> Ordinal | None:
    """The regression on a bounded sample of labelled documents; None where there are none."""
    rated = labels.filter(F.col(level).between(1, LEVELS)).select(F.col(key), F.col(level).cast("int").alias("y"))
    n = rated.count()
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003))
    picked = rated.filter(spot < int(1_000_003 * min(1.0, most_labels / max(1, n)))).orderBy(spot, key).limit(2 * most_labels)
    rows = picked.join(feats.filter("words > 0"), key).select("language", "features", "y", key).toPandas()
    if rows.empty:
        return None
    x = np.array([(np.array(f) - scales[g][0]) / scales[g][1] for g, f in zip(rows["language"], rows["features"])])
    weight = 1 / rows.groupby(key)["y"].transform("count").to_numpy(float)
    return Ordinal.fit(x, rows["y"].to_numpy(int) - 1, weight)


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 60, label: str = "lang", sample: int = 60) -> DataFrame:
    """(key, reading_level, confidence) of each document of at least ``least_words`` words; without labels no document has a level.

    The language of a document is told by the classifier of language labels, fitted on at most about ``sample`` labelled documents of each
    language; without a column ``label`` all documents are scaled together.
    """
    # scales, fit and grading all read the features: they are computed once
    model = language.train(docs, key, text, label, sample) if label in docs.columns else None
    feats = cut(document_features(docs, common_words(docs, text), key, text, model if model and model.vocabulary else None))
    scales = language_scales(feats)
    grades = fit_levels(feats, labels, scales, key)
    schema = f"`{key}` long, reading_level int, confidence double"
    if grades is None:
        return feats.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast((grades.w, grades.cuts, scales))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, cuts, by = shared.value
        grader = Ordinal(w, cuts)
        for b in batches:
            if len(b):
                x = np.array([(np.array(f) - by[g][0]) / by[g][1] for g, f in zip(b["language"], b["features"])])
                p = grader.probabilities(x)
                yield pd.DataFrame({key: b[key], "reading_level": p.argmax(1).astype("int32") + 1, "confidence": p.max(1)})

    return feats.filter(F.col("words") >= least_words).mapInPandas(run, schema)


def profile(levels: DataFrame) -> DataFrame:
    """(reading_level, documents): how demanding the corpus is."""
    return levels.groupBy("reading_level").agg(F.count(F.lit(1)).alias("documents"))
