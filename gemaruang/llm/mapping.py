r"""Freely typed values mapped to a reference list, values without a counterpart reported.

The reference list becomes a symmetric-delete dictionary: every form of an entry with up to ``MAX_DELETES`` characters deleted points back to it. A typed
value is folded (one form for look-alikes, lower case, punctuation to spaces) and looked up by its own deletes; what meets in the
dictionary is ranked by weighted Damerau-Levenshtein distance and then by the entry's frequency. Deletes of the first ``PREFIX`` characters are
enough to meet: two texts that meet after two deletes each also meet in their beginnings, and what meets there is checked in full. So
an entry has at most 56 forms, however long it is.

The dictionary works on words as well as whole entries, so that swapped, abbreviated, run-together and affixed words are found too: each
word of an entry must be met by one typed word. Words have further forms: their beginnings (for words cut by a stop), their consonants
(for words without vowels) and the beginnings of these. An entry is looked at only if its rarest word is met, so a word that many entries share costs nothing.

Costs: transposition and doubled letters 0.6, a vowel lost 0.5, any other edit 1. A value is accepted where its cost stays
within ``TOLERANCE`` of the entry's length, of which letters beyond ``SHORT`` count half, and the cheapest such entry is taken; values of equal cost and frequency
go to the smaller entry number.

The dictionary is built once, as sorted arrays of 64-bit digests, and broadcast after a check of its bytes. A list whose dictionary is larger is cut
into blocks that fit; each spelling is looked up in every block and the best of its answers counts, which gives the same result.

Null and blank values are no cases; what matches nothing gets entry number 0.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.functions.text import WS
from gemaruang.llm.canonical import canonical
from gemaruang.session import core_count, shuffle_partitions

MAX_DELETES, PREFIX = 2, 10
TOLERANCE, SHORT = 0.34, 12
MOST_BYTES = 128 << 20
#: Words that people put before a topic, and the Indonesian endings that do not change it (fixed values).
FILLERS = frozenset({"soal", "aspek", "tentang", "topik", "kategori", "masalah", "hal"})
ENDINGS = ("nya", "ny")
_VOWELS = frozenset("aeiou")
_NO = 1e6


def deletes(word: str, most: int = MAX_DELETES) -> set[str]:
    """All forms with up to ``most`` characters deleted, itself included."""
    out, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def meet(a: str, b: str, of_a: int = MAX_DELETES, of_b: int = MAX_DELETES) -> bool:
    """Whether the two are equal after so many deletes at most from each."""
    if abs(len(a) - len(b)) > max(of_a, of_b):
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) <= of_a and len(b) <= of_b
    return of_a > 0 and meet(a[1:], b, of_a - 1, of_b) or of_b > 0 and meet(a, b[1:], of_a, of_b - 1)


def distance(typed: str, meant: str) -> float:
    """Weighted Damerau-Levenshtein distance of adjacent transpositions."""
    n, m = len(typed), len(meant)
    before: list[float] = []
    above = [0.0] * (m + 1)
    for j in range(1, m + 1):
        above[j] = above[j - 1] + (0.5 if meant[j - 1] in _VOWELS else 1.0)
    for i in range(1, n + 1):
        t = typed[i - 1]
        extra = 0.6 if i > 1 and typed[i - 2] == t else 1.0
        row = [above[0] + extra]
        for j in range(1, m + 1):
            c = meant[j - 1]
            best = min(above[j] + extra, row[j - 1] + (0.5 if c in _VOWELS else 0.6 if j > 1 and meant[j - 2] == c else 1.0), above[j - 1] + (t != c))
            if i > 1 and j > 1 and t == meant[j - 2] and typed[i - 2] == c and t != c:
                best = min(best, before[j - 2] + 0.6)
            row.append(best)
        before, above = above, row
    return above[m]


def skeleton(word: str) -> str:
    return "".join(c for c in word if c not in _VOWELS)


def assignment(costs: list[list[float]]) -> float:
    """Least total of one cost from each row in different columns; rows are at most as many as columns."""
    n, m = len(costs), len(costs[0]) if costs else 0
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, back, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            done[j] = True
            r, delta, to = row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    c = costs[r - 1][k - 1] - u[r] - v[k]
                    if c < least[k]:
                        least[k], back[k] = c, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if done[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            row_of[j] = row_of[back[j]]
            j = back[j]
    return sum(costs[row_of[k] - 1][k - 1] for k in range(1, m + 1) if row_of[k])


class Index:
    """Forms to numbers, as two arrays sorted by the forms' digests; what meets by a digest is checked by the caller."""

    def __init__(self, pairs: Iterable[tuple[str, int]]) -> None:
        keys, ids = [], []
        for form, i in pairs:
            keys.append(self.digest(form))
            ids.append(i)
        k, v = np.array(keys, dtype=np.uint64), np.array(ids, dtype=np.int32)
        order = np.argsort(k, kind="stable")
        self.keys, self.ids = k[order], v[order]

    @staticmethod
    def digest(form: str) -> int:
        return int.from_bytes(blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")

    def find(self, forms: Iterable[str]) -> set[int]:
        h = np.array([self.digest(f) for f in forms], dtype=np.uint64)
        low, high = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        return {int(i) for a, b in zip(low, high) if a < b for i in self.ids[a:b]}


class Mapper:
    """The dictionary of some entries (number, name) with their frequencies; ``near_fillers`` are reference words that look like fillers."""

    def __init__(self, entries: Iterable[tuple[int, str]], frequency: dict[int, int] | None = None, near_fillers: Iterable[str] | None = None) -> None:
        split = {n: self.split(name) for n, name in entries if name and name.strip()}
        names = sorted((n, ws) for n, ws in split.items() if ws)
        self.numbers = [n for n, _ in names]
        self.frequency = [(frequency or {}).get(n, 0) for n in self.numbers]
        self.vocabulary = sorted({w for _, ws in names for w in ws})
        at = {w: i for i, w in enumerate(self.vocabulary)}
        self.words_of = [tuple(at[w] for w in ws) for _, ws in names]
        self.whole_of = ["".join(ws) for _, ws in names]
        self.holders: dict[int, list[int]] = defaultdict(list)
        for e, ws in enumerate(self.words_of):
            for w in set(ws):
                self.holders[w].append(e)
        # every word of an entry must be met, so its rarest word too
        self.anchored: dict[int, list[int]] = defaultdict(list)
        for e, ws in enumerate(self.words_of):
            self.anchored[min(ws, key=lambda w: (len(self.holders[w]), w))].append(e)
        self.near_fillers = frozenset(self.vocabulary if near_fillers is None else near_fillers)
        self.whole = Index((f, e) for e, x in enumerate(self.whole_of) for f in deletes(x[:PREFIX]))
        self.words = Index((f, i) for i, w in enumerate(self.vocabulary) for f in deletes(w[:PREFIX]))
        self.starts = Index((f, i) for i, w in enumerate(self.vocabulary) for f in {f for k in range(2, min(len(w), PREFIX) + 1) for f in deletes(w[:k], 1 if k > 2 else 0)})
        self.bones = Index((f, i) for i, w in enumerate(self.vocabulary) if (b := skeleton(w)[:PREFIX]) for f in {*(f for f in deletes(b) if len(f) >= 2 and len(b) < 2 * len(f)), *(b[:k] for k in range(2, len(b)))})

    @staticmethod
    def fold(value: str) -> str:
        """One form, lower case; stops stay as marks of abbreviation, all other punctuation is a space."""
        return re.sub(r"[^\w.]+|_+", " ", canonical(value).casefold()).strip()

    @classmethod
    def split(cls, name: str) -> list[str]:
        return cls.fold(name).replace(".", " ").split()

    @lru_cache(maxsize=1 << 14)  # noqa: B019
    def word_costs(self, typed: str, cut: bool) -> dict[int, float]:
        """Cost of each reference word that ``typed`` may stand for; ``cut``: a stop marks it as shortened."""
        out: dict[int, float] = {}

        def offer(word: int, cost: float) -> None:
            if cost < out.get(word, _NO):
                out[word] = cost

        forms = [typed] + [typed[: -len(e)] for e in ENDINGS if typed.endswith(e) and len(typed) > len(e) + 2]
        for k, form in enumerate(forms):
            for i in self.words.find(deletes(form[:PREFIX])):
                if meet(form, self.vocabulary[i]):
                    offer(i, distance(form, self.vocabulary[i]) + 0.1 * k)
            if len(form) < 2:
                continue
            if len(form) >= 3 or cut:
                for i in self.starts.find(deletes(form[:PREFIX], 1) if cut and len(form) > 2 else [form[:PREFIX]]):
                    word = self.vocabulary[i]
                    if len(form) >= len(word):
                        continue
                    gap = 0.02 * (len(word) - len(form)) + 0.1 * k
                    if word.startswith(form):
                        offer(i, (0.3 if cut else 1.2) + gap)
                    elif cut and len(form) > 2:
                        # a beginning, itself mistyped: against prefixes of about its length
                        best = min(distance(form, word[:n]) for n in range(len(form) - 1, min(len(word), len(form) + 2) + 1))
                        if best <= 1.0:
                            offer(i, 0.3 + best + gap)
            bare = skeleton(form)
            if len(bare) >= 2:
                # the vowels left out: a cost by the whole word, not by each vowel; further letters left out cost more
                strict = bare == form and len(form) >= 3
                for i in self.bones.find(deletes(bare[:PREFIX], 1) if strict else [bare[:PREFIX]]):
                    word = self.vocabulary[i]
                    bones = skeleton(word)
                    if strict and (d := distance(form, bones)) <= (1.0 if len(form) >= 5 else 0.6 if len(form) >= 4 else 0):
                        offer(i, 0.5 + d + 0.1 * k)
                    if cut and bare == form and bones.startswith(bare):
                        offer(i, 0.8 + 0.02 * (len(bones) - len(bare)) + 0.1 * k)
                    if len(form) <= 0.75 * len(word) and len(bones) < 2 * len(bare) and meet(bare, bones, 0, MAX_DELETES):
                        offer(i, 1.2 + 0.02 * (len(word) - len(form)) + 0.1 * k)
        return out

    @lru_cache(maxsize=1 << 12)  # noqa: B019
    def filler(self, token: str) -> bool:
        """A word before the topic, perhaps mistyped, that is no reference word itself."""
        return token in FILLERS or token not in self.near_fillers and near_filler(token)

    def _tokens(self, folded: str) -> list[tuple[str, bool]]:
        out = []
        for raw in folded.split():
            parts = raw.split(".")
            for i, p in enumerate(parts):
                if p:
                    out.append((p, i < len(parts) - 1))
        return out

    def _assign(self, tokens: list[tuple[str, bool]], costs: list[dict[int, float]], rest: list[float], e: int) -> float:
        """Least cost of meeting each word of an entry by one token, in any order; tokens left over cost ``rest``."""
        words = self.words_of[e]
        if len(words) > len(tokens):
            return _NO
        matrix = [[costs[k].get(w, _NO) + (0.05 if k != i else 0) - rest[k] for k in range(len(tokens))] for i, w in enumerate(words)]
        return assignment(matrix) + sum(rest)

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def best(self, value: str) -> tuple[float, int, int] | None:
        """(cost, -frequency, number) of the entry meant, or None."""
        tokens = self._tokens(self.fold(value))
        kept = [t for t in tokens if not self.filler(t[0])] or tokens
        squeezed = "".join(t for t, _ in kept)
        forms = {squeezed: 0.0}
        for e in ENDINGS:
            if squeezed.endswith(e):
                forms.setdefault(squeezed[: -len(e)], 0.1)
        for f in FILLERS:
            if squeezed.startswith(f) and len(squeezed) > len(f) + 4:
                forms.setdefault(squeezed[len(f) :], 0.2)
        found: dict[int, float] = {}
        for form, extra in forms.items():
            for e in self.whole.find(deletes(form[:PREFIX])):
                if meet(form, self.whole_of[e]):
                    found[e] = min(found.get(e, _NO), distance(form, self.whole_of[e]) + extra)
        costs = [self.word_costs(*t) for t in tokens]
        met = {w for c in costs for w in c}
        rest = [0.2 if self.filler(t) else float(len(t)) for t, _ in tokens]
        for w in met:
            for e in self.anchored.get(w, ()):
                if met.issuperset(self.words_of[e]):
                    found[e] = min(found.get(e, _NO), self._assign(tokens, costs, rest, e))
        ranked = sorted((c, -self.frequency[e], self.numbers[e], len(self.whole_of[e])) for e, c in found.items())
        return next(((c, f, n) for c, f, n, size in ranked if c <= TOLERANCE * (min(size, SHORT) + size) / 2), None)

    def match(self, value: str) -> int:
        """The entry meant, or 0."""
        got = self.best(value)
        return got[2] if got else 0


def near_filler(token: str) -> bool:
    return len(token) >= 4 and any(distance(token, f) <= 1 for f in FILLERS if len(f) >= 4)


def _blocks(entries: DataFrame, counts: dict[int, int], most_bytes: int, blocks: int = 1) -> list[bytes]:
    """The dictionary of (n, name), pickled, in as many blocks as it takes to keep each within ``most_bytes``."""
    near = entries.select(F.explode(F.split(F.lower("name"), r"[^\p{L}\p{N}]+")).alias("w")).distinct()
    words = [r["w"] for r in near.filter(F.length("w").between(3, max(map(len, FILLERS)) + 1)).collect()]
    near_fillers = {w for w in words if near_filler(w)}
    while True:
        out = []
        for b in range(blocks):
            rows = entries.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).collect()
            own = pickle.dumps(Mapper([(r["n"], r["name"]) for r in rows], {r["n"]: counts.get(r["n"], 0) for r in rows}, near_fillers))
            if len(own) > most_bytes and len(rows) > 1:
                break
            out.append(own)
        else:
            return out
        blocks *= 2


def map_values(
    df: DataFrame, reference: DataFrame, key: str = "pred_id", value: str = "aspect_category", number: str = "aspect_no", name: str = "aspect_category", most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(key, number) of each row whose value is not blank and not literally an entry; 0 where none is meant.

    Frequencies are counts of literal entries over all rows, at most one number for each entry. The dictionary is broadcast in blocks of at
    most ``most_bytes``.
    """
    spark = df.sparkSession
    entries = reference.select(F.col(number).cast("int").alias("n"), F.col(name).alias("name")).filter(F.col("name").isNotNull() & F.col("n").isNotNull())
    values = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    names = entries.select(F.col("name").alias("v"), "n").groupBy("v").agg(F.min("n").alias("n"))
    counts = {r["n"]: r["c"] for r in values.join(names, "v").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    shared = [spark.sparkContext.broadcast(b) for b in _blocks(entries, counts, most_bytes)]
    typed = values.filter(F.regexp_replace("v", f"{WS}+", "") != "").join(names.select("v"), "v", "left_anti")

    def lookup(block):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mapper = pickle.loads(block.value)
            for b in batches:
                got = [mapper.best(v) or (_NO, 0, 0) for v in b["v"]]
                yield pd.DataFrame({"v": b["v"], "cost": [g[0] for g in got], "f": [g[1] for g in got], "n": [g[2] for g in got]})

        return run

    # each spelling is matched once: copies collapse per task before they are shuffled, the answers are joined back. The spellings go
    # round robin to all cores, as the rows of one lookup are few and dear
    spellings = typed.select("v").distinct().repartition(max(core_count(spark), shuffle_partitions(spark)))
    schema = "v string, cost double, f long, n int"
    answers = spellings.mapInPandas(lookup(shared[0]), schema)
    for block in shared[1:]:
        answers = answers.unionByName(spellings.mapInPandas(lookup(block), schema))
    if len(shared) > 1:
        answers = answers.groupBy("v").agg(F.min(F.struct("cost", "f", "n")).alias("b")).select("v", F.col("b.n").alias("n"))
    return typed.join(answers.select("v", "n"), "v").select(F.col("k").alias(key), F.col("n").alias(number))


def unmatched_values(df: DataFrame, reference: DataFrame, **names: str) -> DataFrame:
    """(value, rows): typed values without a counterpart, with the number of rows that hold them."""
    key, value = names.get("key", "pred_id"), names.get("value", "aspect_category")
    misses = map_values(df, reference, **names).filter(F.col(names.get("number", "aspect_no")) == 0).select(key)
    return df.select(key, value).join(misses, key, "left_semi").groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
