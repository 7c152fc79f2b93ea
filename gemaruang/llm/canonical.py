r"""One form for text that looks the same on screen.

Full-width forms, ligatures, decomposed accents, look-alike letters of other scripts, invisible characters and kinds of
space are brought to one form; letter case, punctuation, the number of spaces, tabs and line breaks stay.

Most text is stable: ASCII and precomposed Latin letters answer the quick check of normalisation with yes. A scan isolates
the maximal runs that do not (quick check *no* or *maybe*, or a character with a fold), takes the starter before a run as
boundary context, since only a starter can compose with what follows, normalises that segment alone and splices it back. Segments
recur, so their forms are kept in a bounded cache.

Null stays null, the empty text stays empty; texts of any length are handled in one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemaruang.session import cut, spread

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀаеѕіјорсухүһӏԁԛԝѵ", "ABESIJKMHOPCTYXYGQWIaesijopcyxyhldqwv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc"),
    "Armenian": ("ՏՍՕցհոսօզ", "SUOghnuoq"),
    "Latin": ("ɑɡɩıℓ", "agiil"),
}

_FOLD: dict[int, str] = {ord(a): b for seen, meant in LOOK_ALIKES.values() for a, b in zip(seen, meant, strict=True)}
#: Marks of the same look that normalisation keeps apart (fixed values).
_FOLD |= {0x0340: "̀", 0x0341: "́", 0x0343: "̓"}

#: Everything the quick check can pass over: ASCII and Latin letters in composed form, without the soft hyphen and the no-break space.
CANDIDATE = re.compile("(?:[^\\W\\d_]|[\x20-\x7e])?[^\x00-\x9f\xa1-\xac\xae-İĴ-ɏ]+|[\xa0\xad]+")
_KEEP_JOINER = 0x200D


@lru_cache(maxsize=1 << 16)
def fold_char(ch: str) -> str:
    """The form of one decomposed character: '' for invisible ones."""
    o = ord(ch)
    if o in _FOLD:
        return _FOLD[o]
    kind = unicodedata.category(ch)
    if kind == "Cf" or o == 0x034F or o == 0x115F or o == 0x1160 or o == 0x3164 or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F:
        return ""
    if kind == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0] in ("<wide>", "<narrow>", "<font>") or len(parts) > 2 and parts[0] == "<compat>" and ("LIGATURE" in unicodedata.name(ch, "") or "DIGRAPH" in unicodedata.name(ch, "")):
        return "".join(fold_char(c) for c in unicodedata.normalize("NFKD", ch))
    return ch


def _symbol(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk") or 0xFE00 <= ord(ch) <= 0xFE0F


@lru_cache(maxsize=1 << 16)
def fold_segment(seg: str) -> str:
    decomposed = unicodedata.normalize("NFD", seg)
    out = []
    last = len(decomposed) - 1
    for i, ch in enumerate(decomposed):
        # a joiner between two pictures is seen: it makes one picture of them
        if ord(ch) == _KEEP_JOINER and 0 < i < last and _symbol(decomposed[i - 1]) and _symbol(decomposed[i + 1]):
            out.append(ch)
        else:
            out.append(fold_char(ch))
    return unicodedata.normalize("NFC", "".join(out))


def canonical(text: str | None) -> str | None:
    """The one form of ``text``."""
    if text is None or text.isascii():
        return text
    return CANDIDATE.sub(lambda m: fold_segment(m.group()), text)


def _canonical_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(canonical, na_action="ignore")


canonical_udf = F.pandas_udf(_canonical_batches, T.StringType())


def canonical_text(c: Column | str) -> Column:
    """The one form of a text column; null stays null."""
    return canonical_udf(F.col(c) if isinstance(c, str) else c)


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, class_key, text_key, changed) of rows with a letter or digit: 128-bit digests of the one form and of the text as it is."""
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).filter(F.col("t").rlike(r"[\p{L}\p{N}]"))
    return rows.withColumn("c", canonical_udf("t")).select("k", F.unhex(F.md5("c")).alias("class_key"), F.unhex(F.md5("t")).alias("text_key"), (F.col("c") != F.col("t")).alias("changed"))


def look_alike_classes(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, class_id, variant_id, variants): membership of every row whose text has a letter or digit; ids are the smallest keys of the class and of the exact text.

    Texts are counted before they are shuffled whole: exact copies are pre-aggregated per task by their digests.
    """
    rows = cut(_keys(df, key, text))
    variants = rows.groupBy("class_key", "text_key").agg(F.min("k").alias("variant_id"))
    classes = variants.groupBy("class_key").agg(F.min("variant_id").alias("class_id"), F.count(F.lit(1)).alias("variants"))
    return rows.join(variants, ["class_key", "text_key"]).join(classes, "class_key").select(F.col("k").alias(key), "class_id", "variant_id", "variants")


def look_alike_pairs(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key_a, key_b): all pairs of rows whose texts look the same but differ in code points, the smaller key first.

    Two different texts of one class cannot both be in the one form, so each pair has a row that the fold changed: only those
    rows look for partners. The other side is the whole table as digests of 16 bytes; a hot class is split by adaptive execution.
    """
    # both sides read the digests: the texts are folded once
    rows = cut(_keys(df, key, text))
    left = rows.filter("changed").select(F.col("k").alias("a"), "class_key", F.col("text_key").alias("ta"))
    right = rows.select(F.col("k").alias("b"), "class_key", F.col("text_key").alias("tb"), F.col("changed").alias("b_changed"))
    # a pair of two changed rows is met from both sides; it is kept where a is the smaller
    met = left.join(right, "class_key").filter((F.col("ta") != F.col("tb")) & (~F.col("b_changed") | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
