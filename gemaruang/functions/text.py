"""Text verbs as Column expressions.

Character classes follow the Unicode behaviour of Python's ``re`` and ``str.strip``, which differ from the ASCII defaults of Java's regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in str.isspace, and word characters, for Java's regular expressions.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\xa0  -     　]"
WORD = r"[\p{L}\p{N}_]"

#: Texts that a CSV reader in the manner of data frames takes as missing (fixed values).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Words that negate (fixed values).
NEGATORS = ("tidak", "tak", "bukan", "jangan", "belum", "enggak")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; stripped."""
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


def words(c: Column | str) -> Column:
    """White-space separated tokens, none of them empty; null gives null."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def null_tokens(c: Column | str) -> Column:
    """Null for the texts that data-frame CSV readers take as missing."""
    c = _col(c)
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def clean_line(c: Column | str) -> Column:
    """Lower case without a leading ``rt``, links, mentions, hashtags and everything but ASCII letters and digits; null gives ``''``."""
    out = F.lower(_col(c))
    out = F.regexp_replace(out, f"^{WS}*rt(?!{WORD})[:\\-]*{WS}*", "")
    out = F.regexp_replace(out, f"http{NOT_WS}+", "")
    out = F.regexp_replace(out, f"@{WORD}+", "")
    out = F.regexp_replace(out, f"#{WORD}+", "")
    out = F.regexp_replace(out, r"[^a-z0-9" + WS[1:], "")
    return blank_if_null(squeeze(out))


def min_clean_line(c: Column | str) -> Column:
    """Commas become spaces, white space is squeezed; null stays null."""
    return squeeze(F.replace(_col(c), F.lit(","), F.lit(" ")))


def normalize_words(c: Column | str, slang: Column | None, stopwords: Column | None) -> Column:
    """Each token replaced through the ``slang`` map, then dropped where its lower case is in the ``stopwords`` array; null gives ``''``.

    A replacement of several words is tested against the stop words as a whole. Stop words are compared as they are spelled.
    """
    toks = words(c)
    if slang is not None:
        toks = F.transform(toks, lambda t: F.coalesce(F.try_element_at(slang, t), t))
    if stopwords is not None:
        toks = F.filter(toks, lambda t: ~F.array_contains(stopwords, F.lower(t)))
    return blank_if_null(F.array_join(toks, " "))


def merge_negators(c: Column | str, negators: tuple[str, ...] = ("tidak",)) -> Column:
    """A negator and the token after it become one token with an underscore; pairs are taken greedily from the left."""
    toks = words(c)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(acc: Column, t: Column) -> Column:
        joined = F.struct(F.concat(acc["out"], F.array(F.concat_ws("_", acc["held"], t))).alias("out"), F.lit(None).cast("string").alias("held"))
        kept = F.struct(acc["out"].alias("out"), t.alias("held"))
        plain = F.struct(F.concat(acc["out"], F.array(t)).alias("out"), F.lit(None).cast("string").alias("held"))
        return F.when(acc["held"].isNotNull(), joined).when(t.isin(*negators), kept).otherwise(plain)

    def finish(acc: Column) -> Column:
        return F.array_join(F.when(acc["held"].isNotNull(), F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]), " ")

    return F.aggregate(toks, start, step, finish)


def merge_phrases(c: Column | str, phrases: list[str]) -> Column:
    """Known phrases of several words joined by underscores, longest first and then by name; word boundaries are Unicode ones.

    ``phrases`` comes from a lexicon file that people maintain; it is folded into the expression, one replacement each.
    """
    out = _col(c)
    for phrase in sorted({p for p in phrases if " " in p}, key=lambda p: (-len(p), p)):
        quoted = "".join("\\" + ch if not (ch.isalnum() or ch == " " or ord(ch) > 127) else ch for ch in phrase)
        out = F.regexp_replace(out, f"(?<!{WORD}){quoted}(?!{WORD})", phrase.replace(" ", "_").replace("\\", "\\\\").replace("$", "\\$"))
    return out


def drop_stopwords(c: Column | str, stopwords: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda t: ~F.array_contains(stopwords, F.lower(t))), " ")


def match_key(c: Column | str) -> Column:
    """The form in which quoted answers are compared: stripped, without surrounding quotes, white space squeezed; null gives ``''``."""
    out = strip(c)
    out = F.regexp_replace(out, '^"+|"+$', "")
    out = F.regexp_replace(out, "^'+|'+$", "")
    return blank_if_null(squeeze(out))


def strip_apostrophes(c: Column | str) -> Column:
    """Stripped, then without leading apostrophes, as spreadsheet ids are written."""
    return F.regexp_replace(strip(c), "^'+", "")


def lower_strip(c: Column | str) -> Column:
    """Lower case and stripped; null gives ``''``."""
    return blank_if_null(strip(F.lower(_col(c))))


def vocabulary_tokens(c: Column | str) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"{WORD}{{2,}}"), F.lit(0))
