"""Verbs on corpora: ids, projections, filters, cleaning, merging.

Rows have no order in Spark. Where "first" or "last" matters the caller names an order column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemaruang.functions import text as T
from gemaruang.operators.ranking import with_rank

#: Words that filtering of stop-word lists keeps (fixed values).
SAFE_KEEP = frozenset(
    """tidak tak bukan jangan belum enggak gak
    dan atau tetapi namun tapi serta sementara sedangkan &
    walaupun meskipun padahal biarpun sekalipun
    sangat banget amat
    harus bisa mesti boleh dapat masih sudah""".split()
)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def text_ids(df: DataFrame, text: str = "text", name: str = "id") -> DataFrame:
    """Every row with the rank of its text among the distinct texts in order, from 1; null text has a null id.

    Ranks need a total order but not one task; see ``with_rank``.
    """
    distinct = df.select(F.col(text).alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    numbered = with_rank(distinct, ["__t"], name)
    return df.drop(name).join(numbered, F.col(text) == F.col("__t"), "left").drop("__t")


def extract_corpus(df: DataFrame) -> DataFrame:
    """Distinct id and text, and the community where there is one."""
    require(df, ["id", "text"])
    return df.select("id", "text", *[c for c in ["community"] if c in df.columns]).distinct()


def absa_input(df: DataFrame) -> DataFrame:
    return require(df, ["id", "text"]).select("id", "text")


def drop_columns(df: DataFrame, columns: list[str], invert: bool = False) -> DataFrame:
    """Without the named columns; inverted: only these, in the given order. Names that are absent are ignored."""
    present = [c for c in columns if c in df.columns]
    return df.select(*present) if invert else df.drop(*present)


def drop_rows(df: DataFrame, condition: str | Column, invert: bool = False) -> DataFrame:
    """Without the rows that meet the condition, which may be unknown for nulls; inverted: only those that meet it.

    The condition is a Spark SQL expression. One that cannot be resolved selects all rows, so that the plain form drops them all.
    """
    test = F.expr(condition) if isinstance(condition, str) else condition
    try:
        df.filter(test).schema  # noqa: B018
    except Exception:
        test = F.lit(True)
    met = F.coalesce(test, F.lit(False))
    return df.filter(met if invert else ~met)


def clean_column(df: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """Rows with a text, cleaned into ``text``."""
    require(df, [text, id_column])
    return df.filter(F.col(text).isNotNull()).withColumn("text", T.clean_line(text))


def min_clean(df: DataFrame, text: str = "text") -> DataFrame:
    require(df, [text])
    return df.filter(F.col(text).isNotNull()).withColumn(text, T.min_clean_line(text))


def last_of(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row for each key: the value of its last row."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def as_map(df: DataFrame, key: str, value: str, most: int = 500_000) -> Column:
    """A literal map of a lexicon that people maintain; its size is checked against ``most`` entries."""
    rows = df.select(key, value).filter(F.col(key).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has more than {most} entries; join it instead")
    if not rows:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(r[0]) for r in rows]), F.array(*[F.lit(r[1]) for r in rows]))


def as_array(df: DataFrame, column: str, most: int = 500_000) -> Column:
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the list has more than {most} entries")
    return F.array(*[F.lit(r[0]) for r in rows]) if rows else F.array().cast("array<string>")


def normalize(df: DataFrame, text: str = "text", slang: DataFrame | None = None, stopwords: DataFrame | None = None) -> DataFrame:
    """``text`` with slang replaced and stop words dropped; either list may be left out."""
    table = as_map(slang, "slang", "formal") if slang is not None else None
    stops = as_array(stopwords, "word") if stopwords is not None else None
    return df.withColumn("text", T.normalize_words(text, table, stops))


def merge_slang(txt: DataFrame | None, csv: DataFrame | None, order: str = "ord") -> DataFrame:
    """(slang, formal): the csv entries override those of the text file; within each the last row counts."""
    parts = [d.select("slang", "formal", F.struct(F.lit(rank), F.col(order)).alias("o")) for rank, d in enumerate((txt, csv)) if d is not None]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("slang").agg(F.max_by("formal", "o").alias("formal"))


def filter_stopwords(words: DataFrame, keep: Iterable[str] = SAFE_KEEP, column: str = "word") -> DataFrame:
    """The sorted stop words without those to keep; the input is not changed."""
    out = words.select(T.strip(column).alias(column)).filter(F.col(column) != "").distinct()
    return out.filter(~F.col(column).isin(*keep)).orderBy(column)


def unique_aspects(df: DataFrame, column: str = "aspect_category_final") -> DataFrame:
    """Distinct stripped values in order, blank ones included as ``''``; null counts as blank."""
    return df.select(T.blank_if_null(T.strip(column)).alias("aspect_category")).distinct().orderBy("aspect_category")


def merge_on_id(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Inner join on the id; the right id is stripped of apostrophes, null ids match, columns named alike get ``_x`` and ``_y``."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    a = left.select(*[F.col(c).alias(f"{c}_x" if c in shared else c) for c in left.columns])
    b = right.select(*[(T.strip_apostrophes(c).alias("__key") if c == key else F.col(c).alias(f"{c}_y" if c in shared else c)) for c in right.columns])
    return a.join(b, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def replace_phrase(df: DataFrame, phrase: str, replacement: str, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.replace(F.col(text), F.lit(phrase), F.lit(replacement)))


def text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """(value): stripped texts without blank ones, as they go into a text file."""
    return df.select(T.strip(text).alias("value")).filter(F.col("value") != "")


def column_names(values: list[str], taken: Iterable[str]) -> list[str]:
    """A column name for each value: the value itself, with a number behind it where one before it differs by case only."""
    used, out = {t.lower() for t in taken}, []
    for v in values:
        name, n = v, 1
        while name.lower() in used:
            n += 1
            name = f"{v}_{n}"
        used.add(name.lower())
        out.append(name)
    return out


def pivot_aspects(predictions: DataFrame, meta: DataFrame, order: str = "ord", most_aspects: int = 10_000) -> DataFrame:
    """id, one column for each aspect in order, community: the last prediction of each id and aspect, blank where there is none.

    Duplicate rows of ``meta`` stay; predictions for unknown ids only add their column. Columns of aspects that differ by case only, or from ``id`` and
    ``community``, are told apart as in ``column_names``. More than ``most_aspects`` aspects are no table; ``long_aspects`` has them all.
    """
    names = [r[0] for r in predictions.select("aspect_category").filter(F.col("aspect_category").isNotNull()).distinct().orderBy("aspect_category").limit(most_aspects + 1).collect()]
    if len(names) > most_aspects:
        raise ValueError(f"more than {most_aspects} aspects; keep the long form")
    columns = [f"a{i}" for i in range(len(names))]
    last = predictions.groupBy("id", "aspect_category").agg(F.max_by("sentiment_prob", order).alias("p"))
    wide = last.groupBy("id").pivot("aspect_category", names).agg(F.max("p")).toDF("id", *columns) if names else last.select("id").distinct()
    joined = meta.select("id", F.col("community").cast("string").alias("community")).join(wide, "id", "left")
    return joined.select("id", *columns, "community").na.fill("", [*columns, "community"]).toDF("id", *column_names(names, ("id", "community")), "community")


def unpivot_aspects(wide: DataFrame, names: list[str]) -> DataFrame:
    """(id, community, aspect, sentiment_prob) of the cells of ``pivot_aspects`` that are not blank, ``names`` being those of its columns in order."""
    plain = wide.toDF("id", *[f"a{i}" for i in range(len(names))], "community")
    cells = plain.select("id", "community", F.posexplode(F.array(*[f"a{i}" for i in range(len(names))])).alias("i", "sentiment_prob")).filter("sentiment_prob <> ''")
    table = wide.sparkSession.createDataFrame(list(enumerate(names)), "i int, aspect string")
    return cells.join(F.broadcast(table), "i").select("id", "community", "aspect", "sentiment_prob")


def long_aspects(predictions: DataFrame, meta: DataFrame, order: str = "ord") -> DataFrame:
    """(id, community, aspect, vec): what pivot_aspects shows, kept long and parsed."""
    from gemaruang.functions.vectors import parse_vector

    last = predictions.groupBy("id", F.col("aspect_category").alias("aspect")).agg(F.max_by("sentiment_prob", order).alias("p"))
    return meta.select("id", "community").join(last, "id").select("id", "community", "aspect", parse_vector("p").alias("vec"))
