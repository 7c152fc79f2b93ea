"""Sentiment vectors: parsing, normalising, comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gemaruang.functions.text import WS, strip

#: Entries this near to zero count as zero.
ZERO = 1e-8

_NUMBER = r"[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_LIST = rf"^{WS}*\[{WS}*(?:{_NUMBER}{WS}*(?:,{WS}*{_NUMBER}{WS}*)*,?)?{WS}*\]{WS}*$"
_SCALAR = rf"^{WS}*{_NUMBER}{WS}*$"


def parse_list(c: Column | str) -> Column:
    """array<double> of a bracketed list of numbers; anything else gives null."""
    c = F.col(c) if isinstance(c, str) else c
    inner = F.regexp_replace(strip(c), rf"^\[{WS}*|{WS}*,?{WS}*\]$", "")
    parts = F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: strip(x).try_cast("double")))
    return F.when(c.rlike(_LIST), parts)


def parse_vector(c: Column | str, width: int = 3) -> Column:
    """As the consensus stage reads a cell: a list as it is, a scalar as a list of one, all else ``width`` zeros."""
    c = F.col(c) if isinstance(c, str) else c
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.coalesce(parse_list(c), F.when(c.rlike(_SCALAR), F.array(strip(c).try_cast("double"))), zeros)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def normalize(v: Column) -> Column:
    """Divided by its sum; uniform where the sum is not positive; null stays null."""
    s = total(v)
    return F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(F.transform(v, lambda x: F.lit(1.0) / F.size(v)))


def argmax(v: Column) -> Column:
    """Index of the first largest entry, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def all_zero(v: Column) -> Column:
    return F.forall(v, lambda x: F.abs(x) <= ZERO)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def clean_probabilities(c: Column | str) -> Column:
    """Three probabilities from a model's answer, rounded to 4 places.

    Brackets, letters and ``=`` are removed; not exactly three numbers give zeros. A sum off 1 by more than 0.1 is divided out, or gives zeros where it is not positive.
    """
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(F.regexp_replace(c, r"[\[\]a-zA-Z=]", ""), ","), lambda x: F.round(strip(x).try_cast("double"), 4))
    zeros = F.array_repeat(F.lit(0.0), 3)
    s = total(parts)
    good = (F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull())
    near = F.abs(s - 1) <= 0.1
    return F.when(F.coalesce(good, F.lit(False)), F.when(near, parts).when(s > 0, F.transform(parts, lambda x: x / s)).otherwise(zeros)).otherwise(zeros)


def require_length(v: Column, length: int) -> Column:
    """The vector, or an error naming the length it should have."""
    return F.when(v.isNull() | (F.size(v) == length), v).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {length} entries is needed, one has "), F.size(v).cast("string"))))
