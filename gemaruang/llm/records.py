r"""One record of all rows that differ only in formatting, with the number of copies.

The canonical bytes of a text leave out letter case, white space and punctuation; in a text of three or more
``field: value`` parts the parts are sorted. Rows are spread by recursive radix partitioning on those bytes:

1. A bucket is the set of rows that share a prefix, named by its digest. Buckets are counted by one hash aggregation, combined per task
   before the shuffle. One that holds more than ``limit`` rows or ``most_chars`` characters is split by further bytes, first past what all its
   members have in common (the common prefix of its smallest and largest value), until each fits. Only rows of such buckets
   are looked at again, and only numbers of such buckets are broadcast: at most (rows / ``limit``) at each level.
2. A large bucket whose rows all have the same 128-bit digest is one record, however many rows it has; no byte can split it.
   Its first row is known from the counting, so its rows need not meet anywhere.
3. All other rows are shuffled and sorted by bucket into tries with terminal counters. A task holds the trie of one bucket at a time. A node's
   edges are runs of bytes and a leaf keeps its whole remainder until a second key shares its path, so a key costs a few
   steps whatever its length.

Null texts and texts without letter or digit are no records. Ties: the smallest key is the first row of a record.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemaruang.functions.text import NOT_WS, WS
from gemaruang.session import cut, shuffle_partitions

_PUNCT = r"\p{P}!-/:-@\[-`{-~"
_IGNORED = "[" + _PUNCT + WS[1:-1] + "]+"
_PART = rf"^{WS}*[\p{{L}}\p{{N}}_\-][\p{{L}}\p{{N}}_\- ]{{0,39}}{WS}*[:=](?s:.*)$"
_FIRST_PART = rf"^(?:{WS}|[;|\n\r])*[\p{{L}}\p{{N}}_\-][\p{{L}}\p{{N}}_\- ]{{0,39}}{WS}*[:=]"
_HAS_SIGN = r"[\p{L}\p{N}]"
_END = "\x00"
_STEP = 8


def canonical_bytes(c: Column | str) -> Column:
    """The canonical form whose equality is equality of records; null where there is no letter or digit."""
    out = _canonical(F.col(c) if isinstance(c, str) else c)
    return F.when(out.rlike(_HAS_SIGN), out)


def _canonical(c: Column) -> Column:
    """The canonical form, empty where nothing is left. The parts are looked at only where the first one has a field's form."""

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.lower(F.upper(x)), _IGNORED, "")

    parts = F.filter(F.split(c, r"[;|\n\r]+"), lambda p: p.rlike(NOT_WS))
    fielded = (F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(_PART))
    return F.when(c.rlike(_FIRST_PART), F.when(fielded, F.array_join(F.array_sort(F.transform(parts, plain)), "")).otherwise(plain(c))).otherwise(plain(c))


def _bucket(length: Column) -> Column:
    """The digest of the first so many characters of the form with its end mark; of the whole where it is shorter."""
    return F.xxhash64(F.concat("canon", F.lit(_END)).substr(F.lit(1), length))


def _common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Length of the next prefix of each bucket: two characters past what its smallest and largest value share."""
    for b in batches:
        shared = [len(os.path.commonprefix([x + _END, y + _END])) for x, y in zip(b["least"], b["most"])]
        yield pd.DataFrame({"bucket": b["bucket"], "length": [n + 2 for n in shared]}).astype({"length": "int32"})


def split_plan(keys: DataFrame, limit: int, most_chars: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, whole): for each level the (bucket, length) to split further; (h1, h2, first, copies) of large buckets that are one record.

    ``keys`` has (k, canon, h1, h2). Nothing but the number of large buckets comes to the driver.
    """
    levels, whole = [], []
    rows = keys.withColumn("bucket", _bucket(F.lit(2)))
    while True:
        sums = rows.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("copies"), F.sum(F.length("canon")).alias("chars"), F.min("k").alias("first"), F.min("h1").alias("h1"), F.max("h1").alias("g1"), F.min("h2").alias("h2"), F.max("h2").alias("g2")
        )
        large = cut(sums.filter((F.col("copies") > limit) | (F.col("chars") > most_chars)))
        one = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
        whole.append(large.filter(one).select("h1", "h2", "first", "copies"))
        split = large.filter(~one).select("bucket")
        if split.isEmpty():
            break
        inside = rows.join(F.broadcast(split), "bucket")
        ends = inside.groupBy("bucket").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
        levels.append(cut(ends.mapInPandas(_common, "bucket long, length int")))
        rows = cut(inside.join(F.broadcast(levels[-1]), "bucket").withColumn("bucket", _bucket(F.col("length"))).drop("length"))
    out = whole[0]
    for w in whole[1:]:
        out = out.unionByName(w)
    return levels, out


class Trie:
    """A burst trie over canonical bytes: edges of up to 8 bytes, terminal counters at the ends."""

    def __init__(self) -> None:
        self.root: dict[bytes, list] = {}
        self.first: list[int] = []
        self.count: list[int] = []

    def _new(self, key: int) -> int:
        self.first.append(key)
        self.count.append(0)
        return len(self.first) - 1

    def add(self, canon: bytes, key: int) -> int:
        """The terminal of ``canon``, its counter raised and its first row kept."""
        node, at = self.root, 0
        while True:
            edge = canon[at : at + _STEP]
            at += _STEP
            slot = node.get(edge)
            if slot is None:
                node[edge] = slot = [canon[at:], self._new(key), None]  # a leaf: remainder, terminal, children
                break
            rest = slot[0]
            if rest is not None:
                if rest == canon[at:]:
                    break
                # a second key on this path: the leaf's remainder moves one edge down
                if len(edge) == _STEP:
                    slot[2] = {rest[:_STEP]: [rest[_STEP:], slot[1], None]}
                    slot[0] = slot[1] = None
                else:
                    break
            node = slot[2]
        t = slot[1]
        self.count[t] += 1
        if key < self.first[t]:
            self.first[t] = key
        return t


def _count_tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole buckets, sorted by bucket: one trie at a time, then each row with the first row and the copies of its record."""
    done: dict[str, list[int]] = {"first": [], "k": [], "copies": []}

    def finish(trie: Trie, ends: list[int], keys: list[int]) -> None:
        done["first"] += [trie.first[e] for e in ends]
        done["k"] += keys
        done["copies"] += [trie.count[e] for e in ends]

    bucket, trie, ends, keys = None, Trie(), [], []
    for b in batches:
        for at, canon, key in zip(b["bucket"], b["canon"], b["k"]):
            if at != bucket:
                finish(trie, ends, keys)
                bucket, trie, ends, keys = at, Trie(), [], []
            ends.append(trie.add(canon.encode("utf-8", "surrogatepass"), key))
            keys.append(key)
        if len(done["k"]) >= 10_000:
            yield pd.DataFrame(done)
            done = {"first": [], "k": [], "copies": []}
    finish(trie, ends, keys)
    yield pd.DataFrame(done).astype("int64")


def record_members(df: DataFrame, key: str = "row_id", text: str = "text", limit: int = 250_000, most_chars: int = 64_000_000) -> DataFrame:
    """(first_key, key, copies) of every row that is a record: the record's smallest key and its number of rows.

    ``limit`` and ``most_chars`` are the rows and characters a bucket may hold and so bound what a task keeps.
    """
    spark = df.sparkSession
    given = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull() & F.col("k").isNotNull())
    # what has no letter or digit is left out after the cut: a filter before it would work out every form twice
    forms = cut(given.select("k", _canonical(F.col("t")).alias("canon"))).filter(F.col("canon").rlike(_HAS_SIGN))
    keys = forms.withColumns({"h1": F.xxhash64("canon"), "h2": F.xxhash64(F.lit("other"), "canon")})
    levels, whole = split_plan(keys, limit, most_chars)
    # at most (rows / limit) records, of four numbers each
    known = F.broadcast(whole.select("h1", "h2", "first", "copies"))
    met = keys.join(known, ["h1", "h2"]).select("first", "k", "copies")
    rest = keys.join(known, ["h1", "h2"], "left_anti").select("k", "canon", _bucket(F.lit(2)).alias("bucket"))
    for level in levels:
        rest = rest.join(F.broadcast(level), "bucket", "left").select("k", "canon", F.coalesce(F.when(F.col("length").isNotNull(), _bucket(F.col("length"))), F.col("bucket")).alias("bucket"))
    rows, chars = forms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("canon")), F.lit(0))).first()
    tasks = max(shuffle_partitions(spark), -(-rows // limit), -(-chars // most_chars))
    counted = rest.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(_count_tries, "first long, k long, copies long")
    return counted.unionByName(met).select(F.col("first").alias(f"first_{key}"), F.col("k").alias(key), "copies")


def records(df: DataFrame, key: str = "row_id", text: str = "text", limit: int = 250_000, most_chars: int = 64_000_000) -> DataFrame:
    """The first row of each record with all its columns and ``record_copies``; a column of that name is replaced."""
    members = record_members(df, key, text, limit, most_chars)
    firsts = members.filter(F.col(key) == F.col(f"first_{key}")).select(F.col(key), F.col("copies").alias("record_copies"))
    return df.drop("record_copies").join(firsts, key)
