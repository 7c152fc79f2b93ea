"""Loading CSV records of which some do not parse.

Blocks of records go through a columnar path: one regular expression over the whole block decides whether every record is
well formed for its number of columns, Arrow's CSV reader parses the block, and vectorised tests check the values. A block
that fails any of these is halved, again and again, until the bad records stand alone; only those are read by the strict
scanner, which names the first reason that applies: ``quoting``, ``column_count`` or ``value``.

Null or empty lines: an empty line is a record of one empty field (``column_count``); null lines are no records and give no
row. Unknown feeds give ``feed``. Extra columns of the input are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.session import spread

FIELDS = {
    "community_input": ["id", "text", "in_reply_to_status_id", "in_reply_to_screen_name", "name"],
    "absa_predictions": ["id", "text", "aspect_category", "sentiment_prob"],
}
BLOCK = 512

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_UNIT = r"(?:0+(?:\.[0-9]*)?|0*1(?:\.0*)?|0*\.[0-9]+)"
#: Exactly three plain decimals from 0 to 1 in brackets, once white space is taken out.
PROBABILITIES = rf"^\[{_UNIT},{_UNIT},{_UNIT}\]$"
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")
_RE2_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}\x{fffd}]"
_RE2_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def valid_probabilities(value: str) -> bool:
    return re.match(PROBABILITIES[:-1] + r"\Z", re.sub(_SPACES, "", value)) is not None


def diagnose(line: str, fields: list[str]) -> tuple[str, list[str] | None]:
    """The strict scanner: (reason or '', fields)."""
    out, i, n, ok = [], 0, len(line), True
    while ok:
        if i < n and line[i] == '"':
            j, part = i + 1, []
            while True:
                k = line.find('"', j)
                if k < 0:
                    return "quoting", None
                part.append(line[j:k])
                if line[k + 1 : k + 2] == '"':
                    part.append('"')
                    j = k + 2
                    continue
                i = k + 1
                break
            if i < n and line[i] != ",":
                return "quoting", None
            out.append("".join(part))
        else:
            k = line.find(",", i)
            k = n if k < 0 else k
            part = line[i:k]
            if '"' in part:
                return "quoting", None
            out.append(part)
            i = k
        if i >= n:
            break
        i += 1
    if len(out) != len(fields):
        return "column_count", None
    row = dict(zip(fields, out))
    bad = not re.fullmatch("[0-9]+", row["id"]) or _CONTROL.search(row["text"])
    if "in_reply_to_status_id" in row:
        bad = bad or not re.fullmatch("[0-9]*", row["in_reply_to_status_id"])
    if "sentiment_prob" in row:
        bad = bad or not valid_probabilities(row["sentiment_prob"])
    return ("value", None) if bad else ("", out)


def _all(mask: pa.ChunkedArray | pa.Array) -> bool:
    return bool(pc.all(mask, min_count=0).as_py())


def bulk_parse(lines: pa.Array, fields: list[str]) -> pa.Table | None:
    """All records of the block as a table of strings, or None where any of them is not fully valid."""
    if len(lines) == 0:
        return None
    shape = rf"^{_FIELD}(?:,{_FIELD}){{{len(fields) - 1}}}$"
    if not _all(pc.match_substring_regex(lines, "(?s)" + shape.replace("^", r"\A", 1)[:-1] + r"\z")):
        return None
    # a record may hold lone carriage returns or be one empty field; such blocks are left to the strict scanner
    try:
        body = pc.binary_join(pa.array([lines.to_pylist()], pa.list_(pa.string())), "\n")[0].as_py() + "\n"
        table = pacsv.read_csv(
            io.BytesIO(body.encode("utf-8", "surrogatepass")),
            pacsv.ReadOptions(column_names=fields, use_threads=False, block_size=max(1 << 20, 2 * len(body))),
            pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types={f: pa.string() for f in fields}, strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except (pa.ArrowInvalid, UnicodeError):
        return None
    if table.num_rows != len(lines):
        return None
    checks = [pc.match_substring_regex(table["id"], r"\A[0-9]+\z"), pc.invert(pc.match_substring_regex(table["text"], _RE2_CONTROL))]
    if "in_reply_to_status_id" in fields:
        checks.append(pc.match_substring_regex(table["in_reply_to_status_id"], r"\A[0-9]*\z"))
    if "sentiment_prob" in fields:
        squeezed = pc.replace_substring_regex(table["sentiment_prob"], _RE2_SPACES, "")
        checks.append(pc.match_substring_regex(squeezed, r"\A" + PROBABILITIES[1:-1] + r"\z"))
    return table if all(map(_all, checks)) else None


def bisect(lines: pa.Array, fields: list[str], good: Callable[[int, pa.Table], None], bad: Callable[[int, str], None], start: int = 0) -> None:
    """Report valid runs as tables and bad records one by one, in order."""
    todo = [(start, lines)]
    while todo:
        at, block = todo.pop()
        table = bulk_parse(block, fields)
        if table is not None:
            good(at, table)
        elif len(block) == 1:
            reason, row = diagnose(block[0].as_py(), fields)
            if reason:
                bad(at, reason)
            else:
                good(at, pa.table({f: pa.array([v], pa.string()) for f, v in zip(fields, row)}))
        elif len(block) > 1:
            half = len(block) // 2
            todo += [(at + half, block.slice(half)), (at, block.slice(0, half))]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = list(dict.fromkeys(f for fields in FIELDS.values() for f in fields))
    schema = pa.schema([("line_no", pa.int64()), ("feed", pa.string()), ("reason", pa.string()), *((f, pa.string()) for f in names)])
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        for feed in pc.unique(whole["feed"]).to_pylist():
            part = whole.filter(pc.equal(whole["feed"], feed)) if feed is not None else whole.filter(pc.is_null(whole["feed"]))
            keys, lines = part["line_no"].combine_chunks(), part["line"].combine_chunks()
            if feed not in FIELDS:
                nulls = {f: pa.nulls(len(keys), pa.string()) for f in names}
                yield from pa.table({"line_no": keys, "feed": pa.array([feed] * len(keys), pa.string()), "reason": pa.array(["feed"] * len(keys), pa.string()), **nulls}, schema=schema).to_batches()
                continue
            fields, tables, bad_at, why = FIELDS[feed], [], [], []

            def good(at: int, table: pa.Table) -> None:
                n = table.num_rows
                tables.append(pa.table({"line_no": keys.slice(at, n), "feed": pa.array([feed] * n, pa.string()), "reason": pa.nulls(n, pa.string()), **{f: table[f] if f in fields else pa.nulls(n, pa.string()) for f in names}}, schema=schema))

            def bad(at: int, reason: str) -> None:
                bad_at.append(at)
                why.append(reason)

            for start in range(0, len(lines), BLOCK):
                bisect(lines.slice(start, BLOCK), fields, good, bad, start)
            if bad_at:
                n = len(bad_at)
                tables.append(pa.table({"line_no": keys.take(pa.array(bad_at)), "feed": pa.array([feed] * n, pa.string()), "reason": pa.array(why, pa.string()), **{f: pa.nulls(n, pa.string()) for f in names}}, schema=schema))
            for t in tables:
                yield from t.combine_chunks().to_batches()


def parse_records(raw: DataFrame) -> DataFrame:
    """line_no, feed, reason and the fields of all feeds: ``reason`` is null for valid records, whose own fields are set."""
    names = list(dict.fromkeys(f for fields in FIELDS.values() for f in fields))
    schema = "line_no long, feed string, reason string, " + ", ".join(f"`{n}` string" for n in names)
    lines = raw.select(F.col("line_no").cast("long").alias("line_no"), "feed", "line").filter(F.col("line").isNotNull())
    return spread(lines).mapInArrow(_parse, schema)


def split_records(raw: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows with the fields of ``feed``, rejects with line_no and reason)."""
    parsed = parse_records(raw.filter(F.col("feed") == feed))
    return parsed.filter(F.col("reason").isNull()).select("line_no", *FIELDS[feed]), parsed.filter(F.col("reason").isNotNull()).select("line_no", "reason")


def bad_probabilities(predictions: DataFrame) -> DataFrame:
    """(row_key, reason): non-blank sentiment_prob values that are no bracketed list of three plain decimals from 0 to 1."""
    squeezed = F.regexp_replace("sentiment_prob", _SPACES, "")
    return predictions.filter((squeezed != "") & ~squeezed.rlike(PROBABILITIES.replace("^", r"\A", 1)[:-1] + r"\z")).select(F.col("pred_id").cast("long").alias("row_key"), F.lit("value").alias("reason"))


def rejects(raw: DataFrame, predictions: DataFrame) -> DataFrame:
    """(src, row_key, reason) of both sources."""
    records = parse_records(raw).filter(F.col("reason").isNotNull()).select(F.lit("raw_records").alias("src"), F.col("line_no").alias("row_key"), "reason")
    return records.unionByName(bad_probabilities(predictions).select(F.lit("absa_predictions").alias("src"), "row_key", "reason"))
