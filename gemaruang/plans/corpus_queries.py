"""Queries on delivered records and reply hierarchies, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemaruang.operators import bad_records, hierarchy

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.parent_links(_table(spark, d, "community_input"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.rejects(_table(spark, d, "raw_records"), _table(spark, d, "absa_predictions"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.parse_records(_table(spark, d, "raw_records")).filter(F.col("reason").isNull()).drop("reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, d))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, d))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_links(spark, d))


def p5_cycles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(_links(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_loaded, p5_found, p5_descendants, p5_paths, p5_cycles)}

_UNIT = r"(0+(\.[0-9]*)?|0*1(\.0*)?|0*\.[0-9]+)"
_PROBS = rf"^\[{_UNIT},{_UNIT},{_UNIT}\]$"
_F = r'("(?:[^"]|"")*"|[^",]*)'
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}\x{fffd}]"



def _unquoted(x: str) -> str:
    return f"""CASE WHEN starts_with({x}, '"') THEN replace({x}[2:-2], '""', '"') ELSE {x} END"""


_PARENT_SQL = f"""
named AS (
  SELECT id, min(nullif(regexp_replace(in_reply_to_status_id, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '')) AS parent
  FROM community_input WHERE id IS NOT NULL AND id <> '' GROUP BY id),
links AS (SELECT a.id, b.id AS parent FROM named a LEFT JOIN named b ON a.parent = b.id),
down AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth, id AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, d.root_id, d.depth + 1, d.path || '/' || l.id FROM down d JOIN links l ON l.parent = d.id),
loose AS (SELECT l.id, l.parent FROM links l WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.id = l.id)),
up AS (SELECT id, parent AS above FROM loose UNION SELECT u.id, l.parent FROM up u JOIN loose l ON l.id = u.above)
"""



_RINGS = "rings AS (SELECT u.id, min(a.above) AS cycle_id FROM up u JOIN up a ON a.id = u.id WHERE u.above = u.id GROUP BY 1)"


def _groups(n: int) -> str:
    """The n fields of a well-formed record as a list."""
    shape = "(?s)^" + ",".join([_F] * n) + "$"
    return "[" + ", ".join(f"regexp_extract(line, '{shape}', {k})" for k in range(1, n + 1)) + "]"


def _parsed_sql() -> str:
    def pick(i: int) -> str:
        return _unquoted(f"coalesce(g5[{i}], g4[{i}])")

    return rf"""
WITH shaped AS (
  SELECT line_no, feed, line, regexp_full_match(line, '(?s){_F}(,{_F})*') AS quoted,
         length(regexp_replace(regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'g'), '[^,]', '', 'g')) + 1 AS n,
         CASE feed WHEN 'community_input' THEN 5 ELSE 4 END AS want
  FROM raw_records WHERE line IS NOT NULL),
cut AS (
  SELECT line_no, feed, quoted, n, want,
         CASE WHEN quoted AND n = 5 AND want = 5 THEN {_groups(5)} END AS g5,
         CASE WHEN quoted AND n = 4 AND want = 4 THEN {_groups(4)} END AS g4
  FROM shaped),
named AS (
  SELECT line_no, feed, quoted, n, want, {pick(1)} AS f1, {pick(2)} AS f2, {pick(3)} AS f3, {pick(4)} AS f4, {_unquoted("g5[5]")} AS f5 FROM cut),
parsed AS (
  SELECT *, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN n <> want THEN 'column_count'
    WHEN NOT regexp_full_match(f1, '[0-9]+') OR regexp_matches(f2, '{_CONTROL}') THEN 'value'
    WHEN want = 5 AND NOT regexp_full_match(f3, '[0-9]*') THEN 'value'
    WHEN want = 4 AND NOT regexp_matches(regexp_replace(f4, '[{_WS}]', '', 'g'), '{_PROBS}') THEN 'value'
  END AS reason FROM named)
"""


SQL: dict[str, str] = {
    "p4_found": _parsed_sql()
    + rf"""SELECT 'raw_records' AS src, line_no AS row_key, reason FROM parsed WHERE reason IS NOT NULL
UNION ALL SELECT 'absa_predictions', pred_id, 'value' FROM absa_predictions
WHERE regexp_replace(sentiment_prob, '[{_WS}]', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(sentiment_prob, '[{_WS}]', '', 'g'), '{_PROBS}')""",
    "p4_loaded": _parsed_sql()
    + """SELECT line_no, feed, f1 AS id, f2 AS text, CASE WHEN want = 5 THEN f3 END AS in_reply_to_status_id, CASE WHEN want = 5 THEN f4 END AS in_reply_to_screen_name, f5 AS name,
CASE WHEN want = 4 THEN f3 END AS aspect_category, CASE WHEN want = 4 THEN f4 END AS sentiment_prob FROM parsed WHERE reason IS NULL""",
    "p5_found": f"WITH RECURSIVE {_PARENT_SQL} SELECT id, root_id, depth FROM down UNION ALL SELECT id, '', CASE WHEN EXISTS (SELECT 1 FROM up u WHERE u.id = l.id AND u.above = l.id) THEN -1 ELSE -2 END FROM loose l",
    "p5_paths": f"WITH RECURSIVE {_PARENT_SQL} SELECT id, path FROM down",
    "p5_cycles": f"WITH RECURSIVE {_PARENT_SQL}, {_RINGS} SELECT r.id, cycle_id, l.parent = cycle_id AS back_edge FROM rings r JOIN links l USING (id)",
    "p5_descendants": f"""WITH RECURSIVE {_PARENT_SQL}, {_RINGS},
tree AS (SELECT l.id, l.parent FROM links l WHERE l.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rings r WHERE r.id = l.id)),
pairs AS (SELECT parent AS id, id AS descendant, 1::BIGINT AS distance FROM tree
  UNION ALL SELECT p.id, t.id, p.distance + 1 FROM pairs p JOIN tree t ON t.parent = p.descendant)
SELECT id, descendant, distance FROM pairs""",
}
