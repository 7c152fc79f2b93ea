"""Registered queries of this subpackage and their SQL; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemaruang.llm import canonical, encoding, language, mapping, packing, personal, reading, records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_table(spark, d, "community_input"))


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    tweets = _table(spark, d, "community_input")
    return language.languages(tweets, language.train(tweets))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_items(_table(spark, d, "community_input"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(_table(spark, d, "community_input"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members = records.record_members(_table(spark, d, "community_input"))
    return members.filter(F.col("row_id") != F.col("first_row_id")).select("first_row_id", "row_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return records.records(_table(spark, d, "community_input"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_values(_table(spark, d, "absa_predictions"), _table(spark, d, "aspects"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return mapping.unmatched_values(_table(spark, d, "absa_predictions"), _table(spark, d, "aspects"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_pairs(_table(spark, d, "community_input"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_classes(_table(spark, d, "community_input"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_column(_table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(_table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels")).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(reading.reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_languages, p2_found, p2_redacted, p3_found, p3_records, p6_found, p6_unmatched, p7_found, p7_classes, p8_ids, p9_containers, p9_fill, p10_found, p10_profile,
    )
}

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PLAIN = lambda c: f"regexp_replace(lower(upper({c})), '[\\p{{P}}!-/:-@\\[-`\\{{-~{_WS}]+', '', 'g')"
_RECORD = rf"""
parts AS (SELECT row_id, text, list_filter(regexp_split_to_array(text, '[;|\n\r]+'), lambda p: regexp_replace(p, '[{_WS}]+', '', 'g') <> '') AS ps FROM community_input WHERE text IS NOT NULL),
forms AS (SELECT row_id, CASE WHEN len(ps) >= 3 AND len(list_filter(ps, lambda p: NOT regexp_matches(p, '(?s)^[{_WS}]*[\p{{L}}\p{{N}}_\-][\p{{L}}\p{{N}}_\- ]{{0,39}}[{_WS}]*[:=]'))) = 0
  THEN array_to_string(list_sort(list_transform(ps, lambda p: {_PLAIN('p')})), '') ELSE {_PLAIN('text')} END AS form FROM parts),
recs AS (SELECT row_id, min(row_id) OVER (PARTITION BY form) AS first_row_id, count(*) OVER (PARTITION BY form) AS copies FROM forms WHERE regexp_matches(form, '[\p{{L}}\p{{N}}]'))"""

# the one form, as far as SQL has the functions: letters are exchanged before composing, and joined emoji are not told apart
_SEEN = "".join(a for a, _ in canonical.LOOK_ALIKES.values()) + "".join(chr(0xFF01 + i) for i in range(94)) + "    　" + "".join(chr(0x2000 + i) for i in range(11))
_MEANT = "".join(b for _, b in canonical.LOOK_ALIKES.values()) + "".join(chr(0x21 + i) for i in range(94)).replace("'", "''") + " " * 16
_FORM = rf"nfc_normalize(translate(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '[\p{{Cf}}\x{{34f}}\x{{fe00}}-\x{{fe0f}}]', '', 'g'), '{_SEEN}', '{_MEANT}'))"
_LOOK = rf"looks AS (SELECT row_id, text, {_FORM} AS form FROM community_input WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]'))"

SQL: dict[str, str] = {
    "p3_found": f"WITH {_RECORD} SELECT first_row_id, row_id FROM recs WHERE row_id <> first_row_id",
    "p3_records": f"WITH {_RECORD} SELECT c.*, recs.copies AS record_copies FROM recs JOIN community_input c USING (row_id) WHERE row_id = first_row_id",
    "p7_found": f"WITH {_LOOK} SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM looks a JOIN looks b ON a.form = b.form AND a.row_id < b.row_id AND a.text <> b.text",
    "p7_classes": f"WITH {_LOOK}, v AS (SELECT *, min(row_id) OVER (PARTITION BY form, text) AS variant_id, min(row_id) OVER (PARTITION BY form) AS class_id FROM looks), k AS (SELECT form, count(DISTINCT text) AS variants FROM looks GROUP BY 1) SELECT row_id, class_id, variant_id, variants FROM v JOIN k USING (form)",
}
