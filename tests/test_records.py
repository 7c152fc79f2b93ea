import random

import pyarrow as pa
from pyspark.sql import functions as F

from gemaruang.operators import bad_records as B
from gemaruang.streaming import verbs

GOOD = ['1,teks,,,"nama"', '"2","a ""b"", c",5,x,y', '3,"baris\nbaru",,,', "4,,,,"]
BAD = [
    ("quoting", '5,"a"b,,,'), ("quoting", '6,a"b,,,'), ("quoting", '7,"open,,,'), ("quoting", '8,"a" ,,,'), ("column_count", "9,a"), ("column_count", ""), ("column_count", "1,2,3,4,5,6"),
    ("value", "x,a,,,"), ("value", ",a,,,"), ("value", "1,a,n/a,,"), ("value", "1,a\x01b,,,"), ("value", "1,�,,,"), ("quoting", 'a"b'),
]


def test_diagnosis_and_bisection_agree():
    fields = B.FIELDS["community_input"]
    rng = random.Random(3)
    lines = [(None, g) for g in GOOD * 40] + BAD * 3
    rng.shuffle(lines)
    good, bad = [], {}
    B.bisect(pa.array([x for _, x in lines]), fields, lambda at, t: good.extend(range(at, at + t.num_rows)), lambda at, why: bad.__setitem__(at, why))
    assert bad == {i: why for i, (why, _) in enumerate(lines) if why}
    assert sorted(good) == [i for i, (why, _) in enumerate(lines) if not why]
    assert B.diagnose('2,"a ""b"", c",,,', fields)[1][1] == 'a "b", c'


def test_probabilities():
    for x in ("[0.1, 0.2, 0.7]", " [ 0 , 1 , 1.00 ] ", "[.5,0.50,0.]"):
        assert B.valid_probabilities(x), x
    for x in ("", "[0.1,0.2]", "[1.01,0,0]", "[-0.1,0,0]", "[+0.1,0,0]", "[1e-1,0,0]", "[10%,0,0]", "0.1,0.2,0.7", "[0.1,0.2,0.7]x", "[a,b,c]", "[0.1,0.2,0.7,]", "[0.1,0.2,0.3]\n["):
        assert not B.valid_probabilities(x), x


def test_load_with_odd_rows(spark):
    rows = [(1, "community_input", GOOD[0], 9), (2, "absa_predictions", '1,t,a,"[0.1,0.2,0.7]"', 9), (3, "absa_predictions", "1,t,a,[0.1]", 9), (4, "other", "x", 9), (5, "community_input", None, 9), (6, None, "x", 9), (7, "community_input", "1," + "x" * 100_000 + ",,,", 9)]
    raw = spark.createDataFrame(rows, "line_no long, feed string, line string, reason int")
    got = {r["line_no"]: r["reason"] for r in B.parse_records(raw).collect()}
    assert got == {1: None, 2: None, 3: "value", 4: "feed", 6: "feed", 7: None}
    good, bad = B.split_records(raw, "absa_predictions")
    assert good.count() == 1 and bad.count() == 1
    assert B.parse_records(raw.limit(0)).count() == 0
    p = spark.createDataFrame([(1, " "), (2, None), (3, "[1]"), (4, "[1,0,0]")], "pred_id long, sentiment_prob string")
    assert [r["row_key"] for r in B.bad_probabilities(p).collect()] == [3]


def test_stream(spark, tmp_path):
    rows = [("2025-01-01 00:00:00", "a", "[1,0,0]"), ("2025-01-01 05:00:00", "a", "[0,1,0]"), ("2025-01-02 00:00:00", "b", "x"), ("2025-02-02 00:00:00", "b", "[0,0,1]"), ("2025-03-02 00:00:00", "b", "[0,0,1]")]
    df = spark.createDataFrame(rows, "t string, aspect_category string, sentiment_prob string").select(F.to_timestamp("t").alias("predicted_at"), "aspect_category", "sentiment_prob")
    df.write.parquet(str(tmp_path / "in"))
    stream = verbs.read_folder(spark, str(tmp_path / "in"), df.schema)
    q = verbs.aspect_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["start"])[:10], r["aspect_category"]): (r["rows"], r["positive"]) for r in spark.table("counts").collect()}
    assert got[("2025-01-01", "a")] == (2, 1.0)
