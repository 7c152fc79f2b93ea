import pytest
from pyspark.sql import functions as F

from gemaruang.operators import metrics, propagation, responses, tables
from gemaruang.plans import pipeline
from gemaruang.sources import files, parsed

CONLLU = "# text\n1\tVaksin\tvaksin\tNOUN\t_\t_\t2\tnsubj\t_\t_\n2\taman\taman\tADJ\t_\t_\t0\troot\t_\t_\n3\tmurah\tmurah\tADJ\t_\t_\t2\tconj\t_\t_\n3-4\tx\t_\t_\t_\t_\t_\t_\n1.1\ty\t_\t_\t_\t_\t_\t_\nshort\n"


@pytest.fixture(scope="module")
def world(spark):
    tokens = parsed.conllu_tokens(spark.createDataFrame([(1, "t1", CONLLU), (2, "t2", "")], "doc int, id string, conllu string"))
    aspects = spark.createDataFrame([(1, "vaksin", "keamanan efek vaksin"), (2, "biaya", "harga vaksin")], "aspect_ord int, aspect_category string, description string")
    lexicon = spark.createDataFrame([("aman", 3.0)], "word string, weight double")
    return tokens, aspects, lexicon


def test_conllu(world):
    rows = world[0].orderBy("tok").collect()
    assert [(r["wid"], r["text"], r["pos"], r["head"]) for r in rows] == [(1, "Vaksin", "NOUN", 2), (2, "aman", "ADJ", 0), (3, "murah", "ADJ", 2)]


def test_double_propagation(spark, world):
    tokens, aspects, lexicon = world
    edges = propagation.dependency_edges(tokens)
    known = propagation.fixpoint(edges, lexicon.select("word"))
    assert {(r["kind"], r["word"]) for r in known.collect()} == {("opinion", "aman"), ("opinion", "murah"), ("target", "vaksin")}
    texts = spark.createDataFrame([(1, "Vaksin aman murah")], "doc int, text string")
    r = propagation.double_propagation(tokens, texts, aspects, lexicon).first()
    assert (r["aspect_term"], r["matched_opinions"], r["total_weight"], r["opinion_count"], r["context_phrase"]) == ("vaksin", "aman", 3.0, 1, "vaksin aman")
    assert r["sentiment_prob"] == [0.9677, 0.0161, 0.0161]
    negated = tokens.withColumn("text", F.when(F.col("tok") == 2, "tidak").otherwise(F.col("text")))
    r = propagation.double_propagation(negated, texts, aspects, lexicon).first()
    assert r["total_weight"] == -3.0


def test_tfidf_default_and_cosine(spark):
    aspects = spark.createDataFrame([(1, "vaksin keamanan", "efek vaksin"), (2, "biaya", "harga vaksin")], "aspect_ord int, aspect_category string, description string")
    got = {r["context"]: (r["aspect_category"], r["similarity"]) for r in propagation.nearest_aspect(spark.createDataFrame([("harga vaksin mahal",), ("tak dikenal",)], "context string"), aspects).collect()}
    assert got == {"harga vaksin mahal": ("biaya", 0.7752), "tak dikenal": ("vaksin keamanan", 0.0)}
    vectors = spark.createDataFrame([("harga", [1.0, 0.0]), ("biaya", [1.0, 0.1]), ("vaksin", [0.0, 1.0]), ("efek", [0.0, 1.0])], "word string, vec array<double>")
    near = propagation.nearest_aspect_by_vectors(spark.createDataFrame([("harga mahal",), ("kosong",)], "context string"), aspects, vectors)
    assert {r["context"]: r["aspect_category"] for r in near.collect()} == {"harga mahal": "biaya", "kosong": "vaksin keamanan"}


@pytest.mark.parametrize("w,want", [(3, (0.9677, 0.0161, 0.0161)), (1, (0.7692, 0.1923, 0.0385)), (0.3, (0.3871, 0.5484, 0.0645)), (-1, (0.0385, 0.1923, 0.7692)), (-4, (0.0122, 0.0122, 0.9756)), (0, (0, 1, 0))])
def test_sentiment(spark, w, want):
    got = spark.createDataFrame([(float(w),)], "w double").select(propagation.probabilities(F.col("w")).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=5e-5)


def test_fuzzy(spark):
    pairs = [("ekonomi", "ekonomy", 0.857143), ("kesehatan", "pendidikan", 0.315789), ("tide", "diet", 0.25), ("diet", "tide", 0.5)]
    df = spark.createDataFrame(pairs, "a string, b string, r double").select(responses.fuzzy_ratio("a", "b").alias("x"), "r")
    assert all(abs(r["x"] - r["r"]) < 1e-6 for r in df.collect())


def answering():
    def answer(system: str, user: str) -> str:
        if "kedua" in user:
            return "Text pertama sekali\nCategory ekonomy\nsome prob: [0.8, 0.1, 0.1]\n\nText tak ada di sini sama sekali\nAspect vaksin\nprob: [0,0,0]"
        return 'Tweet: "vaksin itu aman"\nAspect: vaksin\nSentiment: [0.7, 0.2, 0.1]\n\nTweet: lain sekali ini\nAspect: tak ada\nSentiment: [1,0,0]\n\nTweet: zzz\nAspect: ekonomi\nSentiment: [0.5,0.5,0.0]'

    return answer


def test_provider_and_parsing(spark):
    answer = answering()
    tweets = spark.createDataFrame([("1", "vaksin itu aman", 1), ("2", "pertama sekali", 2), ("3", "kedua", 3)], "id string, text string, ord int")
    aspects = spark.createDataFrame([(1, "vaksin", "a"), (2, "ekonomi", "b")], "aspect_ord int, aspect_category string, description string")
    got = {(r["id"], r["aspect_category"]) for r in responses.predict(tweets.limit(1), aspects, answer, 2).collect()}
    assert got == {("1", "vaksin"), ("NA", "ekonomi")}
    batched = responses.batches(tweets, 10)
    flexible = responses.parse_answers(spark.createDataFrame([(0, answer("", "kedua"))], "batch long, answer string"), batched, aspects)
    assert [(r["id"], r["aspect_category"]) for r in flexible.collect()] == [("2", "ekonomi")]

    def failing(system, user):
        raise OSError("no network")

    out = responses.ask(responses.user_prompts(batched), "s", failing, 2, 0.0).first()
    assert (out["answer"], out["attempts"], out["error"]) == (None, 2, "no network")
    assert responses.success_rate(3, spark.createDataFrame([(None,)], "answer string"), 3).first()["success_rate"] == 0
    body = spark.range(1).select(responses.answer_text(F.lit('{"candidates":[{"content":{"parts":[{"text":"ok"}]}}]}')).alias("t"), responses.request_body(F.lit("s"), F.lit("u")).alias("q")).first()
    assert body["t"] == "ok" and '"topK":40' in body["q"]


def test_metrics_by_hand(spark):
    gold = metrics.labelled(spark.createDataFrame([("1", "a", "[0,0,1]", 1), ("2", "b", None, 2)], "id string, asp string, vec string, o int"), "asp", "vec", "o")
    pred = metrics.labelled(spark.createDataFrame([("1", "a", "[0.5,0.3,0.2]", 1), ("3", "c", "[1,0,0]", 2)], "id string, asp string, vec string, o int"), "asp", "vec", "o")
    assert metrics.brier_overall(metrics.brier(gold, pred)).first()[0] == pytest.approx(1.646667, abs=1e-6)
    assert {tuple(r) for r in metrics.mismatches(gold, pred).collect()} == {("3", "none", "c")}
    assert metrics.exact_match(gold, pred).first()["exact_match_ratio"] == pytest.approx(1 / 3)
    assert {r["aspect"] for r in metrics.aspect_counts(gold, pred).collect()} == {"a", "b", "c"}
    assert any(x.startswith("Penalised Brier 1.6467") for x in metrics.report_lines(gold, pred))
    with pytest.raises(Exception, match="3 entries"):
        metrics.last_vectors(metrics.labelled(spark.createDataFrame([("1", "a", "[1,0]", 1)], "id string, asp string, vec string, o int"), "asp", "vec", "o")).collect()


def test_pipeline_and_files(spark, tmp_path):
    rows = [(f"t{i}", f"teks {i}", "", f"u{i % 2}" if i else "", f"u{i % 4}", i) for i in range(24)]
    corpus = spark.createDataFrame(rows, "id string, text string, in_reply_to_status_id string, in_reply_to_screen_name string, name string, ord int")
    preds = spark.createDataFrame([(f"t{i}", "vaksin", "[0.7, 0.2, 0.1]") for i in range(24)], "id string, aspect_category string, sentiment_prob string")
    aspects = spark.createDataFrame([(1, "vaksin", "a")], "aspect_ord int, aspect_category string, description string")
    for whole in (False, True):
        r = pipeline.run(corpus, aspects, "ord", preds, min_members=1, aggregate_users=whole)
        assert r.summary.count() == 1 and set(r.seconds) >= {"aspects", "graph", "consensus"}
    given = pipeline.run(corpus.withColumn("community", F.col("ord") % 2), aspects, "ord", preds, min_members=1)
    assert {r["community"] for r in given.nodes.select("community").distinct().collect()} == {0, 1}
    for form in ("gml", "graphml"):
        files.write_graph(r.nodes, r.edges, str(tmp_path / form), form)
    v, e = files.read_gml(spark, str(tmp_path / "gml"))
    assert {x[0] for x in v.collect()} == {x["id"] for x in r.nodes.select("id").collect()}
    assert {tuple(x) for x in e.collect()} == {tuple(x) for x in r.edges.select("u", "v").collect()}
    files.write_csv(r.nodes.select("id", "text"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == r.nodes.count()
    (tmp_path / "slang.txt").write_text("gak:tidak\nbad line\n a : b:c \n")
    assert {(x["slang"], x["formal"]) for x in files.read_slang_lines(spark, str(tmp_path / "slang.txt")).collect()} == {("gak", "tidak"), ("a", "b:c")}
    (tmp_path / "edges.txt").write_text("1,2\n2 1\n3\n2\t3\n4,4\n")
    assert {tuple(x) for x in files.read_edges(spark, str(tmp_path / "edges.txt")).collect()} == {("1", "2"), ("2", "3")}
    with pytest.raises(ValueError, match="overwrite"):
        files.output_path("/x/a.csv", "/x/a.csv")


@pytest.mark.parametrize(
    "answer,want",
    [
        ("", []),
        ('Tweet: "harga naik"\nAspect: ekonomi\nSentiment: [0.1, 0.2, 0.7]', [("harga naik", "ekonomi", "0.1, 0.2, 0.7")]),
        ("1. TEXT:\n harga\n\nCategory:\r\n 'vaksin' \n\n prob: [1,0,\n0] dan\ntext: b\naspect: c\nprob: [0,1,0]", [("harga", "vaksin", "1,0,\n0"), ("b", "c", "0,1,0")]),
        ("Tweet: a\nb\nAspect: c\nSentiment: []\nSentiment: [1,0,0]", [("a\nb", "c\nSentiment: []", "1,0,0")]),
        ("Tweet: a Aspect: b\nSentiment: [1,0,0]", []),
        ("Tweet: a\nAspect: b", []),
        ("Tweet:\nAspect: b\nProb: [1,0,0]", [("", "b", "1,0,0")]),
    ],
)
def test_structured_answers(answer, want):
    assert responses.scan_structured(answer) == want


@pytest.mark.parametrize(
    "answer,want",
    [
        ("", []),
        ("Text harga naik sekali\nCategory ekonomi\nthe prob: [1,0,0]", [("harga naik sekali", "ekonomi", "1,0,0")]),
        ("Text: 'a b c d e f'\nAspect: x\nSentiment [0,1,0]\n \nText: kurang satu bagian\nAspect: y", [("a b c d e f", "x", "0,1,0")]),
        ("Text: a\nAspect: b\n[1]", []),
        ("konteks text lain aspect vaksin sentiment baik prob: [0, 0, 1]", [("lain", "vaksin", "0, 0, 1")]),
        ("Tweet: pendek", []),
    ],
)
def test_flexible_answers(answer, want):
    assert responses.scan_flexible(answer) == want


def test_answers_of_both_forms(spark):
    rows = [(1, "Tweet: a\nAspect: b\nProb: [1,0,0]"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "batch int, answer string").select("batch", responses.structured_blocks(F.col("answer")).alias("s"), responses.flexible_blocks(F.col("answer")).alias("f"))
    got = {r["batch"]: ([tuple(x) for x in r["s"]], [tuple(x) for x in r["f"]]) for r in df.collect()}
    assert got == {1: ([("a", "b", "1,0,0")], [("a", "b", "1,0,0")]), 2: ([], []), 3: ([], [])}


def test_wide_table_tells_names_apart(spark):
    rows = [("1", "air", "x", 1), ("1", "Air", "y", 2), ("2", "air", "z", 3), ("1", "air", "w", 4), ("3", "ID", "v", 5)]
    predictions = spark.createDataFrame(rows, "id string, aspect_category string, sentiment_prob string, ord int")
    meta = spark.createDataFrame([("1", 7), ("3", None), ("9", 1)], "id string, community int")
    wide = tables.pivot_aspects(predictions, meta)
    assert wide.columns == ["id", "Air", "ID_2", "air_2", "community"]
    assert sorted(map(tuple, wide.collect())) == [("1", "y", "", "w", "7"), ("3", "", "v", "", ""), ("9", "", "", "", "1")]
    assert sorted(map(tuple, tables.unpivot_aspects(wide, ["Air", "ID", "air"]).collect())) == [("1", "7", "Air", "y"), ("1", "7", "air", "w"), ("3", "", "ID", "v")]
    assert tables.pivot_aspects(predictions.limit(0), meta).columns == ["id", "community"]


def test_predictions_have_a_small_plan(spark):
    from gemaruang.plans import queries

    df = queries.QUERIES["dp_predictions"](spark, "/root/testdata/sf0.001")
    # rows, texts and numbers of contexts are each found once; the driver held the joins of all their copies before
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 10
