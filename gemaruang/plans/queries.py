"""Registered queries for the analytics operators and their SQL; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemaruang.functions import text as T
from gemaruang.functions import vectors as V
from gemaruang.operators import communities, consensus, graph, metrics, nulls, propagation, responses, tables
from gemaruang.session import cut
from gemaruang.sources import parsed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STOPWORDS = ("yang", "di", "dan", "untuk", "dari", "ini", "itu")
PHRASES = ("jadwal imunisasi", "bantuan pangan", "air bersih", "kartu peserta", "laporan keuangan panitia")
NULL_RUNS = 100


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- consensus on events
# users are user_id, aspects event_type, vectors the numbers of high, middle and low values


def _event_vectors(spark: SparkSession, d: str, least: float | None = None, bands: tuple[float, float] = (60, 20)) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), (F.col("user_id") % 3).cast("int").alias("community"), F.col("event_type").alias("aspect"), "value")
    users = e.select("id", "community").distinct()
    if least is not None:
        e = e.filter(F.col("value") >= least)
    hi, lo = bands
    n = lambda c: F.count_if(c).cast("double")
    vec = F.array(n(F.col("value") >= hi), n((F.col("value") < hi) & (F.col("value") >= lo)), n(F.col("value") < lo))
    return users, e.groupBy("id", "community", "aspect").agg(vec.alias("vec"))


def _events_sql(least: str = "", hi: int = 60, lo: int = 20) -> str:
    return f"""
users AS (SELECT DISTINCT user_id::VARCHAR AS id, (user_id % 3)::INT AS community FROM events),
cells AS (SELECT user_id::VARCHAR AS id, event_type AS aspect, count_if(value >= {hi})::DOUBLE AS x, count_if(value < {hi} AND value >= {lo})::DOUBLE AS y, count_if(value < {lo})::DOUBLE AS z FROM events {least} GROUP BY ALL),
dense AS (SELECT u.id, u.community, a.aspect, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM users u CROSS JOIN (SELECT DISTINCT event_type AS aspect FROM events) a LEFT JOIN cells c ON c.id = u.id AND c.aspect = a.aspect),
big AS (SELECT community FROM users GROUP BY 1 HAVING count(DISTINCT id) >= 5),
full_v AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM dense SEMI JOIN big USING (community)),
sims AS (SELECT l.community AS a, r.community AS b, l.aspect, CASE WHEN l.n > 0 AND r.n > 0 THEN (l.x*r.x + l.y*r.y + l.z*r.z) / (l.n * r.n) ELSE 0 END AS s, l.n > 1e-8 OR r.n > 1e-8 AS valid
  FROM full_v l JOIN full_v r ON l.aspect = r.aspect AND (l.community < r.community OR l.community = r.community AND l.id < r.id))"""


def _cc_sql(power: int) -> str:
    return f"""
ac AS (SELECT a, b, aspect, coalesce(pow(avg(pow(s, {power})) FILTER (WHERE valid), 1.0 / {power}), 0) AS ac, count_if(valid) > 0 AS active FROM sims GROUP BY ALL),
cc AS (SELECT a, b, CASE WHEN count_if(active) > 0 THEN pow(sum(CASE WHEN ac > 0 THEN pow(ac, {power}) ELSE 0 END) / count_if(active), 1.0 / {power}) ELSE 0 END AS cc FROM ac GROUP BY ALL),
means AS (SELECT coalesce(avg(cc) FILTER (WHERE a = b), 0) AS w, coalesce(avg(cc) FILTER (WHERE a < b), 0) AS b FROM cc)"""


_RATIO = "SELECT round(w, 6) AS within_mean, round(b, 6) AS between_mean, round(CASE WHEN b > 0 THEN w / b ELSE 'inf'::DOUBLE END, 6) AS ecr FROM means"
_SPARSE = ("WHERE value >= 100", 160, 120)


@query(f"WITH {_events_sql()}, {_cc_sql(1)} {_RATIO}")
def ecr_summary(spark, d):
    return _round(consensus.ratio(*_event_vectors(spark, d)), "within_mean", "between_mean", "ecr")


@query(f"WITH {_events_sql(*_SPARSE)}, {_cc_sql(1)} {_RATIO}")
def ecr_sparse(spark, d):
    return _round(consensus.ratio(*_event_vectors(spark, d, 100, (160, 120))), "within_mean", "between_mean", "ecr")


@query(f"WITH {_events_sql(*_SPARSE)}, {_cc_sql(2)} {_RATIO}")
def ecr_p2(spark, d):
    return _round(consensus.ratio(*_event_vectors(spark, d, 100, (160, 120)), power=2), "within_mean", "between_mean", "ecr")


@query(f"WITH {_events_sql(*_SPARSE)}, {_cc_sql(1)} SELECT a AS community, (SELECT count(DISTINCT id) FROM users u WHERE u.community = a) AS size, round(cc, 6) AS cc FROM cc WHERE a = b")
def within_cc(spark, d):
    return _round(consensus.within(*_event_vectors(spark, d, 100, (160, 120))), "cc")


@query(f"WITH {_events_sql(*_SPARSE)}, {_cc_sql(1)} SELECT a AS community, aspect, round(ac, 6) AS ac FROM ac WHERE a = b AND active")
def within_ac(spark, d):
    return _round(consensus.within_aspects(*_event_vectors(spark, d, 100, (160, 120))).filter("active").drop("active"), "ac")


@query(f"WITH {_events_sql(*_SPARSE)}, {_cc_sql(1)} SELECT a, b, round(cc, 6) AS cc FROM cc WHERE a < b")
def between_cc(spark, d):
    return _round(consensus.between(*_event_vectors(spark, d, 100, (160, 120))), "cc")


@query(f"WITH {_events_sql(*_SPARSE)}, {_cc_sql(1)} SELECT unnest(['=== GLOBAL WITHIN-COMMUNITY CONSENSUS ===', format('Mean = {{:.4f}}', w), '', '=== GLOBAL BETWEEN-COMMUNITY CONSENSUS ===', format('Mean = {{:.4f}}', b), '', '=== ECHO CHAMBER RATIOS (ECR) ===', format('ECR (Mean) = {{:.4f}}', w / b)]) AS value, unnest(range(8))::INT AS ord FROM means")
def ecr_report(spark, d):
    return consensus.summary_lines(consensus.ratio(*_event_vectors(spark, d, 100, (160, 120))))


@query(
    f"""WITH {_events_sql(*_SPARSE)}, {_cc_sql(1)}, sz AS (SELECT community, count(DISTINCT id) AS k FROM users GROUP BY 1)
SELECT 1::INT AS section, a::VARCHAR AS a, '' AS b, format('Community {{}} (size={{}}): CC(within)={{:.4f}}', a, k, cc) AS value FROM cc JOIN sz ON community = a WHERE a = b
UNION ALL SELECT 1, a::VARCHAR, aspect, format('   Aspect {{}}: {{:.4f}}', aspect, ac) FROM ac WHERE a = b AND active
UNION ALL SELECT 2, a::VARCHAR, b::VARCHAR, format('Between {{}} & {{}}: CC={{:.4f}}', a, b, cc) FROM cc WHERE a < b"""
)
def ecr_details(spark, d):
    v = _event_vectors(spark, d, 100, (160, 120))
    return consensus.detail_lines(consensus.within(*v), consensus.within_aspects(*v).filter("active"), consensus.between(*v))


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
u AS (SELECT vec_id, label, unnest(range(1, len(e) + 1)) AS i, unnest(e) / n AS x FROM v WHERE n > 0),
s AS (SELECT label, i, sum(x) AS s FROM u GROUP BY ALL), c AS (SELECT label, count(*) AS k FROM v GROUP BY 1 HAVING count(*) >= 5)
SELECT c.label::INT AS community, k AS size, round(greatest((sum(s * s) - k) / 2 / (k * (k - 1) / 2), 0), 6) AS cc FROM s JOIN c USING (label) GROUP BY c.label, k"""
)
def embedding_community_consensus(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("int").alias("community"), F.lit("e").alias("aspect"), F.col("embedding").cast("array<double>").alias("vec"))
    return _round(consensus.within(v.select("id", "community"), v), "cc")


# ---------------------------------------------------------------- corpus verbs

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = lambda c: f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, '[{_WS}]+', ' ', 'g'))"
_WORDS = lambda c: f"list_filter(string_split({_SQUEEZE(c)}, ' '), lambda t: t <> '')"
_W = r"[\p{L}\p{N}_]"


def _clean_sql(c: str) -> str:
    x = f"lower({c})"
    x = rf"regexp_replace({x}, '^[{_WS}]*rt([:\-]+[{_WS}]*|[{_WS}]+|([^\p{{L}}\p{{N}}_:\-{_WS}])|$)', '\2')"
    for p in (f"http[^{_WS}]+", f"@{_W}+", f"#{_W}+"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return f"coalesce({_SQUEEZE(f"regexp_replace({x}, '[^a-z0-9{_WS}]', '', 'g')")}, '')"


@query(f"SELECT row_id, {_clean_sql('text')} AS cleaned FROM community_input")
def clean_text(spark, d):
    return _t(spark, d, "community_input").select("row_id", T.clean_line("text").alias("cleaned"))


@query(f"SELECT row_id, id, text AS source, {_clean_sql('text')} AS text FROM community_input WHERE text IS NOT NULL")
def clean_corpus(spark, d):
    c = _t(spark, d, "community_input").select("row_id", "id", F.col("text").alias("source"))
    return tables.clean_column(c, "source")


@query(f"SELECT doc_id, {_SQUEEZE("replace(text, ',', ' ')")} AS text FROM documents WHERE text IS NOT NULL")
def min_clean_text(spark, d):
    return tables.min_clean(_t(spark, d, "documents").select("doc_id", "text"))


@query(
    f"""WITH m AS (SELECT map(list(slang), list(formal)) AS m FROM (SELECT slang, max(formal) AS formal FROM slang GROUP BY 1)),
w AS (SELECT row_id, {_WORDS('text')} AS w FROM community_input)
SELECT row_id, coalesce(array_to_string(list_filter(list_transform(w, lambda t: coalesce(m[t], t)), lambda t: NOT list_contains({list(STOPWORDS)}, lower(t))), ' '), '') AS text FROM w CROSS JOIN m"""
)
def normalize_text(spark, d):
    slang = tables.last_of(_t(spark, d, "slang"), "slang", "formal", "formal")
    stops = spark.createDataFrame([(w,) for w in STOPWORDS], "word string")
    return tables.normalize(_t(spark, d, "community_input").select("row_id", "text"), "text", slang, stops)


@query(
    f"""WITH w AS (SELECT row_id, {_WORDS('text')} AS w FROM community_input WHERE text IS NOT NULL),
t AS (SELECT row_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT *, i - row_number() OVER (PARTITION BY row_id, t = 'tidak' ORDER BY i) AS run FROM t),
r AS (SELECT *, CASE WHEN t = 'tidak' THEN row_number() OVER (PARTITION BY row_id, t = 'tidak', run ORDER BY i) ELSE 0 END AS k FROM g),
p AS (SELECT *, lag(k, 1, 0) OVER (PARTITION BY row_id ORDER BY i) AS before FROM r),
s AS (SELECT row_id, i, t, (before % 2) = 1 AS glued FROM p)
SELECT w.row_id, coalesce((SELECT string_agg(CASE WHEN i = 1 THEN t WHEN glued THEN '_' || t ELSE ' ' || t END, '' ORDER BY i) FROM s WHERE s.row_id = w.row_id), '') AS merged FROM w"""
)
def negator_merge(spark, d):
    return _t(spark, d, "community_input").filter("text is not null").select("row_id", T.merge_negators("text").alias("merged"))


def _phrase_sql(c: str) -> str:
    # RE2 has no look-around: neighbours are captured and written again, twice for phrases that share a neighbour
    for p in sorted(PHRASES, key=lambda p: (-len(p), p)):
        for _ in range(2):
            c = f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])', '\\1{p.replace(' ', '_')}\\2', 'g')"
    return c


@query(f"SELECT row_id, {_phrase_sql('text')} AS merged FROM community_input")
def phrase_merge(spark, d):
    return _t(spark, d, "community_input").select("row_id", T.merge_phrases("text", list(PHRASES)).alias("merged"))


@query(
    f"""SELECT row_id, array_to_string(list_filter({_WORDS('text')}, lambda t: NOT list_contains({list(STOPWORDS)}, lower(t))), ' ') AS kept FROM community_input WHERE text IS NOT NULL"""
)
def stopword_removal(spark, d):
    stops = F.array(*[F.lit(w) for w in STOPWORDS])
    return _t(spark, d, "community_input").filter("text is not null").select("row_id", T.drop_stopwords("text", stops).alias("kept"))


@query("SELECT row_id, CASE WHEN text IS NOT NULL THEN (dense_rank() OVER (ORDER BY text NULLS LAST))::BIGINT END AS text_id FROM community_input")
def text_ids(spark, d):
    return tables.text_ids(_t(spark, d, "community_input").select("row_id", "text"), name="text_id").select("row_id", F.col("text_id").cast("long").alias("text_id"))


@query(f"SELECT DISTINCT coalesce({_STRIP('aspect_category_final')}, '') AS aspect_category FROM labelled_corpus")
def unique_aspects(spark, d):
    return tables.unique_aspects(_t(spark, d, "labelled_corpus"))


@query("SELECT DISTINCT id, text, community FROM community_input")
def extract_corpus(spark, d):
    return tables.extract_corpus(_t(spark, d, "community_input"))


@query("SELECT id, text FROM community_input")
def absa_input(spark, d):
    return tables.absa_input(_t(spark, d, "community_input"))


@query("SELECT doc_id, lang, topic FROM documents")
def drop_columns(spark, d):
    return tables.drop_columns(_t(spark, d, "documents"), ["text", "source", "n_chars", "name", "created_at", "not there"])


@query("SELECT topic, doc_id FROM documents")
def keep_columns(spark, d):
    return tables.drop_columns(_t(spark, d, "documents"), ["topic", "not there", "doc_id"], invert=True)


@query("SELECT doc_id, n_chars FROM documents WHERE NOT coalesce(n_chars > 500, false)")
def drop_rows(spark, d):
    return tables.drop_rows(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars > 500")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 500")
def drop_rows_invert(spark, d):
    return tables.drop_rows(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars > 500", invert=True)


@query("SELECT doc_id, replace(text, 'petugas loket', 'petugas_loket') AS text FROM documents")
def replace_phrase(spark, d):
    return tables.replace_phrase(_t(spark, d, "documents").select("doc_id", "text"), "petugas loket", "petugas_loket")


@query(f"SELECT {_STRIP('text')} AS value FROM community_input WHERE {_STRIP('text')} <> ''")
def csv_to_txt(spark, d):
    return tables.text_lines(_t(spark, d, "community_input"))


@query(f"SELECT DISTINCT {_STRIP('formal')} AS word FROM slang WHERE {_STRIP('formal')} <> '' AND {_STRIP('formal')} NOT IN {tuple(sorted(tables.SAFE_KEEP))}")
def filter_stopwords(spark, d):
    return tables.filter_stopwords(_t(spark, d, "slang").select(F.col("formal").alias("word")))


@query("SELECT c.id, c.text AS text_x, p.text AS text_y, p.aspect_category FROM community_input c JOIN absa_predictions p ON c.id IS NOT DISTINCT FROM regexp_replace(" + _STRIP("p.id") + ", '^''+', '')")
def merge_text_aspects(spark, d):
    c, p = _t(spark, d, "community_input").select("id", "text"), _t(spark, d, "absa_predictions").select("id", "text", "aspect_category")
    return tables.merge_on_id(c, p)


_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LIST = rf"^\s*\[\s*{_NUM}\s*(,\s*{_NUM}\s*)*,?\s*\]\s*$"


def _list_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_LIST}') THEN list_transform(list_filter(string_split(regexp_replace({c}, '[\\[\\]\\s]', '', 'g'), ','), lambda t: t <> ''), lambda t: t::DOUBLE) END"


_LAST = "SELECT id, aspect_category AS aspect, arg_max(sentiment_prob, pred_id) AS p FROM absa_predictions WHERE sentiment_prob IS NOT NULL GROUP BY ALL"


@query(rf"WITH l AS ({_LAST}), m AS (SELECT DISTINCT id, community FROM community_input WHERE id IS NOT NULL), v AS (SELECT m.id, m.community, l.aspect, {_list_sql('p')} AS v FROM m JOIN l USING (id) WHERE NOT regexp_matches(p, '^\s*({_NUM}|\[\s*\])\s*$')) SELECT id, community, aspect, round(coalesce(v[1], 0), 6) AS pos, round(coalesce(v[2], 0), 6) AS neu, round(coalesce(v[3], 0), 6) AS neg FROM v WHERE v IS NULL OR len(v) = 3")
def absa_by_community(spark, d):
    p = _t(spark, d, "absa_predictions").filter("sentiment_prob is not null").withColumnRenamed("pred_id", "ord")
    m = _t(spark, d, "community_input").filter("id is not null").select("id", "community").distinct()
    out = tables.long_aspects(p, m).filter(F.size("vec") == 3)
    return out.select("id", "community", "aspect", *[F.round(F.col("vec")[i], 6).alias(n) for i, n in enumerate(("pos", "neu", "neg"))])


@query(
    """WITH l AS (SELECT id, aspect_category AS aspect, arg_max(sentiment_prob, pred_id) AS p FROM absa_predictions WHERE sentiment_prob IS NOT NULL AND aspect_category IS NOT NULL GROUP BY ALL)
SELECT c.id, coalesce(c.community::VARCHAR, '') AS community, aspect, p AS sentiment_prob FROM community_input c JOIN l USING (id) WHERE p <> ''"""
)
def absa_pivot(spark, d):
    """The wide table of all predictions as they are typed, and back: its columns follow the data, so its cells are compared."""
    p = _t(spark, d, "absa_predictions").filter("sentiment_prob is not null and aspect_category is not null").withColumnRenamed("pred_id", "ord")
    names = [r[0] for r in p.select("aspect_category").distinct().orderBy("aspect_category").collect()]
    return tables.unpivot_aspects(tables.pivot_aspects(p, _t(spark, d, "community_input")), names)


@query(
    rf"""WITH p AS (SELECT pred_id, list_transform(string_split(regexp_replace(sentiment_prob, '[\[\]a-zA-Z=]', '', 'g'), ','), lambda x: round(try_cast(trim(x) AS DOUBLE), 4)) AS v FROM absa_predictions),
s AS (SELECT pred_id, v, len(v) = 3 AND len(list_filter(v, lambda x: x IS NULL)) = 0 AS ok, v[1] + v[2] + v[3] AS t FROM p),
r AS (SELECT pred_id, CASE WHEN coalesce(ok, false) THEN CASE WHEN abs(t - 1) <= 0.1 THEN v WHEN t > 0 THEN list_transform(v, lambda x: x / t) ELSE [0.0, 0.0, 0.0] END ELSE [0.0, 0.0, 0.0] END AS v FROM s)
SELECT pred_id, round(v[1], 6) AS pos, round(v[2], 6) AS neu, round(v[3], 6) AS neg FROM r"""
)
def parse_probs(spark, d):
    v = V.clean_probabilities("sentiment_prob")
    return _t(spark, d, "absa_predictions").select("pred_id", v.alias("v")).select("pred_id", *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate(("pos", "neu", "neg"))])


# ---------------------------------------------------------------- interaction graph

_TWEETS = f"""
t AS (SELECT id, row_id AS ord, coalesce(text, '') AS text, coalesce({_STRIP('in_reply_to_status_id')}, '') AS reply_id, coalesce({_STRIP('lower(in_reply_to_screen_name)')}, '') AS reply_name, coalesce({_STRIP('lower(name)')}, '') AS name, community FROM community_input WHERE id IS NOT NULL)"""
_RULES = {
    1: "SELECT DISTINCT a.id AS u, b.id AS v FROM t a JOIN t b ON a.reply_id = b.reply_id AND a.reply_id <> '' AND a.id < b.id",
    2: "SELECT DISTINCT a.id AS u, b.id AS v FROM t a JOIN t b ON a.reply_name = b.reply_name AND a.reply_name <> '' AND a.id < b.id",
    3: "SELECT DISTINCT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v FROM t a JOIN t b ON a.reply_name = b.name AND a.reply_name <> '' AND a.id <> b.id",
    4: "SELECT DISTINCT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v FROM t a JOIN t b ON a.reply_id = b.id AND a.id <> b.id",
}
_EDGES = "e AS (" + " UNION ".join(_RULES.values()) + ")"


def _tweets(spark: SparkSession, d: str) -> DataFrame:
    return graph.tweets(_t(spark, d, "community_input"), "row_id")


def _rule(n: int):
    def run(spark, d):
        return graph.reply_edges(_tweets(spark, d), (n,))

    run.__name__ = f"reply_rule{n}"
    return query(f"WITH {_TWEETS} {_RULES[n]}")(run)


reply_rules = [_rule(n) for n in (1, 2, 3, 4)]


@query(f"WITH {_TWEETS}, {_EDGES} SELECT id, count(*) AS degree FROM (SELECT u AS id FROM e UNION ALL SELECT v FROM e) GROUP BY 1")
def graph_degrees(spark, d):
    return graph.ReplyGraph(_tweets(spark, d)).degrees()


_CC = f"""RECURSIVE {_TWEETS}, {_EDGES}, b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
cc(id, component) USING KEY (id) AS (SELECT DISTINCT id, id FROM t UNION (
  SELECT b.v, min(cc.component) FROM cc JOIN b ON b.u = cc.id JOIN recurring.cc r ON r.id = b.v WHERE cc.component < r.component GROUP BY b.v))"""


@query(f"WITH {_CC} SELECT id, component FROM cc")
def reply_components(spark, d):
    t = _tweets(spark, d)
    return graph.connected_components(t, graph.star_edges(t))


@query(f"WITH {_CC} SELECT (SELECT count(DISTINCT id) FROM t) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT component) FROM cc) AS components")
def graph_counts(spark, d):
    t = _tweets(spark, d)
    return graph.counts(t, graph.ReplyGraph(t), graph.connected_components(t, graph.star_edges(t)))


_PART = "part AS (SELECT id, coalesce(max(community), -1) AS c FROM t GROUP BY 1), w AS (SELECT t.*, part.c, CASE WHEN name <> '' THEN name ELSE t.id END AS who FROM t JOIN part USING (id))"
_NODES = "nodes AS (SELECT who, c, arg_min(id, (ord, id)) AS id, arg_min(reply_name, (ord, id)) AS reply_name, arg_min(reply_id, (ord, id)) AS reply_id, string_agg(text, ' ' ORDER BY ord, id) FILTER (WHERE text <> '') AS txt FROM w GROUP BY ALL)"


def _partition(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "community_input").filter("id is not null")
    return c.groupBy("id").agg(F.coalesce(F.max("community"), F.lit(-1)).alias("community"))


@query(f"WITH {_TWEETS}, {_PART}, {_NODES} SELECT id, who AS name, c AS community, reply_name, reply_id, coalesce({_STRIP('txt')}, '') AS text FROM nodes")
def user_contraction(spark, d):
    return graph.merge_by_user(_tweets(spark, d), _partition(spark, d))[0]


@query(
    f"WITH {_TWEETS}, {_EDGES}, {_PART}, {_NODES}, m AS (SELECT DISTINCT w.id, n.id AS x FROM w JOIN nodes n ON n.who = w.who AND n.c = w.c) SELECT DISTINCT least(a.x, b.x) AS u, greatest(a.x, b.x) AS v FROM e JOIN m a ON a.id = e.u JOIN m b ON b.id = e.v WHERE a.x <> b.x"
)
def contracted_edges(spark, d):
    t = _tweets(spark, d)
    return graph.merged_group_edges(t, graph.merge_by_user(t, _partition(spark, d))[1])


_MODULARITY = "j AS (SELECT a.c AS x, b.c AS y FROM e JOIN part a ON a.id = e.u JOIN part b ON b.id = e.v), m AS (SELECT count(*) AS m FROM e), dg AS (SELECT c, count(*) AS d FROM (SELECT x AS c FROM j UNION ALL SELECT y FROM j) GROUP BY 1), ins AS (SELECT x AS c, count(*) AS k FROM j WHERE x = y GROUP BY 1) SELECT round(sum(coalesce(k, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM dg LEFT JOIN ins USING (c) CROSS JOIN m"


@query(f"WITH {_TWEETS}, {_EDGES}, {_PART}, {_MODULARITY}")
def partition_modularity(spark, d):
    return _round(graph.ReplyGraph(_tweets(spark, d), _partition(spark, d)).modularity(), "modularity")


@query()
def louvain_communities(spark, d):
    t = _tweets(spark, d)
    return communities.louvain(t, graph.ReplyGraph(t))


@query()
def balanced_communities(spark, d):
    t = _tweets(spark, d)
    return communities.balanced_parts(t, graph.ReplyGraph(t), 4)


@query("SELECT id, ((row_number() OVER (ORDER BY id) - 1) % 3)::INT AS community FROM (SELECT DISTINCT id FROM community_input WHERE id IS NOT NULL)")
def metis_fallback(spark, d):
    return communities.fallback_parts(_tweets(spark, d), 3)


# ---------------------------------------------------------------- double propagation
# tokens come from a fixed rule on lengths and places, no linguistic analysis

_TOKENS = f"""
li AS (SELECT doc_id AS doc, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) - 1 AS sent FROM documents WHERE text IS NOT NULL),
wl AS (SELECT doc, sent, {_WORDS('line')} AS w FROM li),
tk AS (SELECT doc, doc::VARCHAR AS id, sent, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS tok FROM wl),
tokens AS (SELECT *, CASE length(w) % 4 WHEN 1 THEN 'ADJ' WHEN 2 THEN 'VERB' ELSE 'NOUN' END AS pos, CASE WHEN (tok + 1) % 3 = 0 THEN 'conj' ELSE 'dep' END AS deprel FROM tk)"""
_DEPS = """dep AS (SELECT c.doc, c.id, h.w AS hw, c.w AS cw, c.pos, c.deprel FROM tokens c JOIN tokens h ON h.doc = c.doc AND h.sent = c.sent AND h.tok = c.tok - 1),
rel AS (SELECT DISTINCT hw, cw, pos, deprel = 'conj' AS conj FROM dep WHERE pos IN ('NOUN', 'ADJ')),
rules AS (SELECT 'opinion' AS k, hw, 'target' AS nk, cw FROM rel WHERE pos = 'NOUN' UNION SELECT 'opinion', hw, 'opinion', cw FROM rel WHERE pos = 'ADJ' AND conj
  UNION SELECT 'target', hw, 'opinion', cw FROM rel WHERE pos = 'ADJ' UNION SELECT 'target', hw, 'target', cw FROM rel WHERE pos = 'NOUN' AND conj)"""
_KNOWN = "known AS (SELECT 'opinion' AS kind, word FROM lexicon WHERE word IS NOT NULL UNION SELECT r.nk, r.cw FROM known k JOIN rules r ON r.k = k.kind AND r.hw = k.word)"
_PAIRS = "pairs AS (SELECT DISTINCT id, cw AS target, hw AS opinion FROM dep WHERE pos = 'NOUN' AND hw IN (SELECT word FROM known WHERE kind = 'opinion'))"
_LEX = "lex AS (SELECT word, max(weight) AS weight FROM lexicon WHERE word IS NOT NULL GROUP BY 1)"
_NEG = f"ng AS (SELECT doc, sent, tok, w, max(w IN {T.NEGATORS}) OVER (PARTITION BY doc, sent ORDER BY tok ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS neg FROM tokens), neg AS (SELECT doc, w, max(neg) AS negated FROM (SELECT doc, sent, w, arg_min(neg, tok) AS neg FROM ng GROUP BY ALL) GROUP BY ALL)"
_CTX = "cx AS (SELECT doc, sent, tok, w, trim(concat_ws(' ', lag(w, 1, '') OVER s, w, lead(w, 1, '') OVER s)) AS c FROM tokens WINDOW s AS (PARTITION BY doc, sent ORDER BY tok)), ctx AS (SELECT doc, w, arg_min(c, (sent, tok)) AS context FROM cx GROUP BY ALL)"
_SCORED = """cand AS (SELECT d.doc, p.id, p.target, p.opinion, coalesce(l.weight, 0) AS wt, coalesce(n.negated, false) AS ng FROM (SELECT DISTINCT doc, id FROM tokens) d JOIN pairs p USING (id) LEFT JOIN lex l ON l.word = p.opinion LEFT JOIN neg n ON n.doc = d.doc AND n.w = p.opinion),
dw AS (SELECT doc, sum(weight) AS s FROM tokens JOIN lex ON lex.word = w GROUP BY 1),
scored AS (SELECT c.doc, c.id, target, array_to_string(list_sort(list_distinct(list(opinion))), ',') AS matched_opinions, CASE WHEN count_if(wt <> 0) > 0 THEN sum(CASE WHEN ng THEN -wt ELSE wt END) ELSE coalesce(any_value(dw.s), 0) * 0.3 END AS total_weight, count_if(wt <> 0) AS opinion_count FROM cand c LEFT JOIN dw ON dw.doc = c.doc GROUP BY ALL)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("id"), "text")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as arrays."""
    return parsed.rule_sentences(_docs(spark, d))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # read by the rules, the pairs and the scores: cut into words once
    tokens = cut(_tokens(spark, d))
    weights = propagation.lexicon_weights(_t(spark, d, "lexicon"))
    edges = propagation.dependency_edges(tokens)
    known = propagation.fixpoint(edges, weights.select("word"))
    return tokens, weights, known, propagation.pairs(edges, known)


def _aspects(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "aspects").select(F.col("aspect_no").alias("aspect_ord"), "aspect_category", "description")


@query(f"WITH {_TOKENS} SELECT doc, sent::INT AS sent, tok::INT AS tok, w AS text, pos, (tok)::INT AS head, deprel FROM tokens")
def conllu_parse(spark, d):
    t = parsed.rule_tokens(_docs(spark, d))
    line = F.concat_ws("\t", F.col("wid").cast("string"), "text", "lemma", "pos", F.lit("_"), F.lit("_"), F.col("head").cast("string"), "deprel", F.lit("_"), F.lit("_"))
    sents = t.groupBy("doc", "id", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", line.alias("l")))), lambda s: s["l"]), "\n").alias("s"))
    docs = sents.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("sent", "s"))).alias("a"))
    text = docs.select("doc", "id", F.concat(F.lit("# newdoc\n"), F.array_join(F.transform("a", lambda s: s["s"]), "\n\n")).alias("conllu"))
    # empty sentences do not survive CoNLL-U: their numbers are restored for the comparison
    back = parsed.conllu_tokens(text)
    order = t.select("doc", "sent").distinct()
    from pyspark.sql import Window

    named = order.select("doc", F.col("sent").alias("orig"), (F.dense_rank().over(Window.partitionBy("doc").orderBy("sent")) - 1).alias("sent"))
    return back.join(named, ["doc", "sent"]).select("doc", F.col("orig").cast("int").alias("sent"), "tok", "text", "pos", "head", "deprel")


@query(f"WITH RECURSIVE {_TOKENS}, {_DEPS}, {_KNOWN} SELECT kind, word FROM known")
def dp_fixpoint(spark, d):
    return _found(spark, d)[2].select("kind", "word")


@query(f"WITH RECURSIVE {_TOKENS}, {_DEPS}, {_KNOWN}, {_PAIRS} SELECT * FROM pairs")
def dp_pairs(spark, d):
    return _found(spark, d)[3]


@query(f"WITH {_TOKENS}, {_NEG} SELECT doc, w AS word, negated FROM neg")
def dp_negation(spark, d):
    return propagation.negated(_tokens(spark, d))


@query(f"WITH {_TOKENS}, {_CTX} SELECT doc, w AS word, context FROM ctx")
def dp_context(spark, d):
    return propagation.contexts(_tokens(spark, d))


@query(f"WITH RECURSIVE {_TOKENS}, {_DEPS}, {_KNOWN}, {_PAIRS}, {_LEX}, {_NEG}, {_SCORED} SELECT doc, target, matched_opinions, round(total_weight, 6) AS total_weight, opinion_count FROM scored")
def dp_weights(spark, d):
    tokens, weights, _, found = _found(spark, d)
    return _round(propagation.target_weights(tokens, found, weights).drop("id"), "total_weight")


@query(
    f"""WITH RECURSIVE {_TOKENS}, {_DEPS}, {_KNOWN}, {_PAIRS},
ph AS (SELECT doc, id, sent, tok, w, concat_ws(' ', CASE WHEN lag(pos, 2) OVER s = 'NOUN' THEN lag(w, 2) OVER s END, CASE WHEN lag(pos) OVER s = 'NOUN' THEN lag(w) OVER s END, CASE WHEN lag(pos) OVER s = 'ADJ' THEN lag(w) OVER s END, w, CASE WHEN lead(pos) OVER s = 'NOUN' THEN lead(w) OVER s END, CASE WHEN lead(pos, 2) OVER s = 'NOUN' THEN lead(w, 2) OVER s END) AS phrase FROM tokens WINDOW s AS (PARTITION BY doc, sent ORDER BY tok)),
hit AS (SELECT * FROM ph WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.id = ph.id AND p.target = ph.w)),
cnt AS (SELECT k FROM (SELECT target AS k FROM pairs UNION ALL SELECT phrase FROM hit) GROUP BY 1)
SELECT doc, sent::INT AS sent, tok::INT AS tok, phrase FROM hit WHERE string_split(phrase, ' ')[-1] IN (SELECT k FROM cnt)"""
)
def dp_phrases(spark, d):
    tokens, _, _, found = _found(spark, d)
    return propagation.expanded_phrases(tokens, found)


def _tfidf_sql(source: str) -> str:
    return rf"""
aterm AS (SELECT aspect_no AS o, aspect_category AS cat, unnest(regexp_extract_all(lower(concat_ws('. ', aspect_category, description)), '{_W}{{2,}}')) AS term FROM aspects),
tf AS (SELECT o, cat, term, count(*) AS tf FROM aterm GROUP BY ALL), df AS (SELECT term, count(DISTINCT o) AS df FROM aterm GROUP BY 1),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM aspects)) / (1 + df)) + 1 AS idf FROM df),
aw AS (SELECT o, cat, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY o)) AS w FROM tf JOIN idf USING (term)),
x AS ({source}), xt AS (SELECT text, unnest(regexp_extract_all(lower(text), '{_W}{{2,}}')) AS term FROM x),
xf AS (SELECT text, term, count(*) AS tf FROM xt GROUP BY ALL), xw AS (SELECT text, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY text)) AS w FROM xf JOIN idf USING (term)),
sc AS (SELECT text, o, cat, round(sum(xw.w * aw.w), 12) AS s FROM xw JOIN aw USING (term) GROUP BY ALL),
best AS (SELECT text, arg_max(cat, (s, -o)) AS cat, max(s) AS s FROM sc GROUP BY 1)"""


_TFIDF = _tfidf_sql("SELECT DISTINCT text FROM community_input WHERE text IS NOT NULL")


@query(f"WITH {_TFIDF} SELECT text, coalesce(cat, (SELECT arg_min(aspect_category, aspect_no) FROM aspects)) AS aspect_category, round(least(greatest(coalesce(s, 0), 0), 1), 4) AS similarity FROM x LEFT JOIN best USING (text)")
def dp_tfidf_aspect(spark, d):
    texts = _t(spark, d, "community_input").filter("text is not null").select("text")
    return propagation.nearest_aspect(texts, _aspects(spark, d), "text")


_SHARES = "abs(total_weight) * 2.0 AS big, greatest(0.1, 1 - abs(total_weight) * 0.5) AS mid"


def _share_sql(above: str, below: str, none: int) -> str:
    return f"round(CASE WHEN total_weight = 0 THEN {none} WHEN total_weight > 0 THEN {above} / (big + mid + 0.1) ELSE {below} / (big + mid + 0.1) END, 4)"


@query(
    f"""WITH RECURSIVE {_TOKENS}, {_DEPS}, {_KNOWN}, {_PAIRS}, {_LEX}, {_NEG}, {_SCORED}, {_CTX},
pr AS (SELECT s.* REPLACE (round(total_weight, 9) AS total_weight), coalesce(x.context, target) AS context FROM scored s LEFT JOIN ctx x ON x.doc = s.doc AND x.w = s.target),
{_tfidf_sql("SELECT DISTINCT context AS text FROM pr")}, sh AS (SELECT *, {_SHARES} FROM pr)
SELECT doc, id, documents.text AS original_text, target AS aspect_term, coalesce(cat, (SELECT arg_min(aspect_category, aspect_no) FROM aspects)) AS aspect_category, round(least(greatest(coalesce(best.s, 0), 0), 1), 4) AS similarity,
  matched_opinions, round(total_weight, 6) AS total_weight, {_share_sql('big', '0.1', 0)} AS pos, {_share_sql('mid', 'mid', 1)} AS neu, {_share_sql('0.1', 'big', 0)} AS neg, context AS context_phrase, opinion_count
FROM sh JOIN documents ON doc_id = doc LEFT JOIN best ON best.text = context"""
)
def dp_predictions(spark, d):
    texts = _t(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), "text")
    out = propagation.double_propagation(_tokens(spark, d), texts, _aspects(spark, d), _t(spark, d, "lexicon"))
    return _round(out, "total_weight").withColumns({n: F.col("sentiment_prob")[i] for i, n in enumerate(("pos", "neu", "neg"))}).drop("sentiment_prob")


@query(
    """WITH p AS (SELECT word, max(weight) AS w FROM lexicon WHERE word IS NOT NULL GROUP BY 1), r AS (SELECT word, w, abs(w) * 2.0 AS m, greatest(0.1, 1 - abs(w) * 0.5) AS n FROM p)
SELECT word, round(CASE WHEN w = 0 THEN 0 WHEN w > 0 THEN m / (m + n + 0.1) ELSE 0.1 / (m + n + 0.1) END, 6) AS pos, round(CASE WHEN w = 0 THEN 1 ELSE n / (m + n + 0.1) END, 6) AS neu, round(CASE WHEN w = 0 THEN 0 WHEN w > 0 THEN 0.1 / (m + n + 0.1) ELSE m / (m + n + 0.1) END, 6) AS neg FROM r"""
)
def dp_sentiment(spark, d):
    w = propagation.lexicon_weights(_t(spark, d, "lexicon"))
    return w.select("word", propagation.probabilities(F.col("weight")).alias("v")).select("word", *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate(("pos", "neu", "neg"))])


# ---------------------------------------------------------------- answers of a model


def _answers(spark: SparkSession, d: str, form: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers as a model would give them, made from the predictions: one for each batch of ten."""
    p = _t(spark, d, "absa_predictions").filter("text is not null and aspect_category is not null and sentiment_prob is not null")
    return *_batched_answers(p, d, form), _aspects(spark, d)


def _batched_answers(p: DataFrame, d: str, form: str) -> tuple[DataFrame, DataFrame]:
    p = p.select("pred_id", "id", "text", "aspect_category", "sentiment_prob").withColumn("ord", F.col("pred_id"))
    # a model repeats a text on one line
    batched = responses.batches(p.withColumn("text", F.regexp_replace("text", r"[\r\n]+", " ")), 10)
    probs = F.regexp_replace("sentiment_prob", r"[\[\]]", "")
    if form == "structured":
        block = F.format_string("Tweet: %s\nAspect: %s\nSentiment: [%s]", F.col("text"), F.col("aspect_category"), probs)
    else:
        block = F.format_string("Text %s\nCategory %s\nthe prob: [%s]", F.col("text"), F.col("aspect_category"), probs)
    answers = batched.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("answer"))
    return answers, batched


@query()
def llm_parse_structured(spark, d):
    return responses.parse_answers(*_answers(spark, d, "structured"))


@query()
def llm_parse_flexible(spark, d):
    return responses.parse_answers(*_answers(spark, d, "flexible"))


_KEY = lambda c: f"coalesce({_SQUEEZE(f"regexp_replace(regexp_replace({_STRIP(c)}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")}, '')"


@query(
    rf"""WITH p AS (SELECT *, (row_number() OVER (ORDER BY pred_id) - 1) // 10 AS batch, (pred_id % 36 + 1)::INT AS no FROM (SELECT pred_id, id, regexp_replace(text, '[
]+', ' ', 'g') AS text FROM absa_predictions WHERE {_KEY('text')} <> '')),
k AS (SELECT *, {_KEY('text')} AS k FROM p), f AS (SELECT batch, k, arg_min(id, pred_id) AS id FROM k GROUP BY ALL)
SELECT k.batch, f.id, aspect_category, k.k AS text, count(*) AS rows FROM k JOIN f USING (batch, k) JOIN aspects ON aspect_no = no GROUP BY ALL"""
)
def llm_parse_planted(spark, d):
    """Answers with known parts, in the asked-for form: each text that is not blank literally, aspects of the list, vectors that sum to one."""
    p = _t(spark, d, "absa_predictions").filter(T.match_key("text") != "")
    names = _aspects(spark, d).select((F.col("aspect_ord") - 1).alias("no"), F.col("aspect_category").alias("planted"))
    p = p.withColumn("no", (F.col("pred_id") % 36).cast("int")).join(F.broadcast(names), "no").select("pred_id", "id", "text", F.col("planted").alias("aspect_category"), F.lit("[0.5, 0.3, 0.2]").alias("sentiment_prob"))
    out = responses.parse_answers(*_batched_answers(p, d, "structured"), _aspects(spark, d))
    return out.groupBy("batch", "id", "aspect_category", T.match_key("text").alias("text")).agg(F.count(F.lit(1)).alias("rows"))


@query()
def fuzzy_match(spark, d):
    """Each typed aspect with its most similar entry of the list, distinct spellings once."""
    typed = _t(spark, d, "absa_predictions").select("aspect_category").filter("trim(aspect_category) <> ''").distinct()
    names = F.array(*[F.lit(r[0]) for r in _aspects(spark, d).orderBy("aspect_ord").select("aspect_category").collect()])
    at = responses.fuzzy_index(T.match_key("aspect_category"), names, F.lit(responses.ASPECT_THRESHOLD))
    return typed.withColumn("i", at).select("aspect_category", F.when(F.col("i") >= 0, F.get(names, F.col("i"))).alias("matched"))


@query(f"SELECT row_id, coalesce({_SQUEEZE(f"regexp_replace(regexp_replace({_STRIP('text')}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")}, '') AS k FROM community_input")
def match_keys(spark, d):
    return _t(spark, d, "community_input").select("row_id", T.match_key("text").alias("k"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""SELECT {_quoted(responses.PROMPT_HEAD)} || string_agg(format('- "{{}}": {{}}', aspect_category, description), chr(10) ORDER BY aspect_no) || {_quoted(responses.PROMPT_RULES)} AS prompt FROM aspects""")
def prompt_system(spark, d):
    return responses.system_prompt(_aspects(spark, d))


@query(f"""WITH p AS (SELECT row_id, text, (row_number() OVER (ORDER BY row_id) - 1) // 25 AS batch FROM community_input WHERE text IS NOT NULL) SELECT batch, {_quoted(responses.USER_HEAD)} || string_agg('"' || text || '"', chr(10) ORDER BY row_id) || {_quoted(responses.USER_END)} AS prompt FROM p GROUP BY 1""")
def prompt_users(spark, d):
    t = _t(spark, d, "community_input").filter("text is not null").select(F.col("row_id").alias("ord"), "text")
    return responses.user_prompts(responses.batches(t))


# ---------------------------------------------------------------- evaluation
# gold: labelled_corpus; predictions: those whose vectors have three entries


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.labelled(_t(spark, d, "labelled_corpus"), "aspect_category_final", "hard_label_final", "label_id")


def _pred(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "absa_predictions")
    return metrics.labelled(p.filter(F.coalesce(F.size(V.parse_list("sentiment_prob")) == 3, F.lit(False))), "aspect_category", "sentiment_prob", "pred_id")


@query(rf"WITH n AS (SELECT pred_id AS ord, id, aspect_category AS aspect, CASE WHEN regexp_matches(sentiment_prob, '^\s*\[\s*\]\s*$') THEN 0 ELSE len({_list_sql('sentiment_prob')}) END::INT AS entries FROM absa_predictions) SELECT * FROM n WHERE entries <> 3")
def eval_wrong_lengths(spark, d):
    """The predictions that the evaluation refuses: with them there is no result, so the other evaluation queries are without them."""
    return metrics.wrong_lengths(_t(spark, d, "absa_predictions"), "aspect_category", "sentiment_prob", "pred_id")


_EVAL = f"""
g0 AS (SELECT id, aspect_category_final AS aspect, {_list_sql('hard_label_final')} AS v, label_id AS o FROM labelled_corpus),
p0 AS (SELECT * FROM (SELECT id, aspect_category AS aspect, {_list_sql('sentiment_prob')} AS v, pred_id AS o FROM absa_predictions) WHERE len(v) = 3),
gl AS (SELECT id, aspect, arg_max(v, o) AS g FROM g0 WHERE aspect IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
pl AS (SELECT id, aspect, arg_max(v, o) AS p FROM p0 WHERE aspect IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
j AS (SELECT id, aspect, g, p FROM gl FULL JOIN pl USING (id, aspect)),
ids AS (SELECT id FROM g0 WHERE id IS NOT NULL UNION SELECT id FROM p0 WHERE id IS NOT NULL),
asp AS (SELECT aspect FROM g0 WHERE aspect IS NOT NULL UNION SELECT aspect FROM p0 WHERE aspect IS NOT NULL),
cnt AS (SELECT asp.aspect, count_if(g IS NOT NULL AND p IS NOT NULL) AS tp, count_if(p IS NOT NULL AND g IS NULL) AS fp, count_if(g IS NOT NULL AND p IS NULL) AS fn FROM asp LEFT JOIN j USING (aspect) GROUP BY ALL),
o AS (SELECT id, aspect, list_transform(g, lambda x: x / list_sum(g)) AS g, list_transform(p, lambda x: CASE WHEN list_sum(p) > 0 THEN x / list_sum(p) ELSE 1.0 / 3 END) AS p, list_position(g, list_max(g)) - 1 AS t, list_position(p, list_max(p)) - 1 AS q FROM j WHERE g IS NOT NULL AND p IS NOT NULL)"""
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"
_RC = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"


@query(f"WITH {_EVAL} SELECT aspect, round({_PR}, 6) AS precision, round({_RC}, 6) AS recall, round({_F1}, 6) AS f1, tp + fn AS support FROM cnt")
def eval_aspect_prf(spark, d):
    return _round(metrics.aspect_scores(_gold(spark, d), _pred(spark, d)), "precision", "recall", "f1")


@query(f"WITH {_EVAL} SELECT round(avg({_F1}), 6) AS f1_macro, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM cnt")
def eval_aspect_summary(spark, d):
    return _round(metrics.aspect_summary(_gold(spark, d), _pred(spark, d)), "f1_macro", "f1_micro")


@query(f"WITH {_EVAL} SELECT aspect, tp, fp, fn, (SELECT count(*) FROM ids) - tp - fp - fn AS tn FROM cnt")
def eval_multilabel_cm(spark, d):
    return metrics.aspect_counts(_gold(spark, d), _pred(spark, d))


_MM = """gm AS (SELECT id, aspect, row_number() OVER (PARTITION BY id ORDER BY aspect) AS k FROM j WHERE p IS NULL), pm AS (SELECT id, aspect, row_number() OVER (PARTITION BY id ORDER BY aspect) AS k FROM j WHERE g IS NULL),
mm AS (SELECT coalesce(gm.id, pm.id) AS id, coalesce(gm.aspect, 'none') AS gold, coalesce(pm.aspect, 'none') AS pred FROM gm FULL JOIN pm ON gm.id IS NOT DISTINCT FROM pm.id AND gm.k = pm.k)"""


@query(f"WITH {_EVAL}, {_MM} SELECT * FROM mm")
def eval_mismatches(spark, d):
    return metrics.mismatches(_gold(spark, d), _pred(spark, d))


@query(f"WITH {_EVAL}, {_MM} SELECT * FROM mm ORDER BY id NULLS FIRST, gold, pred LIMIT 50")
def eval_first_mismatches(spark, d):
    return metrics.first_mismatches(_gold(spark, d), _pred(spark, d))


@query(f"WITH {_EVAL}, {_MM} SELECT gold, pred, count(*) AS n FROM (SELECT gold, pred FROM mm UNION ALL SELECT aspect, aspect FROM j WHERE g IS NOT NULL AND p IS NOT NULL) GROUP BY ALL")
def eval_confusion(spark, d):
    return metrics.confusion(_gold(spark, d), _pred(spark, d))


@query(f"WITH {_EVAL} SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM j WHERE j.id = ids.id AND (g IS NULL OR p IS NULL OR list_position(g, list_max(g)) <> list_position(p, list_max(p)))) THEN 0.0 ELSE 1.0 END), 6) AS exact_match_ratio, count(*) AS ids FROM ids")
def eval_exact_match(spark, d):
    return _round(metrics.exact_match(_gold(spark, d), _pred(spark, d)), "exact_match_ratio")


_SR = "c AS (SELECT unnest([0, 1, 2])::INT AS cls), sr AS (SELECT cls, count_if(t = cls AND q = cls) AS tp, count_if(t <> cls AND q = cls) AS fp, count_if(t = cls AND q <> cls) AS fn FROM c LEFT JOIN o ON true GROUP BY 1)"


@query(f"WITH {_EVAL}, {_SR} SELECT cls, round({_PR}, 6) AS precision, round({_RC}, 6) AS recall, round({_F1}, 6) AS f1, tp + fn AS support FROM sr")
def eval_sentiment_report(spark, d):
    return _round(metrics.sentiment_report(_gold(spark, d), _pred(spark, d)), "precision", "recall", "f1")


@query(f"WITH {_EVAL}, {_SR} SELECT round(avg({_F1}), 6) AS macro_f1, round(sum(tp) / sum(tp + fn), 6) AS micro_f1, round(sum({_F1} * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1, round(sum(tp) / sum(tp + fn), 6) AS accuracy, sum(tp + fn)::BIGINT AS pairs FROM sr")
def eval_sentiment_f1(spark, d):
    return _round(metrics.sentiment_summary(_gold(spark, d), _pred(spark, d)), "macro_f1", "micro_f1", "weighted_f1", "accuracy")


@query(f"WITH {_EVAL} SELECT round(avg((pow(g[1] - p[1], 2) + pow(g[2] - p[2], 2) + pow(g[3] - p[3], 2)) / 3), 6) AS mse, round(avg(-ln(greatest(least(p[list_position(g, list_max(g))] / list_sum(p), 1 - {metrics.EPS}), {metrics.EPS}))), 6) AS log_loss, count(*) AS pairs FROM o")
def eval_mse_logloss(spark, d):
    return _round(metrics.sentiment_errors(_gold(spark, d), _pred(spark, d)), "mse", "log_loss")


def _brier_sql(source: str) -> str:
    return f"b AS (SELECT list_position(g, list_max(g)) - 1 AS cls, pow(p[1] - (g[1] = list_max(g))::INT, 2) + pow(p[2] - (list_position(g, list_max(g)) = 2)::INT, 2) + pow(p[3] - (list_position(g, list_max(g)) = 3)::INT, 2) + CASE WHEN list_position(p, list_max(p)) <> list_position(g, list_max(g)) THEN 2.0 / 3 ELSE 0 END AS b FROM {source})"


@query(f"WITH {_EVAL}, {_brier_sql('o')} SELECT cls::INT AS cls, round(avg(b), 6) AS brier, count(*) AS n FROM b GROUP BY 1")
def eval_brier(spark, d):
    return _round(metrics.brier(_gold(spark, d), _pred(spark, d)), "brier")


@query(
    f"WITH {_EVAL}, ga AS (SELECT CASE WHEN v IS NULL THEN [1/3, 1/3, 1/3] ELSE list_transform(v, lambda x: x / list_sum(v)) END AS g FROM g0), mean AS (SELECT [avg(g[1]), avg(g[2]), avg(g[3])] AS p FROM ga), s AS (SELECT g, p FROM ga CROSS JOIN mean), {_brier_sql('s')} SELECT cls::INT AS cls, round(avg(b), 6) AS brier, count(*) AS n FROM b GROUP BY 1"
)
def eval_brier_baseline(spark, d):
    return _round(metrics.brier_baseline(_gold(spark, d)), "brier")


# ---------------------------------------------------------------- null models

_NULL = f"""
users AS (SELECT DISTINCT user_id::VARCHAR AS id, (user_id % 3)::INT AS community FROM events),
cells AS (SELECT user_id::VARCHAR AS id, event_type AS aspect, count_if(value >= 160)::DOUBLE AS x, count_if(value < 160 AND value >= 120)::DOUBLE AS y, count_if(value < 120)::DOUBLE AS z FROM events WHERE value >= 100 GROUP BY ALL),
own AS (SELECT id, community, row_number() OVER (ORDER BY id) AS place FROM users), runs AS (SELECT unnest(range(1, {NULL_RUNS + 1})) AS run),
drawn AS (SELECT run, id AS donor, row_number() OVER (PARTITION BY run ORDER BY md5('1/' || run || '/' || id), id) AS place FROM users CROSS JOIN runs),
moved AS (SELECT run, own.id, own.community, donor FROM drawn JOIN own USING (place)),
u AS (SELECT run, community, aspect, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM moved JOIN cells ON cells.id = moved.donor WHERE x*x+y*y+z*z > 0),
m AS (SELECT run, community, aspect, sum(x) AS x, sum(y) AS y, sum(z) AS z, count(*) AS n FROM u GROUP BY ALL), sz AS (SELECT community, count(*) AS k FROM users GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT r.run, sz.community, a.aspect, k, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z, coalesce(n, 0) AS n FROM runs r CROSS JOIN sz CROSS JOIN (SELECT DISTINCT aspect FROM cells) a LEFT JOIN m ON m.run = r.run AND m.community = sz.community AND m.aspect = a.aspect),
wa AS (SELECT run, community, (x*x+y*y+z*z-n)/2 AS s, (k*(k-1) - (k-n)*(k-n-1))/2 AS q FROM f),
w AS (SELECT run, community, sum(CASE WHEN q > 0 AND s > 0 THEN s / q ELSE 0 END) / count_if(q > 0) AS cc FROM wa GROUP BY ALL),
ba AS (SELECT a.run, a.community AS a, b.community AS b, a.x*b.x+a.y*b.y+a.z*b.z AS s, a.k*b.k-(a.k-a.n)*(b.k-b.n) AS q FROM f a JOIN f b ON a.run = b.run AND a.aspect = b.aspect AND a.community < b.community),
b AS (SELECT run, a, b, sum(CASE WHEN q > 0 AND s > 0 THEN s / q ELSE 0 END) / count_if(q > 0) AS cc FROM ba GROUP BY ALL),
nulls AS (SELECT run::INT AS run, (SELECT avg(cc) FROM w WHERE w.run = r.run) / (SELECT avg(cc) FROM b WHERE b.run = r.run) AS ecr FROM runs r)"""


def _null(spark: SparkSession, d: str) -> DataFrame:
    return nulls.attribute_null(*_event_vectors(spark, d, 100, (160, 120)), runs=NULL_RUNS)


@query(f"WITH {_NULL} SELECT run, round(ecr, 6) AS ecr FROM nulls")
def null_attribute(spark, d):
    return _round(_null(spark, d), "ecr")


@query(f"WITH {_events_sql(*_SPARSE)}, {_cc_sql(1)}, obs AS (SELECT w / b AS obs FROM means), {_NULL.replace('users AS (', 'users2 AS (', 1).replace('cells AS (', 'cells2 AS (', 1).replace('w AS (', 'w2 AS (').replace('FROM w WHERE w.run', 'FROM w2 WHERE w2.run')} SELECT round(any_value(obs), 6) AS obs, round(avg(ecr), 6) AS null_mean, round(stddev_samp(ecr), 6) AS null_std, round((any_value(obs) - avg(ecr)) / stddev_samp(ecr), 3) AS z, count_if(ecr >= obs) / count(*) AS p_emp FROM nulls CROSS JOIN obs")
def null_stats(spark, d):
    observed = consensus.ratio(*_event_vectors(spark, d, 100, (160, 120)))
    return _round(_round(nulls.null_stats(observed, _null(spark, d)), "obs", "null_mean", "null_std"), "z", digits=3)


@query(f"WITH {_NULL}, r AS (SELECT round(ecr, 9) AS ecr FROM nulls), lim AS (SELECT min(ecr) AS lo, (max(ecr) - min(ecr)) / 30 AS w FROM r), hb AS (SELECT CASE WHEN w > 0 THEN least(floor((ecr - lo) / w), 29) ELSE 0 END::INT AS bin, lo, w FROM r CROSS JOIN lim) SELECT bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS runs FROM hb GROUP BY ALL")
def null_histogram(spark, d):
    return _round(nulls.null_histogram(_round(_null(spark, d), "ecr", digits=9)), "low", "high")


@query()
def null_topology(spark, d):
    """The whole interaction graph, rewired; users are the tweets with aspect vectors."""
    t = _tweets(spark, d)
    p = _t(spark, d, "absa_predictions").filter("sentiment_prob is not null").withColumnRenamed("pred_id", "ord")
    vectors = tables.long_aspects(p, _t(spark, d, "community_input").select("id", "community").distinct()).select("id", "aspect", "vec").filter(F.size("vec") == 3)
    return nulls.topology_null(graph.ReplyGraph(t), vectors)
