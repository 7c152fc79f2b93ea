"""Command line over the verbs and stages: ``python -m gemaruang.plans.cli VERB ...``."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from gemaruang.operators import communities, consensus, graph, metrics, nulls, tables
from gemaruang.plans import pipeline
from gemaruang.session import build_session
from gemaruang.sources import files


def _verbs(p: argparse.ArgumentParser) -> None:
    sub = p.add_subparsers(dest="verb", required=True)
    for name in ("add_id", "clean", "csvtotxt", "extract_ac", "extract_corpus", "filter_stopwords", "merge", "replace_phrase", "norm", "drop_columns", "drop_rows", "min_clean"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("output")
        s.add_argument("--text_column", default="text")
        if name == "clean":
            s.add_argument("--id_column", default="id")
        if name == "extract_ac":
            s.add_argument("--aspect_column", default="aspect_category_final")
        if name == "merge":
            s.add_argument("--aspects", required=True)
        if name == "replace_phrase":
            s.add_argument("phrase")
            s.add_argument("replacement")
        if name == "norm":
            s.add_argument("--slang_txt")
            s.add_argument("--slang_csv")
            s.add_argument("--stopwords")
        if name == "drop_columns":
            s.add_argument("columns", nargs="+")
        if name == "drop_rows":
            s.add_argument("condition")
        if name.startswith("drop_"):
            s.add_argument("--invert", action="store_true")
    s = sub.add_parser("community")
    s.add_argument("input")
    s.add_argument("--algo", choices=("louvain", "metis"), default="louvain")
    s.add_argument("-k", type=int, default=2)
    s.add_argument("--out-graph", default="graph")
    s.add_argument("--format", choices=("gml", "graphml"), default="gml")
    s.add_argument("--out-csv", default="tweets_with_communities")
    s = sub.add_parser("consensus")
    s.add_argument("csv")
    s.add_argument("-p", "--p-inner", type=int, default=1)
    s.add_argument("--min-members", type=int, default=5)
    s.add_argument("-o", "--output", default="summary")
    s.add_argument("--details", default="details")
    s = sub.add_parser("merge_aspects")
    s.add_argument("predictions")
    s.add_argument("meta")
    s.add_argument("output")
    s = sub.add_parser("evaluate")
    s.add_argument("--pred", required=True)
    s.add_argument("--gold", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--gold_aspect_col", default="aspect_category_final")
    s.add_argument("--gold_sentiment_col", default="hard_label_final")
    s.add_argument("--pred_aspect_col", default="aspect_category")
    s.add_argument("--pred_sentiment_col", default="sentiment_prob")
    s.add_argument("--sentiment_order", default="neg,neu,pos")
    s.add_argument("--normalize_sentiment_probs", action="store_true")
    s = sub.add_parser("nulls")
    s.add_argument("--aspects", required=True)
    s.add_argument("--graph")
    s.add_argument("--method", choices=("attribute", "topology", "both"), default="both")
    s.add_argument("--n-runs", type=int, default=100)
    s.add_argument("--out-prefix", required=True)
    s = sub.add_parser("run")
    s.add_argument("--community_input", required=True)
    s.add_argument("--absa_aspect", required=True)
    s.add_argument("--predictions", help="ready predictions; else --provider")
    s.add_argument("--provider", help="module:function that answers (system, user) prompts")
    s.add_argument("--batch_size", type=int, default=25)
    s.add_argument("--algo", choices=("louvain", "metis"), default="louvain")
    s.add_argument("-k", type=int, default=2)
    s.add_argument("--workdir", required=True)


def _loaded(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gemaruang")
    _verbs(parser)
    a = parser.parse_args(argv)
    spark = build_session()
    if a.verb == "community":
        df = files.read_csv(spark, a.input)
        t = graph.tweets(df, "ord")
        edges = graph.reply_edges(t)
        part = communities.detect(t, edges, a.algo, a.k)
        nodes, node_map = graph.merge_by_user(t, part, "name" in df.columns)
        files.write_graph(nodes, graph.merge_edges(edges, node_map), a.out_graph, a.format)
        files.write_csv(nodes, a.out_csv)
    elif a.verb == "consensus":
        users, vectors = files.read_aspect_matrix(spark, a.csv)
        s = consensus.ratio(users, vectors, a.p_inner, a.min_members)
        files.write_lines(consensus.summary_lines(s).orderBy("ord"), a.output)
        lines = consensus.detail_lines(*[f(users, vectors, a.p_inner, a.min_members) for f in (consensus.within, consensus.within_aspects, consensus.between)])
        files.write_lines(lines.orderBy("section", "a", "b"), a.details)
    elif a.verb == "merge_aspects":
        files.write_csv(tables.pivot_aspects(files.read_csv(spark, a.predictions), files.read_csv(spark, a.meta)), files.output_path(a.meta, a.output))
    elif a.verb == "evaluate":
        n = a.sentiment_order.split(",")
        gold = metrics.labelled(files.read_csv(spark, a.gold, True), a.gold_aspect_col, a.gold_sentiment_col, "ord", len(n), a.normalize_sentiment_probs)
        pred = metrics.labelled(files.read_csv(spark, a.pred, True), a.pred_aspect_col, a.pred_sentiment_col, "ord", len(n), a.normalize_sentiment_probs)
        lines = metrics.report_lines(gold, pred, tuple(n))
        files.write_lines(spark.createDataFrame(list(enumerate(lines)), "ord int, value string").orderBy("ord"), a.output)
    elif a.verb == "nulls":
        users, vectors = files.read_aspect_matrix(spark, a.aspects)
        observed = consensus.ratio(users, vectors)
        for method in ("attribute", "topology"):
            if a.method not in (method, "both"):
                continue
            if method == "attribute":
                runs = nulls.attribute_null(users, vectors, a.n_runs)
            else:
                _, edges = files.read_gml(spark, a.graph)
                runs = nulls.topology_null(edges, vectors.select("id", "aspect", "vec"), a.n_runs)
            nulls.null_stats(observed, runs).write.mode("overwrite").json(f"{a.out_prefix}_{method}_stats")
            nulls.null_histogram(runs).write.mode("overwrite").json(f"{a.out_prefix}_{method}_histogram")
    elif a.verb == "run":
        corpus = files.read_csv(spark, a.community_input)
        listed = files.read_csv(spark, a.absa_aspect)
        aspects = listed.select(F.col("ord").alias("aspect_ord"), "aspect_category", F.col("desc" if "desc" in listed.columns else "description").alias("description"))
        ready = files.read_csv(spark, a.predictions) if a.predictions else None
        r = pipeline.run(corpus, aspects, "ord", ready, _loaded(a.provider) if a.provider else None, algo=a.algo, k=a.k, batch_size=a.batch_size, log=print)
        files.write_csv(r.nodes, f"{a.workdir}/tweets_with_communities")
        files.write_graph(r.nodes, r.edges, f"{a.workdir}/graph")
        files.write_lines(consensus.summary_lines(r.summary).orderBy("ord"), f"{a.workdir}/summary")
        files.write_lines(consensus.detail_lines(r.within, r.within_aspects, r.between).orderBy("section", "a", "b"), f"{a.workdir}/details")
    else:
        out = files.output_path(a.input, a.output)
        if a.verb == "filter_stopwords":
            files.write_lines(tables.filter_stopwords(files.read_words(spark, a.input)), out, "word")
            return 0
        df = files.read_csv(spark, a.input, na_tokens=True, order=None)
        if a.verb == "csvtotxt":
            files.write_lines(tables.text_lines(df, a.text_column), out)
            return 0
        verbs = {
            "add_id": lambda: tables.text_ids(df, a.text_column),
            "clean": lambda: tables.clean_column(df, a.text_column, a.id_column),
            "extract_ac": lambda: tables.unique_aspects(df, a.aspect_column),
            "extract_corpus": lambda: tables.extract_corpus(df),
            "merge": lambda: tables.merge_on_id(df, files.read_csv(spark, a.aspects, True, None)),
            "replace_phrase": lambda: tables.replace_phrase(df, a.phrase, a.replacement, a.text_column),
            "norm": lambda: tables.normalize(
                df,
                a.text_column,
                tables.merge_slang(files.read_slang_lines(spark, a.slang_txt) if a.slang_txt else None, files.read_csv(spark, a.slang_csv) if a.slang_csv else None) if a.slang_txt or a.slang_csv else None,
                files.read_words(spark, a.stopwords) if a.stopwords else None,
            ),
            "drop_columns": lambda: tables.drop_columns(df, a.columns, a.invert),
            "drop_rows": lambda: tables.drop_rows(df, a.condition, a.invert),
            "min_clean": lambda: tables.min_clean(df, a.text_column),
        }
        files.write_csv(verbs[a.verb](), out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
