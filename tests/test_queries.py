"""Queries against their SQL at the smallest scale, and the driver contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SMALL, same_as_sql  # noqa: E402

from gemaruang.plans import corpus_queries, queries  # noqa: E402

FAST = [
    "ecr_sparse", "between_cc", "clean_text", "normalize_text", "negator_merge", "phrase_merge", "text_ids", "unique_aspects", "drop_rows", "merge_text_aspects", "absa_pivot", "parse_probs",
    "reply_rule3", "user_contraction", "metis_fallback", "dp_pairs", "dp_weights", "dp_phrases", "dp_tfidf_aspect", "eval_aspect_prf", "eval_mismatches", "eval_exact_match", "eval_mse_logloss", "eval_brier", "eval_brier_baseline", "null_attribute", "ecr_details", "partition_modularity", "dp_predictions", "llm_parse_planted", "prompt_system", "prompt_users", "eval_wrong_lengths", "contracted_edges",
]


@pytest.mark.parametrize("name", FAST)
def test_core_query_matches_sql(spark, name):
    a, b = same_as_sql(spark, queries.QUERIES[name], queries.SQL[name])
    assert a == b


@pytest.mark.parametrize("name", ["p4_found", "p4_loaded", "p5_found", "p5_cycles", "p5_paths", "p5_descendants"])
def test_corpus_query_matches_sql(spark, name):
    a, b = same_as_sql(spark, corpus_queries.QUERIES[name], corpus_queries.SQL[name])
    assert a == b


def test_null_queries_are_whole(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(queries.nulls, "topology_null", lambda edges, vectors, **k: asked.update(k, edges=edges.count()))
    queries.QUERIES["null_topology"](spark, str(SMALL))
    every = queries.graph.reply_edges(queries._tweets(spark, str(SMALL))).count()
    assert asked == {"edges": every}
    assert sum(r["runs"] for r in queries.QUERIES["null_histogram"](spark, str(SMALL)).collect()) == 100


def test_communities_use_all_rules(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.communities, "louvain", lambda t, edges: asked.append(edges.count()))
    monkeypatch.setattr(queries.communities, "balanced_parts", lambda t, edges, k: asked.append(edges.count()))
    queries.QUERIES["louvain_communities"](spark, str(SMALL))
    queries.QUERIES["balanced_communities"](spark, str(SMALL))
    every = queries.graph.reply_edges(queries._tweets(spark, str(SMALL))).count()
    assert asked == [every, every]


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["within_mean", "between_mean", "ecr"] and df.count() == 1
    assert SMALL.exists()
