"""The whole run: tweets to communities, aspects and the echo-chamber ratio, as one composition of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.functions.vectors import parse_vector
from gemaruang.operators import communities, consensus, graph, propagation, responses
from gemaruang.session import cut


@dataclass
class Result:
    """Frames of each stage, and the seconds that building each took (their jobs run when they are read, but for loops)."""

    predictions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    within: DataFrame
    within_aspects: DataFrame
    between: DataFrame
    summary: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def aspect_vectors(predictions: DataFrame, users: DataFrame, order: str | None = None) -> DataFrame:
    """(id, community, aspect, vec): the last prediction of each id and aspect, for ids of ``users``."""
    vec = F.col("sentiment_prob")
    if dict(predictions.dtypes)["sentiment_prob"] == "string":
        vec = parse_vector("sentiment_prob")
    rows = predictions.filter(F.col("aspect_category").isNotNull()).select("id", F.col("aspect_category").alias("aspect"), vec.alias("vec"), (F.col(order) if order else F.monotonically_increasing_id()).alias("o"))
    last = rows.groupBy("id", "aspect").agg(F.max_by("vec", "o").alias("vec"))
    return users.select("id", "community").join(last, "id").select("id", "community", "aspect", "vec")


def run(
    corpus: DataFrame,
    aspects: DataFrame,
    order: str,
    predictions: DataFrame | None = None,
    provider: responses.Provider | None = None,
    tokens: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    algo: str = "louvain",
    k: int = 2,
    resolution: float = 0.5,
    power: int = 1,
    min_members: int = 5,
    batch_size: int = 25,
    aggregate_users: bool = False,
    log: Callable[[str], None] = lambda _: None,
) -> Result:
    """All stages.

    Aspect sentiment comes from ready ``predictions``, else from a ``provider`` of a language model, else by double propagation
    over ``tokens`` with a ``lexicon``. A corpus that has a ``community`` column keeps it and skips detection. Predictions are by tweet and nodes by user
    and community, so only the first tweet of a node counts; with ``aggregate_users`` the vectors of all its tweets are averaged instead.
    """
    seconds: dict[str, float] = {}

    def timed(name: str, f: Callable):
        log(name)
        start = time.time()
        out = f()
        seconds[name] = time.time() - start
        return out

    t = graph.tweets(corpus, order)

    def predict() -> DataFrame:
        if predictions is not None:
            return predictions
        if provider is not None:
            return responses.predict(t.select("id", "text", "ord"), aspects, provider, batch_size)
        if tokens is None or lexicon is None:
            raise ValueError("give predictions, a provider, or tokens with a lexicon")
        texts = tokens.select("doc", "id").distinct().join(t.groupBy("id").agg(F.max_by("text", "ord").alias("text")), "id").select("doc", "text")
        return propagation.double_propagation(tokens, texts, aspects, lexicon)

    found = timed("aspects", predict)

    def parts() -> DataFrame:
        if "community" in corpus.columns:
            return corpus.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("community", order).alias("community"))
        # detection works on the groups, as the merged graph does
        return communities.detect(t.select("id"), graph.ReplyGraph(t), algo, k, resolution)

    partition = timed("communities", lambda: cut(parts()))
    nodes, node_map = timed("contraction", lambda: graph.merge_by_user(t, partition, "name" in corpus.columns))
    merged = timed("graph", lambda: graph.merged_group_edges(t, node_map))

    def vectors() -> DataFrame:
        if not aggregate_users:
            return aspect_vectors(found, nodes)
        own = aspect_vectors(found, node_map.select("id", F.lit(0).alias("community"))).join(node_map, "id")
        cells = own.select("merged_id", "aspect", F.posexplode("vec").alias("i", "x")).groupBy("merged_id", "aspect", "i").agg(F.avg("x").alias("x"))
        vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
        return nodes.select("id", "community").join(cells.groupBy(F.col("merged_id").alias("id"), "aspect").agg(vec.alias("vec")), "id")

    v = timed("vectors", lambda: cut(vectors()))
    users = cut(nodes.select("id", "community"))

    def measure():
        return (
            consensus.within(users, v, power, min_members),
            consensus.within_aspects(users, v, power, min_members),
            consensus.between(users, v, power, min_members),
            consensus.ratio(users, v, power, min_members),
        )

    w, wa, b, s = timed("consensus", measure)
    return Result(found, nodes, merged, v, w, wa, b, s, seconds)
