r"""Items of varying length combined into containers of fixed capacity.

Method: a grouping genetic algorithm whose genes are whole containers. Crossover injects well-filled containers of one
parent into the other, removes containers that hold an injected item, and puts the displaced items back by best fit; mutation empties the
least filled containers. The algorithm runs as islands: each district of items (drawn by a hash of the key, so of
bounded size) is evolved by several islands in parallel, and between epochs the elite of each island migrates to the next one.
Containers that end below ``poor`` of the capacity are opened, and their items are packed once more across districts.

An item is split only where it exceeds the capacity: into full containers and one rest, which is packed like any item. Null and
empty texts have no tokens and are left out. Ties are settled by key, so the same input gives the same containers.
"""

from __future__ import annotations

import bisect
import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.llm.encoding import token_counts
from gemaruang.session import cut

CAPACITY = 2048
DISTRICT = 1500
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 6, 12

Bins = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Bins, capacity: int) -> Bins:
    """``items`` in the given order, each into the fullest container that still holds it."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        bisect.insort(room, (left - sizes[i], k))
    return bins


def fitness(sizes: list[int], bins: Bins, capacity: int) -> float:
    """Mean squared fill: few containers, and those well filled."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def cross(sizes: list[int], a: Bins, b: Bins, capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled containers of ``b`` go into ``a``; what they displace is best-fitted, large items first."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    best = ranked[: max(1, len(ranked) // 2)]
    taken = rng.sample(best, max(1, len(best) // 2))
    inside = {i for x in taken for i in x}
    kept, displaced = [list(x) for x in taken], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, displaced, kept, capacity)


def mutate(sizes: list[int], bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """The least filled containers and some others are emptied and their items put back, large ones first."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    n = len(bins)
    gone = set(order[: max(1, n // 20)]) | set(rng.sample(range(n), min(n, max(1, n // 20))))
    items = [i for k in gone for i in bins[k]]
    items.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, items, [list(bins[k]) for k in range(n) if k not in gone], capacity)


def evolve(sizes: list[int], seeds: list[Bins], capacity: int, rng: random.Random, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The best packing of one island after some generations; ``seeds`` are elites that arrived."""
    n = len(sizes)
    least = math.ceil(sum(sizes) / capacity)
    large_first = sorted(range(n), key=lambda i: (-sizes[i], i))
    people = [(fitness(sizes, s, capacity), s) for s in seeds]
    first = True
    while len(people) < population:
        order = list(large_first)
        if not first:
            # neighbours in size change places: other packings of about the same quality
            for i in range(0, n - 1, 2):
                if rng.random() < 0.5:
                    order[i], order[i + 1] = order[i + 1], order[i]
            at = rng.randrange(n) if n else 0
            order = order[:at] + rng.sample(order[at:], n - at)
        first = False
        bins = best_fit(sizes, order, [], capacity)
        people.append((fitness(sizes, bins, capacity), bins))
    for _ in range(generations):
        people.sort(key=lambda p: -p[0])
        if len(people[0][1]) <= least:
            break
        a, b = (max(rng.sample(people, 2), key=lambda p: p[0]) for _ in range(2))
        child = mutate(sizes, cross(sizes, a[1], b[1], capacity, rng), capacity, rng)
        score = fitness(sizes, child, capacity)
        if score > people[-1][0]:
            people[-1] = (score, child)
    return max(people, key=lambda p: p[0])[1]


def _rounds(items: DataFrame, districts: int, capacity: int) -> DataFrame:
    """(district, bin, item, k, part, size): items packed within districts by islands with migration; ``item`` is a row's own number, as keys may be repeated."""
    placed = items.withColumn("district", F.pmod(F.xxhash64("k", "part"), F.lit(districts))).withColumn("seed", F.lit(0)).withColumn("bin", F.lit(-1))
    schema = "district long, island int, seed int, bin int, item long, k long, part int, size int"

    def epoch(number: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            district, island = int(key[0]), int(key[1])
            own = pdf.drop_duplicates(["item"]).sort_values(["k", "part", "item"])
            at = {x: i for i, x in enumerate(own["item"])}
            sizes = own["size"].tolist()
            seeds = []
            for _, s in pdf[pdf["bin"] >= 0].groupby("seed", sort=True):
                bins: dict[int, list[int]] = {}
                for b, x in zip(s["bin"], s["item"]):
                    bins.setdefault(b, []).append(at[x])
                seeds.append(list(bins.values()))
            bins = evolve(sizes, seeds, capacity, random.Random(f"{district}/{island}/{number}"))
            of = [0] * len(sizes)
            for b, members in enumerate(bins):
                for i in members:
                    of[i] = b
            return pd.DataFrame({"district": district, "island": island, "seed": island, "bin": of, "item": own["item"], "k": own["k"], "part": own["part"], "size": own["size"]})

        return run

    state = placed.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    for number in range(EPOCHS):
        if number:
            # the elite stays and also goes to the next island
            state = state.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
        state = state.select("district", "island", "seed", "bin", "item", "k", "part", "size").groupBy("district", "island").applyInPandas(epoch(number), schema)

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fills = pdf.groupby(["island", "bin"])["size"].sum().reset_index()
        score = (fills["size"] / capacity).pow(2).groupby(fills["island"]).mean()
        best = score.index[score.to_numpy().argmax()]
        return pdf.loc[pdf["island"] == best, ["district", "bin", "item", "k", "part", "size"]]

    return state.groupBy("district").applyInPandas(choose, "district long, bin int, item long, k long, part int, size int")


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, district_items: int = DISTRICT, poor: float = 0.985) -> DataFrame:
    """(container, key, part, size) of every item with a positive size; parts count from 0 and only items above ``capacity`` have several."""
    rows = cut(sizes.select(F.col(key).cast("long").alias("k"), F.col(size).cast("int").alias("n")).filter(F.col("n") > 0).withColumn("item", F.monotonically_increasing_id()))
    full = F.floor(F.col("n") / capacity).cast("int")
    whole = rows.filter(full > 0).select("item", "k", F.explode(F.sequence(F.lit(0), full - 1)).alias("part"), F.lit(capacity).alias("size"))
    alone = whole.select(F.concat_ws("-", F.lit("full"), "k", "part", "item").alias("container"), F.col("k").alias(key), "part", "size")
    items = rows.filter(F.col("n") % capacity > 0).select("item", "k", full.alias("part"), (F.col("n") % capacity).alias("size"))
    districts = max(1, round(items.count() / district_items))
    first = cut(_rounds(items, districts, capacity))
    fills = first.groupBy("district", "bin").agg(F.sum("size").alias("fill"))
    marked = first.join(fills, ["district", "bin"])
    good = marked.filter(F.col("fill") >= poor * capacity)
    rest = cut(marked.filter(F.col("fill") < poor * capacity).select("item", "k", "part", "size", "district", "bin"))
    # districts of the second pass are sized by what is left; where all was one district, packing it again gains nothing
    again = _rounds(rest.select("item", "k", "part", "size"), max(1, round(rest.count() / district_items)), capacity) if districts > 1 else rest

    def named(df: DataFrame, stage: str) -> DataFrame:
        return df.select(F.concat_ws("-", F.lit(stage), "district", "bin").alias("container"), F.col("k").alias(key), "part", "size")

    return named(good, "a").unionByName(named(again, "b")).unionByName(alone)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(container, key, part, size) of all non-empty texts, sized in tokens."""
    return pack(token_counts(docs, key, text, path), key, capacity=capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers any packing needs, and the share of unused space."""
    bins = packed.groupBy("container").agg(F.sum("size").alias("fill"))
    out = bins.agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
    return out.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused"))
