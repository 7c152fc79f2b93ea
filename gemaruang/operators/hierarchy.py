"""Parent-child rows to full hierarchies: root, depth, path, descendants and cycles.

Each node has at most one parent, so the graph is a forest in which some trees may hang below a cycle.

1. *Components.* Pointer doubling: every node keeps a pointer ``2**k`` steps up, the steps taken and the smallest
   proper ancestor passed. A node that is its own smallest proper ancestor is the smallest node of a cycle, which is
   cut there. After ``log2(depth)`` rounds all pointers are roots or cut nodes: the component labels. Nodes that are done
   leave the rounds, so a hot root is never a join key.
2. *Co-location.* Components of at most ``max_component`` nodes are packed into tasks and walked by an iterative
   depth-first traversal with node colours (white, grey, black); a back edge to a grey node is a cycle. The walk keeps the trail from the
   top of the tree to the node, from which roots, depths, paths and descendants are written as it goes on.
3. *Larger components* never meet in one task: root and depth come from step 1, which has them already, cycle membership
   from a second doubling restricted to the components that were cut, and paths and descendants from a closure by doubling.

Nodes on a cycle are the tops of the trees that hang from them: these trees are walked like any other, and what is below a node of a
cycle are the nodes of its own trees. The other members of the cycle are reported as its cycle.

Ties and dirt: repeated ids are one node; of different parents for one id the smallest non-blank one counts. Null or
empty ids are no nodes. A parent that is no node is no parent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemaruang.functions.text import strip
from gemaruang.session import cut

CYCLE_DEPTH, BELOW_CYCLE_DEPTH = -1, -2


def parent_links(df: DataFrame, id_col: str = "id", parent_col: str = "in_reply_to_status_id") -> DataFrame:
    """(node, parent): one row for each distinct non-null, non-empty id; parent null for roots.

    The parent is stripped of surrounding white space; blank, or not the id of any row, means no parent.
    """
    parent = strip(F.col(parent_col))
    nodes = (
        df.select(F.col(id_col).alias("node"), F.when(parent != "", parent).alias("parent"))
        .filter(F.col("node").isNotNull() & (F.col("node") != ""))
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _settle(rows: DataFrame) -> DataFrame:
    """Cut the cycles that the open rows have come round, and finish all open rows whose least ancestor lies on one.

    A node that is its own least proper ancestor is the least node of a cycle. Whoever has it as least ancestor is in its component.
    """
    rows = cut(rows)
    found = rows.filter(~F.col("done") & (F.col("least") == F.col("node"))).select(F.col("node").alias("least"), F.lit(True).alias("looped"))
    if found.isEmpty():
        return rows
    met = ~F.col("done") & F.coalesce("looped", F.lit(False))
    joined = rows.join(found, "least", "left")
    return cut(
        joined.select(
            "node", "parent", F.when(met, F.col("least")).otherwise(F.col("up")).alias("up"), "steps", "least", (F.col("done") | met).alias("done"), (met & (F.col("least") == F.col("node"))).alias("cut"),
        )
    )


def _walk(links: DataFrame) -> DataFrame:
    """(node, parent, up, steps, cut): ``up`` is the root reached after ``steps``; ``cut`` marks the nodes at which cycles were cut, which are the ``up`` of their components.

    A row is done when its pointer is a root. An open row's next pointer is that of its target, so the targets of a round are
    among those of the round before: the pool of rows that can be asked shrinks with the open ones, and only the first rounds are as
    large as the table.
    """
    links = cut(links)
    roots = links.filter(F.col("parent").isNull()).select("node", "parent", F.col("node").alias("up"), F.lit(0).cast("long").alias("steps"), F.lit(False).alias("cut"))
    above = links.select(F.col("node").alias("parent"), F.col("parent").isNull().alias("done"))
    state = links.join(above, "parent").select(
        "node", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("parent").alias("least"), "done", F.lit(False).alias("cut")
    )
    state = _settle(state)
    pool, finished = state, [roots]
    while True:
        finished.append(state.filter("done").select("node", "parent", "up", "steps", "cut"))
        open_rows = state.filter(~F.col("done"))
        if open_rows.isEmpty():
            break
        target = pool.select(F.col("node").alias("up"), F.col("up").alias("t_up"), F.col("steps").alias("t_steps"), F.col("least").alias("t_least"), F.col("done").alias("t_done"))
        moved = open_rows.join(target, "up").select(
            "node", "parent", F.col("t_up").alias("up"), (F.col("steps") + F.col("t_steps")).alias("steps"), F.least("least", "t_least").alias("least"), F.col("t_done").alias("done"), "cut",
        )
        asked = open_rows.select(F.col("up").alias("node")).distinct()
        state = _settle(moved)
        pool = cut(state.unionByName(pool.filter("done")).join(asked, "node", "left_semi"))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def _traversal(ids: list[str], parents: list[str | None]) -> Iterator[tuple[int, list[int], int]]:
    """(node, trail, cycle) of every node of whole components, depth first, children in order of id.

    ``trail`` has the nodes from the top of the tree down to the node, as a list that changes while the walk goes on; ``cycle`` is the
    least node of the cycle that the top lies on, or -1. Colours: 0 white, 1 grey, 2 black.
    """
    at = {v: i for i, v in enumerate(ids)}
    up = [at[p] if p is not None else -1 for p in parents]
    order = sorted(range(len(ids)), key=ids.__getitem__, reverse=True)
    colour, cycle = [0] * len(ids), [-1] * len(ids)
    for i in order:
        # up the parents through white nodes: a grey one closes a cycle by a back edge
        grey, v = [], i
        while v >= 0 and not colour[v]:
            colour[v] = 1
            grey.append(v)
            v = up[v]
        if v >= 0 and colour[v] == 1:
            ring = grey[grey.index(v) :]
            least = min(ring, key=ids.__getitem__)
            for w in ring:
                cycle[w] = least
        for w in grey:
            colour[w] = 2
    children: list[list[int]] = [[] for _ in ids]
    tops = []
    for i in order:
        if up[i] < 0 or cycle[i] >= 0:
            tops.append(i)
        else:
            children[up[i]].append(i)
    trail: list[int] = []
    for top in reversed(tops):
        stack = [(top, 0)]
        while stack:
            v, depth = stack.pop()
            del trail[depth:]
            trail.append(v)
            yield v, trail, cycle[top]
            stack += [(w, depth + 1) for w in children[v]]


def _tree_rows(ids: list[str], v: int, trail: list[int], cycle: int) -> list[tuple]:
    if cycle < 0:
        return [(ids[v], ids[trail[0]], len(trail) - 1)]
    return [(ids[v], "", CYCLE_DEPTH if len(trail) == 1 else BELOW_CYCLE_DEPTH)]


def _path_rows(ids: list[str], v: int, trail: list[int], cycle: int) -> list[tuple]:
    return [(ids[v], [ids[w] for w in trail])] if cycle < 0 else []


def _descendant_rows(ids: list[str], v: int, trail: list[int], cycle: int) -> list[tuple]:
    n = len(trail) - 1
    return [(ids[w], ids[v], n - i) for i, w in enumerate(trail[:-1])]


def _cycle_rows(ids: list[str], v: int, trail: list[int], cycle: int) -> list[tuple]:
    return [(ids[v], ids[cycle])] if cycle >= 0 and len(trail) == 1 else []


def _walked(small: DataFrame, rows: Callable[[list[str], int, list[int], int], list[tuple]], schema: str) -> DataFrame:
    """What ``rows`` writes on a walk of co-located components (component, node, parent), many to a task and one after another."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def walk(ids: list[str], parents: list[str | None]) -> Iterator[pd.DataFrame]:
            nonlocal out
            for v, trail, cycle in _traversal(ids, parents):
                out += rows(ids, v, trail, cycle)
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []

        current, ids, parents = None, [], []
        for b in batches:
            for comp, node, parent in zip(b["component"], b["node"], b["parent"]):
                if comp != current and len(ids) >= 4096:
                    yield from walk(ids, parents)
                    ids, parents = [], []
                current = comp
                ids.append(node)
                parents.append(parent)
        yield from walk(ids, parents)
        if out:
            yield pd.DataFrame(out, columns=names)

    placed = small.select("component", "node", "parent").repartition("component").sortWithinPartitions("component")
    return placed.mapInPandas(run, schema)


def _marked_cycles(cyclic: DataFrame) -> DataFrame:
    """(node): the nodes on cycles among ``cyclic`` (node, parent, cut).

    From the parent of each cut node the pointers of every doubling round are followed: after round k the set holds the first ``2**k`` ancestors.
    """
    jump = cut(cyclic.select("node", F.when(F.col("cut"), F.col("node")).otherwise(F.col("parent")).alias("up")))
    found = cut(cyclic.filter("cut").select(F.col("parent").alias("node")).distinct())
    count = found.count()
    still = 0
    while True:
        grown = found.join(jump, "node").select(F.col("up").alias("node"))
        found = cut(found.unionByName(grown).distinct())
        other = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = cut(jump.join(other, "up").select("node", F.col("up2").alias("up")))
        now = found.count()
        still = still + 1 if now == count else 0
        if still:
            return found
        count = now


def _located(links: DataFrame, max_component: int, max_pairs: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(small, large): the nodes of components that are co-located, and those of larger ones with ``on`` for those on a cycle.

    ``max_pairs`` also bounds the sum of a small component's depths, for walks that write a row for each ancestor.
    """
    state = _walk(links)
    sizes = state.groupBy(F.col("up").alias("component")).agg(F.count(F.lit(1)).alias("members"), F.sum("steps").alias("pairs"), F.max(F.col("cut").cast("int")).alias("cyclic"))
    over = F.col("members") > max_component
    if max_pairs is not None:
        over = over | (F.col("pairs") > max_pairs)
    # at most (all nodes / max_component) components are large, or (all pairs / max_pairs); their labels are the only ones that are broadcast
    large = cut(sizes.filter(over))
    nodes = state.withColumnRenamed("up", "component")
    if large.isEmpty():
        return nodes, None
    marks = F.broadcast(large.select("component", "cyclic"))
    rest = cut(nodes.join(marks, "component"))
    marked = _marked_cycles(rest.filter("cyclic = 1")).select("node", F.lit(True).alias("on"))
    return nodes.join(marks, "component", "left_anti"), rest.join(marked, "node", "left").withColumn("on", F.coalesce("on", F.lit(False)))


def hierarchy(links: DataFrame, max_component: int = 200_000) -> DataFrame:
    """(id, root_id, depth) of every node of ``links`` (node, parent).

    Roots have themselves and 0; nodes on a cycle ``''`` and -1, nodes below one ``''`` and -2. An empty table gives no rows.
    """
    small, large = _located(links, max_component)
    out = _walked(small, _tree_rows, "id string, root_id string, depth long")
    if large is None:
        return out
    looped = F.col("cyclic") == 1
    depth = F.when(~looped, F.col("steps")).when(F.col("on"), CYCLE_DEPTH).otherwise(BELOW_CYCLE_DEPTH)
    return out.unionByName(large.select(F.col("node").alias("id"), F.when(looped, "").otherwise(F.col("component")).alias("root_id"), depth.cast("long").alias("depth")))


def _closure(edges: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of the trees of ``edges`` (node, parent), by doubling; kept as rows, so that no node's descendants meet in one task."""
    closure, reach = cut(edges.select(F.col("node").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance"))), 1
    while True:
        edge = closure.filter(F.col("distance") == reach)
        if edge.isEmpty():
            return closure
        onward = closure.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("distance").alias("more"))
        further = edge.join(onward, "ancestor").select("id", F.col("beyond").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        closure = cut(closure.unionByName(further))
        reach *= 2


def descendants(links: DataFrame, max_component: int = 200_000, max_pairs: int = 20_000_000) -> DataFrame:
    """(id, descendant, distance): every node below every node; below a node of a cycle are the nodes of its own trees.

    The output is as large as the sum of all depths.
    """
    small, large = _located(links, max_component, max_pairs)
    out = _walked(small, _descendant_rows, "id string, descendant string, distance long")
    if large is None:
        return out
    trees = large.filter(F.col("parent").isNotNull() & ~F.col("on"))
    return out.unionByName(_closure(trees).select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "distance"))


def paths(links: DataFrame, separator: str = "/", max_component: int = 200_000, max_pairs: int = 20_000_000) -> DataFrame:
    """(id, path): the ids from the root to the node; nodes on or below a cycle have none.

    A path is as long as the node is deep, so its array is bounded by the depth, not by the component.
    """
    small, large = _located(links, max_component, max_pairs)
    out = _walked(small, _path_rows, "id string, path array<string>")
    if large is not None:
        plain = large.filter("cyclic = 0")
        up = F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False)
        above = _closure(plain.filter(F.col("parent").isNotNull())).groupBy("id").agg(F.transform(up, lambda s: s["ancestor"]).alias("above"))
        own = plain.select(F.col("node").alias("id")).join(above, "id", "left")
        out = out.unionByName(own.select("id", F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("id")).alias("path")))
    return out.select("id", F.concat_ws(separator, "path").alias("path"))


def descendant_counts(links: DataFrame, max_component: int = 200_000, max_pairs: int = 20_000_000) -> DataFrame:
    """(id, descendants): number of all nodes below each node."""
    below = descendants(links, max_component, max_pairs).groupBy("id").agg(F.count(F.lit(1)).alias("descendants"))
    return links.select(F.col("node").alias("id")).join(below, "id", "left").select("id", F.coalesce("descendants", F.lit(0)).cast("long").alias("descendants"))


def cycles(links: DataFrame, max_component: int = 200_000) -> DataFrame:
    """(id, cycle_id, back_edge) of every node on a cycle: the cycle's least id, and whether its link is the one that leads back there.

    A self-reference is a cycle of one.
    """
    small, large = _located(links, max_component)
    out = _walked(small, _cycle_rows, "id string, cycle_id string")
    if large is not None:
        out = out.unionByName(large.filter("on").select(F.col("node").alias("id"), F.col("component").alias("cycle_id")))
    parent = links.select(F.col("node").alias("id"), "parent")
    return out.join(parent, "id").select("id", "cycle_id", (F.col("parent") == F.col("cycle_id")).alias("back_edge"))
