"""Dependency graphs: edges, fan-in, neighbours, order, boosts."""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delve.functions.text import path_parts
from delve.sources.stage import cut, numbered


def dependency_edges(imports: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """src, dst, kind from imports (src, dst, type_only): runtime edges, and type_only edges that are not runtime edges too.

    Null, self and untracked targets are left out.
    """
    known = imports.where(F.col("dst").isNotNull() & F.col("src").isNotNull() & (F.col("src") != F.col("dst")))
    if tracked is not None:
        known = known.join(tracked.select(F.col("path").alias("dst")), "dst", "left_semi")
    # runtime (false) sorts first, so the least flag of an edge tells its kind: one shuffle, no anti join
    edges = known.groupBy("src", "dst").agg(F.min("type_only").alias("type_only"))
    return edges.select("src", "dst", F.when(F.col("type_only"), "type_only").otherwise("runtime").alias("kind"))


def adjacency(edges: DataFrame) -> DataFrame:
    """path, dependencies, dependents, type_only of each node, in path order."""
    order = lambda c: F.transform(F.array_sort(F.collect_set(F.when(c[0], F.struct(path_parts(F.col(c[1])).alias("k"), F.col(c[1]).alias("v"))))), lambda x: x.v)
    runtime = F.col("kind") == "runtime"
    out = edges.groupBy(F.col("src").alias("path")).agg(order((runtime, "dst")).alias("dependencies"), order((~runtime, "dst")).alias("type_only"))
    into = edges.where(runtime).groupBy(F.col("dst").alias("path")).agg(order((runtime, "src")).alias("dependents"))
    return out.join(into, "path", "full").select("path", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("dependencies", "dependents", "type_only")))


def fan_in(edges: DataFrame) -> DataFrame:
    """dst and the number of distinct nodes that depend on it at run time."""
    return edges.where(F.col("kind") == "runtime").groupBy("dst").agg(F.countDistinct("src").alias("fan_in"))


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 2, src: str = "src", dst: str = "dst") -> DataFrame:
    """start, node, depth of the nodes within depth steps of each start (start), at their least depth, the start itself left out."""
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0)


def levels(edges: DataFrame, most: int = 64, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, level: 0 for nodes that depend on none, else one more than the highest of those they depend on.

    Each round takes the nodes whose needs have all been met and lowers the counts of those that need them; edges are written once.  A cycle is an error, as
    a chain of more than `most` levels is.  Use layered_order for graphs with cycles.
    """
    step = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    needs = step.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("needs"))
    nodes = step.select(F.col("dst").alias("node")).distinct()
    left = cut(nodes.join(needs, "node", "full").select("node", F.coalesce("needs", F.lit(0)).alias("needs")))
    out = left.limit(0).select("node", F.lit(0).alias("level"))
    for n in range(most):
        ready = cut(left.where("needs = 0").select("node", F.lit(n).alias("level")))
        if ready.isEmpty():
            break
        out = out.unionByName(ready)
        met = step.join(ready.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("met"))
        left = cut(left.where("needs > 0").join(met, "node", "left").select("node", (F.col("needs") - F.coalesce("met", F.lit(0))).alias("needs")))
        if left.isEmpty():
            return out
    if left.isEmpty():
        return out
    raise ValueError(f"no order within {most} levels: the graph has a cycle, or a longer chain")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges (a, b) that are left when nodes without edges in, or without edges out, go again and again: all cycles are in them."""
    size = edges.count()
    while size:
        kept = cut(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        n = kept.count()
        edges, before, size = kept, size, n
        if n == before:
            break
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component of edges (a, b: long): the nodes that stand on cycles, with the least node of all that reach each other.

    Colours go forward: a node takes the greatest node that reaches it.  Back from that node, within its colour, all that is met is one component.  Components
    go, what is left is coloured anew.  Each round is written; rounds grow with the longest shortest path.
    """
    left, found = _trimmed(cut(edges.where("a <> b").select("a", "b").distinct())), None
    while not left.isEmpty():
        colours = cut(left.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))  # after trimming every node has an edge out
        moved = colours
        while not moved.isEmpty():
            offers = left.join(moved.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("offer"))
            moved = cut(offers.join(colours, "node").where("offer > colour").select("node", F.col("offer").alias("colour")))
            colours = cut(colours.join(moved.withColumnRenamed("colour", "new"), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")))
        own = left.join(colours.select(F.col("node").alias("a"), "colour"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b")
        own = cut(own.where("colour = other").select("a", "b"))
        met = front = cut(colours.where("node = colour"))
        while not front.isEmpty():
            back = own.join(front.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "colour").distinct()
            front = cut(back.join(met, "node", "left_anti"))
            met = cut(met.unionByName(front))
        found = met if found is None else found.unionByName(met)
        gone = met.select("node")
        left = _trimmed(cut(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")))
    if found is None:
        return edges.limit(0).select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = found.groupBy("colour").agg(F.min("node").alias("component"))
    return cut(found.join(least, "colour").select("node", "component"))


def layered_order(groups: DataFrame, edges: DataFrame, most: int = 256) -> DataFrame:
    """group, position, node, level, component: each group's nodes (group, node), dependencies before dependents, over its induced subgraph, of any size.

    Nodes that need each other are one component, named by its least node in path order.  Components have levels as in levels(); the order goes by
    level, component and path, so that it depends on nothing else.  edges: src needs dst.
    """
    parts = path_parts(F.col("node"))
    placed = numbered(groups.select("group", "node").distinct().withColumn("_parts", parts), "id", "group", "_parts").drop("_parts")
    known = cut(placed.select("group", "node", "id"))
    inner = edges.select("src", "dst").distinct().join(known.select("group", F.col("node").alias("src"), F.col("id").alias("a")), "src")
    target = known.select(F.col("group").alias("other"), F.col("node").alias("target"), F.col("id").alias("b"))
    inner = inner.join(target, F.col("group").eqNullSafe(F.col("other")) & (F.col("dst") == F.col("target"))).select("a", "b").where("a <> b")
    inner = cut(inner)
    strong = strong_components(inner)
    name = lambda c: strong.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    condensed = inner.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_component", "a").alias("src"), F.coalesce("b_component", "b").alias("dst")).where("src <> dst")
    level = levels(condensed, most).withColumnRenamed("node", "component")
    own = known.join(strong.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(level, "component", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    ordered = cut(numbered(own, "place", "group", "level", "component", "id"))
    first = ordered.groupBy(F.col("group").alias("_group")).agg(F.min("place").alias("first"))
    named = known.select(F.col("id").alias("component"), F.col("node").alias("component_node"))
    out = ordered.join(first, F.col("group").eqNullSafe(F.col("_group"))).join(named, "component")
    return out.select("group", (F.col("place") - F.col("first")).alias("position"), "node", "level", F.col("component_node").alias("component"))


def _order(nodes: Iterable[str], pairs: set[tuple[str, str]]) -> list[str]:
    """Dependencies first, level by level; when a cycle blocks all, the least node that can reach itself goes next."""
    key = lambda x: x.split("/")
    needs: dict[str, set[str]] = {n: set() for n in nodes}
    users: dict[str, list[str]] = {n: [] for n in needs}
    for a, b in pairs:
        if a in needs and b in needs and a != b:
            needs[a].add(b)
            users[b].append(a)

    def take(n: str) -> list[str]:
        """n is done: those that wait for nothing more."""
        del needs[n]
        free = []
        for user in users[n]:
            if user in needs:
                needs[user].discard(n)
                if not needs[user]:
                    free.append(user)
        return free

    def on_cycle(n: str) -> bool:
        stack, seen = list(needs[n]), set()
        while stack:
            x = stack.pop()
            if x == n:
                return True
            if x in needs and x not in seen:
                seen.add(x)
                stack += needs[x]
        return False

    out: list[str] = []
    layers, ready = [], sorted((n for n, d in needs.items() if not d), key=key)
    whole = {n: set(d) for n, d in needs.items()}
    while ready:  # level by level, as long as nothing is blocked
        layers += ready
        ready = sorted((x for n in ready for x in take(n)), key=key)
    if not needs:
        return layers
    needs = whole
    heap = [(key(n), n) for n, d in needs.items() if not d]
    heapify(heap)
    while needs:
        n = heappop(heap)[1] if heap else next(filter(on_cycle, sorted(needs, key=key)))
        out.append(n)
        for x in take(n):
            heappush(heap, (key(x), x))
    return out


def dependency_order(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """group, position, node: each group's nodes (group, node), dependencies before dependents, over its induced subgraph.

    A group is a change's files and small; groups are ordered independently.
    """
    inner = groups.join(edges.select(F.col("src").alias("node"), "dst"), "node", "left")
    other = groups.select("group", F.col("node").alias("dst"), F.lit(True).alias("inside"))
    inner = inner.join(other, ["group", "dst"], "left").select("group", "node", F.when(F.col("inside"), F.col("dst")).alias("dst"))

    def order(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = {(a, b) for a, b in zip(rows.node, rows.dst, strict=True) if isinstance(b, str)}
        nodes = _order(set(rows.node), pairs)
        return pd.DataFrame({"group": key[0], "position": range(len(nodes)), "node": nodes})

    return inner.groupBy("group").applyInPandas(order, f"group {dict(groups.dtypes)['group']}, position long, node string")


def structural_boost(ranking: DataFrame, edges: DataFrame, seeds: int = 5, near: float = 0.25, hub: float = 0.01) -> DataFrame:
    """ranking (path, score) with scores raised near its first seeds.

    A neighbour of one of the first `seeds` gets near times the best score; every path hub times the best score times a tenth of its fan-in,
    which counts to 10.  The ranking is computed once.
    """
    ranking = cut(ranking.select("path", "score"))
    best = ranking.agg(F.max("score").alias("best"))
    first = ranking.where(F.col("score") > 0).orderBy(F.desc("score"), "path").limit(seeds).select(F.col("path").alias("start"))
    both = edges.where("kind = 'runtime'").select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    close = both.join(F.broadcast(first), both["src"] == F.col("start")).select(F.col("dst").alias("path")).distinct().withColumn("near", F.lit(1))
    out = ranking.crossJoin(F.broadcast(best)).join(close, "path", "left").join(fan_in(edges).withColumnRenamed("dst", "path"), "path", "left")
    raised = F.col("score") + near * F.col("best") * F.coalesce("near", F.lit(0)) + hub * F.col("best") * F.least(F.coalesce("fan_in", F.lit(0)), F.lit(10)) / 10
    return out.select("path", F.round(raised, 6).alias("score"))


def history_boost(ranking: DataFrame, partners: DataFrame, seeds: int = 3) -> DataFrame:
    """ranking (path, score), raised by the best score times the greatest support among partners (path, partner, support) of its first seeds.
    The ranking is computed once."""
    ranking = cut(ranking.select("path", "score"))
    best = ranking.agg(F.max("score").alias("best"))
    first = ranking.where(F.col("score") > 0).orderBy(F.desc("score"), "path").limit(seeds).select(F.col("path").alias("seed"))
    gain = partners.join(F.broadcast(first), partners["path"] == F.col("seed")).groupBy(F.col("partner").alias("path")).agg(F.max("support").alias("support"))
    out = ranking.crossJoin(F.broadcast(best)).join(gain, "path", "left")
    return out.select("path", F.round(F.col("score") + F.col("best") * F.coalesce("support", F.lit(0.0)), 6).alias("score"))


def expansion(edges: DataFrame, confirmed: DataFrame, files: int = 2, each: int = 3, most: int = 6) -> DataFrame:
    """Neighbours of the first confirmed files (seq, path): at most `each` a direction and file, `most` in all, in order."""
    first = confirmed.orderBy("seq").limit(files)
    runtime = edges.where("kind = 'runtime'")
    ways = runtime.select(F.col("src").alias("path"), F.col("dst").alias("node"), F.lit(0).alias("way")).unionByName(runtime.select(F.col("dst").alias("path"), F.col("src").alias("node"), F.lit(1).alias("way")))
    near = ways.join(F.broadcast(first), "path").join(F.broadcast(first.select(F.col("path").alias("node"))), "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("path", "way").orderBy(path_parts(F.col("node"))))
    near = near.withColumn("n", rank).where(F.col("n") <= each)
    once = near.groupBy("node").agg(F.min(F.struct("seq", "way", "n", "path")).alias("x"))
    return once.orderBy("x").limit(most).select("node", "x.path", F.when(F.col("x.way") == 0, "dependency").otherwise("dependent").alias("direction"))
