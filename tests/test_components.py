import random

import pytest
from pyspark.sql import functions as F

from delve.operators import graph


def reach(edges):
    out = {a: set() for e in edges for a in e}
    for a in out:
        stack = [b for x, b in edges if x == a]
        while stack:
            x = stack.pop()
            if x not in out[a]:
                out[a].add(x)
                stack += [b for y, b in edges if y == x]
    return out


@pytest.mark.parametrize("n,m,seed", [(12, 14, 1), (12, 30, 2), (30, 33, 3), (5, 0, 4)])
def test_components_levels_and_order(spark, n, m, seed):
    rng = random.Random(seed)
    name = lambda i: f"d{i % 3}/f{i}.py"
    pairs = {(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(m)}
    groups = [("g", name(i)) for i in range(n)] + [("h", name(i)) for i in range(0, n, 2)]
    got = graph.layered_order(spark.createDataFrame(groups, "group string, node string"), spark.createDataFrame(list(pairs), "src string, dst string")).collect()
    key = lambda x: x.split("/")
    for g in ("g", "h"):
        nodes = {x for y, x in groups if y == g}
        inner = {(a, b) for a, b in pairs if a in nodes and b in nodes and a != b}
        far = reach(inner)
        comp = {x: min([x, *(y for y in far.get(x, ()) if x in far.get(y, ()))], key=key) for x in nodes}
        steps = {(comp[a], comp[b]) for a, b in inner if comp[a] != comp[b]}
        level = {}

        def depth(c):
            if c not in level:
                level[c] = 1 + max((depth(b) for a, b in steps if a == c), default=-1)
            return level[c]

        want = sorted(nodes, key=lambda x: (depth(comp[x]), key(comp[x]), key(x)))
        own = sorted((r for r in got if r.group == g), key=lambda r: r.position)
        assert [(r.position, r.node, r.level, r.component) for r in own] == [(i, x, depth(comp[x]), comp[x]) for i, x in enumerate(want)]


def test_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c"), ("a", "b")], "src string, dst string")
    assert sorted(map(tuple, graph.levels(edges).collect())) == [("a", 2), ("b", 1), ("c", 0), ("x", 1)]
    for more, most in (([("c", "a")], 64), ([], 2)):
        with pytest.raises(ValueError):
            graph.levels(edges.union(spark.createDataFrame(more, edges.schema)), most)
    assert graph.levels(edges.limit(0)).collect() == []


def test_one_group_of_many_nodes(spark):
    """Triangles that hang on each other: 100,000 components of three, each needing the one ten times smaller."""
    n = 100_000
    of = lambda c, k: F.format_string("m/%07d_%d", c, F.lit(k))
    ids = spark.range(n)
    ring = [ids.select(of(F.col("id"), k).alias("src"), of(F.col("id"), (k + 1) % 3).alias("dst")) for k in range(3)]
    down = ids.where("id > 0").select(of(F.col("id"), 0).alias("src"), of(F.expr("id div 10"), 1).alias("dst"))
    nodes = spark.range(3 * n).select(F.lit("all").alias("group"), F.format_string("m/%07d_%d", F.expr("id div 3"), F.expr("id % 3")).alias("node"))
    got = graph.layered_order(nodes, ring[0].unionByName(ring[1]).unionByName(ring[2]).unionByName(down))
    told = got.agg(F.count("*").alias("n"), F.countDistinct("component").alias("components"), F.max("level").alias("level"), F.max("position").alias("last")).first()
    assert (told.n, told.components, told.level, told.last) == (3 * n, n, 5, 3 * n - 1)
    digits = F.length(F.regexp_extract("node", "m/0*([0-9]*)_", 1))
    assert got.where(F.col("level") != F.when(digits == 0, 0).otherwise(digits)).count() == 0


def test_small_orders_take_no_pass_over_all_nodes(spark):
    rng = random.Random(3)
    for _ in range(200):
        nodes = [f"n{i}" for i in range(8)]
        pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randint(0, 14))}
        left, out, far = {n: {b for a, b in pairs if a == n and b != n} for n in nodes}, [], reach({p for p in pairs if p[0] != p[1]})
        cyclic = any(n in far.get(n, ()) for n in nodes)
        while left:
            ready = sorted(n for n, d in left.items() if not d & set(left))
            inner = {(a, b) for a, b in pairs if a in left and b in left and a != b}
            batch = ready[:1] if ready and cyclic else ready or [min(n for n in left if n in reach(inner).get(n, ()))]
            out += batch
            for n in batch:
                del left[n]
        assert graph._order(set(nodes), pairs) == out
