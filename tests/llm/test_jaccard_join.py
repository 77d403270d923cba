import math
import random
import re

import numpy as np
import pytest

from delve.llm import jaccard_join as J
from delve.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i] or i, i)
    nodes, links, root = sorted(reps.values()), {}, {v: v for v in reps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    postings = {}
    for v in nodes:
        seen = {}
        for s in sets[v]:
            for o in postings.setdefault(s, []):
                seen[o] = seen.get(o, 0) + 1
            postings[s].append(v)
        for o, both in seen.items():
            if both / (len(sets[v]) + len(sets[o]) - both) >= 0.8:
                links[v], links[o] = links.get(v, 0) + 1, links.get(o, 0) + 1
                a, b = sorted((find(v), find(o)))
                root[b] = a
    copies = {}
    for i in sets:
        copies[reps[sets[i] or i]] = copies.get(reps[sets[i] or i], 0) + 1
    return {i: (find(reps[sets[i] or i]), links.get(reps[sets[i] or i], 0), copies[reps[sets[i] or i]]) for i in sets}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def documents():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = text(40)
    out = [text(rng.randrange(5, 200)) for _ in range(150)]
    out += near_copies(rng, text(300), 400, 5)  # a large group of near copies
    out += [text(60) + " " + passage + " " + text(60) for _ in range(200)]  # a frequent passage
    for _ in range(30):
        out += near_copies(rng, text(120), 3, 3)
    out += [out[3]] * 50 + ["", None, "...", "one two", "One, two!", "one two three"]
    return list(enumerate(out))


def compare(spark, rows, params):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in J.join(df, params).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    return got, want


def test_join_equals_brute_force(spark):
    rows = documents()
    for params in (J.Params(recall=0.999999), J.Params(recall=0.999999, bucket=20, block=64)):
        got, want = compare(spark, rows, params)
        wrong = [(i, got[i], want[i]) for i in want if got[i][0] != want[i][0] or got[i][2] != want[i][2]]
        assert not wrong, wrong[:5]
        found, real = sum(v[1] for v in got.values()), sum(v[1] for v in want.values())
        assert found <= real and found >= 0.999 * real


@pytest.mark.parametrize("params", [J.Params(), J.Params(recall=0.999999), J.Params(threshold=0.6, recall=0.99)])
def test_target_recall_holds_for_sets_that_hold_each_other(params):
    meet, t = 1.0, params.threshold
    for _ in range(params.depth):
        meet = 1 - math.exp(-meet)
    lost = sum(math.comb(J.SKETCH, k) * t**k * (1 - t) ** (J.SKETCH - k) for k in range(J.SKETCH) if k < params.sketch_floor * J.SKETCH)
    assert (1 - meet) ** params.runs + lost <= 1 - params.recall


def test_sketch_keeps_pairs_at_the_threshold():
    rng, n, lost = np.random.default_rng(5), 2000, 0
    for _ in range(20):
        x = rng.integers(0, 1 << 32, (n, 100), dtype=np.uint64).astype(np.uint32)
        a, b = J.sketches(np.ascontiguousarray(x[:, :80]).ravel(), np.arange(n) * 80), J.sketches(x.ravel(), np.arange(n) * 100)
        lost += ((a == b).sum(axis=1) < J.Params().sketch_floor * J.SKETCH).sum()
    assert lost <= 1


def test_production_params_on_split_nodes(spark):
    """Texts and the same with words appended, at a similarity of 0.8; a passage in all of them brings more than `bucket` to a node."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, rows = text(44), []
    for _ in range(400):
        whole = passage + " " + text(40)  # 80 grams of 5 words
        rows += [whole, whole + " " + text(20)]  # 80 of 100
    got, want = compare(spark, list(enumerate(rows)), J.Params())
    assert sum(v[1] for v in want.values()) == 800
    assert sum(v[1] for v in got.values()) >= 798


def test_query_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in J.op10_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert J.join(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)], schema)
    got = sorted(map(tuple, J.join(rows).collect()), key=str)
    assert got == sorted([(None, None, 0, 1)] * 2 + [(7, 7, 0, 2)] * 2 + [(8, 8, 0, 1)], key=str)


def test_texts_under_one_doc_id_are_sets_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(7, a), (7, b), (9, a), (11, b + " end"), (12, "other words of no one else at all")]
    got = {(r.doc_id, r.n_copies, r.n_links): r.class_id for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of_a, of_b = got[9, 2, 0], got[11, 1, 1]
    assert of_a != of_b and 7 in (of_a, of_b) and min(of_a, of_b) < 0
    assert got == {(7, 2, 0): of_a, (9, 2, 0): of_a, (7, 1, 1): of_b, (11, 1, 1): of_b, (12, 1, 0): 12}


def test_a_pair_belongs_to_the_least_leaf_it_shares():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m = rng.integers(2, 30)
        leaves = [sorted(set(rng.integers(0, 12, rng.integers(0, 4)).tolist()) | {6}) for _ in range(m)]
        block = rng.integers(0, 2, m)
        for cross in (False, True):
            want = np.array([[x < y and not (set(leaves[x]) & set(leaves[y]) & set(range(6))) and not (cross and block[x] == block[y]) for y in range(m)] for x in range(m)])
            got = J._owned(6, J.pa.array(leaves, J.pa.list_(J.pa.int64())), block, cross)
            assert (np.zeros((m, m), bool) if got is None else got).tolist() == want.tolist()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_rows_of_a_node_are_split_once_and_in_proportion(spark, monkeypatch):
    """A plan that both counts and joins the children must not hold their making twice; a group of near copies twice as large has twice as many."""
    write, plans, made = J.materialise, [], {}

    def recorded(df, name="table", *rest):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")))
        out = write(df, name, *rest)
        if name == "split":
            made[group] = made.get(group, 0) + out.count()
        return out

    monkeypatch.setattr(J, "materialise", recorded)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    for group in (100, 200):
        rows = near_copies(rng, base, group, 3)
        J.join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), J.Params(bucket=20)).count()
    assert all(n <= 1 for _, n in plans), plans
    assert made[100] > 0 and made[200] < 3 * made[100], made
