import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from delve.llm import lexical_search as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, len(t), Counter(t)) for i, t in own if t]
    n_docs, n_terms = len(own), sum(n for _, n, _ in own)
    df = Counter(t for *_, c in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, its in wanted.items():
        scored = []
        for i, n, c in own:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in its if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "term": F.lit(1), "row": F.lit(None)})
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    return sorted(map(tuple, L.search(docs, items, k).collect()), key=repr)


DOCS = [(1, "Alpha beta"), (2, "alpha ALPHA gamma"), (2, "alpha alpha gamma"), (None, "beta beta beta delta"), (None, None), (4, ""), (5, "..."), (6, "Über über STRASSE 12-12"), (7, "delta " * 50_000 + "beta"), (8, "alpha beta"), (9, "É é")]
ITEMS = [(1, "alpha BETA alpha"), (2, "über 12"), (3, None), (4, "nowhere"), (5, ""), (1, "delta"), (None, "gamma é"), (6, "delta beta alpha gamma straße")]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 2, "SLICE_ROWS": 2, "PIECE_BYTES": 64, "CELL_BITS": 1}, {"PAIRS": 3}])
@pytest.mark.parametrize("k", [1, 3])
def test_edges_against_brute_force(spark, monkeypatch, limits, k):
    for name, value in limits.items():
        monkeypatch.setattr(L, name, value)
    assert found(spark, DOCS, ITEMS, k) == brute(DOCS, ITEMS, k)


def test_random_tables_with_hot_terms_and_ties(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 16)
    monkeypatch.setattr(L, "SLICE_ROWS", 64)
    monkeypatch.setattr(L, "CELL_BITS", 6)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (1 + i) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(400)] + [(1000 + i, "w0 w1 w2 w3") for i in range(100)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(20)]
    assert found(spark, docs, items) == brute(docs, items)


def test_thresholds(spark):
    """Under the threshold in every list a document stays under the bar, and no greater one has that."""
    rng = random.Random(1)
    for _ in range(200):
        tops = np.array([rng.randint(1, 50) for _ in range(rng.randint(1, 6))])
        bar = rng.randint(0, int(tops.sum()))
        t = L.threshold(bar, tops)
        assert t == 1 or np.minimum(t - 1, tops).sum() < bar
        assert np.minimum(t, tops).sum() >= bar or t > tops.max()


def test_only_what_reaches_the_bar_is_looked_up():
    items = L.Items.of([(1, "a"), (1, "b")])
    weights = L.Weights(np.array([1000, 10]), 10, 100)
    plan = L.Plan(items, weights, [10**8], [6 * 10**7], [np.array([6 * 10**7 - 1, 10**7])], 2)
    own = pa.table({"row": [5, 6, 7], "doc_id": [50, None, 70], "n": [10, 10, 10], "codes": pa.array([[0, 1], [1], [0]], pa.list_(pa.int32())), "tfs": pa.array([[3, 1], [9], [1]], pa.list_(pa.int32()))})
    counts, codes, impacts = L._flat(own, weights)
    assert impacts.tolist() == [1000 * (3 * 10**9 // (3000 + 8 * 100)), 10 * (10**9 // 1800), 10 * (9 * 10**9 // 9800), 1000 * (10**9 // 1800)]
    sent = pa.table({"code": [0, 0], "row": [5, 7], "impact": [int(impacts[0]), int(impacts[3])]})
    got = L.judged(plan, sent, own).to_pylist()
    assert [(r["doc_id"], r["score"]) for r in got] == [(50, int(impacts[0] + impacts[1])), (70, int(impacts[3]))]
    none = L.judged(plan, sent.slice(0, 0), own)
    assert none.num_rows == 0


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == [] and found(spark, DOCS, []) == []
