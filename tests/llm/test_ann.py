import numpy as np
import pytest

from delve.llm import ann as A


def brute(vectors, queries, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    out = {}
    for q, v in queries:
        score = x @ np.array(v, np.float32).astype(np.float64)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), score[i]) for i in order]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(vectors, [v for v in vectors if v[0] % 20 == 0])
    got = rows_of(A.op9_ann(spark, d))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.93
    by_id = dict(vectors)
    for q, near in list(got.items())[:20]:
        for i, s in near:
            assert s == pytest.approx(float(np.dot(np.array(by_id[q], np.float64), np.array(by_id[i], np.float64))), abs=1e-12)


@pytest.mark.parametrize("params", [A.Params(least_sample=300, sample=300, list_rows=64), A.Params(least_sample=600, sample=600, list_rows=25, coarse=12)])
def test_recall_on_a_table_of_many_times_the_sample(spark, params):
    """One codebook; and a coarse one with residuals, which has 144 lists."""
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((40, 24)) * 2
    x = (middles[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 24))).astype(np.float32)
    vectors = list(enumerate(x.tolist()))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got, want = rows_of(A.search(df, df.where("vec_id % 20 = 0"), params)), brute(vectors, [v for v in vectors if v[0] % 20 == 0])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("kind, share", [("clusters", 0.2), ("lengths", 0.6)])
def test_fifty_lists_with_the_parameters_of_the_query(spark, monkeypatch, kind, share):
    """Recall, and what part of all pairs of a query and a vector is in cells; vectors of varied length gather in lists that all queries probe."""
    rng, n, dim = np.random.default_rng(11), 26_000, 16
    x = rng.standard_normal((n, dim))
    x = 3 * rng.standard_normal((200, dim))[rng.integers(0, 200, n)] + x if kind == "clusters" else x * rng.lognormal(0, 0.5, (n, 1))
    vectors = list(enumerate(x.astype(np.float32).tolist()))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    probed, sizes, materialise = [], {}, A.materialise

    def watched(df, name):
        out = materialise(df, name)
        if name == "probed":
            probed.append({r["list"]: r["count"] for r in out.groupBy("list").count().collect()})
        if name == "sizes":
            sizes.update({r["list"]: r["size"] for r in out.collect()})
        if name == "cells":
            assert all(r.blocks == -(-sizes[r["list"]] // 4096) and r.chunks == -(-probed[-1][r["list"]] // 4096) for r in out.collect())
        return out

    monkeypatch.setattr(A, "materialise", watched)
    queries = [v for v in vectors if v[0] % 20 == 0]
    got, want = rows_of(A.search(df, df.where("vec_id % 20 = 0"))), brute(vectors, queries)
    assert all(len(got[q]) == 20 for q in want) and recall(got, want) >= 0.9
    assert len(sizes) >= 40 and sum(sizes.values()) == n
    assert sum(m * sizes.get(c, 0) for each in probed for c, m in each.items()) <= share * n * len(queries)


def test_doubles_and_lengths(spark):
    rows = [(0, [1.0, 1e-12]), (1, [1.0, 2e-12]), (2, [1.0]), (3, [0.5, 0.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(A.search(df, df))
    assert got[0] == [(1, 1.0 + 2e-24), (2, 1.0), (3, 0.5)] and [i for i, _ in got[2]] == [0, 1, 3] and got[3] == [(0, 0.5), (1, 0.5), (2, 0.5)]


def test_copies_norms_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 9)).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(200)]  # a hot vector
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0] * 7 + [None]), (2080, []), (2100, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, score string")
    exact = A.Params(list_rows=40, recall=1.0, epsilon=9.0, cell_rows=64)
    got = rows_of(A.search(df, df.where("vec_id % 20 = 0"), exact))
    want = brute(vectors, [v for v in vectors if v[0] % 20 == 0])
    assert got.keys() == want.keys()
    assert recall(got, want) > 0.98
    for q in (0, 1000, 1020):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_every_query_has_its_rows(spark):
    # lists that hold few vectors, and only one of them probed at first
    rng = np.random.default_rng(5)
    vectors = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = rows_of(A.search(df, df.where("vec_id % 20 = 0"), A.Params(list_rows=8, recall=0.01, sample=100, least_sample=100)))
    assert len(got) == 20 and all(len(v) == 20 and len({i for i, _ in v}) == 20 for v in got.values())
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert A.search(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], schema)
    got = rows_of(A.search(few, few.where("vec_id = 0")))
    assert got == {0: [(1, 0.5), (2, 0.0)]}
    one = few.where("vec_id = 0")
    assert A.search(one, one).count() == 0
