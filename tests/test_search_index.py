import pytest
from pyspark.sql import functions as F

from delve.operators import renames, search, search_index


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i % 7} common CamelCase{i % 11} " * (1 + i % 5) + "tail " * (i % 13), "even" if i % 2 == 0 else "odd") for i in range(600)]
    rows += [(1000, None, "even"), (1001, "", "odd"), (1002, "rareThing common", None), (1003, "rareThing common", "odd")]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


@pytest.fixture(scope="module")
def index(docs):
    return search_index.build(docs, by="kind", keep=("kind",))


QUERIES = ["rare thing", "common", "word3 camel case5 tail tail", "nothing here", "", "common common rare"]


@pytest.mark.parametrize("kind", [None, "even"])
@pytest.mark.parametrize("k", [1, 7, 2000])
def test_the_index_finds_what_a_scan_finds(spark, docs, index, kind, k):
    own = docs if kind is None else docs.where(F.col("kind") == kind)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "q int, text string")
    got = search_index.search(index, queries, k, kind).hits.orderBy("q", "rank").collect()
    for q, text in enumerate(QUERIES):
        want = search.top(search.bm25_scores(own, text), k, F.col("doc_id")).collect()
        rows = [(-r.score, r.key, r.truncated) for r in got if r.q == q]
        assert sorted(rows) == sorted((-r.score, r.doc_id, r.truncated) for r in want) and [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_blocks_that_cannot_reach_the_bar_stay_closed(spark, docs, index):
    found = search_index.search(index, spark.createDataFrame([(0, "rare thing common")], "q int, text string"), 1)
    assert [r.key for r in found.hits.collect()] == [1002]
    opened, bounds = found.opened.count(), found.bounds.count()
    assert opened <= search_index.FIRST + 2 and bounds > 2 * opened


def test_an_index_may_be_opened_again(spark, docs, tmp_path):
    search_index.build(docs, path=str(tmp_path / "ix"), by="kind")
    again = search_index.SearchIndex(spark, str(tmp_path / "ix"))
    assert [r.key for r in search_index.search(again, spark.createDataFrame([("a", "rareThing")], "q string, text string"), 5).hits.orderBy("rank").collect()] == [1002, 1003]
    plan = again.blocks.where("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_an_empty_corpus(spark, docs):
    index = search_index.build(docs.limit(0))
    assert search_index.search(index, spark.createDataFrame([(0, "common")], "q int, text string")).hits.collect() == []


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "terms array<string>")
    assert [[tuple(x) for x in r.c] for r in search_index.term_counts(df, "terms", "c").collect()] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


def brute_renames(base, head, threshold=0.5):
    def lines(text):
        out = {}
        for x in (text or "").split("\n"):
            out[x] = out.get(x, 0) + len(x.encode()) + 1
        return out

    gone = {p: t for p, t in base.items() if p not in head}
    new = {p: t for p, t in head.items() if p not in base}
    pairs = []
    for a in sorted(gone):
        for b in sorted(new):
            if (gone[a] or "") == (new[b] or "") and b not in [y for _, y, _ in pairs] and a not in [x for x, _, _ in pairs]:
                pairs.append((a, b, 1.0))
    left = []
    for a, old in gone.items():
        for b, now in new.items():
            x, y = lines(old), lines(now)
            shared, size = sum(min(n, y.get(k, 0)) for k, n in x.items()), max(sum(x.values()), sum(y.values()))
            if shared >= threshold * size:
                left.append((-shared / size, a.split("/")[-1] != b.split("/")[-1], a, b))
    for s, _, a, b in sorted(left):
        if a not in [x for x, _, _ in pairs] and b not in [y for _, y, _ in pairs]:
            pairs.append((a, b, round(-s, 6)))
    return sorted(pairs)


def test_renames_by_similarity(spark):
    import random

    rng = random.Random(4)
    pool = [f"line {i} of the file" for i in range(40)] + ["", "}", "return"]
    text = lambda: "\n".join(rng.choices(pool, k=rng.randint(1, 12)))
    base = {f"src/f{i}.py": text() for i in range(25)} | {"src/none.py": None, "src/same.py": "x\ny", "src/kept.py": "k", "big.txt": "only\n" * 500}
    head = {f"lib/f{i}.py": (base[f"src/f{i}.py"] + "\n" + text()) if i % 3 else text() for i in range(25)} | {"lib/empty.py": "", "lib/same.py": "x\ny", "src/kept.py": "k2", "big2.txt": "only\n" * 400}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    rows = renames.renamed(frame(base), frame(head)).collect()
    assert sorted((r.old_path, r.path, r.similarity) for r in rows if r.status == "R") == brute_renames(base, head)
    assert {(r.status, r.path) for r in rows if r.status == "M"} == {("M", "src/kept.py")}
    paired = {r.old_path for r in rows if r.status == "R"} | {r.path for r in rows if r.status == "R"}
    assert {r.path for r in rows if r.status in "AD"} == (set(base) ^ set(head)) - paired


def test_greedy_pairs_take_each_side_once(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.6), ("c", "y", 0.7), ("c", "z", 0.5)], "from string, to string, similarity double")
    got = renames.greedy_pairs(pairs, -F.col("similarity")).select("from", "to").collect()
    assert sorted(map(tuple, got)) == [("a", "x"), ("c", "y")]
