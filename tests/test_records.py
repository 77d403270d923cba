import hashlib

import pytest
from pyspark.sql import functions as F

from delve.operators import records as R


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_ingest(spark):
    rows = df(spark, [("t1", "r", 1, "b1"), ("t2", "r", 2, "b2"), ("t3", "r", 3, "b3"), ("t4", "r", 4, "b4")], "task_id string, repository string, number int, base string")
    pulls = df(spark, [("r", 1, "b1", True, "2024-05-01"), ("r", 2, "x", True, "2024-05-01"), ("r", 3, "b3", False, None)], "repository string, number int, base_sha string, merged boolean, merged_at string")
    tasks, bad = R.ingest_tasks(rows, pulls)
    assert [r.task_id for r in tasks.collect()] == ["t1"]
    assert {r.task_id: r.reason for r in bad.collect()} == {"t2": "base_differs", "t3": "not_merged", "t4": "no_pull_request"}
    assert R.without(rows, df(spark, [("t1",)], "task_id string")).count() == 3
    with pytest.raises(ValueError):
        R.recent_set(tasks, "2024-01-01")
    assert R.recent_set(tasks, "2024-01-01", least=1).count() == 1 and R.field_gates(tasks, {"base": "b1", "number": 2, "nope": 1}).count() == 2


def test_reports_and_leaks(spark):
    reports = df(spark, [("a", 1), ("b", 2)], "path string, mtime long")
    assert R.latest_report(reports).first().path == "b"
    with pytest.raises(ValueError):
        R.latest_report(reports.union(df(spark, [("c", 2)], reports.schema)))
    repos = df(spark, [("t", "h", "h", False, 0, "change new_mod.py please"), ("u", "h", "x", True, 1, "")], "task_id string, head string, expected_head string, dirty boolean, refs int, request string")
    gold = df(spark, [("t", "new_mod.py"), ("t", "old.py")], "task_id string, path string")
    base = df(spark, [("t", "old.py")], "task_id string, path string")
    assert {(r.task_id, r.check) for r in R.leak_checks(repos, gold, base).where("not passed").collect()} == {("t", "request"), ("u", "head"), ("u", "clean"), ("u", "refs")}
    sources = df(spark, [("t", "a.py", "def fresh_name(): fresh"), ("t", "b.py", "x")], "task_id string, path string, text string")
    assert got(R.symbol_leaks(sources, df(spark, [("t", "fresh_name"), ("t", "fre")], "task_id string, name string"))) == [("t", "fresh_name", "a.py")]
    changed = df(spark, [("t", "b"), ("t", "a"), ("t", "a")], "task_id string, symbol string")
    assert R.symbol_gold(changed, df(spark, [("t",)] * 2, "task_id string"), 2).first().symbols == ["a", "b"]
    with pytest.raises(ValueError):
        R.symbol_gold(changed, df(spark, [("t",)], "task_id string"), 2)


def test_dedupe(spark):
    rows = df(spark, [("k", 2, "b"), ("k", 1, "a"), ("j", 3, "c")], "k string, n int, v string")
    assert got(R.first_wins(rows, ["k"], "n")) == [("j", 3, "c"), ("k", 1, "a")] and got(R.last_wins(rows, ["k"], "n")) == [("j", 3, "c"), ("k", 2, "b")]
    assert {r.n: r.detail for r in R.recent_and_older(rows, "k", "n", 1).collect()} == {2: "full", 1: "summary", 3: "full"}
    assert R.same_rows(rows, rows) and not R.same_rows(rows, rows.union(rows.limit(1)))


def test_aggregates(spark):
    scores = df(spark, [("p", 1, 1, 0), ("p", 1, 0, 2), ("q", 0, 0, 0)], "policy string, tp int, fp int, fn int")
    assert got(R.pooled_scores(scores, ["policy"])) == [("p", 2, 1, 2, 0.6667, 0.5, 0.5714), ("q", 0, 0, 0, 0.0, 0.0, 0.0)]
    runs = df(spark, [("a", 1.0, False), ("a", None, None), ("a", 9.0, True)], "v string, x double, provider_failure boolean")
    assert got(R.protocol_means(runs, "v", ["x"])) == [("a", 2, 1.0)]
    files = df(spark, [("app/migrations/0001.py",), ("app/migrations/__init__.py",), ("alembic/versions/a.py",), ("x.py",)], "path string")
    assert got(R.migration_groups(files)) == [("alembic", "alembic/versions", ["alembic/versions/a.py"]), ("django", "app/migrations", ["app/migrations/0001.py"])]
    parsed = df(spark, [("a/b/c.py", None), ("a/b/d.py", "bad"), ("x.py", None)], "path string, parse_error string")
    hubs = df(spark, [("x.py", 2), ("y.py", 2)], "dst string, fan_in long")
    imports = df(spark, [(None, "os.path"), (None, "os"), ("x.py", "x")], "dst string, module string")
    m = R.repository_map(parsed, hubs, imports)
    assert got(m) == [("broken", 1, "a/b/d.py", 1), ("folders", 1, ".", 1), ("folders", 2, "a/b", 2), ("hubs", 1, "y.py", 2), ("hubs", 2, "x.py", 2), ("outside", 1, "os", 2)]
    assert R.map_text(m).startswith("broken: a/b/d.py (1)\nfolders") and len(R.map_text(m, 9)) == 9
    assert got(R.workload(df(spark, [("tokens", 100.0, 4)], "metric string, value double, runs int"), 2, 3, 1)) == [("tokens", 25.0, 150.0)]
    assert got(R.request_maxima(df(spark, [("s", 1, 5), ("s", 2, 9), ("s", 3, 8)], "scenario string, seq int, bytes int"), 7)) == [("s", 9, 2)]
    calls = df(spark, [("r", 1, 5), ("r", 2, 6), ("r", 3, None), ("r", 4, 1)], "run string, seq int, tokens int")
    assert [(r.used, r.blocked) for r in R.token_ceiling(calls, 100).orderBy("seq").collect()] == [(0, False), (5, False), (11, False), (11, True)]
    keeps = df(spark, [("r", i, "t", "keep") for i in range(4)], "run string, seq int, target string, decision string")
    assert [r.retired for r in R.review_keeps(keeps).orderBy("seq").collect()] == [False, False, True, True]


def test_anomalies_and_facts(spark):
    changes = df(spark, [("t", "a.py"), ("t", "test_a.py"), ("u", "b.py")], "task_id string, path string")
    rows = R.plant_anomalies(changes, df(spark, [("t", "test_a.py")], "task_id string, path string"))
    assert got(rows.where("variant = 'drop_tests'")) == [("drop_tests", "t", "a.py", True), ("drop_tests", "u", "b.py", False)]
    assert rows.where("variant = 'unrelated'").count() == 5
    assert got(R.oracle_predictions(changes, df(spark, [("t", "a.py")], "task_id string, path string"))) == [("t", "a.py", "high")]
    a, b = df(spark, [("x", "expected")], "path string, category string"), df(spark, [("x", "adjacent")], "path string, category string")
    assert R.verdicts_only(a, a).count() == 0 and {r.change for r in R.verdicts_only(a, b).collect()} == {"lost", "added"}
    facts = df(spark, [(1, "app/api/x.py", None, "app/api/x.py::f"), (2, "y.py", "y.py::M", None), (3, "z.py", None, None)], "fact_id int, path string, symbol_id string, handler string")
    targets = df(spark, [("app/api",), ("y.py::M",), ("app/api/x.py::f",)], "target string")
    assert got(R.fact_claims(facts, targets)) == [("app/api", 1), ("app/api/x.py::f", 1), ("y.py::M", 2)]
    one = spark.range(1)
    assert one.select(R.touched(F.array(F.lit("a")), F.array(F.lit("b::c"))).alias("x")).first().x == ["a", "b::c", "b"]
    assert one.select(R.evidence_line(F.lit("find_tests"), F.lit(True), F.lit("a"), F.lit(2)).alias("x")).first().x == "find_tests a: 2 tests"
    assert tuple(one.select(R.usage(F.lit('{"input_tokens": 1, "output_tokens": 2, "total_tokens": 3, "x": 9}')).alias("x")).first().x) == (1, 2, 3, True)


def test_identities(spark):
    files = df(spark, [("r", "b", "2"), ("r", "a", "1")], "repo string, path string, sha256 string")
    assert R.source_identity(files, "repo").first().identity == hashlib.sha256(b"1 a\n2 b").hexdigest()
    rows = df(spark, [(1, '{"b": 1, "a": "é"}'), (2, "no"), (3, None)], "id int, body string")
    out = {r.id: r for r in R.canonical_json(rows, "body").collect()}
    assert out[1].canonical == '{"a":"\\u00e9","b":1}' and out[1].sha256 == hashlib.sha256(out[1].canonical.encode()).hexdigest()
    assert out[2].canonical is None and out[2].ascii_bytes == 4 and out[3].ascii_bytes is None
    stored = df(spark, [("a", hashlib.sha256(b"s").hexdigest()), ("b", "x"), ("c", "y")], "task string, sha256 string")
    assert got(R.terminal_evidence(stored, df(spark, [("a", "s"), ("b", "s")], "task string, summary string"))) == [("b", "hash_differs"), ("c", "missing")]


def test_views(spark):
    cards = df(spark, [("b", "expected"), ("a", "expected"), ("c", "missing_test")], "path string, category string")
    assert [r.path for r in R.finding_cards(cards).collect()] == ["c", "a", "b"]
    own = df(spark, [("r", "b", "confirmed"), ("r", "a", "confirmed"), ("r", "c", "rejected")], "run string, target string, status string")
    assert got(R.ledger_columns(own)) == [("r", [], ["a", "b"], ["c"])]
    trace = df(spark, [("r", "tool", True, True), ("r", "tool", False, False), ("r", "model", True, True)], "run string, event string, ok boolean, target_valid boolean")
    assert got(R.run_record(trace)) == [("r", 2, 1, 1, 1)]
    symbols = df(spark, [("r", "b.py", 1, "f"), ("r", "a.py", 9, "g"), ("r", "a.py", 2, "h")], "repo string, path string, first int, qualname string")
    assert R.outline(symbols, "repo").first().outline == "a.py:2:h\na.py:9:g\nb.py:1:f"
    assert got(R.headline(df(spark, [("t", "b", 0.1), ("t", "a", 0.1), ("t", "c", 0.5)], "task_id string, system string, recall double"))) == [("t", "a", 0.1)]
