"""Small cases with known outcomes."""

import subprocess

import pytest
from pyspark.sql import functions as F

from delve.functions import render
from delve.functions import text as T
from delve.operators import extract, graph, history, journal, mapping, metrics, report, selection, verify
from delve.plans.tools import Tools
from delve.sources import files as S
from delve.sources import git as G
from delve.streaming import ledger, windows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,terms", [("UserService", ["user", "service"]), ("HTTPClient.getUser", ["http", "client", "get", "user"]), ("a/b_c.py", ["a", "b", "c", "py"]), ("", []), ("é1", ["1"])])
def test_tokenize(spark, text, terms):
    assert one(spark, T.tokenize(F.col("t")), t=text) == terms


def test_paths(spark):
    assert one(spark, T.module_name(F.lit("src/app/__init__.py"))) == "app"
    assert one(spark, T.module_name(F.lit("app/core/x.py"))) == "app.core.x"
    assert one(spark, F.array(*(T.is_test_path(F.lit(p)) for p in ("tests/a.txt", "a/tests", "test_x.md", "x_test.py", "src/latest.py")))) == [True, False, True, True, False]
    rows = spark.createDataFrame([("a-b.py",), ("a/b.py",)], ["p"])
    assert [r.p for r in rows.orderBy(T.path_parts(F.col("p"))).collect()] == ["a/b.py", "a-b.py"]
    groups = [one(spark, T.gold_group(F.lit(p))) for p in ("src/a.py", "tests/test_a.py", "docs/guide.py", "uv.lock", "x_pb2.py", "a.md", "setup.cfg")]
    assert groups == ["source_python", "test_python", "ignored", "ignored", "ignored", "ignored", "other"]
    assert tuple(one(spark, T.target_parts(F.lit("a.py::B.c")))) == ("a.py", "B.c") and tuple(one(spark, T.target_parts(F.lit("a.py")))) == ("a.py", None)
    assert [one(spark, T.is_safe_path(F.lit(p))) for p in ("a/b", "/a", "../a", "a/../b", "")] == [True, False, False, False, False]


@pytest.mark.parametrize(
    "text,want",
    [("see app/auth/service.py now", "see [PATH] now"), ("use app.auth.service here", "use [PATH] here"), ("plain prose, version 1.2", "plain prose, version 1.2"), ("at https://x.org/a/b.html ok", "at https://x.org/a/b.html ok"), ("from app.auth import x", "from [PATH] import x")],
)
def test_sanitized(spark, text, want):
    assert one(spark, T.sanitized(F.lit(text))) == want


def test_redaction_and_rules(spark):
    assert one(spark, T.redacted(F.lit("Authorization: Bearer abc.def token=xyz sk-12345678901"))) == "Authorization: Bearer [REDACTED] token=[REDACTED] [REDACTED]"
    assert one(spark, T.redacted_map(F.create_map(F.lit("api_key"), F.lit("v"), F.lit("n"), F.lit("w")))) == {"api_key": "[REDACTED]", "n": "w"}
    assert one(spark, T.failure_kind(F.lit("HTTP 429: slow down"))) == "rate_limit"
    assert one(spark, T.cited(F.lit("abc def"), F.array(F.lit("abc"), F.lit("ef")))) and not one(spark, T.cited(F.lit("abc"), F.array(F.lit("x"))))
    assert [one(spark, T.stem(F.lit(w))) for w in ("queries", "classes", "users", "class", "bus")] == ["query", "class", "user", "class", "bus"]
    assert [one(spark, T.retry_delay(F.lit(s), F.lit(a), F.lit(r).cast("int"))) for s, a, r in ((429, 1, None), (503, 2, 10), (500, 1, None), (429, 3, None), (429, 1, 60))] == [1.0, 10.0, None, None, None]


def test_graph(spark):
    e = [("a", "b", False), ("a", "b", False), ("a", "b", True), ("a", "d", True), ("a", None, False), ("b", "c", False), ("c", "a", False), ("e", "e", False)]
    edges = graph.dependency_edges(spark.createDataFrame(e, "src string, dst string, type_only boolean"))
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "runtime"), ("a", "d", "type_only"), ("b", "c", "runtime"), ("c", "a", "runtime")]
    assert {r.dst: r.fan_in for r in graph.fan_in(edges).collect()} == {"b": 1, "c": 1, "a": 1}
    near = lambda start, s, d: sorted((r.node, r.depth) for r in graph.neighbours(edges.where("kind = 'runtime'"), spark.createDataFrame([(start,)], "start string"), 2, s, d).collect())
    assert near("a", "src", "dst") == [("b", 1), ("c", 2)] and near("c", "dst", "src") == [("a", 2), ("b", 1)]
    adjacent = {r.path: r for r in graph.adjacency(edges).collect()}
    assert adjacent["a"].dependencies == ["b"] and adjacent["a"].type_only == ["d"] and adjacent["a"].dependents == ["c"]
    with pytest.raises(ValueError):
        graph.levels(edges.select("src", "dst"), most=5)
    order = spark.createDataFrame([("route", "service"), ("service", "model"), ("a", "z"), ("y", "z"), ("z", "y")], "src string, dst string")
    groups = spark.createDataFrame([(1, x) for x in ("model", "route", "service", "other")] + [(2, x) for x in "azy"], "group int, node string")
    got = {}
    for r in sorted(graph.dependency_order(groups, order).collect(), key=lambda r: r.position):
        got.setdefault(r.group, []).append(r.node)
    assert got[1].index("model") < got[1].index("service") < got[1].index("route") and got[2] == ["y", "z", "a"]


def test_structure(spark):
    edges = spark.createDataFrame([("a", "b", "runtime"), ("c", "a", "runtime"), ("x", "b", "runtime")], "src string, dst string, kind string")
    ranking = spark.createDataFrame([("a", 4.0), ("b", 0.0), ("c", 0.0), ("x", 0.0)], "path string, score double")
    got = {r.path: r.score for r in graph.structural_boost(ranking, edges).collect()}
    assert got == {"a": 4.004, "b": 1.008, "c": 1.0, "x": 0.0}
    partners = spark.createDataFrame([("a", "x", 0.5)], "path string, partner string, support double")
    assert {r.path: r.score for r in graph.history_boost(ranking, partners).collect()}["x"] == 2.0
    near = graph.expansion(edges, spark.createDataFrame([(0, "a")], "seq int, path string")).collect()
    assert [(r.node, r.direction) for r in near] == [("b", "dependency"), ("c", "dependent")]


def test_co_change(spark):
    commits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "b"), (3, "lone")], "seq long, path string")
    got = {(r.path, r.partner): r for r in history.co_change(commits, limit=1).collect()}
    assert got["a", "b"]["count"] == 2 and got["a", "b"].support == 1.0 and got["a", "b"].truncated and ("a", "c") not in got
    assert not any(p == "lone" for p, _ in got)


def test_ranking_metrics(spark):
    cases = [("perfect", ["a", "b"], ["a", "b"]), ("mixed", list("xazqbc"), ["a", "b"]), ("empty", [], ["a"]), ("no gold", ["a"], []), ("ninth", [f"{i}.py" for i in range(12)], ["8.py"])]
    rankings = spark.createDataFrame([(n, r) for n, r, _ in cases], "task string, ranking array<string>")
    gold = spark.createDataFrame([(n, g) for n, _, g in cases], "task string, gold array<string>")
    got = {r.task: r for r in metrics.score_rankings(rankings, gold, ["task"], 3).collect()}
    assert (got["perfect"].precision, got["perfect"].recall, got["perfect"].f1) == (1, 1, 1)
    m = got["mixed"]
    assert (round(m.precision, 6), m.recall, round(m.f1, 6), m.recall_at_5, m.mrr, m.false_positives) == (0.333333, 0.5, 0.4, 1.0, 0.5, 2)
    assert all(got[n][c] == 0 for n in ("empty", "no gold") for c in metrics.METRICS)
    assert got["ninth"].recall_at_5 == 0 and got["ninth"].recall_at_10 == 1 and got["ninth"].mrr == pytest.approx(1 / 9)
    zero = metrics.score_rankings(rankings.withColumn("k", F.lit(0)), gold, ["task"], F.col("k")).collect()
    assert all(r.precision == r.recall == r.false_positives == 0 for r in zero)


def test_bootstraps(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0)], "cluster string, value double")
    r = metrics.cluster_bootstrap(rows, "value", samples=200, seed=7).first()
    assert (r.ci_low, r.ci_high) == (0.0, 1.0) and r.mean == pytest.approx(1 / 3)
    means = spark.createDataFrame([("t1", "a", "x", 0.8), ("t1", "a", "y", 0.2), ("t2", "b", "x", 0.6), ("t2", "b", "y", 0.5), ("t3", "b", "x", 0.9)], "task_id string, cluster string, system string, f1 double")
    p = metrics.paired_bootstrap(means, "x", "y", "f1", samples=100).first()
    assert p.task_count == 2 and p.mean_difference == pytest.approx(0.35) and p.ci_excludes_zero
    found = spark.createDataFrame([("a", True, None), ("a", True, None), ("a", False, "plausible"), ("a", False, "wrong"), ("b", False, "")], "task_id string, hit boolean, label string")
    assert {r.task_id: r.precision for r in metrics.adjudicated_precision(found).collect()} == {"a": 0.75, "b": None}
    predictions = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b")], "run int, position int, path string")
    kept, dropped = metrics.normalised_ranking(predictions, spark.createDataFrame([("a",), ("b",)], "path string"))
    assert sorted((r.path, r.score) for r in kept.collect()) == [("a", 0.5), ("b", 0.25)] and sorted(r.reason for r in dropped.collect()) == ["not_a_source", "repeated"]


def test_selection(spark):
    rows = spark.createDataFrame([(f"{b}{i:02}", f"r{i % 3}", b) for b in ("lo", "mid", "hi") for i in range(9)], "id string, repository string, bucket string")
    got = selection.capped_round_robin(rows, ["lo", "mid", "hi"], target=12, cap=2).collect()
    counts = {}
    for r in got:
        counts[r.repository] = counts.get(r.repository, 0) + 1
    assert len(got) == 6 and max(counts.values()) == 2
    schedule = selection.rotated_schedule(spark.createDataFrame([("b",), ("a",)], "task_id string"), ["p"], list("xyz"), [1, 2]).orderBy("position").collect()
    assert [r.system for r in schedule] == ["p", "x", "y", "z", "y", "z", "x", "p", "y", "z", "x", "z", "x", "y"] and len({r.position for r in schedule}) == 14
    hits = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("t", 3), ("a", 4)], "path string, position int")
    assert [r.path for r in selection.diverse_by_file(hits, 3, F.col("path") == "t").collect()] == ["a", "b", "a"]


def test_verification(spark):
    base = spark.createDataFrame([("same", "1"), ("mod", "2"), ("gone", "3"), ("old", "4")], "path string, content_hash string")
    head = spark.createDataFrame([("same", "1"), ("mod", "9"), ("new", "5"), ("moved", "4")], "path string, content_hash string")
    assert sorted(map(tuple, verify.snapshot_diff(base, head).collect())) == [("A", "new", None), ("D", "gone", "gone"), ("M", "mod", "mod"), ("R", "moved", "old")]
    changes = spark.createDataFrame([(p,) for p in ("core", "near", "z", "friend")], "path string")
    edges = spark.createDataFrame([("near", "core")], "src string, dst string")
    partners = spark.createDataFrame([("core", "friend", 3), ("core", "z", 4)], "path string, partner string, rank int")
    got = {r.path: (r.category, r.reason) for r in verify.classify_changes(changes, spark.createDataFrame([("core",)], "path string"), edges, partners, edges).collect()}
    assert got == {"core": ("expected", "expected"), "near": ("adjacent", "base_graph"), "z": ("unexpected", None), "friend": ("adjacent", "history")}
    predictions = spark.createDataFrame([("core", "high"), ("high", "high"), ("medium", "medium"), ("low", "low")], "path string, confidence string")
    assert sorted(r.path for r in verify.missing_predictions(predictions, changes).collect()) == ["high", "medium"]
    mapped = spark.createDataFrame([("t1", "core"), ("t2", "near"), ("z", "near")], "test_path string, source_path string")
    assert [r.source_path for r in verify.missing_tests(changes, mapped).collect()] == ["core"]
    broken = spark.createDataFrame([("core::f", "core")], "symbol string, path string")
    refs = spark.createDataFrame([("caller", "core::f"), ("near", "core::f"), ("core", "core::f")], "caller string, symbol string")
    assert [tuple(r) for r in verify.stale_callers(broken, refs, changes).collect()] == [("caller", "core::f")]
    folder = spark.createDataFrame([("app/migrations/",)], "path string")
    added = spark.createDataFrame([("app/migrations/__init__.py", "A", 0), ("app/migrations/b.py", "A", 2), ("app/migrations/a.py", "A", 1)], "path string, status string, position int")
    assert verify.migration_match(folder, added).first().file == "app/migrations/a.py"


@pytest.mark.parametrize(
    "old,new,problem",
    [
        ("a, b", "a, b", None), ("a, b", "a", "positional parameter removed, renamed, or reordered"), ("a", "a, b", "required positional parameter added or made mandatory"), ("a", "a, b=1", None), ("a", "z=1, a=2", None),
        ("a=1", "a", "required positional parameter added or made mandatory"), ("*, k=1", "*, q=1", "keyword-only parameter removed or renamed"), ("*, k=1", "*, k", "required keyword-only parameter added or made mandatory"),
        ("*a", "", "variadic positional parameter removed"), ("**k", "", "variadic keyword parameter removed"), ("self, a", "cls, a", None),
    ],
)
def test_signatures(spark, old, new, problem):
    df = spark.createDataFrame([("a.py", f"def f({old}): pass".encode(), f"def f({new}): pass".encode())], "path string, old binary, new binary")
    sides = [extract.signatures(df.select("path", F.col(c).alias("content"))).select("path", F.col("sig").alias(c)) for c in ("old", "new")]
    assert sides[0].join(sides[1], "path").select(verify.signature_problem(F.col("old"), F.col("new")).alias("p")).first().p == problem


def test_cosmetic_and_hunks(spark):
    pairs = [("space", "x = 1", "x  =  1"), ("comment", "x = 1", "x = 1  # c"), ("doc", 'def f():\n    """a"""\n    return 1', "def f():\n    return 1"), ("real", "x = 1", "x = 2"), ("broken", "x = (", "x = (")]
    df = spark.createDataFrame(pairs, "path string, old string, new string")
    assert {r.path: r.cosmetic for r in extract.cosmetic_changes(df).collect()} == {"space": True, "comment": True, "doc": True, "real": False, "broken": False}
    assert G.hunks("@@ -3 +4,0 @@ x\n@@ -1,2 +5,6 @@") == [(3, 1, 4, 0), (1, 2, 5, 6)]
    one_ = spark.createDataFrame([("p", "f", 1, 4), ("p", "g", 6, 9)], "path string, symbol string, first int, last int")
    two = spark.createDataFrame([("p", "f", 1, 4), ("p", "h", 6, 9)], "path string, symbol string, first int, last int")
    hunk = spark.createDataFrame([("p", 4, 1, 5, 0)], "path string, old_start int, old_count int, new_start int, new_count int")
    assert sorted(r.symbol for r in verify.changed_symbols(one_, two, hunk).collect()) == ["f", "g", "h"]


def test_journal(spark):
    import hashlib

    rows, previous = [], journal.START
    for i, p in enumerate(["a", "b", "c", "d"]):
        own = hashlib.sha256(f"{previous}\n{p}".encode()).hexdigest()
        rows.append(("good", i, previous, p, own))
        previous = own
    bad = [("altered", *r[1:3], "x" if r[1] == 1 else r[3], r[4]) for r in rows] + [("broken", r[1], "0" if r[1] == 2 else r[2], *r[3:]) for r in rows] + [("gap", *r[1:]) for r in rows if r[1] != 1] + [("twice", *r[1:]) for r in [*rows, rows[2]]]
    df = spark.createDataFrame(rows + bad, "journal string, sequence long, previous string, payload string, sha256 string")
    found = {}
    for r in journal.check_chain(df).where("problem is not null").collect():
        found.setdefault(r.journal, []).append((r.sequence, r.problem))
    assert found == {"altered": [(1, "altered_event")], "broken": [(2, "broken_link")], "gap": [(2, "sequence_gap")], "twice": [(2, "duplicate_sequence")]}
    events = [("t", None, 0, "started", None), ("t", 1, 1, "reserved", 100), ("t", 1, 2, "observed", 60), ("t", 1, 3, "settled", None), ("t", 2, 4, "reserved", 50), ("t", 2, 5, "settled", None), ("t", None, 6, "completed", None), ("u", 1, 0, "reserved", 9), ("u", 1, 1, "observed", 5), ("u", 1, 2, "observed", 7), ("u", None, 3, "completed", None)]
    got = {r.task: r for r in journal.accounting(spark.createDataFrame(events, "task string, attempt int, sequence int, kind string, tokens long")).collect()}
    assert (got["t"].charged, got["t"].unknown, got["t"].status, got["t"].reason) == (110, 1, "FAILED", "usage_unknown_or_inconsistent") and (got["u"].charged, got["u"].conflicts, got["u"].status) == (7, 1, "FAILED")
    calls = spark.createDataFrame([("r", "k", 1, 5, True), ("r", "k", 2, 3, False), ("r", "k", 3, 9, False), ("r", "j", 4, 1, False)], "run string, key string, seq int, lim int, cut boolean")
    assert {r.seq: r.served_by for r in journal.first_calls(calls, "run", "key", "seq", "lim", "cut").collect()} == {1: None, 2: 1, 3: 2, 4: None}
    asked = spark.createDataFrame([("t", i, f"2024-01-01 00:00:{i:02}", 10) for i in range(6)], "task string, seq int, ts string, tokens int").withColumn("ts", F.to_timestamp("ts"))
    assert [r.decision for r in journal.admission(asked, 45, 100, 3).orderBy("seq").collect()] == ["admitted"] * 3 + ["rate_limit", "token_budget", "token_budget"]


LEDGER = [
    ("a", "suspected", True, True, True, True, None), ("a", "confirmed", True, True, False, True, "strong_evidence_required"), ("a", "rejected", True, True, True, True, None), ("a", "rejected", True, True, True, True, "already_rejected"),
    ("a", "confirmed", True, True, True, True, "invalid_transition"), ("a", "suspected", True, True, True, True, None), ("a", "rejected", True, True, True, True, None), ("a", "suspected", True, True, True, True, "rejection_limit"),
    ("b", "confirmed", True, True, True, True, "invalid_transition"), ("b", "suspected", False, True, True, True, "failed_evidence"), ("b", "suspected", True, False, True, True, "untouched_target"), ("b", "suspected", True, True, True, False, "latest_evidence_required"),
    ("b", "suspected", True, True, False, True, None), ("b", "confirmed", True, True, True, True, None), ("b", "rejected", True, True, True, True, "already_confirmed"), ("", "suspected", True, True, True, True, "invalid_target"),
]


def test_ledger_in_batch_and_as_a_stream(spark, tmp_path):
    rows = [(run, i, *x[:2], *x[2:6]) for run in ("r1", "r2") for i, x in enumerate(LEDGER)]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows], ledger.EVENT)
    batch = sorted(map(tuple, ledger.replay(df).collect()), key=str)
    assert [r[5] for r in sorted((r for r in batch if r[0] == "r1"), key=lambda r: r[1])] == [x[6] for x in LEDGER]
    for k, part in enumerate(("seq < 7", "seq >= 7")):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = windows.run_available(spark, stream, ledger.replay_stream, "append").collect()
    assert sorted(map(tuple, got), key=str) == batch


def test_stream_windows_equal_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    for plan in (windows.tumbling, lambda e: windows.tumbling(e, "1 hour", "30 minutes")):
        assert sorted(map(tuple, windows.run_available(spark, stream, plan).collect())) == sorted(map(tuple, plan(events).collect()))


def test_report(spark):
    claims = spark.createDataFrame([("r", 0, "a", "high", ["e1"]), ("r", 1, "a", "low", ["e1"]), ("r", 2, "b", "high", ["e2"]), ("r", 3, "c", "high", ["e1"]), ("r", 4, "d", "high", ["e3"])], "run string, position int, target string, confidence string, evidence_ids array<string>")
    ledger_ = spark.createDataFrame([("r", t, s) for t, s in (("a", "confirmed"), ("b", "suspected"), ("c", "confirmed"), ("d", "confirmed"), ("e", "confirmed"))], "run string, target string, status string")
    evidence = spark.createDataFrame([("r", "e1", True, ["a"], True), ("r", "e2", True, ["b"], True), ("r", "e3", True, ["d"], False)], "run string, evidence_id string, ok boolean, touched array<string>, strong boolean")
    kept, dropped = report.keep_claims(claims, ledger_, evidence)
    assert sorted((r.target, r.confidence) for r in kept.collect()) == [("a", "high"), ("d", "medium")]
    assert sorted((r.target, r.reason) for r in dropped.collect()) == [("a", "duplicate"), ("b", "unconfirmed"), ("c", "unsupported")]
    checks = spark.createDataFrame([("r", "e", "exists", True), ("r", "c", "touched", False)], "run string, target string, check string, passed boolean")
    assert sorted((r.target, r.confidence, r.refusal) for r in report.retained(ledger_, kept, checks).collect()) == [("c", None, "touched"), ("e", "low", None)]
    seen = spark.createDataFrame([("r", 1, "find_tests", "a", 0), ("r", 2, "find_references", "a", 3), ("r", 3, "find_references", "a", 1), ("r", 4, "get_dependencies", "b", 0), ("r", 5, "find_tests", "b", 0)], "run string, seq int, tool string, target string, high_references int")
    assert {r.target: r.score for r in report.regression_areas(seen).collect()} == {"a": 13, "b": 5}
    items = spark.createDataFrame([("r", 0, False, "x" * 10), ("r", 1, True, "y" * 20), ("r", 2, False, "z" * 3)], "run string, position int, focused boolean, body string")
    assert [r.position for r in report.within_budget(items, 28).collect()] == [1, 2]
    bodies = spark.createDataFrame([(1, '{"a": [1, 2]}'), (2, '{"a":1}'), (3, "no")], "id int, body string")
    assert [r.body for r in report.compacted(bodies).orderBy("id").collect()] == ['{"a":[1,2]}', '{"a":1}', "no"]
    steps = spark.createDataFrame([("r", i, True, i == 0) for i in range(6)], "run string, seq int, tool_call boolean, progress boolean")
    assert [tuple(r) for r in report.stop_reasons(steps, tools=25, idle=4).collect()] == [("r", 4, "no_progress")]


FILES = {
    "app/__init__.py": "",
    "app/models.py": "def deco(f):\n    return f\n\nclass User:\n    def full_name(self):\n        return ''\n\ndef make():\n    return User()\n",
    "app/consumer.py": "from app.models import User, make as build\nimport app.models\n\nclass Admin(User):\n    pass\n\ndef run():\n    u = build()\n    v = app.models.User()\n    return os.getenv('API_KEY', 'x')\n",
    "app/api.py": "from fastapi import FastAPI\nfrom pydantic import BaseModel\napp = FastAPI()\nclass Item(BaseModel):\n    name: str\n@app.delete('/items/{id}')\ndef remove(id: int): ...\nif __name__ == '__main__':\n    pass\n",
    "app/typed.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from app.models import User\nelse:\n    from . import api\n",
    "app/broken.py": "def (\n",
    "tests/test_models.py": "from app.models import make\n\ndef test_make():\n    assert make()\n",
    "tests/consumer_test.py": "def test_x():\n    pass\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for p, text in FILES.items():
        (path / p).parent.mkdir(exist_ok=True)
        (path / p).write_text(text)
    run("add", "-A")
    run("commit", "-qm", "one")
    (path / "app/models.py").write_text(FILES["app/models.py"] + "\nX = 1\n")
    (path / "app/consumer.py").write_text(FILES["app/consumer.py"] + "\nY = 1\n")
    run("commit", "-qam", "two")
    run("mv", "app/api.py", "app/web.py")
    (path / "app/blob.py").write_bytes(b"\0\1")
    run("add", "-A")
    run("commit", "-qm", "three")
    return str(path)


def test_git_sources(spark, repo):
    G.register(spark)
    tree = spark.read.format("git_tree").option("repo", repo).option("rev", "HEAD~2").load()
    assert {r.path: bytes(r.content).decode() for r in tree.collect()} == FILES
    log = spark.read.format("git_log").option("repo", repo).load().collect()
    assert sorted((r.seq, r.path) for r in log if r.seq < 2) == [(0, "app/api.py"), (0, "app/blob.py"), (0, "app/web.py"), (1, "app/consumer.py"), (1, "app/models.py")]
    diff = {r.path: r for r in spark.read.format("git_diff").option("repo", repo).option("base", "HEAD~2").option("head", "HEAD").load().collect()}
    assert {p: (r.status, r.old_path, r.binary) for p, r in diff.items()} == {"app/models.py": ("M", "app/models.py", False), "app/consumer.py": ("M", "app/consumer.py", False), "app/web.py": ("R", "app/api.py", False), "app/blob.py": ("A", None, True)}
    assert [tuple(h) for h in diff["app/models.py"].hunks] == [(9, 0, 10, 2)]


@pytest.fixture(scope="module")
def tools(spark, repo):
    G.register(spark)
    files = spark.read.format("git_tree").option("repo", repo).option("rev", "HEAD~2").load()
    diff = spark.read.format("git_diff").option("repo", repo).option("base", "HEAD~2").option("head", "HEAD").load()
    return Tools(files, spark.read.format("git_log").option("repo", repo).load().select("seq", "path"), diff)


def test_working_tree(spark, repo, tmp_path):
    clone = str(tmp_path / "clone")
    subprocess.run(["git", "clone", "-q", repo, clone], check=True)
    assert not G.state(clone).dirty and G.clean_state(clone).commit == G.state(repo).commit
    (tmp_path / "clone/app/web.py").write_text("z = 1\n")
    (tmp_path / "clone/tests/test_models.py").unlink()
    (tmp_path / "clone/app/link.py").symlink_to("web.py")
    subprocess.run(["git", "-C", clone, "add", "app/link.py"], check=True)
    G.register(spark)
    found = {r.path: r.content and bytes(r.content).decode() for r in spark.read.format("git_tree").option("repo", clone).option("rev", "WORKTREE").option("exclude", "app/sub").load().collect()}
    assert found["app/web.py"] == "z = 1\n" and found["app/link.py"] is None and found["tests/test_models.py"] is None
    assert G.state(clone).dirty and not G.state(clone, exclude="nothing").root.endswith("nothing")
    with pytest.raises(G.DirtyRepository):
        G.clean_state(clone)
    assert G.clean_state(clone, allow_dirty=True).dirty


def test_long_source_is_cut(spark):
    text = "def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(200)) + "\ndef create_app():\n    pass\n\napp = create_app()\n"
    files = spark.createDataFrame([("a/m.py", text.encode()), ("a/__main__.py", b"pass\n"), ("a/migrations/0001.py", b""), ("a/migrations/__init__.py", b"")], "path string, content binary")
    tools = Tools(files)
    found = tools.invoke("inspect_symbol", target="a/m.py::f")
    assert found.truncated and found.data[0]["source"].count("\n") == 119
    assert sorted((r["path"], r["name"]) for r in tools.invoke("repo_facts", kind="entry_points").data) == [("a/__main__.py", "main_module"), ("a/m.py", "app_factory"), ("a/m.py", "app_object")]
    assert [(r["path"], r["name"], r["names"]) for r in tools.invoke("repo_facts", kind="migrations").data] == [("a/migrations", "django", ["a/migrations/0001.py"])]


def test_extraction(tools):
    assert {r.id for r in tools.symbols.collect()} >= {"app/models.py::User", "app/models.py::User.full_name", "app/consumer.py::Admin", "app/api.py::remove"}
    assert {r.path: r.parse_error is not None for r in tools.records.collect()}["app/broken.py"]
    edges = {(r.src, r.dst): r.kind for r in tools.edges.collect()}
    assert edges == {("app/consumer.py", "app/models.py"): "runtime", ("app/typed.py", "app/models.py"): "type_only", ("app/typed.py", "app/api.py"): "runtime", ("tests/test_models.py", "app/models.py"): "runtime"}
    refs = {(r.path, r.name, r.kind): (r.target, r.confidence) for r in tools.references.collect()}
    assert refs["app/consumer.py", "build", "call"] == ("app/models.py::make", "high")
    assert refs["app/consumer.py", "User", "subclass"] == ("app/models.py::User", "high")
    assert refs["app/consumer.py", "app.models.User", "call"] == ("app/models.py::User", "high")
    assert refs["app/consumer.py", "os.getenv", "call"] == (None, "low")


def test_tools(tools):
    r = tools.invoke("search_code", query="user full name", kind="symbol")
    assert r.ok and r.data[0]["symbol"] == "app/models.py::User.full_name" and r.evidence_id == "e1"
    assert tools.invoke("search_code", query=" ").error["code"] == "empty_query" and tools.invoke("search_code", query="zzzz").error["code"] == "no_results"
    assert tools.invoke("search_code", query="user", limit=1).truncated
    assert tools.invoke("nope").error["code"] == "unknown_tool" and tools.invoke("search_code", query="x", limit=99).error["code"] == "invalid_arguments"
    assert tools.invoke("search_code", other=1).error["code"] == "invalid_arguments"
    assert {(d["path"], d["kind"]) for d in tools.invoke("find_references", symbol="make").data} >= {("app/consumer.py", "call"), ("app/consumer.py", "import"), ("tests/test_models.py", "import")}
    assert [d["node"] for d in tools.invoke("get_dependencies", path="app/models.py", direction="imported_by").data] == ["app/consumer.py", "tests/test_models.py"]
    assert tools.invoke("get_dependencies", path="fastapi").error["code"] == "external_module"
    assert tools.invoke("inspect_symbol", target="app/broken.py").error["code"] == "parse_error" and tools.invoke("inspect_symbol", target="../x").error["code"] == "path_outside_repo"
    missing = tools.invoke("inspect_symbol", target="app/model.py").error
    assert missing["code"] == "not_found" and "app/models.py" in missing["hint"]
    assert tools.invoke("find_tests", target="app/models.py").data == [{"test_path": "tests/test_models.py", "reasons": "imports,references,naming"}]
    assert tools.invoke("find_tests", target="app/consumer.py").data == [{"test_path": "tests/consumer_test.py", "reasons": "naming"}]
    assert tools.invoke("repo_facts", kind="route").data[0]["names"] == ["DELETE"] and tools.invoke("repo_facts", kind="setting").data[0]["detail"] == "[REDACTED]"
    assert tools.invoke("repo_facts", kind="model", contains="ITEM").data[0]["names"] == ["name:str"] and tools.invoke("repo_facts", kind="x").error["code"] == "unsupported_kind"
    changed = tools.invoke("co_changed", path="app/models.py", limit=1)
    assert changed.data[0]["partner"] == "app/consumer.py" and changed.data[0]["count"] == 2 and changed.truncated


def test_file_diff_and_source(spark, repo, tools):
    found = tools.invoke("file_diff", path="app/models.py").data[0]
    assert (found["status"], found["new_ranges"], found["old_ranges"]) == ("M", [{"start": 10, "count": 2}], [{"start": 9, "count": 0}])
    assert found["snippets"][0].startswith("@@ -9,0 +10,2 @@") and found["snippets"][0].endswith("+X = 1")
    assert tools.invoke("file_diff", path="app/blob.py").error["code"] == "binary_file" and tools.invoke("file_diff", path="/x").error["code"] == "invalid_arguments"
    assert tools.invoke("file_diff", path="tests/test_models.py").error["code"] == "not_in_diff" and tools.invoke("file_diff", path="no.py").error["code"] == "not_found"
    own = tools.invoke("inspect_symbol", target="tests/test_models.py::test_make").data[0]
    assert own["signature"].startswith("test_make()") and own["source"] == "def test_make():\n    assert make()"


def test_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z", "event": "seed"}\nnot json\n')
    got = S.read_events(spark, str(tmp_path / "t.jsonl")).collect()
    assert [(r.event, r._corrupt_record) for r in got] == [("seed", None), (None, "not json")]
    own = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("../c", b"3")], "path string, content binary")
    listed = own.select("path", F.when(F.col("path") == "b", "x").otherwise(F.sha2("content", 256)).alias("sha256")).unionByName(spark.createDataFrame([("m", "y")], "path string, sha256 string"))
    assert sorted(map(tuple, S.check_manifest(own, listed).collect())) == [("../c", "unsafe"), ("b", "changed"), ("m", "missing")]
    patch = spark.createDataFrame([("t", 'diff --git a/x.py b/y.py\n@@\ndiff --git a/z b/z\ndiff --git a/x.py b/y.py\ndiff --git "a/q" "b/q"')], "task_id string, patch string")
    assert [r.path for r in S.changed_files(patch).orderBy("position").collect()] == ["y.py", "z"]
    cache = S.IndexCache(spark, str(tmp_path / "cache"))
    built = []
    for _ in range(2):
        df = cache.get("files", "c1", lambda: built.append(1) or spark.range(3), S.dirty_digest(own))
    assert df.count() == 3 and len(built) == 1


def test_render(spark):
    df = spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z string")
    assert render.markdown_table(df) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 0.500 | n/a |"
    assert render.replace_between("a<1>x<2>b", "<1>", "<2>", "new") == "a<1>\nnew\n<2>b"
    with pytest.raises(ValueError):
        render.replace_between("a", "<1>", "<2>", "n")


def test_naming_needs_one_source(spark):
    files = spark.createDataFrame([("a/user.py",), ("b/user.py",), ("a/auth.py",), ("tests/test_user.py",), ("tests/test_auth.py",)], "path string")
    assert [tuple(r)[:2] for r in mapping.naming_evidence(files).collect()] == [("tests/test_auth.py", "a/auth.py")]
