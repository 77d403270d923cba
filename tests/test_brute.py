"""Queries that SQL cannot express, against brute force over the whole tables."""

import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from delve.operators import records, selection
from delve.plans import catalogue
from delve.sources import files, stage
from delve.streaming import ledger

D = "/root/testdata/sf0.001"


def rows(spark, table):
    return spark.read.parquet(f"{D}/{table}.parquet").collect()


def test_sanitized_pages(spark):
    rules = [
        (r"(?<![\w/:.-])(?:[\w.-]+/)*[\w-]+\.(?:py|pyi|toml|cfg|ini|json|ya?ml|md|rst|txt)\b", "[PATH]"),
        (r"(?<![\w/:.-])(?:[\w.-]+/){1,}[\w.-]+", "[PATH]"),
        (r"(?<![\w/:.@-])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*){2,}", "[PATH]"),
        (r"\b(from|import)\s+[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", r"\1 [PATH]"),
    ]
    want = {}
    for r in rows(spark, "pages"):
        text = f"{r.url} {r.html}"
        for pattern, new in rules:
            text = re.sub(pattern, new, text, flags=re.A)
        want[r.page_id] = text
    assert {r.page_id: r.text for r in catalogue.QUERIES["sanitized_pages"](spark, D).collect()} == want


def test_dependency_order(spark):
    edges = {(r.src, r.dst) for r in catalogue.QUERIES["dependency_edges"](spark, D).collect()}
    groups = defaultdict(set)
    for pair in edges:
        for n in pair:
            groups[n.split(":")[0]].add(n)
    got = defaultdict(list)
    for r in sorted(catalogue.QUERIES["dependency_order"](spark, D).collect(), key=lambda r: (r.group, r.position)):
        assert r.position == len(got[r.group])
        got[r.group].append(r.node)
    assert {g: set(n) for g, n in got.items()} == groups
    for group, nodes in groups.items():
        needs = {n: {b for a, b in edges if a == n and b in nodes and b != n} for n in nodes}
        reach = {n: set(needs[n]) for n in nodes}
        for k, i in itertools.product(nodes, nodes):
            if k in reach[i]:
                reach[i] |= reach[k]
        done = set()
        for n in got[group]:
            # what comes next lacks nothing, or all lack something and it can reach itself
            assert needs[n] <= done or (n in reach[n] and not any(needs[x] <= done for x in nodes - done)), n
            done.add(n)


def greedy(data, buckets, target, cap):
    queues = {b: sorted((r for r in data if r[2] == b), key=lambda r: (r[1], r[0])) for b in buckets}
    taken, seen = [], defaultdict(int)
    while len(taken) < target and any(queues.values()):
        for b in buckets:
            while queues[b] and len(taken) < target:
                r = queues[b].pop(0)
                if seen[r[1]] < cap:
                    seen[r[1]] += 1
                    taken.append(r[0])
                    break
    return taken


@pytest.mark.parametrize(("target", "cap"), [(40, 5), (7, 1), (1000, 2), (30, 30)])
def test_capped_round_robin(spark, target, cap):
    data = [(r.p_partkey, r.p_brand, "small" if r.p_size < 10 else "middle" if r.p_size < 30 else "large") for r in rows(spark, "part")]
    df = spark.createDataFrame(data, "id long, repository string, bucket string").repartition(3)
    got = [r.id for r in selection.capped_round_robin(df, ["small", "middle", "large"], target, cap).collect()]
    assert got == greedy(data, ["small", "middle", "large"], target, cap)
    if (target, cap) == (40, 5):
        assert [r.id for r in catalogue.QUERIES["capped_round_robin"](spark, D).collect()] == got


def test_ledger_replay(spark):
    states, want = defaultdict(dict), {}
    for r in sorted(rows(spark, "events"), key=lambda r: r.event_id):
        status = "suspected" if r.event_type in ("view", "click") else "rejected" if r.event_type == "error" else "confirmed"
        m = re.search(r"(\d)\}", r.props)
        own = states[str(r.user_id)]
        event = {"target": m[1] if m else "", "status": status, "ok": True, "touches": r.event_id % 11 != 0, "strong": r.value > 2, "latest": True}
        changed, refusal = ledger.step(own, event)
        want[r.event_id] = (event["target"], own.get(event["target"], [None])[0], changed, refusal)
    got = {r.seq: (r.target, r.status, r.changed, r.refusal) for r in catalogue.QUERIES["ledger_replay"](spark, D).collect()}
    assert got == want


def test_numbering_by_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    got = {r.v: r.n for r in stage.numbered(df, "n", "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(i * 7919 % 5003 for i in range(5000)))}
    assert stage.numbered(df.limit(0), "n", "v").count() == 0


def test_trace_sink_redacts_and_lines_are_numbered(spark, tmp_path):
    path = str(tmp_path / "trace")
    events = spark.createDataFrame([("2024-01-01T00:00:00Z", "call", {"api_key": "x", "q": "Bearer abc"})], "timestamp string, event string, payload map<string,string>")
    for _ in range(2):
        files.write_events(events, path)
    got = files.read_events(spark, path).collect()
    assert [(r.event, r.line) for r in got] == [("call", 1)] * 2 and all("abc" not in r.payload and '"x"' not in r.payload for r in got)
    (tmp_path / "t.jsonl").write_text('{"event": "a"}\n{"event": "b"}\nbad\n')
    assert [(r.event, r.line, r._corrupt_record) for r in files.read_events(spark, str(tmp_path / "t.jsonl")).orderBy("line").collect()] == [("a", 1, None), ("b", 2, None), (None, 3, "bad")]


def test_same_rows(spark):
    a, b = spark.range(3), spark.range(3).repartition(2)
    assert records.same_rows(a, b) and not records.same_rows(a, a.union(a))
