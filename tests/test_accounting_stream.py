import datetime
import random

import pytest
from pyspark.sql import functions as F

from delve.plans import corpus_queries
from delve.streaming import accounting as A
from delve.streaming import windows

KINDS = ["started", "request", "reserved", "observed", "metadata", "settled", "unknown", "response", "stopped", "finished"]
AT = datetime.datetime(2024, 1, 1)


def random_events(rng, n, tasks):
    out = []
    for i in range(n):
        kind = rng.choice(KINDS[:8] * 4 + KINDS[8:])
        attempt = rng.randint(1, 4) if kind in ("reserved", "observed", "metadata", "settled", "unknown") else None
        tokens = rng.choice([5, 5, 5, 5, 9, None]) if kind in A.USAGE else rng.randint(1, 20) if kind in ("started", "reserved") else None
        reason = rng.choice(["token_limit", "execution_interrupted", "odd", None]) if kind == "stopped" else None
        out.append((rng.choice(tasks), attempt, i, kind, tokens, reason, rng.choice([None, True, True, True, False]), rng.choice([None, True, True, False]), AT + datetime.timedelta(seconds=i)))
    return out


def brute(events):
    tasks = {}
    for task, attempt, sequence, kind, tokens, reason, consistent, complete, _ in events:
        t = tasks.setdefault(task, {"n": 0, "allocation": None, "open": 0, "end": None, "attempts": {}})
        t["n"] += 1
        t["open"] += (kind == "request") - (kind == "response")
        if kind == "started":
            t["allocation"] = max(t["allocation"] or 0, tokens)
        if kind in A.ENDS:
            t["end"] = max(t["end"] or (-1,), (sequence, kind, reason))
        if attempt is not None:
            a = t["attempts"].setdefault(attempt, {"reserved": 0, "seen": set(), "doubt": False, "settled": 0})
            good = tokens is not None and consistent is not False
            a["reserved"] = max(a["reserved"], tokens) if kind == "reserved" else a["reserved"]
            a["seen"] |= {tokens} if kind in A.USAGE and good else set()
            a["doubt"] |= kind == "unknown" or kind in A.USAGE and (not good or kind == "settled" and complete is False)
            a["settled"] += kind == "settled"
    out = []
    for task, t in tasks.items():
        own = t["attempts"].values()
        charged = sum(max(a["seen"]) if a["settled"] and not a["doubt"] and len(a["seen"]) == 1 else max([a["reserved"], *a["seen"]]) for a in own)
        conflicts, doubt, unresolved = sum(len(a["seen"]) > 1 for a in own), sum(a["doubt"] or not a["seen"] for a in own), sum(not a["settled"] for a in own)
        _, kind, why = t["end"] or (0, None, None)
        done = kind == "finished"
        if conflicts:
            status, reason = "FAILED", "usage_observation_mismatch"
        elif done and (unresolved or doubt or t["open"]):
            status, reason = "FAILED", "unsettled_attempts" if unresolved else "usage_unknown_or_inconsistent" if doubt else "unanswered_request"
        elif done:
            status, reason = "COMPLETED", "task_finished"
        else:
            status, reason = "UNFINISHED" if kind is None else "CENSORED" if why == "token_limit" else "INTERRUPTED" if why == "execution_interrupted" else "FAILED", why
        sums = (len(own), sum(a["reserved"] for a in own), sum(max(a["seen"], default=0) for a in own), charged, conflicts, doubt, unresolved, sum(a["settled"] > 1 for a in own))
        out.append((task, t["n"], t["allocation"], *sums, t["open"], t["allocation"] is not None and charged > t["allocation"], status, reason))
    return sorted(out, key=repr)


def streamed(spark, tmp_path, batches, **more):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, A.EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(A.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    source = source.withWatermark("at", "0 seconds") if "patience" in more else source
    return windows.run_available(spark, source, lambda e: A.accounts_stream(e, **more), "update")


def test_batch_is_the_plain_fold(spark):
    events = random_events(random.Random(2), 1500, [1, 2, 3, *range(10, 60)])
    got = A.accounts(spark.createDataFrame(events, A.EVENT).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(events)
    assert {r.status for r in got} >= {"FAILED", "UNFINISHED", "CENSORED"} and A.accounts(spark.createDataFrame([], A.EVENT)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_batch_whatever_the_micro_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = random_events(rng, 300, [1, 2, *range(10, 20)])
    mixed = rng.sample(events, len(events))
    got = A.latest(streamed(spark, tmp_path, [mixed[:1], mixed[1:120], mixed[120:]]))
    assert sorted(map(tuple, got.drop("expired").collect()), key=repr) == brute(events)


def test_stream_goes_on_from_a_first_batch(spark, tmp_path):
    events = random_events(random.Random(5), 200, [1, 2, 3])
    before = A.attempt_states(spark.createDataFrame(events[:120], A.EVENT))
    got = A.latest(streamed(spark, tmp_path, [events[120:160], events[160:]], before=before))
    assert sorted(map(tuple, got.drop("expired").collect()), key=repr) == brute(events)


def test_attempts_that_are_never_settled_are_told(spark, tmp_path):
    at = lambda s: AT + datetime.timedelta(seconds=s)
    rows = [[(1, 1, 0, "reserved", 10, None, None, None, at(0)), (2, 1, 1, "reserved", 7, None, None, None, at(0))], [(2, 1, 2, "settled", 7, None, None, None, at(5))], [(3, None, 3, "started", 50, None, None, None, at(500))], [(3, None, 4, "request", None, None, None, None, at(900))]]
    told = streamed(spark, tmp_path, rows, patience=60_000).where("expired").collect()
    assert [(r.task, r.unresolved, r.charged) for r in told] == [(1, 1, 10)]


def test_attempts_as_a_stream_make_the_accounts(spark, tmp_path, monkeypatch):
    """Whatever the micro-batches; and the query over all events calls no Python for a task, as it did before."""
    events = random_events(random.Random(7), 300, [1, 2, *range(10, 20)])
    random.Random(8).shuffle(events)
    for i, rows in enumerate([events[:1], events[1:120], events[120:]]):
        spark.createDataFrame(rows, A.EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(A.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    told = windows.run_available(spark, source, A.attempts_stream, "update")
    got = A.accounts_of(A.latest(told, "task", "attempt"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(events) and told.count() > A.latest(told, "task", "attempt").count()
    plans = []
    run = windows.run_available
    monkeypatch.setattr(windows, "run_available", lambda s, source, plan, mode: plans.append(plan(source)) or run(s, source, plan, mode))
    assert corpus_queries.accounts_stream(spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 1 and plans[0].isStreaming and "InPandas" not in plans[0]._jdf.queryExecution().logical().toString()
