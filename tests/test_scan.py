import random

import pytest
from pyspark.sql import functions as F

from delve.operators import journal, scan
from delve.streaming import ledger


def rows_of(rng, keys, n):
    return [(rng.choice(keys), i, rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("keys", [["hot"], ["a", "b", None], [f"k{i}" for i in range(50)], ["hot"] * 9 + ["x", "y"]])
def test_automaton_finds_each_state(spark, keys):
    rng = random.Random(len(keys))
    table = [[rng.randrange(4) for _ in range(3)] for _ in range(4)]
    rows = rows_of(rng, keys, 3000)
    state, want = {}, {}
    for key, i, symbol in rows:
        want[i] = state.get(key, 2)
        if symbol is not None:
            state[key] = table[want[i]][symbol]
        else:
            state[key] = want[i]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    df = spark.createDataFrame(rows, "key string, at long, symbol int").repartition(5)
    got = {r.at: r.before for r in scan.automaton(df, ["key"], ["at"], F.col("symbol"), table, 2).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_previous_is_lag(spark):
    rng = random.Random(1)
    rows = rows_of(rng, ["hot"] * 8 + [None, "x"], 2000)
    df = spark.createDataFrame(rows, "key string, at long, symbol int").repartition(5)
    last, want = {}, {}
    for key, i, symbol in rows:
        want[i] = last.get(key, (None, None))
        last[key] = (i, symbol)
    got = {r.at: (r.previous_at, r.previous_symbol) for r in scan.previous(df, ["key"], ["at"], ["at", "symbol"]).collect()}
    assert got == want
    assert scan.previous(df.limit(0), ["key"], ["at"], ["at"]).collect() == [] and scan.automaton(df.limit(0), ["key"], ["at"], F.col("symbol"), [[0, 0, 0]]).collect() == []


def test_ledger_by_scan_is_the_fold(spark):
    rng = random.Random(6)
    yes = lambda p: rng.choice([None, False]) if rng.random() > p else True
    events = [(rng.choice(["hot", "hot", "hot", "r1", None]), i, rng.choice([None, ""] + [f"t{k}" for k in range(40)] * 3), rng.choice(["suspected", "suspected", "rejected", "confirmed", "odd", None]), yes(0.9), yes(0.9), yes(0.6), yes(0.95)) for i in range(4000)]
    names = ["run", "seq", "target", "status", "ok", "touches", "strong", "latest"]
    states, want = {}, {}
    for e in events:
        row = dict(zip(names, e, strict=True))
        state = states.setdefault(row["run"], {})
        changed, refusal = ledger.step(state, row)
        want[row["seq"]] = (state.get(row["target"], [None])[0], changed, refusal)
    got = ledger.replay(spark.createDataFrame(events, ledger.EVENT).repartition(7)).collect()
    assert {r.seq: (r.status, r.changed, r.refusal) for r in got} == want and len(got) == len(events)
    assert {x[2] for x in want.values()} >= {"candidate_cap", "rejection_limit", "already_confirmed", "strong_evidence_required"}


def test_one_log_of_many_records(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("one").alias("journal"), F.col("id").alias("sequence"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"))
    chain = journal.chained(rows)
    assert chain.where("sequence = 0").first().previous == journal.START
    altered = chain.withColumn("payload", F.when(F.col("sequence") == 150_000, "x").otherwise(F.col("payload"))).where("sequence <> 77777")
    got = journal.check_chain(altered).where("problem is not null").orderBy("sequence").collect()
    assert [(r.sequence, r.problem) for r in got] == [(77_778, "sequence_gap"), (150_000, "altered_event")]


def test_one_automaton_of_a_million_events(spark):
    rows = spark.range(1_000_000).select(F.lit("run").alias("run"), F.col("id").alias("seq"), (F.col("id") % 3).alias("symbol"))
    got = scan.automaton(rows, ["run"], ["seq"], F.when(F.col("symbol") < 2, 0), [[1], [2], [3], [0]]).agg(F.sum("before").alias("s"), F.count_if(F.col("before") != F.expr("(seq div 3 * 2 + least(seq % 3, 2)) % 4")).alias("wrong")).first()
    assert got.wrong == 0
