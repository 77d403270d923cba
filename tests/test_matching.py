"""Requests and responses: the stream's rows equal the batch's, and late rows are counted."""

import datetime as dt

import pytest

from delve.operators import report
from delve.streaming.matching import closing_stream, matched, run_matched

T0 = dt.datetime(2024, 1, 1)
REQUESTS, RESPONSES = "run_id long, kind string, at timestamp", "run_id long, status string, at timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


ASKED = [(i, "even" if i % 2 == 0 else "odd", at(i)) for i in range(60)] + [(None, "none", at(3)), (7, "timeless", None)]
#: Every third in time, every fifth too late for its request, one before it, one on the last instant, two of one request.
ANSWERED = [(i, "ok", at(i + 5)) for i in range(0, 60, 3)] + [(i, "slow", at(i + 90)) for i in range(1, 60, 5)]
ANSWERED += [(2, "early", at(1)), (8, "edge", at(8 + 30)), (12, "again", at(20)), (None, "none", at(4)), (5, "timeless", None)]


def written(spark, folder, rows, schema, parts):
    """The rows as files of a stream, one a part of their order in time."""
    rows = sorted(rows, key=lambda r: r[2] or T0)
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def seen(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_batch(spark, tmp_path, parts):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    written(spark, a, ASKED, REQUESTS, parts)
    written(spark, b, ANSWERED, RESPONSES, parts)
    requests, responses = spark.createDataFrame(ASKED, REQUESTS), spark.createDataFrame(ANSWERED, RESPONSES)
    want = matched(requests, responses, "30 minutes")
    # the last files close the streams
    for folder, like in ((a, requests), (b, responses)):
        spark.createDataFrame([(-1, None, dt.datetime(9999, 1, 1))], like.schema).coalesce(1).write.mode("append").parquet(folder)
    got, late = run_matched(spark, lambda: matched(stream(spark, a, REQUESTS), stream(spark, b, RESPONSES), "30 minutes"))
    assert seen(got) == seen(want) and late == 0
    brute = []
    for i, kind, t in ASKED:
        if i is None or t is None:
            continue
        own = [s for j, s, u in ANSWERED if j == i and u is not None and t <= u <= t + dt.timedelta(minutes=30)]
        brute += [(i, kind, s) for s in own or [None]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute))
    once = spark.createDataFrame([r for r in ANSWERED if r[1] == "ok"], RESPONSES)
    only = matched(requests.where("run_id is not null and at is not null"), once, "30 minutes").groupBy("kind", "status").count()
    held = report.reconcile(requests.where("run_id is not null and at is not null").select("run_id", "kind"), once.select("run_id", "status"))
    assert {(r.kind, r.status or "missing", r["count"]) for r in only.collect()} == {tuple(r) for r in held.collect()}


def test_a_stream_that_goes_on_counts_what_comes_late(spark, tmp_path):
    a, b, folder = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/out"
    plan = lambda: matched(stream(spark, a, REQUESTS), stream(spark, b, RESPONSES), "30 minutes", "10 minutes")
    written(spark, a, [(1, "x", at(0)), (2, "x", at(300))], REQUESTS, 1)
    written(spark, b, [(2, "ok", at(301))], RESPONSES, 1)
    got, late = run_matched(spark, plan, folder)
    assert seen(got) == ["Row(run_id=1, kind='x', status=None)", "Row(run_id=2, kind='x', status='ok')"] and late == 0
    written(spark, b, [(1, "late", at(5)), (2, "more", at(302))], RESPONSES, 1)
    got, late = run_matched(spark, plan, folder)
    assert late == 1 and seen(got) == ["Row(run_id=1, kind='x', status=None)", "Row(run_id=2, kind='x', status='more')", "Row(run_id=2, kind='x', status='ok')"]


def test_streams_without_rows_and_a_closing_row(spark, tmp_path):
    none = spark.createDataFrame([], REQUESTS)
    some = spark.createDataFrame([(1, "ok", at(0))], RESPONSES)
    assert matched(none, some).count() == 0
    ends = closing_stream(none), closing_stream(some)
    got, late = run_matched(spark, lambda: matched(*ends))
    assert got.count() == 0 and late == 0
