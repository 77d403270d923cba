"""Append-only logs: hash chains, rate windows, accounting, repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delve.operators.scan import key_at, key_starts, previous

START = "0" * 64


def record_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("\n"), payload), 256)


def chained(records: DataFrame, by: str = "journal") -> DataFrame:
    """records (by, sequence, payload) with previous and sha256, each log in order of sequence; null payloads count as empty.

    A hash needs the one before, so a log is one task's from first to last; it goes by in sorted batches and none of it is held but the last hash.
    """
    kind = records.schema[by].dataType.simpleString()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, START
        for batch in batches:
            if not batch.num_rows:
                continue
            previous, hashes = [], []
            for new, payload in zip(key_starts(batch, [by], key).tolist(), batch.column("payload").to_pylist(), strict=True):
                if new:
                    last = START
                previous.append(last)
                last = hashlib.sha256(f"{last}\n{payload}".encode()).hexdigest()
                hashes.append(last)
            key = key_at(batch, [by], batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(hashes, pa.string())], [*batch.schema.names, "previous", "sha256"])

    rows = records.select(by, F.col("sequence").cast("long"), F.coalesce("payload", F.lit("")).alias("payload"))
    return rows.repartition(by).sortWithinPartitions(by, "sequence").mapInArrow(link, f"{by} {kind}, sequence long, payload string, previous string, sha256 string")


def check_chain(records: DataFrame, by: str = "journal") -> DataFrame:
    """records (by, sequence, previous, payload, sha256) with problem: sequence_gap, duplicate_sequence, broken_link, altered_event or null; the first that holds."""
    # the row before is looked up by ranges of the order, so a long log is checked by many tasks
    own = previous(records.withColumnRenamed("previous", "_named"), [by], ["sequence", "sha256"], ["sha256", "sequence"])
    before, number = F.col("previous_sha256"), F.col("previous_sequence")
    problem = (
        F.when(F.col("sequence") == number, "duplicate_sequence")
        .when(F.col("sequence") != F.coalesce(number + 1, F.lit(0)), "sequence_gap")
        .when(F.col("_named") != F.coalesce(before, F.lit(START)), "broken_link")
        .when(F.col("sha256") != record_hash(F.col("_named"), F.col("payload")), "altered_event")
    )
    return own.withColumn("problem", problem).withColumnRenamed("_named", "previous").select(*records.columns, "problem")


def trailing_window(rows: DataFrame, by: str, ts: str, seconds: int, value: str) -> DataFrame:
    """rows with window_count and window_sum over the rows of `by` that are less than `seconds` old, itself among them (exclusive edge)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(by).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumns({"window_count": F.count("*").over(frame), "window_sum": F.sum(value).over(frame)})


def first_calls(calls: DataFrame, by: str, key: str, seq: str, limit: str | None = None, truncated: str | None = None) -> DataFrame:
    """calls with served_by: the earlier call of the same key whose answer serves this one, else null.

    An earlier answer serves unless it was truncated under a smaller limit.
    """
    own = Window.partitionBy(by, key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    if limit is None:
        return calls.withColumn("served_by", F.min(seq).over(own))
    # an untruncated answer serves every later limit; a truncated one, limits up to its own
    whole = F.min(F.when(~F.col(truncated), F.col(seq))).over(own)
    most = F.max_by(F.col(seq), F.col(limit)).over(own)
    enough = F.max(limit).over(own) >= F.col(limit)
    return calls.withColumn("served_by", F.coalesce(whole, F.when(enough, most)))


# Stops that say nothing about the task's result.
CENSORED = (
    "token_limit", "request_limit", "time_boundary", "context_or_output_limit", "context_budget", "provider_rate_limit", "response_schema_invalid", "local_request_rate_limit",
    "local_reserved_token_rate_limit",
)


def accounting(events: DataFrame) -> DataFrame:
    """One row for each task of events (task, attempt, sequence, kind, tokens, and if there: reason, consistent): attempts, reserved, observed,
    charged, conflicts, unknown, status, reason.

    An attempt is charged the most that was observed, or its reservation if usage is unknown; differing observations conflict.  The last
    of completed, failed and stopped is the task's end.  A stop is CENSORED or INTERRUPTED by its reason, else FAILED; a task without an end is
    UNFINISHED.  Conflicting usage makes any task FAILED; unknown usage, observations that do not add up (consistent is false) or attempts that were not
    settled make a COMPLETED one FAILED.
    """
    for name, kind_ in (("reason", "string"), ("consistent", "boolean")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind_))
    kind = lambda k: F.col("kind") == k
    last = F.when(F.col("kind").isin("completed", "failed", "stopped"), F.col("sequence"))
    # one pass: what events say of their attempt, or of their task where they name none
    attempts = events.groupBy("task", "attempt").agg(
        F.max(F.when(kind("reserved"), F.col("tokens"))).alias("reserved"),
        F.max(F.when(kind("observed"), F.col("tokens"))).alias("observed"),
        (F.max(F.when(kind("observed"), F.col("tokens"))) != F.min(F.when(kind("observed"), F.col("tokens")))).alias("conflict"),
        F.coalesce(F.bool_and(F.when(kind("observed"), F.col("consistent"))), F.lit(True)).alias("adds_up"),
        F.bool_or(kind("settled")).alias("settled"),
        F.max(F.when(last.isNotNull(), F.struct("sequence", "kind", "reason"))).alias("end"),
    )
    own = F.col("attempt").isNotNull()
    total = lambda x: F.sum(F.when(own, x))
    ends = attempts.groupBy("task").agg(
        F.count_if(own).alias("attempts"),
        total(F.coalesce("reserved", F.lit(0))).alias("reserved"),
        total(F.coalesce("observed", F.lit(0))).alias("observed"),
        total(F.coalesce("observed", "reserved", F.lit(0))).alias("charged"),
        F.count_if(own & F.coalesce("conflict", F.lit(False))).alias("conflicts"),
        F.count_if(own & F.col("observed").isNull()).alias("unknown"),
        F.bool_and(F.when(own, F.col("settled"))).alias("all_settled"),
        F.bool_and(F.when(own, F.col("adds_up") & F.col("observed").isNotNull())).alias("known"),
        F.max("end").alias("last"),
    ).withColumns({"end": F.col("last.kind"), "why": F.col("last.reason")})
    conflicted = F.coalesce("conflicts", F.lit(0)) > 0
    complete = F.col("end") == "completed"
    unsettled, uncertain = complete & ~F.coalesce("all_settled", F.lit(True)), complete & ~F.coalesce("known", F.lit(True))
    status = (
        F.when(conflicted | unsettled | uncertain | (F.col("end") == "failed"), "FAILED")
        .when(complete, "COMPLETED")
        .when((F.col("end") == "stopped") & F.col("why").isin(*CENSORED), "CENSORED")
        .when((F.col("end") == "stopped") & F.coalesce(F.col("why") == "execution_interrupted", F.lit(False)), "INTERRUPTED")
        .when(F.col("end") == "stopped", "FAILED")
        .otherwise("UNFINISHED")
    )
    reason = (
        F.when(conflicted, "usage_observation_mismatch")
        .when(unsettled, "unsettled_attempts")
        .when(uncertain, "usage_unknown_or_inconsistent")
        .when(complete, "task_finished")
        .otherwise(F.col("why"))
    )
    out = ends.withColumns({"status": status, "reason": reason})
    counts = ("attempts", "reserved", "observed", "charged", "conflicts", "unknown")
    return out.select("task", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), "status", "reason")


def admission(requests: DataFrame, budget_tokens: int, budget_requests: int, per_minute: int, by: str = "task") -> DataFrame:
    """requests (by, seq, ts, tokens) with decision: the first budget a request exceeds, in order, or admitted.  An audit of a log: all rows count."""
    run = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = trailing_window(requests, by, "ts", 60, "tokens").withColumns({"total": F.sum("tokens").over(run), "n": F.count("*").over(run)})
    decision = F.when(F.col("n") > budget_requests, "request_budget").when(F.col("total") > budget_tokens, "token_budget").when(F.col("window_count") > per_minute, "rate_limit").otherwise("admitted")
    return rows.withColumn("decision", decision)


def call_order_problem(events: DataFrame, by: str = "task") -> DataFrame:
    """events (by, sequence, kind, attempt) with problem, where request, reserved and response do not nest or an attempt is not the next."""
    own = Window.partitionBy(by).orderBy("sequence")
    before, number = F.lag("kind").over(own), F.max("attempt").over(own.rowsBetween(Window.unboundedPreceding, -1))
    problem = (
        F.when((F.col("kind") == "reserved") & (F.coalesce(before, F.lit("")) != "request"), "reserved_without_request")
        .when((F.col("kind") == "response") & (F.coalesce(before, F.lit("")) != "reserved"), "response_without_reservation")
        .when((F.col("kind") == "reserved") & (F.col("attempt") != F.coalesce(number + 1, F.lit(1))), "attempt_out_of_order")
    )
    return events.withColumn("problem", problem)


def timeline(trace: DataFrame, by: str = "run") -> DataFrame:
    """trace (by, seq, event, error) with the phase that holds and the last error so far."""
    own = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    phase = F.when(F.col("event").isin("seed", "explore", "expand", "draft"), F.col("event"))
    return trace.withColumns({"phase": F.last(phase, ignorenulls=True).over(own), "last_error": F.last("error", ignorenulls=True).over(own)})
