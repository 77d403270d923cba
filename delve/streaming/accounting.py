"""What tasks have spent, folded from a journal of ten kinds of event: in batch by two aggregations, as a stream by typed state.

Kinds: started (tokens: the task's allocation), request, reserved (tokens: an attempt's reservation), observed, metadata and settled (tokens: what
an attempt has used), unknown (its usage cannot be told), response, stopped (reason) and finished.  All that is kept of an attempt or a task is a greatest,
a least, a count or a mark, so that the account is the same in whatever order and batches events come; sequence alone decides which end is the last.

An attempt is settled by its settlement.  Usage that comes without tokens or does not add up (consistent is false), an unknown, and a settlement
that is not complete leave it uncertain; observations that differ are a conflict.  A settled, certain attempt costs what was observed, any other at
least its reservation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from delve.operators.journal import CENSORED

USAGE = ("observed", "metadata", "settled")
ENDS = ("finished", "stopped")
EVENT = "task long, attempt int, sequence long, kind string, tokens long, reason string, consistent boolean, complete boolean, at timestamp"
#: What is kept of an attempt, and of a task besides.
ATTEMPT = "reserved long, low long, high long, uncertain boolean, settlements long"
TASK = "events long, allocation long, requests long, responses long, end_sequence long, end_kind string, end_reason string"
SUMS = "attempts long, reserved long, observed long, charged long, conflicts long, uncertain long, unresolved long, repeated long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def _usage() -> tuple[Column, Column]:
    """The tokens that an event tells of its attempt, and whether it leaves doubt."""
    usable = F.col("tokens").isNotNull() & F.coalesce("consistent", F.lit(True))
    doubt = (kind("observed", "metadata") & ~usable) | kind("unknown") | (kind("settled") & (~usable | ~F.coalesce("complete", F.lit(True))))
    return F.when(kind(*USAGE) & usable, F.col("tokens")), F.coalesce(doubt, F.lit(False))


def attempt_states(events: DataFrame) -> DataFrame:
    """One row for each task and attempt of events, and one of each task for the events without attempt: what ATTEMPT and TASK keep."""
    seen, doubt = _usage()
    end = F.max(F.when(kind(*ENDS), F.struct("sequence", "kind", "reason")))
    out = events.groupBy("task", "attempt").agg(
        F.max(F.when(kind("reserved"), F.col("tokens"))).alias("reserved"), F.min(seen).alias("low"), F.max(seen).alias("high"), F.bool_or(doubt).alias("uncertain"), F.count_if(kind("settled")).alias("settlements"),
        F.count("*").alias("events"), F.max(F.when(kind("started"), F.col("tokens"))).alias("allocation"), F.count_if(kind("request")).alias("requests"), F.count_if(kind("response")).alias("responses"), end.alias("end"),
    )
    return out.withColumns({f"end_{n}": F.col(f"end.{n}") for n in ("sequence", "kind", "reason")}).drop("end")


def _with_status(sums: DataFrame) -> DataFrame:
    complete = F.col("end_kind") == "finished"
    conflict, unsettled, doubt, open_ = F.col("conflicts") > 0, complete & (F.col("unresolved") > 0), complete & (F.col("uncertain") > 0), complete & (F.col("requests") != F.col("responses"))
    why = F.col("end_reason")
    status: Column = (
        F.when(conflict | unsettled | doubt | open_, "FAILED")
        .when(complete, "COMPLETED")
        .when(F.col("end_kind").isNull(), "UNFINISHED")
        .when(why.isin(*CENSORED), "CENSORED")
        .when(why == "execution_interrupted", "INTERRUPTED")
        .otherwise("FAILED")
    )
    reason = F.when(conflict, "usage_observation_mismatch").when(unsettled, "unsettled_attempts").when(doubt, "usage_unknown_or_inconsistent").when(open_, "unanswered_request").when(complete, "task_finished").otherwise(why)
    named = [c.split()[0] for c in SUMS.split(", ")]
    marks = ["expired"] if "expired" in sums.columns else []
    return sums.select("task", *marks, "events", "allocation", *named, (F.col("requests") - F.col("responses")).alias("unanswered"), F.coalesce(F.col("charged") > F.col("allocation"), F.lit(False)).alias("over"), status.alias("status"), reason.alias("reason"))


def accounts(events: DataFrame) -> DataFrame:
    """One row for each task of events (EVENT, without at): what its attempts reserved, used and cost, what is open, its status and why."""
    return accounts_of(attempt_states(events))


def accounts_of(attempts: DataFrame) -> DataFrame:
    """The accounts of attempt_states()."""
    own, sure = F.col("attempt").isNotNull(), F.col("low") == F.col("high")
    certain = (F.col("settlements") > 0) & ~F.col("uncertain") & sure
    seen, held = F.coalesce("high", F.lit(0)), F.coalesce("reserved", F.lit(0))
    of = lambda value: F.coalesce(F.sum(F.when(own, value)), F.lit(0)).alias
    count = lambda what: F.count_if(own & F.coalesce(what, F.lit(False))).alias
    end = F.max(F.when(F.col("end_sequence").isNotNull(), F.struct("end_sequence", "end_kind", "end_reason"))).alias("end")
    sums = attempts.groupBy("task").agg(
        F.sum("events").alias("events"), F.max("allocation").alias("allocation"), F.sum("requests").alias("requests"), F.sum("responses").alias("responses"), end,
        count(F.lit(True))("attempts"), of(held)("reserved_"), of(seen)("observed"), of(F.when(F.coalesce(certain, F.lit(False)), seen).otherwise(F.greatest(held, seen)))("charged"),
        count(~sure)("conflicts"), count(F.col("uncertain") | F.col("high").isNull())("uncertain_"), count(F.col("settlements") == 0)("unresolved"), count(F.col("settlements") > 1)("repeated"),
    )
    return _with_status(sums.withColumns({f"end_{n}": F.col(f"end.end_{n}") for n in ("kind", "reason")}).withColumnsRenamed({"reserved_": "reserved", "uncertain_": "uncertain"}))


class Accounts(StatefulProcessor):
    """A task's account as state: a value for the task, a map of its attempts, and a list of the attempts that were settled more than once."""

    def __init__(self, patience: int | None = None):
        self.patience = patience  # milliseconds after which an attempt should have been settled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", TASK)
        self.attempts = handle.getMapState("attempts", "attempt int", ATTEMPT)
        self.repeated = handle.getListState("repeated", "attempt int")

    def _fold(self, rows: pd.DataFrame) -> None:
        """Rows as attempt_states gives them, of this task."""
        lesser = lambda a, b: b if a is None else a if b is None else min(a, b)
        greater = lambda a, b: b if a is None else a if b is None else max(a, b)
        whole = lambda x: None if pd.isna(x) else int(x)
        events, allocation, requests, responses, *end = self.task.get() if self.task.exists() else (0, None, 0, 0, None, None, None)
        for r in rows.to_dict("records"):
            events, requests, responses = events + int(r["events"]), requests + int(r["requests"]), responses + int(r["responses"])
            allocation = greater(allocation, whole(r["allocation"]))
            last = whole(r["end_sequence"])
            rank = lambda sequence, kind, reason: (sequence, kind, reason is not None, reason or "")
            if last is not None:
                reason = None if pd.isna(r["end_reason"]) else r["end_reason"]
                if end[0] is None or rank(last, r["end_kind"], reason) > rank(*end):
                    end = [last, r["end_kind"], reason]
            number = whole(r["attempt"])
            if number is None:
                continue
            held = self.attempts.getValue((number,)) if self.attempts.containsKey((number,)) else (None, None, None, False, 0)
            settled = held[4] + int(r["settlements"])
            if settled > 1 >= held[4]:
                self.repeated.appendValue((number,))
            self.attempts.updateValue((number,), (greater(held[0], whole(r["reserved"])), lesser(held[1], whole(r["low"])), greater(held[2], whole(r["high"])), bool(held[3] or r["uncertain"]), settled))
        self.task.update((events, allocation, requests, responses, *end))

    def _account(self, task: int, expired: bool) -> pd.DataFrame:
        events, allocation, requests, responses, _, end_kind, end_reason = self.task.get()
        own = [v for _, v in self.attempts.iterator()]
        certain = [s > 0 and not doubt and low is not None and low == high for _, low, high, doubt, s in own]
        sums = {
            "attempts": len(own),
            "reserved": sum(r or 0 for r, *_ in own),
            "observed": sum(high or 0 for _, _, high, *_ in own),
            "charged": sum((high or 0) if sure else max(r or 0, high or 0) for (r, _, high, *_), sure in zip(own, certain, strict=True)),
            "conflicts": sum(low is not None and low != high for _, low, high, *_ in own),
            "uncertain": sum(bool(doubt) or high is None for _, _, high, doubt, _ in own),
            "unresolved": sum(s == 0 for *_, s in own),
            "repeated": sum(1 for _ in self.repeated.get()),
        }
        row = {"task": task, "events": events, "allocation": allocation, "requests": requests, "responses": responses, "end_kind": end_kind, "end_reason": end_reason, "expired": expired} | sums
        return pd.DataFrame([row]).astype({"allocation": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            self._fold(part)
            if "latest" in part and part["latest"].notna().any():
                latest = max(latest or 0, int(part["latest"].max()))
        account = self._account(key[0], False)
        if self.patience is not None and latest is not None and account["unresolved"].iloc[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.patience)
        yield account

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Attempts that were not settled in time: the account as it stands, marked."""
        account = self._account(key[0], True)
        yield account if account["unresolved"].iloc[0] else account.iloc[:0]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self._fold(initialState)

    def close(self) -> None:
        pass


_OUTPUT = f"task long, events long, allocation long, requests long, responses long, end_kind string, end_reason string, expired boolean, {SUMS}"

def accounts_stream(events: DataFrame, patience: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """accounts() over a stream of events: a row of a task for each micro-batch that has events of it, the last of which is its account; see latest().

    before: attempt_states() of events that were folded in batch, which the stream goes on from.  patience: milliseconds after a task's last event at
    which a task with attempts that are not settled is told again, with expired set; events then need at, and a watermark of it.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    seen, doubt = _usage()
    own = lambda what, name: F.when(kind(*ENDS), F.col(what)).alias(name)
    one = lambda *names: kind(*names).cast("long")
    rows = events.select(
        "task", "attempt", F.when(kind("reserved"), F.col("tokens")).alias("reserved"), seen.alias("low"), seen.alias("high"), doubt.alias("uncertain"), one("settled").alias("settlements"), F.lit(1).cast("long").alias("events"),
        F.when(kind("started"), F.col("tokens")).alias("allocation"), one("request").alias("requests"), one("response").alias("responses"), own("sequence", "end_sequence"), own("kind", "end_kind"), own("reason", "end_reason"), *(["at", F.unix_millis("at").alias("latest")] if patience is not None else []),
    )
    initial = before.groupBy("task") if before is not None else None
    told = rows.groupBy("task").transformWithStateInPandas(Accounts(patience), _OUTPUT, "Update", "EventTime" if patience is not None else "None", initialState=initial)
    return _with_status(told)


def attempts_stream(events: DataFrame) -> DataFrame:
    """attempt_states() over a stream of events: for each micro-batch a row of each attempt that it has events of; see latest() and accounts_of().

    State is Spark's own, of a group, so that none of it goes through Python: what accounts_stream() does for each task costs several calls between the two.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return attempt_states(events)


def latest(rows: DataFrame, *by: str) -> DataFrame:
    """Of a stream's rows the last of each task (or of by): that which counts the most events."""
    by = by or ("task",)
    names = [c for c in rows.columns if c not in (*by, "events")]
    return rows.groupBy(*by).agg(F.max("events").alias("events"), F.max_by(F.struct(*names), "events").alias("x")).select(*by, "events", "x.*")
