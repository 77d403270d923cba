"""The candidate ledger: an ordered fold over decisions, in batch by a scan of automata and as a stateful stream.

A target begins as suspected; it is confirmed or rejected; a rejected one may come back until it has been rejected twice; a confirmed one stays.
Every event gets an outcome: changed, or a reason why not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from delve.operators import scan

CAP, REJECTIONS = 30, 2
EVENT = "run string, seq long, target string, status string, ok boolean, touches boolean, strong boolean, latest boolean"
OUTCOME = "run string, seq long, target string, status string, changed boolean, refusal string"


def step(state: dict, event: dict, cap: int = CAP) -> tuple[bool, str | None]:
    """Apply one event to state ({target: [status, rejections]}); (changed, refusal)."""
    target, wanted, now = event["target"], event["status"], state.get(event["target"])
    if not target:
        return False, "invalid_target"
    for flag, reason in (("latest", "latest_evidence_required"), ("ok", "failed_evidence"), ("touches", "untouched_target")):
        if not event[flag]:
            return False, reason
    if now is None:
        if wanted != "suspected":
            return False, "invalid_transition"
        if len(state) >= cap:
            return False, "candidate_cap"
        state[target] = ["suspected", 0]
        return True, None
    status, rejections = now
    if status == "confirmed":
        return False, "already_confirmed"
    if status == "rejected":
        if wanted == "rejected":
            return False, "already_rejected"
        if rejections >= REJECTIONS:
            return False, "rejection_limit"
        if wanted != "suspected":
            return False, "invalid_transition"
    elif wanted not in ("confirmed", "rejected"):
        return False, "invalid_transition"
    elif wanted == "confirmed" and not event["strong"]:
        return False, "strong_evidence_required"
    state[target] = [wanted, rejections + (wanted == "rejected")]
    return True, None


def _fold(run: str, rows: pd.DataFrame, state: dict) -> pd.DataFrame:
    out = []
    for event in rows.sort_values("seq").to_dict("records"):
        changed, refusal = step(state, event)
        status = state.get(event["target"], [None])[0]
        out.append((run, event["seq"], event["target"], status, changed, refusal))
    return pd.DataFrame(out, columns=["run", "seq", "target", "status", "changed", "refusal"])


# The ledger of one target as an automaton: absent, suspected after 0, 1, ... rejections, rejected after 1, 2, ..., confirmed.
ABSENT, CONFIRMED = 0, 2 * REJECTIONS + 1
SUSPECTED, REJECTED = range(1, REJECTIONS + 1), range(REJECTIONS + 1, 2 * REJECTIONS + 1)
# Symbols: what an event that passes the checks asks for; others are null.
SUSPECT, REJECT, CONFIRM = range(3)


def _moves() -> list[list[int]]:
    table = [[s] * 3 for s in range(CONFIRMED + 1)]
    table[ABSENT][SUSPECT] = SUSPECTED[0]
    for n in range(REJECTIONS):
        table[SUSPECTED[n]][REJECT], table[SUSPECTED[n]][CONFIRM] = REJECTED[n], CONFIRMED
        if n + 1 < REJECTIONS:
            table[REJECTED[n]][SUSPECT] = SUSPECTED[n + 1]
    return table


def replay(events: DataFrame) -> DataFrame:
    """The outcome of every event of a log, in order of seq, whatever its length: see step.

    The targets of a run only meet in the cap: the CAP that are validly suspected first are all that it will ever hold.  So they are found by
    their first such events, and each target is an automaton of its own, scanned in parts.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    named = flag(F.col("target") != "")
    checked = named & flag(F.col("latest")) & flag(F.col("ok")) & flag(F.col("touches"))
    own = events.withColumns({"_checked": checked, "_wants": F.when(checked & F.col("status").isin("suspected", "rejected", "confirmed"), F.col("status"))})
    first = own.where("_wants = 'suspected'").groupBy("run", "target").agg(F.min("seq").alias("first"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("first", "target"))
    taken = first.withColumn("place", place).where(F.col("place") <= CAP).select(F.col("run").alias("_run"), F.col("target").alias("_target"))
    own = own.join(taken, F.col("run").eqNullSafe(F.col("_run")) & (F.col("target") == F.col("_target")), "left").withColumn("_taken", F.col("_target").isNotNull()).drop("_run", "_target")
    strong = flag(F.col("strong"))
    symbol = F.when(F.col("_taken"), F.when(F.col("_wants") == "suspected", SUSPECT).when(F.col("_wants") == "rejected", REJECT).when((F.col("_wants") == "confirmed") & strong, CONFIRM))
    own = scan.automaton(own.withColumn("_symbol_", symbol), ["run", "target"], ["seq"], F.col("_symbol_"), _moves(), ABSENT, "_before")
    before, wants = F.col("_before"), F.coalesce("status", F.lit(""))
    suspected, rejected = before.isin(*SUSPECTED), before.isin(*REJECTED)
    refusal = (
        F.when(~named, "invalid_target")
        .when(~flag(F.col("latest")), "latest_evidence_required")
        .when(~flag(F.col("ok")), "failed_evidence")
        .when(~flag(F.col("touches")), "untouched_target")
        .when((before == ABSENT) & (wants != "suspected"), "invalid_transition")
        .when((before == ABSENT) & ~F.col("_taken"), "candidate_cap")
        .when(before == CONFIRMED, "already_confirmed")
        .when(rejected & (wants == "rejected"), "already_rejected")
        .when(before == REJECTED[-1], "rejection_limit")
        .when(rejected & (wants != "suspected"), "invalid_transition")
        .when(suspected & ~wants.isin("confirmed", "rejected"), "invalid_transition")
        .when(suspected & (wants == "confirmed") & ~strong, "strong_evidence_required")
    )
    held = F.when(suspected, "suspected").when(rejected, "rejected").when(before == CONFIRMED, "confirmed")
    return own.withColumn("refusal", refusal).select("run", "seq", "target", F.when(F.col("refusal").isNull(), F.col("status")).otherwise(held).alias("status"), F.col("refusal").isNull().alias("changed"), "refusal")


def replay_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; a run's ledger is its state.  Events of one micro-batch are folded in order of seq."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames))
        out = _fold(key[0], rows, held)
        state.update((json.dumps(held),))
        yield out

    return events.groupBy("run").applyInPandasWithState(update, OUTCOME, "ledger string", "append", GroupStateTimeout.NoTimeout)
