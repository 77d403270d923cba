"""From a decision log to a report: evidence, claims, expansion, confidence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEARCH_TOOLS = ("search_code",)


def strong(tool: Column, ok: Column, high_references: Column) -> Column:
    """Evidence that is not lexical; references need one of high confidence."""
    return ok & ~tool.isin(*SEARCH_TOOLS) & ((tool != "find_references") | (F.coalesce(high_references, F.lit(0)) > 0))


def keep_claims(claims: DataFrame, ledger: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped claims (run, position, target, confidence, evidence_ids); ledger: run, target, status; evidence: run, evidence_id, ok, touched, strong.

    Dropped, for the first reason that holds: unconfirmed, duplicate, unsupported.  High confidence without strong evidence becomes medium.
    """
    cited = claims.select("run", "position", "target", F.explode_outer("evidence_ids").alias("evidence_id"))
    support = cited.join(evidence, ["run", "evidence_id"], "left").groupBy("run", "position").agg(
        F.coalesce(F.bool_or(F.col("ok") & F.array_contains("touched", F.col("target"))), F.lit(False)).alias("supported"),
        F.coalesce(F.bool_or(F.col("strong") & F.array_contains("touched", F.col("target"))), F.lit(False)).alias("is_strong"),
    )
    confirmed = ledger.where("status = 'confirmed'").select("run", "target", F.lit(True).alias("confirmed"))
    first = F.row_number().over(Window.partitionBy("run", "target").orderBy("position"))
    rows = claims.withColumn("n", first).join(confirmed, ["run", "target"], "left").join(support, ["run", "position"], "left")
    reason = F.when(F.col("confirmed").isNull(), "unconfirmed").when(F.col("n") > 1, "duplicate").when(~F.col("supported"), "unsupported")
    rows = rows.withColumn("reason", reason)
    confidence = F.when((F.col("confidence") == "high") & ~F.col("is_strong"), "medium").otherwise(F.col("confidence"))
    return rows.where("reason is null").select(*[c for c in claims.columns if c != "confidence"], confidence.alias("confidence")), rows.where("reason is not null").select(*claims.columns, "reason")


def retained(ledger: DataFrame, kept: DataFrame, checks: DataFrame) -> DataFrame:
    """Confirmed targets that no kept claim has and whose checks (run, target, check, passed) all passed, with low confidence; else the first failed check."""
    missing = ledger.where("status = 'confirmed'").join(kept.select("run", "target"), ["run", "target"], "left_anti")
    failed = checks.where("not passed").groupBy("run", "target").agg(F.min("check").alias("refusal"))
    return missing.join(failed, ["run", "target"], "left").select("run", "target", F.when(F.col("refusal").isNull(), "low").alias("confidence"), "refusal")


def confidence_tiers(decisions: DataFrame) -> DataFrame:
    """Targets of decisions (run, seq, target, decision) that were first confirmed after they had been deferred have low confidence."""
    first = decisions.groupBy("run", "target").agg(F.min(F.when(F.col("decision") == "confirm", F.col("seq"))).alias("confirmed"), F.min(F.when(F.col("decision") == "keep", F.col("seq"))).alias("deferred"))
    return first.where("confirmed is not null").select("run", "target", F.when(F.col("deferred") < F.col("confirmed"), "low").otherwise("high").alias("tier"))


def regression_areas(evidence: DataFrame) -> DataFrame:
    """run, target, score, reason of evidence (run, seq, tool, target, high_references), folded in order: a dependency writes its 20 whatever was
    there, references their 10 plus count only over a lower score, tests their 5 whatever was there."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        areas: dict[str, tuple[int, str]] = {}
        for r in rows.sort_values("seq").itertuples():
            if r.tool == "get_dependencies":
                areas[r.target] = (20, "dependency")
            elif r.tool == "find_references":
                value = 10 + int(r.high_references or 0)
                if value > areas.get(r.target, (-1, ""))[0]:
                    areas[r.target] = (value, "references")
            elif r.tool == "find_tests":
                areas[r.target] = (5, "tests")
        out = [(key[0], t, s, why) for t, (s, why) in areas.items()]
        return pd.DataFrame(sorted(out, key=lambda x: (-x[2], x[1])), columns=["run", "target", "score", "reason"])

    return evidence.groupBy("run").applyInPandas(fold, "run string, target string, score long, reason string")


def proof_steps(suspects: DataFrame, done: DataFrame, most: int = 8) -> DataFrame:
    """The calls that suspects (run, target, seq) still need and that done (run, tool, target) lacks: inspect, references, tests, in tiers."""
    steps = suspects.select("run", "target", "seq", F.posexplode(F.array(*map(F.lit, ("inspect_symbol", "find_references", "find_tests")))).alias("tier", "tool"))
    left = steps.join(done, ["run", "tool", "target"], "left_anti")
    n = F.row_number().over(Window.partitionBy("run").orderBy("tier", "seq", "target"))
    return left.withColumn("n", n).where(F.col("n") <= most)


def stop_reasons(steps: DataFrame, tools: int = 25, idle: int = 4, stall: int = 8, checkpoints: int = 8, candidates: int = 30, tokens: int | None = None) -> DataFrame:
    """run, seq, stop_reason where a run first meets a bound, the first of: tool_budget, no_progress, no_ledger_progress, review_exhausted,
    candidate_cap, token_ceiling.

    steps: run, seq, tool_call, progress, and if there: ledger_change, checkpoint (booleans), candidates and tokens (numbers of the step).  Idle and
    stall are steps in a row without progress and without a change of the ledger.
    """
    own = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    def since(rows: DataFrame, flag: str, name: str) -> DataFrame:
        """Steps since the flag was last set."""
        rows = rows.withColumn("_streak", F.sum(F.col(flag).cast("int")).over(own))
        place = F.row_number().over(Window.partitionBy("run", "_streak").orderBy("seq"))
        return rows.withColumn(name, place - F.when(F.col("_streak") > 0, 1).otherwise(0)).drop("_streak")

    rows = since(steps.withColumn("calls", F.sum(F.col("tool_call").cast("int")).over(own)), "progress", "since")
    reason = F.when(F.col("calls") >= tools, "tool_budget").when(F.col("since") >= idle, "no_progress")
    if "ledger_change" in steps.columns:
        rows = since(rows, "ledger_change", "stalled")
        reason = reason.when(F.col("stalled") >= stall, "no_ledger_progress")
    if "checkpoint" in steps.columns:
        rows = rows.withColumn("reviews", F.sum(F.col("checkpoint").cast("int")).over(own))
        reason = reason.when(F.col("reviews") > checkpoints, "review_exhausted")
    if "candidates" in steps.columns:
        reason = reason.when(F.col("candidates") > candidates, "candidate_cap")
    if "tokens" in steps.columns and tokens is not None:
        rows = rows.withColumn("used", F.sum("tokens").over(own))
        reason = reason.when(F.col("used") >= tokens, "token_ceiling")
    met = rows.withColumn("stop_reason", reason).where("stop_reason is not null")
    return met.groupBy("run").agg(F.min(F.struct("seq", "stop_reason")).alias("x")).select("run", "x.seq", "x.stop_reason")


# Tools whose evidence is about what they were aimed at.
DIRECT_TOOLS = ("inspect_symbol", "find_references", "find_tests")


def direct_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """run, target, direct of citations (run, target, evidence_id): a cited result (run, evidence_id, ok, strong, tool, touched, aimed) of a direct
    tool is strong, touched the target, and was aimed at the target's own file."""
    path = lambda c: F.substring_index(c, "::", 1)
    both = citations.join(evidence, ["run", "evidence_id"], "left")
    good = F.col("ok") & F.col("strong") & F.col("tool").isin(*DIRECT_TOOLS) & F.array_contains("touched", F.col("target")) & (path("aimed") == path("target"))
    return both.groupBy("run", "target").agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("direct"))


def candidate_needs(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """run, target, needs: the calls that a candidate (run, target, status, strong, checked_refs, checked_tests) still requires, in order; symbols: path, id.

    A suspect without strong evidence is inspected; references are asked of the target or of its file's first three symbols; a rejected one needs nothing.
    """
    n = F.row_number().over(Window.partitionBy("path").orderBy("id"))
    first = symbols.select("path", "id").withColumn("n", n).where("n <= 3").groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = candidates.join(first, candidates["target"] == first["path"], "left")
    asked = F.when(F.contains("target", F.lit("::")), F.array("target")).otherwise(F.coalesce("ids", F.array().cast("array<string>")))
    calls = F.array(
        F.when((F.col("status") == "suspected") & ~F.col("strong"), F.concat(F.lit("inspect_symbol "), "target")),
        F.when((F.col("status") != "rejected") & ~F.col("checked_refs") & (F.size(asked) > 0), F.concat(F.lit("find_references "), F.array_join(asked, " | "))),
        F.when((F.col("status") != "rejected") & ~F.col("checked_tests"), F.concat(F.lit("find_tests "), "target")),
    )
    return rows.select("run", "target", F.filter(calls, lambda c: c.isNotNull()).alias("needs"))


def bounded_batch(candidates: DataFrame, budget: int) -> DataFrame:
    """candidates (run, position, size, least_size) with decision: shown, reduced or deferred.

    The last candidates go until the batch fits the budget; one that does not fit alone is reduced to its last strong record if that fits.
    """
    own = Window.partitionBy("run").orderBy("position")
    total, first = F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(own) == 1
    return candidates.withColumn("decision", F.when(total <= budget, "shown").when(first & (F.col("least_size") <= budget), "reduced").otherwise("deferred"))


def repairable_drafts(drafts: DataFrame, ledger: DataFrame, existing: DataFrame) -> DataFrame:
    """Drafts (run, target, change_type) that call a confirmed target a new file although it exists (target), with the error."""
    wrong = drafts.where("change_type = 'new_file'").join(ledger.where("status = 'confirmed'").select("run", "target"), ["run", "target"], "left_semi")
    return wrong.join(existing.select("target"), "target", "left_semi").select("run", "target", F.lit("existing_target_classified_new_file").alias("error"))


def wasted_choices(choices: DataFrame) -> DataFrame:
    """choices with waste: disabled, invalid_arguments, invalid_target, duplicate, stalled, for the first that holds."""
    earlier = F.count("*").over(Window.partitionBy("run", "tool", "arguments").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    waste = (
        F.when(~F.col("enabled"), "disabled").when(~F.col("valid_arguments"), "invalid_arguments").when(~F.col("valid_target"), "invalid_target").when(earlier > 0, "duplicate").when(F.col("stalled"), "stalled")
    )
    return choices.withColumn("waste", waste)


def adjudication_rows(findings: DataFrame, context: DataFrame) -> DataFrame:
    """One row for each false positive (task_id, path) of findings (task_id, path, seed), with its seeds in order and context (task_id, path, context)."""
    return findings.groupBy("task_id", "path").agg(F.array_sort(F.collect_set("seed")).alias("seeds")).join(context, ["task_id", "path"], "left")


def reconcile(archived: DataFrame, current: DataFrame) -> DataFrame:
    """Archived failures (run_id, kind) by their status now (run_id, status): kind, status or missing, count."""
    return archived.join(current, "run_id", "left").groupBy("kind", F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("count"))


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """The items (run, position, focused, body) that fit the run's budget of ASCII JSON bytes: focused ones first, an item that does not fit is
    skipped, and what is kept stays in its order."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        for i in rows.sort_values(["focused", "position"], ascending=[False, True]).index:
            size = len(json.dumps(rows.at[i, "body"]).encode())
            if size <= left:
                left -= size
                kept.append(i)
        return rows.loc[kept].sort_values("position")

    return items.groupBy("run").applyInPandas(choose, items.schema)


def compacted(prompts: DataFrame) -> DataFrame:
    """prompts (id, body) with JSON bodies rewritten without blanks, where that loses nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x["body"] = [_compact(b) for b in x["body"]]
            yield x

    return prompts.mapInPandas(run, prompts.schema)


def _compact(body: str | None) -> str | None:
    try:
        value = json.loads(body or "")
    except ValueError:
        return body
    small = json.dumps(value, separators=(",", ":"))
    return small if json.dumps(value) == body else body
