"""Records of evaluations and runs: ingest, constraints, aggregates, identities, audits, views."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delve.operators.metrics import ratio
from delve.sources.stage import numbered

# ingest and constraints


def ingest_tasks(rows: DataFrame, pulls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and rejected rows of rows (task_id, repository, number, base) joined with pulls (repository, number, base_sha, merged, merged_at).

    The first failed constraint is the reason: no_pull_request, not_merged, base_differs.
    """
    both = rows.join(pulls, ["repository", "number"], "left")
    reason = F.when(F.col("base_sha").isNull(), "no_pull_request").when(~F.coalesce("merged", F.lit(False)), "not_merged").when(F.col("base") != F.col("base_sha"), "base_differs")
    both = both.withColumn("reason", reason)
    return both.where("reason is null").drop("reason", "base_sha", "merged"), both.where("reason is not null").select("task_id", "repository", "number", "reason")


def without(tasks: DataFrame, taken: DataFrame, key: str = "task_id") -> DataFrame:
    """tasks that are not among those taken for development."""
    return tasks.join(taken.select(key), key, "left_anti")


def recent_set(tasks: DataFrame, cutoff: str, least: int = 3, most: int = 5) -> DataFrame:
    """Tasks merged after cutoff; an error unless they come from least to most repositories."""
    kept = tasks.where(F.col("merged_at").cast("date") > F.to_date(F.lit(cutoff)))
    n = kept.agg(F.countDistinct("repository")).first()[0]
    if not least <= n <= most:
        raise ValueError(f"{n} repositories; {least} to {most} are wanted")
    return kept


def field_gates(actual: DataFrame, expected: dict[str, object]) -> DataFrame:
    """field, reason for each field of a one-row contract that is not as expected: missing or differs."""
    checks = [
        F.struct(F.lit(k).alias("field"), F.when(F.col(k).isNull(), "missing").when(F.col(k).cast("string") != F.lit(str(v)), "differs").alias("reason")) if k in actual.columns else F.struct(F.lit(k).alias("field"), F.lit("missing").alias("reason"))
        for k, v in expected.items()
    ]
    return actual.select(F.inline(F.array(*checks))).where("reason is not null")


def latest_report(reports: DataFrame) -> DataFrame:
    """The report (path, mtime) of the latest mtime; an error if two share it."""
    best = Window.orderBy(F.desc("mtime"))
    found = reports.orderBy(F.desc("mtime"), "path").limit(2).withColumn("rank", F.rank().over(best)).where("rank = 1").drop("rank")
    if found.count() > 1:
        raise ValueError("ambiguous: two reports are the latest")
    return found


def leak_checks(repositories: DataFrame, gold_paths: DataFrame, base_paths: DataFrame) -> DataFrame:
    """task_id, check, passed of repositories (task_id, head, expected_head, dirty, refs, request): head, clean, no other refs, and no path that only
    the solution has mentioned in the request."""
    only = gold_paths.join(base_paths, ["task_id", "path"], "left_anti").groupBy("task_id").agg(F.collect_set("path").alias("only"))
    rows = repositories.join(only, "task_id", "left")
    mentioned = F.exists(F.coalesce("only", F.array().cast("array<string>")), lambda p: F.contains(F.col("request"), p))
    checks = {"head": F.col("head") == F.col("expected_head"), "clean": ~F.col("dirty"), "refs": F.col("refs") == 0, "request": ~mentioned}
    return rows.select("task_id", F.inline(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()))))


def symbol_leaks(sources: DataFrame, names: DataFrame) -> DataFrame:
    """task_id, name, path where a name that only the solution has is a word of a source (task_id, path, text).  Words meet names by equality."""
    words = sources.select("task_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), 0))).alias("name"))
    return words.join(names.select("task_id", "name").distinct(), ["task_id", "name"])


def symbol_gold(changed: DataFrame, checkpoints: DataFrame, wanted: int = 21) -> DataFrame:
    """task_id, symbols of changed (task_id, symbol); an error unless every task has the wanted number of checkpoints (task_id)."""
    bad = changed.select("task_id").distinct().join(checkpoints.groupBy("task_id").count(), "task_id", "left").where(F.coalesce("count", F.lit(0)) != wanted)
    if not bad.isEmpty():
        raise ValueError(f"a task without {wanted} checkpoints: {bad.first().task_id}")
    return changed.groupBy("task_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


# de-duplication


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of least position of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("x")).select(*keys, "x.*")


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of greatest position of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("x")).select(*keys, "x.*")


def recent_and_older(rows: DataFrame, by: str, seq: str, recent: int = 3) -> DataFrame:
    """rows with detail: full for the `recent` last of each `by`, else summary."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq)))
    return rows.withColumn("detail", F.when(n <= recent, "full").otherwise("summary"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# aggregates


def pooled_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """precision, recall and f1 of summed tp, fp, fn, to 4 decimals: pooled, not a mean of tasks."""
    sums = rows.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*by, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def protocol_means(rows: DataFrame, by: str, values: list[str], failed: str = "provider_failure") -> DataFrame:
    """Means of values that are there, without rows that a provider failed."""
    return rows.where(~F.coalesce(failed, F.lit(False))).groupBy(by).agg(F.count("*").alias("runs"), *(F.avg(v).alias(v) for v in values))


def migration_groups(files: DataFrame) -> DataFrame:
    """framework, folder, files: what lies under a folder migrations (django) or alembic's versions."""
    folder = F.regexp_extract("path", r"^((?:[^/]+/)*?(?:migrations|alembic(?:/[^/]+)*?/versions))/[^/]+\.py$", 1)
    rows = files.select("path", folder.alias("folder")).where("folder <> ''").where(~F.endswith("path", F.lit("__init__.py")))
    framework = F.when(F.endswith("folder", F.lit("versions")), "alembic").otherwise("django")
    return rows.groupBy(framework.alias("framework"), "folder").agg(F.array_sort(F.collect_list("path")).alias("files"))


def repository_map(files: DataFrame, fan_in: DataFrame, imports: DataFrame) -> DataFrame:
    """section, name, n, place of a short map: files a folder (two levels), the ten nodes most depended on (ties: greater path first), the ten
    packages imported from outside most, at most twenty files that do not parse."""
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(2))), "/")
    folders = files.groupBy(F.when(F.size(parts) > 1, folder).otherwise(".").alias("name")).agg(F.count("*").alias("n"))
    hubs = fan_in.select(F.col("dst").alias("name"), F.col("fan_in").alias("n")).orderBy(F.desc("n"), F.desc("name")).limit(10)
    outside = imports.where("dst is null and module <> ''").groupBy(F.substring_index("module", ".", 1).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    broken = files.where("parse_error is not null").select(F.col("path").alias("name"), F.lit(1).cast("long").alias("n")).orderBy("name").limit(20)
    out = None
    for section, rows, order in (("folders", folders, ["name"]), ("hubs", hubs, [F.desc("n"), F.desc("name")]), ("outside", outside, [F.desc("n"), "name"]), ("broken", broken, ["name"])):
        placed = rows.withColumns({"section": F.lit(section), "place": F.row_number().over(Window.orderBy(*order))})
        out = placed if out is None else out.unionByName(placed)
    return out.select("section", "place", "name", "n")


def map_text(repository: DataFrame, most: int = 6000) -> str:
    """The map as text of at most `most` characters."""
    rows = repository.orderBy("section", "place").collect()
    return "\n".join(f"{r.section}: {r.name} ({r.n})" for r in rows)[:most]


def workload(totals: DataFrame, tasks: int, seeds: int, systems: int) -> DataFrame:
    """A smoke run's totals (metric, value, runs), for each run and for tasks x seeds x systems runs."""
    mean = F.col("value") / F.col("runs")
    return totals.select("metric", mean.alias("each"), (mean * tasks * seeds * systems).alias("estimate"))


def request_maxima(requests: DataFrame, cap: int) -> DataFrame:
    """For each scenario of requests (scenario, seq, bytes): the largest request and the first over cap."""
    return requests.groupBy("scenario").agg(F.max("bytes").alias("largest"), F.min(F.when(F.col("bytes") > cap, F.col("seq"))).alias("first_over"))


def token_ceiling(calls: DataFrame, ceiling: int) -> DataFrame:
    """calls (run, seq, tokens) with used so far and blocked: over the ceiling, or any earlier usage unknown."""
    before = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    unknown = F.coalesce(F.bool_or(F.col("tokens").isNull()).over(before), F.lit(False))
    used = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return calls.withColumns({"used": used, "blocked": unknown | (used >= ceiling)})


def review_keeps(decisions: DataFrame, most: int = 2) -> DataFrame:
    """decisions (run, seq, target, decision) with retired: a keep after `most` keeps of its target."""
    own = Window.partitionBy("run", "target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.coalesce(F.sum((F.col("decision") == "keep").cast("int")).over(own), F.lit(0))
    return decisions.withColumn("retired", (F.col("decision") == "keep") & (kept >= most))


def verdicts_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings (path, category) that an investigation has added, lost or moved to another category: there may be none."""
    a, b = before.select("path", "category"), after.select("path", "category")
    return a.exceptAll(b).withColumn("change", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


def plant_anomalies(changes: DataFrame, tests: DataFrame) -> DataFrame:
    """variant, task_id, path, applicable: each task's changes (task_id, path) untouched, with an unrelated file more, and without its tests (task_id, path)."""
    control = changes.select(F.lit("control").alias("variant"), "task_id", "path", F.lit(True).alias("applicable"))
    unrelated = changes.select("task_id").distinct().select(F.lit("unrelated").alias("variant"), "task_id", F.lit("zz_unrelated.py").alias("path"), F.lit(True).alias("applicable"))
    has = tests.select("task_id").distinct().withColumn("applicable", F.lit(True))
    dropped = changes.join(tests, ["task_id", "path"], "left_anti").join(has, "task_id", "left").select(F.lit("drop_tests").alias("variant"), "task_id", "path", F.coalesce("applicable", F.lit(False)).alias("applicable"))
    return control.unionByName(control.withColumn("variant", F.lit("unrelated"))).unionByName(unrelated).unionByName(dropped)


def oracle_predictions(gold: DataFrame, existing: DataFrame) -> DataFrame:
    """Gold paths (task_id, path) that exist, as predictions of high confidence."""
    return gold.join(existing, ["task_id", "path"], "left_semi").withColumn("confidence", F.lit("high"))


# joins on facts and evidence


def fact_claims(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts (fact_id, path, symbol_id, handler) that concern a confirmed target: by its file or a folder above, its symbol, or its handler."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keys = [facts.select("fact_id", F.explode(above).alias("target")), facts.select("fact_id", F.col("symbol_id").alias("target")), facts.select("fact_id", F.col("handler").alias("target"))]
    out = keys[0].unionByName(keys[1]).unionByName(keys[2]).where("target is not null")
    return out.join(targets.select("target").distinct(), "target").distinct()


def touched(paths: Column, symbols: Column) -> Column:
    """The targets a result touches: its paths, its symbols, and the paths of its symbols, each once."""
    of = F.transform(symbols, lambda s: F.substring_index(s, "::", 1))
    return F.array_distinct(F.concat(F.coalesce(paths, F.array().cast("array<string>")), F.coalesce(symbols, F.array().cast("array<string>")), F.coalesce(of, F.array().cast("array<string>"))))


def evidence_line(tool: Column, ok: Column, target: Column, n: Column) -> Column:
    """One line about a result."""
    what = F.when(tool == "search_code", "hits").when(tool == "find_references", "references").when(tool == "get_dependencies", "neighbours").when(tool == "find_tests", "tests").otherwise("rows")
    return F.when(~ok, F.concat_ws(" ", tool, target, F.lit("failed"))).otherwise(F.concat_ws(" ", tool, F.concat(target, F.lit(":")), n.cast("string"), what))


def usage(payload: Column) -> Column:
    """struct(input, output, total, consistent) of a provider's usage in JSON; other keys are left out."""
    u = F.from_json(payload, "input_tokens long, output_tokens long, total_tokens long")
    return F.struct(u["input_tokens"].alias("input"), u["output_tokens"].alias("output"), u["total_tokens"].alias("total"), F.coalesce(u["input_tokens"] + u["output_tokens"] == u["total_tokens"], F.lit(False)).alias("consistent"))


# identities


def source_identity(files: DataFrame, by: str) -> DataFrame:
    """A hash of each group's files (path, sha256) in order of path."""
    line = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws(" ", x["sha256"], x["path"])))
    return files.groupBy(by).agg(F.sha2(line, 256).alias("identity"))


def canonical_json(rows: DataFrame, column: str) -> DataFrame:
    """rows with canonical (keys in order, no blanks, ASCII), its sha256, and ascii_bytes: the bytes of the text as a JSON string; all null for what is no JSON."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for x in frames:
            canonical = []
            for text in x[column]:
                try:
                    canonical.append(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")))
                except (TypeError, ValueError):
                    canonical.append(None)
            x["canonical"] = canonical
            x["sha256"] = [c and hashlib.sha256(c.encode()).hexdigest() for c in canonical]
            x["ascii_bytes"] = pd.array([None if t is None else len(json.dumps(t)) for t in x[column]], dtype="Int64")
            yield x

    fields = rows.withColumns({"canonical": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string"), "ascii_bytes": F.lit(None).cast("long")}).schema
    return rows.mapInPandas(run, fields)


def terminal_evidence(summaries: DataFrame, recomputed: DataFrame) -> DataFrame:
    """task, problem of stored summaries (task, sha256) against recomputed ones (task, summary): missing, or not bound to its hash."""
    both = summaries.join(recomputed, "task", "left")
    return both.select("task", F.when(F.col("summary").isNull(), "missing").when(F.sha2("summary", 256) != F.col("sha256"), "hash_differs").alias("problem")).where("problem is not null")


# views


# The order of categories in a view.
CATEGORY_ORDER = ("missing_predicted", "missing_test", "stale_caller", "unexpected", "adjacent", "expected")


def finding_cards(findings: DataFrame) -> DataFrame:
    """findings (path, category) in the order of the view, with rank, from 1 on."""
    placed = findings.withColumn("_place", F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category")), F.lit(99)))
    return numbered(placed, "rank", "_place", "path").withColumn("rank", F.col("rank") + 1).drop("_place").orderBy("rank")


def ledger_columns(ledger: DataFrame) -> DataFrame:
    """run, suspected, confirmed, rejected: the targets of each status, in order."""
    own = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("target"))))
    return ledger.groupBy("run").agg(*(own(s).alias(s) for s in ("suspected", "confirmed", "rejected")))


def run_record(trace: DataFrame) -> DataFrame:
    """Counts of a run's trace (run, event, ok, target_valid): tool calls, failures, invalid targets, model calls."""
    tool = F.col("event") == "tool"
    return trace.groupBy("run").agg(F.count_if(tool).alias("tool_calls"), F.count_if(tool & ~F.col("ok")).alias("failures"), F.count_if(tool & ~F.col("target_valid")).alias("invalid_targets"), F.count_if(F.col("event") == "model").alias("model_calls"))


def outline(symbols: DataFrame, by: str, most: int = 24_000) -> DataFrame:
    """Each group's symbols (path, first, qualname) as text, a line each in order, at most `most` characters."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "first", "qualname"))), lambda x: F.concat_ws(":", x["path"], x["first"].cast("string"), x["qualname"]))
    return symbols.groupBy(by).agg(F.substring(F.array_join(lines, "\n"), 1, most).alias("outline"))


def headline(rows: DataFrame) -> DataFrame:
    """The system of each task (task_id, system, recall) with the least recall; ties by name."""
    return rows.groupBy("task_id").agg(F.min(F.struct("recall", "system")).alias("x")).select("task_id", "x.system", "x.recall")
