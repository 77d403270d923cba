"""Ranked-retrieval metrics, seed means, cluster bootstraps, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delve.sources.stage import cut, numbered

METRICS = ("precision", "recall", "f1", "recall_at_5", "recall_at_10", "mrr")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_rankings(rankings: DataFrame, gold: DataFrame, by: list[str], k: Column | int = 5, first: str | None = None) -> DataFrame:
    """Metrics of each ranking.  rankings: by, ranking (array), and what k refers to; gold: by, gold (array).

    The first k entries are predicted, as a set; recall at 5 and 10 and the reciprocal rank look at the whole ranking.  Everything
    happens in arrays of one row, so the only shuffle is the join of rankings with gold.  For long rankings the array may end at the largest
    cut-off if the column `first` holds the rank, in the whole ranking, of the first entry of gold (null without one).
    """
    k = F.lit(k) if isinstance(k, int) else k
    rows = rankings.join(gold, by, "left").withColumn("gold", F.array_distinct(F.coalesce("gold", F.array().cast("array<string>"))))
    head = lambda n: F.when(n > 0, F.slice("ranking", 1, n)).otherwise(F.array().cast("array<string>"))
    found = lambda n: F.size(F.array_intersect(head(n), F.col("gold")))
    rows = rows.withColumns({"_predicted": F.size(F.array_distinct(head(k))), "_hit": found(k), "_gold": F.size("gold")})
    at = F.col(first) if first else F.array_position(F.transform("ranking", lambda p: F.array_contains("gold", p)), F.lit(True))
    rows = rows.withColumns({"precision": ratio(F.col("_hit"), F.col("_predicted")), "recall": ratio(F.col("_hit"), F.col("_gold"))})
    return rows.withColumns(
        {
            "f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            "recall_at_5": ratio(found(F.lit(5)), F.col("_gold")),
            "recall_at_10": ratio(found(F.lit(10)), F.col("_gold")),
            "mrr": F.when(at > 0, 1 / at.cast("double")).otherwise(0.0),
            "false_positives": F.col("_predicted") - F.col("_hit"),
        }
    ).drop("_predicted", "_hit", "_gold")


def set_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """precision, recall, true and false positives, misses and equality of two sets, for selecting."""
    hit = F.size(F.array_intersect(predicted, gold))
    n, m = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    return {"tp": hit, "fp": n - hit, "fn": m - hit, "precision": ratio(hit, n), "recall": ratio(hit, m), "exact": (hit == n) & (hit == m)}


def matched_k(rankings: DataFrame, lead: DataFrame, by: list[str]) -> DataFrame:
    """rankings with k: the number of predictions of lead (by, ranking) for the same keys, 0 kept; its own length where lead has none."""
    sizes = lead.select(*by, F.size("ranking").alias("lead_k"))
    return rankings.join(sizes, by, "left").withColumn("k", F.coalesce("lead_k", F.size("ranking"))).drop("lead_k")


def seed_means(runs: DataFrame, values: list[str], task: str = "task_id", system: str = "system", cluster: str | None = "repository") -> DataFrame:
    """One row for each task and system: the means over its seeds without nulls, and seed_runs."""
    own = [F.min(cluster).alias(cluster)] if cluster else []
    return runs.groupBy(task, system).agg(*own, F.count("*").alias("seed_runs"), *(F.avg(v).alias(v) for v in values))


def system_means(means: DataFrame, values: list[str], system: str = "system") -> DataFrame:
    """The mean over tasks of seed means: tasks weigh alike, however many seeds they have."""
    return means.groupBy(system).agg(F.count("*").alias("tasks"), *(F.avg(v).alias(v) for v in values))


def bootstrap_draws(clusters: DataFrame, samples: int, seed: int, cluster: str = "cluster") -> DataFrame:
    """sample, cluster, times: as many draws a sample as there are clusters, with replacement.

    A draw is the first 8 hex digits of md5(seed:sample:draw), mod the number of clusters in their order: the same in any engine.  The
    table has samples x clusters rows; clusters are numbered range by range, and no name comes to the driver.
    """
    names = cut(numbered(clusters.select(cluster).distinct(), "pick", cluster))
    spark, n = clusters.sparkSession, names.count()
    if not n:
        return spark.createDataFrame([], f"sample long, {cluster} {dict(clusters.dtypes)[cluster]}, times long")
    draws = spark.range(samples * n).select(F.expr(f"id div {n}").alias("sample"), (F.col("id") % n).alias("draw"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col("draw").cast("string"))
    pick = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n
    picked = draws.select("sample", pick.alias("pick")).groupBy("sample", "pick").agg(F.count("*").alias("times"))
    return picked.join(names, "pick").select("sample", cluster, "times")


def cluster_bootstrap(rows: DataFrame, value: str, samples: int = 1000, seed: int = 1729, cluster: str = "cluster", by: list[str] | None = None) -> DataFrame:
    """mean, ci_low, ci_high, n of value: all rows of a drawn cluster count, as often as it is drawn; linear percentiles 2.5 and 97.5.

    Rows shrink to a sum and a count a cluster before anything is drawn.
    """
    by = by or []
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    draws = bootstrap_draws(sums, samples, seed, cluster)
    each = draws.join(sums, cluster).groupBy(*by, "sample").agg((F.sum(F.col("times") * F.col("total")) / F.sum(F.col("times") * F.col("n"))).alias("mean"))
    limits = each.groupBy(*by).agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))
    whole = sums.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return whole.join(limits, by) if by else whole.crossJoin(F.broadcast(limits))


def paired_bootstrap(means: DataFrame, left: str, right: str, value: str, samples: int = 1000, seed: int = 1729, task: str = "task_id", system: str = "system", cluster: str = "cluster") -> DataFrame:
    """task_count, mean_difference, ci_low, ci_high, ci_excludes_zero of left minus right, over tasks that both have."""
    pick = lambda s: F.max(F.when(F.col(system) == s, F.col(value)))
    pairs = means.where(F.col(system).isin(left, right)).groupBy(task, cluster).agg(pick(left).alias("l"), pick(right).alias("r"))
    rows = pairs.where("l is not null and r is not null").select(cluster, (F.col("l") - F.col("r")).alias("difference"))
    out = cluster_bootstrap(rows, "difference", samples, seed, cluster)
    return out.select(F.col("n").alias("task_count"), F.col("mean").alias("mean_difference"), "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("ci_excludes_zero"))


def detection_rates(records: DataFrame, control: str = "control") -> DataFrame:
    """For each variant: rows that are applicable and not, and the share detected of the applicable (false alarms for the control)."""
    applies = F.coalesce("applicable", F.lit(True))
    return records.groupBy("variant").agg(
        F.count_if(applies).alias("applicable"),
        F.count_if(~applies).alias("inapplicable"),
        F.try_divide(F.count_if(applies & F.col("detected")).cast("double"), F.count_if(applies).cast("double")).alias("rate"),
    )


def adjudicated_precision(findings: DataFrame) -> DataFrame:
    """task_id, precision of findings (task_id, hit, label): hits and plausible misses over all; null while a miss has no label."""
    miss = ~F.col("hit")
    unlabelled = F.bool_or(miss & (F.coalesce("label", F.lit("")) == ""))
    good = F.count_if(F.col("hit") | (F.col("label") == "plausible"))
    return findings.groupBy("task_id").agg(F.when(~unlabelled, F.try_divide(good.cast("double"), F.count("*"))).alias("precision"))


def status_mix(runs: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """One row for each `by`, with a column of counts for each status."""
    return runs.groupBy(by).pivot(status, values).count().na.fill(0)


def reciprocal_test_scores(mapping: DataFrame, ranked: DataFrame) -> DataFrame:
    """test_path, score of the tests mapped to ranked sources (path, rank): one over the best rank, to 6 decimals."""
    best = mapping.join(ranked, mapping["source_path"] == ranked["path"]).groupBy("test_path").agg(F.min("rank").alias("best_rank"))
    return best.select("test_path", "best_rank", F.round(1 / F.col("best_rank"), 6).alias("score"))


def normalised_ranking(predictions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows of predictions (run, position from 1, path): only sources (path) stay, each once; the score is one over the original position."""
    marked = predictions.join(sources.select("path", F.lit(True).alias("known")), "path", "left")
    first = marked.groupBy("run", "path").agg(F.min("position").alias("first"))
    marked = marked.join(first, ["run", "path"])
    reason = F.when(F.col("known").isNull(), "not_a_source").when(F.col("position") > F.col("first"), "repeated")
    marked = marked.withColumn("reason", reason)
    return marked.where("reason is null").select("run", "path", "position", (1 / F.col("position")).alias("score")), marked.where("reason is not null").select("run", "path", "position", "reason")
