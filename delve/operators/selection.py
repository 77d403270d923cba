"""Deterministic selections and schedules."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delve.sources.stage import numbered


def round_robin(rows: DataFrame, bucket: str, order: list[str], buckets: list | None = None, limit: int | None = None) -> DataFrame:
    """rows with turn (place in its bucket), taken bucket by bucket in turns; buckets: their order, else their own.  With a limit no bucket
    gives more rows than that, and none ranks more."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    place = F.array_position(F.array(*map(F.lit, buckets)), F.col(bucket)) if buckets else F.col(bucket)
    out = rows.withColumn("turn", turn)
    out = (out.where(F.col("turn") <= limit) if limit else out).orderBy("turn", place, *order)
    return out.limit(limit) if limit else out


def capped_round_robin(rows: DataFrame, buckets: list[str], target: int, cap: int, bucket: str = "bucket", group: str = "repository", key: str = "id") -> DataFrame:
    """Turns over buckets, skipping rows of a group that has been taken cap times; the caps bind all buckets together.

    A row past the cap-th of its bucket and group can never be taken.  Of the rest of a bucket at most `target` are taken, and at most `target`
    skipped: a skipped row's group has been taken cap times, there are at most target / cap such groups, and each has cap rows here.  So
    the first 2 x target rows of each bucket decide, and these alone meet in the greedy pass, which is sequential.
    """
    rank = F.row_number().over(Window.partitionBy(bucket, group).orderBy(key))
    small = rows.where(F.col(bucket).isin(buckets)).withColumn("n", rank).where(F.col("n") <= cap).drop("n")
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(group, key))
    small = small.withColumn("n", place).where(F.col("n") <= 2 * target).drop("n")

    def greedy(data: pd.DataFrame) -> pd.DataFrame:
        queues = {b: deque(data[data[bucket] == b].sort_values([group, key]).index) for b in buckets}
        taken: list = []
        seen: dict = {}
        while len(taken) < target:
            before = len(taken)
            for b in buckets:
                while queues[b] and len(taken) < target:
                    i = queues[b].popleft()
                    g = data.at[i, group]
                    if seen.get(g, 0) < cap:
                        seen[g] = seen.get(g, 0) + 1
                        taken.append(i)
                        break
            if len(taken) == before:
                break
        return data.loc[taken]

    one = small.withColumn("_all", F.lit(0))
    return one.groupBy("_all").applyInPandas(lambda data: greedy(data.drop(columns="_all")), small.schema)


def _with_seed(seed: int):
    return lambda s: F.struct(s.alias("system"), F.lit(seed).cast("int").alias("seed"))


def rotated_schedule(tasks: DataFrame, plain: list[str], rotated: list[str], seeds: list[int], key: str = "task_id") -> DataFrame:
    """position, task, system, seed: for each task its plain systems, then for each seed the others, rotated by the task's and seed's places."""
    n = len(rotated)
    places = numbered(tasks.select(key).distinct(), "place", key)
    fixed = F.transform(F.array(*map(F.lit, plain)), lambda s: F.struct(s.alias("system"), F.lit(None).cast("int").alias("seed")))
    parts = [fixed]
    for j, seed in enumerate(seeds):
        names = F.array(*map(F.lit, rotated))
        begin = ((F.col("place") + j) % n).cast("int")
        turned = F.concat(F.slice(names, begin + 1, n), F.slice(names, F.lit(1), begin))
        parts.append(F.transform(turned, _with_seed(seed)))
    each = places.select(key, "place", F.posexplode(F.concat(*parts)).alias("step", "x"))
    return each.select((F.col("place") * (len(plain) + n * len(seeds)) + F.col("step")).cast("long").alias("position"), key, "x.system", "x.seed")


def diverse_by_file(hits: DataFrame, limit: int, skip: Column | None = None) -> DataFrame:
    """hits (path, position) in turns over files in order of their first hit."""
    rows = hits.where(~skip) if skip is not None else hits
    own = Window.partitionBy("path")
    rows = rows.withColumns({"turn": F.row_number().over(own.orderBy("position")), "first": F.min("position").over(own)})
    return rows.orderBy("turn", "first").limit(limit).drop("first")
