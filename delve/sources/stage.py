"""Cutting the lineage of iterative plans, and numbering rows without one task for all of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_dir(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder that the session names; a temporary one takes its place only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="delve-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/delve-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder: a lost executor costs no more than the stage at hand."""
    path = f"{stage_dir(df.sparkSession)}/stage"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with name, the place of each row in that order, from 0 on: ranges are sorted apart, and only their sizes meet on the driver."""
    row = f"_{name}"
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    part, before, starts = F.shiftright(row, 33), 0, []
    for r in ranges.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r.part, before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, f"_part long, {name} long")
    placed = ranges.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col(name) + F.col(row).bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.drop(row, "_part")
