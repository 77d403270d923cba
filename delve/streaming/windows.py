"""Event-time windows, the same plan in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.sources.stage import stage_dir


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """events with ts as a timestamp of the session's zone; watermarks do not take timestamps without one."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of each (sliding) window; value is summed in hundredths, so that the order of rows does not matter."""
    rows = event_time(events).withWatermark("ts", late) if events.isStreaming else event_time(events)
    out = rows.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.unix_micros("window.start").alias("window_start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end (micros), n of each session."""
    rows = event_time(events).withWatermark("ts", late) if events.isStreaming else event_time(events)
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("session_start"), F.unix_micros("session_window.end").alias("session_end"), "n")


def run_available(spark: SparkSession, source: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Run plan over all that the stream source has now, and return its result, a table in the shared folder: written anew by each batch in
    complete mode, batch by batch in append mode (a batch that is run again replaces its part)."""
    folder, result = stage_dir(spark), plan(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result" + ("" if mode == "complete" else f"/batch={number}"))

    writer = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(result.schema).parquet(f"{folder}/result").select(*result.columns)
    except AnalysisException:  # no batch came
        return spark.createDataFrame([], result.schema)
