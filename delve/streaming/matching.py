"""Requests and responses matched as a stream: an outer join of two streams, each with its watermark, so that its state is bounded in time.

A request (run_id, kind, at) meets the responses (run_id, status, at) from its own time on until within has passed.  Once both streams are past that
time, a request without response comes out with a null status.  In batch the same plan gives the same rows.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from delve.sources.stage import stage_dir

#: A time after all others: rows at it close a stream, so that all before them is settled.
CLOSING = "9999-01-01 00:00:00"


def matched(requests: DataFrame, responses: DataFrame, within: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """run_id, kind, status of each request and each of its responses; status is null where none came in time.

    Requests without run_id or time are nobody's and are left out, as are such responses; several responses of one request are several rows.
    """
    left = requests.select("run_id", "kind", F.col("at").cast("timestamp").alias("asked")).where("run_id is not null and asked is not null")
    right = responses.select(F.col("run_id").alias("own"), "status", F.col("at").cast("timestamp").alias("answered")).where("own is not null and answered is not null")
    if requests.isStreaming:
        left, right = left.withWatermark("asked", late), right.withWatermark("answered", late)
    near = (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"interval {within}"))
    return left.join(right, (F.col("run_id") == F.col("own")) & near, "left").where(F.col("asked") < F.lit(CLOSING).cast("timestamp")).select("run_id", "kind", "status")


def closed(stream: DataFrame, closing: DataFrame) -> DataFrame:
    """stream with the rows of another one, of the same columns, that ends it: a row at CLOSING."""
    return stream.unionByName(closing)


def closing_stream(like: DataFrame, time: str = "at", key: str = "run_id") -> DataFrame:
    """A stream of one row at CLOSING, in the columns of like; its key is that of no other row: text is empty, a number the least."""
    spark, kinds = like.sparkSession, dict(like.dtypes)
    folder = f"{stage_dir(spark)}/closing"
    own = F.lit("") if kinds[key] == "string" else F.lit(-(1 << 31)).cast(kinds[key])
    cols = [F.lit(CLOSING).cast("timestamp").alias(c) if c == time else own.alias(c) if c == key else F.lit(None).cast(kinds[c]).alias(c) for c in like.columns]
    spark.range(1).select(*cols).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(like.schema).parquet(folder)


class _Late(StreamingQueryListener):
    """Adds up the rows that a query has dropped for being behind its watermark."""

    def __init__(self) -> None:
        self.query, self.rows, self.done = None, 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.query:
            self.rows += sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.query:
            self.done.set()


def run_matched(spark: SparkSession, plan: Callable[[], DataFrame], folder: str | None = None) -> tuple[DataFrame, int]:
    """What plan, a streaming plan, appends over all that its sources have now, and how many late rows it dropped.

    The result is a table in folder (or the session's shared one), batch by batch; a folder that is given again goes on where its last run ended,
    and a batch that is run again replaces its part.
    """
    folder = folder or stage_dir(spark)
    result, late = plan(), _Late()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    spark.streams.addListener(late)
    try:
        writer = result.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/state")
        query = writer.trigger(availableNow=True).start()
        late.query = str(query.runId)
        query.awaitTermination()
        late.done.wait(30)
    finally:
        spark.streams.removeListener(late)
    try:
        return spark.read.schema(result.schema).parquet(f"{folder}/result").select(*result.columns), late.rows
    except AnalysisException:  # no batch came
        return spark.createDataFrame([], result.schema), late.rows
