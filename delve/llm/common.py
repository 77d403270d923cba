"""Helpers the training-data operators share: tables, the shared folder, Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass looks at; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Records and bytes of an Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS, BATCH_BYTES = 500, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; text batches sent to Python are kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shared(spark: SparkSession) -> None:
    """Delete the folders that shared_dir() has given out, once no result that reads them is wanted any more."""
    while _made:
        delete_folder(spark, _made.pop())


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which all executors share.

    Where the session names none (tests, a local run) a temporary folder is set as checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="delve-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    _made.append(f"{base.rstrip('/')}/delve-{uuid.uuid4().hex}")
    return _made[-1]


#: Spark's own bound (spark.sql.sources.bucketing.maxBuckets); beyond it buckets grow, and are streamed all the same.
MOST_BUCKETS = 100_000


def bucketed(df: DataFrame, parts: int, column: str) -> tuple[DataFrame, str, str]:
    """Write df as a table of so many buckets by column in the shared folder, so that joins on it leave its rows where they are: (table, name, path)
    for drop_bucketed()."""
    spark = df.sparkSession
    name, path = f"delve_{uuid.uuid4().hex}", f"{shared_dir(spark)}/buckets"
    df.write.bucketBy(min(parts, MOST_BUCKETS), column).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def drop_bucketed(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    delete_folder(spark, path)


def materialise(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, int64) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def spans_of_rows(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most limit bytes each, or of a single longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche, for hashed indexes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
