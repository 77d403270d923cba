"""Spark data source `journal`: an append-only log of hash-chained records in segment files.

    rows.select("sequence", "payload")...; append(rows, path)
    spark.read.format("journal").load(path)      # sequence, previous, payload, sha256, segment

A write reads the log's tail first and goes on from there: one task chains the new records in order, in a stream, into a file that no reader
sees.  The commit looks at the tail again and links the file under the name of its first sequence, which fails if it is taken: of two
writers from one tail one gets the name, the other's write fails and leaves nothing.  A write in batches makes a segment of each, one going on from the other, and links them in order.  Files appear whole or not at all, and a reader
refuses one that is torn all the same.  The folder must be one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

START = "0" * 64
#: A record's payload has so many bytes at most.
RECORD_BYTES = 2 << 20
_SEGMENT = re.compile(r"segment-(\d{18})\.jsonl")


class JournalError(ValueError):
    """The log cannot be read or gone on with; the first word says why."""


@dataclass(frozen=True)
class Tail:
    """The sequence that comes next, and the hash that it follows."""

    sequence: int = 0
    sha256: str = START


def folder(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def segments(path: str) -> list[str]:
    """The names of the segments, in order."""
    return sorted(filter(_SEGMENT.fullmatch, os.listdir(path) if os.path.isdir(path) else []))


_json = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def line_of(sequence: int, previous: str, payload: str) -> tuple[str, str]:
    """A record as a line, and its hash."""
    sha256 = hashlib.sha256(f"{previous}\n{payload}".encode()).hexdigest()
    return _json({"sequence": sequence, "previous": previous, "payload": payload, "sha256": sha256}) + "\n", sha256


def end_of(rows: int, sha256: str) -> str:
    """The last line of a segment, without which it is torn."""
    return json.dumps({"rows": rows, "last": sha256}, separators=(",", ":")) + "\n"


def records(file: str) -> Iterator[dict]:
    """The records of a segment, one after the other; a torn or altered one is an error."""
    name = os.path.basename(file)
    first, rows, previous, ended = int(_SEGMENT.fullmatch(name)[1]), 0, None, False
    with open(file, "rb") as f:
        for line in f:
            if ended or (line.startswith(b'{"rows":') and line == end_of(rows, previous or "").encode()):
                if ended:
                    raise JournalError(f"torn_or_altered after the end of {name}")
                ended = True
                continue
            try:
                record = json.loads(line)
                own, sha256 = line_of(record["sequence"], record["previous"], record["payload"])
                whole = line == own.encode() and sha256 == record["sha256"]
            except (ValueError, KeyError, TypeError):
                whole = False
            if not whole:
                raise JournalError(f"torn_or_altered record in {name}")
            if record["sequence"] != first + rows or previous not in (None, record["previous"]):
                raise JournalError(f"broken_link at {first + rows} in {name}")
            yield record
            previous, rows = record["sha256"], rows + 1
    if not ended:
        raise JournalError(f"torn_or_altered: {name} has no end")


def tail(path: str) -> Tail:
    """From the last segment alone, which is read whole and checked."""
    found = segments(path)
    if not found:
        return Tail()
    for record in records(os.path.join(path, found[-1])):
        pass
    return Tail(record["sequence"] + 1, record["sha256"])


@dataclass
class _Written(WriterCommitMessage):
    #: The first sequence and the file of each segment, in order.
    staged: list[tuple[int, str]]


class JournalWriter(DataSourceWriter):
    def __init__(self, path: str, batch: int | None = None):
        self.path = path
        self.batch = batch  # rows of a segment; all of a write if None
        os.makedirs(path, exist_ok=True)
        self.tail = tail(path)  # a torn log is refused before anything is written
        self.staged = os.path.join(path, f"_staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        at, done = self.tail, []
        first = next(iterator, None)
        while first is not None:
            file = f"{self.staged}-{uuid.uuid4().hex}"
            done.append((at.sequence, file))
            at, first = self._segment(file, at, first, iterator)
        return _Written(done)

    def _segment(self, file: str, at: Tail, first: Row | None, iterator: Iterator[Row]) -> tuple[Tail, Row | None]:
        """Write a segment that goes on from at, of first and what follows; the tail it leaves and the first row behind it."""
        sequence, previous, rows = at.sequence, at.sha256, 0
        with open(file, "x", encoding="utf-8") as f:
            while first is not None and rows != self.batch:
                if first["sequence"] != sequence:
                    raise JournalError(f"sequence_gap: {first['sequence']} came where the log expects {sequence}")
                payload = first["payload"] or ""
                if len(payload.encode()) > RECORD_BYTES:
                    raise JournalError(f"record_size at {sequence}")
                line, previous = line_of(sequence, previous, payload)
                f.write(line)
                sequence, rows, first = sequence + 1, rows + 1, next(iterator, None)
            f.write(end_of(rows, previous))
            f.flush()
            os.fsync(f.fileno())
        return Tail(sequence, previous), first

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m and m.staged]
        try:
            if len(done) > 1:
                raise JournalError("several_tasks: a log is written by one task; use append()")
            if done:
                if tail(self.path) != self.tail:
                    raise JournalError("tail_moved: another writer has gone on with the log")
                # the first sequence is the name: whoever links it has the log's next place
                try:
                    for sequence, staged in done[0].staged:
                        os.link(staged, os.path.join(self.path, f"segment-{sequence:018d}.jsonl"))
                except FileExistsError:
                    raise JournalError("tail_moved: another writer has taken the log's next place") from None
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing of a write that failed stays, but for what a task that is being killed still writes: no reader sees it."""
        own = os.path.basename(self.staged)
        for name in os.listdir(self.path):
            if name.startswith(own):
                os.unlink(os.path.join(self.path, name))


@dataclass
class _Segment(InputPartition):
    file: str


class JournalReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Segment(os.path.join(self.path, name)) for name in segments(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, _Segment):  # an empty log
            return
        for r in records(partition.file):
            yield r["sequence"], r["previous"], r["payload"], r["sha256"], os.path.basename(partition.file)


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return "sequence long, previous string, payload string, sha256 string, segment string"

    def reader(self, schema) -> DataSourceReader:
        return JournalReader(folder(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise JournalError("append_only: a log is never written over")
        batch = self.options.get("batch")
        return JournalWriter(folder(self.options["path"]), int(batch) if batch else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JournalSource)


def append(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Append rows (sequence, payload) to the log at path: all of them or, with an error, none.  Their sequences must go on from the log's without a gap; null payloads count as empty.

    batch: make a segment of each so many rows, as appends one after the other would, in one write.  All are written before the first is
    committed; if another writer comes between the commits, the batches before its own stay and the rest is an error.
    """
    if batch is not None and batch < 1:
        raise ValueError("a batch has a row at least")
    register(rows.sparkSession)
    own = rows.select(F.col("sequence").cast("long").alias("sequence"), F.lit(None).cast("string").alias("previous"), "payload", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("segment"))
    writer = own.repartition(1).sortWithinPartitions("sequence").write.format("journal").mode("append").option("path", folder(path))
    (writer.option("batch", batch) if batch else writer).save()


def load(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("journal").option("path", folder(path)).load()
