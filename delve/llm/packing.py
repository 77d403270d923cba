"""Vector best-fit packing of documents into sequences.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared piece lengths).  Pieces are
placed longest first; of the open sequences that can take a piece under every capacity, the one with the largest score wins:

* `norm`: least weighted norm of what would remain of the capacities (tightest fit);
* `dot`: largest weighted dot product of the piece's demands and what remains of the capacities.

Pieces are dealt into groups of bounded size by a hash of their row, so that each group has the whole mix of lengths; a group is
packed in one task and leaves at most about one sequence partly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import materialise, table, texts
from delve.llm.tokens import default_file, encoder

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """Capacities of a sequence (documents and attention: None for no bound beyond the tokens'), their weights and the score."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


#: Pieces of a group, on average.
GROUP_PIECES = 4096


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece.  Ties: the longer piece first, then the earlier; the older sequence."""
    cap, weights = capacity.vector, np.array(capacity.weights)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, n + 1))  # of each open sequence, as a share of the capacity
    name, used = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    opened = made = 0
    least = lengths.min() / cap[0] if n else 0
    demands = np.stack([lengths / cap[0], np.full(n, 1 / cap[1]), np.asarray(lengths, np.float64) ** 2 / cap[2]])
    for i in np.argsort(-lengths, kind="stable"):
        need = demands[:, i]
        after = left[:, :opened] - need[:, None]
        fits = (after >= -1e-12).all(axis=0)
        if fits.any():
            value = -(weights @ after**2) if capacity.score == "norm" else (weights * need) @ left[:, :opened]
            k = int(np.argmax(np.where(fits, value, -np.inf)))
        else:
            k = opened
            left[:, k], name[k], used[k] = 1.0, made, 0
            opened, made = opened + 1, made + 1
        bins[i], offsets[i] = name[k], used[k]
        used[k] += lengths[i]
        left[:, k] -= need
        if (left[:, k] < (least, 1 / cap[1], least * least * cap[0] ** 2 / cap[2]) - np.array(1e-12)).any():  # takes no piece any more
            last = opened - 1
            left[:, k : last] = left[:, k + 1 : opened]
            name[k:last], used[k:last] = name[k + 1 : opened], used[k + 1 : opened]
            opened = last
    return bins, offsets


def pieces(docs: DataFrame, file: str, capacity: Capacity, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document's ids and end id; only documents over the longest possible piece are cut."""
    longest = min(capacity.tokens, int((capacity.attention or capacity.tokens**2) ** 0.5))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = encoder(file).encode(texts(batch.column("text")))
            at = np.concatenate([[0], np.cumsum(counts)])
            rows: list[tuple] = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), longest)):
                    part = own[start : start + longest]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def pack(docs: DataFrame, file: str, capacity: Capacity = Capacity(), end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed as often as they come; an empty table gives no row; other
    columns of docs are ignored.
    """
    cut = materialise(pieces(docs, file, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = (int(key[0]) << 32) + bins, offsets
        return rows.drop(columns=["row", "group"])

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens; documents and attention are bounded by the tokens alone."""
    return pack(table(spark, sf_dir, "documents"), default_file())
