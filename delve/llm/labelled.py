"""Which labelled rows a model is fitted on, and the hashed features the models share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delve.llm.wordhash import LOWER, word_bounds, word_hashes

FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0: such rows are never learned from.  A null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def sample_ids(labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """doc_id and label of about `most` rows of each label value, those of smallest hashed id; and each value's rows in all.

    Held-out rows and null ids and labels are left out; of several labels of one id the largest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    return least_hashed(rows, counts, most), counts


def least_hashed(rows: DataFrame, counts: dict, most: int) -> DataFrame:
    """Of rows (doc_id, label) about `most` of each label, those of smallest hashed id; all, where a label has fewer.

    A label's share most / count of all hashes is taken, so no row is ranked and none is moved; the number differs from `most` as a
    binomial does, by a few times its square root.
    """
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    wanted = F.lit(0.0)
    for label, count in counts.items():
        wanted = F.when(F.col("label") == label, min(1.0, most / count)).otherwise(wanted)
    return rows.where(share <= wanted)


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen ids' text and label.  chosen is bounded by its maker, so it is broadcast and the texts stay where they are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def segment_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of values[first:last] for each pair; 0 where it is empty."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    last = np.maximum(first, last)
    return total[last] - total[first]


def gram_buckets(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n bytes (3 or 4) from each position on."""
    if len(raw) < n:
        return np.zeros(0, np.uint32)
    have = raw.astype(np.uint32)
    key = have[: len(raw) - n + 1].copy()
    for i in range(1, n):
        key |= have[i : len(raw) - n + 1 + i] << np.uint32(8 * i)
    key *= np.uint32(2654435761)
    key ^= key >> np.uint32(15)
    key *= np.uint32(2246822519 if n == 3 else 3266489917)
    return key >> np.uint32(32 - bits)


def families(raw: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, first, last) of each kind of feature: byte 3-grams and 4-grams, words, word pairs; each document's are first to last."""
    begin, end = offsets[:-1], offsets[1:]
    for n in (3, 4):
        yield gram_buckets(raw, n, bits), np.minimum(begin, max(0, len(raw) - n + 1)), np.minimum(np.maximum(begin, end - n + 1), max(0, len(raw) - n + 1))
    starts, ends = word_bounds(raw, begin)
    words = word_hashes(raw, starts, ends, fold=False)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    shift = np.uint64(64 - bits)
    odd = np.uint64(0x9FB21C651E98DF25)
    yield ((words * odd) >> shift), first, last
    pairs = (words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]) * odd if len(words) > 1 else words[:0]
    yield (pairs >> shift), np.minimum(first, len(pairs)), np.minimum(np.maximum(first, last - 1), len(pairs))


#: Bytes of the word beginnings that are features beside the whole words.
BEGINNINGS = range(4, 10)


def word_features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each lower-cased word and of its beginnings."""
    low = LOWER[raw]
    starts, ends = word_bounds(low, offsets[:-1])
    owner = np.searchsorted(offsets[1:], starts, side="right")
    shift, odd = np.uint64(64 - bits), np.uint64(0x9FB21C651E98DF25)
    docs, buckets = [owner], [(word_hashes(low, starts, ends, fold=False) * odd) >> shift]
    sums = np.zeros(len(starts), np.uint64)
    for n in range(1, BEGINNINGS.stop):
        longer = ends - starts > n  # a word as long as this is there already
        starts, ends, owner, sums = starts[longer], ends[longer], owner[longer], sums[longer]
        sums = (sums ^ low[starts + n - 1]) * np.uint64(0x100000001B3)
        if n in BEGINNINGS:
            mixed = (sums ^ (sums >> np.uint64(32))) * odd
            docs.append(owner)
            buckets.append(((mixed ^ (mixed >> np.uint64(29))) * odd) >> shift)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def distinct_pairs(doc: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (document, bucket) once, in order of document."""
    key = np.unique((doc.astype(np.int64) << bits) | bucket)
    return key >> bits, key & ((1 << bits) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
