"""Benchmark decontamination by word n-grams.

The windows of all benchmark items become a broadcast set of hashes, checked against a size bound; training texts are scanned once, each
window's hash is looked up, and a hit is verified word for word.  A benchmark over the bound is dealt into slices that are
scanned one after the other, each scan written before the next, so that no task holds more than one set.  A set takes 24 bytes a window beside the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from delve.llm.common import materialise, spans_of_rows, table, utf8
from delve.llm.wordhash import LOWER, window_hashes, word_bounds, word_hashes

WINDOW = 13
#: Contaminated: hit words times this are at least the words.
SHARE = 20
#: Bytes of benchmark text in one broadcast set.
SLICE_BYTES = 16 << 20


class Windows:
    """The windows of some items, in arrays: for each size a bit filter, sorted hashes, and for each window its item and where it stands
    in the items' lower-cased words, which are kept once, joined by blanks."""

    def __init__(self, items: list[tuple[object, bytes]], n: int = WINDOW):
        self.items = [str(i) for i, _ in items]
        kept: list[bytes] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        at = 0
        for k, (_, raw) in enumerate(items):
            raw = LOWER[np.frombuffer(raw, np.uint8)]
            starts, ends = word_bounds(raw)
            if not len(starts):
                continue
            size = min(n, len(starts))
            hashes = window_hashes(word_hashes(raw, starts, ends, fold=False), size)
            length = ends - starts
            first = at + np.cumsum(length + 1) - (length + 1)
            kept.append(_joined_words(raw, starts, ends) + b" ")
            at += len(kept[-1])
            place = np.arange(len(hashes))
            found.setdefault(size, []).append((hashes, np.full(len(hashes), k, np.int32), first[place], first[place + size - 1] + length[place + size - 1]))
        self.text = b"".join(kept)
        self.by_size = {}
        for size, parts in found.items():
            hashes, owner, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = (bits, hashes[order], owner[order], begin[order], end[order])

    def hits(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of each verified window of lower-cased raw; owner: the document of each word."""
        words = word_hashes(raw, starts, ends, fold=False)
        for size, (bits, known, items, begin, end) in self.by_size.items():
            hashes = window_hashes(words, size)
            at = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
            at = at[owner[at] == owner[at + size - 1]]
            if not len(at):
                continue
            first, last = np.searchsorted(known, hashes[at]), np.searchsorted(known, hashes[at], side="right")
            for k, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                if a == b:
                    continue
                text = _joined_words(raw, starts[k : k + size], ends[k : k + size])
                own = [self.items[items[x]] for x in range(a, b) if end[x] - begin[x] == len(text) and self.text[begin[x] : end[x]] == text]
                if own:
                    yield k, size, own


def _joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    first = starts[0] if len(starts) else 0
    text = raw[first : ends[-1] if len(ends) else 0].tobytes()
    return b" ".join([text[a:b] for a, b in zip((starts - first).tolist(), (ends - first).tolist(), strict=True)])


_FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]


def _scanner(windows: Windows, prefix: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            n = len(offsets) - 1
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            spans: list[list[int]] = [[] for _ in range(n)]
            items: list[list[str]] = [[] for _ in range(n)]
            before = {}  # what earlier slices of the benchmark have hit
            if f"{prefix}hit_spans" in batch.schema.names:
                rows = zip(batch.column(f"{prefix}hit_spans").to_pylist(), batch.column(f"{prefix}items").to_pylist(), strict=True)
                before = {i: (a, b) for i, (a, b) in enumerate(rows) if a}
            for first, last in spans_of_rows(offsets):
                raw = LOWER[data[offsets[first] : offsets[last]]]
                own = offsets[first : last + 1] - offsets[first]
                starts, ends = word_bounds(raw, own[:-1])
                owner = np.searchsorted(own[1:], starts, side="right")
                n_words[first:last] = np.bincount(owner, minlength=last - first)
                cover = np.zeros(len(starts) + 1, np.int64)
                found: dict[int, set] = {}
                for k, size, ids in windows.hits(raw, starts, ends, owner):
                    cover[k] += 1
                    cover[k + size] -= 1
                    found.setdefault(int(owner[k]), set()).update(ids)
                for d in range(first, last) if before else ():
                    if d in before:
                        edges = np.array(before[d][0]) + own[d - first]
                        np.add.at(cover, np.searchsorted(starts, edges[::2]), 1)
                        np.add.at(cover, np.searchsorted(starts, edges[1::2]), -1)
                        found.setdefault(d - first, set()).update(before[d][1])
                if found:
                    hit = np.cumsum(cover[:-1]) > 0
                    n_hit[first:last] = np.bincount(owner[hit], minlength=last - first)
                    for d, ids in found.items():
                        items[first + d] = sorted(map(str, ids))
                        mine = np.flatnonzero(hit & (owner == d))
                        runs = np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1)
                        spans[first + d] = [int(x) for r in runs for x in (starts[r[0]] - own[d], ends[r[-1]] - own[d])]
            made = [prefix + x for x, _ in _FIELDS]
            keep = [x for x in batch.schema.names if x not in made]
            new = [pa.array(n_words), pa.array(n_hit), pa.array(spans, _FIELDS[2][1]), pa.array(items, _FIELDS[3][1])]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *new], [*keep, *made])

    return scan


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items with words, in slices of bounded size; a larger item is a slice of its own."""
    held, size = [], 0
    for r in benchmark.select("item_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("raw")).where("raw is not null").toLocalIterator():
        if held and size + len(r.raw) > slice_bytes:
            yield held
            held, size = [], 0
        held.append((r.item_id, bytes(r.raw)))
        size += len(r.raw)
    yield held


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slice_bytes: int = SLICE_BYTES, prefix: str = "") -> DataFrame:
    """docs with n_words, n_hit, hit_spans (byte offsets: start, end, start, …) and items (occurring item_ids as strings, sorted).

    Null and empty texts have no words and no hits; items without words have no window; an empty benchmark hits nothing.  Columns of
    docs that have one of these names are left out; prefix goes before the names of the new columns.
    """
    docs = docs.drop(*(prefix + x for x, _ in _FIELDS))
    new = [StructField(f"{prefix}n_words", LongType()), StructField(f"{prefix}n_hit", LongType())]
    new += [StructField(f"{prefix}hit_spans", ArrayType(LongType())), StructField(f"{prefix}items", ArrayType(StringType()))]
    fields = StructType([*docs.schema.fields, *new])
    scan_with = lambda df, w: df.mapInArrow(lambda batches: _scanner(w.value, prefix)(batches), fields)
    for k, items in enumerate(_slices(benchmark, slice_bytes)):
        if k:  # one set at a time: the scan of the slice before ends here
            docs = materialise(docs, "scanned")
        docs = scan_with(docs, docs.sparkSession.sparkContext.broadcast(Windows(items, n)))
    return docs


def remove_spans(docs: DataFrame) -> DataFrame:
    """docs of scan() with every hit span cut out of text."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows["text"] = [_without(t, s) for t, s in zip(rows["text"], rows["hit_spans"], strict=True)]
            yield rows

    return docs.mapInPandas(cut, docs.schema)


def _without(text: str | None, spans: list[int]) -> str | None:
    if text is None or not len(spans):
        return text
    raw, at, out = text.encode(), 0, []
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (F.col(n_hit) * SHARE >= F.col(n_words))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc_id"),
        F.col("n_words"),
        F.col("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


