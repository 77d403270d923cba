"""Exact removal of repeated byte strings across documents, by merging Burrows-Wheeler transforms.

Every string of `length` bytes has one anchor: the least hash among its short grams, the leftmost of equal ones.  Consecutive strings
with one anchor gram are a run; equal strings have equal anchors, at one distance from their start.  Documents travel once, into a table
of batches that is bucketed by batch number; the passes over it join what they need without moving the texts again.

1. Each batch sends its anchors with a hash of their runs.  An anchor that one document has is settled: its strings are in no other.
2. Each batch sends the runs of the other anchors, dealt into buckets by anchor.  Where runs of different bytes may meet, a batch's runs
   in a bucket are a shard: the batch sorts their suffixes and sends their Burrows-Wheeler transform.  Where all runs of an anchor seem to be equal,
   their bytes are sent instead.  The bucket compares those bytes, and merges the transforms (see bwt_merge) into the intervals of substrings
   that several documents share; an interval's least doc_id is what each of its strings is held against.
3. What was found returns to the documents as a bit for each string.

Hashes decide only who meets whom; what is equal is found from bytes.  An anchor with more runs than a bucket should hold is split: each
of its strings becomes a run of its own, dealt by a hash of all its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.bwt_merge import load, repeats, sorted_order, transform
from delve.llm.common import bucketed, drop_bucketed, materialise, mix, spans_of_rows, table, utf8

LENGTH = 50
#: Bytes of a gram; a string of 50 bytes has 35 of them.
GRAM = 16
#: Bytes of the documents of a batch, and about the bytes of documents of a bucket.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Bytes of strings whose suffixes are sorted at once, and strings looked at at once: few, so that their numbers stay in a core's cache.
SHARD_BYTES, PIECE = 2 << 20, 1 << 15
#: Runs of one anchor, over all batches, from which on it is split.
HOT_RUNS = 20_000
#: Bytes of documents of a bucket of the batch table.
PART_BYTES = 64 << 20
#: A row without doc_id comes after all others.
NO_ID = np.iinfo(np.int64).max

_BYTE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BATCH = "batch long, ids binary, lengths binary, n_bytes long, data binary"
_SENT = "bucket int, batch long, payload binary"
_MARK = "batch long, kind int, bucket int, bits binary"


def _batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    data: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal made, size
        joined = [np.concatenate(x) for x in (ids, lengths, data)]
        row = {"batch": (part << 33) + made, "ids": joined[0].tobytes(), "lengths": joined[1].tobytes(), "n_bytes": len(joined[2]), "data": joined[2].tobytes()}
        made, size = made + 1, 0
        for x in (ids, lengths, data):
            x.clear()
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("batch", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("n_bytes", pa.int64()), ("data", pa.binary())]))

    for batch in batches:
        own = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        offsets, raw = utf8(batch.column("text"))
        for a, b in spans_of_rows(offsets):
            ids.append(own[a:b])
            lengths.append(np.diff(offsets[a : b + 1]))
            data.append(raw[offsets[a] : offsets[b]])
            size += int(offsets[b] - offsets[a])
            if size >= most:
                yield flush()
    if ids:
        yield flush()


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    h, size = np.take(_BYTE, raw), 1
    while size < GRAM:
        last = h[size:]
        h = h[:-size] * np.uint64(pow(0xD6E8FEB86659FD93, size, 1 << 64))
        h += last
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


def anchor_at(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` hashes in a row is, by their high bits, the leftmost of equal ones."""
    # bits of a position; the rest are the hash's, as many for any piece, so that equal strings have equal anchors
    bits, word = (16, np.uint32) if PIECE + width <= 1 << 16 else (24, np.uint64)
    key = (h >> np.uint64(64 - 8 * word().itemsize)).astype(word) >> word(bits) << word(bits) | np.arange(len(h), dtype=word)
    size, n = 1, len(h) - width + 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[:n], key[width - size : width - size + n])
    return (key & word((1 << bits) - 1)).astype(np.int64)


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of each, end to end."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from a and from b on are equal (no size is 0)."""
    if not len(a):
        return np.zeros(0, bool)
    differ = gathered(data, a, size) != gathered(data, b, size)
    return np.add.reduceat(differ, np.cumsum(size) - size, dtype=np.int64) == 0


class Batch:
    """A batch's documents and runs: doc (row), start (in data), count (strings), shift (of the anchor gram from start), anchor, hash."""

    def __init__(self, row: dict, length: int):
        if length < GRAM:
            raise ValueError(f"length must be at least {GRAM}")
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.length = length
        found = [x for a, b in spans_of_rows(self.offsets) for x in self._runs(a, b)]
        none = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2]
        self.doc, self.start, self.count, self.shift, self.anchor, self.hash = (np.concatenate(x) for x in zip(*(found or none), strict=True))

    def _runs(self, a: int, b: int) -> Iterator[tuple[np.ndarray, ...]]:
        width = self.length - GRAM + 1
        last = int(self.offsets[b]) - self.length  # the last start of a string
        stop = self.offsets[a + 1 : b + 1]
        for begin in range(int(self.offsets[a]), last + 1, PIECE):
            raw = self.data[begin : min(begin + PIECE, last + 1) + self.length - 1]
            h = gram_hashes(raw)
            at = anchor_at(h, width)
            ends = stop[(stop >= begin) & (stop < begin + len(raw) + self.length)] - begin
            whole = np.zeros(len(at) + 1, np.int32)  # strings that would cross a document's end are left out
            np.add.at(whole, np.clip(ends - self.length + 1, 0, len(at)), 1)
            np.add.at(whole, np.clip(ends, 0, len(at)), -1)
            starts = np.flatnonzero(np.cumsum(whole[:-1]) == 0)
            if not len(starts):
                continue
            at = at[starts]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
            count = np.diff(np.r_[new, len(starts)])
            start, gram = starts[new], at[new]
            final = start + count + self.length - 1 - GRAM
            value = h[start] ^ (count.astype(np.uint64) << np.uint64(8)) ^ (gram - start).astype(np.uint64)
            for k in range(GRAM, 2 * self.length, GRAM):
                value = value * _ODD + h[np.minimum(start + k, final)]
            doc = a + np.searchsorted(stop, start + begin, side="right")
            yield doc, start + begin, count, gram - start, mix(h[gram] * _ODD), mix(value)

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors in order, and for each: 24 bits of its runs' hash, 1 bit if several documents have it, 1 bit if its runs
        differ, 6 bits with the logarithm of their number."""
        if not len(self.anchor):
            return self.anchor, np.zeros(0, np.uint32)
        order = sorted_order(self.anchor)
        v, ids, h = self.anchor[order], self.ids[self.doc][order], self.hash[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        differ = np.minimum.reduceat(h, first) != np.maximum.reduceat(h, first)
        size = np.where(differ, np.log2(np.diff(np.r_[first, len(v)])), 0).astype(np.uint32)
        return v[first], (h[first] >> np.uint64(40)).astype(np.uint32) << np.uint32(8) | several.astype(np.uint32) << np.uint32(7) | differ.astype(np.uint32) << np.uint32(6) | size

    def distinct(self) -> np.ndarray:
        """The distinct anchors in order."""
        values = np.sort(self.anchor)
        return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values

    def keep(self, values: np.ndarray, marks: np.ndarray) -> None:
        """Go on with the runs of the anchors (values: distinct()) that marks (shared, alike, hot of each) has as shared; hot ones are split."""
        shared, alike, hot = marks
        order = sorted_order(self.anchor)
        v, at = self.anchor[order], np.empty(len(order), np.int64)
        at[order] = np.cumsum(np.concatenate([[False], v[1:] != v[:-1]])[: len(v)])  # of values
        chosen = shared[at] if len(values) else np.zeros(0, bool)
        self._take(chosen)
        at = at[chosen]
        self.alike = alike[at]
        split = hot[at]
        if not split.any():
            return
        rest, own = np.flatnonzero(~split), np.flatnonzero(split)
        n = self.count[own]
        of = np.repeat(own, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.start[of] + step
        words = np.zeros((len(start), -(-self.length // 8) * 8), np.uint8)
        words[:, : self.length] = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[start]
        value = np.zeros(len(start), np.uint64)
        for column in words.view(np.uint64).T:
            value = mix(value * _ODD + column)
        join = lambda x, y: np.concatenate([x[rest], y])
        self.doc, self.count = join(self.doc, self.doc[of]), join(self.count, np.ones(len(of), np.int64))
        self.shift, self.start = join(self.shift, self.shift[of] - step), join(self.start, start)
        self.alike = join(self.alike, np.ones(len(of), bool))
        self.anchor, self.hash = join(self.anchor, value), join(self.hash, value)

    def _take(self, chosen: np.ndarray) -> None:
        self.doc, self.start, self.count, self.shift, self.anchor, self.hash = (x[chosen] for x in (self.doc, self.start, self.count, self.shift, self.anchor, self.hash))

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the run that stands for each distinct one, in order of anchor; the least id that has it; which of these each run is)."""
        if not len(self.start):
            return (np.zeros(0, np.int64),) * 3
        order = np.lexsort((self.hash, self.anchor))
        a, b = order[:-1], order[1:]
        same = (self.anchor[a] == self.anchor[b]) & (self.hash[a] == self.hash[b]) & (self.count[a] == self.count[b]) & (self.shift[a] == self.shift[b]) & (self.alike[a] == self.alike[b])
        at = np.flatnonzero(same)
        same[at] = same_bytes(self.data, self.start[a[at]], self.start[b[at]], self.count[a[at]] + self.length - 1)
        new = np.r_[True, ~same]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        return order[begin], np.minimum.reduceat(self.ids[self.doc[order]], begin), which


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {k: batch.column(k)[i] for k in names}
        yield {k: (v.as_buffer() if pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type) else v.as_py()) for k, v in row.items()}


def _bounds(values: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of sorted values, by their high bits; empty buckets are left out."""
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), a, b


def _table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_SENT_OF = (["bucket", "batch", "payload"], [pa.int32(), pa.int64(), pa.binary()])
_MARK_OF = (["batch", "kind", "bucket", "bits"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])


def _send_anchors(bits: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                values, about = Batch(row, length).values()
                low = ((values << np.uint64(bits)) >> np.uint64(24)).astype("<u8")  # 40 bits beside the bucket's
                raw = np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :5])
                about = about.astype("<u4")
                sent = [(k, row["batch"], raw[a:b].tobytes() + about[a:b].tobytes()) for k, a, b in _bounds(values, bits)]
                if sent:
                    yield _table(sent, *_SENT_OF)

    return run


def _count_anchors(hot_runs: int):
    """Three bits for each anchor of each batch: several documents have it; all its runs have one hash; it is split."""

    def run(rows: pa.Table) -> pa.Table:
        found, tags = [], []
        for x in rows["payload"]:
            raw = np.frombuffer(x.as_buffer(), np.uint8)
            n = len(raw) // 9
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = raw[: 5 * n].reshape(-1, 5)
            found.append(wide.view("<u8")[:, 0])
            tags.append(raw[5 * n :].view("<u4"))
        values, about = np.concatenate(found), np.concatenate(tags)
        order = np.argsort(values)
        new = np.r_[True, values[order][1:] != values[order][:-1]]
        first = np.flatnonzero(new)
        tag, least = about[order], about[order] >> np.uint32(8)
        size = np.diff(np.r_[first, len(order)])
        shared = (size > 1) | (np.maximum.reduceat(tag >> np.uint32(7) & np.uint32(1), first) > 0)
        differ = (np.minimum.reduceat(least, first) != np.maximum.reduceat(least, first)) | (np.maximum.reduceat(tag >> np.uint32(6) & np.uint32(1), first) > 0)
        hot = differ & (np.add.reduceat(np.int64(1) << (tag & np.uint32(63)).astype(np.int64), first) > hot_runs)
        mark = np.empty(len(order), np.uint8)
        mark[order] = np.repeat(shared + 2 * ~differ + 4 * hot, size)
        bits, ends = [], np.cumsum([len(x) for x in found])
        for x in np.split(mark, ends[:-1]):
            bits.append(np.packbits(np.concatenate([x & 1, x >> 1 & 1, x >> 2 & 1])).tobytes())
        bucket = rows["bucket"][0].as_py()
        return pa.Table.from_batches([_table([(b, 0, bucket, x) for b, x in zip(rows["batch"].to_pylist(), bits, strict=True)], *_MARK_OF)])

    return run


def _marks(row: dict, kind: int, counts: Iterator[tuple[int, int]], planes: int = 1) -> np.ndarray:
    """The bits of one kind (planes of them for each thing), of all buckets in order; counts: (bucket, things) that this batch has sent."""
    got = {m["bucket"]: m["bits"] for m in row["marks"] or [] if m["kind"] == kind}
    found = [np.unpackbits(np.frombuffer(got[k], np.uint8), count=planes * n).astype(bool).reshape(planes, n) for k, n in counts]
    return np.concatenate([*found, np.zeros((planes, 0), bool)], axis=1)


def _candidates(row: dict, bits: int, length: int) -> Batch:
    own = Batch(row, length)
    values = own.distinct()
    own.keep(values, _marks(row, 0, ((k, b - a) for k, a, b in _bounds(values, bits)), 3))
    return own


def _columns(*parts: np.ndarray) -> bytes:
    """Integer columns, byte by byte of their significance, so that equal high bytes lie together."""
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in parts)


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def bytes(self, n: int) -> np.ndarray:
        self.at += n
        return np.frombuffer(self.raw, np.uint8, n, self.at - n)

    def column(self, kind: type, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.bytes(n * size).reshape(size, n).T).view(kind).reshape(-1)


def _payloads(own: Batch, bits: int, shard_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload): the heads of its strings; the bytes of those whose anchor has only such; the transforms of the others, cut
    into shards of at most about shard_bytes."""
    stand, owner, _ = own.strings()
    sizes = own.count[stand] + own.length - 1
    bounds = list(_bounds(own.anchor[stand], bits))
    bucket = np.repeat([k for k, _, _ in bounds], [b - a for _, a, b in bounds])
    other = np.flatnonzero(~own.alike[stand])
    bodies: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    total = np.cumsum(sizes[other])
    cut = np.flatnonzero(np.diff((total - sizes[other]) // shard_bytes)) + 1
    for part in np.split(other, cut) if len(other) else []:
        n = sizes[part]
        before, first = transform(gathered(own.data, own.start[stand[part]], n), np.cumsum(n), bucket[part])
        begin = np.flatnonzero(np.r_[True, bucket[part][1:] != bucket[part][:-1]])
        strings = np.diff(np.r_[begin, len(part)])
        ends = np.cumsum(np.add.reduceat(n + 1, begin))
        for k, s, a, b in zip(bucket[part][begin].tolist(), strings.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            bodies.setdefault(k, []).append((s, before[a:b], first[a:b]))
    for k, a, b in bounds:
        s = stand[a:b]
        alike = own.alike[s]
        held = bodies.get(k, [])
        head = np.array([b - a, len(held), *(x for s_, w, _ in held for x in (s_, len(w)))], np.int64)
        rest = [_columns(own.anchor[s], owner[a:b], own.count[s].astype(np.uint8), own.shift[s].astype(np.uint8), alike.astype(np.uint8))]
        rest += [gathered(own.data, own.start[s[alike]], sizes[a:b][alike]).tobytes()]
        for _, before, first in held:
            rest += [before.tobytes(), np.packbits(first).tobytes()]
        yield k, b"".join([head.tobytes(), *rest])


def _send_strings(bits: int, length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in _rows(batch):
                sent = [(k, row["batch"], compressor.compress(x)) for k, x in _payloads(_candidates(row, bits, length), bits, shard_bytes)]
                if sent:
                    yield _table(sent, *_SENT_OF)

    return run


def least_of_alike(anchor: np.ndarray, owner: np.ndarray, count: np.ndarray, shift: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least owner among the equal runs, whether all runs of its anchor are equal indeed) of each run."""
    size = count + length - 1
    start = np.cumsum(size) - size
    order = np.argsort(anchor, kind="stable")
    a, b = order[:-1], order[1:]
    one = anchor[a] == anchor[b]
    same = one & (count[a] == count[b]) & (shift[a] == shift[b])
    at = np.flatnonzero(same)
    same[at] = same_bytes(data, start[a[at]], start[b[at]], size[a[at]])
    begin = np.flatnonzero(np.r_[True, ~one])
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
    alike = np.minimum.reduceat(np.r_[True, same | ~one], begin)
    return np.minimum.reduceat(owner[order], begin)[group], alike[group]


def _merge(length: int):
    def run(rows: pa.Table) -> pa.Table:
        heads, plain, before, first, shard_rows, shard_strings = [], [], [], [], [], []
        unpack = zstandard.ZstdDecompressor()
        for x in rows["payload"]:
            r = Reader(unpack.decompress(x.as_buffer().to_pybytes()))
            n, shards = r.bytes(16).view(np.int64).tolist()
            about = r.bytes(16 * shards).view(np.int64).reshape(-1, 2)
            head = [r.column(t, n) for t in (np.uint64, np.int64, np.uint8, np.uint8, np.uint8)]
            heads.append(head)
            alike = head[4] > 0
            plain.append(r.bytes(int((head[2][alike].astype(np.int64) + length - 1).sum())))
            for s, w in about.tolist():
                before.append(r.bytes(w))
                first.append(np.unpackbits(r.bytes(-(-w // 8)), count=w).astype(bool))
                shard_rows.append(w)
                shard_strings.append(s)
        anchor, owner, count, shift, alike = (np.concatenate(x) for x in zip(*heads, strict=True))
        count, shift, alike = count.astype(np.int64), shift.astype(np.int64), alike > 0
        data = np.concatenate(plain)
        least = np.repeat(owner, count)
        place = np.cumsum(count) - count
        # runs that should be alike; those that are not (two runs of one hash) are a shard of their own
        p = np.flatnonzero(alike)
        other = np.flatnonzero(~alike)
        if len(p):
            lowest, sure = least_of_alike(anchor[p], owner[p], count[p], shift[p], data, length)
            good = p[sure]
            n = count[good]
            least[np.arange(n.sum()) + np.repeat(place[good] - (np.cumsum(n) - n), n)] = np.repeat(lowest[sure], n)
            if not sure.all():
                size = count[p] + length - 1
                start = np.cumsum(size) - size
                w, f = transform(gathered(data, start[~sure], size[~sure]), np.cumsum(size[~sure]))
                before.append(w)
                first.append(f)
                shard_rows.append(len(w))
                shard_strings.append(int((~sure).sum()))
                other = np.concatenate([other, p[~sure]])
        if len(other):
            merged = load(np.concatenate(before), np.concatenate(first), np.array(shard_rows), np.array(shard_strings), count[other] + length - 1)
            at, interval = repeats(merged, length, anchor[other], shift[other], owner[other])
            if len(at):
                n = count[other]
                own = np.repeat(other, n)[at]  # the string that a substring is of, and the substring's number among all
                whole = place[own] + at - np.repeat(np.cumsum(n) - n, n)[at]
                begin = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
                least[whole] = np.minimum.reduceat(owner[own], begin)[interval]
        gone = least < np.repeat(owner, count)
        out, at, bucket = [], 0, rows["bucket"][0].as_py()
        for batch, head in zip(rows["batch"].to_pylist(), heads, strict=True):
            n = int(head[2].astype(np.int64).sum())
            out.append((batch, 1, bucket, np.packbits(gone[at : at + n]).tobytes()))
            at += n
        return pa.Table.from_batches([_table(out, *_MARK_OF)])

    return run


def _finish(bits: int, length: int, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = _candidates(row, bits, length)
                cover = removed(own, row, bits)
                total = np.concatenate([[0], np.cumsum(cover, dtype=np.int32)])
                begins = cover & ~np.r_[False, cover[:-1]]
                begins[own.offsets[:-1][own.lengths > 0]] = cover[own.offsets[:-1][own.lengths > 0]]
                spans = np.concatenate([[0], np.cumsum(begins, dtype=np.int32)])
                a, b = own.offsets[:-1], own.offsets[1:]
                kept = [own.data[i:j] if total[i] == total[j] else own.data[i:j][~cover[i:j]] for i, j in zip(a, b, strict=True)]
                columns = {
                    "doc_id": pa.array(own.ids, mask=own.ids == NO_ID),
                    "n_bytes": pa.array(own.lengths),
                    "n_removed": pa.array((total[b] - total[a]).astype(np.int64)),
                    "n_spans": pa.array((spans[b] - spans[a]).astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                }
                if with_kept:
                    columns["kept"] = pa.array([x.tobytes() for x in kept], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def removed(own: Batch, row: dict, bits: int) -> np.ndarray:
    """Which bytes of a batch's data are covered by a string that starts in a document of smaller id too."""
    stand, owner, which = own.strings()
    counts = own.count[stand]
    ends = np.concatenate([[0], np.cumsum(counts)])
    found = _marks(row, 1, ((k, int(ends[b] - ends[a])) for k, a, b in _bounds(own.anchor[stand], bits)))[0]
    n = own.count
    string = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    later = np.repeat(own.ids[own.doc] > owner[which] if len(n) else np.zeros(0, bool), n)
    gone = later | found[string + np.repeat(ends[:-1][which], n)]
    starts = (string + np.repeat(own.start, n))[gone]
    edge = np.zeros(len(own.data) + 1, np.int8)
    if len(starts):  # each place is the start of one string at most
        edge[starts] = 1
        edge[starts + own.length] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def dedup(
    docs: DataFrame,
    length: int = LENGTH,
    with_kept: bool = False,
    batch_bytes: int = BATCH_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    shard_bytes: int = SHARD_BYTES,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes.

    Null and empty texts have no bytes.  Of rows with one doc_id none is smaller than the other: they leave each other alone.  Rows without
    doc_id come after all others.  Other columns are left out; an empty table gives no rows.  The result is written to the shared folder;
    the table of batches is dropped.  A batch sends at most one message a bucket that it has anchors in, so messages are never more than runs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    batches, name, path = bucketed(rows.mapInArrow(lambda x: _batches(x, batch_bytes), _BATCH), parts, "batch")
    bits = max(5, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    anchors_sent = batches.mapInArrow(_send_anchors(bits, length), _SENT)
    marks = materialise(anchors_sent.groupBy("bucket").applyInArrow(_count_anchors(hot_runs), _MARK), "anchors")

    def marked(marks: DataFrame) -> DataFrame:
        grouped = marks.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("marks"))
        return batches.join(grouped.hint("shuffle_hash"), "batch", "left")

    sent = marked(marks).mapInArrow(_send_strings(bits, length, shard_bytes), _SENT)
    found = materialise(sent.groupBy("bucket").applyInArrow(_merge(length), _MARK), "strings")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    out = materialise(marked(marks.unionByName(found)).mapInArrow(_finish(bits, length, with_kept), fields), "kept")
    drop_bucketed(spark, name, path)
    return out


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
