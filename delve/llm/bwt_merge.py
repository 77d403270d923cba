"""Merging the Burrows-Wheeler transforms of shards of strings, to find their repeated intervals.

A shard is a set of short byte strings.  It is suffix-sorted once, by itself, and travels as its transform: the byte before each suffix,
in suffix order.  Whoever receives transforms derives the LF mapping from them by counting, and never sorts a suffix.

The merge starts with the shards' suffixes side by side, in intervals; step by step every interval of suffixes that share h bytes is
refined into those that share some bytes more, by moving each suffix to the longer one, stably by the bytes moved over.  Within an
interval the shards' orders stay as they are; no suffix is compared with another.  Two neighbours are parted at the step at which their
common prefix ends, so the borders of step h are the common prefixes shorter than h; an interval of one suffix is settled and leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rows whose intervals are refined at once: few, so that they stay in a core's cache and a step moves over many bytes.
_PART = 1 << 15


def sorted_order(x: np.ndarray) -> np.ndarray:
    """np.argsort(x, kind="stable") of 64-bit hashes: their high bits are sorted together with their places, as plain numbers, which numpy sorts
    several times faster than it sorts places; what that leaves out of order, if anything, is then put in order."""
    bits = np.uint64(max(len(x) - 1, 1).bit_length())
    key = np.sort(x >> bits << bits | np.arange(len(x), dtype=np.uint64))
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = x[order]
    return order if (found[1:] >= found[:-1]).all() else order[np.argsort(found, kind="stable")]


def suffix_order(data: np.ndarray, ends: np.ndarray, shard: np.ndarray | None = None) -> np.ndarray:
    """The order of all suffixes of the strings (which end at `ends`, end to end in data), the empty ones too; ties in order of string.

    Position p stands for the suffix at p of data with one place added after each string, for its empty suffix.  With `shard`, a number
    for each string, ascending, the suffixes of each shard come one shard after the other.

    Suffixes are sorted by their first symbols; then, while some are tied in h symbols, by the ranks of the suffixes h places on, in 2h.
    """
    n = len(data) + len(ends)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.diff(np.r_[0, ends])
    seen = np.zeros(256, bool)
    seen[data] = True
    code = np.cumsum(seen)  # of each byte that occurs, from 1 on; 0 is the end of the string
    bits, width = n.bit_length(), max(int(code[-1]), 1).bit_length()
    done = max((64 - bits) // width, 1)
    sym = np.zeros(n + done, np.uint64)
    sym[np.arange(len(data)) + np.repeat(np.arange(len(ends)), sizes)] = code.astype(np.uint64)[data]
    stop = ends + np.arange(len(ends))  # the empty suffix of each string
    left = (np.repeat(stop, sizes + 1) - np.arange(n)).astype(np.int32)  # symbols before the end
    key = np.zeros(n, np.uint64)
    for i in range(done):
        key <<= np.uint64(width)
        key |= sym[i : n + i]
    keep = np.array([((1 << width * k) - 1) << width * (done - k) for k in range(done + 1)], np.uint64)
    key &= keep[np.minimum(left, done)]  # nothing of the next string
    key = np.sort(key << np.uint64(bits) | np.arange(n, dtype=np.uint64))
    order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    key >>= np.uint64(bits)
    new = np.r_[True, key[1:] != key[:-1]]
    if shard is not None and len(shard):
        step = np.cumsum(np.r_[0, np.diff(shard) != 0])
        own = np.repeat(step.astype(np.uint16 if step[-1] < 1 << 16 else np.uint32), sizes + 1)[order]
        by = np.argsort(own, kind="stable")
        order, key, own = order[by], key[by], own[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.int32)  # the first row of the suffixes that a row is tied with
    rank = np.empty(n, np.int32)
    rank[order] = head
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))  # rows that are tied with another
    head = head[open_]
    while len(open_):
        rest = order[open_]
        more = left[rest] >= done
        if not more.all():  # equal suffixes: their strings' order
            again = np.sort(head[~more].astype(np.uint64) << np.uint64(32) | rest[~more].astype(np.uint64))
            ends_here = open_[~more]
            order[ends_here] = (again & np.uint64((1 << 32) - 1)).astype(np.int64)
            rank[order[ends_here]] = ends_here
            open_, head, rest = open_[more], head[more], rest[more]
            if not len(open_):
                break
        block = np.cumsum(np.r_[False, head[1:] != head[:-1]])
        ahead = block.astype(np.uint64) << np.uint64(bits) | rank[rest + done].astype(np.uint64)
        again, ahead = sorted_places(ahead, int(block[-1]).bit_length() + bits)
        rest = rest[again]
        new = np.r_[True, ahead[1:] != ahead[:-1]]
        head = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))].astype(np.int32)
        order[open_] = rest
        rank[rest] = head
        both = ~(new & np.r_[new[1:], True])
        open_, head = open_[both], head[both]
        done *= 2
    return order


def sorted_places(x: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """(np.argsort(x, kind="stable"), x so sorted) of numbers of so many bits; sorted as plain numbers where a number and its place fit 64 bits."""
    bits = len(x).bit_length()
    if used + bits > 64:
        order = np.argsort(x, kind="stable")
        return order, x[order]
    key = np.sort(x << np.uint64(bits) | np.arange(len(x), dtype=np.uint64))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), key >> np.uint64(bits)


def transform(data: np.ndarray, ends: np.ndarray, shard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(before, first): the byte before each suffix, in suffix order, and whether the suffix is a whole string, with no byte before it."""
    order = suffix_order(data, ends, shard)
    sym = np.zeros(len(order), np.uint8)
    sym[np.arange(len(data)) + np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))] = data
    first = np.zeros(len(order), bool)
    first[np.r_[0, ends[:-1] + np.arange(1, len(ends))]] = True
    first = first[order]
    return np.where(first, 0, sym[order - 1]).astype(np.uint8), first


@dataclass
class Merge:
    """The transforms of some shards, one after the other: before and lf of each suffix, sizes of each string, rows of their empty suffixes."""

    before: np.ndarray
    lf: np.ndarray
    sizes: np.ndarray
    stop: np.ndarray


def load(before: np.ndarray, first: np.ndarray, rows: np.ndarray, strings: np.ndarray, sizes: np.ndarray | None = None) -> Merge:
    """From transforms alone; rows and strings: of each shard.  Where suffixes of one byte lie follows from counting that byte.
    sizes of the strings, if known, are not counted."""
    shard = np.repeat(np.arange(len(rows)).astype(np.uint16 if len(rows) <= 1 << 16 else np.uint32), rows)
    symbol = np.where(first, 0, before.astype(np.uint16) + 1).astype(np.uint16)
    source = np.argsort(symbol, kind="stable")
    if len(rows) > 1:
        source = source[np.argsort(shard[source], kind="stable")]
    lf = np.empty(len(before), np.int32)
    lf[source] = np.arange(len(before), dtype=np.int32)
    lf[first] = -1
    base = np.cumsum(rows) - rows
    stop = np.arange(strings.sum()) + np.repeat(base - (np.cumsum(strings) - strings), strings)  # a shard's empty suffixes come first
    if sizes is not None:
        return Merge(before, lf, sizes, stop)
    sizes, row, open_ = np.zeros(len(stop), np.int64), stop.copy(), np.arange(len(stop))
    while len(open_):
        row = lf[row]
        more = row >= 0
        row, open_ = row[more], open_[more]
        sizes[open_] += 1
    return Merge(before, lf, sizes, stop)


def repeats(merge: Merge, length: int, class_of: np.ndarray, shift: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The substrings of `length` bytes that several owners have: (substring, interval), intervals in order.

    A substring is numbered by string, then by start.  Only substrings of one class (a number for each string) and of one distance,
    shift of its string minus its start, can be equal: these are the first intervals.
    """
    counts = np.maximum(merge.sizes - length + 1, 0)
    first = np.cumsum(counts) - counts
    place = np.full(len(merge.before), -1, np.int32)  # the substring that begins at a suffix
    begun: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    longest = np.argsort(-merge.sizes, kind="stable")
    sizes, row, begin, apart = merge.sizes[longest], merge.stop[longest], first[longest], (shift - merge.sizes)[longest]
    for t in range(int(sizes[0]) + 1 if len(sizes) else 0):  # row is the suffix of t bytes of each string that has so many
        have, ends = np.searchsorted(-sizes, [-t, -t - length], side="right")
        row = row[:have]
        begun.append((row[:ends], longest[:ends], apart[:ends] + (t + length)))
        if t >= length:
            place[row] = begin[:have] + sizes[:have] - t
        row = merge.lf[row]
    empty = np.zeros(0, np.int64)
    row, own, apart = (np.concatenate(x) for x in zip(*begun, strict=True)) if begun else (empty,) * 3
    if not len(row):
        return empty, empty
    _, rank = np.unique(class_of, return_inverse=True)
    width = int(apart.max() - apart.min()) + 1
    interval = rank[own].astype(np.int64) * width + (apart - apart.min())
    of = np.zeros(len(merge.before), np.int32)  # the string of a suffix
    of[row] = own
    key = np.sort(interval.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64))  # rows of an interval in the shards' order
    row, interval = (key & np.uint64((1 << 32) - 1)).astype(np.int32), (key >> np.uint64(32)).astype(np.int64)
    own = owner[of[row]]
    _, interval, row = _several(interval, row, own)
    found, before, steps = [], 0, _Steps(merge)
    for a, b in _parts(interval):
        x, y = steps.refined(row[a:b], interval[a:b] - interval[a], length)
        found.append((x, y + np.int32(before)))
        before += int(y[-1]) + 1 if len(y) else 0
    row, interval = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (row[:0], interval[:0])
    at = place[row].astype(np.int64)
    _, interval, at = _several(interval, at, np.repeat(owner, counts)[at])
    return at, interval


class _Steps:
    """Moves of suffixes to longer ones, some bytes at once: for 1, 2 and 4 bytes those before each suffix as one number, and the longer suffix."""

    def __init__(self, merge: Merge):
        seen = np.zeros(256, bool)
        seen[merge.before] = True
        code = np.cumsum(seen) - 1  # of each byte that occurs
        self.width = max(int(code[-1]).bit_length(), 1)
        self.made = {1: (code.astype(np.uint32)[merge.before], merge.lf)}

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.made:
            c, to = self(n // 2)
            self.made[n] = c << np.uint32(n // 2 * self.width) | c[to], to[to]
        return self.made[n]

    def refined(self, row: np.ndarray, interval: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of rows (in order, from 0 on) after moves over length bytes: each step moves over as many bytes as fit a number with
        a row's interval and place."""
        done = 0
        while done < length and len(row):
            held = int(interval[-1]).bit_length()
            room = min((64 - len(row).bit_length() - held) // self.width, length - done)
            n = 4 if room >= 4 else 2 if room >= 2 else 1
            c, to = self(n)
            order, key = sorted_places(interval.astype(np.uint64) << np.uint64(n * self.width) | c[row], held + n * self.width)
            row = to[row[order]]
            new = np.concatenate([[True], key[1:] != key[:-1], [True]])
            several = ~(new[:-1] & new[1:])
            row, interval = row[several], np.cumsum(new[:-1][several], dtype=np.int32) - np.int32(1)
            done += n
        return row, interval


def _parts(interval: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows cut between intervals, into parts of about _PART rows or of one longer interval."""
    begin = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])[: len(interval)])
    cut = begin[np.concatenate([[True], np.diff(begin // _PART) != 0])[: len(begin)]].tolist()
    yield from zip(cut, [*cut[1:], len(interval)][: len(cut)], strict=True)


def _several(interval: np.ndarray, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What belongs to intervals with several owners: (owner, interval from 0 on, x)."""
    if not len(x):
        return owner, interval.astype(np.int32), x
    begin = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
    size = np.diff(np.r_[begin, len(x)])
    keep = np.repeat(several, size)
    return owner[keep], np.repeat(np.arange(several.sum(), dtype=np.int32), size[several]), x[keep]
