"""Set-similarity join of word n-grams by chosen paths.

A document is the set of its word 5-grams.  Documents with equal sets are one class; the join finds all pairs of classes of Jaccard
similarity 0.8 or more.  In each run every set follows, from the run's root, the tokens that a hash of (path, token) chooses, on average
1 / threshold of them; sets that are alike follow the same tokens.  A node that more than `bucket` sets reach is split again by
further tokens, up to `depth`; what is left is compared by brute force, in blocks.  The number of runs is what the target recall needs.

A pair is compared at the least of the leaves that both sets reach, and there only: once by sketch, then by n-grams.  So links are counted
and joined inside the tasks, and no pair is ever a row.  A group of g near copies makes, at one leaf, g / block rows of each of its sets, as
the exact number of links needs every pair; at its other leaves only sets that have not met before do (see _dealt).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delve.llm.common import bucketed, drop_bucketed, materialise, mix, spans_of_rows, table, utf8
from delve.llm.components import components
from delve.llm.wordhash import LOWER, window_hashes, word_bounds, word_hashes

SKETCH = 64
#: Bytes of the tokens of a bucket.
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class Params:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    bucket: int = 256  # sets of a node that is not split
    depth: int = 3
    block: int = 512  # sets of a block of a larger leaf

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold has met, and passed the sketch, with the target recall.

        Children are drawn by the larger set's size.  Sets of one size share 2t / (1 + t) of it, but a set that holds the other shares only t:
        a node then has Poisson(1) common children on average, and that is the least a pair at the threshold has.
        """
        meet = 1.0
        for _ in range(self.depth):
            meet = 1 - math.exp(-meet)
        left = 1 - self.recall - self.sketch_miss
        if left <= 0:
            raise ValueError(f"a recall of {self.recall} is out of reach: the sketch alone loses {self.sketch_miss:.1e} of pairs")
        return max(1, math.ceil(math.log(left) / math.log(1 - meet)))

    @property
    def sketch_floor(self) -> float:
        """Share of equal sketch bytes below which a pair is not verified: `deviations` standard deviations under the threshold's."""
        return self.threshold - self.deviations * math.sqrt(self.threshold * (1 - self.threshold) / SKETCH)

    @property
    def deviations(self) -> float:
        """As few, from 5 on, as keep the sketch's miss within a tenth of what the target recall allows."""
        return next(k for k in itertools.count(5) if self._tail(k) <= (1 - self.recall) / 10)

    @property
    def sketch_miss(self) -> float:
        """Share of pairs at the threshold that the sketch loses in every run alike: a binomial tail."""
        return self._tail(self.deviations)

    def _tail(self, deviations: float) -> float:
        t = self.threshold
        least = math.ceil(SKETCH * t - deviations * math.sqrt(SKETCH * t * (1 - t)))
        return sum(math.comb(SKETCH, k) * t**k * (1 - t) ** (SKETCH - k) for k in range(max(0, least)))


def children(tokens: np.ndarray, node: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The paths on from a node: (index of the row, path).  tokens of all rows end to end; node and size of each row."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    drawn = mix(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ node[owner])
    limit = np.minimum(1.0, 1 / (threshold * np.maximum(sizes, 1)))
    at = np.flatnonzero(drawn.astype(np.float64) / 2.0**64 < limit[owner])
    return owner[at], mix(node[owner[at]] * np.uint64(0xD6E8FEB86659FD93) + tokens[at].astype(np.uint64)).view(np.int64)


_MASKS = np.random.default_rng(77).integers(1, 1 << 32, (2, SKETCH), dtype=np.uint64).astype(np.uint32)


def sketches(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A byte of each of SKETCH min-hashes of each set (no set empty)."""
    out = np.zeros((len(first), SKETCH), np.uint8)
    for k in range(SKETCH if len(first) else 0):
        least = np.minimum.reduceat((tokens ^ _MASKS[0, k]) * (_MASKS[1, k] | np.uint32(1)), first)
        out[:, k] = (least * np.uint32(2654435761)) >> np.uint32(24)
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct 32-bit hashes of each document's n-grams of lower-cased words; of all its words, if they are fewer."""
    raw = LOWER[raw]
    starts, ends = word_bounds(raw, offsets[:-1])
    words = word_hashes(raw, starts, ends, fold=False)
    grams = (mix(window_hashes(words, n)) >> np.uint64(32)).astype(np.uint32)
    first = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append((mix(window_hashes(words[a:b], b - a)) >> np.uint64(32)).astype(np.uint32) if b > a else np.zeros(0, np.uint32))
    return out


SETS = "doc_id long, k1 long, k2 long, n int, tokens binary, sketch binary, paths array<long>"


def _sets(docs: DataFrame, p: Params) -> DataFrame:
    roots = mix(np.arange(1, p.runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for a, b in spans_of_rows(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p.n)
                sizes = np.array([len(x) for x in sets])
                flat = np.concatenate([*sets, np.zeros(0, np.uint32)])
                full = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[full]
                keys = np.zeros((len(sets), 2), np.uint64)
                sketch = np.zeros((len(sets), SKETCH), np.uint8)
                if len(full):
                    for k in (0, 1):
                        keys[full, k] = mix(np.add.reduceat(mix(flat.astype(np.uint64) + (np.uint64(k + 1) << np.uint64(40))), begin) + sizes[full].astype(np.uint64))
                    sketch[full] = sketches(flat, begin)
                owners, paths = [], []
                for root in roots:
                    own, path = children(flat, np.full(len(sets), root, np.uint64), sizes, p.threshold)
                    owners.append(own)
                    paths.append(path)
                own, path = np.concatenate(owners), np.concatenate(paths)
                path = path[np.argsort(own, kind="stable")]
                ends = np.cumsum(np.bincount(own, minlength=len(sets)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        *(pa.array(keys[:, k].view(np.int64)) for k in (0, 1)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array([x.tobytes() for x in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(path)),
                    ],
                    ["doc_id", "k1", "k2", "n", "tokens", "sketch", "paths"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SETS)


def _shared(rows: DataFrame) -> DataFrame:
    """rows (leaf, set_id) of leaves that two sets or more reach, with the number of them."""
    counts = rows.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    return rows.join(counts, "leaf")


def _split(rows: DataFrame, tokens: DataFrame, p: Params) -> DataFrame:
    """The children (leaf, set_id) of rows (leaf, set_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("tokens")]
            node = batch.column("leaf").to_numpy().view(np.uint64)
            own, path = children(np.concatenate([*sets, np.zeros(0, np.uint32)]), node, np.array([len(x) for x in sets], np.int64), p.threshold)
            yield pa.RecordBatch.from_arrays([pa.array(path), batch.column("set_id").take(pa.array(own))], ["leaf", "set_id"])

    joined = tokens.join(rows.hint("shuffle_hash"), "set_id").select("leaf", "set_id", "tokens")
    return joined.mapInArrow(run, "leaf long, set_id long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            same &= x == x[last]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _owned(leaf: int, leaves: pa.Array, block: np.ndarray, cross: bool) -> np.ndarray | None:
    """Which pairs of a cell meet at no lesser leaf, as an upper triangle; None if none does."""
    m = len(block)
    values, offsets = leaves.values.to_numpy(), leaves.offsets.to_numpy()
    values, offsets = values[offsets[0] : offsets[-1]], offsets - offsets[0]
    lesser = np.flatnonzero(values < leaf)
    _, column, count = np.unique(values[lesser], return_inverse=True, return_counts=True)
    if len(count) and count.max() == m:
        return None
    met = np.zeros((m, m), bool)
    row = np.repeat(np.arange(m), np.diff(offsets))[lesser]
    often = count > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    for first in range(0, int(often.sum()), 4096):
        own = (column >= first) & (column < first + 4096)
        holds = np.zeros((m, min(4096, int(often.sum()) - first)), np.float32)
        holds[row[own], column[own] - first] = 1
        met |= holds @ holds.T > 0
    wanted = np.triu(~met, 1)
    if cross:
        wanted &= block[:, None] != block[None, :]
    return wanted if wanted.any() else None


def _pairs(leaf: int, sketch: np.ndarray, leaves: pa.Array, block: np.ndarray, cross: bool, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that meet at no lesser leaf, and whose sketches agree enough."""
    wanted = _owned(leaf, leaves, block, cross)
    if wanted is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(sketch)
    if wanted.sum() * 8 < m * m:
        x, y = np.nonzero(wanted)
        good = np.concatenate([(sketch[x[a : a + 65536]] == sketch[y[a : a + 65536]]).sum(axis=1) >= floor * SKETCH for a in range(0, len(x), 65536)])
        return x[good], y[good]
    equal = np.zeros((m, m), np.uint8)
    for k in range(SKETCH):
        equal += sketch[:, k][:, None] == sketch[:, k][None, :]
    return np.nonzero(wanted & (equal >= floor * SKETCH))


def _verified(tokens: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have Jaccard similarity of at least threshold."""
    sizes = np.array([len(t) for t in tokens])
    used = np.unique(np.concatenate([x, y]))
    if len(x) > 200:
        flat = np.concatenate([tokens[i] for i in used])
        owner = np.repeat(used, sizes[used])
        values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        common = counts > 1
        column = np.cumsum(common) - 1
        keep = common[inverse]
        if common.sum() <= 1 << 14:
            table_ = np.zeros((len(tokens), max(1, int(common.sum()))), np.float32)
            table_[owner[keep], column[inverse[keep]]] = 1
            both = (table_ @ table_.T)[x, y]
            return both >= threshold * (sizes[x] + sizes[y] - both) - 1e-6
    out = np.zeros(len(x), bool)
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        both = len(np.intersect1d(tokens[a], tokens[b], assume_unique=True))
        out[i] = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    return out


def _least(m: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of m sets the least set that pairs connect it with."""
    root = np.arange(m)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return root
        root = new


CELL = ["leaf", "i", "j"]


def _cells(table_: pa.Table) -> Iterator[tuple[int, int]]:
    keys = np.stack([table_[k].to_numpy() for k in CELL], axis=1)
    at = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    yield from zip(np.r_[0, at], np.r_[at, len(keys)], strict=True)


LIVE = "set_id long, leaf long, i int, j int, place int, partners binary"


def _compare(p: Params):
    """The sets of each cell that have partners to verify there, each with a bit for every such set of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, CELL):
            ids, leaf = group["set_id"].to_numpy(), group["leaf"].to_numpy()
            i, j, block = (group[c].to_numpy() for c in ("i", "j", "block"))
            sketch, leaves = _matrix(group["sketch"], SKETCH, np.uint8), group["leaves"].combine_chunks()
            kept, places, partners = [], [], []
            for a, b in _cells(group):
                x, y = _pairs(int(leaf[a]), sketch[a:b], leaves.slice(a, b - a), block[a:b], i[a] != j[a], p.sketch_floor)
                if not len(x):
                    continue
                own, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                bits = np.zeros((len(own), len(own)), bool)
                bits[at[: len(x)], at[len(x) :]] = True
                kept.append(a + own)
                places.append(np.arange(len(own), dtype=np.int32))
                partners += [v.tobytes() for v in np.packbits(bits, axis=1)]
            at = np.concatenate([*kept, np.zeros(0, np.int64)])
            place = np.concatenate([*places, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([*(pa.array(v[at]) for v in (ids, leaf, i, j)), pa.array(place), pa.array(partners, pa.binary())], ["set_id", *CELL, "place", "partners"])

    return run


def _verify(p: Params):
    """links and the least linked set of each set, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, CELL):
            ids = group["set_id"].to_numpy()
            kept, links, roots = [], [], []
            for a, b in _cells(group):
                bits = np.unpackbits(_matrix(group["partners"][a:b], -(-(b - a) // 8), np.uint8), axis=1, count=b - a)
                x, y = np.nonzero(bits)
                tokens = [np.frombuffer(t.as_buffer(), np.uint32) for t in group["tokens"][a:b]]
                good = _verified(tokens, x, y, p.threshold)
                x, y = x[good], y[good]
                if not len(x):
                    continue
                order = np.argsort(ids[a:b], kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(b - a)
                own = np.unique(np.concatenate([x, y]))
                kept.append(a + own)
                links.append((np.bincount(x, minlength=b - a) + np.bincount(y, minlength=b - a))[own])
                roots.append(ids[a:b][order][_least(b - a, place[x], place[y])[place]][own])
            at = np.concatenate([*kept, np.zeros(0, np.int64)])
            rest = [np.concatenate([*v, np.zeros(0, np.int64)]) for v in (links, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), *map(pa.array, rest)], ["set_id", "links", "root"])

    return run


def _dealt(leaves: DataFrame, about: DataFrame, p: Params) -> DataFrame:
    """leaves (leaf, set_id, size) with about (set_id, leaves, sketch), dealt to the cells (leaf, i, j) of two blocks, or one.

    A leaf of up to `block` sets is one cell.  In a larger one, sets whose least leaf is the same and is not this one have met there: those
    of a least leaf that many have are blocks apart, and no cell is made of two such blocks of one least leaf.  So a group of near copies, which
    meets in every run, makes all its cells at one leaf only.  A row carries the lesser ones of its set's leaves.
    """
    lesser = F.filter("leaves", lambda x: x < F.col("leaf")).alias("leaves")
    small = leaves.where(F.col("size") <= p.block).select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "set_id")
    large = leaves.where(F.col("size") > p.block)
    if large.isEmpty():
        dealt = small
    else:
        large = large.join(leaves.groupBy("set_id").agg(F.min("leaf").alias("least")), "set_id")
        alike = large.groupBy("leaf", "least").agg(F.count("*").alias("n")).where(F.col("n") >= p.block)  # at most a `block`th of the rows
        alike = alike.withColumn("parts", F.ceil(F.col("n") / p.block).cast("int"))
        before = Window.partitionBy("leaf").orderBy("least")
        alike = materialise(alike.withColumn("base", (F.sum("parts").over(before) - F.col("parts")).cast("int")), "alike")
        of_leaf = alike.groupBy("leaf").agg(F.sum("parts").cast("int").alias("held"), F.sum("n").alias("n_held"))
        large = large.join(alike.select("leaf", "least", "base", "parts"), ["leaf", "least"], "left").join(of_leaf, "leaf", "left")
        held = F.coalesce("held", F.lit(0))
        others = F.ceil((F.col("size") - F.coalesce("n_held", F.lit(0))) / p.block).cast("int")
        drawn = F.xxhash64("set_id")
        block = F.when(F.col("base").isNotNull(), F.col("base") + F.pmod(drawn, "parts")).otherwise(held + F.pmod(drawn, others)).cast("int")
        met = F.col("base").isNotNull() & (F.col("least") != F.col("leaf"))
        every = F.sequence(F.lit(0), held + others - 1)
        partners = F.when(met, F.filter(every, lambda x: (x < F.col("base")) | (x >= F.col("base") + F.col("parts")))).otherwise(every)
        large = large.select("leaf", block.alias("block"), F.explode(partners).alias("other"), "set_id")
        dealt = small.unionByName(large.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id"))
    rows = dealt.join(about, "set_id").select(*CELL, "block", "set_id", lesser, "sketch")
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def join(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_links, n_copies.

    class_id is the least doc_id that links and copies lead to, n_links the number of other n-gram sets of at least the threshold's
    similarity, n_copies the rows of equal set.  Where classes that nothing links have one least doc_id (which then stands for several texts), one
    keeps it and the others have negative numbers of their own.  Null texts and texts without a word are alone, with no links and one
    copy, under their doc_id; rows without doc_id likewise, with a null class; other columns are left out; an empty table gives no rows.
    """
    p = params
    sets = materialise(_sets(docs, p).withColumn("row", F.monotonically_increasing_id()), "sets")
    full = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # a set is numbered by one of its rows
    same = full.groupBy("k1", "k2").agg(F.min("row").alias("set_id"), F.min("doc_id").alias("doc"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    classes = materialise(same, "classes")
    rows = materialise(_shared(classes.select(F.explode("paths").alias("leaf"), "set_id")), "rows")
    active = rows.select("set_id").distinct()
    # the tokens of sets that meet others are dealt once; the joins to come leave them where they are
    size = 4 * (sets.agg(F.sum("n")).first()[0] or 0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = full.select(F.col("row").alias("set_id"), "tokens").repartition(parts, "set_id")
    tokens, *written = bucketed(dealt.join(active.repartition(parts, "set_id"), "set_id"), parts, "set_id")
    leaves = rows.where(F.col("size") <= p.bucket) if p.depth > 1 else rows
    for depth in range(2, p.depth + 1):
        # written before _shared() reads it twice, so that no plan can split the same rows twice
        below = materialise(_split(rows.where(F.col("size") > p.bucket).select("leaf", "set_id"), tokens, p), "split")
        rows = materialise(_shared(below), "rows")
        leaves = leaves.unionByName(rows.where(F.col("size") <= p.bucket) if depth < p.depth else rows)
        if rows.isEmpty():
            break
    own = leaves.groupBy("set_id").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))  # as many as runs and depth allow
    about = own.join(classes.select("set_id", "sketch"), "set_id")
    live = materialise(_dealt(leaves, about, p).mapInArrow(_compare(p), LIVE), "live")
    met = tokens.join(live.hint("shuffle_hash"), "set_id").repartition(*CELL).sortWithinPartitions(*CELL, "place")
    found = materialise(met.mapInArrow(_verify(p), "set_id long, links long, root long"), "found")
    drop_bucketed(docs.sparkSession, *written)
    links = found.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    tied = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "set_id")
    tied = tied.join(classes.select("set_id", "doc", "k1"), "set_id")
    named = tied.groupBy("root").agg(F.min("doc").alias("class_id"), F.min("k1").alias("name"))
    tied = tied.select("set_id", "root").join(named, "root")
    known = classes.select("k1", "k2", "set_id", "doc", "n_copies").join(links, "set_id", "left").join(tied, "set_id", "left")
    known = known.withColumns({"class_id": F.coalesce("class_id", "doc"), "name": F.coalesce("name", "k1"), "root": F.coalesce("root", "set_id")})
    known = materialise(known, "known")
    heads = known.where(F.col("root") == F.col("set_id"))
    clashes = heads.groupBy("class_id").agg(F.count("*").alias("heads"), F.min("name").alias("first")).where("heads > 1")
    if not clashes.isEmpty():
        mine = F.col("first").isNull() | (F.col("first") == F.col("name"))
        apart = -1 - F.col("name").bitwiseAND(F.lit((1 << 63) - 1))
        known = known.join(clashes, "class_id", "left").withColumn("class_id", F.when(mine, F.col("class_id")).otherwise(apart))
    out = sets.select("doc_id", "k1", "k2", "n").withColumns({k: F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col(k)) for k in ("k1", "k2")})
    # keys that are null meet nothing: such rows are alone
    return out.join(known.select("k1", "k2", "class_id", "n_links", "n_copies"), ["k1", "k2"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
