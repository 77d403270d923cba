"""Approximate nearest neighbours by an adaptive dimension scan of the probed lists of an inverted index.

Distinct vectors are dealt to the lists of a coarse quantiser; a query scans its nearest lists.  Within a list the vectors are
rotated at random and read in blocks of columns: after each block a hypothesis test compares the distance seen so far, scaled up, with
what a vector still needs to be among the nearest, and abandons it early.  Survivors are scored on their original components.

Bounds: the quantiser, the number of probed lists and a query's first threshold come from at most `sample` vectors, an eighth of a
small table; every vector is indexed, and a result comes from a scanned list alone.  Lists grow with the vectors: beyond `coarse` of them a
list is a coarse centroid and one of a codebook of residuals, so that codebooks stay small.  Lists and queries meet in cells of
bounded size, by the numbers of each list: one that holds many vectors, or that many queries probe, is many cells.  A query whose lists hold fewer
than k goes on with four times as many lists, and again, until it has k or has scanned all, at last without the test.  Of equal vectors the
index keeps the k + 1 smallest ids: no other one can be among anyone's k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delve.llm.common import materialise, table


#: A query whose lists hold too few goes on with this many times as many of them.
WIDER = 4


@dataclass(frozen=True)
class Params:
    k: int = 20
    sample: int = 16_384  # at most; an eighth of the vectors, if that is less, but least_sample
    least_sample: int = 512
    list_rows: int = 512  # vectors of a list, on average, up to coarse * coarse lists
    coarse: int = 2048
    recall: float = 0.97  # on the sample, for the number of probed lists
    epsilon: float = 2.1  # of the hypothesis test: larger abandons later
    columns: int = 16  # of a column block
    cell_rows: int = 4096  # vectors, and queries, of a cell on average, whatever list it is of
    seed: int = 7


@dataclass
class Index:
    """What every task needs: the rotation, the codebooks in augmented space, the sample, how many lists to probe.

    List c * len(residuals) + r has the centroid centroids[c] + residuals[r].
    """

    rotation: np.ndarray
    centroids: np.ndarray
    residuals: np.ndarray
    top: float  # the largest squared norm
    sample: np.ndarray
    sample_copies: np.ndarray
    probes: int
    params: Params

    @property
    def lists(self) -> int:
        return len(self.centroids) * len(self.residuals)


def valid(vector: str = "embedding"):
    """No null vector, null or non-finite component, or zero vector."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each row has, and all of them, one after the other."""
    ids = column.combine_chunks()
    return ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy()


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """One more component makes all norms equal, so that the nearest by distance are those of largest inner product."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1)))[:, None]])


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, but for the constant of each row of x."""
    return (centroids**2).sum(axis=1) - 2 * x @ centroids.T


def _least(away: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(away, n - 1, axis=1)[:, :n] if n < away.shape[1] else np.tile(np.arange(away.shape[1]), (len(away), 1))


def nearest_lists(x: np.ndarray, index: Index, n: int) -> np.ndarray:
    """The n nearest lists of each row.  With residuals: among those of the nearest coarse centroids, twice as many as hold n lists, and 8 more."""
    away, width = distances(x, index.centroids), len(index.residuals)
    if width == 1:
        return _least(away, n)
    some = _least(away, 2 * -(-n // width) + 8)
    out = np.empty((len(x), min(n, some.shape[1] * width)), np.int64)
    own = distances(np.zeros_like(x[:1]), index.residuals)[0]
    for a in range(0, len(x), 64):
        c = some[a : a + 64]
        rest = x[a : a + 64, None, :] - index.centroids[c]
        fine = np.take_along_axis(away[a : a + 64], c, axis=1)[:, :, None] + own - 2 * rest @ index.residuals.T
        best = _least(fine.reshape(len(c), -1), out.shape[1])
        out[a : a + 64] = np.take_along_axis(c, best // width, axis=1) * width + best % width
    return out


def kmeans(x: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = distances(x, centroids).argmin(axis=1)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if (~full).any():
            centroids[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centroids


def codebooks(x: np.ndarray, lists: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    most = max(1, min(params.coarse, len(x) // 8))
    centroids = kmeans(x, min(lists, most), params.seed)
    fine = min(-(-lists // len(centroids)), most)
    if fine == 1:
        return centroids, np.zeros_like(centroids[:1])
    return centroids, kmeans(x - centroids[distances(x, centroids).argmin(axis=1)], fine, params.seed)


def train(sample: np.ndarray, copies: np.ndarray, top: float, rows: int, params: Params) -> Index:
    dim = sample.shape[1]
    rng = np.random.default_rng(params.seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    x = augmented(sample, top)
    index = Index(rotation, *codebooks(x, max(1, rows // params.list_rows), params), top, sample, copies, 1, params)
    own = nearest_lists(x, index, 1)[:, 0]
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    inner = sample[asked].astype(np.float64) @ sample.T.astype(np.float64)
    inner[np.arange(len(asked)), asked] = -np.inf
    k = min(params.k, len(sample) - 1)
    if k > 0:
        best = np.argpartition(-inner, k - 1, axis=1)[:, :k]
        q = np.hstack([sample[asked].astype(np.float64), np.zeros((len(asked), 1))])
        needed = np.sort(np.concatenate([_ranks(index, q[i : i + 1], own[best[i]]) for i in range(len(asked))]))
        index.probes = int(needed[min(len(needed) - 1, int(np.ceil(params.recall * len(needed))))]) + 1
    return index


def _ranks(index: Index, q: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """How many lists are nearer to q than each of some lists."""
    width = len(index.residuals)
    rest = q - index.centroids
    away = (rest**2).sum(axis=1)[:, None] + distances(rest, index.residuals)
    return np.searchsorted(np.sort(away.ravel()), away[lists // width, lists % width])


def first_threshold(index: Index, q: np.ndarray) -> np.ndarray:
    """An inner product that at least k + 1 vectors of the sample reach (its copies counted), so the k + 1 nearest do."""
    need = index.params.k + 1
    out = np.full(len(q), -np.inf)
    if index.sample_copies.sum() < need:
        return out
    sample = index.sample.astype(np.float64)
    m = min(need, len(sample))
    for a in range(0, len(q), 256):
        inner = q[a : a + 256].astype(np.float64) @ sample.T
        best = np.argpartition(-inner, m - 1, axis=1)[:, :m]
        score = np.take_along_axis(inner, best, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        best, score = np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1)
        at = np.argmax(np.cumsum(index.sample_copies[best], axis=1) >= need, axis=1)
        out[a : a + len(best)] = np.take_along_axis(score, at[:, None], axis=1)[:, 0]
    return out - 1e-6 * (1 + np.abs(out))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of pairs of rows, in double precision."""
    return np.einsum("ij,ij->i", q.astype(np.float64), x.astype(np.float64))


def expanded(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, copies: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(row, id, score) of the `most` best of each row, each vector of cols with all its ids; ties to the smaller id."""
    n = copies[cols]
    ends = np.cumsum(copies)
    rows, score = np.repeat(rows, n), np.repeat(score, n)
    vec = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((ends - copies)[cols], n)]
    order = np.lexsort((vec, -score, rows))
    rows, score, vec = rows[order], score[order], vec[order]
    first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    best = place < most
    return rows[best], vec[best], score[best]


def adaptive_scan(q: np.ndarray, x: np.ndarray, floor: np.ndarray, index: Index, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector) of at least floor[query] that no test abandons, and their scores.

    With d of D rotated columns seen, s = D / d times the partial squared distance estimates the whole; a pair is abandoned if s is
    over (1 + epsilon / sqrt(d))^2 times the largest squared distance at which its inner product would still reach the floor.
    """
    p, dim = index.params, q.shape[1]
    turn = index.rotation
    qr, xr = q.astype(np.float64) @ turn, x.astype(np.float64) @ turn
    qn, xn = (qr**2).sum(axis=1), (xr**2).sum(axis=1)
    rows = cols = part = None
    for a in range(0, dim, p.columns):
        b = min(a + p.columns, dim)
        if rows is None:
            seen = (qr[:, a:b] ** 2).sum(axis=1)[:, None] + (xr[:, a:b] ** 2).sum(axis=1)[None, :] - 2 * qr[:, a:b] @ xr[:, a:b].T
            limit = np.maximum(qn[:, None] + xn[None, :] - 2 * floor[:, None], 0)
            alive = seen * (dim / b) <= limit * (1 + epsilon / np.sqrt(b)) ** 2 + 1e-9
            rows, cols = np.nonzero(alive)
            part, limit = seen[rows, cols], limit[rows, cols]
        else:
            if len(rows) > 0.3 * len(q) * len(x):  # nearly all are alive: the dense product is cheaper than gathering
                dense = (qr[:, a:b] ** 2).sum(axis=1)[:, None] + (xr[:, a:b] ** 2).sum(axis=1)[None, :] - 2 * qr[:, a:b] @ xr[:, a:b].T
                part = part + dense[rows, cols]
            else:
                part = part + ((qr[rows, a:b] - xr[cols, a:b]) ** 2).sum(axis=1)
            wide = (1 + epsilon / np.sqrt(b)) ** 2 if b < dim else 1.0
            alive = part * (dim / b) <= limit * wide + 1e-9 * (1 + limit)
            rows, cols, part, limit = rows[alive], cols[alive], part[alive], limit[alive]
    return rows, cols, exact(q[rows], x[cols])


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """A row for each distinct vector: key (its smallest id), the k + 1 smallest ids, embedding.  The group limit runs before the shuffle."""
    ranked = vectors.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = F.array_sort(F.collect_list("vec_id"))
    return ranked.groupBy("embedding").agg(ids.alias("ids")).select(F.col("ids")[0].alias("key"), "ids", "embedding")


_HITS = "key long, vec_id long, score double"


def _probed(wanted: DataFrame, index, probes: int) -> DataFrame:
    """key, floor, list for each list that a query's vector is held against; vectors stay where they are."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        every = probes >= own.lists
        for batch in batches:
            x = matrix(batch.column("embedding"))
            step = max(1, min(256, (1 << 20) // probes))
            for a in range(0, len(x), step):
                part = x[a : a + step]
                q = np.hstack([part.astype(np.float64), np.zeros((len(part), 1))])
                lists = np.tile(np.arange(own.lists), (len(part), 1)) if every else nearest_lists(q, own, probes)
                at = pa.array(a + np.repeat(np.arange(len(part)), lists.shape[1]))
                floor = np.repeat(first_threshold(own, part), lists.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(floor), pa.array(lists.ravel().astype(np.int64))], ["key", "floor", "list"])

    return wanted.mapInArrow(probe, "key long, floor double, list long")


def _scanned(left: DataFrame, right: DataFrame, index, epsilon: float) -> DataFrame:
    """The hits (key, vec_id, score) of cells."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        own = index.value
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and b.num_rows:
            q, x, floor, keys = matrix(a["embedding"]), matrix(b["embedding"]), a["floor"].to_numpy(), a["key"].to_numpy()
            copies, ids = _ids(b["ids"])
            step = max(1, (4 << 20) // len(x))
            for s in range(0, len(q), step):
                rows, cols, score = adaptive_scan(q[s : s + step], x, floor[s : s + step], own, epsilon)
                rows, vec, score = expanded(rows, cols, score, copies, ids, own.params.k + 1)
                out.append((keys[s : s + step][rows], vec, score))
        joined = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("key", "vec_id", "score"), map(pa.array, joined), strict=True)))

    by = ("list", "block", "chunk")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, _HITS)


def search(vectors: DataFrame, queries: DataFrame, params: Params = Params()) -> DataFrame:
    """The nearest of each query's vector among vectors (vec_id, embedding), but itself: query_id, rank, vec_id, score.

    queries: rows of vectors.  Null, empty, zero or not finite vectors take no part; a shorter vector counts as filled up with zeros; floats
    and doubles are scored as they are, in double precision.  Equal scores go to the smaller vec_id; an empty table, or a
    single vector, gives no row; other columns are left out.
    """
    spark, p = vectors.sparkSession, params
    double = "double" in vectors.schema["embedding"].dataType.simpleString()
    kind = "array<double>" if double else "array<float>"
    keep = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")]
    vectors, queries = (x.select(*keep).where(valid()) for x in (vectors, queries))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = vectors.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if lengths.most is None:
        return spark.createDataFrame([], schema)
    if lengths.least < lengths.most:
        filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(lengths.most) - F.size("embedding")).cast(kind))
        vectors, queries = (x.withColumn("embedding", filled) for x in (vectors, queries))
    distinct = materialise(_distinct(vectors, p.k), "vectors")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    facts = distinct.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.sum(F.size("ids")).alias("ids")).first()
    wanted_sample = max(min(facts.n, p.least_sample), min(p.sample, facts.n // 8))
    share = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(2.0**53)  # about as many; none is ranked or moved
    held = distinct.where(share <= min(1.0, wanted_sample / facts.n)).select("key", F.size("ids").alias("copies"), "embedding").toArrow().sort_by("key")
    if not held.num_rows:
        held = distinct.limit(1).select("key", F.size("ids").alias("copies"), "embedding").toArrow()
    index = spark.sparkContext.broadcast(train(matrix(held["embedding"]), held["copies"].to_numpy().astype(np.int64), facts.top, facts.n, p))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            x = augmented(matrix(batch.column("embedding")), own.top)
            lists = nearest_lists(x, own, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            yield batch.append_column("list", pa.array(lists.astype(np.int64)))

    listed = materialise(distinct.mapInArrow(assign, f"key long, ids array<long>, embedding {kind}, list long"), "lists")
    sizes = materialise(listed.groupBy("list").agg(F.count("*").alias("size")), "sizes")

    asked = queries.join(distinct.select("key", "embedding"), "embedding").select("vec_id", "key")
    asked = materialise(asked, "asked")
    wanted = materialise(distinct.join(asked.select("key").distinct(), "key", "left_semi").select("key", "embedding"), "queries")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    parts = lambda n: F.ceil(F.col(n) / p.cell_rows).cast("int")
    places = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def nearest(wanted: DataFrame, probes: int, epsilon: float) -> DataFrame:
        """key and its near vectors, best first.  Each list's vectors are dealt to blocks and its queries to chunks, as many as its own numbers ask for."""
        probed = materialise(_probed(wanted, index, probes), "probed")
        asking = probed.groupBy("list").agg(F.count("*").alias("queries"))
        cells = materialise(sizes.join(asking, "list").select("list", parts("size").alias("blocks"), parts("queries").alias("chunks")), "cells")
        left = probed.join(cells, "list").select("key", "floor", "list", F.pmod(F.xxhash64("key", F.lit(1)), "chunks").cast("int").alias("chunk"), places("blocks").alias("block"))
        right = listed.join(cells, "list").select("key", "ids", "embedding", "list", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), places("chunks").alias("chunk"))
        hits = _scanned(left.join(wanted, "key"), right, index, epsilon)
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k + 1)
        return materialise(ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near")), "near")

    probes, near, left = index.value.probes, None, wanted
    while True:
        last = probes >= index.value.lists
        found = nearest(left, probes, float("inf") if last and near is not None else p.epsilon)
        enough = found if last and near is not None else found.where(F.size("near") >= min(p.k + 1, facts.ids))
        near = enough if near is None else near.unionByName(enough)
        left = materialise(left.join(enough, "key", "left_anti"), "few")
        if left.isEmpty() or (last and found is enough):
            break
        probes = min(index.value.lists, WIDER * probes)
    each = asked.join(near, "key").select(F.col("vec_id").alias("query_id"), F.filter("near", lambda x: x.vec_id != F.col("vec_id")).alias("near"))
    each = each.select("query_id", F.posexplode(F.slice("near", 1, p.k)).alias("pos", "hit"))
    return each.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
