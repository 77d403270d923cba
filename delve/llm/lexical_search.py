"""Ranked lexical search by three-phase uniform thresholds (TPUT) over postings partitioned by term.

A posting is a document and what one of its terms adds to a score, a whole number; a term's list is sorted by that, cut into blocks and, where
it is long, dealt into slices by document, so that no term is a task's alone.  Lists hold the terms of the items, of all documents.

1. The heads of the lists, k postings each, give partial scores.  The documents of the greatest are looked up: an item's k-th greatest exact score
   among them is its bar, which bounds its k-th score from below.
2. One threshold for all lists of an item: the greatest for which a document with less in every list stays under the bar, a list adding no more than its
   greatest posting.  Every list sends its postings from the threshold on (the least of the items that use it); blocks whose greatest
   is less are not opened.  What arrives is summed for each item, and a document goes whose unseen lists cannot lift it to the bar.
3. What is left is looked up: its exact scores from its own terms.

Postings are sent to cells of consecutive documents, where the documents' terms are for the third phase; a cell is a task's group of bounded size, and
all items are summed there, so that no pair of an item and a document is ever shuffled but for those that reach the bar.  A text is read once, where
it lies.  Everything the phases share is written to the shared folder.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delve.llm.common import materialise, table

K = 10
#: Documents of an item that the heads name and that are looked up for its bar, as a multiple of k.
PROBES = 10
#: Postings of a block, and of a slice of a list on average; documents of a cell are 2 ** CELL_BITS at most.
BLOCK_ROWS, SLICE_ROWS, CELL_BITS = 1024, 1 << 16, 12
#: Items are searched so many terms at a time, on average: that bounds what workers and the driver hold of them.
PAIRS = 200_000
#: Bytes of text whose terms are found at a time, about.
PIECE_BYTES = 1 << 22

# A term is a run of these characters, of which A-Z alone are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 after bytes.lower(), which changes A-Z alone.
_FIND = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE_BYTES and (cut := _BREAK.search(text, at + PIECE_BYTES)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def text_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class Items:
    """The items of one search: ids, and the codes of item i's terms at codes[starts[i]:starts[i + 1]]; a code is a term's place in terms."""

    ids: list[int | None]
    starts: np.ndarray
    codes: np.ndarray
    terms: list[str]

    @classmethod
    def of(cls, pairs: list[tuple[int | None, str]]) -> Items:
        own: dict[int | None, set[str]] = {}
        for item, term in pairs:
            own.setdefault(item, set()).add(term)
        ids, terms = sorted(own, key=lambda x: (x is not None, x or 0)), sorted(set().union(*own.values()))
        code = {t: i for i, t in enumerate(terms)}
        codes = [sorted(code[t] for t in own[i]) for i in ids]
        return cls(ids, np.cumsum([0, *map(len, codes)]), np.array([c for x in codes for c in x], np.int64), terms)

    def of_item(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i + 1]]


@dataclass(frozen=True)
class Weights:
    """What makes an impact of a posting: each code's weight, the number of documents and of all terms."""

    w: np.ndarray
    docs: int
    terms: int

    def impacts(self, n: list[int], counts: np.ndarray, codes: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Of documents of n terms one after the other, with so many codes each."""
        m = np.repeat(np.array([10 + 90 * x * self.docs // self.terms for x in n], np.int64), counts)
        return self.w[codes] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), codes, tfs: which of the terms each document has, and how often."""
    held = docs.sparkSession.sparkContext.broadcast({x.encode(): i for i, x in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = held.value
        for batch in batches:
            sizes, codes, tfs = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n, own = 0, Counter()
                for piece in _pieces(text):
                    words = _FIND(piece.lower())
                    n += len(words)
                    own.update(filter(code.__contains__, words))
                sizes.append(n)
                codes.append([*map(code.__getitem__, own)])
                tfs.append(list(own.values()))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(codes, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "codes", "tfs"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(count, "doc_id long, n long, codes array<int>, tfs array<int>")


def _flat(rows: pa.Table | pa.RecordBatch, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all codes of the rows (n, codes, tfs): how many each row has, the codes, and their impacts."""
    column = lambda name: rows.column(name).combine_chunks() if isinstance(rows, pa.Table) else rows.column(name)
    codes, tfs = column("codes"), column("tfs")
    counts = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, flat, weights.impacts(rows.column("n").to_pylist(), counts, flat, tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _postings(weights: Weights, slices: np.ndarray):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, codes, impacts = _flat(batch, weights)
            rows = np.repeat(batch.column("row").to_numpy(), counts)
            part = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices[codes]
            on = impacts > 0
            yield pa.RecordBatch.from_arrays([pa.array(codes[on], pa.int32()), pa.array(part[on], pa.int32()), pa.array(rows[on]), pa.array(impacts[on])], ["code", "slice", "row", "impact"])

    return post


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by code, slice and falling impact as blocks; only the list at hand is open."""
    names = ["code", "slice", "block", "top", "rows", "impacts"]
    schema = pa.schema([("code", pa.int32()), ("slice", pa.int32()), ("block", pa.int32()), ("top", pa.int64()), ("rows", pa.list_(pa.int64())), ("impacts", pa.list_(pa.int64()))])
    key, number, rows, impacts, made = None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def close(n: int) -> None:
        nonlocal number, rows, impacts
        made.append((*key, number, int(impacts[0]), rows[:n], impacts[:n]))
        number, rows, impacts = number + 1, rows[n:], impacts[n:]

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, schema.field(n).type) for n, x in zip(names, zip(*made, strict=True), strict=True)], schema=schema)
        made.clear()
        return out

    for batch in batches:
        code, part, own_rows, own_impacts = (batch.column(n).to_numpy() for n in ("code", "slice", "row", "impact"))
        for a, b in _runs(code, part):
            if key != (code[a], part[a]):
                if len(rows):
                    close(len(rows))
                key, number = (code[a], part[a]), 0
            rows, impacts = np.concatenate([rows, own_rows[a:b]]), np.concatenate([impacts, own_impacts[a:b]])
            while len(rows) >= BLOCK_ROWS:
                close(BLOCK_ROWS)
        if made:
            yield sent()
    if len(rows):
        close(len(rows))
        yield sent()


def threshold(bar: int, tops: np.ndarray) -> int:
    """The greatest t for which less than t in every list, and no more than its top, adds up to less than bar; 1 at least."""
    low, high = 0, int(tops.max(initial=0))
    while low < high:  # the greatest t - 1 of which the sum stays under bar
        middle = (low + high + 1) // 2
        low, high = (middle, high) if int(np.minimum(middle, tops).sum()) < bar else (low, middle - 1)
    return low + 1


@dataclass(frozen=True)
class Plan:
    """What cells judge by: the items, weights, and for each item its bar, its threshold, and what each of its lists adds at most unseen."""

    items: Items
    weights: Weights
    bars: list[int]
    thresholds: list[int]
    caps: list[np.ndarray]
    k: int


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Beginnings and ends of the runs of equal keys."""
    n = len(keys[0])
    starts = np.flatnonzero(np.r_[True, reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])]).tolist() if n else []
    return list(zip(starts, [*starts[1:], n], strict=False))


def _by_code(codes: np.ndarray, at: np.ndarray, impacts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(codes, kind="stable")
    codes, at, impacts = codes[order], at[order], impacts[order]
    return {int(codes[a]): (at[a:b], impacts[a:b]) for a, b in _runs(codes)}


def judged(plan: Plan, sent: pa.Table, own: pa.Table) -> pa.Table:
    """The second and third phase in one cell: sent (code, row, impact) are the postings that arrived, own (row, doc_id, n, codes, tfs) its documents."""
    rows, doc_ids = own.column("row").to_numpy(), own.column("doc_id")
    first, out = (int(rows.min()) if len(rows) else 0), []
    width = int(rows.max()) - first + 1 if len(rows) else 0
    place = np.zeros(width, np.int64)
    place[rows - first] = np.arange(len(rows))
    arrived = _by_code(sent.column("code").to_numpy(), sent.column("row").to_numpy() - first, sent.column("impact").to_numpy())
    held = None
    for i in range(len(plan.items.ids)):
        codes, least = plan.items.of_item(i), plan.thresholds[i]
        reach = np.full(width, int(plan.caps[i].sum()))
        touched = np.zeros(width, bool)
        for code, cap in zip(codes.tolist(), plan.caps[i].tolist(), strict=True):
            if code in arrived:
                at, impacts = arrived[code]
                n = int(np.searchsorted(-impacts, -least, side="right"))  # they come in falling order
                reach[at[:n]] += impacts[:n] - cap
                touched[at[:n]] = True
        left = np.flatnonzero(touched & (reach >= plan.bars[i]))
        if not len(left):
            continue
        if held is None:
            counts, flat, impacts = _flat(own, plan.weights)
            held = _by_code(flat, np.repeat(rows - first, counts), impacts)
        exact = np.zeros(width, np.int64)
        for code in codes.tolist():
            if code in held:
                exact[held[code][0]] += held[code][1]
        left = left[exact[left] >= max(plan.bars[i], 1)]
        ids = [doc_ids[int(x)].as_py() for x in place[left]]
        best = sorted(zip((-exact[left]).tolist(), [(x is not None, x or 0) for x in ids], ids, (left + first).tolist(), strict=True))[: plan.k]
        out += [(i, row, doc_id, -score) for score, _, doc_id, row in best]
    names, types = ["item", "row", "doc_id", "score"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)


def _first(sums: DataFrame, k: int) -> DataFrame:
    """The k rows of greatest score of each item, with their place n."""
    own = Window.partitionBy("item").orderBy(F.desc("score"), "row")
    return sums.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k)


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    forward = materialise(counted(docs, items.terms).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "forward")
    total = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    df = np.zeros(len(items.terms), np.int64)
    for r in forward.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # a row for each of the items' terms
        df[r.code] = r["count"]
    weights = Weights(np.floor(1000 * np.log((2 * total.docs + 2) / (2 * df + 1))).astype(np.int64), total.docs, total.terms)
    slices = np.maximum(1, -(-df // SLICE_ROWS))
    dealt = forward.select("row", "n", "codes", "tfs").mapInArrow(_postings(weights, slices), "code int, slice int, row long, impact long").repartition("code", "slice")
    blocks = materialise(dealt.sortWithinPartitions("code", "slice", F.desc("impact")).mapInArrow(_blocks, "code int, slice int, block int, top long, rows array<long>, impacts array<long>"), "blocks")

    query = F.broadcast(spark.createDataFrame([(i, int(c)) for i in range(len(items.ids)) for c in items.of_item(i)], "item int, code int"))
    heads = blocks.where("block = 0").select("code", F.explode(F.arrays_zip(F.slice("rows", 1, k).alias("row"), F.slice("impacts", 1, k).alias("impact"))).alias("x")).select("code", "x.*")
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("impact"), "row"))).where(F.col("n") <= k)
    sums = heads.join(query, "code").groupBy("item", "row").agg(F.sum("impact").alias("score"))
    probes = materialise(_first(sums, PROBES * k).select("item", "row"), "probes")  # PROBES * k an item at most

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, codes, impacts = _flat(batch, weights)
            ends = np.cumsum(counts)
            wanted = batch.column("item").to_pylist()
            scores = [int(impacts[e - n : e][np.isin(codes[e - n : e], items.of_item(i))].sum()) for i, e, n in zip(wanted, ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("row"), pa.array(scores, pa.int64())], ["item", "row", "score"])

    known = forward.join(F.broadcast(probes), "row").select("item", "row", "n", "codes", "tfs").mapInArrow(look_up, "item int, row long, score long")
    bars = {r["item"]: r.score for r in _first(known, k).where(F.col("n") == k).collect()}
    tops = np.zeros(len(items.terms), np.int64)
    for r in blocks.groupBy("code").agg(F.max("top").alias("top")).collect():
        tops[r.code] = r.top
    bar = [bars.get(i, 0) for i in range(len(items.ids))]
    least = [threshold(bar[i], tops[items.of_item(i)]) for i in range(len(items.ids))]
    plan = Plan(items, weights, bar, least, [np.minimum(least[i] - 1, tops[items.of_item(i)]) for i in range(len(items.ids))], k)
    start = np.full(len(items.terms), np.iinfo(np.int64).max)
    for i, t in enumerate(least):
        np.minimum.at(start, items.of_item(i), t)

    cut = F.broadcast(spark.createDataFrame([(c, int(t)) for c, t in enumerate(start)], "code int, from long"))
    opened = blocks.join(cut, "code").where(F.col("top") >= F.col("from")).select("code", "from", F.explode(F.arrays_zip("rows", "impacts")).alias("x"))
    cell = lambda row: F.shiftright(row, CELL_BITS).alias("cell")
    sent = opened.where(F.col("x.impacts") >= F.col("from")).select("code", F.col("x.rows").alias("row"), F.col("x.impacts").alias("impact"), cell(F.col("x.rows")))
    held = spark.sparkContext.broadcast(plan)
    own = forward.select("row", "doc_id", "n", "codes", "tfs", cell(F.col("row")))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        # in falling order of impact within a code, as the lists have it
        return judged(held.value, left.sort_by([("code", "ascending"), ("impact", "descending")]), right)

    found = sent.groupBy("cell").cogroup(own.groupBy("cell")).applyInArrow(judge, "item int, row long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long"))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's (item_id, text) k documents (doc_id, text) of highest score above 0, ties by ascending doc_id.

    The N documents with at least one term have L terms in all; a document has n, df of them hold a term, and tf is its count in one.  A
    term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))) and adds w ((10^9 tf) div (1000 tf + 8 m)), where m = 10 + (90 n N) div L.

    Null and empty texts have no terms: such items have no rows and such documents are in none.  Rows of one item_id (null too) are one item with the terms
    of all; rows of one doc_id (null too) are documents of their own, null before others in ties.  Columns other than these are left out.
    """
    terms = F.explode(text_terms(F.col("text").cast("string"))).alias("term")
    query = materialise(items.select(F.col("item_id").cast("long").alias("item_id"), terms).distinct(), "terms")
    parts = max(1, -(-query.count() // PAIRS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    own = [Items.of([(r.item_id, r.term) for r in query.where(part == i).collect()]) for i in range(parts)]
    found = [_search(docs, x, k) for x in own if x.ids]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
