"""Ordered folds over logs of any length: a log is cut by ranges of its order, and its parts are joined by what each does to a small state.

Rows are sorted by ranges of key and order, so a key with a third of all rows is many tasks'.  A task folds what it has of each key without
knowing where it begins: as a map from every state before to the state after.  Maps are composed, and only those of the first and last
key of each task meet on the driver, two rows a task, where a prefix scan gives the state that each task begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delve.sources.stage import cut

_PART, _MAP, _LAST = "_part", "_map", "_last"


def sorted_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order)


def key_starts(batch: pa.RecordBatch, by: list[str], before: tuple | None) -> np.ndarray:
    """Which rows begin another key than the row before them; before is the key of the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    for name in by:
        codes = batch.column(name).dictionary_encode().indices
        codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = before != key_at(batch, by, 0)
    return new


def key_at(batch: pa.RecordBatch, by: list[str], i: int) -> tuple:
    return tuple(batch.column(name)[i].as_py() for name in by)


def _extended(rows: DataFrame, extra: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {extra}"


def composed(maps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Inclusive compositions along segments: row i becomes the map of all rows from its segment's first to i.  place is a row's place in its segment."""
    out, d = maps.copy(), 1
    while d <= place.max(initial=0):
        at = np.flatnonzero(place >= d)
        out[at] = np.take_along_axis(out[at], out[at - d], axis=1)
        d *= 2
    return out


def automaton(rows: DataFrame, by: list[str], order: list[str], symbol: Column, table: list[list[int]], start: int = 0, name: str = "before") -> DataFrame:
    """rows with name, the state in which each row finds its key's automaton: it begins in start and goes from s to table[s][symbol] with each row.

    by and order make a total order; a null symbol changes nothing.  At most 15 states.  A map of states is one number in base len(table), so a row
    carries eight bytes, whatever the length of the log.
    """
    states, moves = len(table), np.array(table, np.uint8).T
    if states > 15:
        raise ValueError("at most 15 states")
    powers = states ** np.arange(states, dtype=np.int64)
    same = np.arange(states, dtype=np.uint8)
    spark, numbered = rows.sparkSession, rows.withColumn("_symbol", symbol.cast("int"))
    schema = _extended(numbered, f"{_PART} int, {_MAP} long, {_LAST} boolean")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, first, carry, ends = TaskContext.get().partitionId(), None, None, same, []
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = key_starts(batch, by, key)
            if first is None:
                begins[0] = True
            starts = np.flatnonzero(begins)
            place = np.arange(n) - (np.r_[0, starts] if not begins[0] else starts)[np.cumsum(begins) - begins[0]]
            symbols = batch.column("_symbol")
            own = moves[pc.fill_null(symbols, 0).to_numpy(zero_copy_only=False)]
            own[pc.is_null(symbols).to_numpy(zero_copy_only=False)] = same
            whole = composed(own, place)
            if not begins[0]:  # the first segment goes on with what came before
                stop = starts[0] if len(starts) else n
                whole[:stop] = whole[:stop][:, carry]
            ahead = np.vstack([carry[None], whole[:-1]])
            ahead[starts] = same
            if first is None:
                first = key_at(batch, by, 0)
            elif not ends and len(starts):
                ends.append((first, carry if starts[0] == 0 else whole[starts[0] - 1]))
            if not ends and len(starts) > 1:
                ends.append((first, whole[starts[1] - 1]))
            key, carry, last = key_at(batch, by, n - 1), whole[-1], batch
            columns = [*batch.columns, pa.array([part] * n, pa.int32()), pa.array((ahead.astype(np.int64) * powers).sum(axis=1)), pa.array([False] * n)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, _PART, _MAP, _LAST])
        if last is not None:
            told = [*ends, (key, carry)]
            columns = [pa.array([k[by.index(n)] if n in by else None for k, _ in told], t) for n, t in zip(last.schema.names, last.schema.types, strict=True)]
            columns += [pa.array([part] * len(told), pa.int32()), pa.array([int((m.astype(np.int64) * powers).sum()) for _, m in told]), pa.array([True] * len(told))]
            yield pa.RecordBatch.from_arrays(columns, [*last.schema.names, _PART, _MAP, _LAST])

    made = cut(sorted_ranges(numbered, by, order).mapInArrow(scan, schema))
    held: dict[tuple, int] = {}
    incoming = []
    for r in made.where(_LAST).select(*by, _PART, _MAP).orderBy(_PART).collect():  # two rows a task
        key = tuple(r[n] for n in by)
        if key in held:
            incoming.append((*key, r[_PART], held[key]))
        held[key] = r[_MAP] // states ** held.get(key, start) % states
    kinds = dict(rows.dtypes)
    known = spark.createDataFrame(incoming, ", ".join(f"_k{i} {kinds[n]}" for i, n in enumerate(by)) + ", _p int, _s int")
    match = F.col(_PART) == F.col("_p")
    for i, n in enumerate(by):
        match = match & F.col(n).eqNullSafe(F.col(f"_k{i}"))
    found = made.where(~F.col(_LAST)).join(F.broadcast(known), match, "left")
    power = F.element_at(F.array(*(F.lit(int(p)) for p in powers)), F.coalesce("_s", F.lit(start)) + 1)
    state = F.expr(f"{_MAP} div _power").cast("long") % states
    return found.withColumn("_power", power).withColumn(name, state.cast("int")).select(*rows.columns, name)


def previous(rows: DataFrame, by: list[str], order: list[str], names: list[str]) -> DataFrame:
    """rows with previous_<name> of the row before in its key, null for the first: lag() for keys of any size."""
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    schema = _extended(rows, ", ".join(f"previous_{n} {kinds[n]}" for n in names) + f", {_PART} int, _head boolean, {_LAST} boolean")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins, head = key_starts(batch, by, key), np.zeros(n, bool)
            if last is None:
                begins[0] = head[0] = True
            columns = []
            for name in names:
                own = batch.column(name)
                before = own.slice(0, 0) if last is None else last.column(name).slice(last.num_rows - 1)
                shifted = pa.concat_arrays([before if len(before) else pa.nulls(1, own.type), own.slice(0, n - 1)])
                columns.append(pc.if_else(pa.array(begins), pa.scalar(None, own.type), shifted))
            key, last = key_at(batch, by, n - 1), batch
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([part] * n, pa.int32()), pa.array(head), pa.array([False] * n)], [*batch.schema.names, *(f"previous_{x}" for x in names), _PART, "_head", _LAST])
        if last is not None:
            end = last.slice(last.num_rows - 1)
            none = [pa.nulls(1, end.column(x).type) for x in names]
            yield pa.RecordBatch.from_arrays([*end.columns, *none, pa.array([part], pa.int32()), pa.array([False]), pa.array([True])], [*end.schema.names, *(f"previous_{x}" for x in names), _PART, "_head", _LAST])

    made = cut(sorted_ranges(rows, by, order).mapInArrow(look, schema))
    ends = made.where(_LAST).select(*by, *names, _PART).orderBy(_PART).collect()  # a row a task
    into = [(*a[: len(by) + len(names)], b[_PART]) for a, b in zip(ends, ends[1:], strict=False)]
    known = spark.createDataFrame(into, ", ".join([*(f"_k{i} {kinds[n]}" for i, n in enumerate(by)), *(f"_v{i} {kinds[n]}" for i, n in enumerate(names)), "_p int"]))
    match = F.col("_head") & (F.col(_PART) == F.col("_p"))
    for i, n in enumerate(by):
        match = match & F.col(n).eqNullSafe(F.col(f"_k{i}"))
    found = made.where(~F.col(_LAST)).join(F.broadcast(known), match, "left")
    return found.select(*rows.columns, *(F.when(F.col("_p").isNotNull(), F.col(f"_v{i}")).otherwise(F.col(f"previous_{n}")).alias(f"previous_{n}") for i, n in enumerate(names)))
