"""Repair of the turn structure of conversations by a min-plus matrix scan.

A well-formed conversation reads `(s?(ua)+)?` by the initials of its roles: at times a system turn, then user and assistant by turns.  That is
an automaton of four states, so what edits can do with one turn is a 4 x 4 matrix: from state i to state j at least cost, with the
initials of the edits (the audit).  Elements are pairs (cost, audit) of which the lesser is better; a product adds costs and joins
audits.  Inserted turns are the closure of the insert matrix, put between turns.  Products are associative, and of equal cost no audit
of the same turns is the beginning of another, so that least parts make least wholes: a conversation may be cut anywhere, its parts
multiplied apart and combined in a tree.

Turns are sorted by ranges, which also cut a long conversation: a task multiplies what it has of each conversation, and only the first
and last conversations of tasks, two a task at most, go on to be combined, FAN at a time.  What is counted along the order (gaps, illegal neighbours) is
a monoid that goes the same way.  Rows of one turn, role and text fall together into one with their number, so copies are no load.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import materialise, table

#: Space and the controls 9 to 13: what a blank text is made of.
WHITE = " \t\n\x0b\x0c\r"
#: Parts of a conversation that are combined at a time.
FAN = 16
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 1, 2, 5, 5

# States: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.  A conversation ends in 0 or 3.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")

Cell = tuple[int, str]
#: Row by row; None where no edits lead from i to j.
Matrix = tuple[Cell | None, ...]


def _matrix(cells: Iterable[tuple[int, int, Cell]]) -> Matrix:
    out: list[Cell | None] = [None] * 16
    for i, j, cell in cells:
        at = 4 * i + j
        out[at] = cell if out[at] is None else min(out[at], cell)
    return tuple(out)


def _product(a: Matrix, b: Matrix) -> Matrix:
    return _matrix((i, j, (x[0] + y[0], x[1] + y[1])) for i in range(4) for k in range(4) if (x := a[4 * i + k]) for j in range(4) if (y := b[4 * k + j]))


_known = lru_cache(maxsize=1 << 16)(_product)
#: Products of parts with audits of about so many edits at most are remembered: most conversations are short and much alike.
SHORT = 8


def product(a: Matrix, b: Matrix) -> Matrix:
    short = all(len(next(c for c in m if c)[1]) <= SHORT for m in (a, b))
    return _known(a, b) if short else _product(a, b)


UNIT = _matrix((i, i, (0, "")) for i in range(4))
_ONE_INSERT = _matrix((i, j, (INSERT, "I")) for role in "ua" for i, j in MOVES[role].items())
#: No insert, one or more: three reach every state that inserts can.
INSERTS = reduce(lambda have, _: product(have, _matrix([(i, j, c) for m in (UNIT, _ONE_INSERT) for i in range(4) for j in range(4) if (c := m[4 * i + j])])), range(3), UNIT)


@cache
def turn_matrix(kind: str) -> Matrix:
    """One turn, with the inserts before it.  Its kind is its role's initial (s, u, a; x for any other), a capital if its text is truncated, or d if it must be deleted."""
    cells = [(i, i, (DELETE, "D")) for i in range(4)]
    if kind != "d":
        more = OPEN_END * kind.isupper()
        cells += [(i, j, (KEEP + more, "K")) for i, j in MOVES.get(kind.lower(), {}).items()]
        cells += [(i, j, (REROLE + more, "R")) for role in "ua" for i, j in MOVES[role].items()]
    return product(INSERTS, _matrix(cells))


def folded(parts: list[Matrix]) -> Matrix:
    """The product of the parts, in order, as a tree."""
    while len(parts) > 1:
        parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else UNIT


def cheapest(matrix: Matrix) -> Cell:
    whole = product(matrix, INSERTS)
    return min(whole[j] for j in ENDS if whole[j])


class Part(NamedTuple):
    """What is known of consecutive turns of a conversation; rows is 0 for none."""

    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int  # distinct numbers
    first_turn: int | None  # the least number: nulls come first, and are no number
    last_turn: int | None
    first_role: str | None  # initials
    last_role: str | None
    matrix: Matrix


NOTHING = Part(0, 0, 0, 0, 0, 0, None, None, None, None, UNIT)


def joined(parts: list[Part]) -> Part:
    """The parts as one, in order."""
    own = [p for p in parts if p.rows]
    if not own:
        return NOTHING
    numbered = [p for p in own if p.first_turn is not None]
    pairs = list(zip(own, own[1:], strict=False))
    return Part(
        *(sum(getattr(p, n) for p in own) for n in ("rows", "blank", "duplicate", "truncated")),
        sum(p.illegal for p in own) + sum(a.last_role + b.first_role not in LEGAL for a, b in pairs),
        sum(p.turns for p in own) - sum(a.last_turn == b.first_turn for a, b in zip(numbered, numbered[1:], strict=False)),
        numbered[0].first_turn if numbered else None,
        numbered[-1].last_turn if numbered else None,
        own[0].first_role,
        own[-1].last_role,
        folded([p.matrix for p in own]),
    )


def turn_part(turn: int | None, role: str, blank: bool, truncated: bool, again: bool, copies: int) -> Part:
    """One row and its copies; again if its role and text stood in an earlier turn."""
    initial = role[:1]
    kind = initial if initial in ("s", "u", "a") else "x"
    kind = "d" if blank or again else kind.upper() if truncated else kind
    further, whole = copies - 1, turn_matrix(kind)
    power = turn_matrix("d")
    while further:  # copies of a row must go: a power of one matrix, by squares
        if further & 1:
            whole = product(whole, power)
        further >>= 1
        if further:
            power = product(power, power)
    further = copies - 1
    cut = int(truncated and not blank and not again)
    illegal = further * (initial + initial not in LEGAL)
    return Part(copies, copies * blank, 0 if blank else further + again, cut, illegal, int(turn is not None), turn, turn, initial, initial, whole)


# Damage, by the crc32 of conversation and turn modulo 20.
DAMAGES = {"drop": 0, "empty": 1, "open": 2, "repeat": 3, "user": 4}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after damage; a dropped row stays, with no copies, so that its conversation does.  Null counts as one space in text, role and the key."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    case = lambda name: kind == DAMAGES[name]
    text = F.when(case("empty"), "").when(case("open"), F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(case("drop"), 0).when(case("repeat"), 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(case("user"), "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The same without damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.lit(1).alias("copies"))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


#: Ascending, so nulls first.
ORDER = ["conv_id", "turn", "role", "digest"]
_PART = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string, costs array<long>, audits array<string>"


def _row(part: Part) -> dict:
    return part._asdict() | {"costs": [c[0] if c else None for c in part.matrix], "audits": [c[1] if c else None for c in part.matrix]}


def _part(row: dict) -> Part:
    return Part(*(row[n] for n in Part._fields[:-1]), tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)))


_TYPES = {"part": pa.int32(), "edge": pa.bool_(), "first_role": pa.string(), "last_role": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
_NAMES = ["conv_id", "part", *(x.split()[0] for x in _PART.split(", "))]


def _sent(rows: list[dict], names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[n] for r in rows], _TYPES.get(n, pa.int64())) for n in names], names)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as one part for each conversation of this task; edge marks the first and the last, which other tasks may go on with."""
    task, held, conv, first = TaskContext.get().partitionId(), [], None, True
    names = [*_NAMES, "edge"]

    def closed(edge: bool) -> dict:
        return {"conv_id": conv, "part": task, "edge": edge} | _row(joined(held))

    started = False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if started and r["conv_id"] != conv:
                out.append(closed(first))
                held, first = [], False
            conv, started = r["conv_id"], True
            if r["copies"]:
                held.append(turn_part(r["turn"], r["role"], r["blank"], r["truncated"], r["again"], r["copies"]))
            if len(held) >= 4096:
                held = [joined(held)]
        if out:
            yield from _sent(out, names).to_batches()
    if started:
        yield from _sent([closed(True)], names).to_batches()


def _combined(rows: pa.Table) -> pa.Table:
    own = sorted(rows.to_pylist(), key=lambda r: r["part"])
    return _sent([{"conv_id": own[0]["conv_id"], "part": own[0]["part"] // FAN} | _row(joined([_part(r) for r in own]))], _NAMES)


def parts(turns_: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, copies) as one row of _PART for each conversation, whatever its length."""
    spark = turns_.sparkSession
    bare = F.rtrim("text", F.lit(WHITE))
    facts = turns_.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), "copies")
    none = F.col("copies") == 0
    facts = facts.select("conv_id", *(F.when(~none, F.col(c)).alias(c) for c in ("turn", "role", "digest", "blank", "truncated")), "copies")
    facts = materialise(facts.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.sum("copies").alias("copies")), "turns")
    # a text seen in an earlier turn: nulls come first, so where a turn has none only its own copies are earlier
    earliest = facts.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("places"), F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")).alias("first"))
    repeated = earliest.where("places > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    again = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn") > F.col("first")
    marked = facts.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left").withColumn("again", F.coalesce(again, F.lit(False))).drop("c", "r", "d", "first")
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = marked.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER)
    made = materialise(dealt.mapInArrow(_multiply, f"conv_id long, part int, {_PART}, edge boolean"), "parts")
    edges, width = made.where("edge").drop("edge"), tasks
    while width > 1:
        edges = edges.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("fan")).applyInArrow(_combined, f"conv_id long, part int, {_PART}")
        width = -(-width // FAN)
    return made.where("not edge").drop("edge").unionByName(edges).drop("part")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's counts and cheapest edits."""
    schema = pa.schema([(n, pa.int64()) for n in _COUNTS] + [("audit", pa.string())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit = cheapest(_part(r).matrix)
            gaps = 0 if r["first_turn"] is None else r["last_turn"] - r["first_turn"] + 1 - r["turns"]
            out.append({n: r[n] for n in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's row (audit not null), then its turns in order: the row, with the hash of the repaired turns; one text at a time."""
    sha, state, audit, at, own, any_yet = hashlib.sha256(), 0, "", 0, None, False
    schema = pa.schema([(n, pa.int64()) for n in _COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def put(initial: str, line: str | None, text: str = "") -> None:
        nonlocal state, any_yet
        state = MOVES[initial][state]
        sha.update(("\n" * any_yet + (line if line is not None else {"u": "user", "a": "assistant"}[initial]) + ":" + text).encode())
        any_yet = True

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put("a" if state == 2 else "u", None)
            at += 1

    def ended() -> dict:
        inserts()
        return {n: own[n] for n in _COUNTS} | {"audit": audit, "repaired_sha256": sha.hexdigest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["audit"] is not None:
                if own:
                    out.append(ended())
                own, audit, at, state, sha, any_yet = r, r["audit"], 0, 0, hashlib.sha256(), False
                continue
            for _ in range(r["copies"]):
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(r["role"][0], r["role"], r["text"])
                elif edit == "R":
                    put("a" if state == 2 else "u", None, r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if own:
        yield pa.RecordBatch.from_pylist([ended()], schema=schema)


_COUNTS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns_: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conv_id of turns (see damaged).

    Rows of a conversation are taken by turn (nulls first), then role, then the hash of the text, so that the order is total but for equal rows.  A
    null conv_id is a conversation of its own.  A conversation without turns has zeros, an empty audit and the hash of nothing.  A SHA-256
    is made from first to last, so one task reads a conversation's sorted texts once more, a batch at a time; it holds no more
    than the audit.
    """
    told = parts(turns_).mapInArrow(_decide, ", ".join(f"{n} long" for n in _COUNTS) + ", audit string")
    nothing = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    heads = told.select(F.lit(0).alias("place"), *_COUNTS, "audit", *nothing("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).alias("copies"))
    rows = turns_.where("copies > 0").select(F.lit(1).alias("place"), "conv_id", *nothing(*_COUNTS[1:]), F.lit(None).cast("string").alias("audit"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", "copies")
    together = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(ORDER[0], "place", *ORDER[1:])
    return together.drop("place", "turn", "digest").mapInArrow(_spell, ", ".join(f"{n} long" for n in _COUNTS) + ", audit string, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
