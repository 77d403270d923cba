import hashlib
import random

import numpy as np
import pytest

from delve.llm import bwt_merge as B
from delve.llm import substring_dedup as D
from delve.llm.bwt_merge import load, repeats, suffix_order, transform


def brute(rows, n=50):
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - n + 1):
            g = raw[p : p + n]
            least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - n + 1):
            if least[raw[p : p + n]] < i:
                gone[p : p + n] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(raw)]).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéñ ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(30), text(12)
    out = [text(rng.randrange(0, 120)) for _ in range(60)]
    out += [text(rng.randrange(0, 20)) + passage[rng.randrange(40) :] + text(9) for _ in range(40)]
    out += [text(3) + other + text(3) + passage[:70] + other + other for _ in range(30)]
    out += ["ab" * 300, "ab" * 400, "ba" * 30, "x" * 49, "x" * 50, "x" * 500, None, "", out[5], out[5], "\x00" * 120, "\x00" * 60, "The " * 700]
    near = text(200)
    for _ in range(25):
        k = rng.randrange(len(near))
        out.append(near[:k] + "#" + near[k:])
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("batch,bucket,shard,hot", [(8 << 20, 8 << 20, 1 << 20, 20_000), (3000, 100, 1500, 20_000), (3000, 1 << 20, 400, 3)])
def test_equals_brute_force(spark, batch, bucket, shard, hot):
    """Whole batches; small shards in many buckets; anchors with more than three runs split."""
    data = rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, n_bytes string").repartition(3)
    assert sorted(map(tuple, D.dedup(df, batch_bytes=batch, bucket_bytes=bucket, shard_bytes=shard, hot_runs=hot).collect())) == brute(data)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("delve_")]


def test_pieces_of_a_long_document(spark, monkeypatch):
    whole = D.Batch({"ids": np.array([1, 2]).tobytes(), "lengths": np.array([5000, 300]).tobytes(), "data": np.random.default_rng(1).integers(97, 100, 5300, np.uint8).tobytes()}, 50)
    monkeypatch.setattr(D, "PIECE", 170)
    cut = D.Batch({"ids": whole.ids.tobytes(), "lengths": whole.lengths.tobytes(), "data": whole.data.tobytes()}, 50)
    of = lambda b: [(int(d), s, a) for d, s0, n, a in zip(b.doc, b.start, b.count, b.anchor) for s in range(s0, s0 + n)]
    assert of(whole) == of(cut) and len(of(cut)) == 4951 + 251 and len(cut.start) > len(whole.start)


def test_runs_of_one_hash_that_differ(monkeypatch):
    """Runs taken for equal by their hash alone are compared by their bytes, and merged if they differ."""
    texts = [b"a" * 20 + b"common passage of some bytes, long enough for one anchor to be in it" + x for x in (b"1" * 9, b"2" * 9, b"1" * 9)]
    sent = []
    for i, t in enumerate(texts):
        own = D.Batch({"ids": np.array([i]).tobytes(), "lengths": np.array([len(t)]).tobytes(), "data": t}, 50)
        values = own.distinct()
        own.keep(values, np.repeat([[True], [True], [False]], len(values), axis=1))
        sent += [(0, i, D.zstandard.ZstdCompressor().compress(x)) for _, x in D._payloads(own, 0 + 1, 1000)]
    table_ = D.pa.Table.from_batches([D._table(sent, *D._SENT_OF)])
    got = D._merge(50)(table_)
    assert got.num_rows == len(sent)
    assert sum(int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in got["bits"].to_pylist()) == (len(texts[1]) - 9 - 49) + (len(texts[2]) - 49)


def test_query_on_the_small_table(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, D.op4_substring_dedup(spark, "/root/testdata/sf0.001").collect())) == brute(data)


def test_kept_bytes_and_odd_rows(spark):
    a = "".join(map(chr, range(97, 123))) * 3
    data = [(None, a), (4, a), (4, a), (2, "start " + a), (9, "tail" + a[:60] + "end"), (7, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r.doc_id, bytes(r.kept).decode(), r.n_removed) for r in D.dedup(df, with_kept=True).collect()), key=str)
    assert got == sorted([(None, "", 78), (4, "", 78), (4, "", 78), (2, "start " + a, 0), (9, "tailend", 60), (7, "", 0)], key=str)
    assert D.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_of_shards_equals_sorting():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"\x00ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        shard = np.sort([rng.randrange(4) for _ in strings])
        data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(t) for t in strings])
        want = sorted((shard[j], t[i:], j, i) for j, t in enumerate(strings) for i in range(len(t) + 1))
        at = {(j, i): i + j + int(ends[j - 1] if j else 0) for _, _, j, i in want}
        assert suffix_order(data, ends, shard).tolist() == [at[j, i] for _, _, j, i in want]
        before, first = transform(data, ends, shard)
        rows = np.bincount(shard, [len(t) + 1 for t in strings]).astype(int)
        merge = load(before, first, rows, np.bincount(shard))
        assert merge.sizes.tolist() == [len(t) for t in strings]
        n, owner = rng.randint(1, 8), np.array([rng.randrange(4) for _ in strings])
        kind, shift = np.array([rng.randrange(2) for _ in strings]), np.array([rng.randrange(3) for _ in strings])
        got, places, held = {}, [(j, i) for j, t in enumerate(strings) for i in range(len(t) - n + 1)], {}
        for at, interval in zip(*repeats(merge, n, kind, shift, owner), strict=True):
            got.setdefault(int(interval), set()).add(places[at])
        for j, i in places:
            held.setdefault((strings[j][i : i + n], kind[j], shift[j] - i), set()).add((j, i))
        assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in held.values() if len({owner[j] for j, _ in w}) > 1)


def counted(monkeypatch):
    calls = []
    for name in ("sort", "argsort"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **b: calls.append(name) or f(*a, **b))
    return calls


def test_sorts_do_not_grow_with_the_strings(monkeypatch):
    """Tied suffixes are ranked by doubling, and intervals refined by several bytes a step."""
    strings = [b"a" * 2000, b"a" * 1999, b"ab" * 1000, b"a" * 2000]
    data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(t) for t in strings])
    calls = counted(monkeypatch)
    order = suffix_order(data, ends)
    assert len(calls) <= 30  # 500 with four bytes a round
    monkeypatch.undo()
    at = [(t[i:], j) for j, t in enumerate(strings) for i in range(len(t) + 1)]
    assert order.tolist() == sorted(range(len(at)), key=lambda p: at[p])
    before, first = transform(data, ends)
    merge = load(before, first, np.array([len(before)]), np.array([4]))
    calls = counted(monkeypatch)
    at, interval = repeats(merge, 50, np.zeros(4, int), np.zeros(4, int), np.arange(4))
    assert len(calls) <= 20  # 26 with two bytes a step
    assert len(at) == 1951 + 1950 + 1951 and np.bincount(interval).max() == 3  # one start, two or three strings


def test_orders_of_numbers_that_their_high_bits_do_not_tell():
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 1 << 63, 500, np.uint64), rng.integers(0, 9, 500).astype(np.uint64), np.zeros(0, np.uint64)):
        assert B.sorted_order(x).tolist() == np.argsort(x, kind="stable").tolist()
        for used in (63, 64):  # a number and its place do not fit
            order, found = B.sorted_places(x, used)
            assert order.tolist() == np.argsort(x, kind="stable").tolist() and found.tolist() == sorted(x.tolist())
    x = rng.integers(0, 99, 500).astype(np.uint64)
    assert B.sorted_places(x, 7)[0].tolist() == np.argsort(x, kind="stable").tolist()
