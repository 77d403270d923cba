import hashlib
import re

import pytest

from delve.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n=13):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[k : k + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Über die Brücke, gehen WIR!"), (10, LONG.upper() + " tail"), (3, ""), (4, None), (5, "solo")]
TEXTS = [
    None,
    "",
    "...",
    LONG,
    "before " + " ".join(f"W{i}" for i in range(5, 20)) + " after",
    "x " * 40 + "solo",
    "über  DIE-Brücke gehen wir Über",
    "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11",
    "long " * 300_000 + LONG,
    LONG,
]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 50])
def test_scan_equals_brute_force(spark, slice_bytes):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.scan(docs, bench, slice_bytes=slice_bytes).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        n, h, k, sha = brute(TEXTS[r.doc_id], ITEMS) if r.doc_id != 8 else (300_030, 30, 2, hashlib.sha256(b"1,10").hexdigest())
        assert (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) == (n, h, k, sha), r.doc_id


def test_documents_do_not_run_together(spark):
    docs = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(7))), (1, " ".join(f"w{i}" for i in range(7, 30)))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")
    assert [r.n_hit for r in D.scan(docs, bench).collect()] == [0, 0]


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(0, f"é kept {LONG}, kept"), (1, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert {r.doc_id: r.text for r in D.remove_spans(D.scan(docs, bench)).collect()} == {0: "é kept , kept", 1: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.scan(one, bench).first().n_hit == 0


def test_query_on_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = D.op5_decontaminate(spark, d).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got[::5]:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute(docs[r.doc_id], items)
