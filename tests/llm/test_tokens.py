import random
import zlib
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from delve.llm import packing as P
from delve.llm import token_store as S
from delve.llm.tokens import BatchEncoder, default_file

ODD = [
    "", "  ", "áb It's H̱ x", "İI ΣΑΣ σ", "don't!'s <|endoftext|> x\x1cy\x85z q", "foo.bar,,baz's A''s", "12ab34 ½", "naïve Été là", "ﬁ K",
    "a!b 'll x'LL ≮ ≮=", "한국어 中文 ١٢", "Ünï. ÉCOLE!!", "́a  b c", "x" * 5000, "SHOUT!! shout!!", "🙂🙂a _ __a", None,
]


@cache
def library():
    return Tokenizer.from_file(default_file())


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("cache", [3, 10**6])
def test_words_make_the_ids_of_the_whole_text(cache):
    encoder = BatchEncoder(default_file(), cache)
    for _ in range(2):
        for batch in (ODD[:9], ODD[9:]):
            flat, counts = encoder.encode([x or "" for x in batch])
            ends = np.cumsum(counts)
            for text, end, n in zip(batch, ends, counts, strict=True):
                assert flat[end - n : end].tolist() == ids(text), text


def test_fuzz_against_the_library():
    """Marks, letters with odd lower cases, capitals, special tokens in both cases, odd white space and punctuation, in short random texts."""
    rng, encoder = random.Random(11), BatchEncoder(default_file())
    parts = ["A", "a", "K", "É", "é", "İ", "I", "Σ", "ΑΣ", "ς", "\u0301", "\u0307", "ß", "ẞ", "ﬁ", "Ⅷ", "1", "٢", "½", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "\u2028", "\u200b"]
    parts += ["'s", "'LL", "!", ".", "_", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "word", "Word", "中", "한", "\u1100\u1161", "🙂", "Ǆ", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    flat, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, e, n in zip(texts, ends, counts, strict=True):
        assert flat[e - n : e].tolist() == ids(text), ascii(text)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i * 3 % 17, t, "x") for i, t in enumerate(ODD)] + [(5, "twice", "y"), (5, "twice", "y"), (-1, "minus", "y"), (None, "no id", "y")], "doc_id long, text string, start string")


def test_store_round_trip(spark, odd, tmp_path):
    S.write_token_ids(odd, str(tmp_path / "s"), default_file())
    got = S.read_token_ids(spark, str(tmp_path / "s"), with_ids=True).collect()
    want = sorted((str(r.doc_id), [*ids(r.text), 2]) for r in odd.collect())
    assert sorted((str(r.doc_id), r["ids"]) for r in got) == want
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before and r.n_tokens == len(r["ids"]) and r.ids_crc32 == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        before += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert S.lookup(spark, str(tmp_path / "s"), 3) == [[*ids(ODD[1]), 2]]
    assert len(S.lookup(spark, str(tmp_path / "s"), 5)) == 3 and S.lookup(spark, str(tmp_path / "s"), 99) == []
    assert S.lookup(spark, str(tmp_path / "s"), -1) == [[*ids("minus"), 2]] and S.lookup(spark, str(tmp_path / "s"), 0) == [[2]]


def test_registered_query(spark):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()))
    before = 0
    for (doc_id, text), r in zip(rows, sorted(S.op2_token_store(spark, "/root/testdata/sf0.001").collect()), strict=True):
        flat = np.array([*ids(text), 2], "<u4")
        assert tuple(r) == (doc_id, before, len(flat), zlib.crc32(flat.tobytes()))
        before += len(flat)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    S.write_token_ids(empty, str(tmp_path / "s"), default_file())
    assert S.read_token_ids(spark, str(tmp_path / "s")).count() == 0
    assert P.pack(empty, default_file()).count() == 0


def test_dictionary_is_trained_and_used(spark, tmp_path):
    S.write_token_ids(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "s"), default_file())
    _, dictionary = S.open_store(spark, str(tmp_path / "s"))
    assert len(dictionary) > 1000


def check_packing(rows, cap=4096):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= cap
    return len(at)


def test_pieces_and_sequences(spark, odd):
    long = spark.createDataFrame([(50, "word " * 9000, "x")], odd.schema)
    rows = P.pack(odd.union(long), default_file()).collect()
    check_packing(rows)
    own = sorted((r for r in rows if r.doc_id == 50), key=lambda r: r.piece)
    flat = np.array([*ids("word " * 9000), 1], "<u4")
    assert [(r.start, r.length) for r in own] == [(0, 4096), (4096, 4096), (8192, len(flat) - 8192)]
    assert [r.ids_crc32 for r in own] == [zlib.crc32(flat[r.start : r.start + r.length].tobytes()) for r in own]
    assert len(rows) == len(ODD) + 4 + 3


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_constraint_holds(score):
    lengths = np.random.default_rng(1).integers(1, 900, 700)
    cap = P.Capacity(tokens=1000, documents=3, attention=700_000, score=score, weights=(1, 1, 1))
    bins, offsets = P.best_fit(np.minimum(lengths, 800), cap)
    for b in np.unique(bins):
        own = np.minimum(lengths, 800)[bins == b]
        assert own.sum() <= 1000 and len(own) <= 3 and (own**2).sum() <= 700_000


def test_packing_is_near_the_bound(spark):
    rows = P.op3_packing(spark, "/root/testdata/sf0.01").collect()
    assert check_packing(rows) <= -(-sum(r.length for r in rows) // 4096) * 1.01 + 1
