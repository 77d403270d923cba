import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from delve.llm import token_counts as C

FILE = C.byte_level_file()
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "a \n b", "a\n b", "a  \nb", "\n\n a", "\t \t x", "don't I'll 's  's 't", "x.'s ''s", "<|endoftext|>", " <|endoftext|> ", "a<|endoftext|><|endoftext|> b <|endof", "<|endoftext",
    "über Straße 中文 한국어 ١٢ ½ 🙂🙂 a　b 　b a   b", "\x1c a \x1d\x1eb \x85 c \xa0 d a \xa0b", "x" * 3000, "\x00 \x00a", "word, word. (word) word!? 12,345.67 http://a.b/c?d=e&f", "ĺe ́x é", "՘ ꟎\U00010940 new",
]


def library(texts):
    t = Tokenizer.from_file(FILE)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
@pytest.mark.parametrize("frequent", [{}, {"a": 1, "\na": 1, "word,": 2, "b": 1}])
def test_counts_are_the_library_s(monkeypatch, piece, frequent):
    monkeypatch.setattr(C, "PIECE_CHARS", piece)
    counter = C.TokenCounter(FILE, frequent, cache_rows=5)
    for _ in range(2):
        assert counter.count([x or "" for x in ODD]) == library(ODD)
    assert counter.count([]) == []


def test_fuzz_against_the_library():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "B", "é", "中", "1", "٢", "'s", "'LL", "'", ".", "!?", "<|endoftext|>", "<|", "|>", "́", "🙂", "word", "​", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    assert C.TokenCounter(FILE).count(texts) == library(texts)


def test_table_round_trip():
    assert C.unpack_table(C.pack_table({"über": 2, "\na": 1, "": 0})) == {"über": 2, "\na": 1, "": 0}
    assert C.unpack_table(C.pack_table({})) == {}


def test_another_kind_of_tokenizer_counts_whole_texts():
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    texts = ["Two  words, here", "", "<|endoftext|> x"]
    assert C.TokenCounter(file).count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_rows_stay_as_they_are(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "twice", "y"), (3, "twice", "y"), (None, "no id", "y"), (9, "w " * 300_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = C.count_tokens(df, FILE, limit=2)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 2) for (i, t, _), n in zip(rows, library([t for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert C.count_tokens(df.limit(0), FILE).collect() == []


@pytest.mark.parametrize("rows", [0, 10, C.TABLE_ROWS])
def test_query_whatever_the_table(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(docs, FILE, table_rows=rows).collect()}
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert got == {r.doc_id: (len(r.text.encode()), n, n > 1024) for r, n in zip(own, library([r.text for r in own]), strict=True)}
