"""Token counts of whole texts by a byte-level tokenizer, without an id ever being made for what has been seen.

The pre-tokenizer always begins a pre-token at a single space that a character other than white space follows, whatever is before it.
So a text's count is the sum of the counts of its units, the parts between such places: a word's pre-token, at times with its punctuation's.
A unit's length in tokens is looked up on the map side in two tiers: a compact hash table of frequent units that every worker
gets by broadcast, and a cache that each worker fills with those it misses, which the tokenizers library encodes.  Nothing is
shuffled: a text is read, cut and counted where it lies.

The frequent table only saves work.  It is counted on a bounded sample of documents, and a count never depends on it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import table, texts

#: Entries of the broadcast table, and bytes of the longest unit in it: with them the table stays under some 3 MB.
TABLE_ROWS, TABLE_KEY_BYTES = 1 << 16, 40
#: The table is counted on about so many documents (twice as many at most, where texts repeat) and so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 1 << 14
#: A worker forgets its misses once it knows so many; longer units are encoded each time they come.
CACHE_ROWS, CACHE_KEY_CHARS = 1 << 20, 64
#: Characters that are cut into units at a time, about.
PIECE_CHARS = 1 << 20
LIMIT = 1024

#: Where a unit begins.  re's white space holds all of the library's, so that each such place is one of the library's.
_CUT = re.compile(r" (?=\S)")
#: Marks the first unit of a text, which has no space before it; no other unit begins with white space.
_BARE = "\n"


def units(text: str) -> list[str]:
    """The units of text, end to end: without its space each, but the first with _BARE before it."""
    found = text.split(" ") if text.count(" ") == len(_CUT.findall(text)) else _CUT.split(text)
    if found[0]:
        found[0] = _BARE + found[0]
    else:
        del found[0]
    return found


def spelled(unit: str) -> str:
    return unit[1:] if unit[0] == _BARE else " " + unit


def pack_table(counts: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The units' UTF-8 one after the other, the bytes of each, and the tokens of each."""
    keys = [k.encode() for k in counts]
    return b"".join(keys), np.array([len(k) for k in keys], np.uint8).tobytes(), np.array(list(counts.values()), np.uint8).tobytes()


def unpack_table(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    keys, sizes, lengths = packed
    ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64)).tolist()
    return {keys[a:b].decode(): n for a, b, n in zip([0, *ends], ends, lengths, strict=False)}


class TokenCounter:
    """count(texts) gives each text's number of tokens; frequent is the first tier, the cache of misses the second."""

    def __init__(self, file: str, frequent: dict[str, int] | None = None, cache_rows: int = CACHE_ROWS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            kept = {k: v for k, v in json.load(f).items() if k != "model"}
        first, added = kept.get("pre_tokenizer") or {}, kept.get("added_tokens") or []
        plain = all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in added)
        #: Whether texts fall into units between special strings; else the library counts whole texts.
        self.by_units = plain and not kept.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        self.special = re.compile("|".join(sorted((re.escape(x["content"]) for x in added), key=len, reverse=True)) or "(?!)")
        self.frequent, self.cache_rows = frequent or {}, cache_rows
        self.seen: dict[str, int] = {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def pieces(self, text: str) -> Iterator[str]:
        """text in consecutive pieces that begin where a unit does."""
        at = 0
        while len(text) - at > PIECE_CHARS and (cut := _CUT.search(text, at + PIECE_CHARS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def count(self, batch: list[str]) -> list[int]:
        if not self.by_units:
            return self.lengths(batch)
        out, missed, owner, get = [0] * len(batch), [], [], self.frequent.get
        for i, text in enumerate(batch):
            between = self.special.split(text) if "<" in text or not self.special.pattern.startswith("<") else [text]
            out[i] = len(between) - 1
            for part in between:
                for piece in self.pieces(part):
                    found = units(piece)
                    known = [*map(get, found)]
                    out[i] += sum(filter(None, known))
                    if None in known:
                        odd = [*compress(found, (n is None for n in known))]
                        missed += odd
                        owner.append((i, len(odd)))
            if len(missed) > PIECE_CHARS:  # a batch of long texts
                self._missed(out, missed, owner)
                missed, owner = [], []
        self._missed(out, missed, owner)
        return out

    def _missed(self, out: list[int], missed: list[str], owner: list[tuple[int, int]]) -> None:
        """Adds the counts of the units that the table lacks to their texts' counts."""
        if len(self.seen) > self.cache_rows:
            self.seen.clear()
        new = [x for x in dict.fromkeys(missed) if x not in self.seen]
        if new:
            own = dict(zip(new, self.lengths([*map(spelled, new)]), strict=True))
            long = {k: n for k, n in own.items() if len(k) > CACHE_KEY_CHARS}
            self.seen.update(own)
        counts, at = [*map(self.seen.__getitem__, missed)], 0
        for i, n in owner:
            out[i] += sum(counts[at : at + n])
            at += n
        if new:
            for k in long:
                del self.seen[k]


def frequent_table(docs: DataFrame, file: str, rows: int = TABLE_ROWS) -> tuple[bytes, bytes, bytes]:
    """The commonest units of the sampled documents (text) with their lengths in tokens, packed."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = TokenCounter(file), Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                for part in counter.special.split(text):
                    seen.update(units(part))
        common = [k for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if len(k.encode()) <= TABLE_KEY_BYTES][:rows]
        lengths = counter.lengths([*map(spelled, common)])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in pack_table(dict(zip(common, lengths, strict=True)))], names)

    names = ["keys", "sizes", "lengths"]
    total = max(docs.count(), 1)
    share = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(2.0**53)
    sample = docs.where(share <= min(1.0, SAMPLE_DOCS / total)).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_DOCS)
    packed = sample.repartition(1).mapInArrow(tally, "keys binary, sizes binary, lengths binary").first()
    return tuple(bytes(packed[n]) for n in names) if packed else (b"", b"", b"")


_held: dict[tuple[str, str], TokenCounter] = {}


def _counter(file: str, name: str, packed: Broadcast) -> TokenCounter:
    """The worker's own, which keeps its misses from task to task."""
    if (file, name) not in _held:
        _held.clear()
        _held[file, name] = TokenCounter(file, unpack_table(packed.value))
    return _held[file, name]


def count_tokens(docs: DataFrame, file: str, limit: int = LIMIT, table_rows: int = TABLE_ROWS) -> DataFrame:
    """docs (doc_id, text; other columns are left out) as doc_id, n_bytes, n_tokens, over_limit, a row for each row.

    Ids are those of the library's plain call: no tokens are added, special strings inside a text are one token each, nothing is cut or filled
    up.  A null or empty text has no bytes and no tokens; null and repeated doc_ids are kept as they are.  A text is cut into units
    a piece at a time, so a very long one takes the memory of a piece.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    packed, name = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, file, table_rows)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file, name, packed)
        for batch in batches:
            n = pa.array(counter.count(texts(batch.column("text"))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def byte_level_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), byte_level_file())
