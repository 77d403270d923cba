"""Token-id output: one zstandard frame a document, a dictionary shared by all, an index of offsets.

A store is a folder of two Parquet tables that any executor can write and read through Spark's own commit protocol:

* `dictionary`: one row (dict_sha256, dictionary);
* `blocks`: one row a block of consecutive documents in ascending doc_id order, with `part` and `block` (their order),
  `first_doc_id`, `last_doc_id`, `n_docs`, `n_tokens`, `start` (ids before it in its part) and `payload`.

A payload is, little-endian: the magic `DTK1`, u32 number of documents, u32 bytes of an id, the 32 bytes of the dictionary's
SHA-256, an index entry for each document (i64 doc_id, u64 offset and u32 length of its frame, u32 number of ids, whose highest bit marks a
document without doc_id), and the frames.
A document is found by its index entry and decompressed alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import shared_dir, table, texts
from delve.llm.tokens import default_file, encoder

MAGIC = b"DTK1"
#: A block is closed at either bound.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
#: The dictionary is trained on about so many documents, those of smallest hashed id, and on so many ids of each; it may be so large.
#: This bounds what the driver holds (twice as many documents, where ids repeat); every document is encoded whole.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1500, 2048, 1 << 16
#: Bytes of text of a part, about.
PART_BYTES = 64 << 20
_NO_ID = np.uint32(1 << 31)
END_ID = 2
_HEAD = struct.Struct("<4sII32s")
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
BLOCKS = (
    "part int, block int, first_doc_id long, last_doc_id long, n_docs int, n_tokens long, start long, dict_sha256 string, payload binary"
)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for frames like the samples; empty if they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack_block(doc_ids: list[int | None], frames: list[bytes], counts: list[int], width: int, dict_hash: bytes) -> bytes:
    index = np.zeros(len(doc_ids), _ENTRY)
    index["doc_id"], index["n_tokens"] = [x or 0 for x in doc_ids], counts
    index["n_tokens"] |= np.array([x is None for x in doc_ids], np.uint32) * _NO_ID
    index["length"] = lengths = np.fromiter(map(len, frames), np.int64, len(frames))
    index["offset"] = _HEAD.size + index.nbytes + np.cumsum(lengths) - lengths
    return b"".join([_HEAD.pack(MAGIC, len(doc_ids), width, dict_hash), index.tobytes(), *frames])


def block_index(payload: bytes) -> tuple[np.ndarray, np.ndarray, int, bytes]:
    """The index of a block, which of its documents have no doc_id, the bytes of an id, and the hash of its dictionary."""
    magic, n, width, dict_hash = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    index = np.frombuffer(payload, _ENTRY, n, _HEAD.size).copy()
    no_id = index["n_tokens"] >= _NO_ID
    index["n_tokens"] &= ~_NO_ID
    return index, no_id, width, dict_hash


def read_document(payload: bytes, entry: np.void, width: int, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    """The ids of one document, from its own frame."""
    at = int(entry["offset"])
    raw = decompressor.decompress(payload[at : at + int(entry["length"])], max_output_size=int(entry["n_tokens"]) * width)
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def _sample(docs: DataFrame, rows: int, file: str, width: int) -> list[bytes]:
    """The first ids of about SAMPLE_DOCS of so many rows: those whose hash is under that share of all hashes, so that none is ranked or moved."""

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = encoder(file).encode(texts(batch.column(0)))
            at = np.concatenate([[0], np.cumsum(counts)])
            cut = [ids[a : min(b, a + SAMPLE_IDS)].astype(f"<u{width}").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["raw"])

    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    chosen = docs.where(share <= min(1.0, SAMPLE_DOCS / max(rows, 1))).select("text")
    return sorted(bytes(r.raw) for r in chosen.mapInArrow(serialise, "raw binary").limit(2 * SAMPLE_DOCS).collect())


def write_token_ids(docs: DataFrame, path: str, file: str, end_id: int = END_ID, parts: int | None = None, level: int = 3) -> None:
    """Encode every whole text of docs (doc_id, text; other columns are ignored) and write a store in ascending doc_id order.

    A null text is empty: its ids are the end id alone.  Rows of one doc_id are kept, next to each other, by a hash of their texts; rows
    without doc_id come first.  An empty table makes a store without blocks.  parts follows from the bytes of text unless it is given.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if encoder(file).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    dictionary = train_dictionary(_sample(docs, size.rows, file, width))
    dict_hash = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(dict_hash.hex(), bytearray(dictionary))], "dict_sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        end = np.array([end_id], f"<u{width}").tobytes()
        own: list[int | None] = []
        frames: list[bytes] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            payload = pack_block(own, frames, counts, width, dict_hash)
            named = [x for x in own if x is not None]
            row = (part, number, min(named, default=None), max(named, default=None), len(own), sum(counts), before, dict_hash.hex(), payload)
            number, before = number + 1, before + sum(counts)
            for x in (own, frames, counts):
                x.clear()
            return pa.RecordBatch.from_pylist([dict(zip(_NAMES, row, strict=True))], schema=_SCHEMA)

        size = 0
        for batch in batches:
            ids, n = encoder(file).encode(texts(batch.column("text")))
            raw = memoryview(ids.astype(f"<u{width}").tobytes())
            at = np.concatenate([[0], np.cumsum(n)]) * width
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                frame = compressor.compress(bytes(raw[at[i] : at[i + 1]]) + end)
                own.append(doc_id)
                frames.append(frame)
                counts.append(int(n[i]) + 1)
                size += len(frame)
                if size >= BLOCK_BYTES or len(own) >= BLOCK_DOCS:
                    yield flush()
                    size = 0
        if own:
            yield flush()

    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // PART_BYTES))
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("n_docs", pa.int32())]
    + [("n_tokens", pa.int64()), ("start", pa.int64()), ("dict_sha256", pa.string()), ("payload", pa.binary())]
)
_NAMES = _SCHEMA.names


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The blocks of a store and its dictionary (at most DICTIONARY_BYTES)."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(head.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != head.dict_sha256:
        raise ValueError("the dictionary does not have the hash it is stored under")
    from pyspark.sql.types import _parse_datatype_string

    return spark.read.schema(_parse_datatype_string(BLOCKS)).parquet(f"{path}/blocks"), dictionary


def _decoder(dictionary: bytes, with_ids: bool):
    wanted = hashlib.sha256(dictionary).digest()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for k in range(batch.num_rows):
                payload = batch.column("payload")[k].as_buffer().to_pybytes()
                index, no_id, width, dict_hash = block_index(payload)
                if dict_hash != wanted:
                    raise ValueError("a block names another dictionary")
                ids = [read_document(payload, x, width, decompressor) for x in index]
                counts = index["n_tokens"].astype(np.int64)
                columns = {
                    "doc_id": pa.array(index["doc_id"].astype(np.int64), mask=no_id),
                    "start": pa.array(batch.column("start")[k].as_py() + np.cumsum(counts) - counts),
                    "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return decode


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids.

    Only the totals of the store's parts meet on the driver: one number for each partition that wrote it.
    """
    blocks, dictionary = open_store(spark, path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r.part, before))
        before += r.n
    starts = F.broadcast(spark.createDataFrame(rows, "part int, part_start long"))
    blocks = blocks.join(starts, "part").select((F.col("start") + F.col("part_start")).alias("start"), "payload")
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(_decoder(dictionary, with_ids), fields)


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document, for each row of that doc_id: only blocks whose range holds it are read, only its frames opened."""
    blocks, dictionary = open_store(spark, path)
    found = blocks.where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).select("payload").toLocalIterator()
    decompressor, out = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)), []
    for r in found:
        payload = bytes(r.payload)
        index, no_id, width, _ = block_index(payload)
        out += [read_document(payload, x, width, decompressor).tolist() for x in index[(index["doc_id"] == doc_id) & ~no_id]]
    return out


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to a store in the shared folder and return what the store holds."""
    path = f"{shared_dir(spark)}/ids"
    write_token_ids(table(spark, sf_dir, "documents"), path, default_file())
    return read_token_ids(spark, path)
