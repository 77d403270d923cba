"""Quality classifier: supervised subword embeddings.

Words, word pairs and byte n-grams are hashed to learned vectors; a document is the mean of its vectors, plus the mean of the vectors of
a few structure words (how much of its lines and words repeat); a softmax layer gives the label.  Vectors and layer are trained
together by numpy stochastic gradient descent on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import spans_of_rows, table, utf8
from delve.llm.labelled import families, held_out, sample_ids, segment_sums, sigmoid, with_texts
from delve.llm.wordhash import word_bounds, word_hashes

THRESHOLD = 0.3


@dataclass(frozen=True)
class Params:
    most_per_label: int = 1500  # labelled rows learned from, of each label value, about
    bits: int = 16
    dim: int = 8
    epochs: int = 12
    batch: int = 32
    rate: float = 0.5
    seed: int = 11


#: Structure words: the share of repeated lines and of repeated words, each in 11 steps.
STEPS = 11


def structure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The two structure words of each document."""
    n = len(offsets) - 1
    starts, ends = word_bounds(raw, offsets[:-1])
    words = word_hashes(raw, starts, ends)
    owner = np.searchsorted(offsets[1:], starts, side="right")
    breaks = np.union1d(offsets[:-1], np.flatnonzero(raw == 10))
    breaks = breaks[breaks < len(raw)]
    line = np.searchsorted(breaks, starts, side="right")
    share = []
    for keys, own in ((words, owner), _lines(words, line, owner)):
        total = np.bincount(own, minlength=n)
        distinct = np.bincount(np.unique(np.stack([own.astype(np.uint64), keys]), axis=1)[0].astype(np.int64), minlength=n) if len(keys) else np.zeros(n)
        share.append(np.floor((1 - distinct / np.maximum(total, 1)) * (total > 0) * (STEPS - 1) + 1e-9).astype(np.int64))
    return np.stack([share[0], STEPS + share[1]], axis=1)


def _lines(words: np.ndarray, line: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each line with words, and its document."""
    if not len(words):
        return words, owner
    first = np.r_[0, np.flatnonzero(np.diff(line)) + 1]
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))
    mixed = (words ^ (words >> np.uint64(31))) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.add.reduceat(mixed, first), owner[first]


@dataclass
class Model:
    """What scoring needs: each bucket's and structure word's share of the difference of the two logits, and the constant."""

    buckets: np.ndarray
    steps: np.ndarray
    constant: float
    bits: int


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, weight) of each document; the weights of a document sum to 1."""
    found = list(families(raw, offsets, bits))
    out = []
    for d in range(len(offsets) - 1):
        own = np.concatenate([b[i[d] : j[d]] for b, i, j in found]).astype(np.int64)
        buckets, counts = np.unique(own, return_counts=True)
        out.append((buckets.astype(np.int32), (counts / max(1, len(own))).astype(np.float32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], counts: dict, params: Params) -> Model:
    """rows: buckets, weights, structure words and label (0 or 1).  counts: rows of each label in all, for the prior."""
    p, size = params, 1 << params.bits
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (size + 2 * STEPS, p.dim)).astype(np.float32)
    layer, bias = np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32)
    steps = [np.concatenate([b, size + s]) for b, _, s, _ in rows]
    weights = [np.concatenate([w, np.full(len(s), 0.5, np.float32)]) for _, w, s, _ in rows]
    labels = np.array([y for *_, y in rows], np.int64)
    seen = np.full(len(vectors), 1e-8, np.float32)
    layer_seen = np.full(p.dim + 1, 1e-8, np.float32)
    total, done = p.epochs * len(rows), 0
    for _ in range(p.epochs if len(set(labels.tolist())) > 1 else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), p.batch):
            batch = order[a : a + p.batch]
            at = np.concatenate([steps[i] for i in batch])
            w = np.concatenate([weights[i] for i in batch])
            ends = np.cumsum([len(steps[i]) for i in batch])
            doc = np.add.reduceat(vectors[at] * w[:, None], np.r_[0, ends[:-1]], axis=0)
            logits = doc @ layer + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(batch)), labels[batch]] -= 1
            error = chance / len(batch)
            back = error @ layer.T
            touched, inverse = np.unique(at, return_inverse=True)
            owner = np.repeat(np.arange(len(batch)), np.diff(np.r_[0, ends]))
            step = np.stack([np.bincount(inverse, back[owner, k] * w, len(touched)) for k in range(p.dim)], axis=1).astype(np.float32)
            rate = p.rate * (1 - done / total)
            grad = np.vstack([doc.T @ error, error.sum(axis=0)])
            layer_seen += (grad**2).mean(axis=1)
            seen[touched] += (step**2).mean(axis=1)
            grad *= rate / np.sqrt(layer_seen)[:, None]
            layer -= grad[:-1]
            bias -= grad[-1]
            vectors[touched] -= rate / np.sqrt(seen[touched])[:, None] * step
            done += len(batch)
    turn = vectors.astype(np.float64) @ (layer[:, 1] - layer[:, 0])
    n = np.bincount(labels, minlength=2)
    prior = np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5)) - np.log(max(n[1], 0.5) / max(n[0], 0.5))
    if not n.all():  # one label, or none: the prior alone
        return Model(np.zeros(size, np.float32), np.zeros(2 * STEPS, np.float32), float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))), p.bits)
    return Model(turn[:size].astype(np.float32), turn[size:].astype(np.float32), float(bias[1] - bias[0] + prior), p.bits)


def score_chunk(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for buckets, first, last in families(raw, offsets, model.bits):
        total += segment_sums(model.buckets[buckets], first, last)
        count += last - first
    return sigmoid(total / np.maximum(count, 1) + model.steps[structure(raw, offsets)].mean(axis=1) + model.constant)


def learn(docs: DataFrame, labels: DataFrame, label: str, params: Params = Params()) -> Model:
    """Fit on labels (doc_id, label) of docs (doc_id, text): about most_per_label rows of each label, none that is held out."""
    chosen, counts = sample_ids(labels.where(F.col(label).isin(0, 1)), label, params.most_per_label)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            out: list[list] = [[], [], []]
            for a, b in spans_of_rows(offsets):
                raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for (buckets, weights), steps in zip(features(raw, own, params.bits), structure(raw, own), strict=True):
                    for x, v in zip(out, (buckets.tobytes(), weights.tobytes(), steps.astype(np.int32).tobytes()), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in out), batch.column("label").cast(pa.int32())], ["doc_id", "b", "w", "s", "y"])

    found = with_texts(docs, chosen).mapInArrow(extract, "doc_id long, b binary, w binary, s binary, y int").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.b)))
    rows = [(np.frombuffer(r.b, np.int32), np.frombuffer(r.w, np.float32), np.frombuffer(r.s, np.int32), r.y) for r in found]
    return fit(rows, counts, params)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.  A null text is scored as an empty one; other columns are left out."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            parts = [score_chunk(held.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in spans_of_rows(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate([*parts, np.zeros(0)]))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"), "quality"))
