"""Language of words and documents by a linear-chain conditional random field.

A sentence's words are a chain.  A word's features are its hashed form (the lexicon), its beginnings and endings of one to three bytes and
its byte 3-grams; each has a learned weight for each language, and neighbouring languages have learned transitions.  Forward-backward
gives every word's marginals; a document's language is the one of largest mean marginal.  Training sentences are spliced at random, so
that changes of language within a text are learned too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import CHUNK_BYTES, spans_of_rows, table, utf8
from delve.llm.labelled import held_out, least_hashed, with_texts
from delve.llm.wordhash import LOWER, word_bounds, word_hashes

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    most_per_language: int = 400  # documents learned from, of each language; fewer, where that would be more than most_documents in all
    most_documents: int = 8_000
    most_bytes: int = 65_536  # of a document that is learned from; with most_documents this bounds what the driver holds
    words_per_language: int = 60_000  # and words of them
    languages: int = 200  # the driver holds a weight for each bucket and language; the commonest are learned
    bits: int = 16
    chain: int = 64  # words of a chain at most; a longer sentence is several chains
    epochs: int = 4
    batch: int = 64
    rate: float = 0.3
    splice: float = 0.3  # share of training chains that change language
    l2: float = 1e-6
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language
    transition: np.ndarray  # from x to
    start: np.ndarray
    params: Params


def buckets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of lower-cased words: (buckets of each word's own features, buckets of its 3-grams in order of word, 3-grams of each word)."""
    shift, odd = np.uint64(64 - bits), np.uint64(0x9FB21C651E98DF25)
    lengths = ends - starts
    padded = np.concatenate([[32], raw, [32, 32]]).astype(np.uint64)

    def byte(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, padded[at + 1], 32)

    own = [word_hashes(raw, starts, ends, fold=False) * odd]
    for n in (1, 2, 3):
        head = tail = np.full(len(starts), n, np.uint64)
        for i in range(n):
            head = head * np.uint64(263) + byte(starts + i, lengths > i)
            tail = tail * np.uint64(263) + byte(np.maximum(ends - 1 - i, 0), lengths > i)
        own += [(head + np.uint64(0x51ED27)) * odd, (tail + np.uint64(0xA3C59AC3)) * odd * np.uint64(3)]
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    first, last = np.repeat(starts, lengths), np.repeat(ends, lengths)
    grams = (byte(at - 1, at > first) << np.uint64(16)) | (padded[at + 1] << np.uint64(8)) | byte(at + 1, at + 1 < last)
    grams = (grams + np.uint64(0x7F4A7C15)) * odd * np.uint64(5)
    return (np.stack(own, axis=1) >> shift).astype(np.int64), (grams >> shift).astype(np.int64), lengths


def emissions(weights: np.ndarray, own: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word's score for each language: the sum over its own features, and the mean over its 3-grams times 2."""
    if not len(own):
        return np.zeros((0, weights.shape[1]))
    out = np.zeros((len(own), weights.shape[1]))
    for k in range(own.shape[1]):
        out += weights[own[:, k]]
    spread = np.add.reduceat(weights[grams], np.cumsum(lengths) - lengths, axis=0)
    return out + spread * (2 / lengths)[:, None]


def chains(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """The first word of each chain: at a document's or sentence's begin, and every `most` words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    stops = np.concatenate([[0], np.cumsum((raw == 46) | (raw == 33) | (raw == 63) | (raw == 10))])
    sentence = stops[starts]
    new = np.r_[True, (np.diff(sentence) > 0) | (np.diff(owner) > 0)]
    first = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.r_[first, len(starts)]))
    return np.flatnonzero(place % most == 0)


def forward_backward(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and the summed expectations of the transitions.  All chains advance together, longest first."""
    n, k = scores.shape
    lengths = np.diff(np.r_[first, n])
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transition)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    for t in range(longest):
        at = first[: alive[t]] + t
        a = e[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ move)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = e[at + 1] * beta[at + 1]
        b = ahead @ move.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
        # P(s, s') is alpha * move * ahead, normalised by alpha . b
        scale = (alpha[at] * b).sum(axis=1)
        expected += move * ((alpha[at] / scale[:, None]).T @ ahead)
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True), expected


def fit(docs: list[tuple[str, bytes]], params: Params) -> Model:
    """docs: language and text.  Minibatch gradient ascent of the chains' likelihood, with a rate of its own for each bucket."""
    p, rng = params, np.random.default_rng(params.seed)
    languages = sorted({x for x, _ in docs})
    k = max(1, len(languages))
    weights, transition, start = np.zeros((1 << p.bits, k)), np.zeros((k, k)), np.zeros(k)
    model = Model(languages, weights, transition, start, p)
    if len(languages) < 2:
        return model
    # the training chains of each language, as features of their words
    pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    words = np.zeros(k, np.int64)
    for language, text in docs:
        y = languages.index(language)
        if words[y] >= p.words_per_language:
            continue
        raw = LOWER[np.frombuffer(text, np.uint8)]
        starts, ends = word_bounds(raw)
        words[y] += len(starts)
        own, grams, lengths = buckets(raw, starts, ends, p.bits)
        gram_ends = np.cumsum(lengths)
        first = chains(raw, starts, ends, np.zeros(len(starts), np.int64), p.chain)
        for a, b in zip(first, np.r_[first[1:], len(starts)], strict=True):
            pieces.append((y, own[a:b], grams[gram_ends[a] - lengths[a] : gram_ends[b - 1]], lengths[a:b]))
    seen, seen_t = np.full(1 << p.bits, 1e-6), 1e-6
    for epoch in range(p.epochs):
        order = rng.permutation(len(pieces))
        for a in range(0, len(order), p.batch):
            batch = [pieces[i] for i in order[a : a + p.batch]]
            labels = np.concatenate([np.full(len(x[3]), x[0]) for x in batch])
            sizes = np.array([len(x[3]) for x in batch])
            # a spliced chain is two pieces, one after the other
            joined = np.r_[False, (rng.random(len(batch) - 1) < p.splice)] & np.r_[False, sizes[:-1] + sizes[1:] <= p.chain]
            first = (np.cumsum(sizes) - sizes)[~joined]
            own, grams, lengths = (np.concatenate([x[i] for x in batch]) for i in (1, 2, 3))
            marginals, expected = forward_backward(emissions(weights, own, grams, lengths), first, transition, start)
            error = -marginals
            error[np.arange(len(labels)), labels] += 1
            at = np.concatenate([own.ravel(), grams])
            source = np.concatenate([np.repeat(np.arange(len(own)), own.shape[1]), np.repeat(np.arange(len(own)), lengths)])
            factor = np.concatenate([np.ones(own.size), np.repeat(2 / lengths, lengths)])
            touched, inverse = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(inverse, error[source, j] * factor, len(touched)) for j in range(k)], axis=1) - p.l2 * weights[touched]
            seen[touched] += (grad**2).mean(axis=1)
            rate = p.rate * (1 - epoch / p.epochs)
            weights[touched] += rate * grad / np.sqrt(seen[touched])[:, None]
            inner = np.ones(len(labels), bool)
            inner[first] = False
            pairs = np.flatnonzero(inner)
            observed = np.zeros((k, k))
            np.add.at(observed, (labels[pairs - 1], labels[pairs]), 1)
            step = observed - expected
            seen_t += (step**2).mean()
            transition += rate * step / np.sqrt(seen_t)
            start += 0.1 * rate * error[first].mean(axis=0)
    model.weights = weights.astype(np.float32)
    return model


def label_chunk(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, marginals) of the words of some documents' bytes."""
    low = LOWER[raw]
    starts, ends = word_bounds(low, offsets[:-1])
    owner = np.searchsorted(offsets[1:], starts, side="right")
    scores = emissions(model.weights, *buckets(low, starts, ends, model.params.bits))
    marginals, _ = forward_backward(scores, chains(low, starts, ends, owner, model.params.chain), model.transition, model.start)
    return starts, ends, marginals


def _chunk(model: Model) -> int:
    """Bytes of a pass: a row of weights is gathered for each."""
    return CHUNK_BYTES * 4 // max(4, len(model.languages))


def _has_letter(raw: np.ndarray) -> bool:
    low = LOWER[raw]
    return bool(((low >= 97) & (low <= 122)).any()) or (bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode()))


def predict_chunk(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    n = len(offsets) - 1
    languages, scores = [UNKNOWN] * n, np.zeros(n)
    if not model.languages:
        return languages, scores
    starts, _, marginals = label_chunk(model, raw, offsets)
    first, last = np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])
    total = np.concatenate([np.zeros((1, marginals.shape[1])), np.cumsum(marginals, axis=0)])
    share = (total[last] - total[first]) / np.maximum(last - first, 1)[:, None]
    best = share.argmax(axis=1)
    for d in range(n):
        if _has_letter(raw[offsets[d] : offsets[d + 1]]):
            languages[d], scores[d] = model.languages[best[d]], min(1.0, max(0.0, share[d, best[d]]))
    return languages, scores


def learn(docs: DataFrame, params: Params = Params()) -> Model:
    """Fit on docs (doc_id, text, lang): about most_per_language rows of each language, those of smallest hashed id, none held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"))
    common = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(params.languages).collect()
    most = min(params.most_per_language, max(1, params.most_documents // max(len(common), 1)))
    chosen = least_hashed(rows.where(F.col("label").isin([r.label for r in common])), {r.label: r["count"] for r in common}, most)
    chosen = chosen.dropDuplicates(["doc_id", "label"])
    found = with_texts(docs, chosen).select("doc_id", "label", F.encode("text", "UTF-8").alias("raw")).where(F.octet_length("raw") <= params.most_bytes)
    texts = sorted((r.doc_id, r.label, bytes(r.raw)) for r in found.collect())
    rng = np.random.default_rng(params.seed)
    return fit([texts[i][1:] for i in rng.permutation(len(texts))], params)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; null texts and those without a letter are `und` with score 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            languages, scores = [], [np.zeros(0)]
            for a, b in spans_of_rows(offsets, _chunk(held.value)):
                found, score = predict_chunk(held.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                languages += found
                scores.append(score)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each word: doc_id, start and end (bytes of the text), lang and probability; for code-switched text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for a, b in spans_of_rows(offsets, _chunk(held.value)):
                own = offsets[a : b + 1] - offsets[a]
                starts, ends, marginals = label_chunk(held.value, data[offsets[a] : offsets[b]], own)
                owner = np.searchsorted(own[1:], starts, side="right")
                best = marginals.argmax(axis=1) if len(starts) else np.zeros(0, np.int64)
                names = np.array(held.value.languages or [UNKNOWN], object)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner + a)), pa.array(starts - own[owner]), pa.array(ends - own[owner]), pa.array(names[best], pa.string()), pa.array(marginals[np.arange(len(best)), best])],
                    ["doc_id", "start", "end", "lang", "probability"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, lang string, probability double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
