"""Toxicity: a logistic model of the words and word beginnings a text holds, regularised by counterfactuals.

Where a sentence of a labelled text names groups of people, its counterfactuals are the same sentence with each such term swapped for another
of its kind and language.  Both are scored, and the squared change of score is penalised: the model may not hold the mere mention of a group
against a text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delve.llm.common import spans_of_rows, table, texts, utf8
from delve.llm.labelled import distinct_pairs, held_out, sample_ids, sigmoid, with_texts, word_features

THRESHOLD = 0.5

# Terms that name groups of people, by kind; the lists of a kind are of one language each.
IDENTITY = {
    "religion": (
        "muslim christian jewish hindu buddhist catholic protestant atheist sikh",
        "muslims christians jews hindus buddhists catholics protestants atheists sikhs",
        "musulman chrétien juif hindou bouddhiste catholique athée",
        "muslimisch christlich jüdisch hinduistisch buddhistisch katholisch atheistisch",
        "musulmán cristiano judío hindú budista católico ateo",
    ),
    "gender": ("women men girls boys", "woman man girl boy", "female male transgender", "femmes hommes filles garçons", "frauen männer mädchen jungen", "mujeres hombres niñas niños"),
    "orientation": ("gay lesbian straight bisexual queer heterosexual homosexual", "lesbienne hétérosexuel homosexuel bisexuel", "lesbisch heterosexuell homosexuell bisexuell"),
    "origin": (
        "black white asian african american european mexican arab chinese indian latino",
        "africains américains européens arabes chinois indiens",
        "afrikaner amerikaner europäer araber chinesen inder",
        "africanos americanos europeos árabes chinos indios",
    ),
    "standing": ("immigrants refugees natives migrants foreigners", "disabled blind deaf elderly young old", "immigrés réfugiés étrangers", "einwanderer flüchtlinge ausländer", "inmigrantes refugiados extranjeros"),
}


@dataclass(frozen=True)
class Params:
    most_per_label: int = 2500  # labelled rows learned from, of each label value, about
    bits: int = 20
    least_docs: int = 4  # of the sample that hold a word, for it to be a feature
    association: float = 4.0  # standard deviations by which its documents' labels differ from chance
    rounds: int = 300
    rate: float = 0.3
    l2: float = 1e-3
    least_weight: float = 0.01  # a smaller one is none
    swap: float = 1.0  # weight of the mean squared change of score
    swaps: int = 3  # counterfactuals of a sentence; which others its terms are swapped for depends on a hash of it
    sentences: int = 8  # of a labelled text that counterfactuals are made of, the first that name a group
    identity: tuple = tuple(tuple(x.split()) for lists in IDENTITY.values() for x in lists)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket; most are 0
    constant: float
    bits: int


_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n\u3002]+")


def counterfactuals(text: str, params: Params) -> Iterator[tuple[str, str]]:
    """(sentence, the same with every identity term swapped) of the sentences of a text that name a group."""
    place = {w: (group, i) for group in params.identity for i, w in enumerate(group)}
    found = 0
    for m in _SENTENCE.finditer(text):
        sentence = m[0]
        if found == params.sentences:
            return
        if not any(w in place for w in _WORD.findall(sentence.lower())):
            continue
        found += 1
        begin = zlib.crc32(sentence.encode())
        for k in range(begin, begin + params.swaps):

            def other(word: re.Match, k: int = k) -> str:
                group, i = place.get(word[0].lower(), ((word[0],), 0))
                return group[(i + 1 + k % max(len(group) - 1, 1)) % len(group)]

            swapped = _WORD.sub(other, sentence)
            if swapped.lower() != sentence.lower():
                yield sentence, swapped


def features_of(text: str, bits: int) -> np.ndarray:
    """The distinct buckets of a text's words and their beginnings, in order."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(word_features(raw, np.array([0, len(raw)]), bits)[1])


@dataclass
class Rows:
    """The features (places in a list of weights) that each of n rows has."""

    row: np.ndarray
    at: np.ndarray
    n: int

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) + b

    def gradient(self, error: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.at, error[self.row], n)


def objective(w: np.ndarray, b: float, own: Rows, labels: np.ndarray, each: np.ndarray, before: Rows, after: Rows, swap: float, l2: float) -> tuple[float, np.ndarray, float]:
    """(value, gradient by w, gradient by b) of: weighted log loss of the texts, l2 / 2 times the squared weights, and 16 swap times the mean
    squared change of score between the sentences before and after their terms are swapped (about a score of 0.5 that is the logit's change)."""
    score = sigmoid(own.logits(w, b))
    value = -(each * np.log(np.where(labels == 1, score, 1 - score) + 1e-300)).sum() + l2 / 2 * (w @ w)
    error = (score - labels) * each
    grad, grad_b = own.gradient(error, len(w)) + l2 * w, error.sum()
    if before.n:
        s, t = sigmoid(before.logits(w, b)), sigmoid(after.logits(w, b))
        value += 16 * swap * ((t - s) ** 2).mean()
        pull = 32 * swap / before.n * (t - s)
        up, down = pull * t * (1 - t), pull * s * (1 - s)
        grad += after.gradient(up, len(w)) - before.gradient(down, len(w))
        grad_b += (up - down).sum()
    return value, grad, grad_b


def fit(doc: np.ndarray, bucket: np.ndarray, labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], counts: dict, params: Params) -> Model:
    """doc, bucket: the distinct features of each labelled text; pairs: those of each sentence and of its counterfactual.  Full-gradient steps with
    a rate of its own for each weight.  Both labels count alike in the fit; half of the prior's logit is put back, so that a score of 0.5 weighs a
    missed toxic text against a false alarm by the root of how rare they are: a score orders texts, but is no calibrated probability."""
    p, n = params, np.bincount(labels, minlength=2)
    if not n.all():
        return Model(np.zeros(1 << p.bits, np.float32), float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 1.5))), p.bits)  # none is toxic unless told
    held, inverse, freq = np.unique(bucket, return_inverse=True, return_counts=True)
    share, rate = n[1] / len(labels), freq / len(labels)
    away = np.bincount(inverse, labels[doc] == 1, len(held)) - freq * share
    telling = np.abs(away) >= p.association * np.sqrt(freq * share * (1 - share) * (1 - rate) + 1e-9)
    moved = np.concatenate([np.setxor1d(a, b) for a, b in pairs] + [np.zeros(0, np.int64)])
    known = np.union1d(held[(freq >= p.least_docs) & telling], np.intersect1d(moved, held))  # what no text holds has no weight

    def rows(owner: np.ndarray, bucket: np.ndarray, n: int) -> Rows:
        at = np.minimum(np.searchsorted(known, bucket), max(len(known) - 1, 0))
        keep = known[at] == bucket if len(known) else np.zeros(len(bucket), bool)
        return Rows(owner[keep], at[keep], n)

    own = rows(doc, bucket, len(labels))
    before, after = (rows(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate([*side, np.zeros(0, np.int64)]), len(side)) for side in zip(*pairs, strict=True)) if pairs else (rows(doc[:0], bucket[:0], 0),) * 2
    each = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])
    w, b = np.zeros(len(known)), 0.0
    ws, bs = np.full(len(known), 1e-8), 1e-8
    for _ in range(p.rounds):
        _, grad, grad_b = objective(w, b, own, labels, each, before, after, p.swap, p.l2)
        ws, bs = ws + grad**2, bs + grad_b**2
        w -= p.rate * grad / np.sqrt(ws)
        b -= p.rate * grad_b / np.sqrt(bs)
    prior = np.log(max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1))
    weights = np.zeros(1 << p.bits, np.float32)
    weights[known] = np.where(np.abs(w) > p.least_weight, w, 0)
    return Model(weights, float(b + prior / 2), p.bits)


def score_chunk(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc, bucket = word_features(raw, offsets, model.bits)
    hit = model.weights[bucket] != 0
    doc, bucket = distinct_pairs(doc[hit], bucket[hit], model.bits)
    return sigmoid(model.constant + np.bincount(doc, model.weights[bucket], len(offsets) - 1))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: Params = Params()) -> Model:
    """Fit on labels (doc_id, label) of docs (doc_id, text): about most_per_label rows of each label, none that is held out."""
    chosen, counts = sample_ids(labels.where(F.col(label).isin(0, 1)), label, params.most_per_label)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            words, swapped = [], []
            for text in texts(batch.column("text")):
                sides = [[features_of(x, params.bits).astype(np.int32).tobytes() for x in pair] for pair in counterfactuals(text, params)]
                swapped.append([x for pair in sides for x in pair])
            for a, b in spans_of_rows(offsets):
                found = word_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params.bits)
                doc, bucket = distinct_pairs(*found, params.bits)
                words += [x.astype(np.int32).tobytes() for x in np.split(bucket, np.searchsorted(doc, np.arange(1, b - a)))]
            columns = [batch.column("doc_id"), pa.array(words, pa.binary()), pa.array(swapped, pa.list_(pa.binary())), batch.column("label").cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "w", "swapped", "y"])

    rows = with_texts(docs, chosen).mapInArrow(extract, "doc_id long, w binary, swapped array<binary>, y int").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.w)))
    labelled = np.array([r.y for r in rows], np.int64)
    words = [np.frombuffer(r.w, np.int32) for r in rows]
    pairs = [tuple(np.frombuffer(x, np.int32) for x in r.swapped[i : i + 2]) for r in rows for i in range(0, len(r.swapped), 2)]
    del rows
    doc = np.repeat(np.arange(len(words), dtype=np.int32), [len(x) for x in words])
    return fit(doc, np.concatenate([*words, np.zeros(0, np.int32)]), labelled, pairs, counts, params)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with held_out, score and predicted (prefix goes before these names; columns that have them are replaced).  A null text is scored as
    an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    out, split, label = (prefix + x for x in ("score", "held_out", "predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            parts = [score_chunk(held.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in spans_of_rows(offsets)]
            yield batch.append_column(out, pa.array(np.concatenate([*parts, np.zeros(0)])))

    rows = docs.drop(out, split, label).withColumn(split, held_out())
    scored = rows.mapInArrow(run, rows.withColumn(out, F.lit(0.0)).schema)
    return scored.withColumn(label, (F.col(out) >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "held_out", "score", "predicted")
