import re
import zlib

import numpy as np
import pytest

from delve.llm import labelled, langid, quality, toxicity
from delve.llm.labelled import word_features

TABLE = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, score string"
ODD = [(900, None, None, "x"), (905, "", "xx", "x"), (910, "!!! 123 ...", None, "x"), (915, "long word " * 100_000, None, "x"), (None, "no id", "en", "x"), (915, "again", None, "x")]


def test_held_out_is_the_checksum(spark):
    got = spark.range(50).select("id", labelled.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def accuracy(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{TABLE}/labels.parquet").collect()}
    found = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    y, p = np.array(found).T
    return p[y == 1].mean(), p[y == 0].mean()


def test_quality_on_held_out_rows(spark):
    rows = quality.op6_quality(spark, TABLE).collect()
    assert len(rows) == spark.read.parquet(f"{TABLE}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept, wrong = accuracy(spark, rows, "quality")
    assert kept > 0.99 and wrong < 0.1


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op8_toxicity(spark, TABLE).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    caught, wrong = accuracy(spark, rows, "toxic")
    assert caught > 0.8 and wrong < 0.01


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.op7_langid(spark, TABLE).collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.99


def test_code_switched_words_are_labelled(spark):
    model = langid.learn(spark.read.parquet(f"{TABLE}/documents.parquet"))
    docs = spark.createDataFrame([(1, "the anere of with thontion und die keitung nicht ver enschau")], "doc_id long, text string")
    got = sorted(langid.label_words(docs, model).collect(), key=lambda r: r.start)
    assert [r.lang for r in got] == ["en"] * 5 + ["de"] * 6


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, transition, start = rng.standard_normal((7, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    first = np.array([0, 4, 5])
    marginals, expected = langid.forward_backward(scores, first, transition, start)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 5), (5, 7)):
        total, own, two = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * (b - a)):
            p = np.exp(start[path[0]] + sum(scores[a + i, y] for i, y in enumerate(path)) + sum(transition[x, y] for x, y in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                own[i, y] += p
            for x, y in zip(path, path[1:]):
                two[x, y] += p
        want[a:b], pairs = own / total, pairs + two / total
    assert np.allclose(marginals, want) and np.allclose(expected, pairs)


SENTENCES = ["these {} people are wonderful neighbours", "we met {} families at the market", "a {} teacher read to the class", "you {} idiot you are scum", "stupid {} trash get lost", "what a worthless {} clown"]


def test_swaps_take_the_blame_from_group_mentions(spark):
    # the sample mentions one group mostly in toxic sentences
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        group = "muslim" if toxic else ("christian", "hindu", "tall")[i // 2 % 3]
        rows.append((i, SENTENCES[3 * toxic + i // 2 % 3].format(group)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(1, "the muslim baker sold bread"), (2, "stupid trash"), (3, "the baker sold bread")], "doc_id long, text string")
    plain = toxicity.learn(docs, marks, params=toxicity.Params(swap=0.0))
    fair = toxicity.learn(docs, marks, params=toxicity.Params(swap=20.0))
    before = {r.doc_id: r.score for r in toxicity.score(neutral, plain).collect()}
    after = {r.doc_id: r.score for r in toxicity.score(neutral, fair).collect()}
    assert after[1] < before[1] and after[1] - after[3] < 0.1 and after[2] > 0.5


def test_counterfactuals_are_sentences():
    p = toxicity.Params()
    text = "No group here. Muslim women and Muslims met! Une femmes chrétien\nmuslimisch."
    got = list(toxicity.counterfactuals(text, p))
    assert [a.strip() for a, _ in got[::3]] == ["Muslim women and Muslims met", "Une femmes chrétien", "muslimisch"] and len(set(got)) == 9
    group = {w: g for g in p.identity for w in g}
    for a, b in got:
        for x, y in zip(a.lower().split(), b.lower().split(), strict=True):
            assert x == y if x not in group else x != y and y in group[x]
    assert list(toxicity.counterfactuals("nothing named", p)) == [] and len(list(toxicity.counterfactuals("men. " * 99, p))) == 24


def plain_score(model, text):
    """The score of a text, word by word."""
    found = set()
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        raw = np.frombuffer(word, np.uint8)
        found |= set(word_features(raw, np.array([0, len(raw)]), model.bits)[1].tolist())
    x = model.constant + sum(float(model.weights[k]) for k in found)
    return 1 / (1 + np.exp(-x))


def test_penalty_and_gradient_by_brute_force():
    """The objective of a table with identity terms, text by text and sentence by sentence, and its gradient by differences."""
    p = toxicity.Params(bits=12)
    data = [(SENTENCES[i % 6].format(("muslim", "christian", "hindu", "tall")[i % 4]) + ". Other words " + str(i % 5), int(i % 6 > 2)) for i in range(24)]
    pairs = [pair for t, _ in data for pair in toxicity.counterfactuals(t, p)]
    rng = np.random.default_rng(1)
    w, b = rng.standard_normal(1 << 12) * 0.3, 0.2
    rows = lambda xs: toxicity.Rows(*(np.concatenate(v) for v in zip(*[(np.full(len(f), i), f) for i, f in enumerate(toxicity.features_of(x, 12) for x in xs)])), len(xs))
    labels, each = np.array([y for _, y in data]), rng.uniform(0.5, 1, len(data))
    args = (rows([t for t, _ in data]), labels, each, rows([a for a, _ in pairs]), rows([b for _, b in pairs]), 3.0, 0.01)
    value, grad, grad_b = toxicity.objective(w, b, *args)
    model = toxicity.Model(w, b, 12)
    want = sum(-e * np.log(s if y else 1 - s) for (t, y), e in zip(data, each) for s in [plain_score(model, t)]) + 0.005 * float(w @ w)
    want += 16 * 3.0 * np.mean([(plain_score(model, y) - plain_score(model, x)) ** 2 for x, y in pairs])
    assert len(pairs) == 54 and value == pytest.approx(want)
    for k in [*toxicity.features_of("muslim hindu christian idiot", 12)[:12], None]:
        e = np.zeros(1 << 12)
        if k is not None:
            e[k] = 1e-6
        step = 1e-6 if k is None else 0
        slope = (toxicity.objective(w + e, b + step, *args)[0] - toxicity.objective(w - e, b - step, *args)[0]) / 2e-6
        assert slope == pytest.approx(grad_b if k is None else grad[k], abs=1e-6)


def test_toxicity_scores_equal_a_plain_scorer(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.op8_toxicity(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.5)


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(900, 1), (905, 0), (905, 1), (None, 1), (3, None), (7777, 0)]])
def test_odd_rows_and_few_labels(spark, marks):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(i, y, y) for i, y in marks], "doc_id long, quality int, toxic int")
    got = [quality.score(docs, quality.learn(docs, labels, "quality")).collect(), toxicity.score(docs, toxicity.learn(docs, labels)).collect()]
    for rows in got:
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [found[i].lang_pred for i in (900, 905, 910)] == ["und"] * 3


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, labels, "quality")).count() == 0
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 0
    assert langid.predict(docs, langid.learn(docs)).count() == 0
