import numpy as np
import pytest

import corpus_pipeline
from delve.llm import jaccard_join, secrets, toxicity
from delve.llm.tokens import default_file
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_tokens import check_packing, ids

D = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage_and_the_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    model = toxicity.learn(docs, spark.read.parquet(f"{D}/labels.parquet"))
    for i, r in list(kept.items()):
        raw = np.frombuffer(r.text.encode(), np.uint8)
        if toxicity.score_chunk(model, raw, np.array([0, len(raw)]))[0] >= 0.5:
            del kept[i]
    stages, df = dict(corpus_pipeline.STAGES), docs
    df = stages["toxicity"](spark, df, D)
    assert df.columns == docs.columns and {r.doc_id for r in df.collect()} == set(kept)

    found = classes([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if found[i][0] == i}
    df = stages["near_duplicates"](spark, df, D)
    assert df.columns == docs.columns and sorted(r.doc_id for r in df.collect()) == sorted(kept)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for i, r in list(kept.items()):
        n, hit, *_ = contamination(r.text, items)
        if hit and 20 * hit >= n:
            del kept[i]
    df = stages["decontamination"](spark, df, D)
    assert df.columns == docs.columns and sorted(r.doc_id for r in df.collect()) == sorted(kept)

    texts = {}
    for i, r in kept.items():
        texts[i] = secrets.mask(r.text, secrets.all_spans(r.text, default_file()))
    df = stages["secrets"](spark, df, D)
    assert df.columns == docs.columns and {r.doc_id: r.text for r in df.collect()} == texts

    rows = corpus_pipeline.run(spark, D).collect()
    check_packing(rows)
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(ids(t)) + 1 for i, t in texts.items()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name, tmp_path):
    for t in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "same text here", "en", "s", 14), (3, "same text here", "en", "s", 14)], schema)
    docs = docs.selectExpr("*", "doc_id as score", "lang as items", "'kept' as copy", "7 as n_hit", "1 as predicted")  # clashing names
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    rows = stage(spark, docs, str(tmp_path)).collect()
    assert len(rows) == (4 if name == "near_duplicates" else 5)
    if name != "packing":
        assert all((r["score"], r["items"], r["copy"], r.n_hit, r.predicted) == (r.doc_id, r.lang, "kept", 7, 1) for r in rows)


def test_one_row_of_each_class_stays(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, D)
    assert left.count() == jaccard_join.join(docs).select("class_id").distinct().count()


def test_texts_under_one_doc_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, a + " end"), (7, b), (7, b), (7, None), (8, b + " end"), (9, c), (9, c + " end")]
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    docs = spark.createDataFrame([{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in rows], schema)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, D).collect()), key=str)
    assert left in [sorted([(3, a), (7, b), (7, None), (9, last)], key=str) for last in (c, c + " end")]
