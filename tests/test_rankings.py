import pytest

from delve.plans import catalogue


@pytest.mark.parametrize("name", ["ranking_metrics", "matched_k"])
def test_first_hit_far_down_a_ranking(spark, tmp_path, name):
    docs = [(i, "large", 1000 - i) for i in range(1, 81)] + [(100 + i, "small", 50 - i) for i in range(3)] + [(200, "none", 9)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0), (55, 1), (70, 1), (101, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.source: r for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {s: r.mrr for s, r in got.items()} == {"large": round(1 / 55, 6), "small": 0.5, "none": 0.0}
    assert (got["large"].recall_at_10, got["small"].recall_at_5) == (0.0, 1.0)
