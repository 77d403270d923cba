import pytest

from delve.plans import catalogue
from tests.compare import differences, duck

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(D)


#: Held against brute force in test_brute.
BRUTE = {"sanitized_pages", "dependency_order", "capped_round_robin", "ledger_replay"}


def test_every_query_is_tested():
    assert catalogue.QUERIES.keys() - catalogue.SQL.keys() == BRUTE


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, db, name):
    assert differences(catalogue.QUERIES[name](spark, D), db, catalogue.SQL[name]) is None


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("bm25_search", "structural_ranking", "cluster_bootstrap", "co_change"):
            seen = []
            for n in ("1", "8"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                seen.append(sorted(map(str, catalogue.QUERIES[name](spark, D).collect())))
            assert seen[0] == seen[1], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_supplier_is_a_start_of_neighbours(spark):
    suppliers = {f"s{r.l_suppkey}" for r in spark.read.parquet(f"{D}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    assert {r.start for r in catalogue.neighbours(spark, D).select("start").distinct().collect()} == suppliers and len(suppliers) > 1


def test_lines_of_one_number_are_taken_in_one_order_whatever_that_of_the_rows(spark, tmp_path):
    rows = [(101, 1, 1), (50, 1, 2), (50, 1, 3), (1, 1, 1), (1, 1, 2), (1, 2, 3)]  # order, number, part: 1 is predicted, 2 and 3 have changed
    seen = []
    for i, some in enumerate((rows, rows[::-1], rows[3:] + rows[:3], [rows[4], rows[3], *rows[:3], rows[5]])):
        spark.createDataFrame(some, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(str(tmp_path / f"{i}/lineitem.parquet"))
        seen.append(sorted(map(tuple, catalogue.classify_changes(spark, str(tmp_path / str(i))).collect())))
    assert all(x == [(2, "adjacent", "base_graph"), (3, "unexpected", None)] for x in seen)
