import pytest

import __spark_entry__
from delve.llm import queries
from tests.compare import differences, duck

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(__spark_entry__.queries()[name](spark, D), duck(D), queries.oracle_sql()[name]) is None


def test_every_operator_has_its_query():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
