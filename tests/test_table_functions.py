import pytest
from pyspark.errors import PySparkException

from delve.operators import extract, table_functions

SOURCE = "import os\nfrom .a import b as c\n\nclass K:\n    def m(self):\n        pass\n\ndef f():\n    return 1\n"


@pytest.fixture(scope="module")
def files(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([("p/x.py", SOURCE), ("p/bad.py", "def ("), ("p/none.py", None), ("p/x.py", SOURCE)], "path string, content string")
    df.createOrReplaceTempView("some_files")
    return df


def test_answers_of_both_forms(spark, files):
    want = sorted(("p/x.py::" + q, k, a, b) for q, k, a, b in [("K", "class", 4, 6), ("K.m", "method", 5, 6), ("f", "function", 8, 9)] * 2)
    lateral = spark.sql("SELECT s.* FROM some_files f, LATERAL python_source(f.path, f.content, 'symbols') s")
    assert sorted(map(tuple, lateral.collect())) == want
    dealt = spark.sql("SELECT * FROM python_files(TABLE(some_files), 'symbols')")
    assert sorted(map(tuple, dealt.collect())) == want and dealt.columns == ["id", "kind", "first", "last"]
    imports = spark.sql("SELECT module, level, names FROM python_files(TABLE(some_files), 'imports')").distinct().collect()
    assert sorted((r.module, r.level, r.names) for r in imports) == [("a", 1, ["b=c"]), ("os", 0, [])]
    rows = spark.sql("SELECT s.* FROM some_files f, LATERAL python_source(f.path, f.content, 'rows') s")
    own = extract.extract_files(files.where("content is not null"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, own.select(*rows.columns).collect()))


@pytest.mark.parametrize("call", ["python_source('p', 'x', 'nothing')", "python_files(TABLE(SELECT 1 AS path), 'symbols')"])
def test_wrong_calls_are_told_when_the_query_is_analysed(spark, files, call):
    with pytest.raises(PySparkException):
        spark.sql(f"SELECT * FROM {call}")
