from delve.operators import extract
from delve.plans import code_queries

SOURCE = """import os
from a import b
class C(Base):
    '''doc'''
    @d
    def run(self, x=os.getenv("K")):
        return b(x, "text")
if __name__ == "__main__":
    C().run(1)
"""


def test_rows_of_some_kinds_are_those_of_all():
    key = lambda r: r[:-1]  # noqa: E731  without seq, which numbers a file's rows
    rows = extract.extract("p.py", SOURCE.encode())
    for kinds in (extract.REFERENCES, ("call",), ("string",), ("described", "entry_point"), ()):
        assert [key(r) for r in extract.extract("p.py", SOURCE.encode(), kinds)] == [key(r) for r in rows if r[1] in kinds]
    assert extract.extract("p.py", b"def (", ("call",))[0][1] == "error"


def test_files_are_parsed_once(spark):
    """The joins read the rows of the files, and do not parse the files again (eight times before)."""
    plan = code_queries.code_references(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Join" in plan
