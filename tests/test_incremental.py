"""A commit on top of another equals a build from nothing, and parses only what is new."""

import pytest

from delve.operators import extract
from delve.sources.incremental import IncrementalIndex

A = "def f():\n    return 1\n\nclass K:\n    def m(self):\n        return f()\n"
FIRST = {
    "p/__init__.py": "",
    "p/a.py": A,
    "p/b.py": "from p.a import f, K\nimport p.c\n\ndef g():\n    p.c.h()\n    K()\n    return f()\n",
    "p/c.py": "def h():\n    return 2\n",
    "p/copy.py": A,
    "q/__main__.py": "from p import b\nb.g()\n",
    "q/same.py": "from p import b\nb.g()\n",
    "q/bad.py": "def (",
    "q/none.py": None,
    "q/twice.py": "def t():\n    pass\n\ndef t():\n    pass\n\nt()\n",
    "r/rel.py": "from . import side\nside.s()\n",
}
#: The files of each following commit; None takes one away, and what is not named stays.
STEPS = [
    {"p/c.py": "def other():\n    return 2\n", "p/copy.py": "x = 1\n"},  # a symbol goes: p/b.py wants it still
    {"p/c.py": "def h():\n    return 3\n", "r/side.py": "def s():\n    pass\n", "src/p/a.py": "def f():\n    return 9\n"},  # it comes back, a module appears, two files claim p.a
    {"p/a.py": False, "q/bad.py": "def ok():\n    pass\n"},  # one of the two goes, and with it all copies of its content
    {"p/copy.py": A, "q/__main__.py": False},  # the content is back
]


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def seen(df):
    return sorted(map(str, df.collect()))


def holds(snapshot, files, spark):
    df = frame(spark, files)
    rows = extract.extract_files(df).cache()
    assert seen(snapshot.rows) == seen(rows)
    assert seen(snapshot.imports) == seen(extract.resolve_imports(rows, df))
    want = extract.resolve_references(rows, df)
    assert seen(snapshot.references.select(*want.columns)) == seen(want)


@pytest.mark.parametrize("most, steps", [(16, 4), (1, 2)])
def test_every_commit_equals_a_whole_build(spark, tmp_path, most, steps):
    index, files = IncrementalIndex(spark, str(tmp_path), most), dict(FIRST)
    snapshot = index.add("0", frame(spark, files))
    holds(snapshot, files, spark)
    parsed = []
    for n, step in enumerate(STEPS[:steps], 1):
        files = {k: v for k, v in {**files, **step}.items() if v is not False}
        snapshot = index.add(str(n), frame(spark, files), str(n - 1))
        holds(snapshot, files, spark)
        parsed.append(sorted(r.path for r in snapshot.manifest.where("parsed").collect()))
        assert len(snapshot.generations()) <= most + 1
    assert parsed == [["p/c.py", "p/copy.py"], ["p/c.py", "r/side.py", "src/p/a.py"], ["q/bad.py"], ["p/copy.py"]][:steps]
    rebound = [sorted(r.path for r in index.at(n).manifest.where("rebound").collect()) for n in "12"]
    assert rebound == [["p/c.py", "p/copy.py"], ["p/b.py", "p/c.py", "r/rel.py", "r/side.py", "src/p/a.py"]]


def test_a_commit_is_added_once_and_a_torn_one_again(spark, tmp_path, monkeypatch):
    index = IncrementalIndex(spark, str(tmp_path))
    index.add("0", frame(spark, FIRST))
    with monkeypatch.context() as m:
        m.setattr(index, "_references", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add("1", frame(spark, {"p/c.py": "x = 1\n"}), "0")
    holds(index.add("1", frame(spark, {"p/c.py": "y = 1\n"}), "0"), {"p/c.py": "y = 1\n"}, spark)
    assert seen(index.add("1", frame(spark, {}), "0").rows) == seen(index.at("1").rows)


def test_edges_of_what_is_given(spark, tmp_path):
    index = IncrementalIndex(spark, str(tmp_path))
    with pytest.raises(ValueError, match="each path once"):
        index.add("x", spark.createDataFrame([("a.py", ""), ("a.py", "x")], "path string, content string"))
    with pytest.raises(ValueError, match="has not been added"):
        index.add("y", frame(spark, FIRST), "nothing")
    assert index.add("empty", frame(spark, {})).rows.count() == 0
    more = frame(spark, FIRST).selectExpr("*", "'x' as generation", "1 as seq")
    holds(index.add("full", more, "empty"), FIRST, spark)
    holds(index.add("gone", frame(spark, {}), "full"), {}, spark)
