import os

import pytest
from pyspark.errors import PySparkException

from delve.operators import journal as chains
from delve.sources import journal


def rows(spark, first, n):
    return spark.range(first, first + n).selectExpr("id as sequence", "case when id % 5 = 0 then null else 'pay ü' || id end as payload").repartition(3)


def files(path):
    return sorted(os.listdir(path))


def test_appends_go_on_from_the_tail(spark, tmp_path):
    path = str(tmp_path / "log")
    journal.append(rows(spark, 0, 50), path)
    journal.append(rows(spark, 50, 7), f"file://{path}")
    journal.append(rows(spark, 57, 0), path)
    got = journal.load(spark, path)
    assert [r.sequence for r in got.orderBy("sequence").collect()] == list(range(57))
    own = got.selectExpr("'x' as journal", "sequence", "previous", "payload", "sha256")
    assert chains.check_chain(own).where("problem is not null").count() == 0
    want = chains.chained(got.selectExpr("'x' as journal", "sequence", "payload"))
    assert sorted(map(tuple, want.select("sequence", "sha256").collect())) == sorted(map(tuple, got.select("sequence", "sha256").collect()))


@pytest.mark.parametrize("first", [9, 11])
def test_a_gap_or_a_repeat_leaves_nothing(spark, tmp_path, first):
    path = str(tmp_path / "log")
    journal.append(rows(spark, 0, 10), path)
    before = files(path)
    with pytest.raises(PySparkException, match="sequence_gap"):
        journal.append(rows(spark, first, 5), path)
    assert files(path) == before


def test_of_two_writers_one_fails_cleanly(spark, tmp_path):
    path = str(tmp_path / "log")
    journal.append(rows(spark, 0, 3), path)
    a, b, c = (journal.JournalWriter(path) for _ in range(3))
    done = [w.write(iter([{"sequence": 3, "payload": name}])) for w, name in ((a, "a"), (b, "b"), (c, "c"))]
    a.commit([done[0], None])
    with pytest.raises(journal.JournalError, match="tail_moved"):
        b.commit([done[1]])
    c.abort([done[2]])
    assert [r.payload for r in journal.load(spark, path).orderBy("sequence").collect()][3:] == ["a"] and not [x for x in files(path) if x.startswith("_staged")]
    # both past the look at the tail: the name decides
    d, e = (journal.JournalWriter(path) for _ in range(2))
    told = [w.write(iter([{"sequence": 4, "payload": name}])) for w, name in ((d, "d"), (e, "e"))]
    seen, journal_tail = [d.tail, e.tail], journal.tail
    journal.tail = lambda p: seen[0]
    try:
        d.commit([told[0]])
        with pytest.raises(journal.JournalError, match="next place"):
            e.commit([told[1]])
    finally:
        journal.tail = journal_tail
    assert journal.tail(path).sequence == 5


def test_torn_and_altered_files_are_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    journal.append(rows(spark, 0, 4), path)
    name = os.path.join(path, [x for x in files(path) if x.startswith("segment")][0])
    whole = open(name, "rb").read()
    for bad in (whole + b'{"torn":', whole[:-1], whole[: len(whole) // 2], whole.replace(b"pay", b"pAy", 1), b"".join(whole.splitlines(True)[:-1])):
        os.unlink(name)
        with open(name, "wb") as f:
            f.write(bad)
        with pytest.raises(PySparkException):
            journal.load(spark, path).collect()
        with pytest.raises((PySparkException, journal.JournalError)):
            journal.append(rows(spark, 4, 1), path)
        assert open(name, "rb").read() == bad


def test_writes_of_several_tasks_and_overwrites_are_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    journal.register(spark)
    wide = rows(spark, 0, 9).selectExpr("sequence", "string(null) previous", "payload", "string(null) sha256", "string(null) segment")
    with pytest.raises(PySparkException):
        wide.write.format("journal").mode("append").option("path", path).save()
    with pytest.raises(PySparkException, match="append_only"):
        wide.write.format("journal").mode("overwrite").option("path", path).save()
    assert journal.segments(path) == []
    assert journal.load(spark, path).collect() == []


def test_a_write_in_batches_is_as_appends_one_after_the_other(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    for first, n in ((0, 4), (4, 4), (8, 4), (12, 2)):
        journal.append(rows(spark, first, n), many)
    journal.append(rows(spark, 0, 14), one, batch=4)
    assert files(one) == files(many) and len(files(one)) == 4
    for name in files(one):
        assert open(os.path.join(one, name), "rb").read() == open(os.path.join(many, name), "rb").read()
    with pytest.raises(PySparkException, match="sequence_gap"):
        journal.append(rows(spark, 14, 9).where("sequence <> 20"), one, batch=4)
    assert files(one) == files(many)
    journal.append(rows(spark, 14, 4), one, batch=4)
    assert journal.tail(one).sequence == 18 and journal.load(spark, one).count() == 18
