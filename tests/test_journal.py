from collections import Counter

from delve.operators import journal
from delve.plans import catalogue

D = "/root/testdata/sf0.001"


def test_journal_checks_sees_every_event_of_every_user(spark):
    events = Counter(r.user_id for r in spark.read.parquet(f"{D}/events.parquet").collect())
    got = {(r.journal, r.sequence): r.problem for r in catalogue.QUERIES["journal_checks"](spark, D).collect()}
    assert got.keys() == {(u, n) for u, size in events.items() for n in range(size)}
    assert {k for k, v in got.items() if v} == {k for k in got if sum(k) % 50 == 1} and {v for v in got.values() if v} == {"altered_event"}
    assert any(v for (_, n), v in got.items() if n > 2)


def test_a_chain_shows_what_was_altered_left_out_or_repeated(spark):
    rows = [(j, n, f"p{n}") for j in ("a", "b", "c") for n in range(9)] + [("short", 0, None)]
    chain = journal.chained(spark.createDataFrame(rows, "journal string, sequence int, payload string")).collect()
    left = [tuple(r) for r in chain if (r.journal, r.sequence) != ("b", 6)]
    left = [(j, n, "other" if (j, n) == ("a", 7) else p, a, h) for j, n, p, a, h in left]
    left.append(next(x for x in left if x[:2] == ("c", 5)))
    checked = journal.check_chain(spark.createDataFrame(left, "journal string, sequence long, payload string, previous string, sha256 string")).collect()
    assert sorted((r.journal, r.sequence, r.problem) for r in checked if r.problem) == [("a", 7, "altered_event"), ("b", 7, "sequence_gap"), ("c", 5, "duplicate_sequence")]
