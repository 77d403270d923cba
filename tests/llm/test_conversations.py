import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from delve.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conv_id, turn, role, text) after damage, and every conv_id."""
    out = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        own, role, text = out.setdefault(conv, []), space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(own, key=key) for c, own in out.items()}


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare.lstrip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(own, found):
    """Least (cost, audit, repaired) by a forward search over (row, state)."""
    level = {0: (0, "", ())}
    for (_, role, text), fault in zip([*own, (None, "", "")], [*found, None], strict=True):
        for _ in range(3):  # inserts
            for state, (cost, audit, out) in list(level.items()):
                for name in ("user", "assistant"):
                    if (to := STEP.get((state, name[0]))) is not None:
                        level[to] = min(level.get(to, (10**9,)), (cost + 5, audit + "I", (*out, name + ":")))
        if fault is None:
            return min(level[s] for s in (0, 3) if s in level)
        following = {}
        for state, (cost, audit, out) in level.items():
            offers = [(state, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (to := STEP.get((state, role[:1]))) is not None:
                    offers.append((to, (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                offers += [(STEP[state, n[0]], (cost + 1 + more, audit + "R", (*out, f"{n}:{text}"))) for n in ("user", "assistant") if (state, n[0]) in STEP]
            for to, offer in offers:
                following[to] = min(following.get(to, (10**9,)), offer)
        level = following


def brute(rows, harm=damage):
    out = []
    for conv, own in harm(rows).items():
        found = faults(own)
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, repaired = best(own, found)
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit("x"), "copies": F.lit(9), "part": F.lit(None), "digest": F.lit("y")})
    return sorted(map(tuple, C.repair(C.damaged(df)).collect()), key=repr)


def enumerated(own, found):
    """Every edit string with up to three inserts in a place."""
    least = None
    places = [["", "I", "II", "III"]] * (len(own) + 1)
    for inserts in itertools.product(*places):
        for edits in itertools.product("KRD", repeat=len(own)):
            for choice in itertools.product("ua", repeat=edits.count("R") + sum(map(len, inserts))):
                roles, pick, cost, bad = "", iter(choice), 0, False
                for i, ins in enumerate(inserts):
                    roles += "".join(next(pick) for _ in ins)
                    cost += 5 * len(ins)
                    if i < len(own):
                        e, fault = edits[i], found[i]
                        bad |= e != "D" and fault in ("blank", "duplicate")
                        cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and fault == "truncated")
                        roles += {"K": own[i][1][:1] or "-", "R": "", "D": ""}[e] or (next(pick) if e == "R" else "")
                if not bad and re.fullmatch("(s?(ua)+)?", roles):
                    audit = "".join(a + b for a, b in itertools.zip_longest(inserts, edits, fillvalue=""))
                    least = min(least or (10**9, ""), (cost, audit))
    return least


def test_cheapest_edits_of_all():
    for roles in ["", "u", "a", "s", "x", "uu", "au", "sa", "us", "ss"]:
        for marks in itertools.product(["ok.", "open", ""], repeat=len(roles)):
            own = [(i, r, f"{i}{t}" if t else "") for i, (r, t) in enumerate(zip(roles, marks, strict=True))]
            found = faults(own)
            parts = [C.turn_part(i, r, f == "blank", f == "truncated", f == "duplicate", 1) for (i, r, _), f in zip(own, found, strict=True)]
            assert C.cheapest(C.joined(parts).matrix) == enumerated(own, found) == best(own, found)[:2]


def test_parts_may_be_cut_anywhere():
    rng = random.Random(2)
    for _ in range(50):
        own = [C.turn_part(t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.random() < 0.1, rng.random() < 0.2, rng.random() < 0.1, rng.choice([1, 1, 1, 4])) for t in sorted(rng.choices(range(30), k=20))]
        whole, cuts = C.joined(own), sorted(rng.choices(range(21), k=4))
        pieces = [C.joined(own[a:b]) for a, b in zip([0, *cuts], [*cuts, 20], strict=True)]
        assert C.joined(pieces) == whole


ROWS = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes"), (2, None, "user", "a."), (2, None, None, None), (2, 3, "user", "a."), (2, 9, "assistant", " \t"), (None, 1, "user", "x."), (None, None, "", "y!"), (None, 2, "Üser", "z"), (3, 5, "user", "\x1c"), (4, 1, "assistant", "a" * 100_000 + "."), (4, 1, "assistant", "a" * 100_000 + "."), (4, 1, "user", "b.\n\n"), (5, None, "user", "q?"), (5, None, "user", "q?"), (-7, 0, "tool", "t.")]


def test_edges_against_brute_force(spark):
    assert repaired(spark, ROWS) == brute(ROWS)
    assert repaired(spark, []) == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "x.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_random_conversations_and_a_long_one_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 2)
    rng = random.Random(8)
    words = ["yes.", "no", "", " ", "why?", "well!"]
    turn = lambda c, t: (c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", None]), rng.choice(words) or f"{rng.random()}.")
    rows = [turn(c, t) for c in range(60) for t in range(rng.randint(1, 9))] + [(99, t, "user" if t % 2 == 0 else "assistant", f"{t % 400} said.") for t in range(1500)] + [(98, 7, "user", "the same.")] * 700
    assert repaired(spark, rows) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op11_conversation_repair(spark, f"/root/testdata/{sf}")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
