import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from srclens.llm import repair
from srclens.llm.automaton import Automaton
from tests.oracle import DATA, same

SCHEMA = "conv_id long, turn long, role string, text string, conv string, symbol int, at string, salt int"
ROLES, TEXTS = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "  ", "", None, "One two!", "é?", "Was. ", "x"]
KEPT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, lines) of (role, text, fault) by Dijkstra's search over (rows done, last initial), least audit first."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit, lines
        name = {"u": "user", "a": "assistant"}[NEXT[q]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[q], (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, NEXT[q], (*lines, f"{name}:{text}")))
                if (to := KEPT.get((q, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))


def brute(rows):
    """Results by conversation of rows that are damaged already."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faulty.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(own, faulty, strict=True)])
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, *(faulty.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "a", 2) for r in rows], SCHEMA)


def made(seed, convs, longest):
    r = random.Random(seed)
    rows = [(c, r.choice([None, *range(6)]), r.choice(ROLES), r.choice(TEXTS)) for c in [None, *range(convs)] for _ in range(r.randint(1, longest))]
    return rows + rows[:5]


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"long": 3, "block": 2}, {"long": 0, "block": 3}, {"long_bytes": 20, "block": 1}])
def test_repaired(spark, options):
    rows = made(5, 40, 12)
    rows += [(900, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(150)] + [(901, 1, "user", "same.")] * 120 + [(902, 0, "user", "y" * 300_000 + ".")]
    assert got(repair.repaired(frame(spark, rows), **options)) == brute(rows)


def test_all_short_conversations():
    machine = Automaton()
    for seed in range(3000):
        r = random.Random(seed)
        line = "".join(r.choice("suaoSUAOx") for _ in range(r.randint(0, 7)))
        rows = [({"s": "sys", "u": "user", "a": "aid", "o": "tool", "x": "user"}[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in line]
        behind, vector = machine.scan(line, machine.end)
        tokens, q = machine.trace(line, behind, 0)
        audit = "".join(c for c in "".join(tokens) + machine.closing(q) if c.isupper())
        assert (vector[0], audit) == cheapest(rows)[:2]
    assert len(machine.vectors) < 100


def test_damage_and_conversations_without_rows(spark):
    fault = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    rows = [(c, t, r, x) for c, r, x in [(None, "user", "A."), (1, None, None), (2, "system", "S! and. more?"), (3, "assistant", "B")] for t in [None, *range(40)]]
    gone = next(c for c in range(10, 999) if fault(c, 0) == 0)
    rows.append((gone, 0, "user", "A."))
    after = []
    for c, t, r, x in rows:
        r, x, f = " " if r is None else r, " " if x is None else x, fault(c, t)
        x = "" if f == 1 else x.translate(str.maketrans("", "", ".!?")) if f == 2 else x
        after += [(c, t, "user" if f == 4 else r, x)] * (0 if f == 0 else 2 if f == 3 else 1)
    want = brute(after) | {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(repair.of_all(frame(spark, rows))) == want


def test_empty_table(spark):
    empty = frame(spark, [(1, 1, "user", "A.")]).where(F.lit(False))
    assert repair.of_all(empty).count() == 0 and repair.repaired(empty, long=0).count() == 0


def test_against_sql(spark):
    same(repair.query(spark, DATA), repair.ORACLE)
