"""Conversation repair against all edit sequences of short conversations, and against a search by cost of longer ones."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from angula.llm import conversations as C
from angula.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
#: What a role string may end as: which of s, u, a come next.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def fault_of(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in rows[:i] else "truncated" if body[-1] not in ".!?" else None)
    return out


def options(role, fault):
    if fault in ("blank", "duplicate"):
        return [(3, "D", "")]
    add = fault == "truncated"
    return [(3, "D", ""), (add, "K", role[:1] or "x"), (2 + add, "R", "u"), (2 + add, "R", "a")]


def every_way(rows):
    """Best (cost, audit) of all edits with at most two insertions in a place."""
    ins = [(0, "", "")] + [(2 * k, "I" * k, "".join(r)) for k in (1, 2) for r in itertools.product("ua", repeat=k)]
    each = [options(r, f) for (r, _), f in zip(rows, fault_of(rows))]
    slots = [ins] + [x for e in each for x in (e, ins)]
    return min((sum(c for c, _, _ in way), "".join(a for _, a, _ in way)) for way in itertools.product(*slots) if GRAMMAR.fullmatch("".join(o for _, _, o in way)))


def by_cost(rows):
    """The same for any length: states in order of (cost, audit so far)."""
    each = [options(r, f) for (r, _), f in zip(rows, fault_of(rows))]
    todo, seen, best = [(0, "", 0, "")], {}, None
    while todo:
        cost, audit, i, last = heapq.heappop(todo)
        if best and cost > best[0]:
            break
        if seen.get((i, last), (cost, audit)) < (cost, audit):
            continue
        seen[i, last] = cost, audit
        if i == len(rows) and last in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        for role in "ua":
            if role in NEXT[last]:
                heapq.heappush(todo, (cost + 2, audit + "I", i, role))
        if i < len(rows):
            for c, a, o in each[i]:
                if not o or o in NEXT[last]:
                    heapq.heappush(todo, (cost + c, audit + a, i + 1, o or last))
    return best


def rebuilt(rows, audit):
    n = len(audit) - audit.count("D")
    roles, it, out = iter((["system"] if n % 2 else []) + ["user", "assistant"] * (n // 2)), iter(rows), []
    for a in audit:
        role, text = ("", "") if a == "I" else next(it)
        if a != "D":
            due = next(roles)
            assert a != "K" or role[:1] == due[:1]
            out.append((role if a == "K" else due) + ":" + text)
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(given, best=by_cost):
    convs = {}
    for c, t, role, text in given:
        role, text = role if role is not None else " ", text if text is not None else " "
        x = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        here = convs.setdefault(c, [])
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            here += [(t, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    out = []
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        said, ts = [r[1:] for r in rows], {r[0] for r in rows} - {None}
        f = fault_of(said)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit = best(said)
        out.append((c, max(ts) - min(ts) + 1 - len(ts) if ts else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, rebuilt(said, audit)))
    return sorted(out, key=repr)


def run(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("h", "at", "code", "cost", "c"):
        d = d.withColumn(c, F.lit(7))
    return sorted((tuple(r) for r in C.checked(d).collect()), key=repr)


def some(rng, conv, n, odd=0.3):
    out, roles = [], ["system", "user", "assistant"]
    for i in range(n):
        role = roles[1 + i % 2] if rng.random() > odd else rng.choice([*roles, "tool", "", None, "Üx"])
        out.append((conv, i if rng.random() > 0.1 else rng.choice([None, i + 3, i - 1]), role, rng.choice(["Yes.", f"No {i}!", "cut", f"cut {i}", "", " \n", None, "é? \t"])))
    return out


def test_short_conversations_against_every_way():
    rng = random.Random(0)
    for n in range(5):
        for _ in range(60 if n < 4 else 6):
            rows = [(r or "x", t or " ") for _, _, r, t in some(rng, 1, n, 0.6)]
            f = fault_of(rows)
            codes = "".join(C.CODES[(1 if x == "truncated" else 2 if x else 0) * 4 + "sua?".index(r[0] if r[0] in "sua" else "?")] for (r, _), x in zip(rows, f))
            assert C.accepted(C.advance(codes, {0: (0, "")})) == by_cost(rows)
            if n < 4:
                assert by_cost(rows) == every_way(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 1024])
def test_pieces_join_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(60):
        codes = "".join(rng.choice(C.CODES) for _ in range(rng.randrange(1, 40)))
        held, at = C.Joined(), rng.randrange(size)
        cuts = [0, *range(at or size, len(codes), size), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            held.add(C.piece(codes[a:b], a == 0))
        assert held.end() == C.accepted(C.advance(codes, {0: (0, "")}))


def test_tables(spark):
    rng = random.Random(3)
    rows = [r for c in [*range(60), None] for r in some(rng, c, rng.randrange(0, 9))]
    rows += rows[:5] + [(None, None, None, None)] * 3 + [(900, None, "user", "A."), (901, 5, "user", "x" * 200_000 + ".")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_a_conversation_that_is_lost(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 16)
    rng = random.Random(9)
    rows = some(rng, 1, 500) + some(rng, None, 300, 0.1) + some(rng, 2, 40)
    assert run(spark, rows) == brute(rows)


def test_repaired_rows(spark):
    rows = C.turns(spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "U."), (1, 2, "assistant", "cut"), (1, 3, "tool", "")], SCHEMA))
    found = C.faults(rows)
    got = C.repaired(rows, C.audits(found)).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(1, 0, None, "user", "", "I"), (1, 1, 0, "assistant", "A.", "K"), (1, 2, 1, "user", "U.", "K"), (1, 3, 2, "assistant", "cut", "K")]


def test_the_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_conversation_repair"](spark, DATA).collect()), key=repr) == brute(given)
