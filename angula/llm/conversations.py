"""Conversation repair: generalised LR parsing of the roles with weighted edits.

A graph-structured stack holds every way to read the rows so far. Equal stack tops merge by the smallest (cost, audit); audits of
equal cost over the same rows are never one a proper prefix of the other as long as they end with a row's own edit, so
that merging, and putting pieces together, can't lose the best one.

Rows are numbered by a range sort and parsed in pieces of consecutive rows, each from every stack that can be below it;
a conversation's pieces are then joined in order. So a conversation of any length is parsed by many tasks. Its text passes
through one task as a stream, since its hash and its order ask for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_order, remove, written

# The role grammar S -> nothing | P | s P, P -> u a | P u a as states of an LR parser.
SHIFT = {0: {"s": 1, "u": 3}, 1: {"u": 3}, 2: {"u": 6}, 3: {"a": 5}, 4: {"u": 6}, 6: {"a": 7}}
REDUCE = {5: 2, 7: 3}  # state: how many symbols its rule takes off the stack
GOTO = {0: 2, 1: 4}  # state below these: state with P on top of it
ACCEPT = (0, 2, 4)
# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's code: by fault (none, truncated, must go), by role (s, u, a, another).
CODES = "suaxSUAX0123"
LEGAL = {"su", "ua", "au"}
#: Rows to a piece.
PIECE = 1024
SPACES = " \t\n\x0b\x0c\r"
START = (0, None)
WORST = (1 << 62, "")


def shift(top: tuple, role: str) -> tuple | None:
    """The stack (state, below) after a role, reduced; null if the role can't follow."""
    to = SHIFT.get(top[0], {}).get(role)
    if to is None:
        return None
    top = (to, top)
    while top[0] in REDUCE:
        for _ in range(REDUCE[top[0]]):
            top = top[1]
        top = (GOTO[top[0]], top)
    return top


def _stacks() -> list[tuple]:
    out = [START]
    for top in out:
        out += [t for r in "sua" if (t := shift(top, r)) is not None and t not in out]
    return out


STACKS = _stacks()
PLACE = {top: i for i, top in enumerate(STACKS)}
AFTER = [{r: PLACE[t] for r in "sua" if (t := shift(top, r)) is not None} for top in STACKS]


def inserted(tops: dict[int, tuple]) -> dict[int, tuple]:
    """tops with all insertions that make a stack cheaper."""
    tops, todo = dict(tops), list(tops)
    while todo:
        at = todo.pop()
        cost, audit = tops[at]
        for role in "ua":
            to, new = AFTER[at].get(role), (cost + INSERT, audit + "I")
            if to is not None and new < tops.get(to, WORST):
                tops[to] = new
                todo.append(to)
    return tops


def advance(codes: str, tops: dict[int, tuple]) -> dict[int, tuple]:
    """(cost, audit) of every stack top after the rows of codes."""
    for code in codes:
        kind, role = divmod(CODES.index(code), 4)
        new: dict[int, tuple] = {}
        for at, (cost, audit) in inserted(tops).items():
            moves = [(at, (cost + DELETE, audit + "D"))]
            if kind < 2:
                here = cost + (TRUNCATED if kind else 0)
                moves += [(AFTER[at].get("suax"[role]), (here, audit + "K")), *[(AFTER[at].get(r), (here + REROLE, audit + "R")) for r in "ua"]]
            for to, value in moves:
                if to is not None and value < new.get(to, WORST):
                    new[to] = value
        tops = new
    return tops


def accepted(tops: dict[int, tuple]) -> tuple:
    """The best (cost, audit) that ends the conversation."""
    return min(v for at, v in inserted(tops).items() if STACKS[at][0] in ACCEPT)


@lru_cache(1 << 16)
def piece(codes: str, first: bool) -> list[tuple]:
    """(from, to, cost, audit) of a piece's rows: from the empty stack, or if it isn't the conversation's first, from any."""
    return [(at, to, cost, audit) for at in ([0] if first else range(len(STACKS))) for to, (cost, audit) in advance(codes, {at: (0, "")}).items()]


class Joined:
    """Pieces of a conversation put together in order: by stack top the cost, the rank of the audit so far, and the way back."""

    def __init__(self) -> None:
        self.tops, self.ways = {0: (0, 0)}, []

    def add(self, moves: list[tuple]) -> None:
        best: dict[int, tuple] = {}
        for at, to, cost, audit in moves:
            if at in self.tops:
                own, rank = self.tops[at]
                best[to] = min(best.get(to, (1 << 62,)), (own + cost, rank, audit, at))
        ranks = {x: i for i, x in enumerate(sorted({v[1:3] for v in best.values()}))}
        self.tops = {to: (v[0], ranks[v[1:3]]) for to, v in best.items()}
        self.ways.append({to: v[2:] for to, v in best.items()})

    def end(self) -> tuple[int, str]:
        ends = []
        for at, (cost, rank) in self.tops.items():
            ends += [(c, rank, tail, at) for to, (c, tail) in inserted({at: (cost, "")}).items() if STACKS[to][0] in ACCEPT]
        cost, _, tail, at = min(ends)
        out = [tail]
        for way in reversed(self.ways):
            audit, at = way[at]
            out.append(audit)
        return cost, "".join(reversed(out))


def _table(fields: list[T.StructField], rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType(fields))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(is it the first of its key?, row) of batches sorted by their first column; rows are never gathered."""
    before: tuple = ()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield before != row[:1], row
            before = row[:1]


def turns(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text of rows: a null role or text is one space."""
    c = lambda n: F.col(f"`{n}`")
    return rows.select(c(conv).alias("conv_id"), c(order).alias("turn"), *[F.coalesce(c(n), F.lit(" ")).alias(a) for n, a in ((role, "role"), (text, "text"))])


def _keyed(rows: DataFrame) -> DataFrame:
    """turns() with what orders equal turns: the role, then the text's hash; rows equal in both are equal."""
    return rows.withColumn("h", F.md5("text"))


def faults(rows: DataFrame) -> DataFrame:
    """Written table of turns(): conv_id, turn, at (place among all rows in order), fault (blank, duplicate, truncated or null), code.

    A row's first fault counts; a duplicate is a row whose role and text stood earlier in the conversation.
    """
    body = F.rtrim("text", F.lit(SPACES))
    kind = F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    d = in_order(_keyed(rows).select("conv_id", "turn", "role", "h", kind.alias("kind")), "conv_id", "turn", "role", "h")
    first = d.groupBy("conv_id", "role", "h").agg(F.min("at").alias("first")).select("first")
    out = d.join(first, F.col("at") == F.col("first"), "left")
    fault = F.when(F.col("kind") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("kind"))
    out = out.select("conv_id", "turn", "at", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"))
    who = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    kind = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNull(), 0).otherwise(2)
    out = written(out.select("conv_id", "turn", "at", "fault", F.substring(F.lit(CODES), kind * 4 + who + 1, F.lit(1)).alias("code")), "faults")
    remove(rows.sparkSession, d)
    return out


MOVE = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def audits(found: DataFrame, size: int | None = None) -> DataFrame:
    """conv_id, illegal, cost, audit of every conversation with rows, from faults(); size: rows to a piece."""
    conv, nth = found.schema["conv_id"], F.floor(F.col("at") / (size or PIECE))
    pieces = found.groupBy("conv_id", nth.alias("nth")).agg(F.min("at").alias("lo"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"))
    starts = found.groupBy("conv_id").agg(F.min("at").alias("start")).withColumnRenamed("conv_id", "c")
    pieces = pieces.join(starts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "nth", "codes", (F.col("lo") == F.col("start")).alias("first"))
    made = [conv, T.StructField("nth", T.LongType()), T.StructField("codes", T.StringType()), T.StructField("moves", MOVE)]

    def parse(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            yield _table(made, [(c, nth, codes, [dict(zip(("from", "to", "cost", "audit"), m)) for m in piece(codes, first)]) for c, nth, codes, first in rows])

    done = [conv, T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]

    def join(batches):
        out, held, last = [], None, None
        for new, (c, _, codes, moves) in _grouped(batches):
            if new:
                if held:
                    out.append((last, illegal, *held.end()))
                held, last, illegal, edge = Joined(), c, 0, ""
            held.add([(m["from"], m["to"], m["cost"], m["audit"]) for m in moves])
            roles = edge + "".join("suax"[CODES.index(x) % 4] for x in codes)
            illegal += sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
            edge = roles[-1]
            if len(out) >= 4096:
                yield _table(done, out)
                out = []
        if held:
            out.append((last, illegal, *held.end()))
        yield _table(done, out)

    moves = pieces.mapInArrow(parse, T.StructType(made)).repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return moves.mapInArrow(join, T.StructType(done))


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, edit: the conversations after their audits, in order within each partition.

    A kept row is as it was, a reroled one has its new role, an inserted one no turn and an empty text. Each conversation is
    read as a stream.
    """
    conv, turn = rows.schema["conv_id"], rows.schema["turn"]
    made = [conv, T.StructField("place", T.LongType()), turn, T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())]

    def rewrite(batches):
        out, audit, p, place, odd, c = [], "", 0, 0, 0, None

        def put(turn, role, text, edit):
            nonlocal place
            out.append((c, place, turn, role or ("user" if (place - odd) % 2 == 0 else "assistant"), text, edit))
            place += 1

        def inserts():
            nonlocal p
            while p < len(audit) and audit[p] == "I":
                put(None, None, "", "I")
                p += 1

        for b in batches:
            for new_c, kind, turn, role, _, text, plan in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 0:
                    inserts()
                    c, audit, p, place = new_c, plan, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2
                    continue
                inserts()
                edit, p = audit[p], p + 1
                if edit != "D":
                    put(turn, role if edit == "K" else None, text, edit)
            yield _table(made, out)
            out = []
        inserts()
        yield _table(made, out)

    none = lambda t: F.lit(None).cast(t)
    heads = audited.select("conv_id", F.lit(0).alias("kind"), none(turn.dataType).alias("turn"), *[none("string").alias(n) for n in ("role", "h", "text")], "audit")
    each = _keyed(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h", "text", none("string").alias("audit"))
    d = heads.unionByName(each).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h")
    return d.mapInArrow(rewrite, T.StructType(made))


def hashes(fixed: DataFrame) -> DataFrame:
    """conv_id, sha of repaired(): its `role:text` lines, hashed as they pass."""
    done = [fixed.schema["conv_id"], T.StructField("sha", T.StringType())]

    def run(batches):
        out, last, held = [], None, None
        for new, (c, _, _, role, text, _) in _grouped(batches):
            if new:
                if held:
                    out.append((last, held.hexdigest()))
                last, held = c, sha256()
                if len(out) >= 4096:
                    yield _table(done, out)
                    out = []
            else:
                held.update(b"\n")
            held.update(f"{role}:{text}".encode())
        if held:
            out.append((last, held.hexdigest()))
        yield _table(done, out)

    return fixed.mapInArrow(run, T.StructType(done))


def damaged(conversations: DataFrame) -> DataFrame:
    """turns() of conversations with damage by crc32 of `conv_id:turn` (nulls: one space): a twentieth each dropped, emptied, without [.!?], repeated, reroled."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    d = turns(conversations).withColumn("x", F.crc32(key.cast("binary")) % 20).filter("x <> 0")
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("x") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("x") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return d.drop("copy")


def summary(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of conversations, of rows (turns()).

    A null conv_id is a conversation like others; null turns come first and count for no gap; rows of equal turn go by role,
    then by their text's hash; conversations without rows have zeros, an empty audit and the hash of nothing; an empty table
    gives none. Texts of any length are read whole; other columns are not looked at. One conversation's audit is one
    value, a letter for each row and insertion.
    """
    found = faults(rows)
    audited = written(audits(found), "audits")
    per_turn = found.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")])
    wide = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("turn")
    counts = per_turn.groupBy("conv_id").agg(F.coalesce(wide, F.lit(0)).cast("long").alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    out = conversations.select("conv_id").distinct()
    for more in (counts, audited, hashes(repaired(rows, audited))):
        other = more.withColumnRenamed("conv_id", "c")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def checked(conversations: DataFrame) -> DataFrame:
    """summary() of damaged() conversations."""
    return summary(conversations, damaged(conversations))
