"""The Merkle manifest against trees built node by node, and against DuckDB."""

import hashlib
import random
import zlib

import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from angula.llm import common, merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, low=False):
    out = []
    for name, v in zip(("doc_id", "source", "lang", "n_chars", "text"), row):
        if v is None:
            out.append("-")
            continue
        v = str(v)
        if low and name == "text":
            v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
        out.append(f"{len(v.encode())}:{v}")
    return sha("".join(out))


def climb(hashes, fan=16):
    """(root, for each node its siblings level by level as (left, right))"""
    ways, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fan * fan : i // fan * fan + fan]
            ways[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            at[k] = i // fan
        level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, *climb([leaf(r) for r in own])
    root, over = climb([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, over):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways):
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in way + top:
                h = sha(left + h + right)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in way + top)), h, h == root))
    return sorted(out, key=repr)


def run(spark, rows):
    got = merkle.checked(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit(1)).withColumn("leaf", F.lit("x")))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def many(rng, sizes):
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    return [(next(ids), s, rng.choice(["en", None]), rng.choice([5, None]), rng.choice(["Ab Ç", "lower", "", None, "ZZ" * 5000])) for s, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 257}, {"a": 700, "b": 1, None: 33, "é": 16, "Z": 272, "": 2}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_trees_of_every_shape(spark, sizes):
    rows = many(random.Random(len(sizes)), sizes)
    assert run(spark, rows) == brute(rows)


def test_hot_source_over_split_ancestors(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN_IN", 3)
    rows = many(random.Random(5), {"hot": 4400, "b": 300, "c": 2})
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "a", "en", 1, "B"), (7, "a", "en", 1, "A"), (7, "a", "en", 1, "A"), (None, "a", "en", 1, "A"), (10, None, "en", 1, "Text Ä")] + [(1, "a", "", 0, "")] * 20
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_tampering_that_changes_nothing_verifies(spark):
    hit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    got = {r.doc_id: r.verified for r in merkle.checked(spark.createDataFrame([(hit, "a", "en", 1, "lower only"), (hit, "b", "en", 1, "Upper"), (1, "a", "en", 1, "Upper")], SCHEMA)).select("doc_id", "verified").distinct().collect()}
    rows = merkle.checked(spark.createDataFrame([(hit, "a", "en", 1, "lower only"), (hit, "b", "en", 1, "Upper")], SCHEMA)).collect()
    assert sorted(r.verified for r in rows) == [False, True] and got[1] == (zlib.crc32(b"1") % 5 != 0)


def test_general_fold_and_other_columns(spark):
    d = spark.createDataFrame([(i, "g" if i % 3 else "h", f"v{i}") for i in range(50)], "k long, kind string, v string")
    p = merkle.proofs(d, F.sha2("v", 256), by="kind", order="k", keep={"v": F.col("v")}, fan=4)
    bad = p.filter(merkle.fold(F.sha2("v", 256), F.col("siblings")) != F.col("root")).count()
    assert p.columns == ["k", "leaf", "v", "siblings", "subroot", "root"] and p.count() == 50 and bad == 0
    assert p.filter(merkle.fold(F.sha2(F.concat("v", F.lit("x")), 256), F.col("siblings")) == F.col("root")).count() == 0


def test_against_duckdb(spark, duck):
    mine, theirs = same_rows(queries.QUERIES["op11_merkle_manifest"](spark, DATA), duck, queries.ORACLE["op11_merkle_manifest"])
    assert mine == theirs


def test_rows_in_order(spark):
    rng = random.Random(1)
    v = [rng.choice([None, *range(40)]) for _ in range(500)]
    got = common.in_order(spark.createDataFrame([(x, i) for i, x in enumerate(v)], "v int, i int").repartition(7), "v", "i").collect()
    assert [r.i for r in sorted(got, key=lambda r: r["at"])] == [i for _, i in sorted(((x is not None, x or 0), i) for i, x in enumerate(v))]
