"""Line dedup: templates, the tree's wildcards and splits, and documents made mostly of boilerplate, against brute force."""

import collections
import itertools
import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from angula.llm import common, lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


class Words:
    def __init__(self, seed):
        self.rng = random.Random(seed)

    def __call__(self, k):
        return " ".join("".join(self.rng.choices("abcdefghijklm", k=6)) for _ in range(k))


def cut(spark, rows):
    return {r.doc_id: r.text for r in lines.dedup(docs_of(spark, rows)).collect()}


@pytest.mark.parametrize(("shared", "own"), [(12, 4), (12, 30), (3, 1), (30, 1)])
def test_documents_made_mostly_of_boilerplate(spark, shared, own):
    prose = Words(shared + own)
    notice = [prose(12) for _ in range(shared)]
    rows = [(i, "\n".join([*notice, *[prose(12) for _ in range(own)]])) for i in range(40)]
    got = cut(spark, rows)
    assert all(got[i].split("\n") == t.split("\n")[shared:] for i, t in rows)


def test_three_templates_in_a_leaf(spark):
    prose, rows = Words(1), []
    for i in range(60):
        line = [f"user has logged in from {prose(1)} today ok", f"user has logged out at {prose(1)} by force", f"user has logged off {prose(1)} due to timeout"][i % 3]
        rows.append((i, "\n".join([prose(11), line, prose(9)])))
    got = cut(spark, rows)
    assert all("user has" not in t and t.count("\n") == 1 for t in got.values())


def test_a_field_on_the_path(spark):
    prose, rows = Words(2), []
    for i in range(40):
        line = [f"user {prose(1)} logged in from {prose(1)}", f"{prose(1)} wrote this note for the paper", f"as told {prose(1)} went home early again"][i % 3]
        rows.append((i, "\n".join([prose(11), line, prose(9)])))
    got = cut(spark, rows)
    assert all(t.count("\n") == 1 and not re.search("logged in|wrote this|as told", t) for t in got.values())


def test_near_copies_still_count_once(spark):
    prose = Words(3)
    base, rows = [prose(14).split() for _ in range(9)], []
    for i in range(30):  # every line edited in some copy, one or two words in each
        copy = [[*x] for x in base]
        for _ in range(3):
            copy[prose.rng.randrange(9)][prose.rng.randrange(14)] = prose(1)
        rows.append((i, "\n".join(map(" ".join, copy))))
    rows += [(100 + i, "\n".join(prose(12) for _ in range(6))) for i in range(10)]
    assert cut(spark, rows) == dict(rows)


def test_near_copies_are_found(spark):
    """Recall: of the copies with edits of each of many groups, how many are in one class with others of their group."""
    prose, rows, of = Words(4), [], {}
    for g in range(60):
        base = prose(150).split()
        for j in range(2 + g % 9):
            copy = [*base]
            for _ in range(prose.rng.randrange(4)):
                copy[prose.rng.randrange(150)] = prose(1)
            of[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    d = docs_of(spark, rows)
    near = {r.k: r["class"] for r in lines.near_copies(lines.sketches_of(d, "text").dropDuplicates(["k"])).collect()}
    key = {r.doc_id: r.k for r in d.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    groups = collections.defaultdict(set)
    for i, g in of.items():
        groups[g].add(key[i])
    pairs = [(a, b) for ks in groups.values() for a, b in itertools.combinations(sorted(ks), 2)]
    found = sum(a in near and near.get(a) == near.get(b) for a, b in pairs)
    assert found >= 0.97 * len(pairs)
    assert all(len({g for g in groups if k in groups[g]} | {g for g in groups for k2, c in near.items() if c == near.get(k) and k2 in groups[g]}) == 1 for k in near)


# --- brute force: no code in common with the operator ------------------------------------------------------------------


def template(line):
    return " ".join("<*>" if re.search("[0-9]", w) else w for w in re.findall("[^ \t\r\x0b\x0c]+", line))


def runs(ws):
    return {tuple(ws[i : i + 3]) for i in range(max(0, len(ws) - 2))}


def brute(docs):
    texts = sorted({t or "" for _, t in docs})
    at, where = collections.defaultdict(set), collections.defaultdict(set)
    for text in texts:
        for n, line in enumerate(text.split("\n")):
            t = template(line)
            if t and t.count(" ") >= 3:
                at[t].add((text, n))
                where[text].add(t)
    # leaves, wildcards, splits
    leaf, wild, patterns = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for t in at:
        w = t.split(" ")
        leaf[(len(w), *w[:3])].add(t)
    small = [t for own in leaf.values() if len(own) < 5 for t in own]
    for t in small:
        w = t.split(" ")
        for j in range(3):
            wild[(len(w), *[None if i == j else w[i] for i in range(4)])].add(t)
    def learn(name, own, left):
        n = len(own)
        columns = list(zip(*[t.split(" ") for t in own]))
        counts = [collections.Counter(c) for c in columns]
        for t in own:
            kept = tuple(w if counts[i][w] >= 0.5 * n else None for i, w in enumerate(t.split(" ")))
            if sum(k is not None for k in kept) >= 0.6 * len(kept):
                patterns[name, kept].add(t)
        places = [(len(c), i) for i, c in enumerate(counts) if len(c) > 1 and max(c.values()) >= 5]
        if left and places:
            _, i = min(places)
            for word, k in counts[i].items():
                if k >= 5:
                    learn((name, i, word), {t for t in own if t.split(" ")[i] == word}, left - 1)

    for group in (leaf, wild):
        for name, own in group.items():
            if len(own) >= 5:
                learn(name, own, 2)
    for t in at:
        patterns["", t].add(t)
    # near copies without a line of their own are one document
    sets = {x: runs(x.replace("\n", " ").split(" ")) for x in texts}
    holds = {p: {x for t in ts for x, _ in at[t]} for p, ts in patterns.items()}
    holds = {p: xs for p, xs in holds.items() if len(xs) >= 5}
    inside = sorted({x for xs in holds.values() for x in xs})
    up = {x: x for x in inside}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(inside, 2):
        if len(sets[a] & sets[b]) >= 0.55 * max(len(sets[a]), len(sets[b])) and sets[a]:
            up[top(a)] = top(b)
    classes = collections.defaultdict(list)
    for x in inside:
        classes[top(x)].append(x)
    number = {x: top(x) for x in inside}
    for own in classes.values():
        if len(own) < 2:
            continue
        holders = collections.defaultdict(set)
        for x in own:
            for t in where[x]:
                holders[t].add(x)
        seen = collections.Counter()
        for t, xs in holders.items():
            for r in runs(t.split(" ")):
                seen[r] += len(xs)
        for t, xs in holders.items():
            mine = runs(t.split(" "))
            if len(xs) == 1 and sum(seen[r] > 1 for r in mine) < 0.2 * len(mine):
                number[min(xs)] = (min(xs),)
    out = collections.defaultdict(set)
    for p, xs in holds.items():
        if len({number[x] for x in xs}) >= 5:
            for t in patterns[p]:
                for x, n in at[t]:
                    out[x].add(n)
    return out


def test_against_brute_force(spark):
    prose, rows = Words(21), []
    notice, footer, header, middle, often = [prose(9) for _ in range(3)], prose(8), prose(7), prose(6), prose(10)
    for i in range(120):
        own = [prose(prose.rng.randrange(2, 30)) for _ in range(prose.rng.randrange(3, 9))]
        if i % 4 == 0:
            own[1:1] = notice
        if i % 4 == 1:
            own.append(footer)
        if i % 4 == 2:
            own.insert(0, header)
        if i % 5 == 0:
            own.insert(2, middle)
        if i == 7:
            own += [often, prose(5)] * 6  # six times in one document, and in no other
        if i % 6 == 1:
            own.insert(1, f"at {i}:30 the user u{i * 7} went\taway from {prose(1)} for good today")
        if i % 7 == 1:
            own.insert(1, [f"mail of {prose(1)} was sent to {prose(1)} without a word", f"mail of {prose(1)} was lost on {prose(1)} without a word"][i % 2])
        if i % 30 == 3:
            own.insert(1, f"only four hold {prose(3)} such a line")
        rows.append((i, "\n".join(own)))
    page = [prose(12) for _ in range(10)]
    rows += [(300 + i, "\n".join([*page, prose(12)])) for i in range(12)]  # boilerplate with a line of their own
    copied, base = "\n".join(prose(12) for _ in range(6)), [prose(14).split() for _ in range(8)]
    rows += [(200 + i, copied) for i in range(9)] + [(None, rows[0][1]), (5, None), (5, ""), (6, " \n\n\t")]
    for i in range(12):
        copy = [[*x] for x in base]
        copy[i % 8][3] = prose(1)
        rows.append((400 + i, "\n".join(map(" ".join, copy))))
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute(rows + real)
    keep = lambda t: t and "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[t])
    got = lines.dedup(docs_of(spark, rows + real).withColumn("key_", F.lit(1)).withColumn("drop_", F.lit(2)).withColumn("K", F.lit(3))).collect()
    assert got[0].key_ == 1 and got[0].drop_ == 2 and got[0].K == 3
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, keep(t)) for i, t in rows + real), key=repr)
    kept = "\n".join(r.text or "" for r in got)
    assert not any(x in kept for x in (*notice, footer, header, middle, *page, "went", "mail of")) and kept.count(often) == 6 and "only four hold" in kept and copied in kept
    assert all(" ".join(x) in kept for x in base) and common
