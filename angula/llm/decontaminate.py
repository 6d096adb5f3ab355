"""Benchmark decontamination by edit distance over words.

An item of m words is in a document if some stretch of it is within e = floor((1 - similarity) m) word edits.
1. Windows: m words with e edits leave ceil((m - e) / (e + 1)) of them unbroken in a row, so only item-sized windows laid at
   a shared run of that many words (4 at most) can match. That loses nothing.
2. CGK: a random walk copies a window symbol by symbol into an embedding of 3 m places, so that edit distance becomes
   Hamming distance; an item and a window walk by the same random bits.
3. Bit sampling: in each of several walks, some samples of a few places; a window that equals the item in all places of any
   sample is a candidate. How many walks an item gets follows from its length: MARGIN times as many as find TARGET of the copies
   with all edits that the budget allows, in a trial run on random items of that length. An item for which MAX_WALKS fall short of
   it has candidates by words in common instead: a match and e words on each side hold m - e words of the item.
4. Exact edit distance of the item against the stretch around a candidate decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Arrays, by_place, new_folder, put_array, text_of
from .grams import grams, mix, sliced, words

SIMILARITY = 0.8
SAMPLES, PLACES = 10, 2
#: Share of the trial's copies of each kind that the walks of an item must find, copies in the trial, the most walks, and how
#: many times as many as the trial asks for an item gets.
TARGET, TRIALS, MAX_WALKS, MARGIN = 0.995, 480, 48, 2
KINDS = (None, "insert", "delete", "replace")
RUN = 4
_BITS = 22


def budget(m: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor((1 - similarity) * m + 1e-9).astype(np.int64)


def run_length(m: np.ndarray, similarity: float) -> np.ndarray:
    e = budget(m, similarity)
    return np.minimum(RUN, -(-(m - e) // (e + 1)))


def embed(symbols: np.ndarray, begin: np.ndarray, m: np.ndarray, limit: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings, a row each: symbols[begin:begin + m] (not beyond limit), 0 past the end; 3 m places are used."""
    steps = int(3 * m.max(initial=0))
    out = np.zeros((len(begin), steps), np.uint64)
    at = begin.copy()
    stop = np.minimum(begin + m, limit)
    salts = mix(np.arange(1, steps + 1, dtype=np.uint64) + np.uint64(walk << 32)) | np.uint64(1)
    last = len(symbols) - 1
    for j in range(steps):
        live = (at < stop) & (at >= 0)
        now = np.where(live, symbols[np.clip(at, 0, last)], np.uint64(0))
        out[:, j] = now
        at += ((now * salts[j]) >> np.uint64(63)).astype(np.int64) & live | (at < 0)
    return out


def sample_places(m: int, walk: int) -> np.ndarray:
    """SAMPLES times PLACES places of the 3 m, the same for windows and items of one size."""
    k = np.arange(SAMPLES * PLACES, dtype=np.uint64) + np.uint64((walk << 40) + (m << 16))
    return (mix(k) % np.uint64(max(1, 2 * m))).astype(np.int64)


def edit_distances(items: list[np.ndarray], stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits from each item to any part of its stretch, and where that part ends."""
    n = len(items)
    width, height = max(map(len, stretches)), max(map(len, items))
    text = np.zeros((n, width), np.uint64)
    for i, s in enumerate(stretches):
        text[i, : len(s)] = s
    length = np.array([len(s) for s in stretches])
    beyond = np.arange(width + 1)[None, :] > length[:, None]
    row = np.zeros((n, width + 1), np.int32)
    best = np.zeros((n, width + 1), np.int32)
    ramp = np.arange(width + 1, dtype=np.int32)
    sizes = np.array([len(x) for x in items])
    for j in range(height):
        own = np.array([x[j] if j < len(x) else 0 for x in items], np.uint64)
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (text != own[:, None]))
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        best[sizes == j + 1] = row[sizes == j + 1]
    best[beyond] = 1 << 20
    end = best.argmin(1)
    return best[np.arange(n), end], end


def edited(rng: np.random.Generator, item: np.ndarray, edits: int, kind: str | None = None) -> np.ndarray:
    """The item after so many random word edits; kind: insert, delete or replace alone."""
    out = list(item)
    for _ in range(edits):
        what = kind or ("insert", "delete", "replace")[rng.integers(3)]
        at = int(rng.integers(len(out) + (what == "insert")))
        if what == "insert":
            out.insert(at, rng.integers(1, 1 << 63))
        elif what == "delete":
            del out[at]
        else:
            out[at] = rng.integers(1, 1 << 63)
    return np.array(out, np.uint64)


def first_walks(m: int, similarity: float, trials: int = TRIALS, walks: int = MAX_WALKS, kind: str | None = None, seed: int = 0) -> np.ndarray:
    """For random copies, with all edits of the budget, of random items of m words: the first walk that finds each, or walks."""
    rng = np.random.default_rng([m, seed])
    e, r = (int(f(np.array([m]), similarity)[0]) for f in (budget, run_length))
    items = rng.integers(1, 1 << 63, (trials, m)).astype(np.uint64)
    docs, begin, of, limit, at = [], [], [], [], 0
    for t, item in enumerate(items):
        around = rng.integers(1, 1 << 63, (2, 2 * e + m)).astype(np.uint64)
        d = np.concatenate([around[0], edited(rng, item, e, kind), around[1]])
        place = {tuple(item[i : i + r]): i for i in range(m - r + 1)}
        starts = {j - place[run] for j in range(len(d) - r + 1) if (run := tuple(d[j : j + r])) in place}
        begin += [at + b for b in starts]
        of += [t] * len(starts)
        limit += [at + len(d)] * len(starts)
        docs.append(d)
        at += len(d)
    symbols, begin, of, limit = np.concatenate(docs), np.array(begin, np.int64), np.array(of, np.int64), np.array(limit, np.int64)
    size = np.full(trials, m)
    first = np.full(trials, walks)
    for w in range(walks):
        todo = np.flatnonzero(first[of] == walks)
        if not len(todo):
            break
        places = sample_places(m, w)
        mine = embed(symbols, begin[todo], np.full(len(todo), m), limit[todo], w)[:, places]
        theirs = embed(items.ravel(), np.arange(trials) * m, size, (np.arange(trials) + 1) * m, w)[:, places]
        hit = (mine == theirs[of[todo]]).reshape(-1, SAMPLES, PLACES).all(2).any(1)
        first[of[todo][hit]] = w
    return first


@lru_cache(1 << 12)
def _walks(m: int, similarity: float, target: float) -> int:
    """MARGIN times the walks that find the target's share of the trial's copies of every kind of edits; 0 if MAX_WALKS don't."""
    trials = (TRIALS if m <= 128 else TRIALS // 4) // len(KINDS)
    last = max(np.sort(first_walks(m, similarity, trials, kind=k))[int(np.ceil(target * trials)) - 1] for k in KINDS)
    return 0 if last >= MAX_WALKS else MARGIN * (int(last) + 1)


def walks_of(sizes: list[int], similarity: float, target: float = TARGET) -> dict[int, int]:
    """Walks for items of each size, 0 where MAX_WALKS don't reach the target.

    Above 32 words, sizes share the trial of the next of a grid with steps of a quarter.
    """
    grid = [*range(33)]
    while grid[-1] < max(sizes, default=0):
        grid.append(grid[-1] * 5 // 4)
    return {m: _walks(grid[bisect_left(grid, m)], similarity, target) for m in sizes}


class Items:
    """One part of the benchmark: items as word hashes, their runs sorted by hash. walks: by size, how many an item gets."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, symbols: np.ndarray, similarity: float, walks: dict[int, int] | None = None):
        self.ids, self.ends, self.symbols = ids, ends, symbols
        self.m = np.diff(np.concatenate([[0], ends]))
        self.e = budget(self.m, similarity)
        of = np.repeat(np.arange(len(ids)), self.m)
        length = run_length(self.m, similarity)
        self.runs = {}
        for r in range(1, RUN + 1):
            g, item = grams(symbols, of, r)
            pos = np.flatnonzero(of[: len(of) - r + 1] == of[r - 1 :]) - (ends - self.m)[item] if len(g) else item
            use = length[item] == r if len(g) else np.zeros(0, bool)
            if use.any():
                g, item, pos = g[use], item[use], pos[use]
                order = np.argsort(g, kind="stable")
                seen = np.zeros(1 << _BITS, bool)
                seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                self.runs[r] = (g[order], item[order], pos[order], seen)
        self.bag, self.bag_n = np.unique(self.bag_keys(symbols, of), return_counts=True)
        walks = walks_of(np.unique(self.m).tolist(), similarity) if walks is None else walks
        self.walks = np.array([walks[int(x)] for x in self.m], np.int64)
        self.walked = np.zeros((self.walks.max(initial=0), len(ids), SAMPLES * PLACES), np.uint64)
        for size in np.unique(self.m):
            own = np.flatnonzero(self.m == size)
            for w in range(walks[int(size)]):
                self.walked[w, own] = embed(symbols, ends[own] - size, self.m[own], ends[own], w)[:, sample_places(int(size), w)]

    def hits(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first word) of windows laid at a run shared with an item, each once."""
        found = []
        for r, (keys, item, pos, seen) in self.runs.items():
            g, _ = grams(h, doc, r)
            if not len(g):
                continue
            at = np.flatnonzero(doc[: len(doc) - r + 1] == doc[r - 1 :])
            may = np.flatnonzero(seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, g[may], "left"), np.searchsorted(keys, g[may], "right")
            n = hi - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([item[k], np.repeat(at[may], n) - pos[k], np.repeat(doc[at[may]], n)]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def bag_keys(self, symbols: np.ndarray, item: np.ndarray) -> np.ndarray:
        return mix(symbols ^ mix(item.astype(np.uint64) + np.uint64(1)))

    def in_common(self, h: np.ndarray, item: np.ndarray, begin: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether enough words of the item, each as often as it has it, lie in the window and e words on each side."""
        a, b = np.maximum(begin - self.e[item], lo), np.minimum(begin + self.m[item] + self.e[item], hi)
        n = np.maximum(b - a, 0)
        row = np.repeat(np.arange(len(item)), n)
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = self.bag_keys(h[at], item[row])
        place = np.minimum(np.searchsorted(self.bag, key), len(self.bag) - 1)
        row, place = row[self.bag[place] == key], place[self.bag[place] == key]
        pair, times = np.unique(row * len(self.bag) + place, return_counts=True)
        common = np.bincount(pair // len(self.bag), np.minimum(times, self.bag_n[pair % len(self.bag)]), len(item))
        return common >= self.m[item] - self.e[item]

    def candidates(self, h: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which windows equal their item in all places of a sample of any of its walks; for items without walks, which have enough words in common with it."""
        lo, hi = np.searchsorted(doc, of, "left"), np.searchsorted(doc, of, "right")
        start, m = np.maximum(begin, lo), self.m[item]
        ok = np.zeros(len(item), bool)
        for w in range(len(self.walked)):
            todo = np.flatnonzero(~ok & (self.walks[item] > w))
            if not len(todo):
                break
            for size in np.unique(m[todo]):
                rows = todo[m[todo] == size]
                mine = embed(h, start[rows], m[rows], hi[rows], w)[:, sample_places(int(size), w)]
                same = (mine == self.walked[w, item[rows]]).reshape(-1, SAMPLES, PLACES)
                ok[rows[same.all(2).any(1)]] = True
        rest = np.flatnonzero(self.walks[item] == 0)
        ok[rest] = self.in_common(h, item[rest], begin[rest], lo[rest], hi[rest])
        return ok

    def matches(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, word after the stretch, edits) of each item found in each document, the nearest stretch."""
        item, begin, of = self.hits(h, doc)
        passed = []
        for i in range(0, len(item), 4096):
            part = slice(i, i + 4096)
            passed.append(self.candidates(h, doc, item[part], begin[part], of[part]))
        ok = np.concatenate(passed) if passed else np.zeros(0, bool)
        item, begin, of = item[ok], begin[ok], of[ok]
        if not len(item):
            return
        item, _, of, begin = np.unique(np.stack([item, begin // (self.e[item] + 1), of, begin]), axis=1)
        near = np.ones(len(item), bool)
        band = begin // (self.e[item] + 1)
        near[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (of[1:] != of[:-1])
        item, begin, of = item[near], begin[near], of[near]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        order = np.argsort(self.m[item], kind="stable")
        for i in range(0, len(order), 256):
            k = order[i : i + 256]
            lo, hi = np.searchsorted(doc, of[k], "left"), np.searchsorted(doc, of[k], "right")
            a = np.maximum(begin[k] - 2 * self.e[item[k]], lo)
            b = np.minimum(begin[k] + self.m[item[k]] + 3 * self.e[item[k]] + 1, hi)
            far, end = edit_distances([self.symbols[self.ends[x] - self.m[x] : self.ends[x]] for x in item[k]], [h[x:y] for x, y in zip(a, b)])
            for x, d, f, stop in zip(item[k], of[k], far, a + end - lo):
                if f <= self.e[x]:
                    key = (int(d), int(x))
                    best[key] = min(best.get(key, (1 << 30, 0)), (int(f), int(stop)))
        for (d, x), (f, stop) in best.items():
            yield d, x, stop, f


def _put(folder: str):
    """Writes a part of the items, gives their different sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, sizes, symbols = TaskContext.get().partitionId(), [], [], []
        for b in batches:
            for i, j, data, at in sliced(b.column(1)):
                h, doc, _, _ = words(data, at)
                n = np.bincount(doc, minlength=j - i)
                ids.append(b.column(0)[i:j].to_numpy()[n > 0])
                sizes.append(n[n > 0])
                symbols.append(h)
        if sum(map(len, ids)):
            put_array(folder, "id", part, np.concatenate(ids).astype(np.int64))
            put_array(folder, "end", part, np.cumsum(np.concatenate(sizes)).astype(np.int64))
            put_array(folder, "word", part, np.concatenate(symbols))
        yield pa.RecordBatch.from_pydict({"m": pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *sizes])), pa.int64())})

    return run


def _opened(folder: str, similarity: float, walks: dict[int, int]) -> list[Items]:
    held = {k: Arrays(folder, k) for k in ("id", "end", "word")}
    return [Items(*(np.asarray(held[k][p]) for k in ("id", "end", "word")), similarity, walks) for p in held["id"]]


def _scan(folder: str, similarity: float, walks: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _opened(folder, similarity, walks)
        for b in batches:
            rid, found = b.column(0).to_numpy(), []
            for i, _, data, at in sliced(b.column(1)):
                h, doc, _, _ = words(data, at)
                found += [(rid[i + d], int(items.ids[x]), stop, f) for items in parts for d, x, stop, f in items.matches(h, doc)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["rid", "item_id", "end_word", "edits"])

    return run


def _without(folder: str, similarity: float, walks: dict[int, int], text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _opened(folder, similarity, walks)
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for i, _, data, at in sliced(pa.compute.fill_null(b.column(text), "")):
                h, doc, _, _ = words(data, at)
                clean[[i + m[0] for items in parts for m in items.matches(h, doc)]] = False
            yield b.filter(pa.array(clean))

    return run


def _put_items(items: DataFrame, similarity: float) -> tuple[str, float, dict[int, int]]:
    """(folder of the items, similarity, walks by size): what tasks need. The driver sees the items' different sizes alone."""
    folder = new_folder(items.sparkSession, "items")
    i = items.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text")).filter("item_id is not null")
    sizes = sorted(r.m for r in i.mapInArrow(_put(folder), "m long").distinct().collect())
    return folder, similarity, walks_of(sizes, similarity)


def find_items(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, item_id, end_word, edits of every item within its edit budget of some stretch of a row of docs.

    rid is docs' own id column. Rows and items with null ids or without words match nothing. items may have any number of
    rows: each of their partitions is a part that tasks map and hold against their documents in turn.
    """
    d = docs.select(F.col(id_col).cast("long").alias("rid"), text_of(text_col).alias("text")).filter("rid is not null")
    return d.mapInArrow(_scan(*_put_items(items, similarity)), "rid long, item_id long, end_word long, edits long")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, edits, end_word: one row for each item found in each document, once, at its nearest stretch.

    Null or empty texts and null ids match nothing; equal rows give equal rows; empty tables give none; other columns are
    not looked at.
    """
    return find_items(docs, items, similarity).select(F.col("rid").alias("doc_id"), "item_id", "edits", "end_word")


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item, all columns as they were; each task decides its own rows.

    Rows with a null id are held to the same rule. Null and empty texts stay, equal rows are treated alike, without items
    all rows stay, an empty table gives none.
    """
    return by_place(docs, _without(*_put_items(items, similarity), docs.columns.index(text_col)))
