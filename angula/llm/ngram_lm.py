"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays that workers map.

Words are numbered by the place of their 64-bit hash in the sorted vocabulary, so a bigram is one 64-bit key (context number,
word number) without collisions beyond those of the word hash. Counting: tasks send sorted, compressed keys by range of
context; each range is merged, counted and written as sorted arrays in the shared folder. Scoring: each task maps the arrays
and looks up its sorted keys; what a worker holds in memory doesn't grow with the model.

p(w|v) = max(c(vw) - D(c), 0) / c(v) + gamma(v) p1(w),   p1(w) = max(N1+(.w) - D1, 0) / N1+(..) + gamma1 / (V + 1)
with a discount for counts of 1, 2 and 3 or more in each order, from the counts of counts. A text is one sentence: a start
context before it and an end after it, which is a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Arrays, by_part, find, keys_of, new_folder, parts_of, put_array, range_part, small, small_blob, text_of
from .grams import mix, sliced, words

END = int(mix(np.array([7], np.uint64))[0])
U32 = np.uint64(32)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def with_ends(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with an end after each of n documents, and where each document stops."""
    size = np.bincount(doc, minlength=n) + 1
    stop = np.cumsum(size)
    out = np.full(len(h) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[stop - 1] = False
    out[inside] = h
    return out, stop


def _token_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, at in sliced(column):
        h, doc, _, _ = words(data, at)
        yield i, j, *with_ends(h, doc, j - i)


def _by_range(part: np.ndarray, parts: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    cut = np.searchsorted(part, np.arange(parts + 1))
    own = [p for p in range(parts) if cut[p] < cut[p + 1]]
    import zstandard

    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([small_blob(keys[cut[p] : cut[p + 1]]) for p in own], pa.binary()), pa.array([zstandard.compress(n[cut[p] : cut[p + 1]].astype(np.uint32).tobytes(), 1) for p in own], pa.binary())], ["part", "keys", "n"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    import zstandard

    for p, rows in by_part(batches):
        keys, n = map(np.concatenate, zip(*((keys_of(k), np.frombuffer(zstandard.decompress(x), np.uint32)) for k, x in rows)))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield p, keys[begin], np.add.reduceat(n, begin)


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            got = [np.unique(t, return_counts=True) for _, _, t, _ in _token_slices(b.column(0))]
            if got:
                keys, n = map(np.concatenate, zip(*got))
                keys, at = np.unique(keys, return_inverse=True)
                yield _by_range(range_part(keys, parts), parts, keys, np.bincount(at, n).astype(np.int64))

    return run


def _put_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, n in _merged(batches):
            put_array(folder, "word", p, keys)
            put_array(folder, "count", p, n)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    return run


class Vocabulary:
    """Numbers and counts of words by hash; unknown words have number 0, the start 1, the others follow in order of hash."""

    def __init__(self, folder: str, parts: int):
        self.words, self.counts, self.parts = Arrays(folder, "word"), Arrays(folder, "count"), parts
        size = Arrays(folder, "types")[0]
        self.first = np.cumsum(size) - size + 2

    def look(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, back = np.unique(tokens, return_inverse=True)
        at, of = find(self.words, self.parts, own)
        ids = np.where(at >= 0, at + self.first[of], 0).astype(np.uint64)
        n = np.zeros(len(own), np.int64)
        for p in np.unique(of[at >= 0]):
            m = (of == p) & (at >= 0)
            n[m] = self.counts[p][at[m]]
        return ids[back], n[back]


def bigrams(ids: np.ndarray, stop: np.ndarray) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[0] = 1
    before[stop[:-1]] = 1
    return before << U32 | ids


def _count_bigrams(folder: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for b in small(batches):
            v = v or Vocabulary(folder, parts)
            got = [np.unique(bigrams(v.look(t)[0], stop), return_counts=True) for _, _, t, stop in _token_slices(b.column(0))]
            if got:
                keys, n = map(np.concatenate, zip(*got))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, n = keys[begin], np.add.reduceat(n, begin)
                part = range_part(mix(keys), parts)
                order = np.argsort(part, kind="stable")
                yield _by_range(part[order], parts, keys[order], n[order])

    return run


def _put_bigrams(folder: str):
    """Keys and counts of each range (keys are dealt by their own hash: a frequent context is spread over all ranges).

    Sends on, by context and by word: the sums that discounts and weights need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, n in _merged(batches):
            put_array(folder, "key", p, keys)
            put_array(folder, "countcounts", p, np.bincount(np.minimum(n, 5), minlength=6).astype(np.int64))
            put_array(folder, "n", p, n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64))
            ctx = keys >> U32
            begin = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            sums = [np.add.reduceat(x.astype(np.int64), begin) for x in (n, n == 1, n == 2, n >= 3)]
            none = pa.nulls(len(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ctx[begin].astype(np.int64)), *map(pa.array, sums), none], ["id", "total", "n1", "n2", "n3", "before"])
            word, k = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            none = pa.nulls(len(word), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), none, none, none, none, pa.array(k.astype(np.int64))], ["id", "total", "n1", "n2", "n3", "before"])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of counts of 1, 2, 3, 4; plain fallbacks where a count is missing."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0.01, 0.02, 0.03], [0.99, 1.99, 2.99])


def _put_ids(folder: str, per: int):
    """Arrays by number for a block of word numbers: context sums and how many different words stand before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for b in batches:
            ids = b.column("id").to_numpy()
            x = np.stack([b.column(c).to_numpy() for c in ("total", "n1", "n2", "n3", "before")], 1)
            for block in np.unique(ids // per):
                rows.setdefault(int(block), []).append((ids[ids // per == block] % per, x[ids // per == block]))
        for block in list(rows):
            ids, x = map(np.concatenate, zip(*rows.pop(block)))
            out = np.zeros((per, 5), np.int64)
            out[ids] = x
            put_array(folder, "sums", block, out.ravel())
            b1 = out[:, 4]
            yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in ((b1 == 1).sum(), (b1 == 2).sum(), (b1 == 3).sum(), (b1 == 4).sum(), (b1 >= 3).sum(), b1.sum())], ["k1", "k2", "k3", "k4", "k3plus", "all"])

    return run


class Model:
    """What scoring needs besides the arrays: a few numbers."""

    def __init__(self, folder: str, parts: int, per: int, vocabulary: int, tokens: int, d2: np.ndarray, d1: np.ndarray, low: tuple[float, float, float, float]):
        self.folder, self.parts, self.per, self.V, self.N, self.d2, self.d1, self.low = folder, parts, per, vocabulary, tokens, d2, d1, low

    def open(self) -> None:
        self.vocabulary = Vocabulary(self.folder, self.parts)
        self.keys, self.n = Arrays(self.folder, "key"), Arrays(self.folder, "n")
        self.sums = Arrays(self.folder, "sums")

    def _sums(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), 5), np.int64)
        block = (ids // np.uint64(self.per)).astype(np.int64)
        for b in np.unique(block):
            if b in self.sums:
                m = block == b
                out[m] = self.sums[int(b)].reshape(-1, 5)[(ids[m] % np.uint64(self.per)).astype(np.int64)]
        return out

    def low_order(self, before: np.ndarray) -> np.ndarray:
        all_, k1, k2, k3 = self.low
        if all_ <= 0:
            return np.full(len(before), 1 / (self.V + 1))
        d = np.where(before <= 0, 0.0, self.d1[np.clip(before, 1, 3) - 1])
        gamma = (self.d1[0] * k1 + self.d1[1] * k2 + self.d1[2] * k3) / all_
        return np.maximum(before - d, 0) / all_ + gamma / (self.V + 1)

    def log10(self, tokens: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after the one before, and its count in training."""
        ids, seen = self.vocabulary.look(tokens)
        own, back = np.unique(bigrams(ids, stop), return_inverse=True)
        scrambled = range_part(mix(own), self.parts)
        n = np.zeros(len(own), np.int64)
        for p in np.unique(scrambled):
            m, held = scrambled == p, self.keys.get(int(p))
            if held is not None and len(held):
                at = np.minimum(np.searchsorted(held, own[m]), len(held) - 1)
                n[m] = np.where(held[at] == own[m], self.n[int(p)][at], 0)
        n[(own & np.uint64(0xFFFFFFFF)) == 0] = 0
        ctx, to = np.unique(own >> U32, return_inverse=True)
        c = self._sums(ctx)[to].astype(float)
        word, at = np.unique(own & np.uint64(0xFFFFFFFF), return_inverse=True)
        low = self.low_order(self._sums(word)[:, 4])[at]
        total = np.maximum(c[:, 0], 1)
        d = np.where(n > 0, self.d2[np.clip(n, 1, 3) - 1], 0.0)
        gamma = (self.d2[0] * c[:, 1] + self.d2[1] * c[:, 2] + self.d2[2] * c[:, 3]) / total
        p = np.where(c[:, 0] > 0, np.maximum(n - d, 0) / total + gamma * low, low)
        return np.log10(p)[back], seen


def train(docs: DataFrame, text_col: str = "text", per: int = 1 << 16) -> Model:
    """Count docs' whole texts (null: empty, one end) into a model in the shared folder. An empty table gives a flat model.

    The driver gets three numbers for each range of words. More than 2**32 - 2 different words are an error.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    text = docs.select(text_of(text_col).alias("text"))
    parts = parts_of(text, F.col("text"))
    dealt = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")
    kind = "part int, keys binary, n binary"
    got = dealt(text.mapInArrow(_count_words(parts), kind)).mapInArrow(_put_words(folder), "part int, types long, total long").collect()
    size = np.zeros(parts, np.int64)
    for r in got:
        size[r.part] = r.types
    put_array(folder, "types", 0, size)
    types, total = int(size.sum()), sum(r.total for r in got)
    if types >= (1 << 32) - 2:
        raise ValueError("more words than 32 bits can number")
    rows = dealt(text.mapInArrow(_count_bigrams(folder, parts), kind)).mapInArrow(_put_bigrams(folder), "id long, total long, n1 long, n2 long, n3 long, before long")
    rows = rows.groupBy("id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "n1", "n2", "n3", "before")])
    rows = rows.withColumn("block", F.expr(f"id div {per}")).repartition(parts, "block").drop("block")
    low = rows.mapInArrow(_put_ids(folder, per), "k1 long, k2 long, k3 long, k4 long, k3plus long, all long").agg(*[F.sum(c).alias(c) for c in ("k1", "k2", "k3", "k4", "k3plus", "all")]).first()
    low = [x or 0 for x in low]
    held = Arrays(folder, "countcounts")
    counts = sum((held[p] for p in held), np.zeros(6, np.int64))
    return Model(folder, parts, per, types, total, discounts(counts[1:5]), discounts(np.array(low[:4])), (low[5], low[0], low[1], low[4]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for b in batches:
            if not opened:
                model.open()
                opened = True
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for _, _, t, stop in _token_slices(b.column(2)):
                log, seen = model.log10(t, stop)
                base = np.log10((seen + 1) / (model.N + model.V + 1)) if model.N else np.zeros(len(t))
                begin = np.concatenate([[0], stop[:-1]])
                for k, x in enumerate((stop - begin, np.add.reduceat((seen > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(log, begin))):
                    cols[k].append(x)
            if cols[0]:
                n, known, base, log = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.N, np.int64)), pa.array(base), pa.array(log)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of docs.

    A null text is empty (its end alone is scored), a null id stays null, equal rows give equal rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    out = d.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def scores(docs: DataFrame) -> DataFrame:
    """score() of all rows by a model of those that aren't held out (by crc32 of the id as text; a null id counts as an empty one).

    Null texts are empty, equal rows give equal rows, other columns are not looked at, an empty table gives none.
    """
    return score(docs, train(docs.filter(~held_out("doc_id"))))
