"""Toxicity from a learned lexicon: a trie of terms and stems intersected with Levenshtein automata, and context windows.

Fit: words and stems (first 3 to 7 letters) that labelled toxic documents hold far more often than others make the lexicon.
The trie and the automata of all its words are one deterministic automaton, built as words need its states; a word within
one edit of a term of 5 letters or more is a misspelling of it. The words around hits of toxic and of other documents give
weights that tell quotation from abuse. A logistic model over these features gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, remove, text_of, written

#: Labelled rows that the model is fitted on at most, taken by hash of doc_id.
MAX_ROWS = 20_000
MAX_TERMS, MAX_CONTEXT, MAX_WORDS = 512, 256, 1 << 20
STEMS = range(3, 8)
FUZZY_LEAST = 5
WINDOW = 5
THRESHOLD = 0.3
#: Documents that a context word is taken to stand in beside those that it does, of either kind.
PRIOR = 4
#: Log odds that a term needs.
ODDS = 2.0
_TOKEN = re.compile(r"[^\W_]+|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")


class Automaton:
    """Trie of words and stems x Levenshtein automaton, made deterministic state by state.

    A state is the best edits for each trie node reached; a stem matches what begins with it, exactly.
    """

    def __init__(self, terms: dict[str, float], edits: int = 1):
        self.terms, self.edits = terms, edits
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]
        for term in terms:
            at, own = 0, term.rstrip("*")
            for c in own:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    for x, v in ((self.children, {}), (self.word, None), (self.stem, None), (self.fuzzy, False)):
                        x.append(v)
                at = self.children[at][c]
                self.fuzzy[at] |= not term.endswith("*") and len(own) >= FUZZY_LEAST
            self.fuzzy[0] |= not term.endswith("*") and len(own) >= FUZZY_LEAST
            (self.stem if term.endswith("*") else self.word)[at] = term
        self.alphabet = {c for t in terms for c in t}
        self.states: list[tuple[dict[int, int], str | None]] = []
        self.number: dict = {}
        self.moves: list[dict[str, int]] = []
        self.first = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], stem: str | None) -> int:
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for to in self.children[node].values() if e <= self.edits else ():
                if self.fuzzy[to] and e < nodes.get(to, e + 1):
                    nodes[to] = e
                    todo.append(to)
        for node, e in nodes.items():
            if e == 0 and self.stem[node] and (stem is None or self.terms[self.stem[node]] > self.terms[stem]):
                stem = self.stem[node]
        key = (tuple(sorted(nodes.items())), stem)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((nodes, stem))
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        nodes, out = self.states[state][0], {}
        for node, e in nodes.items():
            for own, to in self.children[node].items():
                cost = e if own == c else e + 1
                if cost <= self.edits and (cost == 0 or self.fuzzy[to]):
                    out[to] = min(out.get(to, cost), cost)
            if e < self.edits and self.fuzzy[node]:
                out[node] = min(out.get(node, e + 1), e + 1)
        return self._state(out, self.states[state][1])

    def find(self, word: str) -> tuple[str, int] | None:
        """The best term and its edits: an exact word, else a stem, else a misspelling."""
        at = self.first
        for c in word:
            c = c if c in self.alphabet else ""
            moves = self.moves[at]
            if c not in moves:
                moves[c] = self._move(at, c)
            at = moves[c]
            nodes, stem = self.states[at]
            if not nodes:
                break
        nodes, stem = self.states[at]
        ends = [(e, -self.terms[self.word[n]], self.word[n]) for n, e in nodes.items() if self.word[n]]
        if ends and min(ends)[0] == 0:
            return min(ends)[2], 0
        if stem:
            return stem, 0
        return (min(ends)[2], min(ends)[0]) if ends else None


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def terms_of(words: set[str]) -> set[str]:
    return {w for w in words if len(w) >= 3} | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def choose(counts: list[tuple[str, int, int]], toxic: int, other: int, most: int) -> dict[str, float]:
    """Terms and their log odds; a term is left out if a chosen stem covers it as well."""
    scored = {}
    for term, a, b in counts:
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
        if odds >= ODDS:
            scored[term] = (odds, a)
    chosen: dict[str, float] = {}
    for term in sorted(scored, key=lambda t: (-scored[t][0] * math.sqrt(scored[t][1]), len(t), t)):
        own = term.rstrip("*")
        if not any(own[:k] + "*" in chosen for k in STEMS if k < len(own) or (k == len(own) and not term.endswith("*"))):
            chosen[term] = scored[term][0]
        if len(chosen) >= most:
            break
    return chosen


class Model:
    def __init__(self, lexicon: dict[str, float]):
        self.auto, self.lexicon = Automaton(lexicon), lexicon
        self.context: dict[str, float] = {}
        self.weights = np.zeros(9)
        self.weights[0] = -3.0
        self.known: dict[str, tuple[str, int] | None] = {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "context": self.context, "weights": self.weights}

    def __setstate__(self, s):
        self.__init__(s["lexicon"])
        self.context, self.weights = s["context"], s["weights"]

    def hits(self, words: list[str]) -> list[tuple[int, str, int]]:
        known, found = self.known, {}
        if len(known) > MAX_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.auto.find(w)
            if known[w] is not None:
                found[w] = known[w]
        return [(i, *found[w]) for i, w in enumerate(words) if w in found] if found else []

    def around(self, words: list[str], hits: list[tuple[int, str, int]]) -> Iterator[tuple[bool, set[str]]]:
        for i, _, _ in hits:
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            yield any(w in _QUOTES for w in words[max(0, i - WINDOW) : i]) and any(w in _QUOTES for w in words[i + 1 : i + 1 + WINDOW]), {w for w in near if w not in _QUOTES}

    def features(self, text: str) -> list[float]:
        words = tokens(text)
        hits = self.hits(words)
        if not hits:
            return [1.0] + [0.0] * 7 + [math.log1p(len(words)) / 10]
        exact = [self.lexicon[t] for _, t, e in hits if e == 0]
        fuzzy = [self.lexicon[t] for _, t, e in hits if e > 0]
        quoted, context = 0, 0.0
        for q, near in self.around(words, hits):
            quoted += q
            context += sum(self.context.get(w, 0.0) for w in near)
        return [1.0, min(len(exact), 4) / 2, len({t for _, t, e in hits if e == 0}) / 4, max(exact, default=0.0) / 4, max(fuzzy, default=0.0) / 8, min(len(fuzzy), 4) / 4, quoted / len(hits), context / len(hits) / 4, math.log1p(len(words)) / 10]

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton steps; the first column, the constant, isn't shrunk."""
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[toxic].update(terms_of(set(_words(text))))
    terms = sorted(counts[0] | counts[1])
    for i in range(0, len(terms), 10_000):
        own = terms[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([counts[1][t] for t in own], pa.int64()), pa.array([counts[0][t] for t in own], pa.int64())], ["term", "toxic", "other"])


def _words(text: str) -> list[str]:
    return [w for w in tokens(text) if w not in _QUOTES]


def _mapped(model, what):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield what(m, b)

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled rows that are not held out: max_rows of them at most, by hash of doc_id.

    Of repeated ids the greatest label and text count; labels of ids that docs lacks don't. Without rows of both labels the
    model gives every text the same low score.
    """
    spark = docs.sparkSession
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id"))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic"), "labelled")  # a repeated id counts once
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}  # of the rows fitted: labels may have ids that docs lacks
    toxic, other = n.get(1, 0), n.get(0, 0)
    counts = rows.mapInArrow(_term_counts, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    least = max(3, toxic // 100)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (other + 1))
    best = counts.filter((F.col("a") >= least) & (odds >= ODDS)).orderBy((odds * F.sqrt("a")).desc(), F.length("term"), "term").limit(16 * MAX_TERMS)
    model = Model(choose([(r.term, r.a, r.b) for r in best.collect()], toxic, other, MAX_TERMS))

    def context(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        c: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = tokens(text)
            near = set().union(*[x for _, x in m.around(w, m.hits(w))], {"*hit*"} if m.hits(w) else set())
            c[y].update(near)
        own = sorted(c[0] | c[1])
        return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([c[1][t] for t in own], pa.int64()), pa.array([c[0][t] for t in own], pa.int64())], ["word", "toxic", "other"])

    shared = spark.sparkContext.broadcast(model)
    near = rows.mapInArrow(_mapped(shared, context), "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    total = {r.word: r for r in near.filter("word = '*hit*'").collect()}
    hit_a, hit_b = (total["*hit*"].a, total["*hit*"].b) if total else (0, 0)
    if hit_a and hit_b:  # else there is nothing to tell apart
        odds = F.log((F.col("a") + PRIOR) / (hit_a + 2 * PRIOR)) - F.log((F.col("b") + PRIOR) / (hit_b + 2 * PRIOR))
        model.context = {r.word: max(-2.0, min(2.0, r.odds)) for r in near.filter("a + b >= 10 and word <> '*hit*'").select("word", odds.alias("odds")).orderBy(F.abs("odds").desc(), "word").limit(MAX_CONTEXT).collect()}

    def features(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(1), pa.array([m.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], ["toxic", "x"])

    table = rows.mapInArrow(_mapped(spark.sparkContext.broadcast(model), features), "toxic int, x array<double>").collect()
    remove(spark, rows)
    if toxic and other:
        model.weights = logistic(np.array([r.x for r in table]), np.array([r.toxic for r in table], float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with its score and the prediction, in place of columns of those names; a null text is empty; each row stays."""
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (score_col.lower(), predicted_col.lower())])
    shared, i = docs.sparkSession.sparkContext.broadcast(model), d.columns.index(text_col)

    def one(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
        s = [m.score(t or "") for t in b.column(i).to_pylist()]
        own = [*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
        return pa.RecordBatch.from_arrays(own, [f"c{k}" for k in range(len(own))])

    return by_place(d, _mapped(shared, one), T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType()))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    A null text is scored as an empty one. Null ids count as an empty id for the fold and stay null; equal rows give equal
    rows; an empty table gives none, without usable labels every score is that of the constant. Other columns are not
    looked at.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return score(d, fit(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
