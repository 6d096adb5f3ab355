"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one node. Unit vectors in double precision are dealt to overlapping shards: their nearest and second
   nearest centre (of a bounded sample); a centre with more vectors than a shard holds is split by hash, and its vectors overlap
   with its next split.
2. Each shard builds a graph: nearest members, robust-pruned. Adjacency lists of all shards are united, both ways, and lie
   with the vectors in the shared folder, mapped by the tasks that search.
3. Every node searches: greedily from the nearest medoids of its two centres' shards and from its own place, then by range,
   through all that it links with. Links count the vectors of both nodes.
4. A sample of vectors is held against all rows; where recall is short, the search widens. If it stays short, all pairs of
   shards whose vectors can be near are compared, each pair in blocks. Links are exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Arrays, components, new_folder, partitions, put_array, written

LIMIT = 0.95
SHARD, SAMPLE, MAX_CENTRES = 1000, 8192, 2048
POOL, DEGREE, ALPHA = 32, 12, 1.2
BEAM, STARTS, AUDIT, RECALL = 12, 4, 256, 0.98
#: Unlinked neighbours as near as this are walked through in the range search.
SLACK = 0.02


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres by Lloyd's rounds on the sphere, from evenly spaced rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def robust_prune(x: np.ndarray, pool: int = POOL, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) rows of x: a near member stays unless an already kept one is nearer to it by the factor alpha."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = []
    for i in range(0, n, 512):
        sims = x[i : i + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        k = min(pool, n - 1)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, 1), 0))
        kept = np.zeros((len(sims), k), bool)
        open_ = np.ones((len(sims), k), bool)
        for j in range(k):
            now = open_[:, j] & (kept.sum(1) < degree)
            kept[:, j] = now
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", x[near[:, j]], x[near]), 0))
            open_ &= ~(now[:, None] & (alpha * between <= far))
        kept[:, : min(2, k)] = True
        q, j = np.nonzero(kept)
        out.append(np.stack([q + i, near[q, j]]))
    return tuple(np.concatenate(out, axis=1))


VALID = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


class Graph:
    """The united graph in the shared folder: node number = shard << 32 | place."""

    def __init__(self, folder: str, dims: int):
        self.vectors, self.ends, self.to, self.dims = Arrays(folder, "vector"), Arrays(folder, "end"), Arrays(folder, "to"), dims

    def sims(self, q: np.ndarray, nodes: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.empty(len(nodes))
        shard = nodes >> 32
        order = np.argsort(shard, kind="stable")
        edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for lo, hi in zip(edge, np.append(edge[1:], len(order))):
            for i in range(lo, hi, 1 << 15):
                at = order[i : min(hi, i + (1 << 15))]
                out[at] = np.einsum("nd,nd->n", self.vectors[int(shard[at[0]])].reshape(-1, self.dims)[nodes[at] & 0xFFFFFFFF], q[of[at]])
        return out

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, neighbour) of all neighbours."""
        own, back = np.unique(nodes, return_inverse=True)
        lists: list[np.ndarray] = []
        for x in own:
            s, i = int(x >> 32), int(x & 0xFFFFFFFF)
            end = self.ends.get(s)
            lists.append(self.to[s][end[i - 1] if i else 0 : end[i]] if end is not None else np.zeros(0, np.int64))
        size = np.array([len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        n = size[back]
        take = np.repeat(begin[back], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(nodes)), n), flat[take]

    def search(self, q: np.ndarray, starts: np.ndarray, beam: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes found with cosine >= limit, from starts (a row of node numbers for each query)."""
        rows = np.arange(len(q))
        of, node = np.repeat(rows, starts.shape[1]), starts.ravel()
        seen_of, seen_node, seen_sim, seen_done = (np.zeros(0, t) for t in (np.int64, np.int64, float, bool))
        while True:
            pair = np.unique(np.stack([of, node]), axis=1)
            if len(seen_of):
                both = np.concatenate([np.stack([seen_of, seen_node]), pair], axis=1)
                order = np.lexsort((np.arange(both.shape[1]), both[1], both[0]))
                b = both[:, order]
                new = np.ones(len(order), bool)
                new[1:] = (b[:, 1:] != b[:, :-1]).any(0)
                fresh = order[new]
                pair = both[:, np.sort(fresh[fresh >= len(seen_of)])]
            of, node = pair
            if not len(of):
                break
            seen_of, seen_node, seen_sim, seen_done = np.append(seen_of, of), np.append(seen_node, node), np.append(seen_sim, self.sims(q, node, of)), np.append(seen_done, np.zeros(len(of), bool))
            order = np.lexsort((-seen_sim, seen_of))
            rank = np.arange(len(order)) - np.searchsorted(seen_of[order], seen_of[order], "left")
            near = np.zeros(len(order), bool)
            near[order] = rank < beam
            todo = np.flatnonzero((near | (seen_sim >= limit - SLACK)) & ~seen_done)
            if not len(todo):
                break
            seen_done[todo] = True
            at, node = self.neighbours(seen_node[todo])
            of = seen_of[todo][at]
        hit = seen_sim >= limit
        return seen_of[hit], seen_node[hit]


class Counts:
    """How many vectors each node stands for."""

    def __init__(self, folder: str):
        self.held = Arrays(folder, "times")

    def __call__(self, nodes: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(nodes), np.int64), nodes >> 32
        for s in np.unique(shard):
            m = shard == s
            out[m] = self.held[int(s)][nodes[m] & 0xFFFFFFFF]
        return out


def _local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and the smallest node that the pairs (a, b) connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _compared(put: DataFrame, folder: str, dims: int, bounds: np.ndarray, shards: np.ndarray, least: np.ndarray, limit: float, parts: int) -> DataFrame:
    """node, n_links, label of all links: pairs of shards compared whole, but those too far apart to have any.

    bounds: a unit vector for each shard; least: the least cosine of its vectors with it. By the angles' triangle inequality.
    """
    spark = put.sparkSession
    held = spark.sparkContext.broadcast((shards, bounds, np.arccos(np.clip(least, -1, 1))))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, reach = held.value
        for b in batches:
            for i in b.column(0).to_numpy():
                angle = np.arccos(np.clip(at[i:] @ at[i], -1, 1))
                near = number[i:][angle <= reach[i:] + reach[i] + np.arccos(limit) + 1e-6]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), number[i], np.int64)), pa.array(near.astype(np.int64))], ["s", "t"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, times = Arrays(folder, "vector"), Counts(folder)
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                left, right = (vectors[x].reshape(-1, dims) for x in (s, t))
                for i in range(0, len(left), 1024):
                    for j in range(0, len(right), 1024):
                        a, c = np.nonzero(left[i : i + 1024] @ right[j : j + 1024].T >= limit)
                        a, c = (s << 32) + i + a, (t << 32) + j + c
                        a, c = a[a != c], c[a != c]
                        node, at = np.unique(a if s == t else np.concatenate([a, c]), return_inverse=True)
                        n = np.bincount(at, times(c if s == t else np.concatenate([c, a])), len(node))
                        mine, label = _local_labels(a, c) if len(a) else (a, c)
                        none = lambda k: pa.nulls(k, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int64)), none(len(node))], ["node", "n_links", "label"])
                        yield pa.RecordBatch.from_arrays([pa.array(mine), none(len(mine)), pa.array(label)], ["node", "n_links", "label"])

    each = written(spark.range(0, len(shards), 1, parts).mapInArrow(pairs, "s long, t long"), "pairs")
    found = written(each.repartition(4 * parts, "s", "t").mapInArrow(compare, "node long, n_links long, label long"), "compared")
    counts = put.select("node").join(found.filter("n_links is not null").groupBy("node").agg(F.sum("n_links").alias("n_links")), "node", "left")
    return written(counts.select("node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.lit(None).cast("long").alias("label")).union(found.filter("label is not null").distinct()), "found")


def links(vectors: DataFrame, limit: float = LIMIT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, and the audited recall, for each row.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components link with
    nothing. Rows with equal ids are rows of their own; a null id stays null and is no component's smallest id unless
    the component has no other. An empty table gives none; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")), "vectors")
    good = rows.filter(VALID)
    size = (good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first() or [0])[0]
    good = good.filter(F.size("embedding") == size).select("rid", "embedding", F.xxhash64("embedding").alias("k"), F.xxhash64(F.lit(1), "embedding").alias("v"))
    rids = good.select("rid", "k", "v")
    good = written(good.groupBy("k", "v").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("times"), F.first("embedding").alias("embedding")), "nodes")
    n = good.count()
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    if n < 1:
        return plain
    parts, folder = max(32, partitions(spark)), new_folder(spark, "graph")
    sample = unit(np.array([r.embedding for r in good.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("embedding").collect()]))
    k = int(min(MAX_CENTRES, max(1, -(-2 * n // SHARD)), len(sample)))
    centre = spark.sparkContext.broadcast(centres_of(sample, k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centre.value
        for b in batches:
            x = unit(np.array(b.column(1).to_pylist()))
            sims = x @ c.T
            own = np.argpartition(-sims, min(1, k - 1), axis=1)[:, :2]
            own = np.take_along_axis(own, np.argsort(-np.take_along_axis(sims, own, 1), axis=1), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(own[:, 0].astype(np.int32)), pa.array(own[:, -1].astype(np.int32)), *b.columns[2:]], ["rid", "x", "c1", "c2", "times", "k", "v"])

    put = written(good.select("rid", "embedding", "times", "k", "v").mapInArrow(assign, "rid long, x array<double>, c1 int, c2 int, times long, k long, v long"), "assigned")
    sizes = {r.c1: r["count"] for r in put.groupBy("c1").count().collect()}
    splits = [-(-sizes.get(c, 0) // SHARD) or 1 for c in range(k)]
    first = np.concatenate([[0], np.cumsum(splits)])[:-1].tolist()
    dim = spark.createDataFrame([(c, int(splits[c]), int(first[c])) for c in range(k)], "c int, splits int, first int")
    salt = F.pmod(F.xxhash64("rid"), F.col("splits")).cast("int")
    put = put.join(F.broadcast(dim), put.c1 == dim.c).withColumn("salt", salt).withColumn("shard", F.col("first") + F.col("salt"))
    put = put.withColumn("also", F.when(F.col("splits") > 1, F.col("first") + (F.col("salt") + 1) % F.col("splits"))).drop("c", "splits", "first", "salt")
    put = put.join(F.broadcast(dim), put.c2 == dim.c).withColumn("second", F.when(F.col("c2") == F.col("c1"), F.col("also")).otherwise(F.col("first") + salt)).drop("c", "splits", "first")
    from pyspark.sql import Window as W

    put = put.withColumn("node", F.shiftleft(F.col("shard").cast("long"), 32) + F.row_number().over(W.partitionBy("shard").orderBy("rid")) - 1)
    put = written(put.select("rid", "node", "x", "c1", "c2", "times", "k", "v", "shard", "second", "also"), "placed")
    member = put.select("node", "x", F.explode(F.array_distinct(F.array_compact(F.array("shard", "second", "also")))).alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        node, x = pdf["node"].to_numpy(), np.array(pdf["x"].tolist())
        a, b = robust_prune(x)
        return pd.DataFrame({"a": np.concatenate([node[a], node[b]]), "b": np.concatenate([node[b], node[a]])})

    edges = member.groupBy("shard").applyInPandas(build, "a long, b long").distinct()

    def put_edges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, pdf = int(key[0]), pdf.sort_values(["place", "b"])
        put_array(folder, "end", p, np.cumsum(np.bincount(pdf["place"].to_numpy(), minlength=sizes_of[p])).astype(np.int64))
        put_array(folder, "to", p, pdf["b"].to_numpy().astype(np.int64))
        return pd.DataFrame({"n": [len(pdf)]})

    def put_vectors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.array(pdf["x"].tolist())
        put_array(folder, "vector", int(key[0]), x.ravel())
        put_array(folder, "times", int(key[0]), pdf["times"].to_numpy().astype(np.int64))
        medoid = int((x @ x.mean(0)).argmax())
        return pd.DataFrame({"shard": [int(key[0])], "node": [pdf["node"].iloc[medoid]], "x": [x[medoid].tolist()], "size": [len(x)], "least": [(x @ x[medoid]).min()]})

    medoids = put.groupBy("shard").applyInPandas(put_vectors, "shard int, node long, x array<double>, size int, least double").collect()
    sizes_of = {r.shard: r["size"] for r in medoids}
    edges.select(F.shiftright("a", 32).cast("int").alias("shard"), F.col("a").bitwiseAND(0xFFFFFFFF).alias("place"), "b").groupBy("shard").applyInPandas(put_edges, "n long").agg(F.sum("n")).collect()
    by_shard = sorted(medoids, key=lambda r: r.shard)
    edge = np.searchsorted([r.shard for r in by_shard], [*first, sum(splits)])
    start = spark.sparkContext.broadcast((np.array([r.node for r in by_shard]), np.array([r.x for r in by_shard]), edge))

    def look(beam: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph, times, (nodes, medoid, edge) = None, Counts(folder), start.value
            for b in batches:
                graph = graph or Graph(folder, size)
                every_node, every, own = b.column(0).to_numpy(), np.array(b.column(1).to_pylist()), np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], 1)
                for i in range(0, len(every), 256):
                    node, x = every_node[i : i + 256], every[i : i + 256]
                    starts = np.repeat(node[:, None], STARTS + 1, axis=1)
                    for j, two in enumerate(own[i : i + 256]):
                        close = np.concatenate([np.arange(edge[c], edge[c + 1]) for c in set(two.tolist())])
                        close = close[np.argsort(-(medoid[close] @ x[j]), kind="stable")[:STARTS]]
                        starts[j, : len(close)] = nodes[close]
                    of, to = graph.search(x, starts, beam, limit)
                    other = to != node[of]
                    of, to = of[other], to[other]
                    count = np.bincount(of, times(to), len(node))
                    mine, label = _local_labels(node[of], to) if len(of) else (of, to)
                    none = lambda k: pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(count.astype(np.int64)), none(len(node))], ["node", "n_links", "label"])
                    yield pa.RecordBatch.from_arrays([pa.array(mine), none(len(mine)), pa.array(label)], ["node", "n_links", "label"])

        return run

    audit = put.orderBy(F.xxhash64("rid", F.lit(1)), "rid").limit(AUDIT).select("node", "x", "times").collect()
    asked = spark.sparkContext.broadcast(np.array([r.x for r in audit]))

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value), np.int64)
        for b in batches:
            total += (asked.value @ np.array(b.column(0).to_pylist()).T >= limit) @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "n"])

    want = {r.i: r.n - audit[r.i].times for r in put.select("x", "times").mapInArrow(truth, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    ids = spark.createDataFrame([(r.node, i) for i, r in enumerate(audit)], "node long, i long")

    def recall_of(found: DataFrame) -> float:
        """The lesser of the recall of all links of the audited vectors and the mean of each one's recall."""
        own = {r.i: r.n_links for r in found.filter("n_links is not null").join(F.broadcast(ids), "node").collect()}
        linked = [i for i in own if want[i]]
        got = [min(own[i], want[i]) for i in linked]
        return min(sum(got) / sum(want[i] for i in linked), float(np.mean([n / want[i] for n, i in zip(got, linked)]))) if linked else 1.0

    beam = BEAM
    while True:
        found = written(put.select("node", "x", "c1", "c2").repartition(parts, "node").mapInArrow(look(beam), "node long, n_links long, label long"), "found")
        recall = recall_of(found)
        if recall >= RECALL or beam >= 8 * BEAM:
            break
        beam *= 2
    if recall < RECALL:
        found = _compared(put, folder, size, np.array([r.x for r in medoids]), np.array([r.shard for r in medoids]), np.array([r.least for r in medoids]), limit, parts)
        recall = recall_of(found)
    group = components(found.filter("label <> node").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct())
    per = put.select("k", "v", "times", "node").join(found.filter("n_links is not null").select("node", "n_links"), "node").join(group, "node", "left")
    per = rids.join(per.select("k", "v", (F.col("n_links") + F.col("times") - 1).alias("n_links"), F.coalesce("label", "node").alias("label")), ["k", "v"]).drop("k", "v")
    out = rows.select("rid", "vec_id").join(per, "rid", "left")
    least = out.filter("label is not null").groupBy("label").agg(F.min("vec_id").alias("component_id"))
    out = out.join(least, "label", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast(T.LongType()).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("recall"))


def oracle(from_table: str = "embeddings") -> str:
    """DuckDB SQL for links() by exact cosines of all pairs, so of recall 1, on a table without null or repeated ids."""
    return f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {from_table}
    WHERE len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), v AS (
    SELECT * FROM usable WHERE len(e) = (SELECT len(e) FROM usable GROUP BY len(e) ORDER BY count(*) DESC, len(e) LIMIT 1)
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LIMIT}
), reached AS (
    SELECT vec_id, vec_id AS other FROM {from_table} UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept, CAST(1 AS DOUBLE) AS recall
FROM reached GROUP BY vec_id
"""
