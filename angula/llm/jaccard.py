"""Jaccard join of word-shingle sets: size-banded tiles, bitmap bounds, exact sorted intersections.

1. Every document's set gets a key; equal sets are one node. All shingles are counted; those of many documents are common.
2. In the order (common, hash) two sets with Jaccard >= 0.8 share one of the first n - ceil(0.8 n) + 1 shingles of each
   (any order will do for that; this one keeps shared passages out of the way). Nodes with such a shingle in common and of
   one size band or the next form a tile. Tiles of the same nodes are one.
3. In rounds, each node of a tile is held against one hub; what links is merged. When few cross pairs are left, every pair
   of one tile in two components is checked, so no link between components is missed.
A pair is first bounded by the bits of hashed bitmaps, then intersected exactly. Sets lie as sorted arrays in the shared
folder, mapped by the tasks that check pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Arrays, by_part, components, find, fresh, keys_of, new_folder, parts_of, put_array, range_part, remove, small, small_blob, text_of, written
from .grams import set_keys, shingle_sets

N = 5
#: Documents that a shingle is in before it goes to the end of the order; a matter of speed alone.
COMMON = 64
BITS = 1024
#: Rounds against hubs at most, and hubs for each node after the first.
ROUNDS, HUBS = 3, 8
U24 = np.uint64(24)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _read(parts: int):
    """Documents with their nodes, and all their shingles by range of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sizes, keys, got = [], [], []
            for _, n, ends, g in shingle_sets(b.columns[-1], N):
                sizes.append(n)
                keys.append(set_keys(n, ends, g))
                got.append(g)
            if not got:
                continue
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32) % parts), *b.columns[:-1], pa.array(np.concatenate(sizes).astype(np.int64)), _i64(np.concatenate(keys)), pa.nulls(n, pa.binary())], ["part", *b.schema.names[:-1], "n_shingles", "node", "blob"])
            g = np.sort(np.concatenate(got))
            cut = np.searchsorted(range_part(g, parts), np.arange(parts + 1))
            own = [p for p in range(parts) if cut[p] < cut[p + 1]]
            none = [pa.nulls(len(own), pa.int64())] * (b.num_columns + 1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *none, pa.array([small_blob(g[cut[p] : cut[p + 1]] >> U24) for p in own], pa.binary())], ["part", *b.schema.names[:-1], "n_shingles", "node", "blob"])

    return run


def _count(folder: str, common: int):
    """Passes documents on and writes the common shingles of each range, and those of two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []

        def put() -> None:
            if blobs:
                keys, n = np.unique(np.concatenate([keys_of(x) for x in blobs]), return_counts=True)
                put_array(folder, "common", part, keys[n >= common] << U24)
                put_array(folder, "twice", part, keys[n >= 2] << U24)

        for b in batches:
            for p, x in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
                if p != part:
                    put()
                    part, blobs = p, []
                if x is not None:
                    blobs.append(x)
            docs = b.filter(pa.compute.is_null(b.column("blob")))
            yield docs.select(docs.schema.names[1:-1])
        put()

    return run


def prefix_sizes(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0)


def _prefixes(folder: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, twice = Arrays(folder, "common"), Arrays(folder, "twice")
        for b in small(batches):
            hs, nodes, ns = [], [], []
            for _, sizes, ends, g in shingle_sets(b.column(0), N):
                of = np.repeat(np.arange(len(sizes)), sizes)
                own, back = np.unique(g >> U24 << U24, return_inverse=True)
                late = (find(common, parts, own)[0] >= 0)[back]
                order = np.lexsort((g, late, of))
                rank = np.arange(len(g)) - np.repeat(ends - sizes, sizes)
                take = order[rank < np.repeat(prefix_sizes(sizes), sizes)]
                hs.append(g[take])
                nodes.append(set_keys(sizes, ends, g)[of[take]])
                ns.append(sizes[of[take]].astype(np.uint32))
            if not hs:
                continue
            h, node, n = map(np.concatenate, (hs, nodes, ns))
            order = np.lexsort((node, h))
            h, node, n = h[order], node[order], n[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            keep[keep] = find(twice, parts, h[keep] >> U24 << U24)[0] >= 0
            h, node, n = h[keep], node[keep], n[keep]
            cut = np.searchsorted(range_part(h, parts), np.arange(parts + 1))
            own = [p for p in range(parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([small_blob(h[cut[p] : cut[p + 1]]) for p in own], pa.binary()), *[pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in own], pa.binary()) for x in (node, n)]],
                ["part", "h", "node", "n"],
            )

    return run


def tiles_of(h: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, node, size): nodes that share a shingle, in their size band and the next; tiles of the same nodes once."""
    band = np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int64)
    h, node, n, band = np.tile(h, 2), np.tile(node, 2), np.tile(n, 2), np.concatenate([band, band + 1])
    order = np.lexsort((node, band, h))
    h, node, n, band = h[order], node[order], n[order], band[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (band[1:] != band[:-1])
    keep = np.ones(len(h), bool)
    keep[1:] = new[1:] | (node[1:] != node[:-1])
    node, n, new = node[keep], n[keep], new[keep]
    if not len(node):
        return node, node, n
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(node)))
    from .grams import mix

    sig = mix(np.add.reduceat(mix(node), begin) + count.astype(np.uint64))
    first = np.zeros(len(begin), bool)
    first[np.unique(sig, return_index=True)[1]] = True
    use = np.repeat(first & (count > 1), count)
    return np.repeat(sig, count)[use], node[use], n[use]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in by_part(batches):
        tile, node, n = tiles_of(*map(np.concatenate, zip(*((keys_of(h), np.frombuffer(node, np.uint64), np.frombuffer(n, np.uint32)) for h, node, n in rows))))
        for i in range(0, len(tile), 50_000):
            yield pa.RecordBatch.from_arrays([_i64(tile[i : i + 50_000]), _i64(node[i : i + 50_000]), pa.array(n[i : i + 50_000].astype(np.int32))], ["tile", "node", "n"])


def _with_part(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(range_part(node, parts).astype(np.int32)), b.column("node")], ["part", "node"])

    return run


def _put_nodes(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in by_part(batches):
            put_array(folder, "wanted", p, np.unique(np.array([x for x, in rows], np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    return run


def _sets(folder: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Arrays(folder, "wanted")
        for b in batches:
            nodes, sets = [], []
            for _, sizes, ends, g in shingle_sets(b.column(0), N):
                key = set_keys(sizes, ends, g)
                order = np.argsort(key)
                for d in order[find(wanted, parts, key[order])[0] >= 0]:
                    nodes.append(key[d])
                    sets.append(g[ends[d] - sizes[d] : ends[d]].tobytes())
            if nodes:
                key = np.array(nodes, np.uint64)
                first = np.unique(key, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(range_part(key[first], parts).astype(np.int32)), _i64(key[first]), pa.array([sets[i] for i in first], pa.binary())], ["part", "node", "set"])

    return run


def _put_sets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in by_part(batches):
            own = {node & (1 << 64) - 1: s for node, s in rows}
            keys = np.array(sorted(own), np.uint64)
            sets = [np.frombuffer(own[int(k)], np.uint64) for k in keys]
            bits = np.zeros((len(keys), BITS // 64), np.uint64)
            for i, s in enumerate(sets):
                at = (s % np.uint64(BITS)).astype(np.int64)
                np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            put_array(folder, "node", p, keys)
            put_array(folder, "bits", p, bits.ravel())
            put_array(folder, "end", p, np.cumsum([len(s) for s in sets]).astype(np.int64))
            put_array(folder, "set", p, np.concatenate(sets))
            yield pa.RecordBatch.from_arrays([_i64(keys), *[_i64(bits[:, k]) for k in range(BITS // 64)]], ["node", *[f"b{k}" for k in range(BITS // 64)]])

    return run


def may_link(a: str, b: str) -> str:
    """SQL for overlap_bound on joined rows: whether the bitmaps leave room for a Jaccard of 0.8."""
    alone = lambda x, y: " + ".join(f"bit_count({x}.b{k} & ~{y}.b{k})" for k in range(BITS // 64))
    return f"9 * least({a}.n - ({alone(a, b)}), {b}.n - ({alone(b, a)})) >= 4 * ({a}.n + {b}.n)"


def overlap_bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Each bit that only one bitmap has stands for a shingle that only that set has."""
    return np.minimum(na - np.bitwise_count(a & ~b).sum(1), nb - np.bitwise_count(b & ~a).sum(1))


def _verify(folder: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = None
        for b in batches:
            if store is None:
                store = {k: Arrays(folder, k) for k in ("node", "bits", "end", "set")}
            sides = []
            for c in ("a", "b"):
                key = b.column(c).to_numpy().view(np.uint64)
                order = np.argsort(key)
                at, of = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
                at[order], of[order] = find(store["node"], parts, key[order])
                bits = np.zeros((len(key), BITS // 64), np.uint64)
                lo, hi = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
                for p in np.unique(of):
                    m = of == p
                    end = store["end"][p]
                    bits[m] = store["bits"][p].reshape(-1, BITS // 64)[at[m]]
                    hi[m], lo[m] = end[at[m]], np.where(at[m] > 0, end[at[m] - 1], 0)
                sides.append((of, lo, hi, bits))
            (pa_, la, ha, ba), (pb, lb, hb, bb) = sides
            na, nb = ha - la, hb - lb
            ok = 9 * overlap_bound(ba, bb, na, nb) >= 4 * (na + nb)
            for i in np.flatnonzero(ok):
                x, y = store["set"][pa_[i]][la[i] : ha[i]], store["set"][pb[i]][lb[i] : hb[i]]
                both = np.concatenate([x, y])
                both.sort()
                ok[i] = 9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * (na[i] + nb[i])
            yield b.filter(pa.array(ok))

    return run


def classes(docs: DataFrame, text_col: str, **ids: Column) -> tuple[DataFrame, DataFrame]:
    """(rows: ids, n_shingles, node; labels: node, label) where nodes with one label are one component; ids are long columns.

    Documents with equal sets have one node; the node of an empty set is 0 and has no label, as have nodes without links.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "sets")
    d = docs.select(*[c.cast("long").alias(k) for k, c in ids.items()], text_of(text_col).alias("text"))
    parts = parts_of(d, F.col("text"))
    dealt = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")
    kept = ", ".join(f"{k} long" for k in [*ids, "n_shingles", "node"])
    rows = dealt(d.mapInArrow(_read(parts), f"part int, {kept}, blob binary")).mapInArrow(_count(folder, COMMON), kept)
    rows = written(rows, "nodes")
    text = d.select("text")
    tiles = dealt(text.mapInArrow(_prefixes(folder, parts), "part int, h binary, node binary, n binary")).mapInArrow(_tiles, "tile long, node long, n int")
    tiles = written(tiles.dropDuplicates(["tile", "node"]), "tiles")
    nodes = tiles.select("node").distinct()
    dealt(nodes.mapInArrow(_with_part(parts), "part int, node long")).mapInArrow(_put_nodes(folder), "n long").agg(F.sum("n")).collect()
    bits = ", ".join(f"b{k} long" for k in range(BITS // 64))
    signs = dealt(text.mapInArrow(_sets(folder, parts), "part int, node long, set binary")).mapInArrow(_put_sets(folder), f"node long, {bits}")
    signs = written(signs, "signs")
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    for turn in range(ROUNDS + 1):
        t = tiles.join(labels, "node")
        left = t.groupBy("tile", "label").count().groupBy("tile").agg(F.sum("count").alias("k"), F.sum(F.col("count") * F.col("count")).alias("own"), F.count(F.lit(1)).alias("labels"))
        left = written(left.filter("labels > 1").select("tile", ((F.col("k") * F.col("k") - F.col("own")) / 2).alias("pairs")), "open")
        open_pairs, size = left.agg(F.sum("pairs")).first()[0], labels.count()
        if not open_pairs:
            break
        t = t.join(left.select("tile"), "tile", "left_semi")
        last = turn == ROUNDS or open_pairs <= 16 * size
        if last:
            signed = t.join(signs, "node")
            on = F.expr(f"a.tile = b.tile AND a.label < b.label AND {may_link('a', 'b')}")
            pairs = signed.alias("a").join(signed.alias("b"), on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.label").alias("la"), F.col("b.label").alias("lb")).distinct()
        else:
            by = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
            hubs = t.groupBy("tile").agg(F.min(F.struct(by.alias("by"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))).alias("hub")).select("tile", "hub.*")
            pairs = t.join(hubs, "tile").filter("label <> lb AND 5 * least(n, nb) >= 4 * greatest(n, nb)")
            pairs = pairs.groupBy(F.col("node").alias("a"), F.col("label").alias("la")).agg(F.array_sort(F.collect_set(F.struct("by", "b", "lb"))).alias("hubs"))
            pairs = pairs.select("a", "la", F.explode(F.slice("hubs", 1, HUBS if turn else 1)).alias("hub")).select("a", "hub.b", "la", "hub.lb")
        good = pairs.repartition(parts, "b").mapInArrow(_verify(folder, parts), "a long, b long, la long, lb long")
        found = components(good.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = written(labels.join(found, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if last:
            break
    remove(spark, folder, tiles, signs)
    return rows, labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: the smallest id that links of Jaccard >= 0.8 reach.

    Null and empty texts have no shingles and link with nothing. A row with a null id links by its text; its
    component_id is null if no row with an id is reached. Equal rows give equal rows, an empty table gives none, other
    columns are not looked at.
    """
    rows, labels = classes(docs, text_col, doc_id=F.col(id_col))
    per = rows.filter("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = per.join(per.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    return rows.join(ids, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of join(): the one with the smallest id, of equal ids the smallest text hash, and once.

    Rows go by what they hold, not by their id: another row of the same id stays. Rows with a null id go only if their
    component has a row with an id or another one without. Null and empty texts all stay. All columns stay as they were;
    an empty table gives none. Texts are known by 128 bits; verdicts are joined to them by a shuffle at every size.
    """
    k, v, verdict = fresh(docs, "k", "v", "verdict")
    hashes = {k: F.xxhash64(text_of(text_col)), v: F.xxhash64(F.lit(1), text_of(text_col))}
    rows, labels = classes(docs, text_col, doc_id=F.col(id_col), k=hashes[k], v=hashes[v])
    texts = rows.filter("node <> 0").groupBy("node", "k", "v").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    texts = written(texts, "texts")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "k", "v"))
    of = texts.groupBy("label").agg(first.alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    verdicts = texts.join(of, "label").select(F.col("k").alias(k), F.col("v").alias(v), F.struct(((F.col("k") == F.col("first.k")) & (F.col("v") == F.col("first.v"))).alias("stays"), "least", "n").alias(verdict))
    verdicts = written(verdicts, "verdicts")
    remove(docs.sparkSession, texts)
    judged = docs.withColumns(hashes).join(verdicts.hint("shuffle_hash"), [k, v], "left")
    chosen = F.col(verdict)["stays"] & F.col(verdict)["least"].eqNullSafe(F.col(id_col).cast("long"))
    alone = judged.filter(F.col(verdict).isNull() | (chosen & (F.col(verdict)["n"] == 1)))
    tied = judged.filter(chosen & (F.col(verdict)["n"] > 1)).dropDuplicates([k, v])
    return alone.unionByName(tied).drop(k, v, verdict)


def oracle(from_table: str = "documents") -> str:
    """DuckDB SQL for join() on a table without null or repeated ids."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {from_table}
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS shingle
    FROM texts WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT o.a, o.b FROM common o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b WHERE 100 * o.n >= 80 * (x.n + y.n - o.n)
), reached AS (
    SELECT doc_id, doc_id AS other FROM {from_table} UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM {from_table} d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""
