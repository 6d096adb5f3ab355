"""Merkle manifest of a table: one tree for each source over its rows in order, one tree over the sources, a proof for every row.

Rows are numbered by a range sort, so that a source's rows spread over all tasks; each level groups runs of at most `fan`
nodes. Proofs come by pointer jumping: every node holds the siblings on its way to an ancestor, and each self-join doubles
the distance to it. The rows of one run share all of their way but its first step, so runs jump, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, remove, written

#: Nodes to a run.
FAN = 16
#: Nodes that may jump by one row of the join before that row is split.
FAN_IN = 2048
#: What a leaf of `documents` is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of a row's fields: each `-` if null, else its UTF-8 byte count, a colon and its text."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and its siblings, as a verifier computes it."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _step(hashes: Column, at: Column, fan: int) -> Column:
    """The siblings of the run's node at a place, on its left and on its right."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), at), "").alias("left"), F.array_join(F.slice(hashes, at + 2, F.lit(fan)), "").alias("right"))


def _levels(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """Written tables of the levels above nodes(key, tree, level, idx, nodes, hash, below) until every tree has one node.

    nodes is the number of its tree's nodes in the level, below the number of nodes under it and itself; a row of a level
    has kids, its run in order.
    """
    out = []
    while most > 1:
        kid = F.struct("idx", "key", "hash", "below")
        up = nodes.filter("nodes > 1").groupBy("tree", (F.col("level") + 1).alias("level"), F.floor(F.col("idx") / fan).alias("idx"))
        up = up.agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.ceil(F.first("nodes") / fan).alias("nodes"))
        up = up.withColumn("hash", F.sha2(F.array_join("kids.hash", ""), 256)).withColumn("below", F.aggregate("kids.below", F.lit(1).cast("long"), lambda a, x: a + x))
        out.append(written(up.withColumn("key", F.struct("tree", "level", "idx")), "level"))
        nodes, most = out[-1], -(-most // fan)
    return out


def _double(way: DataFrame) -> DataFrame:
    """way(key, up, up_below, below, siblings, subroot) with up moved on to up's own up; null up: the root is reached.

    Many nodes share an up: its row is split by how many nodes are under it.
    """
    pieces = lambda c: F.ceil(F.col(c) / FAN_IN)
    on = way.filter("up is not null").withColumn("salt", F.pmod(F.xxhash64("key"), pieces("up_below")))
    to = way.select(F.col("key").alias("t"), F.col("up").alias("t_up"), F.col("up_below").alias("t_below"), F.col("siblings").alias("t_siblings"), F.col("subroot").alias("t_subroot"), F.explode(F.sequence(F.lit(0).cast("long"), pieces("below") - 1)).alias("t_salt"))
    on = on.join(to, (F.col("up") == F.col("t")) & (F.col("salt") == F.col("t_salt")))
    on = on.select("key", F.col("t_up").alias("up"), F.col("t_below").alias("up_below"), "below", F.concat("siblings", "t_siblings").alias("siblings"), F.coalesce("subroot", "t_subroot").alias("subroot"))
    return way.filter("up is null").unionByName(on)


def proofs(docs: DataFrame, leaf: Column, by: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """One row for each row of docs: <order>, leaf, keep, siblings array<struct<left, right>>, subroot, root.

    Rows of a source ascend by order, a null first; what ties is put by its leaf, so that equal rows are the only ones whose
    places can be swapped. Sources ascend bytewise, a null one first and with a tree of its own. The siblings are those of each run
    up to the root, as hex text, left and right of the row's own way; a lone node has none. An empty table gives none; texts
    of any length are hashed whole; docs' other columns are not looked at.
    """
    keep = keep or {}
    d = written(docs.select(F.col(f"`{order}`").alias("id"), F.col(f"`{by}`").alias("name"), leaf.alias("leaf"), *[c.alias(f"k{i}") for i, c in enumerate(keep.values())]), "leaves")
    rows = in_order(d, "name", "id", "leaf")
    trees = in_order(rows.groupBy("name").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("size")), "name")
    sizes = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("size").alias("most")).first()
    rank = F.col("at") - F.col("start")
    item = F.struct((rank % fan).alias("pos"), "id", "leaf", *[f"k{i}" for i in range(len(keep))])
    runs = rows.join(trees.select(F.col("name").alias("t_name"), "start", "size", F.col("at").alias("tree")), F.col("name").eqNullSafe(F.col("t_name"))).groupBy("tree", F.floor(rank / fan).alias("idx")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(item)).alias("items"))
    runs = runs.withColumn("level", F.when(F.col("size") > 1, 1).otherwise(0)).withColumn("nodes", F.ceil(F.col("size") / fan)).withColumn("below", F.lit(1).cast("long"))
    runs = runs.withColumn("hash", F.when(F.col("size") > 1, F.sha2(F.array_join("items.leaf", ""), 256)).otherwise(F.get("items.leaf", F.lit(0))))
    runs = written(runs.withColumn("key", F.struct("tree", "level", "idx")), "runs")
    node = ["key", "tree", "level", "idx", "nodes", "hash", "below"]
    own = _levels(runs.select(*node), -(-(sizes.most or 0) // fan), fan)
    tops = runs.select(*node)
    for level in own:
        tops = tops.unionByName(level.select(*node))
    tops = tops.filter("nodes = 1").select("key", F.lit(-1).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(sizes.trees).cast("long").alias("nodes"), "hash", "below")
    over = _levels(tops, sizes.trees, fan)
    root = over[-1].filter("nodes = 1").select(F.col("hash").alias("root")) if over else tops.select(F.col("hash").alias("root"))
    last = F.col("tree") == (-1 if over else 0)
    way = None
    for level in [*own, *over]:
        at = F.col("nodes") == 1
        kids = level.select(F.when(~(last & at), F.col("key")).alias("up"), F.when(~(last & at), F.col("below")).alias("up_below"), F.col("tree"), F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("at", "kid"))
        top = (F.col("tree") == -1) & (F.col("kid.key.tree") >= 0)
        kids = kids.select("kid.key", "up", "up_below", "kid.below", F.array(_step(F.col("hashes"), F.col("at"), fan)).alias("siblings"), F.when(top, F.col("kid.hash")).alias("subroot"))
        way = kids if way is None else way.unionByName(kids)
    none = F.array().cast(STEP)
    if way is None:
        runs = runs.withColumns({"siblings": none, "subroot": F.lit(None).cast("string")})
    else:
        way, reach = written(way, "way"), 1
        while reach < len(own) + len(over):
            longer = written(_double(way), "way")
            remove(docs.sparkSession, way)
            way, reach = longer, reach * 2
        runs = runs.join(way.select("key", "siblings", "subroot"), "key", "left")
    remove(docs.sparkSession, d, rows, trees)
    runs = runs.crossJoin(F.broadcast(root)).select("size", F.col("items.leaf").alias("hashes"), F.coalesce("siblings", none).alias("way"), F.coalesce("subroot", "root").alias("subroot"), "root", F.explode("items").alias("item"))
    siblings = F.when(F.col("size") == 1, F.col("way")).otherwise(F.concat(F.array(_step(F.col("hashes"), F.col("item.pos").cast("int"), fan)), "way"))
    return runs.select(F.col("item.id").alias(order), F.col("item.leaf").alias("leaf"), *[F.col(f"item.k{i}").alias(n) for i, n in enumerate(keep)], siblings.alias("siblings"), "subroot", "root")


def checked(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents, some of them tampered with.

    Where 5 divides crc32 of the id in decimal, the text's A-Z are lower-cased after the manifest was made (a row with a
    null id is left alone); every row's root is folded from what it is now and its siblings, and held to the manifest's.
    """
    now = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if f == "text" else F.col(f) for f in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of(now))
    p = proofs(docs, leaf_of([F.col(f) for f in FIELDS]), keep={"tampered": tampered})
    shown = F.array_join(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])), "")
    p = p.select("doc_id", "leaf", "subroot", "root", F.sha2(shown, 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("siblings")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB, its table worked out from the polynomial."""
    table = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    step = f"xor(c >> 8, list_extract({table}, xor(c & 255, b) + 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295)"


def oracle(levels: int = 6) -> str:
    """checked() of the table documents in DuckDB; trees of 16 ** levels rows or sources at most."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = {
        "tampered": f"SELECT id, {crc32_sql('id::VARCHAR')} % 5 = 0 AS hit FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL)",
        "hashed": f"SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN hit THEN {leaf(lower)} END AS other FROM documents LEFT JOIN tampered ON id = doc_id",
        "leaves": "SELECT doc_id, leaf, other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM hashed",
        "a0": "SELECT s, r AS i, n, leaf AS h FROM leaves",
    }
    for k, tree in enumerate("ab"):
        for x in range(levels):
            ctes[f"{tree}k{x}"] = f"SELECT s, i // 16 AS j, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {tree}{x} WHERE n > 1 GROUP BY ALL"
            ctes[f"{tree}{x + 1}"] = f"SELECT s, j AS i, (n + 15) // 16 AS n, sha256(array_to_string(hs, '')) AS h FROM {tree}k{x}"
        if k == 0:
            ctes["subroots"] = " UNION ALL ".join(f"SELECT s, h FROM a{x} WHERE n = 1" for x in range(levels + 1))
            ctes["b0"] = "SELECT 0 AS s, s AS i, count(*) OVER () AS n, h FROM subroots"
    ctes["roots"] = " UNION ALL ".join(f"SELECT h AS root FROM b{x} WHERE n = 1" for x in range(levels + 1))
    ctes["f0"] = "SELECT doc_id, leaf, r, s, coalesce(other, leaf) AS now, '' AS proof FROM leaves"
    for x in range(2 * levels):
        tree, at, level = ("a", "r", x) if x < levels else ("b", "s", x - levels)
        pos = f"{at} // {16**level} % 16"
        left, right = f"coalesce(array_to_string(hs[1:{pos}], ''), '')", f"coalesce(array_to_string(hs[{pos} + 2:], ''), '')"
        here = "AND k.s = f.s" if tree == "a" else ""
        ctes[f"f{x + 1}"] = f"SELECT f.* EXCLUDE (now, proof), CASE WHEN hs IS NULL THEN now ELSE sha256({left} || now || {right}) END AS now, proof || {left} || {right} AS proof FROM f{x} f LEFT JOIN {tree}k{level} k ON k.j = f.{at} // {16 ** (level + 1)} {here}".replace(f"{at} // {16**level} %", f"f.{at} // {16**level} %")
    body = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in ctes.items())
    return f"WITH {body} SELECT doc_id, leaf, u.h AS subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified FROM f{2 * levels} f JOIN subroots u ON u.s = f.s, roots"
