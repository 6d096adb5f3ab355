"""Secret scan: base patterns, and weak parts reported only when complementary parts lie within one scope.

Main path: DataFrame operations only. Positions are code points, ends exclusive. Parts are joined with the nearest complements
before and behind them by sweeps over their ends and starts, so that no pairs of parts are made. Rows are known by id and text
(two 64-bit hashes): equal rows are worked on once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import text_of

PART = "struct<kind:int,nth:int,gap:bigint,len:bigint,ok:boolean>"

#: Kinds in the order in which equal starts are listed. The first three are the base; the others are weak parts.
KINDS = ("assign", "access", "hex", "secret", "ident", "endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, and for assign the shortest value. Patterns of runs with a least length match as the plain run does, filtered by length.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "secret": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "ident": r"""(?i:client_?id|user_?name|access_key_id|account_id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com",
}
ASSIGN_LEAST = 12
#: Of these, in lower case, a text with a match of the kind has one. Weak secrets and endpoints count beside an identifier alone.
SEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "ident": ("client", "user", "access_key_id", "account", "login")}
#: Code points between two parts that may belong together.
SCOPE = 400
#: What a row is known by, and what parts do: identify, be secret, or say where.
ROW = ["doc_id", "k", "v"]
IDENTIFIES, SECRET = ("access", "ident"), ("assign", "hex", "secret")


def _found(text: Column, kind: str) -> Column:
    """Matches in turn: the gap before each, its length and whether it counts; from these follow the positions."""
    pattern = PATTERNS[kind]
    matches = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))

    def one(m: Column, i: Column) -> Column:
        ok = F.length(F.regexp_extract(m["hit"], pattern, 2)) >= ASSIGN_LEAST if kind == "assign" else F.lit(True)
        return F.when(m["hit"].isNotNull(), F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.length(m["gap"]).cast("long").alias("gap"), F.length(m["hit"]).cast("long").alias("len"), ok.alias("ok")))

    return F.when(text.rlike(pattern), F.array_compact(F.transform(matches, one))).otherwise(F.array().cast(f"array<{PART}>"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every part of every different row: doc_id, k, v, copies (rows like it), kind, start, end; what fails, or finds nothing, is a row with nulls."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), "text").alias("v"), "text", F.lower("text").alias("low"))
    some = {kind: reduce(or_, [F.contains("low", F.lit(w)) for w in words]) for kind, words in SEEDS.items()}
    some["secret"] = some["endpoint"] = some["access"] | some["ident"]
    none = F.array().cast(f"array<{PART}>")
    found = F.concat(*[F.when(some[k], _found(F.col("text"), k)).otherwise(none) if k in some else _found(F.col("text"), k) for k in KINDS])
    d = d.select(*ROW, F.explode_outer(found).alias("p")).select(*ROW, "p.*")
    d = d.groupBy(*ROW, "kind", "nth").agg(*[F.first(c).alias(c) for c in ("gap", "len", "ok")], F.count(F.lit(1)).alias("copies"))
    run = W.partitionBy(*ROW, "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    d = d.repartition(*ROW).withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
    d = d.withColumn("start", F.col("end") - F.col("len"))
    return d.select(*ROW, "copies", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("kind", "start", "end")])


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts() with strong (base kinds), reported (base parts, and weak ones with their complement), and partners.

    A weak secret needs an identifier, an identifier needs a secret, and an endpoint needs both; a complement doesn't overlap
    the part and is no further away than scope code points. partners are the nearest ones that were needed.
    """
    in_ = lambda names: F.col("kind").isin(*[KINDS.index(k) for k in names])
    d = found.withColumn("role", F.when(in_(IDENTIFIES), "i").when(in_(SECRET), "s").when(F.col("kind").isNotNull(), "e"))
    sides = F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(c == "start").alias("opens")) for c in ("start", "end")]))
    d = d.withColumn("side", sides).select("*", "side.*").drop("side")
    up = W.partitionBy(*ROW).orderBy("at", "opens").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*ROW).orderBy(F.col("at").desc(), F.col("opens").desc()).rowsBetween(W.unboundedPreceding, 0)
    for r in "is":
        ended = F.max(F.when((F.col("role") == r) & ~F.col("opens"), F.struct("end", "start", "kind"))).over(up)
        begun = F.min(F.when((F.col("role") == r) & F.col("opens"), F.struct("start", "end", "kind"))).over(down)
        d = d.withColumn(f"before_{r}", F.when(F.col("opens"), ended)).withColumn(f"after_{r}", F.when(~F.col("opens"), begun))
    d = d.groupBy(*ROW, "kind", "start", "end", "role").agg(F.max("copies").alias("copies"), *[F.max(f"{s}_{r}").alias(f"{s}_{r}") for s in ("before", "after") for r in "is"])
    near = {}
    for r in "is":
        far = {"before": F.col("start") - F.col(f"before_{r}.end"), "after": F.col(f"after_{r}.start") - F.col("end")}
        near[r] = F.least(*[F.when(far[s] <= scope, F.struct(far[s].alias("far"), *[F.col(f"{s}_{r}.{c}").alias(c) for c in ("kind", "start", "end")])) for s in ("before", "after")])
    d = d.withColumn("near_i", near["i"]).withColumn("near_s", near["s"])
    need = {"s": ["near_i"], "i": ["near_s"], "e": ["near_i", "near_s"]}
    partners = F.lit(None).cast("array<struct<kind:int,start:bigint,end:bigint>>")
    for r, of in need.items():
        all_ = reduce(and_, [F.col(c).isNotNull() for c in of])
        partners = F.when((F.col("role") == r) & all_, F.array(*[F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("kind", "start", "end")]) for c in of])).otherwise(partners)
    strong = F.col("kind") <= 2
    return d.withColumn("partners", partners).select(*ROW, "copies", "kind", "start", "end", strong.alias("strong"), (strong | F.col("partners").isNotNull()).alias("reported"), "partners")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, spans array<struct<start, kind, end, partners>> in order, kind a number into KINDS.

    partners has the complements that a part was linked with (null if none). A null or empty text has no spans, a null id
    stays null, equal rows give equal rows, an empty table gives none, other columns are not looked at.
    """
    d = linked(parts(docs, id_col, text_col), scope)
    span = F.when(F.col("reported"), F.struct("start", "kind", "end", "partners"))
    d = d.groupBy(*ROW).agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(span)).alias("spans"))
    return d.select("doc_id", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, all spans as text, and links: weak spans = their partners."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    text = lambda spans, f=one: F.array_join(F.transform(spans, f), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    weak = F.filter("spans", lambda s: s["kind"] > 2)
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] <= 2)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        text(weak, lambda s: F.concat(one(s), F.lit("="), F.array_join(F.transform(s["partners"], one), "+"))).alias("links"),
    )
