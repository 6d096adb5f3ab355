"""Personal data: base patterns, and terms that give away the entities found by them.

Main path: DataFrame operations only. Positions are code points, ends exclusive. A term is a run of three or more letters (A-Z as a-z).
How much it tells of an entity is estimated from the whole corpus: n(e, t) documents hold t near e, n(t) hold t anywhere, and
the bits that stay unknown about e once t is seen are IC(e) - PMI(e; t) = log2 n(t) - log2 n(e, t). Terms that leave few
bits are removed or generalised wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, text_of, written

#: Kinds in the order in which equal starts are listed; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
TERM = len(KINDS) - 1
#: Each matches what the plain pattern of the kind matches in turn, without walking a run again from every place in it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Code points on either side of an entity, up to the next one of its kind, in which terms stand near it.
NEAR = 100
#: Different surroundings in which a term must stand near an entity to count as evidence: copies of one text have one.
CONTEXTS = 3
#: Bits about an entity that a term may leave unknown to be removed, or generalised.
REMOVE, GENERALISE = 1.0, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART = "array<struct<kind:int,nth:int,gap:bigint,len:bigint,ok:boolean,value:string,words:array<string>>>"


def terms_of(text: Column) -> Column:
    """Different terms of a text."""
    return F.filter(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(hit: Column, kind: str) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.try_cast("double") <= 255)
    digits = F.translate(hit, "+ ().-", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _value(hit: Column, kind: str) -> Column:
    """What two spellings of one entity share."""
    return F.translate(hit, UPPER, LOWER) if kind in ("email", "term") else F.translate(hit, "+ ()-" + ("" if kind == "ip" else "."), "")


def _near(before: Column, after: Column) -> Column:
    """Terms of what stands before and after an entity; a word that the bound cuts is left out."""
    left = F.when(F.length(before) > NEAR, F.regexp_replace(F.right(before, F.lit(NEAR)), r"^\p{L}+", "")).otherwise(before)
    right = F.when(F.length(after) > NEAR, F.regexp_replace(F.left(after, F.lit(NEAR)), r"\p{L}+$", "")).otherwise(after)
    return terms_of(F.concat_ws(" ", left, right))


def _found(text: Column, kind: str, pattern: Column | str, near: bool) -> Column:
    """Matches in turn: the gap before each, its length, whether it counts, its value and the terms near it."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.split(text, p, -1)
    hits = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), gaps, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    hits = F.zip_with(hits, F.slice(gaps, F.lit(2), F.greatest(F.lit(0), F.size(gaps))), lambda m, after: F.struct(m["hit"].alias("hit"), m["gap"].alias("gap"), after.alias("after")))
    one = lambda m, i: F.when(m["hit"].isNotNull(), F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.length(m["gap"]).cast("long").alias("gap"), F.length(m["hit"]).cast("long").alias("len"), _valid(m["hit"], kind).alias("ok"), _value(m["hit"], kind).alias("value"), (_near(m["gap"], m["after"]) if near else F.lit(None).cast("array<string>")).alias("words")))
    return F.when(F.regexp_like(text, p), F.array_compact(F.transform(hits, one))).otherwise(F.array().cast(PART))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and k, v, by which rows of equal id and text are known."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return d.select("doc_id", F.xxhash64(key, "text").alias("k"), F.xxhash64(F.lit(1), key, "text").alias("v"), "text")


def entities(d: DataFrame) -> DataFrame:
    """Written table (doc, k, v, found) of the rows of keyed() that hold matches; doc is a number of the row's own."""
    found = F.concat(*[_found(F.col("text"), kind, p, True) for kind, p in PATTERNS.items()])
    return written(d.select("k", "v", found.alias("found")).filter(F.size("found") > 0).select(F.monotonically_increasing_id().alias("doc"), "k", "v", "found"), "entities")


def disclosures(d: DataFrame, held: DataFrame, remove_at: float = REMOVE, generalise_at: float = GENERALISE, contexts: int = CONTEXTS) -> DataFrame:
    """Written table of the terms of keyed() rows that tell too much: term, kind, entity, together, seen, contexts, bits, action.

    together and seen are n(e, t) and n(t) in documents, bits what the term leaves unknown. A term has the entity of which it tells
    most (ties: most documents, then the smallest kind and value) and stands once. What can't reach the threshold by the
    documents near entities alone is left out before the corpus is counted.
    """
    p = held.select("doc", F.explode("found").alias("p")).select("doc", "p.*").filter("ok")
    p = p.select("doc", "kind", F.col("value").alias("entity"), F.xxhash64("words").alias("h"), F.explode("words").alias("term"))
    p = p.groupBy("doc", "kind", "entity", "term").agg(F.min("h").alias("h"))
    pairs = p.groupBy("kind", "entity", "term", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("kind", "entity", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("contexts"))
    near = p.select("doc", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("near"))
    bits = lambda n: F.log2(F.greatest(F.col(n), F.col("together"))) - F.log2("together")
    most = max(remove_at, generalise_at) + 1e-9
    pairs = written(pairs.filter(F.col("contexts") >= contexts).join(near, "term").filter(bits("near") <= most).drop("near"), "pairs")
    seen = d.select(F.explode(terms_of(F.col("text"))).alias("term")).join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    out = pairs.join(seen, "term").withColumn("bits", bits("seen")).filter(F.col("bits") <= most)
    best = F.min_by(F.struct("kind", "entity", "together", "seen", "contexts", "bits"), F.struct("bits", -F.col("together"), "kind", "entity"))
    out = out.groupBy("term").agg(best.alias("b")).select("term", "b.*")
    return written(out.withColumn("action", F.when(F.col("bits") <= remove_at + 1e-9, "remove").otherwise("generalise")), "disclosures")


def spans(d: DataFrame, **how) -> DataFrame:
    """(k, v, spans) of every different row of keyed() that has any, in order: array<struct<start, kind, end, action, value>>."""
    held = entities(d)
    telling = disclosures(d, held, **how).select("term", "action")
    hits = d.select("k", "v", F.explode(terms_of(F.col("text"))).alias("term")).join(telling, "term").groupBy("k", "v").agg(F.collect_set(F.struct("term", "action")).alias("telling"))
    pattern = F.concat(F.lit(r"(?i)(?<!\p{L})(?:"), F.array_join("telling.term", "|"), F.lit(r")(?!\p{L})"))
    terms = d.select("k", "v", "text").join(hits, ["k", "v"]).withColumn("pattern", pattern).select("k", "v", "telling", F.explode(_found(F.col("text"), "term", F.col("pattern"), False)).alias("p"))
    terms = terms.select("k", "v", "p.*", F.get(F.filter("telling", lambda t: t["term"] == F.col("p.value")), F.lit(0))["action"].alias("action"))
    base = held.select("k", "v", F.explode("found").alias("p")).select("k", "v", "p.*", F.lit(None).cast("string").alias("action"))
    d = base.unionByName(terms).groupBy("k", "v", "kind", "nth").agg(*[F.max(c).alias(c) for c in ("gap", "len", "ok", "value", "action")])
    run = W.partitionBy("k", "v", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    d = d.repartition("k", "v").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("start", F.col("end") - F.col("len")).filter("ok")
    covered = F.max(F.when(F.col("kind") < TERM, F.col("end"))).over(W.partitionBy("k", "v").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("kind") < TERM, F.col("start"))).over(W.partitionBy("k", "v").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("covered", covered).withColumn("ahead", ahead).filter((F.col("kind") < TERM) | ((F.coalesce("covered", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))))
    return d.groupBy("k", "v").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "action", "value"))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: doc_id, spans array<struct<start, kind, end, action, value>>, kind a number into KINDS.

    action says what a term calls for (null for base kinds). Terms that overlap a base span aren't listed beside it. A null
    or empty text has no spans, a null id stays null, equal rows give equal rows, an empty table gives none; other columns
    are not looked at.
    """
    d = keyed(docs, id_col, text_col)
    own = d.groupBy("k", "v").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).join(spans(d, **how), ["k", "v"], "left")
    block = 1 << 15
    own = own.select("doc_id", "spans", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))).alias("b"))
    own = own.select("doc_id", F.coalesce("spans", F.array().cast(own.schema["spans"].dataType)).alias("spans"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("copies") - F.col("b") * block))).alias("copy"))
    return own.drop("copy")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with texts in which base spans are [EMAIL], [IP], [CARD] or [PHONE], terms removed are [REMOVED] and generalised ones their shape.

    A shape keeps the case of the first letter and says long (over seven letters) or short: [Short], [long]. Of spans that
    overlap, the one that starts first stands for all. All columns and rows stay; null texts stay null.
    """
    k, v, found = fresh(docs, "k", "v", "spans")
    d = keyed(docs, id_col, text_col)
    own = spans(d, **how).toDF(k, v, found)
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-"))
    text = text_of(F.col(f"`{text_col}`"))
    out = docs.withColumns({k: F.xxhash64(key, text), v: F.xxhash64(F.lit(1), key, text)}).join(own, [k, v], "left")

    def put(a: Column, s: Column) -> Column:
        first = F.substring(text, s["start"].cast("int") + 1, F.lit(1))
        upper = F.upper(first) == first
        size = F.when(s["end"] - s["start"] > 7, F.when(upper, "[Long]").otherwise("[long]")).otherwise(F.when(upper, "[Short]").otherwise("[short]"))
        mark = F.when(s["action"] == "remove", "[REMOVED]").when(s["action"] == "generalise", size).otherwise(F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), s["kind"] + 1))
        gap = F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, mark)).alias("out")))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate(F.col(found), empty, put, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    out = out.withColumn(text_col, F.when(F.col(found).isNull(), F.col(f"`{text_col}`")).otherwise(new))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, all spans as text, and actions: what each term calls for."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    text = lambda which, f=one: F.array_join(F.transform(which, f), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(TERM)],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] < TERM)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        text(F.filter("spans", lambda s: s["kind"] == TERM), lambda s: F.concat(one(s), F.lit("="), s["action"])).alias("actions"),
    )
