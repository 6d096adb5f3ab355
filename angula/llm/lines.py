"""Line dedup by a log-template tree of fixed depth: token count, then leading tokens, then places that tell templates apart.

Main path: DataFrame operations only. Words with a digit are variable fields. A leaf holds the lines of one token count and
the same leading words; lines whose leading words lead to no such leaf go to those with a wildcard for one of them. In a leaf
with enough different lines, words in places where no word prevails become fields, too. A leaf may hold several templates: it is
split at the place with the fewest words, a line following its own word there, and split again.

A template recurs if it stands in enough different documents, where copies and near copies of a document count once; lines of
a document that was copied are for document dedup to find. How often a line stands within a document doesn't matter. Near
copies share most of a sketch, the smallest hashes of three words in a row, and have no line of their own: pages that share
much but say something else each are different documents. Lines of recurring templates go wherever they stand.

Texts and templates are known by two 64-bit hashes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, remove, text_of, written

#: Shorter lines recur in ordinary prose.
MIN_TOKENS = 4
#: Documents, near copies counted once, in which a template must recur.
MIN_DOCUMENTS = 5
#: Leading words on the tree's path.
DEPTH = 3
#: Share of a leaf's lines in which a word must stand at a place to be part of the template, and share of such places.
PREVAIL, CONSTANT = 0.5, 0.6
#: How often leaves are split.
SPLITS = 2
#: A line is a text's own if less than this share of its runs of three words stands elsewhere in its class of near copies.
OWN = 0.2
#: Hashes in a document's sketch, those of them that near copies are looked for by, and the share that near copies have in common.
SKETCH, PROBES, NEAR = 32, 8, 0.6
#: One in so many runs of words may be in a sketch.
STRIDE = 4
#: Runs of three words of a line that are compared, about.
RUNS = 16
#: Keys (16 bytes each) that are broadcast at most, so that lines without them are not shuffled.
BROADCAST_KEYS = 1_000_000
BLANK = " \t\r\x0b\x0c"
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
TEXT, TEMPLATE, PATTERN = ["k", "v"], ["t", "u"], ["p", "q"]


def hashes(names: list[str], *of: str | Column) -> list[Column]:
    return [F.xxhash64(*of).alias(names[0]), F.xxhash64(F.lit(1), *of).alias(names[1])]


def parts_by(text: str | Column, mark: str) -> Column:
    """How many parts split() by a mark of one byte gives, without making them."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit(""))) + 1


def lines_of(docs: DataFrame, text_col: str, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """A row for each line of min_tokens words or more: k, v (the text), nth, t, u (the template), leaf, tokens, line (masked).

    Words are parted by white space, however much of it.
    """
    d = docs.select(text_of(text_col).alias("text")).select(*hashes(TEXT, "text"), F.split("text", "\n", -1).alias("rows"))
    d = d.select(*TEXT, F.posexplode("rows").alias("nth", "line"))
    # Generating one row keeps a filter and what comes next behind the columns, so that they are worked out once.
    then = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))
    d = d.select(*TEXT, "nth", then(F.trim("line"), "line")).filter(F.col("line") != "")
    wide = F.contains("line", F.lit("  "))
    narrow = F.when(wide | F.col("line").rlike(f"[{BLANK[1:]}]"), F.regexp_replace("line", f"[{BLANK}]+", " ")).otherwise(F.col("line"))
    masked = F.trim(F.regexp_replace(narrow, FIELD, "<*>"))
    d = d.select(*TEXT, "nth", then(F.when(wide | F.col("line").rlike(f"[0-9{BLANK[1:]}]"), masked).otherwise(F.col("line")), "line"))
    d = d.select(*TEXT, "nth", "line", then(parts_by("line", " "), "tokens")).filter((F.col("tokens") >= min_tokens) & (F.col("line") != ""))
    return d.select(*TEXT, "nth", *hashes(TEMPLATE, "line"), F.xxhash64("tokens", F.substring_index("line", " ", depth)).alias("leaf"), "tokens", "line")


def sketches_of(docs: DataFrame, text_col: str) -> DataFrame:
    """k, sketch: the smallest hashes of three words in a row, of those runs whose first word's hash is a multiple of STRIDE."""
    d = docs.select(text_of(text_col).alias("text")).select(F.xxhash64("text").alias("k"), F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1).alias("w"))
    runs = F.transform("w", lambda x, i: F.when(F.xxhash64(x) % STRIDE == 0, F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    return d.select("k", F.slice(F.sort_array(F.array_compact(F.array_distinct(runs))), 1, SKETCH).alias("sketch"))


def near_copies(sketches: DataFrame) -> DataFrame:
    """k, class: texts that have near copies, and one number for all that links of near copies reach.

    Texts with one of the smallest hashes in common are held against the first of them, so that links grow with the texts.
    """
    probes = sketches.select("k", F.explode(F.slice("sketch", 1, PROBES)).alias("hash"))
    first = probes.groupBy("hash").agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "head")
    pairs = probes.join(first, "hash").filter("k <> head").select("k", "head").distinct()
    pairs = pairs.join(sketches, "k").join(sketches.select(F.col("k").alias("head"), F.col("sketch").alias("other")), "head")
    alike = F.size(F.array_intersect("sketch", "other")) >= NEAR * F.greatest(F.size("sketch"), F.size("other"))
    return components(pairs.filter(alike).select(F.col("k").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("k"), F.col("label").alias("class"))


def few(df: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it has BROADCAST_KEYS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def text_of_templates(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """t, u, line of the templates of a written table."""
    return lines.select(*TEMPLATE, "line").join(few(wanted), TEMPLATE, "left_semi").groupBy(*TEMPLATE).agg(F.first("line").alias("line"))


def with_own_lines(lines: DataFrame, held: DataFrame, classes: DataFrame) -> DataFrame:
    """k of the texts in classes of near copies that have a line of their own: no other has it, nor most of its runs of words.

    held: t, u, k of all texts. A line that an edit made different shares the rest of its runs with the others' version of it.
    Of long lines the runs whose hash is a multiple of a power of two stand for all, so that some RUNS of them are compared.
    """
    classes = written(classes, "classes")
    mine = written(held.join(few(classes), "k").groupBy("class", *TEMPLATE).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")), "mine")
    kinds = written(mine.select(*TEMPLATE).distinct(), "kinds")
    step = F.expr(f"shiftleft(1, CAST(floor(log2(greatest(1, size(w) div {RUNS}))) AS INT))")
    runs = "filter(transform(sequence(0, greatest(0, size(w) - 3)), i -> xxhash64(w[i], get(w, i + 1), get(w, i + 2))), h -> pmod(h, step) = 0)"
    # Generating one row keeps the words behind it, so that they are split once.
    each = text_of_templates(lines, kinds).select(*TEMPLATE, F.inline(F.array(F.struct(F.split("line", " ", -1).alias("w"))))).withColumn("step", step)
    each = each.select(*TEMPLATE, F.array_distinct(F.expr(runs)).alias("runs"))
    id_ = F.xxhash64("class", *TEMPLATE)
    each = written(mine.join(each, TEMPLATE).select(F.when(F.col("n") == 1, id_).alias("id"), "n", "class", F.explode("runs").alias("run")).select("id", "n", F.xxhash64("class", "run").alias("run")), "runs")
    shared = each.groupBy("run").agg(F.sum("n").alias("all")).filter(F.col("all") > 1)
    lone = each.filter("id is not null").join(shared, "run", "left").groupBy("id").agg(F.count(F.lit(1)).alias("runs"), F.count("all").alias("shared"))
    lone = lone.filter(F.col("shared") < OWN * F.col("runs")).select("id")
    out = written(mine.filter("n = 1").select(id_.alias("id"), "k").join(lone, "id").select("k").distinct(), "own")
    remove(lines.sparkSession, classes, mine, kinds, each)
    return out


def leaf_lines(lines: DataFrame, min_documents: int, depth: int = DEPTH) -> DataFrame:
    """Written table leaf, t, u, kinds: different lines of the leaves with kinds of them, min_documents or more.

    A line whose own leaf is smaller is in those with a wildcard among its leading words, of which there is one more, so
    that as many are given.
    """
    head = F.split("line", " ", depth + 2)
    wild = [F.xxhash64("tokens", *[F.lit("<?>") if i == j else F.get(head, i) for i in range(depth + 1)]).alias(f"w{j}") for j in range(depth)]
    names = ["leaf", *[f"w{j}" for j in range(depth)]]
    kinds = written(lines.select(*TEMPLATE, "leaf", *wild).groupBy(*TEMPLATE).agg(*[F.min(c).alias(c) for c in names]), "templates")
    large = lambda df: df.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") >= min_documents)
    own = written(large(kinds), "leaves")
    plain = written(kinds.select(*TEMPLATE, "leaf").join(few(own), "leaf"), "plain")
    rest = kinds.join(few(plain).select(*TEMPLATE), TEMPLATE, "left_anti").select(*TEMPLATE, F.explode(F.array(*names[1:])).alias("leaf"))
    others = written(large(rest), "leaves")
    out = written(plain.unionByName(rest.join(few(others), "leaf")), "members")
    remove(lines.sparkSession, kinds, own, plain, others)
    return out


def generalised(lines: DataFrame, min_documents: int, prevail: float, constant: float, splits: int = SPLITS) -> DataFrame:
    """Written table t, u, p, q: lines of the larger leaves, and their templates after words that do not prevail in their leaf became fields.

    A line has one for its leaf, and one for each part of it that it follows when the leaf is split at the place with the
    fewest different words, the first of those, into parts of min_documents lines or more.
    """
    own = leaf_lines(lines, min_documents)
    kinds = written(own.select(*TEMPLATE).distinct(), "kinds")
    full = text_of_templates(lines, kinds).withColumn("words", F.split("line", " ", -1))
    full = own.join(full, TEMPLATE).select("leaf", *TEMPLATE, "kinds", F.size("words").alias("tokens"), F.posexplode("words").alias("at", "word"))
    words, out, used = written(full, "words"), None, [own, kinds]
    for level in range(splits + 1):
        counts = written(words.groupBy("leaf", "kinds", "at", "word").agg(F.count(F.lit(1)).alias("n")), "shares")
        used += [words, counts]
        kept = words.join(counts.filter(F.col("n") >= F.col("kinds") * prevail).select("leaf", "at", "word"), ["leaf", "at", "word"], "left_semi")
        kept = kept.groupBy("leaf", *TEMPLATE, "tokens").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        kept = kept.filter(F.size("words") >= F.col("tokens") * constant).select(*TEMPLATE, *hashes(PATTERN, "leaf", F.col("words").cast("string")))
        out = kept if out is None else out.unionByName(kept)
        if level < splits:
            place = counts.groupBy("leaf", "at").agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("top")).filter((F.col("d") > 1) & (F.col("top") >= min_documents))
            place = place.groupBy("leaf").agg(F.min(F.struct("d", "at"))["at"].alias("at"))
            part = counts.filter(F.col("n") >= min_documents).join(place, ["leaf", "at"]).select("leaf", "at", "word", F.xxhash64("leaf", "at", "word").alias("part"), F.col("n").alias("size"))
            follows = words.join(part, ["leaf", "at", "word"]).select("leaf", *TEMPLATE, "part", "size")
            words = written(words.join(follows, ["leaf", *TEMPLATE]).select(F.col("part").alias("leaf"), *TEMPLATE, F.col("size").alias("kinds"), "tokens", "at", "word"), "words")
    out = written(out.distinct(), "general")
    remove(lines.sparkSession, *used)
    return out


def recurring(lines: DataFrame, sketches: DataFrame, min_documents: int = MIN_DOCUMENTS, prevail: float = PREVAIL, constant: float = CONSTANT) -> DataFrame:
    """t, u of the templates of lines_of() that recur; sketches are sketches_of() of the same documents.

    A template is counted by itself and by its generalised forms. Classes of near copies are only looked for among texts
    that hold what stands in enough different texts; texts with lines of their own count by themselves.
    """
    spark = lines.sparkSession
    held = written(lines.select(*TEMPLATE, "k").distinct(), "held")
    often = lambda by, of: by.groupBy(*PATTERN).agg(F.count_distinct(of).alias("n")).filter(F.col("n") >= min_documents).select(*PATTERN)
    plain = often(held.toDF(*PATTERN, "k"), "k")
    general = generalised(lines, min_documents, prevail, constant)
    wide = general.join(often(held.join(general, TEMPLATE), "k"), PATTERN, "left_semi")
    members = written(plain.select(*PATTERN, *[F.col(p).alias(t) for p, t in zip(PATTERN, TEMPLATE)]).union(wide.select(*PATTERN, *TEMPLATE)), "members")
    within = written(held.join(members, TEMPLATE).select(*PATTERN, "k").distinct(), "within")
    texts = written(sketches.join(within.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"]), "sketches")
    near = near_copies(texts)
    own = with_own_lines(lines, held, near)
    near = near.join(own, "k", "left_anti")
    classes = within.join(near, "k", "left").select(*PATTERN, F.coalesce("class", "k").alias("class"))
    out = written(members.join(often(classes, "class"), PATTERN, "left_semi").select(*TEMPLATE).distinct(), "recurring")
    remove(spark, held, general, members, within, texts, own)
    return out


def dedup(docs: DataFrame, text_col: str = "text", min_tokens: int = MIN_TOKENS, min_documents: int = MIN_DOCUMENTS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the recurring lines cut from the text, and n_lines, n_dropped.

    Each row of docs stays, with all its columns (n_lines and n_dropped replace columns of those names; other names can be
    given). A null text stays null and has no lines; blank lines stay; equal rows and rows with a null id are treated
    alike; an empty table gives none. The cuts are joined to the texts by a shuffle at every size.
    """
    found = written(lines_of(docs, text_col, DEPTH, min_tokens), "lines")
    out = recurring(found, sketches_of(docs, text_col), min_documents)
    k, v, drop = fresh(docs, "k", "v", "drop")
    cuts = written(found.select(*TEXT, "nth", *TEMPLATE).join(out, TEMPLATE, "left_semi").groupBy(*TEXT).agg(F.collect_set("nth").alias("nths")).toDF(k, v, drop), "cuts")
    remove(docs.sparkSession, found, out)
    text = text_of(text_col)
    d = docs.withColumns(dict(zip((k, v), hashes(TEXT, text)))).join(cuts.hint("shuffle_hash"), [k, v], "left").drop(k, v)
    rows = F.split(text, "\n", -1)
    cut = F.array_join(F.filter(rows, lambda x, i: ~F.array_contains(drop, i)), "\n")
    d = d.withColumns({n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(rows)).cast("long"), n_dropped: F.coalesce(F.size(drop), F.lit(0)).cast("long")})
    return d.withColumn(text_col, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(cut)).drop(drop)
