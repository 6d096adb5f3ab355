"""Mixing sources to target weights: blocks of words, drawn per output shard, joined by permuted index.

Main path: DataFrame operations only. All arithmetic is on integers that SQL engines agree on, so the whole mix is
reproducible from the table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, partitions, text_of, written

#: Primes under 2**31; products of two values below them fit a long.
P, Q = 2147483647, 2147483629
ROUNDS = 8
#: Parts that a source's documents are ordered in, each by itself.
CHUNKS = 4096


def hash31(x: str, salt: str) -> str:
    """SQL for a value in [0, Q), Q just under 2**31, made from a non-negative long and a salt (a small long)."""
    return f"((((CAST({x} AS BIGINT) % {P}) * 1103515245 + CAST({salt} AS BIGINT) * 40503 + 12345) % {P}) * 69069 + 1812433) % {Q}"


def permuted(x: str, n: str, salt: str) -> str:
    """SQL for the place of x after a swap-or-not permutation of [0, n): each round pairs x with key - x and swaps on a keyed bit.

    Valid in Spark, whose list functions evaluate a lambda without unfolding it; oracle() has the same rounds one by one.
    """
    key = f"(({hash31('7 * r + 1', salt)}) * 2147483648 + ({hash31('7 * r + 2', salt)})) % ({n})"
    bit = f"({hash31('greatest(x, y)', f'({salt}) + 1000 * (r + 1)')}) % 1024 < 512"
    step = f"element_at(transform(array(({key} + ({n}) - x) % ({n})), y -> CASE WHEN {bit} THEN y ELSE x END), 1)"
    return f"coalesce(aggregate(sequence(0, {ROUNDS - 1}), {x}, (x, r) -> {step}), -1L)"


def swap_rounds(x: str, n: str, salt: str) -> list[tuple[str, str]]:
    """(name, SQL) steps of permuted(), for engines that name each."""
    steps, now = [], x
    for r in range(ROUNDS):
        key = f"(({hash31(str(7 * r + 1), salt)}) * 2147483648 + ({hash31(str(7 * r + 2), salt)})) % ({n})"
        steps.append((f"y{r}", f"({key} + ({n}) - {now}) % ({n})"))
        bit = f"({hash31(f'greatest({now}, y{r})', f'({salt}) + {1000 * (r + 1)}')}) % 1024 < 512"
        steps.append((f"x{r}", f"CASE WHEN {bit} THEN y{r} ELSE {now} END"))
        now = f"x{r}"
    return steps


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0) and the chunk, by id or else size, that the document's words are packed in."""
    chunk = hash31(f"abs(coalesce(doc_id, size) % {P})", "5")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    return d.withColumn("chunk", F.expr(f"({chunk}) % {CHUNKS}")).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: rank by code point (null last), weight 1, 2, 3 in turn, size and target.

    A target is the least of 3 x size and weight x level; the level is the one at which targets share all sizes, which is
    what resharing the excess by weight until none is above comes to: the first, by ratio, that its source doesn't cap. Windows here run over sources, not documents.
    """
    s = sized.groupBy("skey", "chunk").agg(F.sum("size").alias("size")).groupBy("skey").agg(F.sum("size").alias("source_size"))
    order = W.orderBy((F.col("skey") == "").cast("int"), "skey")
    s = s.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    s = s.withColumn("ratio", F.col("source_size") * 3.0 / F.col("weight"))
    up = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("source_size").over(up), F.lit(0)) * 3).withColumn("used", F.coalesce(F.sum("weight").over(up), F.lit(0)))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.col("capped")) / (F.sum("weight").over(every) - F.col("used")))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    return s.select("skey", "rank", "weight", "source_size", F.least(F.col("source_size") * 3.0, F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def pack(sized: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents at their place in their source's stream of words, and the sources with blocks and slots.

    The offset is the sum of the chunks before and of the documents before within the chunk: a hot source is spread over
    its chunks. Ties go by doc_id, then size; equal rows are interchangeable.
    """
    per = sized.groupBy("skey", "chunk").agg(F.sum("size").alias("chunk_size"))
    src = targets(sized)
    src = src.withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    src = src.withColumn("slots", F.when(F.col("blocks") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5), 3 * F.col("blocks"))).otherwise(0).cast("long"))
    before = F.sum("chunk_size").over(W.partitionBy("skey").orderBy("chunk")) - F.col("chunk_size")
    per = per.withColumn("chunk_at", before).join(src, "skey")
    docs = sized.join(per, ["skey", "chunk"])
    w = W.partitionBy("skey", "chunk").orderBy(F.col("doc_id").asc_nulls_last(), "size")
    docs = docs.withColumn("nth", F.row_number().over(w)).withColumn("at", F.col("chunk_at") + F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return docs, src


def draw(src: DataFrame, shard_slots: int, step: int = 1 << 14) -> DataFrame:
    """Every slot of the mix: skey, shard, slot, and the block that fills it.

    Tickets of all sources are dealt to shards by one permutation of all of them, so a shard's source counts are a
    multinomial draw given each source's total (targets are met, and no source is drawn beyond three epochs). The nth slot
    of a source takes block permutation(n mod blocks), with another permutation for each source and epoch. Runs of step slots
    are dealt to all tasks.
    """
    s = src.withColumn("first", F.coalesce(F.sum("slots").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("all_slots", F.sum("slots").over(W.partitionBy())).filter("slots > 0")
    s = s.select("skey", "rank", "blocks", "slots", "first", "all_slots", F.explode(F.expr(f"sequence(0L, slots - 1, {step}L)")).alias("lo"))
    s = s.repartition(partitions(src.sparkSession), "skey", "lo")
    s = s.select("skey", "rank", "blocks", "first", "all_slots", F.explode(F.expr(f"sequence(lo, least(lo + {step}L, slots) - 1)")).alias("nth"))
    s = s.withColumn("salt", F.expr("(rank * 4 + nth div blocks) * 16")).withColumn("turn", F.expr("nth % blocks"))
    s = s.select("skey", "all_slots", F.expr(permuted("turn", "blocks", "salt")).alias("block"), (F.col("first") + F.col("nth")).alias("turn"))
    s = s.withColumn("place", F.expr(permuted("turn", "all_slots", "3")))
    return s.select("skey", "block", F.expr(f"place div {shard_slots}").alias("shard"), F.expr(f"place % {shard_slots}").alias("slot"))


def pieces(docs: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document has words in (one with a null block for an empty document)."""
    blocks = F.when(F.col("size") > 0, F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})"))
    out = docs.withColumn("block", F.explode_outer(blocks))
    lo = F.greatest(F.col("at"), F.col("block") * block_words)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    return out.withColumn("first_word", lo - F.col("at")).withColumn("words", hi - lo)


def mix(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, **cols: str) -> DataFrame:
    """The mix itself: shard, slot, source, block, doc_id, first_word, words; a document's words at that place of the output.

    Nulls: a null source is a source of its own, null texts have no words, null ids stay null. Empty tables give no rows;
    other columns are not looked at. Words are never cut: a block holds the words between two multiples of block_words.
    """
    packed, src = pack(written(sizes(docs, **cols), "sizes"), block_words)
    where = pieces(packed, block_words).filter("block is not null").select("skey", "block", "source", "doc_id", "first_word", "words")
    return draw(src, shard_slots).join(where.hint("merge"), ["skey", "block"]).select("shard", "slot", "source", "block", "doc_id", "first_word", "words")


def mixed_sizes(docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, **cols: str) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, and how many words the mix takes of it (repeats counted), summed over its shards."""
    packed, src = pack(written(sizes(docs, **cols), "sizes"), block_words)
    times = draw(src, shard_slots).groupBy("shard", "skey", "block").agg(F.count(F.lit(1)).alias("times"))
    of = pieces(packed, block_words).join(times.hint("merge"), ["skey", "block"], "left")
    keys = ["skey", "chunk", "nth", "doc_id", "source", "size", "source_size", "target"]
    return of.groupBy(*keys).agg(F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")


def oracle(from_table: str = "documents", block_words: int = 64) -> str:
    """DuckDB SQL for mixed_sizes."""
    size = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
    chunk = f"({hash31(f'abs(coalesce(doc_id, {size}) % {P})', '5')}) % {CHUNKS}"
    inner = "SELECT skey, blocks, (rank * 4 + nth // blocks) * 16 AS salt, nth % blocks AS turn FROM slots"
    for k, (name, sql) in enumerate(swap_rounds("turn", "blocks", "salt")):
        inner = f"SELECT *, {sql} AS {name} FROM ({inner}) AS q{k}"
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce('s' || source, '') AS skey, {size} AS size, {chunk} AS chunk FROM {from_table}),
s0 AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
s1 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN skey = '' THEN 1 ELSE 0 END, skey) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM s1),
s3 AS (SELECT *, source_size * 3.0::DOUBLE / weight AS ratio FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lev FROM s3
  WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, least(source_size * 3.0::DOUBLE, weight * coalesce((SELECT lev FROM s4 AS f WHERE f.lev <= f.ratio ORDER BY f.ratio, f.rank LIMIT 1), 0)) AS target, (source_size + {block_words - 1}) // {block_words} AS blocks FROM s4),
src AS (SELECT *, CASE WHEN blocks > 0 THEN least(CAST(floor(target * blocks / source_size + 0.5) AS BIGINT), 3 * blocks) ELSE 0 END AS n_slots FROM s5),
slots AS (SELECT skey, rank, blocks, unnest(range(n_slots)) AS nth FROM src),
times AS (SELECT skey, x{ROUNDS - 1} AS block, count(*) AS times FROM ({inner}) AS p GROUP BY ALL),
at1 AS (SELECT *, CAST(sum(size) OVER (PARTITION BY skey ORDER BY chunk, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS w_at,
  row_number() OVER () AS rid FROM sized),
pieces AS (SELECT rid, skey, w_at, size, unnest(range(w_at // {block_words}, (w_at + size - 1) // {block_words} + 1)) AS block FROM at1 WHERE size > 0),
taken AS (SELECT rid, sum((least(w_at + size, (block + 1) * {block_words}) - greatest(w_at, block * {block_words})) * times) AS taken FROM pieces JOIN times USING (skey, block) GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM at1 JOIN src USING (skey) LEFT JOIN taken USING (rid)"""

