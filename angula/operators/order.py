"""A table in a global order: row numbers without one task, and pages that read what they show."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from angula.sources.shared import new_folder

PAGE = 100


class Ordered:
    """Range partitions of a table, written once, each in order; the driver knows how many rows each has.

    A row's number is what the partitions before its own hold plus its place there. A page reads the one or two partitions that it
    lies in.
    """

    def __init__(self, table: DataFrame, sizes: list[int], columns: list[str]):
        self.table, self.sizes, self.columns = table, sizes, columns
        self.starts = [0, *accumulate(sizes)]

    def __len__(self) -> int:
        return self.starts[-1]

    def rows(self, name: str = "row") -> DataFrame:
        """All rows with their number, from 0."""
        before = self.table.sparkSession.createDataFrame(list(enumerate(self.starts[:-1])) or [(0, 0)], "part int, before long")
        d = self.table.join(F.broadcast(before), "part")  # a row for each partition
        return d.select((F.col("before") + F.col("nth")).alias(name), *[F.col(f"`{c}`") for c in self.columns])

    def between(self, lo: int, hi: int) -> DataFrame:
        """Rows lo to hi - 1, in order."""
        lo, hi = max(0, lo), min(hi, len(self))
        parts = range(bisect_right(self.starts, lo) - 1, len(self.sizes)) if lo < hi else []
        one = lambda p: (F.col("part") == p) & (F.col("nth") >= lo - self.starts[p]) & (F.col("nth") < hi - self.starts[p])
        inside = reduce(or_, [one(p) for p in parts if self.starts[p] < hi], F.lit(False))
        return self.table.filter(inside).orderBy("part", "nth").select(*[F.col(f"`{c}`") for c in self.columns])

    def page(self, index: int, size: int = PAGE) -> DataFrame:
        """A page in order; an index past the end gives the last one, of an empty table an empty one."""
        last = max(0, -(-len(self) // size) - 1)
        at = min(max(index, 0), last)
        return self.between(at * size, (at + 1) * size)


def in_order(df: DataFrame, *order: str | Column, parts: int | None = None, keep: list[str] | None = None) -> Ordered:
    """df ordered by columns; keep: the columns to give back (all). Rows that tie in all of them have any order, the same ever after.

    parts: range partitions; None takes the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    d = d.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth"))
    path = new_folder(spark, "ordered")
    d.write.partitionBy("part").parquet(path)
    table = spark.read.schema(d.schema).parquet(path)
    sizes = dict(table.groupBy("part").count().collect()) if not spark.read.schema(d.schema).parquet(path).isEmpty() else {}
    return Ordered(table, [sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)], keep or df.columns)
