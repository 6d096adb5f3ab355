"""Reading the manifest, entries and family tables; writing exports and family tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from angula.functions.columns import finite

# Entry columns by kind, with what stands for an empty text.
TEXT = {"pdb_id": None, "form": "other", "local_form": "other", "compare_local_vs_nakb": "", "exp_method_group": "other", "het_names": "-"}
REAL = ("resolution", "paired_residue_fraction")
FLAGS = ("resolution_known", "passes_clean_conservative", "passes_clean_relaxed", "passes_no_large_het_mw100", "has_any_het", "has_duplex_core", "all_residues_paired")
WHOLE = ("pid", "residue_count", "backbone_rows", "sugar_rows", "pucker_rows", "base_pair_rows", "step_rows", "helical_rows", "paired_nt_count")
RENAMED = {"pdb_id": "entry_id", "exp_method_group": "method", "passes_clean_conservative": "passes_conservative", "passes_clean_relaxed": "passes_relaxed", "passes_no_large_het_mw100": "passes_mw100"}


def parse_number(c: Column) -> Column:
    """The number that a text begins with; null for none and for what is not finite."""
    return finite(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"))


def parse_int(c: Column, fallback: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(fallback))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's one row. A missing path is an error."""
    return spark.read.option("multiLine", True).json(path)


def parameter_dim(manifest: DataFrame) -> DataFrame:
    p = manifest.select(F.explode("parameter_registry").alias("p")).select("p.*")
    has = lambda c, kind: F.col(c).cast(kind) if c in p.columns else F.lit(None).cast(kind)
    return p.select("param_id", has("display_name", "string").alias("display_name"), has("unit", "string").alias("unit"), F.coalesce(F.col("value_type") == "numeric_circular", F.lit(False)).alias("is_circular"), has("period", "double").alias("period"), has("display_range_default", "array<double>").alias("range_default"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table, plain or .gz, all columns text, taken by name from the header; blank lines are skipped."""
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False, enforceSchema=False)


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    """Typed entries; an absent column has its default."""
    t = read_tsv(spark, path)
    c = lambda name: F.col(f"`{name}`") if name in t.columns else F.lit(None).cast("string")
    out = [F.coalesce(F.nullif(F.trim(c(n)), F.lit("")), F.lit(d)).alias(RENAMED.get(n, n)) for n, d in TEXT.items()]
    out += [parse_number(c(n)).alias(n) for n in REAL] + [(parse_int(c(n)) == 1).alias(RENAMED.get(n, n)) for n in FLAGS] + [parse_int(c(n)).alias(n) for n in WHOLE]
    return t.select(*out)


def with_row_index(t: DataFrame) -> DataFrame:
    """t, read from files, with row_index: each row's place from 0 in order of the files' full paths and of the lines in them.

    Rows are counted by file and split, and a split's rows begin where the counts before it end. The sums run over one row for each
    split of the input, in one task; nothing is packed, so no count can overflow.
    """
    mine = t.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = mine.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    up = W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("_path", "_block", (F.coalesce(F.sum("_rows").over(up), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = mine.join(starts, ["_path", "_block"])
    return out.select(*[F.col(f"`{c}`") for c in t.columns], (F.col("_id") + F.col("_shift")).alias("row_index"))


def load_family(spark: SparkSession, path: str, params: list[str], context: str | None = None, secondary: str | None = None) -> DataFrame:
    """Typed observations with a long row_index: the file's own, else the order of the files and lines.

    A context or parameter that is named but isn't in the file is empty in every row; a site label is there if the file has it.
    """
    t = read_tsv(spark, path)
    has = set(t.columns)
    edge = next((e for e in ("edge_flag", "is_terminal_any") if e in has), None)
    t = t.withColumn("row_index", F.col("row_index").cast("long")) if "row_index" in has else with_row_index(t)
    out = [parse_int(F.col("pid")).alias("pid"), (parse_int(F.col(edge)) if edge else F.lit(0)).alias("edge_flag")]
    out += [F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) if n in has else F.lit("").alias(n) for n in ("site_label", context, secondary) if n and (n in has or n != "site_label")]
    out += [(parse_number(F.col(f"`{p}`")) if p in has else F.lit(None)).cast("float").alias(p) for p in params]
    return t.select(*out, "row_index")


class Families:
    """One lazy table for each family, read at its first use."""

    def __init__(self, load):
        self._load, self._held = load, {}

    def __getitem__(self, family_id: str) -> DataFrame:
        if family_id not in self._held:
            self._held[family_id] = self._load(family_id)
        return self._held[family_id]


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; cells with a quote, comma or newline in quotes, quotes doubled."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def export_name(param: str, stamp: str) -> str:
    """Directory name of an export."""
    import re

    return f"{re.sub(r'[^a-z0-9]+', '_', param.lower()).strip('_') or 'export'}_{stamp}"


def counted_write(df: DataFrame, write) -> int:
    """The rows that write(df) writes, counted as they pass."""
    rows = Observation()
    write(df.observe(rows, F.count(F.lit(1)).alias("row_count")))
    return rows.get["row_count"]


def _ranged(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionByRange(parts, "pid").sortWithinPartitions("pid", "row_index")


def write_family(df: DataFrame, path: str, parts: int) -> int:
    """A family's .tsv.gz files in order of pid; gives the row count for the manifest, counted while writing."""
    return counted_write(_ranged(df, parts), lambda d: d.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path))


def write_family_parquet(df: DataFrame, path: str, parts: int) -> int:
    """The same as Parquet."""
    return counted_write(_ranged(df, parts), lambda d: d.write.parquet(path))


def row_counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """family_id, row_count: what write_family() gave, as the manifest records it."""
    return spark.createDataFrame(sorted(counts.items()), "family_id string, row_count long")
