"""Entry tables, universe counts and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from angula.functions.columns import cleanliness_label, finite, fixed_digits, form_label, resolution_label
from angula.operators.filters import allowed_entries, finite_values, obs_condition
from angula.operators.order import PAGE, Ordered, in_order
from angula.spec import FORMS, EntryFilter, FamilySpec, ObsFilter


def universe_counts(entries: DataFrame, families: dict[str, DataFrame] | None = None) -> DataFrame:
    """(kind, id, n): entries in all, by form, by method and by cleanliness, in one pass; and the rows of each family."""
    flags = [F.struct(F.lit("cleanliness").alias("kind"), F.lit(k).alias("id"), F.col(c).alias("is")) for k, c in (("conservative", "passes_conservative"), ("relaxed", "passes_relaxed"), ("mw100", "passes_mw100"))]
    own = [F.struct(F.lit(k).alias("kind"), c.alias("id"), F.lit(True).alias("is")) for k, c in (("all", F.lit("entries")), ("form", F.col("form")), ("method", F.col("method")))]
    out = entries.select(F.explode(F.array(*own, *flags)).alias("v")).select("v.*").filter("is").groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))
    for name, df in (families or {}).items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("family").alias("kind"), F.lit(name).alias("id"), "n"))
    return out


def rows_per_entry(entries: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """pid and the number of observations of each family."""
    out = entries.select("pid")
    for name, df in families.items():
        out = out.join(df.groupBy("pid").agg(F.count(F.lit(1)).alias(f"{name}_rows")), "pid", "left")
    return out.select("pid", *[F.coalesce(f"{n}_rows", F.lit(0)).alias(f"{n}_rows") for n in families])


def sorted_entries(entries: DataFrame) -> DataFrame:
    """By id in locale order, then pid."""
    return entries.orderBy(F.collate("entry_id", "UNICODE"), "pid")


def ordered_entries(entries: DataFrame) -> Ordered:
    """sorted_entries() with row numbers and pages by number: the sort is paid once, not for every page."""
    return in_order(entries, F.collate("entry_id", "UNICODE"), "pid")


def entry_page(entries: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    """A page of the sorted entries; an index past the end gives the last page. For several pages take ordered_entries()."""
    last = max(0, -(-entries.count() // size) - 1)
    return sorted_entries(entries).offset(min(max(page, 0), last) * size).limit(size)


def entry_table(entries: DataFrame, even: bool = False) -> DataFrame:
    """even: how fixed_digits() rounds ties of the resolution."""
    extra = [c for c in ("het_names", "residue_count") if c in entries.columns]
    return entries.select("pid", F.upper("entry_id").alias("entry"), form_label(F.col("form")).alias("form_label"), "method", resolution_label(even).alias("resolution_label"), cleanliness_label().alias("cleanliness"), *extra)


def _export(entries: DataFrame, family: DataFrame, spec: FamilySpec, param: str, f: EntryFilter, o: ObsFilter, even: bool) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, the columns to export, the columns that order them)"""
    extra = [c for c in ("het_names", "residue_count") if c in entries.columns]
    forms = [x for x in dict.fromkeys(f.forms or ()) if x in FORMS] or list(FORMS)
    allowed = allowed_entries(entries, f).filter(F.col("form").isin(forms))
    meta = allowed.select("pid", "form", "entry_id", "method", "resolution", "resolution_known", cleanliness_label().alias("cleanliness"), *extra)
    seen = finite_values(family, param).filter(obs_condition(spec, o)).filter(F.col(f"`{param}`").isNotNull())
    obs = seen.join(meta, "pid")
    text = lambda c, empty: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(empty)) if c else F.lit("")
    res = F.when(F.col("resolution_known") & finite(F.col("resolution")).isNotNull(), fixed_digits(F.col("resolution"), 2, even)).otherwise("")
    shown = [
        fixed_digits(F.col(f"`{param}`"), 6, even).alias(param), F.upper("entry_id").alias("pdb_id"), (F.coalesce(F.col(spec.site), F.lit("")) if spec.site else F.lit("")).alias("site_label"), form_label(F.col("form")).alias("form_nakb"), "method", res.alias("resolution_angstrom"), "cleanliness",
        *extra, text(spec.context, spec.context_empty).alias("sequence_context"), text(spec.secondary, spec.secondary_empty).alias("backbone_state"), F.col("edge_flag").alias("terminal_flag"),
    ]
    keys = [F.array_position(F.array(*[F.lit(x) for x in forms]), F.col("form")), F.col("pid"), *[F.col(c) for c in spec.order]]
    order = [f"_{i}" for i in range(len(keys))]
    out = obs.select(*shown, *[k.alias(n) for k, n in zip(keys, order)])
    return out, [c for c in out.columns if c not in order], order


def export_observations(entries: DataFrame, family: DataFrame, spec: FamilySpec, param: str, f: EntryFilter, o: ObsFilter, even: bool = False) -> DataFrame:
    """One row for each plotted observation, with its entry's properties; numbers as text of a fixed form; in no order.

    The value's column has the parameter's name. even: how fixed_digits() rounds ties.
    """
    out, shown, _ = _export(entries, family, spec, param, f, o, even)
    return out.select(*[F.col(f"`{c}`") for c in shown])


def ordered_export(entries: DataFrame, family: DataFrame, spec: FamilySpec, param: str, f: EntryFilter, o: ObsFilter, even: bool = False) -> Ordered:
    """export_observations() in order of the chosen forms, of the entries' pids, and of the rows in each entry."""
    out, shown, order = _export(entries, family, spec, param, f, o, even)
    return in_order(out, *order, keep=shown)
