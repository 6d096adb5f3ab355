"""Entry filters, observation filters and the join of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from angula.functions.columns import finite
from angula.spec import CLEANLINESS, DUPLEX, RESOLUTION, EntryFilter, FamilySpec, ObsFilter, chosen


def cleanliness(name: str) -> Column:
    return F.col(CLEANLINESS[name]) if name in CLEANLINESS else F.lit(True)


def duplex_gate(name: str) -> Column:
    return F.col(DUPLEX[name]) if name in DUPLEX else F.lit(True)


def resolution_tier(name: str) -> Column:
    if name not in RESOLUTION:
        return F.lit(True)
    most = RESOLUTION[name]
    return F.col("resolution_known") if most is None else F.col("resolution_known") & (F.col("resolution") <= most)


def entry_condition(f: EntryFilter) -> Column:
    if f.preset is not None:
        return F.col("entry_id").isin(list(f.preset))
    out = cleanliness(f.cleanliness) & duplex_gate(f.duplex) & resolution_tier(f.resolution)
    if f.methods is not None:
        out &= F.col("method").isin(list(f.methods))
    if f.forms is not None:
        out &= F.col("form").isin(list(f.forms))
    return out


def allowed_entries(entries: DataFrame, f: EntryFilter) -> DataFrame:
    return entries.filter(entry_condition(f))


def terminal_policy(policy: str) -> Column:
    return F.col("edge_flag") != 1 if policy == "exclude" else F.lit(True)


def context_in(column: str, ids: list[str], empty: str) -> Column:
    """An empty context stands for the family's empty value; if that is empty as well, the row goes."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(empty)).isin([i for i in ids if i != ""])


def obs_condition(spec: FamilySpec, o: ObsFilter, refill: bool = False) -> Column:
    """The filters on rows of a family; refill: choices without a valid id are the family's defaults (see chosen)."""
    out = terminal_policy(o.terminal)
    if spec.context:
        out &= context_in(spec.context, chosen(o.contexts, spec.context_options, spec.context_default, refill), spec.context_empty)
    if spec.secondary:
        out &= context_in(spec.secondary, chosen(o.secondary, spec.secondary_options, spec.secondary_default, refill), spec.secondary_empty)
    return out


def finite_values(family: DataFrame, *params: str) -> DataFrame:
    """family with NaN and infinities of the parameters as nulls, which no operator counts."""
    real = {f.name for f in family.schema.fields if f.dataType.typeName() in ("double", "float")}
    return family.withColumns({p: finite(F.col(p)) for p in params if p in real})


def observations(allowed: DataFrame, family: DataFrame, spec: FamilySpec, o: ObsFilter) -> DataFrame:
    """Filtered observations of allowed entries, with the entry's form; values that are not finite are null. Spark broadcasts the entries if they are small."""
    return finite_values(family, *[p.param_id for p in spec.params]).filter(obs_condition(spec, o)).join(allowed.select("pid", "form"), "pid")
