"""Distributions of one parameter by form, their summaries, the overview of a family, and counts."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from angula.functions.columns import bin_of, circular_bin, finite, wrap
from angula.operators.accumulate import accumulate, distinct_entries, finished, frame, series, summaries
from angula.operators.filters import allowed_entries, observations
from angula.operators.histogram import counts, effective_range, with_row
from angula.spec import EntryFilter, FamilySpec, ObsFilter, ParameterSpec, View, selected_forms


def linear_moments(obs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean and population standard deviation."""
    v = finite(F.col(value).cast("double"))
    m = obs.filter(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.avg(v * v).alias("square"))
    return m.select(*by, "n", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("std"))


def circular_moments(obs: DataFrame, value: str, by: list[str], period: float = 360.0) -> DataFrame:
    """n, mean angle, resultant and circular standard deviation (null for a resultant of 0)."""
    a = wrap(F.col(value).cast("double"), period) * (2 * math.pi / period)
    m = obs.filter(finite(F.col(value)).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"))
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.hypot("c", "s") / F.col("n")))
    m = m.withColumn("resultant", r)
    std = F.when(F.col("resultant") > 0, F.sqrt(F.greatest(F.lit(0.0), -2 * F.log("resultant"))) * (period / (2 * math.pi)))
    return m.select(*by, "n", wrap(F.atan2("s", "c") * (period / (2 * math.pi)), period).alias("mean"), "resultant", std.alias("std"))


def entries_with_value(obs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Entries that give a value: exact, by way of a bit for each pid."""
    return distinct_entries(obs.filter(finite(F.col(value)).isNotNull()), by)


def raw_histogram(obs: DataFrame, family: DataFrame, p: ParameterSpec, bins: int, by: list[str], range_obs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts by key and bin, one-row range). The range follows all allowed observations, selected forms or not."""
    seen = obs.filter(finite(F.col(p.param_id)).isNotNull())
    if p.circular:
        one = obs.sparkSession.createDataFrame([(0.0, float(p.period))], "lo double, hi double")
        return counts(seen, circular_bin(F.col(p.param_id).cast("double"), p.period, bins), by), one
    one = effective_range(obs if range_obs is None else range_obs, family, p.param_id, p.range_default)
    return counts(with_row(seen, one), bin_of(F.col(p.param_id).cast("double"), F.col("lo"), F.col("hi"), bins), by), one


def distribution(entries: DataFrame, family: DataFrame, spec: FamilySpec, p: ParameterSpec, f: EntryFilter, o: ObsFilter, v: View) -> tuple[DataFrame, DataFrame]:
    """(series: form, bin, x, y; summary: form, n, entries and the statistics of the kind of parameter) for forms with rows.

    The observations are read for the range of a linear parameter, and once more for all the rest.
    """
    forms, one_param = selected_forms(f.forms), replace(spec, params=(p,))
    allowed = allowed_entries(entries, f)
    state = accumulate(allowed, family, one_param, o, v, forms, frame(allowed, family, one_param, o))
    done = finished(state, one_param, v, forms)
    return series(done, one_param).drop("param_id"), summaries(done, one_param, v, p)


def family_overview(entries: DataFrame, family: DataFrame, spec: FamilySpec, f: EntryFilter, o: ObsFilter, v: View) -> tuple[DataFrame, DataFrame]:
    """(series: param_id, form, bin, x, y; panels: param_id, lo, hi, shift, cut, kind, rows) of all parameters of a family.

    What distribution() does for one parameter, for all of them together: the observations are read for the ranges and for
    the histograms. Every parameter has a panel, with 0 rows and the fallback range if nothing passes the filters.
    """
    forms, allowed = selected_forms(f.forms), allowed_entries(entries, f)
    one = frame(allowed, family, spec, o)
    done = finished(accumulate(allowed, family, spec, o, v, forms, one), spec, v, forms)
    ends = one.select(F.explode(F.array(*[F.struct(F.lit(p.param_id).alias("param_id"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.lit(cut_of_none(p, v)).alias("none")) for i, p in enumerate(spec.params)])).alias("e")).select("e.*")
    rows = F.aggregate("forms", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    panels = ends.join(F.broadcast(done.select("param_id", "width", "turn", rows.alias("rows"))), "param_id", "left")  # a row for each parameter
    shift, kind = F.coalesce("turn.shift", F.lit(0)), F.coalesce("turn.kind", "none")
    return series(done, spec), panels.select("param_id", "lo", "hi", shift.alias("shift"), F.coalesce(F.col("turn.shift") * F.col("width"), F.lit(0.0)).alias("cut"), kind.alias("kind"), F.coalesce("rows", F.lit(0)).alias("rows"))


def cut_of_none(p: ParameterSpec, v: View) -> str:
    """The kind of cut of a parameter without values."""
    return "linear" if not p.circular else {"wrap_360": "wrap", "signed_180": "signed"}.get(v.mode, "sparse")


def selection_counts(entries: DataFrame, family: DataFrame, spec: FamilySpec, p: ParameterSpec, f: EntryFilter, o: ObsFilter) -> DataFrame:
    """One row: filtered entries, plotted observations, all rows of the family."""
    allowed = allowed_entries(entries, f)
    obs = observations(allowed, family, spec, o).filter(F.col("form").isin(selected_forms(f.forms)))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(allowed, "entries").crossJoin(one(obs.filter(F.col(p.param_id).isNotNull()), "plotted")).crossJoin(one(family, "family_rows"))
