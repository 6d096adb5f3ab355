"""Accumulators: one aggregate over the observations from which all of a distribution follows; kept, it merges with later ones.

A state has two kinds of rows by parameter and form. A row for each bin has the count and two sums: of values and squares, or of
cosines and sines. A row for each 64 entries has a bit for each one that gives a value, so that distinct entries are exact
and states of the same entries add up. Rows of both kinds come from one scan and one shuffle with a map-side part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from angula.functions.columns import bin_of, circular_bin, finite, wrap
from angula.operators import series as S
from angula.operators.filters import finite_values, obs_condition, observations
from angula.operators.histogram import fallback, padded, with_row
from angula.spec import FamilySpec, ObsFilter, ParameterSpec, View

KEYS = ["param_id", "form", "entries", "key"]
STATE = [*KEYS, "n", "a", "b", "bits", "lo", "hi"]


def entry_word() -> Column:
    return F.shiftright(F.col("pid").cast("long"), 6)


def entry_bit() -> Column:
    return F.expr("shiftleft(1L, CAST(CAST(pid AS BIGINT) & 63 AS INT))")


def distinct_entries(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, entries: exact numbers of different pids, from bits by 64 of them; null pids don't count."""
    words = df.filter("pid is not null").groupBy(*by, entry_word().alias("word")).agg(F.bit_or(entry_bit()).alias("bits"))
    return words.groupBy(*by).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("entries"))


def frame(allowed: DataFrame, family: DataFrame, spec: FamilySpec, o: ObsFilter) -> DataFrame:
    """One row lo0, hi0, lo1, ...: the range of each parameter of spec, as effective_range() has it.

    The selection's and the whole family's ends are conditional aggregates of one scan; without a parameter that may need the family's
    the filters reach the scan; without a linear one there is none.
    """
    linear = [(i, p) for i, p in enumerate(spec.params) if not p.circular]
    ends = lambda v, i, name: [F.min(v).alias(f"{name}lo{i}"), F.max(v).alias(f"{name}hi{i}")]
    value = lambda p: F.col(f"`{p.param_id}`").cast("double")
    if not linear:
        one = family.sparkSession.range(1)
    elif all(p.range_default for _, p in linear):
        one = observations(allowed, family, spec, o).agg(*[c for i, p in linear for c in ends(value(p), i, "")])
    else:
        seen = finite_values(family, *[p.param_id for _, p in linear]).join(allowed.select("pid", F.lit(True).alias("_allowed")), "pid", "left")
        passes = F.coalesce(obs_condition(spec, o) & F.col("_allowed"), F.lit(False))
        one = seen.agg(*[c for i, p in linear for c in ends(F.when(passes, value(p)), i, "") + ends(value(p), i, "f_")])
    out = []
    for i, p in enumerate(spec.params):
        lo, hi = F.lit(0.0), F.lit(float(p.period))
        if not p.circular:
            none = F.lit(None).cast("double")
            own = padded(F.col(f"lo{i}"), F.col(f"hi{i}"), p.range_default)
            rest = fallback(none if p.range_default else F.col(f"f_lo{i}"), none if p.range_default else F.col(f"f_hi{i}"), p.range_default)
            lo, hi = (F.when(F.col(f"lo{i}").isNull(), r).otherwise(c) for c, r in zip(own, rest))
        out += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}")]
    return one.select(*out)


def _by_param(spec: FamilySpec, what) -> Column:
    """what(place, parameter) of the row's param_id."""
    return reduce(lambda rest, ip: F.when(F.col("param_id") == ip[1].param_id, what(*ip)).otherwise(rest), enumerate(spec.params), F.lit(None))


def accumulate(allowed: DataFrame, family: DataFrame, spec: FamilySpec, o: ObsFilter, v: View, forms: Sequence[str], one: DataFrame) -> DataFrame:
    """The state of the selection in a frame: STATE columns. Values outside the frame are in the bins at its ends."""
    obs = with_row(observations(allowed.filter(F.col("form").isin(list(forms))), family, spec, o), one)
    zero, parts = F.lit(0.0), []
    for i, p in enumerate(spec.params):
        x = finite(F.col(f"`{p.param_id}`").cast("double"))
        turn = wrap(x, p.period) * (2 * math.pi / p.period)
        at = circular_bin(x, p.period, v.bins(True)) if p.circular else bin_of(x, F.col(f"lo{i}"), F.col(f"hi{i}"), v.bins(False))
        sums = (F.cos(turn), F.sin(turn)) if p.circular else (x, x * x)
        row = lambda entries, key, a, b, bit: F.struct(F.lit(i).alias("i"), F.lit(entries).alias("entries"), F.when(x.isNotNull(), key.cast("long")).alias("key"), a.alias("a"), b.alias("b"), bit.alias("bit"))  # noqa: E731, B023
        parts += [row(False, at, *sums, F.lit(0).cast("long")), row(True, entry_word(), zero, zero, entry_bit())]
    d = obs.select("form", F.explode(F.array(*parts)).alias("v")).select("form", "v.*").filter("key is not null")
    d = d.groupBy("i", "form", "entries", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.bit_or("bit").alias("bits"))
    d = with_row(d.withColumn("param_id", F.element_at(F.array(*[F.lit(p.param_id) for p in spec.params]), F.col("i") + 1)), one)
    return d.withColumn("lo", _by_param(spec, lambda i, p: F.col(f"lo{i}"))).withColumn("hi", _by_param(spec, lambda i, p: F.col(f"hi{i}"))).select(*STATE)


def merged(*states: DataFrame) -> DataFrame:
    """The state of all that went into states of one frame; rows in two of them count twice, their entries once. Unequal frames fail."""
    d = reduce(DataFrame.unionByName, states).groupBy(*KEYS)
    d = d.agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.bit_or("bits").alias("bits"), *[f(c).alias(f"{k}_{c}") for c in ("lo", "hi") for k, f in (("min", F.min), ("max", F.max))])
    same = lambda c: F.when(F.col(f"min_{c}") == F.col(f"max_{c}"), F.col(f"min_{c}")).otherwise(F.raise_error(F.lit("states of different frames")).cast("double")).alias(c)
    return d.select(*KEYS, "n", "a", "b", "bits", same("lo"), same("hi"))


def finished(state: DataFrame, spec: FamilySpec, v: View, forms: Sequence[str]) -> DataFrame:
    """One row for each parameter with values: param_id, circular, lo, hi, width, turn (struct shift, kind) and forms.

    forms: array<struct<form, n, a, b, entries, counts, y>> of the forms with values, in order; counts are those of the bins, y is
    smoothed, cut open and scaled. All of it is worked out within the row.
    """
    bins, turn = v.bins(False), v.bins(True)
    known = "(" + ", ".join(f"'{f}'" for f in forms) + ")"
    of = lambda f, entries, c: f"CASE WHEN form = '{f}' AND {'entries' if entries else 'NOT entries'} THEN {c} END"
    made = [f"sum({of(f, False, c)}) AS {c}{j}" for j, f in enumerate(forms) for c in "nab"]
    made += [f"CAST(sum({of(f, True, 'bit_count(bits)')}) AS BIGINT) AS e{j}" for j, f in enumerate(forms)]
    made += [f"collect_list({of(f, False, 'struct(key, n)')}) AS h{j}" for j, f in enumerate(forms)]
    d = state.filter(f"form IN {known}").groupBy("param_id").agg(*map(F.expr, ["first(lo) AS lo", "first(hi) AS hi", *made]))
    round_ = "param_id IN (" + ", ".join([f"'{p.param_id}'" for p in spec.params if p.circular] or ["NULL"]) + ")"
    d = d.selectExpr("*", f"coalesce({round_}, false) AS circular").selectExpr("*", f"(hi - lo) / IF(circular, {turn}, {bins}) AS width")
    counts = lambda j: f"IF(circular, {S.dense(f'h{j}', turn)}, {S.dense(f'h{j}', bins)})"
    rows = [f"IF(n{j} > 0, named_struct('form', '{f}', 'n', n{j}, 'a', a{j}, 'b', b{j}, 'entries', e{j}, 'counts', {counts(j)}), NULL)" for j, f in enumerate(forms)]
    keep = ("form", "n", "a", "b", "entries", "counts")

    def all_of(given: str) -> str:
        seam = f"IF(circular, {S.cut(S.pooled(f'{given}.counts', turn), turn, v.mode)}, named_struct('shift', 0, 'kind', 'linear'))"
        y = lambda f, c: f"IF(circular, {S.rotated(S.smoothed(f'{f}.counts', turn, v.sigma, True), f'{c}.shift', turn)}, {S.smoothed(f'{f}.counts', bins, v.sigma, False)})"
        one = lambda f, c: f"named_struct({', '.join(f'{n!r}, {f}.{n}' for n in keep)}, 'y', {S.scaled(y(f, c), 'width' if v.scale == 'density' else None)})"
        return S.let(seam, lambda c: f"named_struct('turn', {c}, 'forms', {S.each(given, lambda f: one(f, c))})")

    d = d.selectExpr("param_id", "circular", "lo", "hi", "width", f"{S.let('array_compact(array(' + ', '.join(rows) + '))', all_of)} AS made")
    return d.selectExpr("param_id", "circular", "lo", "hi", "width", "made.turn", "made.forms")


def series(done: DataFrame, spec: FamilySpec) -> DataFrame:
    """param_id, form, bin, x, y."""
    d = done.select("param_id", "circular", "lo", "width", "turn", F.explode("forms").alias("f")).select("*", F.posexplode("f.y").alias("bin", "y"))
    period = _by_param(spec, lambda i, p: F.lit(float(p.period)))
    x = F.col("lo") + F.col("width") * (F.col("bin") + 0.5)
    return d.select("param_id", "f.form", "bin", F.when(F.col("circular"), F.pmod(x + F.col("turn.shift") * F.col("width"), period)).otherwise(x).alias("x"), "y")


def summaries(done: DataFrame, spec: FamilySpec, v: View, p: ParameterSpec) -> DataFrame:
    """form, n, entries and the statistics of the kind of a parameter."""
    d = done.filter(F.col("param_id") == p.param_id).select("lo", "width", "turn", F.explode("forms").alias("f")).select("lo", "width", "turn", "f.*")
    n = F.col("n")
    if p.circular:
        unit = p.period / (2 * math.pi)
        d = d.withColumn("resultant", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.hypot("a", "b") / n)))
        std = F.when(F.col("resultant") > 0, F.sqrt(F.greatest(F.lit(0.0), -2 * F.log("resultant"))) * unit)
        top = wrap((F.expr(S.peak("y")) + 0.5 + F.col("turn.shift")) * F.col("width"), p.period)
        return d.select("form", "n", "entries", wrap(F.atan2("b", "a") * unit, p.period).alias("mean"), "resultant", std.alias("std"), top.alias("peak"))
    mean = F.col("a") / n
    centre = lambda q: F.col("lo") + F.col("width") * (F.expr(S.percentile("counts", v.bins(False), q)) + 0.5)
    return d.select("form", "n", "entries", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("b") / n - mean * mean)).alias("std"), centre(0.05).alias("p05"), centre(0.95).alias("p95"))
