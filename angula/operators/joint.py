"""Two parameters: pairing by row or site, 2D histograms, correlations, contour levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from angula.functions.columns import circular_bin, finite, grid_bin, wrap
from angula.operators.accumulate import entry_bit, entry_word
from angula.operators.filters import obs_condition
from angula.operators.histogram import counts, dense, padded, seam, smooth, with_row
from angula.spec import LEVELS, FamilySpec, ObsFilter, ParameterSpec, View


def same_row(obs: DataFrame, x: str, y: str) -> DataFrame:
    """Both values of one row, where both are there."""
    return obs.select("pid", finite(F.col(x).cast("double")).alias("x"), finite(F.col(y).cast("double")).alias("y")).filter("x is not null and y is not null")


def last_row(df: DataFrame, keys: list[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """The value of each key's last row."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out))


def with_site(family: DataFrame, spec: FamilySpec) -> DataFrame:
    """site: the site label, or for a family without labels the row's offset within its entry, before any filter."""
    if spec.site:
        return family.withColumn("site", F.col(spec.site))
    w = W.partitionBy("pid").orderBy(*spec.order)
    return family.withColumn("site", (F.row_number().over(w) - 1).cast("string"))


def same_level(f1: DataFrame, s1: FamilySpec, p1: str, f2: DataFrame, s2: FamilySpec, p2: str, allowed: DataFrame, o: ObsFilter) -> DataFrame:
    """pid, x, y by (pid, site): the last row of family 1 for each key, every row of family 2; empty labels match.

    Both sides are held to the primary family's context choice.
    """
    cond = obs_condition(s1, o, True)
    a, b = (with_site(f, s).filter(cond).join(allowed.select("pid"), "pid", "left_semi").filter(finite(F.col(p)).isNotNull()) for f, s, p in ((f1, s1, p1), (f2, s2, p2)))
    left = last_row(a, ["pid", "site"], p1, s1.order, "x")
    return b.select("pid", "site", F.col(p2).cast("double").alias("y")).join(left, ["pid", "site"]).select("pid", F.col("x").cast("double").alias("x"), "y")


def split_label(label: Column) -> Column:
    """[left, right] of a pair label, null unless it has exactly two parts."""
    parts = F.split(label, "--", -1)
    return F.when(F.size(parts) == 2, parts)


def pair_to_residue(pairs: DataFrame, ps: FamilySpec, p1: str, residues: DataFrame, rs: FamilySpec, p2: str, allowed: DataFrame, o: ObsFilter, ro: ObsFilter, side: str = "both") -> DataFrame:
    """pid, x (pair), y (residue): each pair with the last row of its residues on the chosen side; equal sides count twice."""
    r = residues.filter(obs_condition(rs, ro, True)).join(allowed.select("pid"), "pid", "left_semi")
    r = r.filter(finite(F.col(p2)).isNotNull() & (F.coalesce(F.col(rs.site), F.lit("")) != ""))
    r = last_row(r.withColumn("site", F.col(rs.site)), ["pid", "site"], p2, rs.order, "y")
    p = pairs.filter(obs_condition(ps, o, True)).filter(finite(F.col(p1)).isNotNull()).join(allowed.select("pid"), "pid", "left_semi")
    sides = F.col("sides")
    pick = {"both": sides, "nt1": F.slice(sides, 1, 1), "nt2": F.slice(sides, 2, 1)}[side]
    p = p.select("pid", F.col(p1).cast("double").alias("x"), split_label(F.col(ps.site)).alias("sides")).select("pid", "x", F.explode(pick).alias("site"))
    return p.join(r, ["pid", "site"]).select("pid", "x", F.col("y").cast("double").alias("y"))


def compatible_families(primary: str, mode: str = "same_level") -> list[str]:
    """Families that a primary family can be joined with; none for an unknown one."""
    level = LEVELS.get(primary)
    if level is None:
        return []
    if mode == "pair_residue" and level == "pair":
        return [f for f, x in LEVELS.items() if x == "residue"]
    return [f for f, x in LEVELS.items() if x == level]


def join_mode(s1: FamilySpec, s2: FamilySpec, mode: str) -> str:
    """same_row, same_level or pair_residue; an error for families that can't be joined."""
    if mode == "pair_residue" and s1.level == "pair" and s2.level == "residue" and s1.family_id != s2.family_id:
        return "pair_residue"
    if s1.level != s2.level:
        raise ValueError(f"{s1.family_id} and {s2.family_id} are of different levels")
    return "same_row" if s1.family_id == s2.family_id else "same_level"


def joint_pairs(f1: DataFrame, s1: FamilySpec, p1: str, f2: DataFrame, s2: FamilySpec, p2: str, allowed: DataFrame, o: ObsFilter, ro: ObsFilter, mode: str = "same_level", side: str = "both") -> DataFrame:
    kind = join_mode(s1, s2, mode)
    if kind == "same_row":
        return same_row(f1.filter(obs_condition(s1, o, True)).join(allowed.select("pid"), "pid", "left_semi"), p1, p2)
    if kind == "pair_residue":
        return pair_to_residue(f1, s1, p1, f2, s2, p2, allowed, o, ro, side)
    return same_level(f1, s1, p1, f2, s2, p2, allowed, o)


def linear_axis(pairs: DataFrame, name: str, default: tuple[float, float] | None = None) -> DataFrame:
    """One row (lo, hi) from the matched values."""
    lo, hi = padded(F.col("lo"), F.col("hi"), default)
    a, b = default or (0.0, 1.0)
    return pairs.agg(F.min(name).alias("lo"), F.max(name).alias("hi")).select(F.coalesce(lo, F.lit(float(a))).alias("lo"), F.coalesce(hi, F.lit(float(b))).alias("hi"))


def circular_axis(pairs: DataFrame, name: str, bins: int, mode: str, period: float = 360.0) -> DataFrame:
    """One row (shift, cut, kind) from the matched values' histogram."""
    hist = counts(pairs, circular_bin(F.col(name), period, bins), [])
    return seam(dense(hist, pairs.sparkSession.range(1), bins, []), bins, mode, period)


def axis(pairs: DataFrame, name: str, p: ParameterSpec, bins: int, mode: str) -> DataFrame:
    """One row <name>lo, <name>hi, <name>cut."""
    if p.circular:
        return circular_axis(pairs, name, bins, mode, p.period).select(F.lit(0.0).alias(f"{name}lo"), F.lit(float(p.period)).alias(f"{name}hi"), F.col("cut").alias(f"{name}cut"))
    return linear_axis(pairs, name, p.range_default).select(F.col("lo").alias(f"{name}lo"), F.col("hi").alias(f"{name}hi"), F.lit(0.0).alias(f"{name}cut"))


def on_axis(pairs: DataFrame, name: str, p: ParameterSpec) -> DataFrame:
    """pairs that hold their axis, with <name>v: the value on it."""
    return pairs.withColumn(f"{name}v", wrap(wrap(F.col(name), p.period) - F.col(f"{name}cut"), p.period) if p.circular else F.col(name))


def placed(pairs: DataFrame, name: str, p: ParameterSpec, bins: int, mode: str) -> DataFrame:
    """pairs with <name>v (the value on its axis), <name>lo, <name>hi and <name>cut."""
    return on_axis(with_row(pairs, axis(pairs, name, p, bins, mode)), name, p)


def grid(points: DataFrame, bx: int, by: int) -> DataFrame:
    """Dense (bx, by, z) counts of placed points."""
    at = points.select(grid_bin(F.col("xv"), F.col("xlo"), F.col("xhi"), bx).alias("bx"), grid_bin(F.col("yv"), F.col("ylo"), F.col("yhi"), by).alias("by"))
    n = at.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("z"))
    cells = points.sparkSession.range(bx).select(F.col("id").cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.lit(by - 1))).alias("by"))
    return cells.join(n, ["bx", "by"], "left").withColumn("z", F.coalesce("z", F.lit(0)))


def smooth_grid(cells: DataFrame, bx: int, by: int, sigma: float, circular_x: bool, circular_y: bool) -> DataFrame:
    """Along x, then along y."""
    a = smooth(cells, ["by"], bx, sigma, circular_x, "z", "z", "bx")
    return smooth(a, ["bx"], by, sigma, circular_y, "z", "z", "by")


def scaled_grid(cells: DataFrame, area: Column | None = None) -> DataFrame:
    total = cells.agg(F.sum("z").alias("total"))
    z = F.when(F.col("total") > 0, F.col("z") / F.col("total")).otherwise(0.0)
    return with_row(cells, total).withColumn("z", z / area if area is not None else z).drop("total")


def log_intensity(z: Column) -> Column:
    return F.log10(F.greatest(z, F.lit(1e-8)))


def pearson(x: str = "x", y: str = "y") -> Column:
    """Null for fewer than 3 rows or no spread."""
    r = F.corr(x, y)
    return F.when((F.count(F.lit(1)) >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0) & ~F.isnan(r), r)


def circular_correlation(pairs: DataFrame, px: float = 360.0, py: float = 360.0) -> DataFrame:
    """One row (n, r): sum sin(a - mean a) sin(b - mean b) over the root of the product of squares, in one pass of sums."""
    a, b = F.col("x") * (2 * math.pi / px), F.col("y") * (2 * math.pi / py)
    t = pairs.select(F.sin(a).alias("sa"), F.cos(a).alias("ca"), F.sin(b).alias("sb"), F.cos(b).alias("cb"))
    s = lambda c, name: F.sum(c).alias(name)
    col = F.col
    one = t.agg(
        F.count(F.lit(1)).alias("n"), s("sa", "sa"), s("ca", "ca"), s("sb", "sb"), s("cb", "cb"), s(col("sa") * col("sb"), "ss"), s(col("sa") * col("cb"), "sc"), s(col("ca") * col("sb"), "cs"), s(col("ca") * col("cb"), "cc"),
        s(col("sa") * col("sa"), "aa"), s(col("sa") * col("ca"), "ac"), s(col("sb") * col("sb"), "bb"), s(col("sb") * col("cb"), "bc"),
    )
    one = one.withColumn("ma", F.atan2("sa", "ca")).withColumn("mb", F.atan2("sb", "cb"))
    sa, ca, sb, cb = F.sin("ma"), F.cos("ma"), F.sin("mb"), F.cos("mb")
    top = col("ss") * ca * cb - col("sc") * ca * sb - col("cs") * sa * cb + col("cc") * sa * sb
    left = col("aa") * ca * ca - 2 * col("ac") * ca * sa + (col("n") - col("aa")) * sa * sa
    right = col("bb") * cb * cb - 2 * col("bc") * cb * sb + (col("n") - col("bb")) * sb * sb
    low = F.sqrt(F.greatest(F.lit(0.0), left * right))
    return one.select("n", F.when((col("n") >= 3) & (low > 1e-12), top / low).alias("r"))


def matched_counts(pairs: DataFrame) -> DataFrame:
    """One row (n, entries): matched rows and the entries that have any, in one pass, by a bit for each pid."""
    words = pairs.groupBy(entry_word().alias("word")).agg(F.count(F.lit(1)).alias("n"), F.bit_or(entry_bit()).alias("bits"))
    return words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("entries"))


def joint_distribution(pairs: DataFrame, p1: ParameterSpec, p2: ParameterSpec, v: View) -> tuple[DataFrame, DataFrame]:
    """(grid: bx, by, x, y, z; stats: n, entries, r, r2, circular_r, max_z).

    pairs is persisted, as the axes, the grid and the statistics read it; unpersist it when both results are written.
    """
    pairs = pairs.persist()
    bx, by = v.bins(p1.circular, True), v.bins(p2.circular, True)
    axes = axis(pairs, "x", p1, bx, v.mode).crossJoin(axis(pairs, "y", p2, by, v.mode))
    points = on_axis(on_axis(with_row(pairs, axes), "x", p1), "y", p2)
    cells = smooth_grid(grid(points, bx, by), bx, by, v.sigma, p1.circular, p2.circular)
    cells = with_row(cells, axes)
    wx, wy = (F.col("xhi") - F.col("xlo")) / bx, (F.col("yhi") - F.col("ylo")) / by
    cells = scaled_grid(cells, wx * wy if v.scale == "density" else None)

    def centre(name: str, p: ParameterSpec, at: str, width: Column) -> Column:
        c = F.col(f"{name}lo") + (F.col(at) + 0.5) * width
        return wrap(c + F.col(f"{name}cut"), p.period) if p.circular else c

    cells = cells.select("bx", "by", centre("x", p1, "bx", wx).alias("x"), centre("y", p2, "by", wy).alias("y"), "z")
    stats = points.agg(pearson("xv", "yv").alias("r")).withColumn("r2", F.col("r") * F.col("r")).crossJoin(matched_counts(pairs)).select("n", "entries", "r", "r2")
    turn = circular_correlation(pairs, p1.period, p2.period).select(F.col("r").alias("circular_r")) if p1.circular and p2.circular else pairs.agg(F.max(F.lit(None).cast("double")).alias("circular_r"))
    return cells, stats.crossJoin(turn).crossJoin(cells.agg(F.max(F.when(F.col("z") > 0, F.col("z"))).alias("max_z")))


# Mantissas of a step that reads well.
STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)


def contour_levels(cells: DataFrame, log: bool = False) -> DataFrame:
    """(width, step, level) of the tight, standard and wide contours; no rows without a positive cell."""
    top = cells.agg(F.max(F.when(F.col("z") > 0, F.col("z"))).alias("top")).filter("top is not null")
    lo, hi = (F.lit(-8.0), F.log10("top")) if log else (F.lit(0.0), F.col("top"))
    one = top.select(lo.alias("lo"), hi.alias("hi")).filter("hi > lo").withColumn("span", F.col("hi") - F.col("lo"))
    exps = F.sequence(F.floor(F.log10("span")).cast("int") - 3, F.floor(F.log10("span")).cast("int") + 1)
    one = one.withColumn("steps", F.array_sort(F.array_distinct(F.flatten(F.transform(exps, lambda e: F.array(*[F.pow(F.lit(10.0), e) * s for s in STEPS]))))))
    at_least = lambda v: F.array_min(F.filter("steps", lambda s: s >= v * (1 - 1e-12)))
    at_most = lambda v: F.array_max(F.filter("steps", lambda s: s <= v * (1 + 1e-12)))
    one = one.withColumn("standard", at_least(F.col("span") / 10))
    one = one.withColumn("wide", F.array_min(F.filter("steps", lambda s: (s >= F.col("span") / 7 * (1 - 1e-12)) & (s > F.col("standard") * (1 + 1e-9)))))
    one = one.withColumn("tight", F.least(at_most(F.col("span") / 14), F.array_max(F.filter("steps", lambda s: s < F.col("standard") * (1 - 1e-9)))))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("width"), F.col(k).alias("step")) for k in ("tight", "standard", "wide")])).alias("k")
    levels = one.select("lo", "hi", kinds).select("lo", "hi", "k.*")
    n = F.floor((F.col("hi") - F.col("lo")) / F.col("step") + 1e-9).cast("int")
    return levels.select("width", "step", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.col("lo") + i * F.col("step"))).alias("level"))
