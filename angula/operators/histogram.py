"""Ranges, histograms, smoothing, scaling, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from angula.functions.columns import finite, kernel


def padded(lo: Column, hi: Column, default: tuple[float, float] | None) -> tuple[Column, Column]:
    """Data range with its padding, united with the default range (the default alone if the data lie inside it)."""
    span = hi - lo
    pad = F.when(span < 1e-9, F.greatest(F.lit(0.5), F.abs(hi) * 0.1)).otherwise(F.greatest(span * 0.05, F.lit(0.5)))
    if default is None:
        return lo - pad, hi + pad
    a, b = map(F.lit, map(float, default))
    inside = (lo >= a) & (hi <= b)
    return F.when(inside, a).otherwise(F.least(a, lo - pad)), F.when(inside, b).otherwise(F.greatest(b, hi + pad))


def fallback(lo: Column, hi: Column, default: tuple[float, float] | None) -> tuple[Column, Column]:
    """Range if nothing passes the filters: the default, else the whole family's with a tenth on either side, else [0, 1]."""
    if default is not None:
        return F.lit(float(default[0])), F.lit(float(default[1]))
    span = hi - lo
    pad = F.when(span < 1e-9, F.greatest(F.lit(1.0), F.abs(hi) * 0.1)).otherwise(span * 0.1)
    return F.coalesce(lo - pad, F.lit(0.0)), F.coalesce(hi + pad, F.lit(1.0))


def effective_range(obs: DataFrame, family: DataFrame, value: str, default: tuple[float, float] | None = None) -> DataFrame:
    """One row (lo, hi) of a linear parameter."""
    v = finite(F.col(value).cast("double"))
    one = obs.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    all_ = family.agg(F.min(v).alias("f_lo"), F.max(v).alias("f_hi"))
    lo, hi = padded(F.col("lo"), F.col("hi"), default)
    f_lo, f_hi = fallback(F.col("f_lo"), F.col("f_hi"), default)
    return one.crossJoin(all_).select(F.coalesce(lo, f_lo).alias("lo"), F.coalesce(hi, f_hi).alias("hi"))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row of df with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(one))


def counts(obs: DataFrame, bin_: Column, by: list[str]) -> DataFrame:
    return obs.select(*by, bin_.alias("bin")).filter("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def dense(hist: DataFrame, keys: DataFrame, bins: int, by: list[str], value: str = "n") -> DataFrame:
    """Every key with every bin; 0 where hist has none."""
    grid = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(hist.select(*by, "bin", value), [*by, "bin"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def smooth(hist: DataFrame, by: list[str], bins: int, sigma: float, circular: bool, value: str = "n", out: str = "y", at: str = "bin") -> DataFrame:
    """Gaussian smoothing of a dense histogram: neighbours past a linear end are left out, circular ones wrap."""
    w = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(x).alias("w")) for o, x in kernel(sigma)])).alias("k")
    s = hist.select(*by, F.col(at), F.col(value), w)
    to = F.col(at) + F.col("k.o")
    to = F.pmod(to, F.lit(bins)) if circular else to
    s = s.select(*by, to.cast("int").alias(at), (F.col(value) * F.col("k.w")).alias("part"))
    return s.filter(F.col(at).between(0, bins - 1)).groupBy(*by, at).agg(F.sum("part").alias(out))


def scaled(series: DataFrame, by: list[str], scale: str = "probability", width: Column | None = None, value: str = "y") -> DataFrame:
    """Probability (sums to 1 for each key; zeros if all is zero) or density (per unit of x)."""
    total = F.sum(value).over(W.partitionBy(*by))
    p = F.when(total > 0, F.col(value) / total).otherwise(0.0)
    return series.withColumn(value, p / width if scale == "density" else p)


def percentile(hist: DataFrame, by: list[str], q: float, centre: Column) -> DataFrame:
    """Centre of the first bin up to which a share q of the raw counts lies, for each key that has any."""
    up = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    h = hist.withColumn("up", F.sum("n").over(up)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    return h.filter((F.col("total") > 0) & (F.col("up") >= F.col("total") * q)).groupBy(*by).agg(F.min_by(centre, "bin").alias("p"))


def rotate(hist: DataFrame, shift: Column, bins: int) -> DataFrame:
    """out[i] = in[(i + shift) mod bins]."""
    return hist.withColumn("bin", F.pmod(F.col("bin") - shift, F.lit(bins)).cast("int"))


def seam(pooled: DataFrame, bins: int, mode: str, period: float | str = 360.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, shift, cut, kind) from the dense pooled histogram (by, bin, n): where a circular axis is cut open; period may be a column."""
    width = (F.col(period) if isinstance(period, str) else F.lit(float(period))) / bins
    sizes = pooled.groupBy(*by).agg(F.max(width).alias("width"))
    if mode == "wrap_360":
        return sizes.select(*by, F.lit(0).alias("shift"), F.lit(0.0).alias("cut"), F.lit("wrap").alias("kind"))
    if mode == "signed_180":
        half = int(bins / 2 + 0.5) % bins
        return sizes.select(*by, F.lit(half).alias("shift"), (F.col("width") * bins / 2).alias("cut"), F.lit("signed").alias("kind"))
    smoothed = smooth(pooled, [*by], bins, 1.2, True)
    listed = lambda df, c: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", c))), lambda s: s[c]).alias(c))
    tied = lambda a, b: a.join(b, [*by]) if by else a.crossJoin(b)
    one = tied(tied(listed(pooled, "n"), listed(smoothed, "y")), sizes)
    every, twice = F.sequence(F.lit(0), F.lit(bins - 1)), F.sequence(F.lit(0), F.lit(2 * bins - 1))
    full = F.filter(twice, lambda j: F.get("n", j % bins) > 0)
    runs = F.transform(every, lambda i: F.struct((F.coalesce(F.array_min(F.filter("full", lambda j: j >= i)), F.lit(2 * bins)) - i).alias("len"), (-i).alias("neg")))
    w = min(bins - 1, max(5, int(36 / (360 / bins) + 0.5)))
    quiet = F.transform(every, lambda i: F.struct(F.round(F.aggregate(F.sequence(F.lit(0), F.lit(w - 1)), F.lit(0.0), lambda a, j: a + F.get("y", (i + j) % bins)), 9).alias("sum"), i.alias("at")))
    one = one.withColumn("full", full).withColumn("gap", F.array_max(runs)).withColumn("quiet", F.array_min(quiet))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    gap = F.floor(-F.col("gap.neg") + F.col("gap.len") / 2 + 0.5) % bins
    flat = F.col("quiet.sum") > 0.85 * total * w / bins
    kind = F.when(total < 8, "sparse").when(F.col("gap.len") >= 2, "gap").when(flat, "flat").otherwise("quiet")
    shift = F.when(F.col("kind") == "gap", gap).when(F.col("kind") == "quiet", (F.col("quiet.at") + w // 2) % bins).otherwise(0)
    return one.withColumn("kind", kind).withColumn("shift", shift.cast("int")).select(*by, "shift", (F.col("shift") * F.col("width")).alias("cut"), "kind")
