"""Column functions: angles, labels, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from angula.spec import FORMS


def finite(v: Column) -> Column:
    """v, or null for NaN and infinities."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def wrap(v: Column, period: float = 360.0) -> Column:
    """The angle in [0, period)."""
    return F.pmod(v, F.lit(float(period)))


def signed_angle(v: Column, period: float = 360.0) -> Column:
    """The angle in (-period / 2, period / 2]."""
    w = wrap(v, period)
    return F.when(w > period / 2, w - period).otherwise(w)


def display_value(v: Column, circular: bool, mode: str, cut: Column | None = None, period: float = 360.0) -> Column:
    if not circular:
        return v
    if mode == "signed_180":
        return signed_angle(v, period)
    return wrap(wrap(v, period) - (F.lit(0.0) if cut is None else cut), period) if mode == "auto" else wrap(v, period)


def cleanliness_label() -> Column:
    """The first of conservative, mw100 and relaxed that the entry passes."""
    return F.when(F.col("passes_conservative"), "Conservative").when(F.col("passes_mw100"), "No large het").when(F.col("passes_relaxed"), "Relaxed").otherwise("All")


def fixed_digits(v: Column, digits: int, even: bool = False) -> Column:
    """v with so many decimals (6 at most), rounded from its exact binary value, ties away from zero; null for null and not finite.

    even: ties to the even digit, as C's and SQL's printf rounds; a browser's toFixed rounds away from zero.
    Where the value is well away from a tie, formatting rounds it alike; elsewhere the part behind the point is taken in units
    of 2**-80, in which a tie can be told exactly. Whole numbers have all their digits up to 1e21, an exponent from there on.
    """
    x = finite(v.cast("double"))
    size = F.abs(x)
    scaled = size * 10.0**digits
    plain = (scaled < 1e10) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    whole = F.floor(F.least(size, F.lit(2.0**62)))
    part = (F.least(size, F.lit(2.0**62)) - whole) * 2.0**40
    units = F.floor(part).cast("decimal(20,0)") * F.lit(2**40).cast("decimal(13,0)") + ((part - F.floor(part)) * 2.0**40).cast("long").cast("decimal(20,0)")
    twice = units * F.lit(2 * 10**digits).cast("decimal(8,0)") + F.expr(f"CAST({2**80} AS DECIMAL(25,0))")
    n = F.call_function("div", twice, F.expr(f"CAST({2**81} AS DECIMAL(25,0))"))
    if even:
        odd = (n if digits else whole.cast("long") + n) % 2 == 1
        n = n - F.when((twice % F.expr(f"CAST({2**81} AS DECIMAL(25,0))") == 0) & odd, 1).otherwise(0)
    up = n >= 10**digits
    exact = (whole.cast("long") + up.cast("long")).cast("string")
    exact = F.concat(exact, F.lit("."), F.lpad((n - F.when(up, 10**digits).otherwise(0)).cast("string"), digits, "0")) if digits else exact
    high = F.floor(F.least(size, F.lit(1e21)) / 2.0**32)  # from 2**53 on there is nothing behind the point
    large = (high.cast("decimal(16,0)") * F.lit(2**32).cast("decimal(10,0)") + (F.least(size, F.lit(1e21)) - high * 2.0**32).cast("long").cast("decimal(10,0)")).cast("string")
    large = F.concat(large, F.lit("." + "0" * digits)) if digits else large
    huge = F.regexp_replace(F.regexp_replace(size.cast("string"), r"\.0E", "E"), "E", "e+")
    text = F.when(plain, F.format_string(f"%.{digits}f", size)).when(size < 2.0**53, exact).when(size < 1e21, large).otherwise(huge)
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), text))


def fixed(v: Column, digits: int, even: bool = False) -> Column:
    """fixed_digits(), and '-' for null and not finite."""
    return F.coalesce(fixed_digits(v, digits, even), F.lit("-"))


def resolution_label(even: bool = False) -> Column:
    return F.when(F.col("resolution_known") & finite(F.col("resolution")).isNotNull(), F.concat(fixed(F.col("resolution"), 2, even), F.lit(" Å"))).otherwise("-")


def form_label(form: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])
    return F.coalesce(F.element_at(labels, form), form)


def entry_url(entry_id: Column, base: str = "https://example.org/entry/") -> Column:
    """The page of an entry: base and the upper-case id, percent-encoded as in a URL's path."""
    return F.concat(F.lit(base), F.replace(F.url_encode(F.upper(entry_id)), F.lit("+"), F.lit("%20")))


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Linear bin; both ends are clamped."""
    width = (hi - lo) / bins
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - lo) / width)))).cast("int")


def circular_bin(v: Column, period: float, bins: int) -> Column:
    """Circular bin; what rounds up to the end is in bin 0."""
    b = F.floor(wrap(v, period) / (period / bins))
    return F.when(b >= bins, 0).otherwise(b).cast("int")


def grid_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a 2D grid; both ends are clamped on both kinds of axis."""
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)))).cast("int")


def kernel(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian of radius max(2, ceil(3 sigma)); weights sum to 1."""
    if sigma <= 0:
        return [(0, 1.0)]
    radius = max(2, math.ceil(3 * sigma))
    w = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-radius, radius + 1)]
    return [(o, x / sum(w)) for o, x in zip(range(-radius, radius + 1), w)]
