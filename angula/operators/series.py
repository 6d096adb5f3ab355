"""A binned series as one array: smoothing, rotation, scaling, seam, percentile and peak within a row, without a shuffle.

Each function takes SQL expressions as text and gives one; F.expr() makes a column of it. A text is parsed at once, where columns
put together in Python are a call into the JVM for every node.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from angula.functions.columns import kernel

_names = count()


def fun(args: int, body: Callable[..., str]) -> str:
    """A lambda of so many arguments, whose names nothing else has."""
    own = [f"_v{next(_names)}" for _ in range(args)]
    return f"({', '.join(own)}) -> {body(*own)}" if args > 1 else f"{own[0]} -> {body(*own)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """body(value), with value worked out once."""
    return f"element_at(transform(array({value}), {fun(1, body)}), 1)"


def each(values: str, body: Callable[[str], str]) -> str:
    return f"transform({values}, {fun(1, body)})"


def fold(values: str, start: str, step: Callable[[str, str], str]) -> str:
    return f"aggregate({values}, {start}, {fun(2, step)})"


def places(bins: int) -> str:
    return f"sequence(0, {bins - 1})"


def total(counts: str) -> str:
    return fold(counts, "0L", lambda a, x: f"{a} + {x}")


def dense(pairs: str, bins: int) -> str:
    """Counts of all bins from an array of structs (key, n); 0 where there is none."""
    return let(f"map_from_entries({pairs})", lambda m: each(places(bins), lambda i: f"coalesce(element_at({m}, CAST({i} AS BIGINT)), 0L)"))


def pooled(arrays: str, bins: int) -> str:
    """The sum of arrays."""
    return each(places(bins), lambda i: fold(arrays, "0L", lambda a, c: f"{a} + get({c}, {i})"))


def smoothed(counts: str, bins: int, sigma: float, circular: bool) -> str:
    """Gaussian smoothing: neighbours past a linear end are left out, circular ones wrap."""
    at = lambda i, o: f"pmod({i} + {o}, {bins})" if circular else f"{i} + {o}"
    return let(counts, lambda c: each(places(bins), lambda i: " + ".join(f"coalesce(get({c}, {at(i, o)}), 0) * {w!r}D" for o, w in kernel(sigma))))


def rotated(y: str, shift: str, bins: int) -> str:
    """out[i] = y[(i + shift) mod bins]."""
    return let(y, lambda c: each(places(bins), lambda i: f"get({c}, ({i} + {shift}) % {bins})"))


def scaled(y: str, width: str | None = None) -> str:
    """Probability (zeros if all is zero), or with the bins' width density."""
    per = "" if width is None else f" / {width}"
    return let(y, lambda c: let(fold(c, "0D", lambda a, x: f"{a} + {x}"), lambda t: each(c, lambda x: f"IF({t} > 0, {x} / {t}{per}, 0D)")))


def cut(counts: str, bins: int, mode: str) -> str:
    """struct(shift, kind): by how many bins, and why, a circular axis with these pooled counts is cut open."""
    made = lambda shift, kind: f"named_struct('shift', CAST({shift} AS INT), 'kind', '{kind}')"
    if mode == "wrap_360":
        return made(0, "wrap")
    if mode == "signed_180":
        return made(int(bins / 2 + 0.5) % bins, "signed")
    w = min(bins - 1, max(5, int(36 / (360 / bins) + 0.5)))
    full = lambda n: f"filter(sequence(0, {2 * bins - 1}), {fun(1, lambda j: f'get({n}, {j} % {bins}) > 0')})"
    first_full = lambda f, i: f"coalesce(array_min(filter({f}, {fun(1, lambda j: f'{j} >= {i}')})), {2 * bins})"
    runs = lambda f: f"array_max({each(places(bins), lambda i: f'struct({first_full(f, i)} - {i} AS len, -{i} AS neg)')})"
    window = lambda y, i: "round(" + fold(f"sequence(0, {w - 1})", "0D", lambda a, j: f"{a} + get({y}, ({i} + {j}) % {bins})") + ", 9)"
    quiet = lambda y: f"array_min({each(places(bins), lambda i: f'struct({window(y, i)} AS sum, {i} AS at)')})"
    by_gap = lambda g: f"floor(-{g}.neg + {g}.len / 2D + 0.5D) % {bins}"
    by_calm = lambda c: f"({c}.at + {w // 2}) % {bins}"
    choice = lambda t, g, c: f"CASE WHEN {t} < 8 THEN {made(0, 'sparse')} WHEN {g}.len >= 2 THEN {made(by_gap(g), 'gap')} WHEN {c}.sum > 0.85D * {t} * {w} / {bins} THEN {made(0, 'flat')} ELSE {made(by_calm(c), 'quiet')} END"
    return let(counts, lambda n: let(total(n), lambda t: let(let(full(n), runs), lambda g: let(let(smoothed(n, bins, 1.2, True), quiet), lambda c: choice(t, g, c)))))


def percentile(counts: str, bins: int, q: float) -> str:
    """The first bin up to which a share q of the counts lies; null without any."""
    step = lambda n, t: lambda a, i: let(f"{a}.up + get({n}, {i})", lambda up: f"named_struct('up', {up}, 'at', IF({a}.at < 0 AND {up} >= {t} * {q!r}D, {i}, {a}.at))")
    return let(counts, lambda n: let(total(n), lambda t: f"IF({t} > 0, {fold(places(bins), _START, step(n, t))}.at, NULL)"))


_START = "named_struct('up', 0L, 'at', -1)"


def peak(y: str) -> str:
    """The first bin of the greatest value, to twelve places."""
    return let(each(y, lambda x: f"round({x}, 12)"), lambda r: f"CAST(array_position({r}, array_max({r})) - 1 AS INT)")
