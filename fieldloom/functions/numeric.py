"""Null- and ANSI-safe column expressions that the operators share.

Missing values are NULL everywhere; NaN and sentinels become NULL at the source. Ratios of zero are NULL, standard
deviations are population or sample ones as named, medians and percentiles interpolate linearly, and random choices are
a hash of a seed and a key, so they depend on neither partitioning nor engine.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, without a negative zero. Averages often end in a half of the last digit, which the order
    of summing tips either way, so a little is added first."""
    return F.round(col(c) + F.lit(1e-9), 6) + F.lit(0.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clamp(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """x held in [lo, hi]; NULL stays NULL (greatest and least alone would skip it)."""
    out = x if lo is None else F.greatest(F.lit(float(lo)), x)
    out = out if hi is None else F.least(F.lit(float(hi)), out)
    return F.when(x.isNotNull(), out)


def corr(x: Column | str, y: Column | str, floor: float = 1e-12) -> Column:
    """Pearson correlation as an aggregate; NULL where a side is constant (up to `floor` of deviation)."""
    x, y = col(x), col(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > floor) & (sy > floor), F.covar_pop(x, y) / (sx * sy))


def hash_unit(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the md5 of seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def hash_rank(seed: int, *keys: Column | str) -> Column:
    """A text to order rows by at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number from two hashed uniforms."""
    u, v = hash_unit(seed, *keys), hash_unit(seed + 1, *keys)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * F.lit(3.141592653589793) * v)


def quantile_bin(order: Column, n: int, *groups: str) -> Column:
    """Bin 0..n-1 of each row by rank over quantile edges that are interpolated linearly (unlike ntile)."""
    w = Window.partitionBy(*groups)
    r = F.row_number().over(w.orderBy(order))
    size = F.count(F.lit(1)).over(w)
    return F.when(size == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((r - 1) * n / (size - 1)).cast("int") - 1))


def band(x: Column | str, edges: list[float]) -> Column:
    """Index of the right-closed band (edge k, edge k+1]; NULL outside and on the lowest edge."""
    x, out = col(x), None
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        hit = (x > lo) & (x <= F.lit(hi)) if hi != float("inf") else x > lo
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out


def missing(x: Column | str, sentinel: float | int | None = None) -> Column:
    """NaN and the sentinel to NULL."""
    x = col(x)
    out = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return out if sentinel is None else F.when(x != sentinel, out)


def floor_window(day: Column | str, start: Column | int, width: int) -> Column:
    """Window number of a day, floored also below the start."""
    return F.floor((col(day) - start) / F.lit(float(width))).cast("bigint")
