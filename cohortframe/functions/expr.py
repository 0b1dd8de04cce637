"""Column helpers shared by the operators.  All of them stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, null where den is 0 (Spark 4 raises in ANSI mode)."""
    return as_col(num).cast("double") / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    value = F.round(as_col(c).cast("double"), digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def round_columns(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery column.

    The row is computed once and read by every task; no join is planned.
    """
    return df.select(F.struct(*df.columns)).scalar()


def u01(seed: int | Column, *keys: str | Column) -> Column:
    """Uniform number in (0, 1) fixed by the seed and the keys.

    52 bits of an MD5 digest: the same cell draws the same number whatever the
    partitioning, the retry or the engine.
    """
    seed_col = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    text = F.concat_ws("|", seed_col, *[as_col(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def std_normal(seed: int, *keys: str | Column) -> Column:
    """Standard normal number by Box-Muller on two hashed uniforms."""
    radius = F.sqrt(-2.0 * F.log(u01(seed, F.lit("r"), *keys)))
    return radius * F.cos(2.0 * math.pi * u01(seed, F.lit("a"), *keys))


# Coefficients of Acklam's rational approximation of the inverse
# normal CDF (relative error below 1.2e-9), published by P. J. Acklam.
_PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
          1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
          6.680131188771972e01, -1.328068155288572e01, 1.0)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
          -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
          3.754408661907416e00, 1.0)


def _horner(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: str | Column) -> Column:
    """Inverse of the standard normal CDF for 0 < p < 1."""
    p = as_col(p)
    low = 0.02425
    q = p - 0.5
    r = q * q
    middle = _horner(_PPF_A, r) * q / _horner(_PPF_B, r)
    tail = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    side = _horner(_PPF_C, tail) / _horner(_PPF_D, tail)
    return F.when(p < low, side).when(p > 1 - low, -side).otherwise(middle)


def clip(c: str | Column, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(hi, F.greatest(lo, as_col(c)))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key that holds most of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]) \
        .select(*df.columns)
