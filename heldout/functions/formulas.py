"""Closed-form column expressions and the few driver-side scalars."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def ccc_of(y: str, x: str, guard: float = 0.0) -> Column:
    """Concordance of two columns as one aggregate; NULL where it is undefined."""
    gap = F.avg(y) - F.avg(x)
    denominator = F.var_pop(y) + F.var_pop(x) + gap * gap
    return F.when(denominator > guard, 2 * F.covar_pop(y, x) / denominator)


def mae_of(y: str, x: str) -> Column:
    return F.avg(F.abs(F.col(x) - F.col(y)))


def rmse_of(y: str, x: str) -> Column:
    return F.sqrt(F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y))))


def ccc_from_sums(n, sy, sx, syy, sxx, sxy, guard: float = 1e-15) -> Column:
    """Concordance from additive sums, with clipped variances."""
    n, sy, sx, syy, sxx, sxy = [F.col(c) if isinstance(c, str) else c for c in (n, sy, sx, syy, sxx, sxy)]
    my, mx = sy / n, sx / n
    denominator = (
        F.greatest(sxx / n - mx * mx, F.lit(0.0))
        + F.greatest(syy / n - my * my, F.lit(0.0))
        + (mx - my) * (mx - my)
    )
    return F.when((n > 0) & (denominator > guard), 2 * (sxy / n - mx * my) / denominator)


def half_even_count(n: Column, fraction: float) -> Column:
    """``max(1, round(n * fraction))`` with ties to even."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction)), 0).cast("bigint"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = successes / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low = F.when(n > 0, (centre - half) / scale)
    high = F.when(n > 0, (centre + half) / scale)
    return low, high


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def _beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_quantile(df: float, p: float = 0.975) -> float:
    """Student-t quantile, a scalar computed once per distinct df on the driver."""
    low, high = 0.0, 1e6
    for _ in range(300):
        mid = (low + high) / 2
        upper_tail = 0.5 * _beta_cdf(df / 2.0, 0.5, df / (df + mid * mid))
        if 1.0 - upper_tail < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@pandas_udf(DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    """Upper 2.5 % Student-t quantile per row, computed once per distinct df in a batch."""
    known = {v: t_quantile(float(v)) for v in df.dropna().unique() if v >= 1}
    return df.map(known)
