"""Special functions: the normal tail as a column, other tails for a few result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerator and denominator coefficients of Cody's rational approximations of erfc
#: (Math. Comp. 23, 1969), highest power first (fixed values).
ERF_P = [1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
ERF_Q = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
MID_P = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
         8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
MID_Q = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
         3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
FAR_P = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
FAR_Q = [1.0, 2.56852019228982242, 1.87295284992346047, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to double precision."""
    small = 1 - x * _horner(ERF_P, x * x) / _horner(ERF_Q, x * x)
    mid = F.exp(-x * x) * _horner(MID_P, x) / _horner(MID_Q, x)
    y = F.try_divide(F.lit(1.0), x * x)
    far = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) - y * _horner(FAR_P, y) / _horner(FAR_Q, y))
    return F.when(x <= 0.46875, small).when(x <= 4.0, mid).otherwise(far)


def normal_p(z: Column) -> Column:
    """ST-11: two-sided normal p."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """ST-10: Wilson interval of k of n; null for n = 0."""
    n_ = F.when(n > 0, n.cast("double"))
    p = k / n_
    centre, spread = p + z * z / (2 * n_), z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    return (centre - spread) / (1 + z * z / n_), (centre + spread) / (1 + z * z / n_)


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_tail(x: float, df: int) -> float:
    return gamma_tail(df / 2, x / 2)


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + an * d) or tiny)
            c = (1 + an / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    half = beta_share(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    """Student's t at an upper-half probability, by bisection."""
    lo, hi = 0.0, 1.0
    while t_tail(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2
