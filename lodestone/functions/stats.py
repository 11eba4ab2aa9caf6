"""Tail probabilities and quantiles of single numbers, for the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square: regularised incomplete gamma by series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0 or df <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def student_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs, by numeric integration of the t density."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    # substitution t = sqrt(df) tan(a) makes the range finite: the density becomes cos(a)^(df - 1)
    lo, hi, steps = math.atan(t / math.sqrt(df)), math.pi / 2, 2000
    w = (hi - lo) / steps
    f = [math.cos(lo + i * w) ** (df - 1) for i in range(steps + 1)]
    area = w / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
    return min(1.0, 2 * c * math.sqrt(df) * area)
