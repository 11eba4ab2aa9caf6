"""Column functions: effect signals, probability maps, logit transforms, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def transformed_outcome(y, t, p) -> Column:
    y, t, p = map(_c, (y, t, p))
    return y * (t - p) / (p * (1 - p))


def adjusted_transformed_outcome(y, t, m, p) -> Column:
    return transformed_outcome(_c(y) - _c(m), t, p)


def ipw_signal(y, t, p) -> Column:
    y, t, p = map(_c, (y, t, p))
    return t * y / p - (1 - t) * y / (1 - p)


def dr_signal(y, t, mu0, mu1, p) -> Column:
    """Doubly robust estimate of a row's effect."""
    y, t, mu0, mu1, p = map(_c, (y, t, mu0, mu1, p))
    return mu1 - mu0 + t * (y - mu1) / p - (1 - t) * (y - mu0) / (1 - p)


def negative_keep_probability(p, factor: float) -> Column:
    """Share of negatives that multiplies prevalence by ``factor``; an impossible factor raises."""
    p = _c(p)
    fine = (p > 0) & (p < 1) & (F.lit(factor) >= 1) & (F.lit(factor) * p < 1)
    return F.when(fine, (1 / F.lit(float(factor)) - p) / (1 - p)).otherwise(F.raise_error("prevalence and factor do not fit").cast("double"))


def sampled_probability(p, s) -> Column:
    p, s = _c(p), _c(s)
    return p / (p + s * (1 - p))


def restore_probability(q, s) -> Column:
    """Undoes ``sampled_probability``; in [0, 1]."""
    q, s = _c(q), _c(s)
    return F.least(F.greatest(s * q / (1 - q * (1 - s)), F.lit(0.0)), F.lit(1.0))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def logit(p, clip: float = 1e-6) -> Column:
    p = F.least(F.greatest(_c(p), F.lit(clip)), F.lit(1 - clip))
    return F.log(p / (1 - p))


def hybrid_transforms(f, tau, clip: float = 1e-6) -> tuple[Column, Column]:
    """logit f, and logit(f + tau) - logit f."""
    f, tau = _c(f), _c(tau)
    base = logit(f, clip)
    return base, logit(f + tau, clip) - base


def hybrid_effect(a, b, coefficients: list[float]) -> Column:
    """Effect on the probability scale: baseline c0 + c1 a (+ c2 b), and what treatment adds to it.

    Three coefficients: intercept, slope, treatment. Six: those of baseline (1, a, b), then of treatment (1, a, b).
    """
    a, b, c = _c(a), _c(b), [F.lit(float(x)) for x in coefficients]
    if len(c) == 3:
        base, lift = c[0] + c[1] * a, c[2]
    elif len(c) == 6:
        base, lift = c[0] + c[1] * a + c[2] * b, c[3] + c[4] * a + c[5] * b
    else:
        raise ValueError("three or six coefficients")
    return sigmoid(base + lift) - sigmoid(base)


def pattern_id(flags: list[Column]) -> Column:
    """Flags as bits, the first lowest; 62 at most."""
    if len(flags) > 62:
        raise ValueError("at most 62 flags")
    return reduce(lambda x, y: x + y, [F.shiftleft(f.cast("bigint"), i) for i, f in enumerate(flags)])


def render_pattern(key, n: int) -> Column:
    """``.`` for a set flag, ``O`` for one that is not, the first flag first."""
    return F.translate(F.reverse(F.lpad(F.bin(_c(key)), n, "0")), "10", ".O")


def uniform_digits(row_id, replicate, seed: int) -> Column:
    """The eight hexadecimal digits behind ``uniform``, which order as it does and cost less to make."""
    text = F.concat_ws(":", _c(row_id).cast("string"), _c(replicate).cast("string") if not isinstance(replicate, int) else F.lit(str(replicate)), F.lit(str(seed)))
    return F.substring(F.md5(text), 1, 8)


def uniform(row_id, replicate, seed: int) -> Column:
    """A number in [0, 1) from md5, the same in any engine that has md5."""
    return F.conv(uniform_digits(row_id, replicate, seed), 16, 10).cast("bigint") / F.lit(4294967296.0)


#: The distribution function of a Poisson count with mean 1.
POISSON = [0.367879441171442, 0.735758882342885, 0.919698602928606, 0.981011843123846, 0.996340153172656, 0.999405815182418, 0.999916758850712]


def poisson_weight(u: Column) -> Column:
    return reduce(lambda x, y: x + y, [(u >= c).cast("int") for c in POISSON])
