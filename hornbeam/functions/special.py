"""Special functions as columns: log-gamma, incomplete gamma and beta, and tails of the distributions that tests need.

All are loops of a few hundred steps over a struct inside one expression, evaluated in the JVM; they are meant for summed
rows.  Arguments outside a function's domain give null, nulls stay null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of Lanczos' approximation of the gamma function with g = 7 and nine terms.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """For x >= 0.5."""
    y = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(total)


def _loop(steps: Column, start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, step)


def _bounded(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def gamma_q(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function: a series for the lower part below a + 1, a continued fraction above."""
    front = F.exp(-x + a * F.log(x) - log_gamma(a))
    steps = F.least(F.lit(60) + 8 * F.ceil(F.sqrt(F.abs(a))), F.lit(5000))
    d = lambda v: F.coalesce(v, F.lit(0.0)).cast("double")
    series = _loop(steps, F.struct(d(1 / a).alias("term"), d(1 / a).alias("sum")), lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum")))["sum"]
    b0 = x + 1 - a
    # modified Lentz: c and d are the two tails of the fraction, h the value so far
    start = F.struct(d(b0).alias("b"), F.lit(1 / _TINY).alias("c"), d(1 / _bounded(b0)).alias("d"), d(1 / _bounded(b0)).alias("h"))

    def lentz(s, i):
        an, b = -i * (i - a), s["b"] + 2
        one = 1 / _bounded(an * s["d"] + b)
        c = _bounded(b + an / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), one.alias("d"), (s["h"] * one * c).alias("h"))

    fraction = _loop(steps, start, lentz)["h"]
    value = F.when(x < a + 1, 1 - front * series).otherwise(front * fraction)
    return F.when(x == 0, 1.0).when((a > 0) & (x > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def beta_i(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    front = F.exp(log_gamma(a + b + 1) - F.log(a + b) - _log_gamma_any(a) - _log_gamma_any(b) + a * F.log(x) + b * F.log(1 - x))
    steps = F.least(F.lit(60) + 4 * F.ceil(F.sqrt(F.greatest(a, b))), F.lit(5000))
    d0 = F.coalesce(1 / _bounded(1 - (p + q) * y / (p + 1)), F.lit(0.0))
    # a step takes the even and the odd coefficient; p, q and y ride along so that they are made once
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), F.coalesce(p, F.lit(1.0)).alias("p"), F.coalesce(q, F.lit(1.0)).alias("q"), F.coalesce(y, F.lit(0.0)).alias("y"))

    def lentz(s, i):
        p, q, y = s["p"], s["q"], s["y"]
        even = i * (q - i) * y / ((p + 2 * i - 1) * (p + 2 * i))
        d1 = 1 / _bounded(1 + even * s["d"])
        c1 = _bounded(1 + even / s["c"])
        odd = -(p + i) * (p + q + i) * y / ((p + 2 * i) * (p + 2 * i + 1))
        d2 = 1 / _bounded(1 + odd * d1)
        c2 = _bounded(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"), p.alias("p"), q.alias("q"), y.alias("y"))

    value = front * _loop(steps, start, lentz)["h"] / p
    value = F.when(swap, 1 - value).otherwise(value)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when((a > 0) & (b > 0) & x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def _log_gamma_any(x: Column) -> Column:
    return log_gamma(x + 1) - F.log(x)


def normal_tail(z: Column) -> Column:
    """P(Z >= z)."""
    half = gamma_q(F.lit(0.5), z * z / 2) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x)."""
    return gamma_q(df / 2.0, F.greatest(x, F.lit(0.0)) / 2.0)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, from the t distribution with n - 2 degrees of freedom; 0 where it is 1 or -1."""
    df = (n - 2).cast("double")
    return F.when(F.abs(r) >= 1, 0.0).otherwise(beta_i(df / 2, F.lit(0.5), 1 - r * r))


def exact_u_tail(u: Column, n: Column, m: Column) -> Column:
    """P(U >= u) of the Mann-Whitney statistic of samples of n and m values without ties.

    The number of orders with each U are the coefficients of a Gaussian binomial: with k the smaller side and N the other,
    the product over i = 1..k of (1 - q^(N+i)) / (1 - q^i), kept up to the middle, as the distribution is symmetric.
    Dividing by 1 - q^i is multiplying by 1 + q^i, 1 + q^2i, 1 + q^4i, ... as far as the array goes.  An array has k * N / 2
    numbers, so the smaller side should be small.
    """
    k, big = F.least(n, m).cast("int"), F.greatest(n, m).cast("int")
    size = (F.floor(k * big / 2) + 1).cast("int")

    def shifted(a, by, sign):
        return F.transform(a, lambda x, j: x + sign * F.coalesce(F.get(a, j - by), F.lit(0.0)))

    def factor(a, i):
        a = F.when(big + i < F.size(a), shifted(a, big + i, -1)).otherwise(a)
        doublings = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(a) / i)).cast("int")))
        return F.aggregate(doublings, a, lambda b, e: shifted(b, (i * F.pow(F.lit(2.0), e)).cast("int"), 1))

    one = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    ways = F.aggregate(F.sequence(F.lit(1), k), one, factor)
    below = lambda top: F.aggregate(F.slice(ways, F.lit(1), F.greatest(F.lit(0), top + 1)), F.lit(0.0), lambda s, x: s + x)
    whole = F.exp(log_gamma((k + big + 1).cast("double")) - log_gamma((k + 1).cast("double")) - log_gamma((big + 1).cast("double")))
    least = F.ceil(u).cast("int")
    mirrored = k * big - least  # P(U >= u) = P(U <= kN - u)
    tail = F.when(mirrored < size, below(mirrored) / whole).otherwise(1 - below(least - 1) / whole)
    return F.when((k > 0) & u.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
