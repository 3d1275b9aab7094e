"""Special functions against their definitions."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hornbeam.functions import special as S


def simpson(f, a, b, n=20_000):
    h = (b - a) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 1e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.log_gamma(F.col("x")).alias("v")).collect()
    assert all(math.isclose(r["v"], math.lgamma(r["x"]), rel_tol=1e-12, abs_tol=1e-12) for r in got)


def test_normal_and_chi_square_tails(spark):
    rows = [(z, k) for z in (-9.0, -2.5, -0.1, 0.0, 0.3, 1.96, 4.0, 8.5, 20.0) for k in (1, 2, 5, 40)] + [(None, 3)]
    d = spark.createDataFrame(rows, "z double, k int")
    for r in d.select("z", "k", S.normal_tail(F.col("z")).alias("n"), S.chi_square_tail(F.col("z"), F.col("k")).alias("c")).collect():
        if r["z"] is None:
            assert r["n"] is None
            continue
        assert math.isclose(r["n"], 0.5 * math.erfc(r["z"] / math.sqrt(2)), rel_tol=1e-10, abs_tol=1e-300)
        x, k = max(r["z"], 0.0), r["k"]
        if k == 2:
            want = math.exp(-x / 2)
        elif k % 2 == 0:
            want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
        else:
            want = math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * sum((x / 2) ** (i + 0.5) / math.gamma(i + 1.5) for i in range((k - 1) // 2))
        assert math.isclose(r["c"], want, rel_tol=1e-9)


def test_incomplete_beta_and_correlation(spark):
    rows = [(a, b, x) for a, b in ((0.5, 0.5), (2.0, 3.0), (10.0, 0.5), (0.5, 30.0), (400.0, 0.5)) for x in (0.0, 0.01, 0.3, 0.5, 0.9, 0.999, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double, x double").select("*", S.beta_i(F.col("a"), F.col("b"), F.col("x")).alias("v")).collect()
    for r in got:
        a, b, x = r["a"], r["b"], r["x"]
        # x = sin^2 takes the edges out of the integral
        f = lambda t: 2 * math.sin(t) ** (2 * a - 1) * math.cos(t) ** (2 * b - 1)  # noqa: B023, E731
        want = simpson(f, 0.0, math.asin(math.sqrt(x))) / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        assert r["v"] == pytest.approx(want, abs=2e-8)
    d = spark.createDataFrame([(0.0, 10), (0.5, 3), (0.9, 12), (-1.0, 5), (1e-3, 2_000_000), (None, 9)], "r double, n long")
    p = {x["n"]: x["p"] for x in d.select("n", S.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()}
    assert p[10] == pytest.approx(1) and p[3] == pytest.approx(2 / 3) and p[5] == 0 and p[9] is None
    t = 0.9 * math.sqrt(10 / (1 - 0.81))
    density = lambda x: math.gamma(5.5) / math.sqrt(10 * math.pi) / math.gamma(5) * (1 + x * x / 10) ** -5.5
    assert p[12] == pytest.approx(1 - 2 * simpson(density, 0, t), rel=1e-6)
    assert p[2_000_000] == pytest.approx(math.erfc(math.sqrt(2) / math.sqrt(2)), rel=1e-4)


def test_exact_u(spark):
    rows, want = [], []
    for n, m in ((1, 1), (1, 4), (2, 3), (3, 2), (4, 4), (5, 3), (2, 7)):
        us = [sum(c) - n * (n - 1) // 2 for c in combinations(range(n + m), n)]
        for u in range(n * m + 2):
            rows.append((u, n, m))
            want.append(sum(x >= u for x in us) / len(us))
    rows.append((8 * 300 // 2, 8, 300))
    got = [r[0] for r in spark.createDataFrame(rows, "u long, n long, m long").coalesce(1).select(S.exact_u_tail(F.col("u"), F.col("n"), F.col("m"))).collect()]
    assert got[:-1] == pytest.approx(want, abs=1e-12) and 0.5 < got[-1] < 0.51
