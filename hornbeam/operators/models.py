"""Grouped cross-validated logistic models by Newton's method, and a mixed model.

Each Newton step is one aggregate: the gradient and the curvature are sums over rows, so only their few numbers reach the
driver, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.sources.store import discard, written


def scaled(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; a constant one has deviation 1."""
    row = train.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (float(row[f"m{i}"] or 0), float(row[f"s{i}"] or 0) or 1.0) for i, c in enumerate(features)}


def fit(train: DataFrame, features: list[str], label: str, c: float = 1.0, balanced: bool = True, steps: int = 12, keep: bool = True):
    """A logistic model on standardised features: coefficients, offset and the scaling, or None with one class.

    The objective is half the squared weights plus ``c`` times the weighted losses, with a free offset; ``balanced`` gives
    each class half of the weight.  With ``keep`` the features are written once, as every step reads them: what they are made of
    is not made again; without, ``train`` is a written table itself.
    """
    train = written(train.select(label, *features), "train") if keep else train
    scale = scaled(train, features)
    data = train.select(F.col(label).cast("double").alias("__y"), *(((F.col(x) - m) / s).alias(f"__x{i}") for i, (x, (m, s)) in enumerate(scale.items())))
    counts = {int(r[0]): r[1] for r in data.groupBy("__y").count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        if keep:
            discard(train)
        return None
    weight = F.when(F.col("__y") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0])) if balanced else F.lit(1.0)
    k = len(features)
    data = data.withColumn(f"__x{k}", F.lit(1.0)).withColumn("__w", weight * c)
    w = np.zeros(k + 1)
    ridge = np.diag([1.0] * k + [0.0])
    for _ in range(steps):
        z = sum((F.col(f"__x{i}") * float(w[i]) for i in range(k + 1)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        d = data.withColumn("__e", (p - F.col("__y")) * F.col("__w")).withColumn("__h", p * (1 - p) * F.col("__w"))
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        row = d.agg(*(F.sum(F.col("__e") * F.col(f"__x{i}")) for i in range(k + 1)), *(F.sum(F.col("__h") * F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in pairs)).first()
        gradient = np.array(row[: k + 1], float) + ridge @ w
        curve = ridge.copy()
        for (i, j), v in zip(pairs, row[k + 1 :]):
            curve[i, j] += v
            curve[j, i] += v if i != j else 0
        step = np.linalg.solve(curve + 1e-9 * np.eye(k + 1), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    if keep:
        discard(train)
    return [float(v) for v in w[:k]], float(w[k]), scale


def predict(df: DataFrame, features: list[str], model) -> DataFrame:
    """Adds ``p``, as an expression of the features; null without a model."""
    if model is None:
        return df.withColumn("p", F.lit(None).cast("double"))
    weights, offset, scale = model
    z = F.lit(offset)
    for w, x in zip(weights, features):
        m, s = scale[x]
        z = z + w * (F.col(x) - m) / s
    return df.withColumn("p", 1 / (1 + F.exp(-z)))


def out_of_fold(df: DataFrame, fold: str, features: list[str], label: str, c: float = 1.0, balanced: bool = True) -> DataFrame:
    """``df`` with ``p`` from a model that has not seen the row's fold.  There are as many fits as folds; folds are few."""
    out = None
    df = written(df, "folds")  # read by every step of every fit
    for (value,) in df.select(fold).distinct().orderBy(fold).collect():
        model = fit(df.where(~F.col(fold).eqNullSafe(F.lit(value))), features, label, c, balanced, keep=False)
        part = predict(df.where(F.col(fold).eqNullSafe(F.lit(value))), features, model)
        out = part if out is None else out.unionByName(part)
    return out


def folds(df: DataFrame, label: str, key: str, n: int = 10, seed: str = "7") -> DataFrame:
    """Adds ``fold``: round-robin within each class in an order hashed from the key."""
    from hornbeam.operators.ranking import running

    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    d = df.withColumn("__h", hashed).withColumn("__one", F.lit(1).cast("long"))
    at = running(d, [label], [F.col("__h"), F.col(key)], {"__at": "__one"})
    return at.withColumn("fold", F.pmod(F.col("__at") - 1, F.lit(n)).cast("int")).drop("__h", "__one", "__at")


@dataclass
class Mixed:
    """``fixed`` effects (with ``intercept``) on standardised features, deviation ``sd`` of the groups' intercepts, and the written
    tables ``rows(y, g, x0..)`` of the fit and ``groups(g, u, ...)`` of its last step."""

    fixed: dict[str, float]
    sd: float
    rows: DataFrame
    groups: DataFrame


def mixed(df: DataFrame, features: list[str], label: str, group: str, prior_sd: float = 2.0, steps: int = 10, tolerance: float = 1e-3, least: float = 1e-4) -> Mixed:
    """A logistic model with several fixed effects and a random intercept for each ``group``, by Laplace's approximation.

    Fixed effects have a normal prior with ``prior_sd``.  Every step is Newton's for all effects at once: a group contributes its
    residual, its curvature and its curvature with each feature, all sums over its rows, and is eliminated by itself (the
    Hessian is an arrow), so the driver sees sums over groups alone and groups' effects stay in a written table.  The
    variance is set after each step so that it is the mean of squared modes and posterior variances, but not below
    ``least``.  Null groups are a group; rows with a null label or feature are left out; without rows or with one class all
    effects are 0 and the deviation is NaN.
    """
    whole = df.where(reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in [label, *features])))
    scale, k = scaled(whole, features), len(features)
    names = ["intercept", *features]
    x = [F.lit(1.0).alias("x0"), *(((F.col(c) - m) / s).alias(f"x{i}") for i, (c, (m, s)) in enumerate(scale.items(), 1))]
    rows = written(whole.select(F.col(label).cast("double").alias("y"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), *x), "mixed-rows")
    groups = written(rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.lit(0.0).alias("u")), "mixed-groups")
    seen = rows.agg(F.countDistinct("y"), F.approx_count_distinct("g")).first()
    if seen[0] < 2:
        return Mixed(dict.fromkeys(names, 0.0), float("nan"), rows, groups)
    beta, var, ridge, part = np.zeros(k + 1), 1.0, 1 / prior_sd**2, None
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for _ in range(steps):
        before, part = part, written(_by_group(rows, groups, _numbers(df, beta, var), k), "mixed-part")
        if before is not None:
            discard(before)
        # sums over groups: residuals and curvature of the fixed effects with the groups taken out
        got = part.agg(
            *(F.sum(F.col(f"e{i}") - F.col(f"b{i}") * F.col("r") * F.col("v")) for i in range(k + 1)),
            *(F.sum(F.col(f"h{i}_{j}") - F.col(f"b{i}") * F.col(f"b{j}") * F.col("v")) for i, j in pairs),
        ).first()
        curve = ridge * np.eye(k + 1)
        for (i, j), value in zip(pairs, got[k + 1 :]):
            curve[i, j] += value
            curve[j, i] += value if i != j else 0
        step = np.linalg.solve(curve, np.array(got[: k + 1], float) - ridge * beta)
        back = reduce(lambda p, q: p + q, (F.col(f"b{i}") * F.col(f"t{i}") for i in range(k + 1)))
        move = (F.col("r") - back) * F.col("v")
        moving = part.crossJoin(F.broadcast(_numbers(df, step, 0.0).drop("var")))
        groups = moving.select("g", (F.col("u") + move).alias("u"), move.alias("move"), (1 - F.col("v") / F.col("var")).alias("worth"))
        beta = beta + step
        told = (F.sum(F.col("u") ** 2), F.sum("worth"))  # squares, and how many groups' worth the data say
        moved, squares, worth = groups.agg(F.max(F.abs("move")), *told).first()
        was, var = var, max(float(squares) / max(float(worth), 1e-12), least)
        if max(moved, np.abs(step).max(), abs(var / was - 1) if var > least else 0.0) < tolerance:
            break
    return Mixed(dict(zip(names, map(float, beta))), math.sqrt(var), rows, written(groups.select("g", "u"), "mixed-groups"))


def _numbers(df: DataFrame, values: np.ndarray, var: float) -> DataFrame:
    """``t0.., var`` as a table of one row: as literals they would be compiled anew at every step."""
    names = [f"t{i}" for i in range(len(values))]
    return df.sparkSession.createDataFrame([(*map(float, values), float(var))], ", ".join(f"{n} double" for n in (*names, "var")))


def _by_group(rows: DataFrame, groups: DataFrame, at: DataFrame, k: int) -> DataFrame:
    """For each group its effect ``u``, curvature with each feature ``b_i``, its share of the fixed effects' residuals ``e_i`` and
    curvature ``h_i_j``, its own slope ``r`` and the variance ``v`` that its effect is left with; ``at`` has the fixed effects."""
    d = rows.join(groups.select("g", "u"), "g").crossJoin(F.broadcast(at))
    z = reduce(lambda p, q: p + q, (F.col(f"x{i}") * F.col(f"t{i}") for i in range(k + 1))) + F.col("u")
    d = d.withColumn("p", 1 / (1 + F.exp(-z)))
    d = d.withColumn("e", F.col("y") - F.col("p")).withColumn("w", F.col("p") * (1 - F.col("p")))
    sums = d.groupBy("g", "u", "var").agg(
        F.sum("e").alias("s"), F.sum("w").alias("d"), *(F.sum(F.col("w") * F.col(f"x{i}")).alias(f"b{i}") for i in range(k + 1)),
        *(F.sum(F.col("e") * F.col(f"x{i}")).alias(f"e{i}") for i in range(k + 1)), *(F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)),
    )
    return sums.withColumns({"r": F.col("s") - F.col("u") / F.col("var"), "v": 1 / (F.col("d") + 1 / F.col("var"))})


def slopes(m: Mixed, prior_sd: float = 2.0) -> DataFrame:
    """``effect, slope`` of the fitted objective at its effects: 0 for each where it is greatest.  ``groups`` has the greatest
    step that a group's slope asks for, ``variance`` how far the variance is from what the effects say."""
    k = len(m.fixed) - 1
    beta = np.array(list(m.fixed.values()))
    part = _by_group(m.rows, m.groups, _numbers(m.rows, beta, m.sd**2), k)
    sums = part.agg(
        *((F.sum(f"e{i}") - float(beta[i]) / prior_sd**2).alias(n) for i, n in enumerate(m.fixed)), F.max(F.abs(F.col("r") * F.col("v"))).alias("groups"),
        (F.avg(F.col("u") ** 2 + F.col("v")) - F.first("var")).alias("variance"),
    )
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("effect"), F.col(f"`{n}`").alias("slope")) for n in sums.columns))))
