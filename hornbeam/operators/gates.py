"""Scores made anew under interventions: deductions, caps and gates as tables, compiled into one plan.

A rule says what a finding of a biomarker costs and which category it counts to, a cap bounds a category's total, and an
intervention leaves a biomarker out where a unit's size is below a floor.  Findings are summed once for each unit and
biomarker of the rules; interventions only choose among these sums, so findings are not multiplied by interventions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.operators import ranking as R
from hornbeam.operators import resampling as B
from hornbeam.operators.groups import severity_weight
from hornbeam.sources.store import written


@dataclass(frozen=True)
class Rules:
    """``deductions``: biomarker, category and cost for each step of severity.  Findings of other biomarkers do not count."""

    deductions: tuple[tuple[str, str, float], ...]
    caps: dict[str, float]
    best: float = 10.0
    worst: float = 1.0


@dataclass(frozen=True)
class Intervention:
    """``biomarker`` is left out of units with ``size < floor``; an infinite floor leaves it out of all, none of none."""

    label: str
    biomarker: str | None = None
    floor: float = 0.0


def rescore(units: DataFrame, findings: DataFrame, rules: Rules, interventions: list[Intervention]) -> DataFrame:
    """``units`` with ``intervention`` and ``score``, a row for each intervention; a unit without findings has the best score.
    Repeated units each keep their row; null severities cost one step, null sizes are below no floor."""
    names = [f"__d{i}" for i in range(len(rules.deductions))]
    paid = findings.where(F.col("biomarker").isin([b for b, _, _ in rules.deductions])).groupBy(F.col("unit_id").alias("__unit")).agg(
        *(F.sum(F.when(F.col("biomarker") == b, severity_weight(F.col("severity"))).otherwise(0)).alias(n) for n, (b, _, _) in zip(names, rules.deductions))
    )
    joined = units.join(paid, F.col("unit_id") == F.col("__unit"), "left").fillna(0, names)
    size = F.col("size").cast("double")

    def score(way: Intervention):
        total = F.lit(0.0)
        for category, cap in rules.caps.items():
            parts = F.lit(0.0)
            for n, (b, c, cost) in zip(names, rules.deductions):
                if c == category:
                    amount = F.col(n) * F.lit(cost)
                    parts = parts + (F.when(size < F.lit(way.floor), 0.0).otherwise(amount) if b == way.biomarker else amount)
            total = total + F.least(F.lit(cap), parts)
        return F.round(F.greatest(F.lit(rules.worst), F.lit(rules.best) - total), 6)

    pairs = F.array(*(F.struct(F.lit(w.label).alias("intervention"), score(w).alias("score")) for w in interventions))
    kept = [c for c in units.columns if c not in ("intervention", "score")]
    return joined.select(*kept, F.inline(pairs))


def gate_table(units: DataFrame, findings: DataFrame, rules: Rules, interventions: list[Intervention], bands: list[float], reps: int, seed: str) -> DataFrame:
    """``intervention, corpus_auc, mean_auc, mean_popt, band_1.., delta, lo, hi``.

    AUC over all units, its mean and Popt's over the clusters with both outcomes, AUC of each size band (up to each of
    ``bands``, null with one class), and the change of the first against the first intervention, with the values at positions
    ``int(q * n)`` of ``reps`` resamples of units.  ``units`` has cluster, ord, size, defects.
    """
    base = interventions[0].label
    t = rescore(units.select("unit_id", "cluster", "ord", "size", "defects"), findings, rules, interventions)
    band = F.lit(len(bands) + 1)
    for i, cut in reversed(list(enumerate(bands, 1))):
        band = F.when(F.col("size") <= cut, i).otherwise(band)
    t = written(t.withColumn("risk", F.lit(rules.best) - F.col("score")).withColumn("band", band), "gates")
    hit = "defects > 0"
    out = R.auc(t, ["intervention"], "risk", hit).select("intervention", F.col("auc").alias("corpus_auc"))
    by = ["intervention", "cluster"]
    per = R.auc(t, by, "risk", hit, None).join(R.popt(t, by, "score").select(*by, "popt"), by).where("auc is not null")
    out = out.join(per.groupBy("intervention").agg(F.avg("auc").alias("mean_auc"), F.avg("popt").alias("mean_popt")), "intervention", "left")
    told = R.auc(t, ["intervention", "band"], "risk", hit, None)
    out = out.join(told.groupBy("intervention").agg(*(F.max(F.when(F.col("band") == i, F.col("auc"))).alias(f"band_{i}") for i in range(1, len(bands) + 2))), "intervention", "left")
    start = t.where(F.col("intervention") == base).select(F.col("unit_id").alias("__unit"), F.col("risk").alias("base"))
    both = t.join(start, F.col("unit_id") == F.col("__unit")).select("intervention", "base", "risk", F.expr(hit).cast("int").alias("y"), "ord")
    c = written(B.cells(both, ["intervention", "base", "risk", "y"], "ord", seed), "cells")
    auc = lambda risk: B.by_draw(B.areas(c, "intervention", [F.col(risk)], F.col("y"), 1 - F.col("y"), reps=reps), risk).select("g", "at", risk)
    change = auc("risk").join(auc("base"), ["g", "at"]).select(F.col("g").alias("intervention"), F.round(F.col("risk") - F.col("base"), 9).alias("delta"))
    values = F.array_sort(F.collect_list("delta"))  # ``reps`` numbers
    at = lambda q: F.element_at("v", F.floor(q * F.size("v")).cast("int") + 1)
    change = change.groupBy("intervention").agg(values.alias("v"), F.avg("delta").alias("delta")).select("intervention", "delta", at(0.025).alias("lo"), at(0.975).alias("hi"))
    return out.join(change, "intervention", "left")
