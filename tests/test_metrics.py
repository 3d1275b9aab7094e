"""The micro-fixture, degenerate inputs and algebraic properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornbeam.operators import groups as G
from hornbeam.operators import inference as I
from hornbeam.operators import models as M
from hornbeam.operators import paired as P
from hornbeam.operators import ranking as R
from hornbeam.operators import resampling as B

U8 = [
    ("a", "r1", 0, 2.0, 300, 4), ("b", "r1", 1, 3.5, 120, 1), ("c", "r1", 2, 4.0, 80, 0), ("d", "r1", 3, 6.0, 200, 2),
    ("e", "r2", 4, 8.0, 40, 0), ("f", "r2", 5, 8.0, 60, 1), ("g", "r2", 6, 9.5, 30, 0), ("h", "r2", 7, 10.0, 15, 0),
]
SCHEMA = "unit_id string, cluster string, ord long, score double, size long, defects long"
RISK, POSITIVE = "10 - score", "defects > 0"


@pytest.fixture
def u8(spark):
    return spark.createDataFrame(U8, SCHEMA)


def test_auc_popt_effort(u8):
    assert R.auc(u8, [], RISK, POSITIVE).first()["auc"] == 27 / 32
    p = R.popt(u8, [], "score").first()
    assert p["popt"] == pytest.approx(0.7319587629)
    assert (p["area_model"], p["area_optimal"], p["area_worst"]) == pytest.approx((0.5665680473, 0.6434911243, 0.3565088757))
    e = R.effort(u8, [], "score").first()
    assert (e["files"], e["inspected"], e["precision"], e["recall_defects"], e["recall_files"]) == (1, 300, 1.0, 0.5, 0.25)
    assert R.precision_at_k(u8, "score", 3).first()["precision"] == pytest.approx(2 / 3)


def test_correlations(u8):
    x = R.partial_spearman(u8, [], "score", "defects", "size").first()
    assert (x["rho_xy"], x["rho_xz"], x["rho_yz"], x["partial"]) == pytest.approx((-0.6680406153, -0.9221722217, 0.8556058191, 0.6042484535))
    assert R.pearson(u8, [], "score", "defects").first()["r"] == pytest.approx(-0.6652346175)


def test_groups(u8, spark):
    d = G.density_ratio(u8, [], 4, 8).first()
    assert (d["low_n"], d["low_mean"], d["high_n"], d["ratio"]) == (2, 2.5, 2, math.inf)
    b = {r["bucket"]: (r["files"], r["defects"], round(r["per_k"], 6)) for r in G.density_by_bucket(u8).collect()}
    assert b == {"[0-4)": (2, 5, 11.904762), "[4-6)": (1, 0, 0.0), "[6-8)": (1, 2, 10.0), "[8-10]": (4, 1, 6.896552)}
    k = G.kruskal(u8, [], F.when(F.col("score") >= 8, "g").when(F.col("score") >= 4, "y").otherwise("r"), "defects").first()
    assert (k["groups"], k["h"], k["p"]) == (3, pytest.approx(3.1643835616), pytest.approx(0.2055241403))
    marks = spark.createDataFrame([(x, "m") for x in "abd"], "unit_id string, biomarker string")
    assert G.with_without(u8, marks, ["m", "none"], "defects").where("biomarker = 'm'").first()["delta"] == pytest.approx(14 / 15)


def test_delong(u8):
    x = I.delong(u8.withColumn("a", F.expr(RISK)).withColumn("b", F.col("size").cast("double")), [], "a", "b", POSITIVE).first()
    assert (x["auc_a"], x["auc_b"], x["var_a"], x["cov"], x["var_b"], x["z"]) == pytest.approx((0.84375, 0.9375, 0.0227864583, 0.01171875, 0.0078125, -1.1078234188))


def test_degenerate(spark):
    zero = spark.createDataFrame([(*r[:5], 0) for r in U8], SCHEMA)
    assert R.auc(zero, [], RISK, POSITIVE).first()["auc"] == 0.5
    assert R.auc(zero, [], RISK, POSITIVE, degenerate=None).first()["auc"] is None
    assert R.popt(zero, [], "score").first()["popt"] is None
    assert R.spearman(zero, [], "score", "defects").first()["rho"] is None
    assert G.kruskal(zero, [], F.lit("x"), "defects").first()["h"] is None
    empty = zero.limit(0)
    assert R.auc(empty, ["cluster"], RISK, POSITIVE).collect() == []
    assert R.effort(empty, ["cluster"], "score").collect() == []
    flat = spark.createDataFrame([("x", "r", i, 5.0, 0, 1) for i in range(4)], SCHEMA)  # size 0 counts as 1
    assert R.popt(flat, [], "score").first()["popt"] == 0.5
    assert R.effort(flat, [], "score").first()["files"] == 1


rows = st.lists(st.tuples(st.integers(0, 6), st.integers(1, 9), st.integers(0, 2)), min_size=3, max_size=25)


@settings(max_examples=8, deadline=None)
@given(rows)
def test_properties(spark, data):
    df = spark.createDataFrame([(str(i), "r", i, float(s), z, d) for i, (s, z, d) in enumerate(data)], SCHEMA)
    pos, neg = [s for s, _, d in data if d], [s for s, _, d in data if not d]
    pairs = [(p < n) + (p == n) / 2 for p in pos for n in neg]
    want = sum(pairs) / len(pairs) if pairs else 0.5
    assert R.auc(df, [], RISK, POSITIVE).first()["auc"] == pytest.approx(want)
    assert R.auc(df, [], "exp(10 - score)", POSITIVE).first()["auc"] == pytest.approx(want)
    assert R.auc(df, [], "score", POSITIVE).first()["auc"] == pytest.approx(1 - want)
    assert R.auc(df.repartition(3), [], RISK, POSITIVE).first()["auc"] == pytest.approx(want)
    p = R.popt(df, [], "score").first()
    if p["popt"] is not None:
        assert -1e-9 <= p["popt"] <= 1 + 1e-9
        assert p["area_worst"] == pytest.approx(1 - p["area_optimal"])


def test_running_sums_over_buckets(spark):
    data = [(random.Random(3).random() if i % 7 else 0.5, i) for i in range(3000)]
    df = spark.createDataFrame(data, "x double, ord long").withColumn("one", F.lit(1))
    got = R.running(df, [], [F.col("x"), F.col("ord")], {"at": "one"}).orderBy("x", "ord").collect()
    assert [r["at"] for r in got] == list(range(1, 3001))


def test_paired_and_tokens(spark):
    runs = [("t1", .2, 8, .1, 8), ("t2", .1, 9, .12, 9), ("t3", .3, 7, .1, 8), ("t4", .15, 9, .15, 8), ("t5", .25, 6, .05, 6)]
    rows = [(t, arm, i, c, float(s)) for i, (t, c0, s0, c2, s2) in enumerate(runs) for arm, c, s in (("C0", c0, s0), ("C2", c2, s2))] + [("t6", "C0", 9, .1, None)]
    p = P.pairs(spark.createDataFrame(rows, "task string, arm string, ord long, cost double, score double"), "C0", "C2", ["cost", "score"])
    assert p.count() == 5
    m = P.metric_block(p, ["cost"]).first()
    assert (m["mean_a"], m["mean_b"], m["tag"]) == (pytest.approx(0.2), pytest.approx(0.104), "b")
    d = p.select(F.lit("x").alias("g"), "ord", (F.col("b_cost") - F.col("a_cost")).alias("d"))
    assert P.trimmed_mean(d, ["g"], "d", "ord").first()["trimmed"] == pytest.approx(-0.1)
    t = [("r", 1000, 100, 50, None), ("r", 400, 0, 100, None), ("r", 90, 30, 10, None), ("r", 0, 0, 0, "all-files-excluded")]
    x = P.token_summary(spark.createDataFrame(t, "repo string, naive long, diff long, context long, skipped string")).where("repo is null").first()
    assert (x["pooled_naive"], x["pooled_diff"], x["mean_ratio_naive"], x["mean_ratio_diff"], x["median_ratio"], x["skipped"]) == (9.3125, 0.8125, 11.0, 2.5, 9.0, 1)


def test_fifo_pairs_against_a_queue(spark):
    rng = random.Random(5)
    rows = [(run, i, rng.choice(["call", "result"])) for run in range(6) for i in range(40)]
    want = {}
    for run in range(6):
        queue = []
        for _, i, kind in (r for r in rows if r[0] == run):
            if kind == "call":
                queue.append(i)
                want[run, i] = None
            elif queue:
                want[run, queue.pop(0)] = i
    got = P.fifo_pairs(spark.createDataFrame(rows, "run int, ord int, kind string")).collect()
    assert {(r["run"], r["call_ord"]): r["result_ord"] for r in got} == want


def test_logistic_fit_is_stationary(spark):
    rng = random.Random(1)
    data = [(x := rng.gauss(0, 1), y := rng.gauss(3, 2), int(rng.random() < 1 / (1 + math.exp(-x + y / 4)))) for _ in range(300)]
    df = spark.createDataFrame(data, "x double, y double, label int")
    (w1, w2), b, scale = M.fit(df, ["x", "y"], "label")
    n1 = sum(d[2] for d in data)
    weight = {1: 300 / (2 * n1), 0: 300 / (2 * (300 - n1))}
    g = [w1, w2, 0.0]
    for x, y, t in data:
        z = [(x - scale["x"][0]) / scale["x"][1], (y - scale["y"][0]) / scale["y"][1], 1.0]
        e = (1 / (1 + math.exp(-(w1 * z[0] + w2 * z[1] + b))) - t) * weight[t]
        g = [a + e * v for a, v in zip(g, z)]
    assert max(map(abs, g)) < 1e-6
    assert M.fit(df.where("label = 1"), ["x"], "label") is None


def test_drawn_weights_are_poisson(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(0, B.PRIME, 300), r.integers(1, B.PRIME, 300)
    for n in (1, 7, 5000):
        w = B.drawn(np.full(300, n), a, b, np.arange(200))
        assert (w == np.floor(w)).all() and abs(w.mean() - n) < 0.02 * n + 0.02 and abs(w.var() / n - 1) < 0.05
    one = B.drawn(np.ones(300, int), a, b, np.arange(200))
    for k in range(5):
        want = 60_000 * math.exp(-1) / math.factorial(k)
        assert abs((one == k).sum() - want) < 6 * math.sqrt(want)


def test_areas_equal_those_of_repeated_rows(spark, monkeypatch):
    """The arrays against rows written out as often as they are drawn, over several ranges, with ties and two clusters."""
    monkeypatch.setattr(B, "STEP", 64)
    r = random.Random(6)
    rows = [(r.choice("pq"), float(r.randrange(6)), r.randrange(2), i) for i in range(80)]
    d = spark.createDataFrame(rows, "cluster string, risk double, y int, ord long")
    c = B.cells(d, ["cluster", "risk", "y"], "ord", "9")
    kept = [x.asDict() for x in c.collect()]
    assert sum(x["n"] for x in kept) == 80

    def auc(cells, weights):
        pos, neg = ([(x["risk"], w) for x, w in zip(cells, weights) if x["y"] == side and w] for side in (1, 0))
        num = sum(w * v * ((a > b) + (a == b) / 2) for a, w in pos for b, v in neg)
        den = sum(w for _, w in pos) * sum(w for _, w in neg)
        return num / den if den else None

    def drawn(cells, j):
        col = lambda k: np.array([x[k] for x in cells], np.int64)
        return B.drawn(col("n"), col("__a"), col("__b"), np.array(j)) if cells else np.zeros((0, len(j)))

    got = {(x["g"], x["at"]): x["auc"] for x in B.by_draw(B.areas(c, "cluster", [F.col("risk")], F.col("y"), 1 - F.col("y"), reps=5), "auc").collect()}
    for g in "pq":
        own = [x for x in kept if x["cluster"] == g]
        w = drawn(own, range(5))
        assert [got[g, j] for j in range(5)] == [pytest.approx(auc(own, w[:, j])) for j in range(5)]
    js = {"p": [0, 1, 4, 7], "q": [2, 3, 6]}  # two slots a resample
    draws = spark.createDataFrame(list(js.items()), "cluster string, js array<long>")
    pooled = {x["at"]: x["auc"] for x in B.by_draw(B.areas(c, None, [F.col("risk")], F.col("y"), 1 - F.col("y"), draws=draws, per=2), "auc").collect()}
    for rep in range(4):
        cells, weights = [], []
        for g, numbers in js.items():
            own, mine = [x for x in kept if x["cluster"] == g], [j for j in numbers if j // 2 == rep]
            cells += own
            weights += list(drawn(own, mine).sum(axis=1)) if mine else [0] * len(own)
        assert pooled[rep] == pytest.approx(auc(cells, weights))
    by_slot = B.areas(c, "cluster", [F.col("risk")], F.col("y"), 1 - F.col("y"), draws=draws)
    assert {x["g"]: len(x["inner"]) for x in by_slot.collect()} == {"p": 4, "q": 3}
    assert B.areas(c.limit(0), "cluster", [F.col("risk")], F.col("y"), 1 - F.col("y"), reps=5).collect() == []


def test_concordance_gives_the_pooled_auc(spark, u8):
    u = u8.withColumn("risk", 10 - F.col("score"))
    counts = u.groupBy("cluster").agg(F.count_if(F.expr(POSITIVE)).alias("p"), F.count_if(~F.expr(POSITIVE)).alias("q"))
    weights = spark.createDataFrame([("r1", 0, 2), ("r2", 0, 1), ("r1", 1, 1), ("r2", 2, 3)], "cluster string, rep long, weight long")
    got = {r["rep"]: r["auc"] for r in I.pooled_auc(I.concordance(u, "cluster", "risk", POSITIVE), counts, weights).collect()}
    for rep in range(3):
        t = u.join(weights.where(F.col("rep") == rep), "cluster")
        assert got[rep] == pytest.approx(R.auc(t, [], "risk", POSITIVE, weight=F.col("weight")).first()["auc"])


def test_ck_oof_fits_ten_folds(spark, sf_dir, monkeypatch):
    from hornbeam.plans import model_queries

    folds, whole = [], M.out_of_fold
    monkeypatch.setattr(M, "out_of_fold", lambda df, fold, *a, **b: folds.extend(r[0] for r in df.select(fold).distinct().collect()) or whole(df, fold, *a, **b))
    assert model_queries.ck_oof(spark, sf_dir).collect()
    assert sorted(folds) == list(range(10))


@pytest.mark.parametrize("name", ["cluster_ci_ratio", "pooled_boot"])
def test_bootstraps_draw_as_often_as_the_reference(spark, sf_dir, name):
    from hornbeam.plans import inference_queries

    assert inference_queries.QUERIES[name](spark, sf_dir).first()["n_boot"] == 2000


def test_jit_constants_has_every_feature(spark, sf_dir):
    from hornbeam.plans import model_queries

    got = [r["feature"] for r in model_queries.jit_constants(spark, sf_dir).collect()]
    assert got == ["entropy", "la", "ld", "nf", "nd", "ns", "exp", "offset"]


def test_mann_whitney_exact_and_normal(spark):
    from itertools import combinations

    rows = [("few", i, float(v), i < 3) for i, v in enumerate((9, 7, 8, 1, 2, 3, 7.5))]
    rows += [("ties", i, float(i // 2), i % 3 == 0) for i in range(12)] + [("many", i, i * 37 % 101 + i / 1000, i % 2 == 0) for i in range(40)]
    rows += [("one side", 1, 1.0, True), ("one side", 2, 2.0, None), ("nothing", 1, None, True), (None, 1, 5.0, True), (None, 2, 4.0, False)]
    d = spark.createDataFrame(rows, "g string, i int, v double, f boolean")
    got = {r["g"]: r for r in G.mann_whitney(d, ["g"], "f", "v", least=1).collect()}
    assert set(got) == {"few", "ties", "many", "one side", None}
    for g, r in got.items():
        a, b = ([v for h, _, v, f in rows if h == g and bool(f) == side] for side in (True, False))
        u = sum((x > y) + (x == y) / 2 for x in a for y in b)
        assert (r["n"], r["m"], r["u"]) == (len(a), len(b), u)
        assert r["exact"] == (g in ("few", "one side", None))
        if r["exact"]:
            us = [sum(c) - len(a) * (len(a) - 1) // 2 for c in combinations(range(len(a) + len(b)), len(a))]
            assert r["p"] == pytest.approx(sum(x >= u for x in us) / len(us))
    low = G.mann_whitney(d, ["g"], "f", "v").where("g = 'one side'").first()
    assert low["u"] is None and low["p"] is None and low["exact"] is None
    assert G.mann_whitney(d.limit(0), ["g"], "f", "v").collect() == []


def test_bundle_equals_the_single_metrics(spark, u8):
    from hornbeam.operators.bundle import metric_bundle

    r = random.Random(12)
    rows = [(str(i), r.choice(["a", "b", None]), i, r.randrange(12) / 2, r.randrange(0, 90), max(0, r.randrange(-3, 4))) for i in range(150)]
    rows += [("x", "one", 900, 5.0, 0, 0), ("y", "flat", 901, 5.0, 4, 2), ("z", "flat", 902, 5.0, 4, 2), ("w", "flat", 903, 5.0, 4, 2)]
    d = spark.createDataFrame(rows, u8.schema)
    by = [d.columns[1]]
    got = {r[by[0]]: r for r in metric_bundle(d, by, low=4.0).collect()}
    single = {
        ("auc",): R.auc(d, by, RISK, POSITIVE), ("popt",): R.popt(d, by, "score"), ("files", "inspected", "precision", "recall_defects", "recall_files"): R.effort(d, by, "score"),
        ("rho",): R.spearman(d, by, "score", "defects"), ("partial",): R.partial_spearman(d, by, "score", "defects", "size"), ("low_mean", "high_mean", "ratio", "low_per_k"): G.density_ratio(d, by, 4.0, 8.0),
    }
    for names, frame in single.items():
        for row in frame.collect():
            for c in names:
                assert got[row[by[0]]][c] == (pytest.approx(row[c]) if row[c] is not None else None), (row, c)
    k = {r[by[0]]: r for r in G.kruskal(d, by, F.when(F.col("score") >= 8, "g").when(F.col("score") >= 4, "y").otherwise("r"), "defects").collect()}
    assert all(got[g]["kruskal_h"] == (pytest.approx(x["h"]) if x["h"] is not None else None) for g, x in k.items())
    assert metric_bundle(d, by, least=4).where("n < 4 and auc is not null").collect() == [] and metric_bundle(d.limit(0), by).collect() == []
    assert metric_bundle(u8, []).first()["auc"] == pytest.approx(R.auc(u8, [], RISK, POSITIVE).first()["auc"])


def test_rescoring_under_interventions(spark):
    from hornbeam.operators.gates import Intervention, Rules, rescore

    rules = Rules((("a", "x", 1.0), ("b", "x", 0.5), ("c", "y", 4.0)), {"x": 3.0, "y": 20.0})
    units = spark.createDataFrame([(1, 10), (2, 100), (3, None), (4, 5), (4, 5)], "unit_id int, size int")
    found = spark.createDataFrame([(1, "a", "critical"), (1, "b", "low"), (2, "a", "low"), (2, "b", None), (3, "b", "high"), (3, "zz", "critical"), (9, "a", "low"), (4, "c", "critical")], "unit_id int, biomarker string, severity string")
    ways = [Intervention("none"), Intervention("a small", "a", 50), Intervention("no b", "b", math.inf)]
    got = sorted((r["unit_id"], r["intervention"], r["score"]) for r in rescore(units, found, rules, ways).collect())
    assert got == sorted(
        [(1, "none", 7.0), (1, "a small", 9.5), (1, "no b", 7.0), (2, "none", 8.5), (2, "a small", 8.5), (2, "no b", 9.0)]
        + [(3, "none", 8.5), (3, "a small", 8.5), (3, "no b", 8.5)]  # no size, so below no floor
        + [(4, w.label, 1.0) for w in ways] * 2
    )
    assert rescore(units.limit(0), found, rules, ways).collect() == []


def test_scans_over_ranges_with_one_long_group(spark):
    """One author, run and task with most of the rows: all ranges have parts of it."""
    from hornbeam.operators import changes as C

    r = random.Random(14)
    rows = [("big" if r.random() < 0.7 else r.choice("xyz"), i, r.choice(["call", "result", "result", "call"]), r.randrange(9) / 4) for i in range(400)]
    d = spark.createDataFrame(rows, "run string, ord long, kind string, cost double").repartition(4)
    want, queues = set(), {}
    for run, i, kind, _ in rows:
        q = queues.setdefault(run, [])
        if kind == "call":
            q.append(i)
        elif q:
            want.add((run, q.pop(0), i))
    want |= {(run, i, None) for run, q in queues.items() for i in q}
    assert {tuple(x) for x in P.fifo_pairs(d).select("run", "call_ord", "result_ord").collect()} == want
    level, low = {}, {}
    for x in sorted(R.running_low(d.withColumn("step", F.when(F.col("kind") == "call", 1).otherwise(-1).cast("long")), ["run"], [F.col("ord")], "step", "level", "low", "was").collect(), key=lambda x: x["ord"]):
        was = low.get(x["run"])
        level[x["run"]] = level.get(x["run"], 0) + (1 if x["kind"] == "call" else -1)
        low[x["run"]] = level[x["run"]] if was is None else min(was, level[x["run"]])
        assert (x["level"], x["low"], x["was"]) == (level[x["run"]], low[x["run"]], was)
    spent = {}
    for x in sorted(P.budget(d, 30.0, 1.0, ["run"]).collect(), key=lambda x: x["ord"]):
        assert x["spent"] == pytest.approx(spent.get(x["run"], 0.0)) and x["allowed"] == (spent.get(x["run"], 0.0) + 1.0 <= 30.0)
        spent[x["run"]] = spent.get(x["run"], 0.0) + x["cost"]
    seen = {}
    for x in sorted(C.experience(d.select(F.col("run").alias("author"), F.col("ord").alias("ct"), F.col("ord").alias("sha"))).collect(), key=lambda x: x["ct"]):
        assert x["exp"] == seen.get(x["author"], 0)
        seen[x["author"]] = x["exp"] + 1


def test_mixed_model_is_at_its_maximum(spark):
    r = random.Random(3)
    effect = {g: r.gauss(0, 1) for g in "abcdefgh"}
    rows = []
    for i in range(1200):
        g, x, z = r.choice("abcdefgh"), r.gauss(0, 1), r.gauss(2, 3)
        rows.append((g, x, z, int(r.random() < 1 / (1 + math.exp(-(0.8 * x - 0.3 * z + effect[g]))))))
    rows += [("a", None, 1.0, 1), ("a", 1.0, 1.0, None), (None, 0.1, 1.0, 0)]
    d = spark.createDataFrame(rows, "g string, x double, z double, y int")
    m = M.mixed(d, ["x", "z"], "y", "g")
    assert m.fixed["x"] > 0.4 and m.fixed["z"] < -0.4 and 0.4 < m.sd < 2.5 and m.groups.count() == 9
    assert all(abs(s["slope"]) < 0.05 for s in M.slopes(m).collect())
    # groups apart explain more than without them
    u = {x["g"]: x["u"] for x in m.groups.collect()}
    assert np.corrcoef([u[g] for g in effect], [effect[g] for g in effect])[0, 1] > 0.8
    one = M.mixed(d.where("y = 1"), ["x"], "y", "g")
    assert one.fixed == {"intercept": 0.0, "x": 0.0} and math.isnan(one.sd)


def test_budget_at_its_limit(spark):
    """What was spent is the sum of the costs before, to the last bit (F3)."""
    rows = [(t, i, c) for t, cost in enumerate((0.1, 8.13, 33.33, 560.21, 1234.56)) for i, c in enumerate((249.5, 249.5, cost, None, 1.0))]
    got = P.budget(spark.createDataFrame(rows, "task long, ord long, cost double"), 500.0, 1.0, ["task"]).collect()
    assert {(r["task"], r["spent"], r["allowed"]) for r in got if r["ord"] == 2} == {(t, 499.0, True) for t in range(5)}
    assert all(r["spent"] == 0.0 for r in got if r["ord"] == 0) and len(got) == 25


def test_every_row_draws_for_itself_over_ranges(spark, monkeypatch):
    """Single rows: few levels that run over several ranges and steps, against all pairs (F5, F6, F7)."""
    from hornbeam.plans import inference_queries as Q

    monkeypatch.setattr(B, "STEP", 30)
    r = random.Random(8)
    d = spark.createDataFrame([("p", float(r.randrange(2)), r.randrange(2), i) for i in range(120)], "cluster string, risk double, y int, ord long")
    c = B.single(d, "ord", "9")
    kept = [x.asDict() for x in c.collect()]
    assert len(kept) == 120 and {x["n"] for x in kept} == {1}
    w = B.drawn(*(np.array([x[k] for x in kept], np.int64) for k in ("n", "__a", "__b")), np.arange(6))
    risk, y = np.array([x["risk"] for x in kept]), np.array([x["y"] for x in kept])
    pair = (risk[:, None] > risk[None]) + (risk[:, None] == risk[None]) / 2
    want = [(w[:, j] * y) @ pair @ (w[:, j] * (1 - y)) / ((w[:, j] * y).sum() * (w[:, j] * (1 - y)).sum()) for j in range(6)]
    of = lambda g, **k: [x["auc"] for x in B.by_draw(B.areas(c, g, [F.col("risk")], F.col("y"), 1 - F.col("y"), **k), "auc").orderBy("at").collect()]
    assert of("cluster", reps=6) == pytest.approx(want)
    draws = spark.createDataFrame([("p", [0, 1, 2, 3, 4, 5])], "cluster string, js array<long>")
    assert of(None, draws=draws, per=1) == pytest.approx(want)
    for name in ("boot_ci_auc", "cluster_boot_mean_auc", "pooled_boot"):
        assert "ub as (select *" in Q.SQL[name] and "count(*) as n, min(ord)" not in Q.SQL[name]


def test_a_fit_makes_its_features_once(spark):
    """Steps read a written table, not what it is made of (F8, F12)."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    d = spark.range(0, 400, 1, 2).select(F.sin("id").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"))
    before = M.fit(d, ["a"], "y")
    after = M.fit(d.mapInArrow(count, d.schema), ["a"], "y")
    assert made.value == 400 and after[0] == pytest.approx(before[0])
    assert M.fit(d.where("y = 1"), ["a"], "y") is None


def test_features_of_odd_paths_in_many_tasks(spark, monkeypatch):
    """Lines are dealt out by commit before they are summed, in tasks whose number follows the lines (F14, F15)."""
    from hornbeam.operators import changes as C

    monkeypatch.setattr(C, "TASK_LINES", 10)
    r = random.Random(4)
    paths = ["a", "b", "/a", "/a/b", "a/b", "a/c", "a/d/e", "b/d/e", "", None]
    rows = [(s, r.choice(paths), r.choice((0, 0, 3, 8)), r.choice((0, 1))) for s in range(60) for _ in range(r.randint(1, 9))]
    out = C.features(spark.createDataFrame(rows, "sha long, path string, la long, ld long"))
    got = {x["sha"]: x for x in out.withColumn("task", F.spark_partition_id()).collect()}
    assert len(got) == 60 and len({x["task"] for x in got.values()}) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for sha, x in got.items():
        churn = {}
        for _, path, la, ld in (y for y in rows if y[0] == sha):
            churn[path] = churn.get(path, 0) + la + ld
        known, total = [p for p in churn if p is not None], sum(churn.values())
        assert (x["nf"], x["nd"], x["ns"]) == (len(churn), len({p.rpartition("/")[0] for p in known}), len({p.split("/")[0] for p in known}))
        assert (x["la"], x["ld"], x["churn"]) == (sum(y[2] for y in rows if y[0] == sha), sum(y[3] for y in rows if y[0] == sha), total)
        assert x["entropy"] == pytest.approx(-sum(c / total * math.log2(c / total) for c in churn.values() if c), abs=1e-9)


def test_both_mixed_models_read_one_table(spark, sf_dir, monkeypatch):
    """The features are made once for all models, not for each one and again for its scaling (F16)."""
    from hornbeam.plans import model_queries as Q

    made, fitted, matrix = [], [], Q.feature_matrix
    monkeypatch.setattr(Q, "feature_matrix", lambda *a: made.append(a) or matrix(*a))
    monkeypatch.setattr(Q.M, "mixed", lambda df, features, label, group: fitted.append((df.stash_path, group)) or M.Mixed({"x": 1.0}, 2.0, df, df))
    assert Q.random_intercept(spark, sf_dir).count() == 4
    assert len(made) == 1 and len({p for p, _ in fitted}) == 1 and [g for _, g in fitted] == ["cluster", "family"]
