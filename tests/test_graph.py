"""Reachability against a search, on histories with merges, missing parents, cycles and repeated rows."""

import random

from hornbeam.operators import history_graph as G


def search(commits, parents, start):
    known, todo, seen = set(commits), [s for s in start if s in set(commits)], set()
    while todo:
        sha = todo.pop()
        if sha not in seen:
            seen.add(sha)
            todo += [p for s, p, _ in parents if s == sha and p in known]
    return seen


def check(spark, commits, parents, start):
    c = spark.createDataFrame([(x,) for x in commits], "sha long")
    p = spark.createDataFrame(parents, "sha long, parent long, position int")
    got = [r[0] for r in G.ancestors(c, p, spark.createDataFrame([(x,) for x in start], "sha long")).collect()]
    assert len(got) == len(set(got)) and set(got) == search([x for x in commits if x is not None], parents, start)


def together(parts):
    """Graphs side by side, their commits numbered apart."""
    shift = lambda x, i: None if x is None else x + 1000 * i
    commits = [shift(c, i) for i, (cs, _, _) in enumerate(parts) for c in cs]
    parents = [(shift(a, i), shift(b, i), k) for i, (_, ps, _) in enumerate(parts) for a, b, k in ps]
    return commits, parents, [shift(s, i) for i, (_, _, ss) in enumerate(parts) for s in ss]


def test_histories_and_odd_graphs(spark):
    r, parts = random.Random(8), []
    for n, merges, missing in ((1, 0, 0), (40, 0.0, 0.0), (60, 0.3, 0.1), (90, 0.8, 0.05)):
        parents = []
        for i in range(1, n):
            parents.append((i, 500 + i if r.random() < missing else max(0, i - r.choice((1, 1, 1, 2, 5))), 0))
            if r.random() < merges:
                parents.append((i, r.randrange(i), 1))
        parts.append((range(n), parents, [n - 1]))
    chain = [(i, i - 1, 0) for i in range(1, 30)]
    parts += [
        (range(30), chain, [7, 3, 99]), (range(30), [*chain, (0, 29, 0)], [4]),  # one cycle
        (range(10), [(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, 3, 0), (3, 2, 1), (5, 4, 0), (4, 5, 1)], [3]),
        ([0, 1, 2, 2, None], [(2, 1, 0), (2, 1, 0), (1, None, 0), (None, 0, 0), (1, 0, 1)], [2]), (range(5), chain[:4], []), ([], chain[:4], [3]),
    ]
    check(spark, *together(parts))
    check(spark, range(3), chain[:2], [])


def test_long_chain_in_few_rounds(spark):
    n = 600
    c = spark.range(n).withColumnRenamed("id", "sha")
    p = spark.range(1, n).selectExpr("id as sha", "id - 1 as parent", "0 as position")
    assert G.chains(c, p).selectExpr("count(distinct chain)", "max(place)").first() == (1, n - 1)
    assert G.ancestors(c, p, spark.createDataFrame([(n // 2,)], "sha long")).count() == n // 2 + 1


def lanes(n, wide, far=0):
    """Lanes side by side with merges, now and then a missing first parent or one far back, a cycle, and repeated rows."""
    r = random.Random(wide)
    parents = [(i, i - wide, 0) for i in range(wide, n) if i % 23] + [(i, i - 1 - i % 7, 1) for i in range(8, n) if i % 11 == 0]
    parents += [(r.randrange(n), r.randrange(n), 2) for _ in range(far)]
    return range(n), [*parents, (n // 2, n // 2 + wide, 0), *parents[:5]]


def test_blocks_contracted_and_searched(spark):
    for block, (commits, parents) in ((16, lanes(3000, 3)), (40, lanes(1500, 5, 2)), (2, lanes(50, 4, 3))):
        c = spark.createDataFrame([(f"c{x}", x) for x in commits], "sha string, ct long")
        p = spark.createDataFrame([(f"c{a}", f"c{b}", k) for a, b, k in parents], "sha string, parent string, position int")
        start = [len(commits) - 1, len(commits) - 40]
        got = [int(r[0][1:]) for r in G.ancestors(c, p, spark.createDataFrame([(f"c{x}",) for x in start], "sha string"), "ct", block).collect()]
        assert len(got) == len(set(got)) and set(got) == search(commits, parents, start)


def test_jobs_do_not_grow_with_cut_chains(spark):
    """Each chain of a shallow clone is entered from the one before by a merge; there was a round for every chain."""
    def jobs(n):
        c = spark.range(n).selectExpr("id as sha", "id as ct")
        p = c.selectExpr("sha", "inline(array(struct(if(sha % 10 = 0, -sha, sha - 1) as parent, 0 as position), struct(if(sha % 10 = 5, sha - 6, null) as parent, 1 as position)))").where("parent is not null")
        group = f"ancestors-{n}"
        spark.sparkContext.setJobGroup(group, group)
        out = G.ancestors(c, p, spark.createDataFrame([(n - 2,)], "sha long")).count()
        spark.sparkContext.setJobGroup("", "")
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (few, a), (many, b) = jobs(100), jobs(1000)
    assert (few, many) == (99, 999) and b < 2 * a
