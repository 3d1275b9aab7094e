"""Reachability in a commit graph.

A history is long and narrow: a search by levels would take as many rounds as there are commits, a transitive closure would
be quadratic.  The commits are cut into blocks of bounded size along an order (their time, or chains of first parents), so
that few edges lead from one block to another.  Every block by itself is contracted to edges from where it is entered to
where it is left, neighbouring blocks are joined into one, and so on until one is left: logarithmically many rounds.  Then
what is reached is told downwards, each block for itself again.  The order decides how much is saved, not what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hornbeam.sources.store import discard, written

#: Commits of a block, blocks that are joined into one a round, and entries up to which a block is contracted.
BLOCK, FAN, ENTRIES = 1 << 16, 16, 1024


def chains(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """``sha, chain, place``: the head of each commit's chain and the steps from there.  A commit on a cycle of first parents
    is a chain of its own.  The table is written and stays until the caller discards it."""
    known = commits.select("sha").where("sha is not null").distinct()
    first = parents.where("parent is not null").groupBy("sha").agg(F.min_by("parent", "position").alias("parent")).join(known, "sha", "left_semi")
    up = first.groupBy(F.col("parent").alias("__sha")).agg(F.min("sha").alias("up"))
    start = known.join(up, F.col("sha") == F.col("__sha"), "left")
    work = written(start.select("sha", F.coalesce("up", "sha").alias("at"), F.col("up").isNotNull().cast("long").alias("place"), F.col("up").isNull().alias("done")), "chains")
    reach, n = 1, work.count()
    while reach < n and work.where("not done").limit(1).count():
        there = work.select(F.col("sha").alias("at"), F.col("at").alias("__at"), F.col("place").alias("__place"), F.col("done").alias("__done"))
        doubled = work.where("not done").join(there, "at")  # each commit is so far from one other at most
        doubled = doubled.select("sha", F.col("__at").alias("at"), (F.col("place") + F.col("__place")).alias("place"), F.col("__done").alias("done"))
        after = written(work.where("done").unionByName(doubled), "chains")
        discard(work)
        work, reach = after, 2 * reach
    out = written(work.select("sha", F.when(F.col("done"), F.col("at")).otherwise(F.col("sha")).alias("chain"), F.when(F.col("done"), F.col("place")).otherwise(0).alias("place")), "chains")
    discard(work)
    return out


def ancestors(commits: DataFrame, parents: DataFrame, start: DataFrame, order: str | None = None, block: int = BLOCK) -> DataFrame:
    """``sha`` of every commit that is reachable from one of ``start(sha)``, these included.

    ``parents(sha, parent, position)`` has a row for each parent, the first with the least position.  Nulls, parents and
    starts that are no commits, repeated rows, self loops and cycles do no harm; no start gives no rows.  ``order`` is a column
    of the commits in which parents are near; without one a commit's place on its chain is taken.  A history too wide
    to be contracted keeps its edges and is searched block by block, in as many rounds as a path goes from block to block.
    """
    known = commits.where("sha is not null")
    at = known.groupBy("sha").agg(F.min(order).alias("at")) if order else chains(commits, parents)
    blocks = max(1, math.ceil(known.count() / block))
    near = ["at", "sha"] if order else ["chain", "place", "sha"]
    placed = written(at.repartitionByRange(blocks, *near).select("sha", F.spark_partition_id().alias("block")), "placed")
    discard(at)
    a, b = (placed.select(F.col("sha").alias(s), F.col("block").alias(f"{s}_block")) for s in "ab")
    edges = parents.select(F.col("sha").alias("a"), F.col("parent").alias("b")).join(a, "a").join(b, "b").select("a", "a_block", "b", "b_block")
    levels, span = [(written(edges, "edges"), 1)], 1
    starts = written(b.join(start.select(F.col("sha").alias("b")).distinct(), "b", "left_semi").select("b", "b_block"), "starts")
    while span < blocks:
        graph = levels[-1][0]
        crossing = graph.where(f"a_block div {span} <> b_block div {span}")
        less = written(_in_groups(graph, starts, span, True).applyInPandas(_contracted, graph.schema).unionByName(crossing), "edges")
        widest = less.groupBy(F.expr(f"a_block div {span * FAN}")).count().agg(F.max("count")).first()[0] or 0
        if widest > 4 * block:
            discard(less)
            break
        span *= FAN
        levels.append((less, span))
    reached = _searched(*levels[-1], starts, span < blocks)
    for graph, span in levels[-2::-1]:
        upper, reached = reached, _spread(graph, reached, span)
        discard(upper)
    for table in (placed, starts, *(graph for graph, _ in levels)):
        discard(table)
    out = reached.select(F.col("b").alias("sha"))
    out.stash_path = reached.stash_path
    return out


def _in_groups(graph: DataFrame, entries: DataFrame, span: int, crossing: bool):
    """By ``span`` blocks: their inner edges (kind 0), ``entries`` (kind 1), and with ``crossing`` also where edges between groups
    enter (kind 1) and leave (kind 2)."""
    row = lambda kind, x, y: f"struct({x}_block div {span} as `group`, {kind} as kind, {x} as a, {x}_block as a_block, {y} as b, {y}_block as b_block)"
    within = f"a_block div {span} = b_block div {span}"
    sides = f"if({within}, array({row(0, 'a', 'b')}), array({row(1, 'b', 'b')}, {row(2, 'a', 'a')}))" if crossing else f"array({row(0, 'a', 'b')})"
    inner = (graph if crossing else graph.where(within)).select(F.expr(f"inline({sides})"))
    return inner.unionByName(entries.select(F.expr(f"inline(array({row(1, 'b', 'b')}))"))).groupBy("group")


def _numbered(rows: pd.DataFrame):
    """A group's commits by number: names, blocks, parents of each, entries and exits."""
    code, names = pd.factorize(pd.concat([rows["a"], rows["b"]], ignore_index=True))
    a, b, kind = code[: len(rows)], code[len(rows) :], rows["kind"].to_numpy()
    blocks, to = np.zeros(len(names), np.int32), [[] for _ in names]
    blocks[a], blocks[b] = rows["a_block"], rows["b_block"]
    for x, y in zip(a[kind == 0].tolist(), b[kind == 0].tolist()):
        to[x].append(y)
    return names, blocks, to, *(np.unique(a[kind == k]).tolist() for k in (1, 2))


def _visited(to: list[list[int]], entries: list[int]) -> list[int]:
    """What can be reached, without cycles a commit before its parents."""
    seen, post, todo = set(), [], list(entries)
    while todo:
        x = todo.pop()
        if x < 0:
            post.append(~x)
        elif x not in seen:
            seen.add(x)
            todo.append(~x)
            todo += to[x]
    return post[::-1]


def _contracted(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges from the entries of a group to the exits reached from them, or its own where these are not more."""
    names, blocks, to, entries, exits = _numbered(rows)
    inner = rows.loc[rows["kind"] == 0, ["a", "a_block", "b", "b_block"]]
    if len(entries) > ENTRIES:
        return inner
    order, by = _visited(to, entries), [0] * len(names)  # by: a bit for each entry that leads there
    for i, x in enumerate(entries):
        by[x] = 1 << i
    again = True
    while again:  # twice, but for cycles
        again = False
        for x in order:
            for y in to[x]:
                if by[x] & ~by[y]:
                    by[y] |= by[x]
                    again = True
    if sum(by[x].bit_count() for x in exits) - len(entries) > len(inner):
        return inner
    pairs = [(e, x) for x in exits for i, e in enumerate(entries) if by[x] >> i & 1 and e != x]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": names[a], "a_block": blocks[a], "b": names[b], "b_block": blocks[b]})


def _reached(rows: pd.DataFrame) -> pd.DataFrame:
    names, blocks, to, entries, _ = _numbered(rows)
    at = np.array(_visited(to, entries), np.int64)
    return pd.DataFrame({"b": names[at], "b_block": blocks[at]})


def _spread(graph: DataFrame, entries: DataFrame, span: int) -> DataFrame:
    """What is reached from the entries without leaving their groups, these included."""
    return written(_in_groups(graph, entries, span, False).applyInPandas(_reached, StructType(graph.schema.fields[2:])), "reached")


def _searched(graph: DataFrame, span: int, entries: DataFrame, several: bool) -> DataFrame:
    """All of the graph that is reached from the entries: at once where it is one group, else group by group."""
    reached = _spread(graph, entries, span)
    crossing = graph.where(f"a_block div {span} <> b_block div {span}")
    fresh = reached
    while several:
        ask = crossing.join(fresh.select(F.col("b").alias("a")), "a", "left_semi").select("b", "b_block").distinct().join(reached.select("b"), "b", "left_anti")
        ask = written(ask, "asked")
        several = bool(ask.limit(1).count())
        if several:
            told = _spread(graph, ask, span)
            new = written(told.join(reached.select("b"), "b", "left_anti"), "fresh")
            after = written(reached.unionByName(new), "reached")
            for table in {fresh, reached, told}:
                discard(table)
            reached, fresh = after, new
        discard(ask)
    if fresh is not reached:
        discard(fresh)
    return reached
