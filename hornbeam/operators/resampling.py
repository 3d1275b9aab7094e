"""Bootstraps by cell.

A bootstrap draws each row a Poisson(1) number of times; n equal rows together are drawn a Poisson(n) number of times.  So
rows are summed into cells of equal values first, and each cell draws one number a resample.  Its numbers come from
``(a + j * b) mod 2**31 - 1`` for draw ``j``, with ``a`` and ``b`` of the MD5 of the cell's key, inverted through the Poisson
distribution: the same on every run and in SQL.

Where every row has to draw for itself, :func:`single` makes each a cell of its own.

AUC and the areas of effort curves are one sum, ``sum x * (2 * y before + y)`` along an order.  Cells are cut into ranges of
that order; a range gives the sums of x, of y and the inner area for all resamples as arrays, and ranges are put together
by ``inner + 2 * x * y of the ranges before``.  A level at a range's end may go on in the next range, so it is told apart.  No
row is multiplied by resamples, and no group or level is one task but for a row of arrays for each of its ranges.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.operators.inference import PRIME, with_stream
from hornbeam.sources.store import written

#: Numbers of a matrix of cells by draws that are worked on at a time.
STEP = 1 << 21


def cells(df: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """Equal rows of ``df(by..., key)`` as one, with their number ``n`` and the stream of their least ``key``, kept as ``key``."""
    return with_stream(df.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias(key)), key, seed)


def single(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Every row of ``df`` as a cell with a stream of its own."""
    return with_stream(df, key, seed).withColumn("n", F.lit(1).cast("long"))


@lru_cache(maxsize=4096)
def _passes(n: int) -> tuple[int, np.ndarray]:
    """(least number, where the Poisson distribution with mean n passes it and the next ones on the scale of the draws)."""
    low = max(0, int(n - 12 * math.sqrt(n) - 20))
    k = np.arange(low, int(n + 12 * math.sqrt(n) + 30) + 1)
    log_p = low * math.log(n) - n - math.lgamma(low + 1) + np.concatenate(([0.0], np.cumsum(math.log(n) - np.log(k[1:]))))
    return low, np.round(PRIME * np.cumsum(np.exp(log_p))).astype(np.int64)


def drawn(n: np.ndarray, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How often draws ``j`` take cells of ``n`` rows, cells by draws."""
    at = (a[:, None] + j[None, :] * b[:, None]) % PRIME
    out = np.empty(at.shape)
    for size in np.unique(n).tolist():
        low, passes = _passes(size)
        rows = n == size
        out[rows] = low + np.searchsorted(passes, at[rows], "right")
    return out


#: Where the Poisson distribution with mean 1 passes 0, 1, 2, ... on the scale of the draws, as far as a draw can pass it.
LIMITS = tuple(v for v in _passes(1)[1].tolist() if v < PRIME)


def _folded(n, a, b, clusters: np.ndarray, js: dict, per: int, width: int) -> np.ndarray:
    """How often each resample of ``per`` draws takes cells of several clusters, each with draws of its own."""
    out = np.zeros((len(n), width))
    for c in set(clusters.tolist()):
        draws = np.array(js.get(c, []), np.int64)
        if len(draws):
            rows, reps = np.flatnonzero(clusters == c), draws // per
            starts = np.concatenate(([0], np.flatnonzero(np.diff(reps)) + 1))
            w = drawn(n[rows], a[rows], b[rows], draws)
            out[np.ix_(rows, reps[starts])] = np.add.reduceat(w, starts, axis=1)
    return out


def _summed(order: np.ndarray, x, y, weights, rows: int, width: int) -> list[tuple]:
    """``key, x, y, inner`` of sorted cells in order: the first level's sums, what lies between, the last level's; ``weights`` gives
    how often a slice of the cells is drawn.  ``rows`` cells are worked on at a time, however many are level."""
    first, pending, total = None, None, np.zeros((3, width))
    new = np.concatenate(([True], np.any(order[:, 1:] != order[:, :-1], axis=0)))
    for at in range(0, len(x), rows):
        cut = slice(at, at + rows)
        w = weights(cut)
        heads = np.flatnonzero(new[cut])
        starts = heads if len(heads) and heads[0] == 0 else np.concatenate(([0], heads))
        xs, ys = (np.add.reduceat(v[cut][:, None] * w, starts, axis=0) for v in (x, y))
        if pending is not None and not new[at]:
            xs[0] += pending[1]
            ys[0] += pending[2]
        elif pending is not None:
            xs, ys = np.vstack([pending[1], xs]), np.vstack([pending[2], ys])
        last = int(starts[-1]) + at
        if first is None and len(xs) > 1:
            first = (order[:, 0].tolist(), xs[0], ys[0])
            done = slice(1, len(xs) - 1)
        else:
            done = slice(0, len(xs) - 1)
        before = total[1] + np.cumsum(ys[done], axis=0) - ys[done]
        total[2] += (xs[done] * (2 * before + ys[done])).sum(axis=0)
        total[0] += xs[done].sum(axis=0)
        total[1] += ys[done].sum(axis=0)
        pending = (order[:, last].tolist(), xs[-1], ys[-1])
    zero = np.zeros(width)
    ends = [(*level, zero) if level else None for level in (first, pending)]
    return [e for e in (ends[0], (None, *total) if first else None, ends[1]) if e]


def areas(table: DataFrame, by: str | None, order: list[Column], x: Column, y: Column, reps: int | None = None, draws: DataFrame | None = None, per: int | None = None) -> DataFrame:
    """``g, x, y, inner`` for each value of ``by``: arrays over draws of the sums of x and y and of twice the area along ``order``.

    ``table`` is from :func:`cells`; cells that agree in ``order`` (numbers) count as level.  Draws are 0 to ``reps - 1``, or
    ``draws(cluster, js)``: ascending numbers for each cluster of ``table``, whose ``per`` make a resample if that is given,
    and then arrays are over resamples.
    """
    spark = table.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"o{i}" for i in range(len(order))]
    g = (F.col(by) if by else F.lit(None)).cast("string").alias("g")
    cluster = (F.col("cluster") if draws is not None else F.lit(None)).cast("string").alias("c")
    rows = table.select(g, cluster, *(o.cast("double").alias(k) for o, k in zip(order, names)), x.cast("double").alias("x"), y.cast("double").alias("y"), "n", F.col("__a").alias("a"), F.col("__b").alias("b"))
    rows = written(rows.repartitionByRange(ranges, "g", *names, "a").withColumn("block", F.spark_partition_id()), "cells")

    def block(own: pa.Table, told: pa.Table | None) -> pa.Table:
        out = []
        js = dict(zip(told["of"].to_pylist(), told["js"].to_pylist())) if told is not None else {}
        if own.num_rows:
            group = own["g"].combine_chunks().dictionary_encode()
            code = group.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            columns = {k: own[k].to_numpy() for k in (*names, "x", "y", "n", "a", "b")}
            clusters = np.array(own["c"].to_pylist(), object)
            by_order = np.lexsort((*(columns[k] for k in reversed(names)), code))
            edges = np.append(np.flatnonzero(np.append(True, np.diff(code[by_order]) != 0)), len(code))
            for s, e in zip(edges[:-1], edges[1:]):
                at = by_order[s:e]
                name = own["g"][int(at[0])].as_py()
                order, x, y, n, a, b = np.stack([columns[k][at] for k in names]), *(columns[k][at] for k in ("x", "y", "n", "a", "b"))
                if per is None:
                    numbers = np.arange(reps) if told is None else np.array(js.get(clusters[at[0]], []), np.int64)
                    width = at_once = len(numbers)
                    weights = lambda cut: drawn(n[cut], a[cut], b[cut], numbers)  # noqa: B023, E731
                else:
                    own_clusters, width = clusters[at], max((int(v[-1]) // per + 1 for v in js.values() if v), default=0)
                    at_once = max(width, max(map(len, js.values()), default=0))
                    weights = lambda cut: _folded(n[cut], a[cut], b[cut], own_clusters[cut], js, per, width)  # noqa: B023, E731
                parts = _summed(order, x, y, weights, max(1, STEP // max(at_once, 1)), width)
                out += [(name, int(own["block"][0].as_py()), i, *p) for i, p in enumerate(parts)]
        arrays = {k: pa.array([o[i] for o in out], pa.list_(pa.float64())) for i, k in enumerate(("key", "x", "y", "inner"), 3)}
        return pa.table({"g": pa.array([o[0] for o in out], pa.string()), "block": pa.array([o[1] for o in out], pa.int32()), "part": pa.array([o[2] for o in out], pa.int32()), **arrays})

    schema = "g string, block int, part int, key array<double>, x array<double>, y array<double>, inner array<double>"
    if draws is None:
        sums = rows.groupBy("block").applyInArrow(lambda own: block(own, None), schema)
    else:
        met = rows.select("block", "c").distinct().join(draws.select(F.col("cluster").cast("string").alias("c"), "js"), "c").select(F.col("block").alias("to"), F.col("c").alias("of"), "js")
        sums = rows.groupBy("block").cogroup(met.groupBy("to")).applyInArrow(lambda own, told: block(own, told), schema)

    def merged(parts: pa.Table) -> pa.Table:
        """The ranges of one group in their order."""
        at = np.lexsort((parts["part"].to_numpy(), parts["block"].to_numpy()))
        keys = parts["key"].to_pylist()
        x, y, inner = ([np.array(v) for v in parts[k].to_pylist()] for k in ("x", "y", "inner"))
        width = max(len(v) for v in x)
        tx, ty, ti = np.zeros(width), np.zeros(width), np.zeros(width)
        level, lx, ly = None, np.zeros(width), np.zeros(width)
        for i in at:
            k = len(x[i])
            if keys[i] is None or keys[i] != level:  # the level before is whole
                ti += lx * (2 * ty + ly)
                tx += lx
                ty += ly
                level, lx, ly = keys[i], np.zeros(width), np.zeros(width)
            if level is None:
                ti[:k] += inner[i] + 2 * x[i] * ty[:k]
                tx[:k] += x[i]
                ty[:k] += y[i]
            else:
                lx[:k] += x[i]
                ly[:k] += y[i]
        ti += lx * (2 * ty + ly)
        tx += lx
        ty += ly
        return pa.table({"g": parts["g"].slice(0, 1), **{k: pa.array([v], pa.list_(pa.float64())) for k, v in (("x", tx), ("y", ty), ("inner", ti))}})

    return sums.groupBy("g").applyInArrow(merged, "g string, x array<double>, y array<double>, inner array<double>")


def by_draw(arrays: DataFrame, name: str) -> DataFrame:
    """``g, at, x, y, inner`` with a row for each draw; ``name`` becomes the ratio inner / (2 x y), null without x or y."""
    rows = arrays.select("g", F.posexplode(F.arrays_zip("x", "y", "inner")).alias("at", "v")).select("g", "at", "v.x", "v.y", "v.inner")
    return rows.withColumn(name, F.try_divide(F.col("inner"), F.nullif(2 * F.col("x") * F.col("y"), F.lit(0.0))))
