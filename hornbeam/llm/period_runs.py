"""Detection of periodic runs of words by a harmonic grid of extension queries.

A run is a stretch of consecutive words with smallest period ``q`` that no neighbouring word extends, at least
``max(min_words, min_exponent * q)`` words long.  For each period p the words at 0, p, 2p, ... form a grid; two
neighbours of it ask how far their suffixes agree forward and how far the words before them agree backward.  Both
lengths are minima over a stretch of an LCP array: one of the text's suffix array, one of its reversed text's.  A run of
period p covers three grid points at least, so only neighbours whose words agree, twice in a row, are asked.  The grids of
all periods have n ln n points together.

Texts are independent: there is no shuffle.  Suffix arrays are made by prefix doubling for about a megabyte of texts at a
time, with ranks that differ between texts from the start, and only suffixes that are still tied are sorted again.
A text is worked on whole, in memory that grows with its words times the logarithm of its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.llm.kernels import Words, chunks, mix, slices

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Entries of an LCP array that share a block of the table of minima, and grid points looked at in one step.
BLOCK, STEP = 16, 1 << 20


class Minima:
    """Minimum of ``values[lo : hi + 1]`` for many (lo, hi): a sparse table over blocks, prefixes and suffixes within."""

    def __init__(self, values: np.ndarray):
        n = max(1, -(-len(values) // BLOCK)) * BLOCK
        self.values = np.full(n, np.iinfo(np.int64).max)
        self.values[: len(values)] = values
        rows = self.values.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(rows, axis=1).ravel()
        self.since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(rows):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.since[lo], self.upto[hi])
        whole = np.flatnonzero(b - a > 1)
        first, last = a[whole] + 1, b[whole] - 1
        level = np.frexp(last - first + 1)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[whole[at]] = np.minimum(out[whole[at]], np.minimum(t[first[at]], t[last[at] - (1 << int(k)) + 1]))
        same = np.flatnonzero(a == b)
        for at in np.array_split(same, -(-len(same) // 65536) or 1):
            span = lo[at][:, None] + np.arange(BLOCK)
            cells = self.values[np.minimum(span, hi[at][:, None])]
            out[at] = cells.min(axis=1)
        return out


class Suffixes:
    """Suffix array, its inverse and its LCP array for texts that lie one after another: ``ends[i]`` is where the text of
    word i ends.  ``codes`` differ between texts, so suffixes of different texts share nothing."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        rank = np.empty(n, np.int64)
        fresh = np.concatenate(([True], np.diff(codes[order]) != 0)) if n else np.zeros(0, bool)
        rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else 0
        levels, step = [rank.copy()], 1
        while True:
            head = np.ones(n + 1, bool)  # where a group of tied suffixes begins
            head[1:n] = rank[order[1:]] != rank[order[:-1]]
            tied = np.flatnonzero(~(head[:-1] & head[1:]))
            if not len(tied):
                break
            at = order[tied]
            beyond = at + step < ends[at]
            second = np.where(beyond, rank[np.minimum(at + step, n - 1)] + 1, 0)
            key = rank[at] * (n + 2) + second
            by = np.argsort(key, kind="stable")
            order[tied] = at[by]
            new = np.concatenate(([True], np.diff(key[by]) != 0))
            rank[order[tied]] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
            step *= 2
            levels.append(rank.copy())
        self.rank = rank
        lcp = np.zeros(n, np.int64)
        for k in range(len(levels) - 1, -1, -1):  # equal ranks of level k are 2^k equal words
            a, b = order[:-1] + lcp[1:], order[1:] + lcp[1:]
            there = (a < ends[order[:-1]]) & (b < ends[order[1:]])
            level = levels.pop()
            same = there & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
            lcp[1:] += np.where(same, 1 << k, 0)
        self.minima = Minima(lcp)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and at j (not the same) have in common."""
        a, b = self.rank[i], self.rank[j]
        return self.minima(np.minimum(a, b) + 1, np.maximum(a, b))


def _grid(sizes: np.ndarray, offsets: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid points that have two more after them: ascending periods, a step for each doubling of the
    period or about STEP points."""
    longest = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    by = np.argsort(period, kind="stable")
    text, period = text[by], period[by]
    points = np.maximum((sizes[text] - 1) // np.maximum(period, 1) - 1, 0)
    upto = np.cumsum(points)
    at = 0
    while at < len(text):
        to = min(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")), int(np.searchsorted(period, 2 * period[at])))
        to = max(at + 1, to)
        m = points[at:to]
        j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        p = np.repeat(period[at:to], m)
        yield np.repeat(offsets[text[at:to]], m) + j * p, p
        at = to


def runs(codes: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start in its text, length, period) of every run, by text, start, period.  ``codes`` are words of texts that
    begin at ``offsets``; equal words of one text have equal codes."""
    if exponent < 4:
        raise ValueError("a run has to cover three grid points: exponent is 4 at least")
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    n, end = len(codes), np.repeat(offsets[1:], sizes)
    begin = np.repeat(offsets[:-1], sizes)
    found: list[np.ndarray] = []
    forward = backward = None
    period_of, end_of = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of a run found here
    for at, p in _grid(np.where(sizes >= min_words, sizes, 0), offsets[:-1], exponent):
        hit = (codes[at] == codes[at + p]) & (codes[at + p] == codes[at + 2 * p])
        at, p = at[hit], p[hit]
        # within a run whose period divides p, the extensions would give that run again
        known = (at + 2 * p < end_of[at]) & (p % np.maximum(period_of[at], 1) == 0)
        at, p = at[~known], p[~known]
        if not len(at):
            continue
        if forward is None:  # most texts have no run and need none of this
            own = np.unique(mix(codes ^ mix(text.astype(np.uint64))), return_inverse=True)[1]
            forward, backward = Suffixes(own, end), Suffixes(own[::-1].copy(), n - begin[::-1])
        ahead = forward.common(at, at + p)
        behind = np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at > begin[at])
        behind[inner] = backward.common(n - at[inner], n - at[inner] - p[inner])
        length = behind + p + ahead
        long = length >= np.maximum(min_words, exponent * p)
        new = np.unique(np.stack([(at - behind)[long], length[long], p[long]], axis=1), axis=0)
        found.append(new)
        for start, size, q in new[np.argsort(new[:, 1], kind="stable")].tolist():  # the longest last
            period_of[start : start + size], end_of[start : start + size] = q, start + size
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    all_found = np.concatenate(found)
    start, length, p = all_found[np.lexsort((all_found[:, 2], all_found[:, 1], all_found[:, 0]))].T
    # one stretch is found with the multiples of its period too: the least is its smallest period
    first = np.concatenate(([True], (np.diff(start) != 0) | (np.diff(length) != 0))) if len(start) else np.zeros(0, bool)
    start, length, p = start[first], length[first], p[first]
    by = np.lexsort((p, start))
    start, length, p = start[by], length[by], p[by]
    return text[start], start - begin[start], length, p


def _collapsed(raw: bytes, found: list[tuple[int, int, int]]) -> str:
    words = raw.split()  # at the six ASCII spaces
    if found:
        kept = np.ones(len(words) + 1, np.int64)
        for start, length, period in found:
            kept[start + period : start + length] = 0
        words = [words[i] for i in np.flatnonzero(kept[:-1])]
    return b" ".join(words).decode()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``n_words``, ``runs`` (start, length, period; by start, then period), ``best_run`` (the one with the
    greatest exact length / period; ties: smallest start, then period) and ``collapsed``, the text without the words that
    any run holds after its first period, its words joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A null or empty text has no word, no run, a null ``best_run`` and an
    empty ``collapsed``.  Repeated rows get a row each; columns of ``docs`` with the names of the new ones are replaced.
    Words are told apart by 64-bit hashes within one text.
    """
    added = T.StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, best_run struct<start: long, length: long, period: long>, collapsed string")
    new = set(added.names)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(*kept, F.col(text).cast("string").alias("collapsed"))  # a name that no other column has now

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1)
            n_words: list[int] = []
            listed: list[list] = []
            best: list[tuple | None] = []
            collapsed: list[str] = []
            for _, data, offsets in chunks(texts):
                words = Words(data, offsets, lower=False)
                found = runs(words.hash, words.offsets.astype(np.int64), min_words, exponent)
                cut = np.searchsorted(found[0], np.arange(len(offsets)))
                n_words += np.diff(words.offsets).tolist()
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    own = list(zip(*(x[a:b].tolist() for x in found[1:])))
                    listed.append([dict(zip(("start", "length", "period"), r)) for r in own])
                    top = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    best.append(top and dict(zip(("start", "length", "period"), top)))
                    collapsed.append(_collapsed(data[offsets[i] : offsets[i + 1]].tobytes(), own))
            columns = [pa.array(n_words, pa.int64()), pa.array(listed, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, *added.names])

    schema = T.StructType([*docs.select(*kept).schema.fields, *added.fields])
    return rows.mapInArrow(work, schema)
