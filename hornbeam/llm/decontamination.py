"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the 1s of a fixed mask, so a substitution at a 0 does not hide a match.  Seeds of
the benchmark are looked up among the seeds of every document; around each hit the two word sequences are compared
along the hit's diagonal, and a window that agrees in enough words is contamination.  The masks of each window size are
completed until one of them hits every window that may agree, so nothing is lost.  The benchmark is a stated query
set: it is read in blocks of bounded size, and each block goes over all documents in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hornbeam.llm.kernels import PUNCTUATION, U, Words, chunks, mix


@dataclass(frozen=True)
class Settings:
    """``window`` words of an item (all of a shorter item) must lie over a document with ``percent`` of them equal.

    ``masks`` are the first ones tried; :func:`masks_for` adds what a window size needs besides.
    """

    masks: tuple[str, ...] = ("11011011", "1110010101", "10110001101")
    window: int = 13
    percent: int = 80
    #: Text bytes of a block of the benchmark; a longer item is a block of its own.
    block_bytes: int = 4 << 20


#: Patterns times masks that are enumerated at most; beyond that one run of equal words is the seed.
ENUMERATED = 4_000_000


@lru_cache(maxsize=1024)
def masks_for(size: int, percent: int, first: tuple[str, ...]) -> tuple[str, ...]:
    """Masks of which at least one, at some position, hits each window of ``size`` words with ``percent`` of them equal.

    Of ``first`` those that fit are kept while they hit something new; then masks of one weight are added, each time the
    one that hits most of the patterns of different words still missed.
    """
    wrong = size - -(-percent * size // 100)
    if wrong <= 0:
        return ("1" * size,)
    weight = max(2 * size // (wrong + 2), min(4, size - wrong))
    if math.comb(size, wrong) * math.comb(size - 1, weight - 1) > ENUMERATED:
        # the equal words lie in at most wrong + 1 runs
        return ("1" * max(1, -(-(size - wrong) // (wrong + 1))),)
    # as many different words as allowed: with fewer, the same masks hit
    missed = np.array([sum(1 << i for i in c) for c in combinations(range(size), wrong)], object if size > 62 else np.int64)

    def misses(mask: str, patterns: np.ndarray) -> np.ndarray:
        ones = sum(1 << i for i, bit in enumerate(mask) if bit == "1")
        out = np.ones(len(patterns), bool)
        for at in range(size - len(mask) + 1):
            out &= (patterns & (ones << at)) != 0
        return out

    chosen = []
    for mask in first:
        if len(mask) <= size and "1" in mask and not (left := misses(mask, missed)).all():
            chosen.append(mask)
            missed = missed[left]
    if len(missed):
        inner = (set(c) for c in combinations(range(1, size), weight - 1))
        others = ["".join("1" if not i or i in c else "0" for i in range(max(c, default=0) + 1)) for c in inner]
    while len(missed):
        mask = min(others, key=lambda m: (misses(m, missed).sum(), len(m), m))
        chosen.append(mask)
        missed = missed[misses(mask, missed)]
    return tuple(chosen)


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash at each position; positions where the mask does not fit are left out at the end."""
    n = len(h) - len(mask) + 1
    acc = np.zeros(max(n, 0), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:
            acc = mix(acc + h[j : j + n] + U(0x9E3779B97F4A7C15))
    return acc


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case, by Unicode; bytes that are no UTF-8 become replacement characters."""
    column = column.cast(pa.large_string())
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        raw = column.cast(pa.large_binary()).to_pylist()
        return pc.utf8_lower(pa.array([x if x is None else x.decode("utf-8", "replace") for x in raw], pa.large_string()))


class Seeds:
    """The seeds of one mask over some items: each distinct seed's items, and each of these items' positions of it."""

    def __init__(self, mask: str, use: list[int], words: list[np.ndarray]):
        self.mask = mask
        found = [_seeds(words[k], mask) for k in use]
        seed, item = np.concatenate(found), np.repeat(use, [len(f) for f in found])
        at = np.concatenate([np.arange(len(f)) for f in found])
        order = np.lexsort((at, item, seed))
        seed, item, self.at = seed[order], item[order], at[order].astype(np.int32)
        fresh = np.ones(len(seed) + 1, bool)
        fresh[1:-1] = (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])
        self.group = np.flatnonzero(fresh)  # where each seed's positions in an item begin; the last is the end
        self.item = item[self.group[:-1]].astype(np.int32)
        grouped = seed[self.group[:-1]]
        fresh = np.ones(len(grouped) + 1, bool)
        fresh[1:-1] = grouped[1:] != grouped[:-1]
        self.first = np.flatnonzero(fresh)  # where each seed's groups begin
        self.seed = grouped[self.first[:-1]]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seed >> U(44)).astype(np.int64)] = True


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its index so many times, and 0, 1, ... within each."""
    whole = np.repeat(np.arange(len(counts)), counts)
    return whole, np.arange(len(whole)) - np.repeat(np.cumsum(counts) - counts, counts)


class Block:
    """Some items: their words, and for each mask their seeds."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.settings = settings
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        for _, text in items:
            for _, data, offsets in chunks(lowered(pa.array([text]))):
                self.words.append(Words(data, offsets, separators=PUNCTUATION).hash)
        uses: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                for mask in masks_for(min(settings.window, len(w)), settings.percent, settings.masks):
                    uses.setdefault(mask, []).append(k)
        self.tables = [Seeds(mask, use, self.words) for mask, use in uses.items()]
        self.lengths = np.array([len(w) for w in self.words])

    def _candidates(self, words: Words, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item, shift) of every place where an item may lie over a text, and (row, item) of the pairs that share
        seeds at more places than there are shifts: these are compared at every shift, their places are not listed."""
        lengths = np.diff(words.offsets)
        listed, dense = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
        for t in self.tables:
            values = _seeds(words.hash, t.mask)
            here = np.flatnonzero(t.bits[(values >> U(44)).astype(np.int64)]) if len(values) else np.zeros(0, np.int64)
            here = here[doc[here] == doc[here + len(t.mask) - 1]]
            which = np.searchsorted(t.seed, values[here])
            real = which < len(t.seed)
            real[real] = t.seed[which[real]] == values[here[real]]
            here, which = here[real], which[real]
            if not len(here):
                continue
            # each text's places of each seed, once
            key, start, many = np.unique(doc[here] * np.int64(len(t.seed)) + which, return_index=True, return_counts=True)
            place = here[np.argsort(doc[here] * np.int64(len(t.seed)) + which, kind="stable")]
            begin = np.cumsum(many) - many
            d, which = doc[here[start]], which[start]
            # meet each item that has the seed
            one, nth = _spread(t.first[which + 1] - t.first[which])
            group = t.first[which[one]] + nth
            item, own = t.item[group], t.group[group + 1] - t.group[group]
            pair, back = np.unique(d[one] * np.int64(len(self.words)) + item, return_inverse=True)
            met = np.bincount(back, weights=many[one].astype(float) * own)
            over = met > (lengths[pair // len(self.words)] + self.lengths[pair % len(self.words)])
            dense.append(np.stack([pair[over] // len(self.words), pair[over] % len(self.words)], 1))
            few = ~over[back]
            one, group, item, own = one[few], group[few], item[few], own[few]
            each, nth = _spread(many[one] * own)
            a = place[begin[one[each]] + nth // own[each]]
            b = t.at[t.group[group[each]] + nth % own[each]]
            listed.append(np.stack([d[one[each]], item[each], a - words.offsets[d[one[each]]] - b], 1))
        return np.unique(np.concatenate(listed), axis=0), np.unique(np.concatenate(dense), axis=0)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, equal words, window) of the best window of each contaminated row and item."""
        for first, data, offsets in chunks(lowered(column)):
            words = Words(data, offsets, separators=PUNCTUATION)
            listed, dense = self._candidates(words, words.doc())
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for d, item in dense.tolist():
                text, own = words.hash[words.offsets[d] : words.offsets[d + 1]], self.words[item]
                size = min(self.settings.window, len(own))
                equal = best_window(text, own, size)
                if 100 * equal >= self.settings.percent * size:
                    best[d, item] = equal, size
            settled = set(map(tuple, dense.tolist()))
            for d, item, shift in listed.tolist():
                text, own = words.hash[words.offsets[d] : words.offsets[d + 1]], self.words[item]
                a, b = max(0, -shift), min(len(own), len(text) - shift)
                size = min(self.settings.window, len(own))
                if b - a < size or best.get((d, item), (0, 0))[0] == size or (d, item) in settled:
                    continue
                total = np.concatenate(([0], np.cumsum(text[a + shift : b + shift] == own[a:b])))
                equal = int((total[size:] - total[:-size]).max())
                if 100 * equal >= self.settings.percent * size and equal > best.get((d, item), (0, 0))[0]:
                    best[d, item] = equal, size
            for (d, item), (equal, size) in sorted(best.items()):
                yield first + d, item, equal, size


def best_window(text: np.ndarray, own: np.ndarray, size: int, cells: int = 1 << 21) -> int:
    """The most equal words of any window of ``size`` words, over all shifts of ``own`` along ``text``."""
    if len(text) < size or len(own) < size:
        return 0
    if len(own) > len(text):
        text, own = own, text
    n, best = len(own), 0
    out = n - size  # words of `own` that may lie outside `text`
    wide = np.concatenate((np.zeros(out, np.uint64), text, np.zeros(out, np.uint64)))
    rows = np.lib.stride_tricks.sliding_window_view(wide, n)
    step = max(1, cells // n)
    for at in range(0, len(rows), step):
        total = np.zeros((len(rows[at : at + step]), n + 1), np.int32)
        np.cumsum(rows[at : at + step] == own, axis=1, out=total[:, 1:])
        equal = total[:, size:] - total[:, :-size]
        place = np.arange(at, at + len(equal))[:, None] + np.arange(out + 1) - out
        equal[(place < 0) | (place > len(text) - size)] = 0  # not a whole window of the text
        best = max(best, int(equal.max()))
        if best == size:
            break
    return best


def blocks(bench: DataFrame, settings: Settings) -> Iterator[Block]:
    """Benchmark items in blocks; null ids and texts without a word are left out, they match nothing."""
    items: list[tuple[int, str]] = []
    size = 0
    for row in bench.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        if items and size + len(row[1]) > settings.block_bytes:
            yield Block(items, settings)
            items, size = [], 0
        items.append((row[0], row[1]))
        size += len(row[1])
    if items:
        yield Block(items, settings)


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("equal_words", T.IntegerType()), T.StructField("window_words", T.IntegerType())]
)


def contaminated(docs: DataFrame, bench: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, equal_words, window_words`` for each document row and each item found in it.

    ``docs`` needs ``doc_id`` and ``text``, ``bench`` needs ``item_id`` and ``text``; other columns are not read.  Null
    and empty texts match nothing, a null ``doc_id`` is carried as null, repeated rows give repeated results, an empty
    table on either side gives no rows.  Words are runs of letters, digits and non-ASCII characters, in lower case.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = None
    for block in blocks(bench, settings):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(shared.value.matches(batch.column(1)))
                at = pa.array([h[0] for h in hits], pa.int64())
                arrays = [batch.column(0).take(at), pa.array([shared.value.ids[h[1]] for h in hits], pa.int64())]
                arrays += [pa.array([h[k] for h in hits], pa.int32()) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays(arrays, names=RESULT.names)

        part = rows.mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, bench: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all their columns, in which no item is found."""
    at = docs.columns.index("text")
    for block in blocks(bench, settings):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in shared.value.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
