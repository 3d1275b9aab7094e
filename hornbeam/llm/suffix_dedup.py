"""Suffix-array de-duplication: remove every byte that a repeated string of ``length`` bytes covers.

The suffixes that are sorted are chosen in two steps that lose none.

1. *Anchors.*  The window of ``length`` bytes at each position is named by its minimiser, the k-gram with the least hash
   (of equal ones the leftmost).  Equal windows have equal minimisers at equal distances.  Consecutive windows with one
   anchor are a *stretch*; an anchor that occurs once has no repeated window, which settles most of the text.  Where
   all stretches of an anchor are the same bytes, all their windows repeat and there is nothing to sort.
2. *Difference-cover sort.*  For the other anchors, the text right of each anchor is a string of 8-byte characters.
   A difference-cover algorithm sorts its suffixes: triples at positions 1 and 2 mod 3 are sorted and named, names that
   are not yet distinct are sorted by recursion, and the suffixes at 0 mod 3 are merged in.  That gives every anchor's
   rank.  The remaining suffixes, those that begin at the windows left of an anchor, are merged by (bytes up to the
   anchor, rank of the anchor), and neighbours in that order are compared: a common prefix of ``length`` bytes marks
   both windows.  Windows are equal only if their anchors are, so the sort runs apart for sets of anchors.

An anchor with very many different stretches would be a large task; its windows are hashed whole, 128 bits each, and
counted with partial aggregation instead (``hot``).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import discard, partitions, stash
from hornbeam.llm.kernels import U, mix, powers, slices

_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)
_STEP = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Settings:
    """``length`` is below 4096, which a place's fields are made for; ``gram`` is a power of two."""

    length: int = 200
    gram: int = 32
    #: Different stretches of one anchor beyond which its windows are counted by hash.
    hot: int = 20_000
    #: Texts that a task remembers when it skips copies; forgotten ones only cost their pieces again.
    remembered: int = 20_000


# ---------------------------------------------------------------- anchors


def stretches(data: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor position, first window, last window + 1) of each stretch of one text."""
    n = len(data)
    if n < s.length:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    h, width, step = _BYTE[data], 1, _STEP
    while width < s.gram:  # hash of 2w bytes from two of w; the gram is a power of two
        h = h[:-width] * U(step) + h[width:]
        width, step = 2 * width, step * step % 2**64
    h = mix(h)
    span = s.length - s.gram + 1
    low, width = h, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - s.length + 1], low[span - width : span - width + n - s.length + 1])
    # the leftmost place of the minimum, for the first window of each run of one minimum
    begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    end = np.append(begin[1:], len(low))
    at = np.empty(len(begin), np.int64)
    for i in range(0, len(begin), 4096):
        some = begin[i : i + 4096]
        at[i : i + 4096] = some + (h[some[:, None] + np.arange(span)] == low[some][:, None]).argmax(1)
    # a run of one least hash may hold several places of that gram; it is split where its first place leaves the window
    out_anchor, out_at, out_begin, out_end = [low[begin]], [at], [begin], [end]
    late = np.flatnonzero(end - 1 > at)
    if len(late):
        extra = []
        out_end[0] = end.copy()
        for i in late.tolist():
            x, stop = int(at[i]), int(end[i])
            out_end[0][i] = x + 1
            while stop - 1 > x:
                first = x + 1
                x = first + int(np.argmax(h[first : first + span] == low[begin[i]]))
                extra.append((low[begin[i]], x, first, min(stop, x + 1)))
        out_anchor.append(np.array([e[0] for e in extra], np.uint64))
        for k, part in enumerate((out_at, out_begin, out_end), 1):
            part.append(np.array([e[k] for e in extra], np.int64))
    return tuple(np.concatenate(x) for x in (out_anchor, out_at, out_begin, out_end))


def _content(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the bytes that each stretch's windows cover."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    stop = end - 1 + length
    return mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(raw: bytes) -> bytes:
    return md5(raw, usedforsecurity=False).digest()


def occurrences(docs: DataFrame, s: Settings) -> DataFrame:
    """``anchor, content, text_key, place``: every stretch of every row's text; ``place`` packs the first window, the
    bytes from it to the anchor, and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces: list[list] = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                raw = _bytes_of(text)
                data = np.frombuffer(raw, np.uint8)
                anchor, at, begin, end = stretches(data, s)
                if not len(anchor):
                    continue
                own = (anchor, _content(data, begin, end, s.length), np.full(len(anchor), text_key(raw)), (begin << 24) | (at - begin) << 12 | (end - begin))
                for p, x in zip(pieces, own):
                    p.append(x)
            if not pieces[0]:
                continue
            a, c, t, place = (np.concatenate(p) for p in pieces)
            arrays = [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(t), [None, pa.py_buffer(np.ascontiguousarray(t).tobytes())]).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(place)], names=["anchor", "content", "text_key", "place"])

    schema = "anchor long, content long, text_key binary, place long"
    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- difference cover


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows given by columns, equal rows alike."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        ranked = c[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``text`` (integers >= 1) by the difference cover {1, 2} mod 3.

    ``depth`` rounds of naming are enough: a name in round r stands for 3**r characters, and suffixes that agree so far
    may share a rank.  Ranks order all suffixes that differ within 3**depth characters.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(3, np.int64)))
    ones, twos = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    rank = np.zeros(n + 3, np.int64)
    if len(sample):
        name = _names(padded[sample], padded[sample + 1], padded[sample + 2])
        if depth > 1 and name.max() < len(sample):
            # a 0 between the two halves keeps triples from running over
            inner = np.concatenate((name[: len(ones)], [0], name[len(ones) :])) + 1
            deeper = suffix_ranks(inner, depth - 1)
            name = _names(np.concatenate((deeper[: len(ones)], deeper[len(ones) + 1 :])))
        rank[sample] = name
    zeros = np.arange(0, n, 3)
    # merge: against a suffix at 1 mod 3 one character and a rank decide, at 2 mod 3 two characters and a rank
    merged = np.zeros(n, np.int64)
    pair = _names(
        np.concatenate((padded[zeros], padded[ones])), np.concatenate((rank[zeros + 1], rank[ones + 1]))
    )
    triple = _names(
        np.concatenate((padded[zeros], padded[twos])),
        np.concatenate((padded[zeros + 1], padded[twos + 1])),
        np.concatenate((rank[zeros + 2], rank[twos + 2])),
    )
    zero_pair, one_pair = pair[: len(zeros)], pair[len(zeros) :]
    zero_triple, two_triple = triple[: len(zeros)], triple[len(zeros) :]
    # ranks of all three kinds on one scale: how many suffixes are less, equal ones counted alike
    by_pair, by_triple = np.sort(zero_pair), np.sort(zero_triple)
    sorted_ones, sorted_twos = np.sort(one_pair), np.sort(two_triple)
    merged[zeros] = (
        np.searchsorted(by_pair, zero_pair, "left") + np.searchsorted(sorted_ones, zero_pair, "left") + np.searchsorted(sorted_twos, zero_triple, "left")
    )
    sample_sorted = np.sort(rank[sample]) if len(sample) else np.zeros(0, np.int64)
    merged[ones] = np.searchsorted(sample_sorted, rank[ones], "left") + np.searchsorted(by_pair, one_pair, "left")
    merged[twos] = np.searchsorted(sample_sorted, rank[twos], "left") + np.searchsorted(by_triple, two_triple, "left")
    return merged + 1


def _rounds(characters: int) -> int:
    r, reach = 1, 3
    while reach < characters:
        r, reach = r + 1, reach * 3
    return r


def repeated_windows(strings: list[bytes], anchor: np.ndarray, left: np.ndarray, count: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) pairs, by string, of the windows that occur in another string at the same anchor.

    ``strings`` are the bytes of stretches; string i has its anchor ``left[i]`` bytes in and ``count[i]`` windows, the
    first at byte 0.  Equal strings are not expected, strings of one anchor are compared.
    """
    n = len(strings)
    blob = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(x) for x in strings])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    # --- sort the suffixes at the anchors, as strings of 8-byte characters
    width = -(-s.length // 8)  # lengths of 8 bytes at least
    right = size - left
    grid = (start + left)[:, None] + np.arange(8 * width)[None, :]
    inside = np.arange(8 * width)[None, :] < np.minimum(right, s.length)[:, None]
    cells = np.where(inside, blob[np.minimum(grid, len(blob) - 1)].astype(np.uint16) + 1, 0)
    # a byte past the end sorts before all others: nine bits a byte do not fit, so ends are told apart by a second column
    words = np.zeros((n, width), np.uint64)
    for j in range(8):
        words = (words << U(8)) | (np.maximum(cells[:, j::8], 1) - 1).astype(np.uint64)
    filled = (cells.reshape(n, width, 8) > 0).sum(2)
    character = _names(words.ravel(), filled.ravel()).reshape(n, width) + 1
    text = np.concatenate((character, np.ones((n, 1), np.int64)), 1)  # 1 ends each string
    ranks = suffix_ranks(text.ravel(), _rounds(width + 1)).reshape(n, width + 1)[:, 0]
    # --- merge the suffixes at the windows: bytes up to the anchor, then the anchor's rank
    up, down = powers(len(blob) + 1)
    total = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(_BYTE[blob] * up[: len(blob)], out=total[1:])
    owner = np.repeat(np.arange(n), count)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    before = left[owner] - offset
    at, stop = start[owner] + offset, start[owner] + left[owner]
    key = mix(mix((total[stop] - total[at]) * down[at] + before.astype(np.uint64)) + anchor[owner])
    order = np.lexsort((ranks[owner], key))
    # --- compare adjacent prefixes; the bytes up to the anchor are equal where the keys are
    x, y = order[:-1], order[1:]
    near = np.flatnonzero((key[x] == key[y]) & (before[x] == before[y]))
    x, y = x[near], y[near]
    words = np.ndarray((len(blob),), "<u8", np.concatenate((blob, np.zeros(8, np.uint8))), 0, (1,))
    same = np.ones(len(x), bool)
    todo = np.arange(len(x))
    for j in [*range(0, s.length - 8, 8), s.length - 8]:  # eight bytes of the two windows at a time, while they agree
        equal = words[at[x[todo]] + j] == words[at[y[todo]] + j]
        same[todo[~equal]] = False
        todo = todo[equal]
    hit = np.zeros(len(owner), bool)
    hit[x[same]] = True
    hit[y[same]] = True
    found = np.flatnonzero(hit)
    return owner[found], offset[found]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Runs [first, last + 1) of ascending integers."""
    if not len(values):
        return []
    cut = np.flatnonzero(np.diff(values) != 1)
    return list(zip(values[np.concatenate(([0], cut + 1))].tolist(), (values[np.append(cut, len(values) - 1)] + 1).tolist()))


# ---------------------------------------------------------------- the operator

_STRETCH = "array<struct<anchor:bigint,content:bigint,at:int,begin:int,stop:int,state:int>>"
FULL, SORT, HOT = 1, 2, 3


def spans(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``text_key, cover``: for texts with something to remove, the byte ranges (begin, stop), ascending and apart."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    occ = stash(occurrences(docs, s))
    # how often an anchor occurs, and with how many different bytes
    per_content = stash(occ.groupBy("anchor", "content").agg(F.count("*").alias("n")))
    per_anchor = per_content.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where("n > 1")
    state = F.when(F.col("kinds") == 1, FULL).when(F.col("kinds") <= s.hot, SORT).otherwise(HOT)
    # written down, so that the join below deals out both its sides itself and can split an anchor that is everywhere
    per_anchor = stash(per_anchor.select("anchor", state.alias("state")))
    # copies of a text are one; by keys other than the anchor, which leaves the join free to split
    found = occ.join(per_anchor, "anchor").dropDuplicates(["text_key", "place"])
    # a stretch that occurs more than once is repeated as a whole, whatever its anchor's other stretches are
    twice = per_content.where("n > 1").select("anchor", "content", F.lit(True).alias("twice"))
    found = found.join(twice, ["anchor", "content"], "left")
    begin, before, windows = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(F.lit(4095)), F.col("place").bitwiseAND(F.lit(4095))
    found = stash(
        found.select("anchor", "content", "text_key", "state", "twice", begin.cast("int").alias("begin"), (begin + before).cast("int").alias("at"), (begin + windows).cast("int").alias("stop"))
    )
    for done in (occ, per_content, per_anchor):
        discard(done)

    # the bytes of one occurrence of each different stretch that has to be sorted
    wanted = found.where(F.col("state") > FULL).groupBy("anchor", "content", "state").agg(F.min(F.struct("text_key", "at", "begin", "stop")).alias("one"))
    wanted = wanted.groupBy("one.text_key").agg(
        F.collect_list(F.struct("anchor", "content", "one.at", "one.begin", "one.stop", "state")).cast(_STRETCH).alias("need")
    )
    keyed = docs.select(docs["text"].cast("string").alias("text")).withColumn(
        "text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted stretches' bytes, of the copies of a text that a task meets once."""
        done: OrderedDict[bytes, None] = OrderedDict()
        for batch in slices(batches, 128):
            rows = []
            for i, key in enumerate(batch.column(2).to_pylist()):
                if key in done:
                    continue
                done[key] = None
                if len(done) > s.remembered:
                    done.popitem(last=False)
                need, raw = batch.column(1)[i].as_py(), _bytes_of(batch.column(0)[i].as_py())
                for x in need:
                    piece = raw[x["begin"] : x["stop"] - 1 + s.length]
                    rows.append((x["anchor"], x["content"], x["at"] - x["begin"], x["stop"] - x["begin"], x["state"], piece))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "content", "before", "windows", "state", "piece"]
            )

    pieces = keyed.join(wanted, "text_key").select("text", "need", "text_key").mapInArrow(
        cut, "anchor long, content long, before int, windows int, state int, piece binary"
    )
    pieces = stash(pieces)

    def sort(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        # copies of one text in several tasks bring the same stretch more than once
        _, one = np.unique(np.stack([group["anchor"].to_numpy(), group["content"].to_numpy()]), axis=1, return_index=True)
        group = group.take(pa.array(np.sort(one)))
        anchor = group["anchor"].to_numpy().view(np.uint64)
        before, windows = group["before"].to_numpy().astype(np.int64), group["windows"].to_numpy().astype(np.int64)
        strings = group["piece"].to_pylist()
        out: list[tuple] = []
        order = np.argsort(anchor, kind="stable")
        lengths = np.cumsum([len(strings[i]) for i in order])
        at = 0
        while at < len(order):  # some anchors at a time, about 1 MB of bytes
            to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + (1 << 20))))
            while to < len(order) and anchor[order[to]] == anchor[order[to - 1]]:
                to += 1
            rows = order[at:to]
            owner, offset = repeated_windows([strings[i] for i in rows], anchor[rows], before[rows], windows[rows], s)
            for i in np.unique(owner).tolist():
                for a, b in _runs(offset[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]):
                    out.append((group["anchor"][int(rows[i])].as_py(), group["content"][int(rows[i])].as_py(), a, b))
            at = to
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("anchor", "content", "a", "b"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))})

    marked = "anchor long, content long, a int, b int"
    by_sort = pieces.where(F.col("state") == SORT).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    by_sort = by_sort.groupBy("bucket").applyInArrow(sort, marked)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = []
            for anchor, content, n, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows += [(anchor, content, i, md5(piece[i : i + s.length], usedforsecurity=False).digest()) for i in range(n)]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "content", "a", "window"])

    hot = pieces.where(F.col("state") == HOT).dropDuplicates(["anchor", "content"]).select("anchor", "content", "windows", "piece")
    hot = hot.mapInArrow(windows_of, "anchor long, content long, a int, window binary")
    often = hot.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    by_hash = hot.join(often, ["anchor", "window"], "left_semi").select("anchor", "content", "a", (F.col("a") + 1).alias("b"))
    marks = by_sort.unionByName(by_hash)

    whole = found.where((F.col("state") == FULL) | F.col("twice")).select("text_key", "begin", "stop")
    parts = found.where((F.col("state") > FULL) & F.col("twice").isNull()).join(marks, ["anchor", "content"])
    parts = parts.select("text_key", (F.col("begin") + F.col("a")).alias("begin"), (F.col("begin") + F.col("b")).alias("stop"))
    ranges = whole.unionByName(parts).select("text_key", "begin", (F.col("stop") - 1 + s.length).alias("stop"))
    packed = ranges.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("ranges"))
    return packed


def remove_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs(doc_id, text)``; ``kept`` is binary.

    Texts are UTF-8 bytes, a null is empty, and a text shorter than ``length`` loses nothing.  A repeat may lie in the
    same text, overlapping too; none crosses texts.  Every byte of repeated rows is a repeat where the text is long
    enough.  A null ``doc_id`` is carried; other columns are not read; an empty table gives no rows.  ``kept`` may end
    inside a character, as windows are bytes.
    """
    packed = spans(docs, s)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = rows.join(packed, "text_key", "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = _bytes_of(text)
                kept, end, removed, runs = [], 0, 0, 0
                for r in ranges or ():
                    begin, stop = r["begin"], r["stop"]
                    if begin > end or runs == 0:
                        kept.append(raw[end:begin])
                        runs += 1
                        removed += stop - begin
                    elif stop > end:
                        removed += stop - end
                    end = max(end, stop)
                kept.append(raw[end:])
                out.append((len(raw), removed, runs, b"".join(kept)))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
