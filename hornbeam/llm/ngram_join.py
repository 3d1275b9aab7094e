"""N-gram Jaccard join with a count-vector R-tree: links between texts whose shingle sets overlap, and their components.

A text's shingles are hashed into groups; its group counts are a point, and the sum over groups of the lesser count
bounds how many shingles two texts share.  R-trees over these points are joined with themselves under that bound, and
pairs that survive are verified on the shingles.

One R-tree over everything would compare everything: at a few hundred dimensions all unrelated texts lie equally far
apart.  So the groups are first used another way, which loses no pair.  Two sets with Jaccard >= t differ in at most
D = (1 - t) / (1 + t) * (|A| + |B|) shingles; hashed into more than D groups, some group has the same shingles in both.
Sets are hashed into some groups more, so that a linked pair agrees in at least ``agree`` of them; pairs that do are tied.
Ties come about by shared passages too, so the bound is put to them first:
the few texts of a small tie pair by pair, those of a large one by an R-tree over their points.  What survives is closed
to families, and each family gets its R-tree and its verification.

* Equal sets are one class from the start, so thousands of copies cost one member.
* A tie or family too large for one task is cut into blocks; every pair of blocks is a task.
* Inside a task, pairs already connected are not looked at again; only spanning links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import components, discard, partitions, scratch, stash
from hornbeam.llm.kernels import U, Words, chunks, mix, release, set_key, shingles, slices, views


@dataclass(frozen=True)
class Settings:
    """Link when ``100 * |A & B| >= percent * |A | B|`` over ``k``-word shingles."""

    k: int = 4
    percent: int = 85
    #: Steps between the size levels that share a number of groups.
    level_step: float = 1.6
    #: Groups of the points.
    axes: int = 256
    #: In how many groups of shingles a linked pair agrees at least.
    agree: int = 4
    #: How often a small set is dealt out anew.
    again: int = 8
    #: Texts of a tie up to which its pairs are listed one by one.
    few: int = 8
    #: Members of a family that one task takes; beyond, it is cut into blocks of this many.
    block: int = 1024
    #: Members of a tie that one task takes; beyond, it is cut into blocks.  Also the members that ties put together
    #: in one task may have, about.
    tie: int = 8192
    #: Rows of the ties of a crowd that one task takes, about.
    rows: int = 16384
    leaf: int = 24
    #: Numbers that a task gathers before it passes them on.
    flush: int = 1 << 18

    def differing(self, both: int) -> int:
        """Most shingles in which two sets of ``both`` shingles together can differ and still link."""
        return (100 - self.percent) * both // (100 + self.percent)

    def top(self, level: int) -> int:
        return ceil(self.level_step**level)

    def groups(self, level: int) -> tuple[int, int]:
        """(D, groups) of a level: D + ``agree`` and more, as groups that are empty in both sets are no agreement."""
        differ = self.differing(2 * self.top(level))
        least = self.top(max(level - 1, 0)) * self.percent / 100
        slack = 6
        for _ in range(2):
            groups = differ + self.agree + slack
            empty = groups * np.exp(-least / groups)
            slack = int(max(6, min(differ, 6 + np.ceil(empty + 6 * np.sqrt(empty)))))
        return differ, differ + self.agree + slack

    def level(self, n: int) -> int:
        at = max(0, int(np.log(max(n, 1)) / np.log(self.level_step)) - 1)
        while self.top(at) < n:
            at += 1
        return at


def _batches(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text of an Arrow column."""
    for first, data, offsets in chunks(column):
        hashes, to = shingles(Words(data, offsets), k)
        for i, (a, b) in enumerate(zip(to[:-1].tolist(), to[1:].tolist())):
            yield first + i, np.unique(hashes[a:b])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def point(own: np.ndarray, axes: int) -> np.ndarray:
    """How many shingles fall into each of the hashed groups."""
    return np.bincount((mix(own ^ U(0x8EBC6AF09C88C6E3)) >> U(40)).astype(np.int64) % axes, minlength=axes).astype(np.int32)


def classes(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, n, key, tag, point``: the number of shingles, 128 bits of the set, 64 of them as a number, group counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            sizes, keys, points = [], [], []
            for _, own in _batches(batch.column(1), s.k):
                sizes.append(len(own))
                keys.append(set_key(own) if len(own) else None)
                points.append(point(own, s.axes).tobytes())
            tags = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tags, pa.int64()), pa.array(points, pa.binary())],
                names=["doc_id", "n", "key", "tag", "point"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n long, key binary, tag long, point binary")


def _group_signatures(own: np.ndarray, groups: int, salt: int) -> np.ndarray:
    """Hashes of the filled groups when a set is dealt out to so many groups by the salted hash of its members."""
    at = (((mix(own ^ U(0xA0761D6478BD642F ^ salt)) >> U(32)) * U(groups)) >> U(32)).astype(np.int64)
    sums = np.zeros(groups, np.uint64)
    np.add.at(sums, at, mix(own ^ U(0xE7037ED1A0B428DB)))
    filled = np.bincount(at, minlength=groups) > 0
    return mix(sums + mix(U((salt << 32) + 1) + np.arange(groups, dtype=np.uint64)))[filled]


def signatures(own: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """For each size level that a partner may share, the hashes of the set's groups.

    Of a set's filled groups all but D agree with those of a linked set, so a pair agrees at least as often as the greater
    of both numbers of filled groups, less D.  A set for which that is less than ``agree``, a small one, is dealt out
    again by other hashes, and if that is not enough member by member.  Its partner does so too, or has enough filled
    groups by itself.

    A text too small to differ from a partner in any shingle has none: such partners are of its own class.
    """
    n = len(own)
    largest = 100 * n // s.percent
    if s.differing(n + largest) < 1:
        return
    for level in range(s.level(n), s.level(largest) + 1):
        differ, groups = s.groups(level)
        sure = 0
        for again in range(s.again + 1):
            found = _group_signatures(own, groups, level + (again << 8))
            yield found
            # a round counts where it is sure to find something
            sure += max(0, len(found) - differ)
            if not again and sure >= s.agree:
                break
        else:
            if sure < s.agree:
                yield mix(own + mix(U((level << 32) + 2)))


def ties(docs: DataFrame, s: Settings) -> DataFrame:
    """Tags of classes that agree in enough groups of shingles: pairs ``a, b`` of small ties, and for large ones a row
    for each member ``a`` with the first one ``b``, the tie's ``many`` (0 for pairs) naming its set of members, so that
    ties alike are one."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, 2048):
            for _, own in _batches(batch.column(0), s.k):
                found = list(signatures(own, s))
                if not found:
                    continue
                key = set_key(own)
                if key in told:  # copies within this task need no second mention
                    continue
                if len(told) < 500_000:
                    told.add(key)
                found = np.concatenate(found)
                held.append((found, np.full(len(found), int.from_bytes(key[:8], "little", signed=True), np.int64)))
                if len(held) % 64 == 0 and sum(len(x) for x, _ in held) >= s.flush:
                    yield packed_rows(held)
                    held = []
        if held:
            yield packed_rows(held)

    def packed_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig, tag = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        bucket = ((sig >> U(40)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, tag, bucket = sig[order], tag[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        to = np.append(cut[1:], len(bucket))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cut].astype(np.int32)),
                pa.array([sig[a:b].tobytes() for a, b in zip(cut, to)], pa.binary()),
                pa.array([tag[a:b].tobytes() for a, b in zip(cut, to)], pa.binary()),
            ],
            names=["bucket", "sigs", "tags"],
        )

    def match(group: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(group["sigs"].to_pylist()), np.uint64)
        tag = np.frombuffer(b"".join(group["tags"].to_pylist()), np.int64)
        order = np.lexsort((tag, sig))
        sig, tag = sig[order], tag[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (tag[1:] != tag[:-1])  # copies are one
        sig, tag = sig[new], tag[new]
        cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(cut, len(sig)))
        found = []
        for n in range(2, s.few + 1):
            rows = cut[size == n]
            found += [np.stack([tag[rows + i], tag[rows + j], np.zeros(len(rows), np.int64)], 1) for i in range(n) for j in range(i + 1, n)]
        for c, n in zip(cut[size > s.few], size[size > s.few]):
            members = tag[c : c + n]
            name = mix(members.view(np.uint64)).sum(dtype=np.uint64) | U(1)
            found.append(np.stack([members, np.full(n, members[0]), np.full(n, name).view(np.int64)], 1))
        rows, times = np.unique(np.concatenate(found), axis=0, return_counts=True) if found else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pa.array(rows[:, 0]), "b": pa.array(rows[:, 1]), "many": pa.array(rows[:, 2]), "times": pa.array(times)})

    packed = _texts(docs).select("text").mapInArrow(emit, "bucket int, sigs binary, tags binary")
    found = packed.groupBy("bucket").applyInArrow(match, "a long, b long, many long, times long")
    # a linked pair that agrees less often in small ties agrees in a large one too, and is found there
    found = found.groupBy("a", "b", "many").agg(F.sum("times").alias("times"))
    return found.where(f"many <> 0 or times >= {s.agree}").drop("times")


class Tree:
    """A packed R-tree over count vectors: leaves of rows, each node with the least and greatest count of each group."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int):
        self.points, self.sizes = points, sizes
        order = self._tiles(np.arange(len(points)), leaf)
        self.leaves = [order[i : i + leaf] for i in range(0, len(order), leaf)]
        low = np.array([sizes[x].min() for x in self.leaves])
        high = np.stack([points[x].max(0) for x in self.leaves])
        self.levels = [(high, low)]
        while len(low) > 1:
            cut = range(0, len(low), 8)
            high, low = np.stack([high[i : i + 8].max(0) for i in cut]), np.array([low[i : i + 8].min() for i in cut])
            self.levels.append((high, low))

    def _tiles(self, rows: np.ndarray, leaf: int) -> np.ndarray:
        """Sort-tile-recursive order: halves along the group in which the rows vary most."""
        if len(rows) <= leaf:
            return rows
        widest = int(self.points[rows].var(0).argmax())
        rows = rows[np.lexsort((self.sizes[rows], self.points[rows, widest]))]
        half = leaf * max(1, round(len(rows) / leaf / 2))
        return np.concatenate((self._tiles(rows[:half], leaf), self._tiles(rows[half:], leaf)))

    def pairs(self, other: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves (rows here, rows there) that may hold a link.  Against itself each pair comes once."""
        same = self is other
        stack = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while stack:
            i, x, j, y = stack.pop()
            (high_a, low_a), (high_b, low_b) = self.levels[i], other.levels[j]
            shared = np.minimum(high_a[x], high_b[y]).sum()
            if (100 + percent) * shared < percent * (low_a[x] + low_b[y]):
                continue
            if i == 0 and j == 0:
                if not same or x <= y:
                    yield self.leaves[x], other.leaves[y]
            elif i >= j:
                stack += [(i - 1, c, j, y) for c in range(8 * x, min(8 * x + 8, len(self.levels[i - 1][1])))]
            else:
                stack += [(i, x, j - 1, c) for c in range(8 * y, min(8 * y + 8, len(other.levels[j - 1][1])))]


class Union:
    """Disjoint sets of numbered rows."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)


def joined(points: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, accept, s: Settings, union: Union | None = None, names: np.ndarray | None = None, seen: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among rows whose points pass the bound and which ``accept(x, y)`` takes; where there are two
    blocks, only pairs across them are looked at.  With ``union``, row x is ``names[x]`` in it, and what it already
    connects is not looked at; ``seen`` holds, by the same names, pairs that need no second look."""
    n = len(points)
    union = union or Union(n)
    names = np.arange(n) if names is None else names
    name = names.tolist()

    def root(x: int) -> int:
        return union.root(name[x])

    out: list[tuple[int, int]] = []

    def test(x: int, y: int) -> None:
        if root(x) != root(y) and accept(x, y):
            union.join(name[x], name[y])
            out.append((x, y))

    values = np.unique(blocks)
    first, second = np.flatnonzero(blocks == values[0]), np.flatnonzero(blocks == values[-1])
    if n == 2:
        test(0, 1)
        return out
    if len(values) == 1:
        # the row nearest to the mean is likely to link with most: those links make other checks needless
        middle = int(np.abs(points - points.mean(0)).sum(1).argmin())
        shared = np.minimum(points[middle], points).sum(1)
        for y in np.flatnonzero((100 + s.percent) * shared >= s.percent * (sizes[middle] + sizes)).tolist():
            test(middle, y)
    left = Tree(points[first], sizes[first], s.leaf)
    right = left if len(values) == 1 else Tree(points[second], sizes[second], s.leaf)
    for a, b in left.pairs(right, s.percent):
        a, b = first[a], second[b]
        roots_a, roots_b = np.array([root(x) for x in a]), np.array([root(x) for x in b])
        if roots_a.min() == roots_a.max() == roots_b.min() == roots_b.max():
            continue
        fresh = roots_a[:, None] != roots_b[None, :]
        if seen is not None:
            place = np.ix_(names[a], names[b])
            fresh &= ~seen[place]
            seen[place] = True
            seen[np.ix_(names[b], names[a])] = True
        if not fresh.any():
            continue
        shared = np.minimum(points[a][:, None, :], points[b][None, :, :]).sum(2)
        near = fresh & ((100 + s.percent) * shared >= s.percent * (sizes[a][:, None] + sizes[b][None, :]))
        for i, j in np.argwhere(near).tolist():
            test(int(a[i]), int(b[j]))
    return out


def linked_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of shingles link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _in_blocks(members: DataFrame, group: str, member: str, s: Settings, tasks: int) -> DataFrame:
    """``members`` with ``block, low, high, task``: small groups share a task, each pair of a large one's blocks is one."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).where("size > 1")
    out = members.join(sizes, group)
    parts = F.ceil(F.col("size") / s.block).cast("int")
    out = out.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64(member), F.col("parts")).cast("int")).drop("size")
    out = out.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.withColumn("low", F.least("block", "meets")).withColumn("high", F.greatest("block", "meets"))
    small = F.pmod(F.xxhash64(group), F.lit(tasks))
    large = F.xxhash64(group, "low", "high").bitwiseOR(F.lit(1 << 40))
    return out.withColumn("task", F.when(F.col("parts") == 1, small).otherwise(large)).drop("parts", "meets")


def _groups_of(table: pa.Table, group: str, member: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their blocks) of each group and pair of blocks in a task, ascending by member."""
    name, low, high, block = (table[c].to_numpy() for c in (group, "low", "high", "block"))
    order = np.lexsort((table[member].to_numpy(zero_copy_only=False), high, low, name))
    same = (np.diff(name[order]) == 0) & (np.diff(low[order]) == 0) & (np.diff(high[order]) == 0)
    cut = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(order)])) if len(order) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        rows = order[a:b]
        if len(rows) > 1 and (low[rows[0]] == high[rows[0]] or len(np.unique(block[rows])) == 2):
            yield rows, block[rows]


def near(known: DataFrame, tied: DataFrame, s: Settings) -> DataFrame:
    """``a, b``: tied pairs, or a spanning part of them, whose points pass the bound."""
    tasks = 4 * partitions(known.sparkSession)
    # one row for each tag; tags that stand for several classes keep the counts of one, and are let through
    points = known.groupBy("tag").agg(F.min("point").alias("point"), (F.min("key") != F.max("key")).alias("mixed"))
    pairs = tied.where("many = 0").select("a", "b")
    pairs = pairs.join(points.select(F.col("tag").alias("a"), F.col("point").alias("p"), F.col("mixed").alias("m")), "a")
    pairs = pairs.join(points.select(F.col("tag").alias("b"), F.col("point").alias("q"), F.col("mixed").alias("o")), "b")

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int32).reshape(-1, s.axes) for i in (2, 3))
            shared = np.minimum(p, q).sum(1)
            keep = (100 + s.percent) * shared >= s.percent * (p.sum(1) + q.sum(1))
            keep |= batch.column(4).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    small = pairs.select("a", "b", "p", "q", F.expr("m or o")).mapInArrow(passes, "a long, b long")
    large = tied.where("many <> 0").select("many", F.col("a").alias("tag"), "b")
    size = large.groupBy("many").agg(F.count("*").alias("size"))
    huge = large.join(size.where(F.col("size") > s.tie).select("many"), "many", "left_semi").select("many", "tag").join(points, "tag")

    def search(table: pa.Table) -> pa.Table:
        tag, raw, mixed = table["tag"].to_numpy(), views(table["point"], np.int32), table["mixed"].to_numpy()
        found = []
        for rows, block in _groups_of(table, "many", "tag"):
            at = np.stack([raw[r] for r in rows])
            found += [(tag[rows[x]], tag[rows[y]]) for x, y in joined(at, at.sum(1), block, lambda x, y: True, s)]
            found += [(tag[r], tag[rows[0]]) for r in rows if mixed[r]]
        release()
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    by_block = _in_blocks(huge, "many", "tag", s, tasks).groupBy("task").applyInArrow(search, "a long, b long")

    # other ties go where those are that share members with them, so that a point is sent once for all of them
    usual = large.join(size.where(F.col("size") <= s.tie).select("many"), "many", "left_semi")
    place = stash(components(usual.select(F.col("tag").alias("a"), "b")).withColumnRenamed("node", "tag"))
    usual = stash(usual.select("many", "tag").join(place, "tag"))
    # a crowd is cut by its members, as their points have to fit, and by its rows, as they are the work
    crowd = usual.groupBy("component").agg(F.count("*").alias("rows"), F.approx_count_distinct("tag").alias("tags"))
    parts = F.greatest(F.ceil(F.col("tags") / s.tie), F.ceil(F.col("rows") / s.rows)).cast("int").alias("parts")
    usual = usual.join(crowd.select("component", parts), "component")
    task = F.xxhash64("component", F.pmod("many", "parts"))
    usual = usual.select(F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(task.bitwiseOR(F.lit(1 << 40))).alias("task"), "many", "tag")
    usual = stash(usual)
    needed = usual.select(F.col("task").alias("of"), F.col("tag").alias("k")).distinct().join(points.withColumnRenamed("tag", "k"), "k")

    def together(ties: pa.Table, known: pa.Table) -> pa.Table:
        found = []
        if ties.num_rows and known.num_rows:
            tag, mixed = known["k"].to_numpy(), known["mixed"].to_numpy()
            order = np.argsort(tag)
            raw = views(known["point"], np.int32)
            at = np.stack([raw[i] for i in order])
            tag, mixed, sizes = tag[order], mixed[order], at.sum(1)
            union = Union(len(tag))
            seen = np.zeros((len(tag), len(tag)), bool) if len(tag) <= s.tie else None  # 64 MB at most
            many, member = ties["many"].to_numpy(), np.searchsorted(tag, ties["tag"].to_numpy())
            rows = np.lexsort((member, many))
            many, member = many[rows], member[rows]
            cut = np.flatnonzero(np.concatenate(([True], many[1:] != many[:-1])))
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(many)).tolist()):
                own = member[x:y]
                first = union.root(int(own[0]))
                if all(union.root(i) == first for i in own.tolist()):
                    continue
                pairs = joined(at[own], sizes[own], np.zeros(len(own), np.int8), lambda a, b: True, s, union, own, seen)
                found += [(tag[own[a]], tag[own[b]]) for a, b in pairs]
                found += [(tag[i], tag[own[0]]) for i in own if mixed[i]]
        release()
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    by_place = usual.groupBy("task").cogroup(needed.groupBy("of")).applyInArrow(together, "a long, b long")
    large = by_block.unionByName(by_place)
    return small.unionByName(large)


def similar(docs: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """``a, b``: keys of linked classes, enough of them to connect all that are connected."""
    tasks = 4 * partitions(docs.sparkSession)
    tied = stash(ties(docs, s))
    close = stash(near(known, tied, s))
    discard(tied)
    family = stash(components(close).select(F.col("node").alias("tag"), F.col("component").alias("family")))
    discard(close)
    # one document of each class with a family, to take its text from
    chosen = stash(known.select("tag", "key", "doc_id").join(family, "tag").groupBy("key", "family").agg(F.min("doc_id").alias("doc_id")))
    of = chosen.select(F.col("doc_id").alias("of")).distinct()
    texts = _texts(docs).alias("t").join(of, F.expr("t.doc_id <=> of"), "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, bytes]] = []
        arrays = lambda: [pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)]
        for batch in slices(batches, 2048):
            for _, own in _batches(batch.column(0), s.k):
                if len(own):
                    rows.append((set_key(own), own.tobytes()))
                if len(rows) % 64 == 63 and sum(len(r[1]) for r in rows) >= 8 * s.flush:
                    yield pa.RecordBatch.from_arrays(arrays(), names=["key", "shingles"])
                    rows.clear()
        yield pa.RecordBatch.from_arrays(arrays(), names=["key", "shingles"])

    sets = texts.select("text").mapInArrow(full, "key binary, shingles binary")
    members = chosen.select("key", "family").join(sets, "key").groupBy("key", "family").agg(F.first("shingles").alias("shingles"))

    def verify(table: pa.Table) -> pa.Table:
        keys, raw = table["key"].to_pylist(), views(table["shingles"], np.uint64)
        found = []
        for rows, block in _groups_of(table, "family", "key"):
            sets = [raw[r] for r in rows]
            sizes = np.array([len(x) for x in sets])
            axes = 1 << int(np.clip(np.ceil(np.log2(max(sizes.max() / 8, 16))), 4, 10))
            points = np.stack([point(x, axes) for x in sets])
            found += [(keys[rows[x]], keys[rows[y]]) for x, y in joined(points, sizes, block, lambda x, y: linked_sets(sets[x], sets[y], s.percent), s)]
        release()
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return _in_blocks(members, "family", "key", s, 4 * tasks).groupBy("task").applyInArrow(verify, "a binary, b binary")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the least ``doc_id`` reachable by links, itself included.  A null, empty or blank text has no
    shingles and is linked with nothing, so its component is its own id; a text with fewer than ``k`` words has one
    shingle, the whole of it.  Rows with a null id take part; their own id does not count for the least, and a
    component of only such rows has a null ``component_id``.  Repeated rows give repeated results; other columns are
    not read; an empty table gives no rows.
    """
    s = Settings(k, percent)
    kept: list[DataFrame] = []
    with scratch(docs.sparkSession, kept):  # what led to them is removed
        known = stash(classes(docs, s))
        linked = stash(similar(docs, known.where("key is not null"), s))
        where = components(linked)
        kept.append(known)
        known = known.drop("point")
        own = known.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
        own = own.join(where, own["key"] == where["node"], "left").select("key", "least", F.coalesce("component", "key").alias("root"))
        own = stash(own)
        kept.append(own)
    of_root = own.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = own.join(of_root, "root").select("key", "component_id")
    out = known.join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns, that stand for their group: of each component the one with the least id.

    Rows without an id come last, so one of them stays only where no row with an id is in its group.  Rows that repeat
    both id and text are one; different texts under one id are rows of their own.
    """
    named = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not named.where("n > 1 or doc_id is null").limit(1).count():
        stay = jaccard_components(docs, k, percent).where("doc_id = component_id").select(F.col("doc_id").alias("__stay"))
        return docs.join(stay, docs["doc_id"] == F.col("__stay"), "left_semi")
    # ids that are null or repeated name no row: rows are numbered in the order of ids, and written, so numbers stay
    rows = docs.dropDuplicates(["doc_id", "text"]).orderBy(F.col("doc_id").asc_nulls_last(), "text")
    rows = stash(rows.withColumn("__row", F.monotonically_increasing_id()))
    found = jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), k, percent)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__stay"))
    return rows.join(stay, rows["__row"] == F.col("__stay"), "left_semi").drop("__row")
