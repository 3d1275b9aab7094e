"""Sharding by a k-d tree: a node is split at the weighted median of its widest metadata dimension until its leaves
reach the target bytes.

What is placed are units: all rows with one text, a point of their own with the bytes of all of them, so that copies lie
in one shard.  A text whose rows have more bytes than a shard is cut into units of a 64th of a shard by a hash of the
ids.  Units are a narrow table, written anew with its nodes at each level.

Medians are found by radix descent: a histogram of the node's bytes over the next bits of the coordinate picks the bin
that holds the wanted weight, four times.  Each step is one grouped sum with partial aggregation; the driver sees one row
for each node.  Below the coordinate's bits come bits hashed from the text, so units that agree in every dimension are
still split evenly, and the same rows give the same shards however they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.llm.common import discard, stash

_VALUE_BITS, _TIE_BITS, _STEP_BITS, _STEPS = 20, 24, 11, 4
#: Pieces for each shard's worth of a text that is larger than a shard.
_FINE = 64


@dataclass(frozen=True)
class Dimension:
    """A metadata coordinate as an SQL expression for a number; null counts as the least value."""

    name: str
    sql: str


#: Log size, source and language by a hash of their name, and the id.
DIMENSIONS = (
    Dimension("size", "ln(cast(shard_size as double))"),
    Dimension("source", "cast(crc32(cast(source as binary)) as double)"),
    Dimension("lang", "cast(crc32(cast(lang as binary)) as double)"),
    Dimension("doc_id", "cast(doc_id as double)"),
)


def text_size(overhead: int = 16) -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(overhead).cast("long")


def text_key() -> Column:
    """128 bits of the text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _composite(n_dims: int, dim: Column) -> Column:
    """The chosen coordinate above the tie bits, as one integer."""
    value = F.element_at(F.array(*(F.col(f"__q{i}") for i in range(n_dims))), dim + 1)
    return value * F.lit(2**_TIE_BITS).cast("long") + F.col("__tie")


def _tie(*keys: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - _TIE_BITS)


def kd_shards(
    docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: tuple[Dimension, ...] = DIMENSIONS, size: Column | None = None, group: Column | None = None
) -> DataFrame:
    """The columns of ``docs`` plus ``shard_size``, ``shard_tie`` and ``shard``: all rows, in shards of near-equal bytes.

    Either the number of shards is given or the bytes a shard should have.  A node that stands for m shards is split
    at m//2 of m of its bytes, at the nearer end of the unit that lies there.  Rows of one ``group``, by default the text,
    stay together unless they have more bytes than a shard; then they are cut by their ids, and equal ids with more
    bytes than a shard by place.  Null metadata sorts first, a group has the least coordinates of its rows; ``size`` is a
    row's weight, by default its text's bytes and 16 (a null text has none), and is never null; clashing names are
    replaced; an empty table gives no rows.

    ``docs`` is read two or three times and should be a table.  Groups with more bytes than a shard are fewer than
    shards, which bounds what is broadcast and collected.
    """
    n = len(dims)
    given = docs.drop("shard", "shard_size", "shard_tie")
    rows = given.withColumn("shard_size", text_size() if size is None else size).withColumn("__key", text_key() if group is None else group)
    base = rows
    for i, d in enumerate(dims):
        base = base.withColumn(f"__x{i}", F.expr(d.sql).cast("double"))
    texts = stash(base.groupBy("__key").agg(F.sum("shard_size").alias("__w"), *(F.min(f"__x{i}").alias(f"__x{i}") for i in range(n))))
    ends = texts.agg(F.sum("__w").alias("w"), *(f(f"__x{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    total = ends["w"] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    share = max(1, total // n_shards)
    pieces = _pieces(rows, texts, share)
    units = texts.withColumn("__piece", F.lit(0)).withColumn("__part", F.lit(0))
    if pieces:
        cut = docs.sparkSession.createDataFrame(pieces, "__big binary, __n int, __piece int, __bytes long, __parts int")
        whole = units.join(F.broadcast(cut.select("__big").distinct()), F.col("__key") == F.col("__big"), "left_anti")
        parts = cut.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        of = texts.drop("__w").join(F.broadcast(parts), F.col("__key") == F.col("__big"))
        units = whole.unionByName(of.withColumn("__w", (F.col("__bytes") / F.col("__parts")).cast("long")).select(*whole.columns))
    top = 2**_VALUE_BITS - 1
    for i in range(n):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        spread = (hi - lo) if lo is not None and hi > lo else 0.0
        value = F.floor((F.col(f"__x{i}") - F.lit(lo)) / F.lit(spread) * top) if spread else F.lit(0)
        units = units.withColumn(f"__q{i}", F.coalesce(value, F.lit(0)).cast("long")).drop(f"__x{i}")
    units = units.withColumn("__tie", _tie("__key", "__piece", "__part"))
    leaves = _assigned(units, n, n_shards).select(F.col("__key").alias("__of"), F.col("__piece").alias("__p"), F.col("__part").alias("__q"), "shard")
    rows = rows.withColumn("shard_tie", _tie("__key", "doc_id"))
    at = _numbered(rows, pieces) if pieces else rows.withColumn("__piece", F.lit(0)).withColumn("__part", F.lit(0))
    out = at.join(leaves, (F.col("__key") == F.col("__of")) & (F.col("__piece") == F.col("__p")) & (F.col("__part") == F.col("__q")))
    return out.select(*(F.col(f"`{c}`") for c in given.columns), "shard_size", "shard_tie", "shard")


def _pieces(rows: DataFrame, texts: DataFrame, share: int) -> list[tuple]:
    """(key, modulus, piece, bytes, parts) of the texts with more bytes than ``share``, which are fewer than the shards:
    pieces of about a _FINE-th of it by id; a piece that is itself larger than ``share``, as its ids are equal, has several
    parts."""
    big = [(r["__key"], -(-_FINE * r["__w"] // share)) for r in texts.where(F.col("__w") > share).select("__key", "__w").collect()]
    if not big:
        return []
    table = rows.sparkSession.createDataFrame(big, "__big binary, __n int")
    piece = F.pmod(F.xxhash64("doc_id"), F.col("__n").cast("long")).cast("int").alias("__piece")
    sums = rows.join(F.broadcast(table), F.col("__key") == F.col("__big")).groupBy("__key", "__n", piece).agg(F.sum("shard_size").alias("w"))
    # at most _FINE + 1 pieces for each shard
    return [(r["__key"], r["__n"], r["__piece"], r["w"], 1 if r["w"] <= share else -(-_FINE * r["w"] // share)) for r in sums.collect()]


def _numbered(rows: DataFrame, pieces: list[tuple]) -> DataFrame:
    """``rows`` with ``__piece`` and ``__part``, 0 where a text or a piece is not cut."""
    spark = rows.sparkSession
    zero = F.lit(0)
    moduli = spark.createDataFrame(sorted({(bytes(key), n) for key, n, *_ in pieces}), "__big binary, __n int")
    heavy = [(bytes(key), piece, parts) for key, _, piece, _, parts in pieces if parts > 1]
    if heavy:
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
    at = rows.join(F.broadcast(moduli), F.col("__key") == F.col("__big"), "left")
    at = at.withColumn("__piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("__n").cast("long")).cast("int"), zero)).drop("__big", "__n")
    if not heavy:
        return at.withColumn("__part", zero)
    table = spark.createDataFrame(heavy, "__big binary, __of int, __parts int")
    at = at.join(F.broadcast(table), (F.col("__key") == F.col("__big")) & (F.col("__piece") == F.col("__of")), "left")
    return at.withColumn("__part", F.coalesce(F.pmod("__row", F.col("__parts").cast("long")).cast("int"), zero)).drop("__big", "__of", "__parts", "__row")


def _assigned(units: DataFrame, n: int, n_shards: int) -> DataFrame:
    """``units`` with the ``shard`` of the leaf they come to."""
    spark = units.sparkSession
    parts = {0: n_shards}  # node -> shards it stands for
    first = {0: 0}
    fresh = 1
    at = stash(units.withColumn("__node", F.lit(0).cast("long")))
    while any(m > 1 for m in parts.values()):
        span = at.groupBy("__node").agg(
            F.sum("__w").alias("w"), *(f(f"__q{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max)))
        ).collect()
        seen = {r["__node"]: r for r in span}
        wanted = {}
        for node in sorted(k for k, m in parts.items() if m > 1):
            r = seen.get(node)
            dim = max(range(n), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i)) if r else 0
            wanted[node] = dim, (r["w"] if r else 0) * (parts[node] // 2) / parts[node]
        cuts = _medians(at, wanted, n)
        splits = []
        for node, (dim, _) in wanted.items():
            a, b = fresh, fresh + 1
            fresh += 2
            splits.append((node, dim, cuts.get(node, -1), a, b))
            left = parts[node] // 2
            parts[a], parts[b] = left, parts.pop(node) - left
            first[a], first[b] = first[node], first.pop(node) + left
        # one row for each node of the level
        table = spark.createDataFrame(splits, "__node long, __dim int, __cut long, __left long, __right long")
        side = F.when(F.col("__dim").isNull(), F.col("__node")).when(_composite(n, F.col("__dim")) <= F.col("__cut"), F.col("__left")).otherwise(F.col("__right"))
        placed = at.join(F.broadcast(table), "__node", "left").withColumn("__node", side).drop("__dim", "__cut", "__left", "__right")
        before, at = at, stash(placed)
        discard(before)
    leaves = spark.createDataFrame([(k, first[k]) for k in parts], "__node long, shard int")
    return at.join(F.broadcast(leaves), "__node")


def _medians(here: DataFrame, wanted: dict[int, tuple[int, float]], n_dims: int) -> dict[int, int]:
    """For each node the composite coordinate up to which the wanted bytes lie, to _STEPS * _STEP_BITS bits."""
    spark = here.sparkSession
    low = {k: 0 for k in wanted}
    rest = {k: w for k, (_, w) in wanted.items()}
    held: dict[int, int] = {}
    bits = _VALUE_BITS + _TIE_BITS
    for step in range(_STEPS):
        shift = bits - (step + 1) * _STEP_BITS
        rows = [(k, wanted[k][0], low[k] >> (shift + _STEP_BITS), float(rest[k])) for k in wanted]
        table = spark.createDataFrame(rows, "__node long, __dim int, __prefix long, __want double")
        at = here.join(F.broadcast(table), "__node").withColumn("__c", _composite(n_dims, F.col("__dim")))
        at = at.where(F.shiftright("__c", shift + _STEP_BITS) == F.col("__prefix")).withColumn("__bin", F.shiftright("__c", shift))
        bins = at.groupBy("__node", "__bin", "__want").agg(F.sum("__w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("__node").orderBy("__bin"))  # at most 2^_STEP_BITS bins a node
        found = (
            bins.withColumn("upto", upto)
            .groupBy("__node")
            .agg(
                F.min(F.when(F.col("upto") >= F.col("__want"), F.struct("__bin", (F.col("upto") - F.col("w")).alias("before"), "w"))).alias("hit"),
                F.max(F.struct("__bin", (F.col("upto") - F.col("w")).alias("before"), "w")).alias("last"),
            )
            .collect()
        )
        for r in found:
            hit = r["hit"] or r["last"]
            low[r["__node"]] = hit["__bin"] << shift
            rest[r["__node"]] -= hit["before"]
            held[r["__node"]] = hit["w"]
    # the nearer end of the last bin: with its units, or without
    return {k: low[k] if held.get(k, 0) - rest[k] <= rest[k] else low[k] - 1 for k in wanted}


def with_slots(sharded: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds ``slot``, the gapless position within the shard: counts of hashed buckets give offsets, and numbering runs
    within a bucket, so no shard is ordered in one task.  Expects the result of :func:`kd_shards`."""
    total = sharded.count()
    n_shards = sharded.agg(F.max("shard")).first()[0]
    buckets = max(8, -(-total // (max(1, (n_shards or 0) + 1) * rows_per_bucket)))
    rows = sharded.withColumn("__bucket", F.pmod("shard_tie", F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    at = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("shard_tie", "doc_id"))
    rows = rows.withColumn("__at", at)
    return rows.join(offsets, ["shard", "__bucket"]).withColumn("slot", (F.col("__offset") + F.col("__at") - 1).cast("long")).drop("__bucket", "__offset", "__at")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, with as many files as tasks had rows of it."""
    sharded.write.partitionBy("shard").parquet(path)
