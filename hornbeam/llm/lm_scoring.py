"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of order 3, 2, 1 and 0 (uniform)::

    p(w | u v) = a3[b] * c(u v w) / c(u v)  +  a2[b] * c(v w) / c(v)  +  a1[b] * c(w) / N  +  a0[b] / (V + 1)

with one set of weights for each bucket b of context frequency: that of c(u v) where the pair was seen, else that of c(v).
Training texts are split by a hash of the text, so copies stand on one side: most give counts, the rest are held out, and
expectation-maximisation on the held-out words learns the weights.  Then the held-out counts are added, and the model
that scores has the counts of all training texts.

Counting every pair and triple as a row would be most of the cost, so counting is done in arrays.  Texts are packed into
blocks as they are read; a block lists its distinct words and pairs once, sorted, with its own counts, and after each pair
24 bits of the hash of each word that follows it; lists go to buckets by the hash of the word or pair, are summed there,
and the sums go back to the block in the block's order, without the keys.  Every text is scored whole.  Held-out texts are
packed apart, so that learning the weights reads only their blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.llm.common import few_at_a_time, partitions, stash, tidy
from hornbeam.llm.kernels import U, Words, chunks, mix, release, slices

_START, _END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


@dataclass(frozen=True)
class Settings:
    """``held_out_of`` = 12: one in twelve training texts is held out for the weights.  Buckets of context frequency are
    powers of ``bucket_base``; the last takes all above.  The grid of held-out estimates, which is all that the driver
    sees, has ``2 * buckets * grid ** 3`` cells at most."""

    held_out_of: int = 12
    bucket_base: float = 4.0
    buckets: int = 12
    grid: int = 24
    em_rounds: int = 60
    #: Bytes of text in a block and, by the input's size, for each bucket.  Larger inputs want larger blocks, as each
    #: block has a list for each bucket; both must fit a task's memory some ten times over.
    block_bytes: int = 4 << 20
    bucket_bytes: int = 4 << 20


def bucket_of(count: np.ndarray, s: Settings) -> np.ndarray:
    """0 for an unseen context, then powers of the base."""
    level = np.floor(np.log(np.maximum(count, 1)) / np.log(s.bucket_base) + 1e-9).astype(np.int64) + 1
    return np.where(count > 0, np.minimum(level, s.buckets - 1), 0)


def mixture_of(pair_context: np.ndarray, context: np.ndarray, s: Settings) -> np.ndarray:
    """Which weights hold: those of the pair's frequency where it was seen, else those of the word's."""
    return np.where(pair_context > 0, s.buckets + bucket_of(pair_context, s), bucket_of(context, s))


def _streams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets): each text's word hashes with the end token, and before them the start."""
    for first, data, offsets in chunks(column):
        words = Words(data, offsets)
        counts = np.diff(words.offsets)
        to = np.concatenate(([0], np.cumsum(counts + 2)))
        out = np.empty(to[-1], np.uint64)
        body = np.ones(to[-1], bool)
        body[to[:-1]] = body[to[1:] - 1] = False
        out[body] = words.hash
        out[to[:-1]], out[to[1:] - 1] = _START, _END
        yield first, out, to


def _pairs(stream: np.ndarray) -> np.ndarray:
    """A hash of each neighbouring pair, 56 bits; pairs that run over two texts are the caller's to leave out."""
    return mix(stream[:-1] * U(0x9E3779B97F4A7C15) + mix(stream[1:])) >> U(8)


# parts of the training split, as told by the caller's ``part`` column
COUNTED, HELD_OUT, UNSEEN = 0, 1, 2


def _sequence(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each token, word before it, word, pair of both, whether the word before is the start)."""
    for first, stream, to in _streams(texts):
        inner = np.ones(len(stream), bool)
        inner[to[:-1]] = False
        inner = inner[1:]
        row = np.repeat(np.arange(len(to) - 1), np.diff(to) - 1)
        opens = np.zeros(len(row), bool)
        opens[to[:-1] - np.arange(len(to) - 1)] = True
        yield first, row, stream[:-1][inner], stream[1:][inner], _pairs(stream)[inner], opens


def _triples(place: np.ndarray, word: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each token but the first of a text: the place of the pair before it and 24 bits of its own hash."""
    return ((place[:-1] << 24) | (word[1:] >> U(40)).astype(np.int64))[~opens[1:]]


class _Block:
    """Distinct words, pairs and triples of some texts, in ascending order, with their counts in training."""

    def __init__(self, texts: pa.Array, trained: np.ndarray):
        parts = [(trained[first + row], v, w, pair, opens) for first, row, v, w, pair, opens in _sequence(texts)]
        join = lambda i, kind: np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, kind)
        counted, before, word, pair, opens = (join(i, k) for i, k in enumerate((bool, np.uint64, np.uint64, np.uint64, bool)))
        del parts

        def told(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            distinct, place = np.unique(keys, return_inverse=True)
            return distinct, place, np.bincount(place[counts], minlength=len(distinct))

        # starts are contexts, never tokens
        self.words, _, self.word_counts = told(np.concatenate((word, before[opens])), np.concatenate((counted, counted[opens])))
        self.pairs, place, self.pair_counts = told(pair, counted)
        self.triples, _, self.triple_counts = told(_triples(place, word, opens), counted[1:][~opens[1:]])


def _dense(raw: bytes) -> bytes:
    """Entropy-coded; small counts and the high bytes of steps take a few bits each."""
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _full(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[4:], int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True)


def _small(x: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for a count told in full beside."""
    large = np.flatnonzero(x >= 255)
    return _dense(len(large).to_bytes(4, "little") + large.astype("<u4").tobytes() + x[large].astype("<u8").tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes())


def _wide(raw: bytes) -> np.ndarray:
    raw = _full(raw)
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, offset=4 + 12 * n).astype(np.int64)
    out[np.frombuffer(raw, "<u4", n, 4)] = np.frombuffer(raw, "<u8", n, 4 + 4 * n).astype(np.int64)
    return out


def _delta(x: np.ndarray, width: int) -> bytes:
    """Ascending numbers as their differences, in ``width`` bytes each, of which the high one is entropy-coded; what a wider
    step has beyond is told beside."""
    d = np.diff(x, prepend=U(0)) if len(x) else x
    bits = U(8 * width)
    wide = np.flatnonzero(d >> bits)
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    high = _dense(len(wide).to_bytes(4, "little") + wide.astype("<u4").tobytes() + (d[wide] >> bits).astype("<u4").tobytes() + planes[-1].tobytes())
    return bytes([width]) + len(high).to_bytes(4, "little") + high + planes[:-1].tobytes()


def _undelta(raw: bytes) -> np.ndarray:
    width, to = raw[0], 5 + int.from_bytes(raw[1:5], "little")
    high = _full(raw[5:to])
    n = int.from_bytes(high[:4], "little")
    at, beyond = np.frombuffer(high, "<u4", n, 4), np.frombuffer(high, "<u4", n, 4 + 4 * n)
    top = np.frombuffer(high, np.uint8, offset=4 + 8 * n)
    full = np.zeros((len(top), 8), np.uint8)
    full[:, : width - 1] = np.frombuffer(raw, np.uint8, offset=to).reshape(width - 1, -1).T
    full[:, width - 1] = top
    d = full.reshape(-1).view("<u8").copy()
    d[at] |= beyond.astype(np.uint64) << U(8 * width)
    return np.cumsum(d, dtype=np.uint64)


def _cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Bounds of equal ranges of the keys, ascending keys assumed."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


_LIST = "block long, held boolean, kind int, bucket int, keys binary, counts binary, fan binary, codes binary, triples binary"
#: ``learn`` counts without the held-out texts, for held-out blocks alone; ``all`` those of all training texts.
_REPLY = "block long, kind int, bucket int, learn binary, all binary, learn3 binary, all3 binary, tokens long, model_tokens long, distinct long"


def _packed(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows(doc_id, text, part)`` as ``block, held, body``, a row for each block; runs where it reads.

    The body is one compressed value: as arrays, a hundred blocks would be open in a page of the written table, and texts
    would be shuffled at nearly their full size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        open_blocks: dict[bool, list] = {True: [], False: []}
        made = 0

        def close(held: bool) -> pa.RecordBatch:
            nonlocal made
            ids, texts, parts = zip(*open_blocks[held])
            open_blocks[held] = []
            made += 1
            body = pa.array([_body(pa.table({"ids": pa.array(ids, pa.int64()), "texts": pa.array(texts, pa.string()), "parts": pa.array(parts, pa.int64())}))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([held]), body], names=["block", "held", "body"])

        size = {True: 0, False: 0}
        for batch in slices(batches):
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held = row[2] == HELD_OUT
                open_blocks[held].append(row)
                size[held] += 2 * len(row[1]) if not row[1].isascii() else len(row[1])
                if size[held] >= s.block_bytes:
                    size[held] = 0
                    yield close(held)
        for held in (True, False):
            if open_blocks[held]:
                yield close(held)

    return rows.mapInArrow(pack, "block long, held boolean, body binary")


def _body(texts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema) as out:
        out.write_table(texts)
    return pa.compress(sink.getvalue(), codec="zstd", asbytes=True) + len(sink.getvalue()).to_bytes(8, "little")


def _unpacked(row: pa.RecordBatch | pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids, texts and parts of a block's row."""
    raw = memoryview(row["body"][0].as_py())
    body = pa.ipc.open_stream(pa.decompress(raw[:-8], int.from_bytes(raw[-8:], "little"), codec="zstd")).read_all()
    ids, texts, parts = (body[c].combine_chunks() for c in ("ids", "texts", "parts"))
    return ids, texts, parts.to_numpy()


def _trained(parts: np.ndarray) -> np.ndarray:
    return parts != UNSEEN


def _count(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts for every block's lists.  ``tokens`` and the like are sums over a bucket, told once in it."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one_block(batch.slice(i, 1))
            release()

    def one_block(row: pa.RecordBatch) -> pa.RecordBatch:
        block, held = row.column("block")[0].as_py(), row.column("held")[0].as_py()
        _, texts, parts = _unpacked(row)
        b = _Block(texts, _trained(parts))
        out = []
        # a step between neighbours is about 2**45 for words and 2**35 for pairs
        cut = _cuts(b.words, buckets, 64)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            x = slice(cut[i], cut[i + 1])
            out.append((block, held, 0, i, _delta(b.words[x], 6), _small(b.word_counts[x]), b"", b"", b""))
        cut = _cuts(b.pairs, buckets, 56)
        owner = b.triples >> 24
        fan, own = np.bincount(owner, minlength=len(b.pairs)), np.searchsorted(owner, cut)
        codes = b.triples.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
        for i in np.flatnonzero(np.diff(cut)).tolist():
            x, y = slice(cut[i], cut[i + 1]), slice(own[i], own[i + 1])
            out.append((block, held, 1, i, _delta(b.pairs[x], 5), _small(b.pair_counts[x]), _small(fan[x]), codes[y].tobytes(), _small(b.triple_counts[y])))
        columns = list(zip(*out)) if out else [()] * 9
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
        names = ["block", "held", "kind", "bucket", "keys", "counts", "fan", "codes", "triples"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def summed(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        held = group["held"].to_pylist()
        lists = [_undelta(x) for x in group["keys"].to_pylist()]
        ends = np.cumsum([len(x) for x in lists])
        keys, place = np.unique(np.concatenate(lists), return_inverse=True)
        places = np.split(place, ends[:-1])
        del lists, place

        def totals(places: list[np.ndarray], column: str, distinct: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
            """Sums without the held-out lists and with them, and what each list is told of both."""
            learn, rest = np.zeros(distinct), np.zeros(distinct)
            for p, h, raw in zip(places, held, group[column].to_pylist()):
                (rest if h else learn)[p] += _wide(raw)  # a list has no key twice
            both = (learn + rest).astype(np.int64)
            learn = learn.astype(np.int64)
            return learn, both, [_small(learn[p]) if h else b"" for p, h in zip(places, held)], [_small(both[p]) for p in places]

        learn, both, told, told_all = totals(places, "counts", len(keys))
        sizes = (0, 0, 0)
        told3 = told_all3 = [b""] * len(held)
        if kind == 0:
            token = keys != _START
            sizes = int(both[token].sum()), int(learn[token].sum()), int((both[token] > 0).sum())
        else:
            own = []
            for p, fan, codes in zip(places, group["fan"].to_pylist(), group["codes"].to_pylist()):
                raw = np.frombuffer(codes, np.uint8).reshape(-1, 3).astype(np.int64)
                own.append((np.repeat(p, _wide(fan)) << 24) | raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16)
            ends = np.cumsum([len(x) for x in own])
            distinct, place = np.unique(np.concatenate(own), return_inverse=True)
            del own
            _, _, told3, told_all3 = totals(np.split(place, ends[:-1]), "triples", len(distinct))
        n = len(held)
        return pa.table(
            {
                "block": group["block"],
                "kind": pa.array([kind] * n, pa.int32()),
                "bucket": pa.array([bucket] * n, pa.int32()),
                **{k: pa.array(v, pa.binary()) for k, v in (("learn", told), ("all", told_all), ("learn3", told3), ("all3", told_all3))},
                **{k: pa.array([v] + [0] * (n - 1), pa.int64()) for k, v in zip(("tokens", "model_tokens", "distinct"), sizes)},
            }
        )

    return rows.mapInArrow(listed, _LIST).groupBy("kind", "bucket").applyInArrow(summed, _REPLY)


class _Known:
    """A block's words, pairs and triples with their corpus counts, from the replies: ``all``, or ``learn`` for a held-out
    block."""

    def __init__(self, texts: pa.Array, parts: np.ndarray, reply: pa.Table, counts: str = "all"):
        block = _Block(texts, _trained(parts))
        got = sorted(zip(*(reply[c].to_pylist() for c in ("kind", "bucket", counts, counts + "3"))))
        join = lambda kind, i: np.concatenate([_wide(x[i]) for x in got if x[0] == kind] or [np.zeros(0, np.int64)])
        self.words, self.word = block.words, join(0, 2)
        self.pairs, self.pair = block.pairs, join(1, 2)
        self.triples, self.triple = block.triples, join(1, 3)

    def tokens(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        """(first row, row of each token, its c(u v w), c(u v), c(v w), c(v), c(w)) for runs of rows; the first two are 0
        for a text's first word."""
        for first, row, v, w, pair, opens in _sequence(texts):
            place = np.searchsorted(self.pairs, pair)
            triple, pair_context = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            later = np.flatnonzero(~opens)
            triple[later] = self.triple[np.searchsorted(self.triples, _triples(place, w, opens))]
            pair_context[later] = self.pair[place[later - 1]]
            yield first, row, (triple, pair_context, self.pair[place], self.word[np.searchsorted(self.words, v)], self.word[np.searchsorted(self.words, w)])


def _estimates(triple, pair_context, pair, context, word, model_tokens: int) -> np.ndarray:
    """Maximum-likelihood estimates of orders 3, 2 and 1, a row each; 0 for an unseen context."""
    ratio = lambda x, y: np.where(y > 0, x / np.maximum(y, 1), 0.0)
    return np.stack([ratio(triple, pair_context), ratio(pair, context), word / max(model_tokens, 1)])


def expectation_maximisation(bucket, estimates, p0: float, weight, s: Settings) -> np.ndarray:
    """Mixture weights (2 * buckets, 4) that fit the held-out estimates (3, n); an empty bucket takes those of all buckets.

    An unseen context has no estimate: bucket 0 gives orders 3 and 2 no weight, the other buckets of words none to order 3.
    """
    out = np.zeros((2 * s.buckets, 4))
    everything = None
    for b in (-1, *range(2 * s.buckets)):
        open_orders = np.array([b < 0 or b >= s.buckets, b != 0, True, True])
        here = slice(None) if b < 0 else bucket == b
        x, n = estimates[:, here], weight[here]
        mixed = np.array([0.3, 0.3, 0.3, 0.1]) * open_orders if everything is None or n.sum() else everything * open_orders
        mixed /= mixed.sum()
        if n.sum() > 0:
            x = np.vstack([x, np.full((1, x.shape[1]), p0)])
            for _ in range(s.em_rounds):
                part = mixed[:, None] * x
                mixed = (part / part.sum(0) * n).sum(1) / n.sum()
            mixed = np.maximum(mixed, 1e-6) * open_orders
            mixed /= mixed.sum()
        if b < 0:
            everything = mixed
        else:
            out[b] = mixed
    return out


def _learn(rows: DataFrame, replies: DataFrame, sizes: tuple[int, int, int], s: Settings) -> np.ndarray:
    """Weights from the held-out words, through a grid of their estimates that is summed on the executors."""
    _, model_tokens, distinct = sizes
    sums = ("n", "p3", "p2", "p1")

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        cells: dict[int, np.ndarray] = {}
        if left.num_rows and right.num_rows:
            _, texts, parts = _unpacked(left)
            for _, _, counts in _Known(texts, parts, right, "learn").tokens(texts):
                p = _estimates(*counts, model_tokens)
                # octaves; 0 is told apart
                step = np.where(p > 0, np.clip(s.grid - 1 + np.floor(np.log2(np.maximum(p, 1e-300))), 1, s.grid - 1), 0).astype(np.int64)
                cell = mixture_of(counts[1], counts[3], s)
                for at in step:
                    cell = cell * s.grid + at
                cell, place = np.unique(cell, return_inverse=True)
                for c, total in zip(cell.tolist(), np.stack([np.bincount(place, w, len(cell)) for w in (np.ones(p.shape[1]), *p)]).T):
                    cells[c] = cells.get(c, 0) + total
        items = sorted(cells.items())
        return pa.table({"cell": pa.array([c for c, _ in items], pa.int64()), **{k: pa.array([float(v[i]) for _, v in items], pa.float64()) for i, k in enumerate(sums)}})

    held = rows.where("held").select("block", "body")
    told = replies.select("block", "kind", "bucket", "learn", "learn3").join(held.select("block"), "block", "left_semi")
    grid = held.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(gather, "cell long, n double, p3 double, p2 double, p1 double")
    cells = grid.groupBy("cell").agg(*(F.sum(c).alias(c) for c in sums)).orderBy("cell").collect()
    n = np.array([c["n"] for c in cells])
    estimates = np.array([[c[k] for c in cells] for k in sums[1:]]).reshape(3, -1) / np.maximum(n, 1)
    bucket = np.array([c["cell"] for c in cells], np.int64) // s.grid**3
    return expectation_maximisation(bucket, estimates, 1.0 / (distinct + 1), n, s)


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
    + [T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
)


def score(docs: DataFrame, training: Column, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    ``training`` is a boolean expression over ``docs``; rows for which it is true are learned from, null counts as
    false.  Tokens are words, A-Z lower-cased, and one end for each text, so an empty or null text has one token.
    Words of one pair of words before are told apart by 24 bits of their hashes.
    ``n_known`` counts tokens seen in training, ``base_score`` is the add-half unigram sum, ``score`` the model's log10
    probability.  Without any counted text the uniform order has all the weight.  Repeated rows give repeated results
    (and count as often as they occur), other columns are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, min(4 * partitions(spark), total // s.bucket_bytes))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    held = F.pmod(F.xxhash64(text, F.lit(5)), F.lit(s.held_out_of)) == 0
    part = F.when(F.coalesce(training, F.lit(False)), F.when(held, HELD_OUT).otherwise(COUNTED)).otherwise(UNSEEN)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), part.cast("long").alias("part"))
    # which text is in which block must not change any more: replies have their block's order
    rows = stash(_packed(rows, s), wide=True)
    with few_at_a_time(spark):
        replies = stash(_count(rows, buckets))
    sizes = tuple(int(x or 0) for x in replies.agg(F.sum("tokens"), F.sum("model_tokens"), F.sum("distinct")).first())
    tokens, model_tokens, distinct = sizes
    mixture = _learn(rows, replies, sizes, s) if model_tokens else np.tile([0.0, 0.0, 0.0, 1.0], (2 * s.buckets, 1))
    tidy(spark)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], pa.float64() if f.dataType == T.DoubleType() else pa.int64()) for f in RESULT})
        ids, texts, parts = _unpacked(left)
        n = len(texts)
        known = _Known(texts, parts, right)
        out = np.zeros((4, n))
        for first, row, counts in known.tokens(texts):
            p = np.vstack([_estimates(*counts, tokens), np.full((1, len(row)), 1.0 / (distinct + 1))])
            p = (mixture[mixture_of(counts[1], counts[3], s)].T * p).sum(0)
            word = counts[4]
            base = np.log10((word + 0.5) / (tokens + 0.5 * (distinct + 1)))
            m = int(row.max()) + 1
            for k, x in enumerate((None, (word > 0).astype(float), base, np.log10(p))):
                out[k, first : first + m] += np.bincount(row, x, m)
        columns = [ids, pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(out[2]), pa.array(out[3])]
        return pa.table(dict(zip(RESULT.names, columns)))

    told = replies.select("block", "kind", "bucket", "all", "all3")
    return rows.select("block", "body").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, RESULT)
