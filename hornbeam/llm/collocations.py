"""Phrase collocation mining by pivot partitioning.

Words are ranked by frequency.  A phrase belongs to its rarest word, its pivot, and an occurrence of it to the first
occurrence of the pivot inside.  Around each occurrence of a word the text is rewritten for that pivot: up to three words
to the left that are more frequent, up to three to the right that are not rarer, nothing beyond the first word that is
rarer, too rare for any phrase, or in another piece.  Such fragments go to the pivot's bucket, which counts the phrases
that hold the pivot, shortest first, and longer ones only where the shorter are frequent.  So every phrase is counted in
one place, and what is sent is at most one fragment for each word.

Texts are packed into blocks with their distinct words; each block gets the ranks of its own words through a join, so no
list of words is ever broadcast.  A pivot with very many occurrences is dealt out over several buckets by block; their
counts are summed.  Counts and scores are whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.llm.common import partitions, stash, tidy
from hornbeam.llm.kernels import Words, mix
from hornbeam.operators.ranking import running

#: Bytes at which a text is split into pieces, and those that separate words.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_IS_END = np.zeros(256, bool)
_IS_END[list(_PIECE_ENDS)] = True
_BETWEEN = _IS_END.copy()
_BETWEEN[[9, 32]] = True
LONGEST = 4


@dataclass(frozen=True)
class Settings:
    """Phrases have 2 to 4 words and ``min_count`` occurrences.  One is dropped if a longer one that holds it has
    ``absorbed`` per cent of its occurrences.  ``top`` phrases a language are reported.

    ``block_bytes`` of text are worked on at a time and ``bucket_bytes`` of the input make a bucket; both must fit a task's
    memory some thirty times over.  Pivots with more than ``hot`` occurrences are dealt out."""

    min_count: int = 30
    absorbed: int = 80
    top: int = 2000
    block_bytes: int = 4 << 20
    bucket_bytes: int = 4 << 20
    hot: int = 1 << 20


def _block_words(data: bytes) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, distinct hashes, first place and place among the distinct of each word)."""
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False, separators=_BETWEEN)
    return words, *np.unique(words.hash, return_index=True, return_inverse=True)


def _cut_place(data: bytes, limit: int) -> int:
    """Where a long text may be cut: after the last end of a piece before ``limit``, else after the next one."""
    last = max(data.rfind(c, 0, limit) for c in _PIECE_ENDS)
    if last < 0:
        last = min((x for c in _PIECE_ENDS if (x := data.find(c, limit)) >= 0), default=len(data) - 1)
    return last + 1


def packed(docs: DataFrame, s: Settings) -> DataFrame:
    """``block, lang, data, words, counts``: lower-cased texts of one language, joined by line ends, with their distinct
    words in the order of their hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId() << 32, 0
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            data = b"\n".join(waiting.pop(lang))
            sizes.pop(lang)
            while data:
                cut = _cut_place(data, s.block_bytes) if len(data) > 2 * s.block_bytes else len(data)
                head, data = data[:cut], data[cut:]
                words, _, first, place = _block_words(head)
                listed = [head[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
                made += 1
                columns = [
                    pa.array([task + made], pa.int64()), pa.array([lang], pa.string()), pa.array([head], pa.binary()),
                    pa.array([listed], pa.list_(pa.binary())), pa.array([np.bincount(place, minlength=len(first))], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "data", "words", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    waiting.setdefault(lang, []).append(text.lower())  # of bytes: A-Z alone
                    sizes[lang] = sizes.get(lang, 0) + len(text)
                    if sizes[lang] >= s.block_bytes:
                        yield from close(lang)
                    elif sum(sizes.values()) > 4 * s.block_bytes:  # many languages
                        yield from close(max(sizes, key=sizes.get))
        for lang in list(waiting):
            yield from close(lang)

    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").cast("binary").alias("text"))
    return rows.where("length(text) > 0").mapInArrow(pack, "block long, lang string, data binary, words array<binary>, counts array<long>")


def _fragments(data: bytes, rank: np.ndarray, deals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot, its neighbours at -3, -2, -1, 1, 2, 3 or 0, deals of the pivot) from the ranks of the block's distinct words."""
    words, _, _, place = _block_words(data)
    n, r = len(words.start), rank[place]
    piece = np.cumsum(_IS_END[np.frombuffer(data, np.uint8)])[words.start] if n else np.zeros(0, np.int64)
    around = np.zeros((n, 6), np.int64)
    for side, column, sign in ((0, (2, 1, 0), -1), (1, (3, 4, 5), 1)):
        open_ = r > 0
        for d in range(1, LONGEST):
            i = np.arange(n) + sign * d
            inside = (i >= 0) & (i < n)
            i = np.clip(i, 0, max(n - 1, 0))
            other = r[i]
            open_ = open_ & inside & (piece[i] == piece) & (other > 0) & ((other <= r) if side else (other < r))
            around[open_, column[d - 1]] = other[open_]
    used = np.flatnonzero((around[:, 2] > 0) | (around[:, 3] > 0))
    return r[used], around[used], deals[place[used]]


def _encoded(pivot: np.ndarray, around: np.ndarray) -> bytes:
    """Fragments by pivot: their number, pivots, which neighbours there are, and these."""
    there = around > 0
    raw = len(pivot).to_bytes(4, "little") + pivot.astype("<u4").tobytes() + np.packbits(there, axis=1).tobytes() + around[there].astype("<u4").tobytes()
    return zlib.compress(raw, 1)


def _decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    m = int.from_bytes(raw[:4], "little")
    pivot = np.frombuffer(raw, "<u4", m, 4)
    there = np.unpackbits(np.frombuffer(raw, np.uint8, m, 4 + 4 * m)[:, None], axis=1, count=6).astype(bool)
    around = np.zeros((m, 6), np.uint32)
    around[there] = np.frombuffer(raw, "<u4", offset=4 + 5 * m)
    return pivot, around


def _counted(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, count) of the distinct phrases, and each row's count.  A phrase's ranks fill two numbers from the left."""
    w = [x.astype(np.uint64) for x in words] + [np.zeros(len(words[0]), np.uint64)] * (LONGEST - len(words))
    high, low = w[0] << np.uint64(32) | w[1], w[2] << np.uint64(32) | w[3]
    by = np.lexsort((low, high)) if len(words) > 2 else np.argsort(high)
    new = np.ones(len(by), bool)
    new[1:] = (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(by)))
    of_row = np.empty(len(by), np.int64)
    of_row[by] = np.repeat(count, count)
    return high[by][head], low[by][head], count, of_row


def mine(pivot: np.ndarray, around: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(high, low, count) of the phrases that occur ``least`` times in these fragments.  With ``a`` words left and ``b`` right
    of the pivot a phrase can only be frequent if those with one word less on a side are."""
    rows_count: dict[tuple[int, int], np.ndarray] = {}
    for total in range(1, LONGEST):
        for a in range(total + 1):
            b = total - a
            there = np.ones(len(pivot), bool)
            if a:
                there &= around[:, 3 - a] > 0
            if b:
                there &= around[:, 2 + b] > 0
            for shorter in ((a - 1, b), (a, b - 1)):
                if shorter in rows_count:
                    there &= rows_count[shorter] >= least
            rows = np.flatnonzero(there)
            count = np.zeros(len(pivot), np.int64)
            if len(rows):
                high, low, n, of_row = _counted([*(around[rows, 3 - i] for i in range(a, 0, -1)), pivot[rows], *(around[rows, 2 + i] for i in range(1, b + 1))])
                count[rows] = of_row
                often = n >= least
                yield high[often], low[often], n[often]
            rows_count[a, b] = count


def _phrases(blocks: DataFrame, ranked: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """``high, low, a`` for every phrase with at least ``min_count`` occurrences."""
    own = blocks.select(F.col("block").alias("to"), "lang", F.posexplode("words").alias("at", "word"))
    known = own.join(ranked, ["lang", "word"]).select("to", "at", "rank", F.ceil(F.col("f") / s.hot).cast("int").alias("deals"))

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            block, data = left["block"][0].as_py(), left["data"][0].as_py()
            at = right["at"].to_numpy()
            rank, deals = (np.zeros(int(at.max()) + 1, np.int64) for _ in range(2))
            rank[at], deals[at] = right["rank"].to_numpy(), right["deals"].to_numpy()
            size = len(_block_words(data)[1])
            rank, deals = np.pad(rank, (0, size - len(rank))), np.pad(deals, (0, size - len(deals)))
            pivot, around, deals = _fragments(data, rank, deals)
            turn = mix(np.array([block], np.uint64))[0] % np.maximum(deals, 1).astype(np.uint64)
            bucket = (mix(pivot.astype(np.uint64) + (turn << np.uint64(40))) % np.uint64(buckets)).astype(np.int64) * 2 + (deals > 1)
            by = np.lexsort((pivot, bucket))
            pivot, around, bucket = pivot[by], around[by], bucket[by]
            cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket)) if len(bucket) else [0]
            out = [(int(bucket[i]), _encoded(pivot[i:j], around[i:j])) for i, j in zip(cut[:-1], cut[1:])]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "fragments": pa.array([x[1] for x in out], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        parts = [_decoded(x) for x in group["fragments"].to_pylist()]
        pivot, around = (np.concatenate(x) for x in zip(*parts))
        del parts
        found = list(mine(pivot, around, 1 if bucket % 2 else s.min_count))
        high, low, a = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"dealt": pa.array(np.full(len(a), bool(bucket % 2))), **{k: pa.array(v.astype(np.int64)) for k, v in (("high", high), ("low", low), ("a", a))}})

    fragments = blocks.select("block", "data").groupBy("block").cogroup(known.groupBy("to")).applyInArrow(route, "bucket long, fragments binary")
    mined = stash(fragments.groupBy("bucket").applyInArrow(count, "dealt boolean, high long, low long, a long"))
    summed = mined.where("dealt").groupBy("high", "low").agg(F.sum("a").alias("a")).where(F.col("a") >= s.min_count)
    return mined.where("not dealt").select("high", "low", "a").unionByName(summed)


_RANKS = "filter(array(shiftright(high, 32), high & 4294967295L, shiftright(low, 32), low & 4294967295L), x -> x > 0)"


def _key(ranks: str) -> list:
    """``high`` and ``low`` of an array of ranks."""
    at = [f"coalesce(get({ranks}, {i}), 0L)" for i in range(LONGEST)]
    return [F.expr(f"shiftleft({at[0]}, 32) | {at[1]}").alias("high"), F.expr(f"shiftleft({at[2]}, 32) | {at[3]}").alias("low")]


def _scored(cuts: DataFrame) -> DataFrame:
    """``score``: 2000000 * a / (l + r) in two steps of whole numbers, whose products stay below 64 bits up to 4 * 10^15 words."""
    cuts = cuts.withColumn("s", F.expr("l + r")).withColumn("q", F.expr("(1000 * a) div s"))
    return cuts.withColumn("score", F.expr("2000 * q + (2000 * (1000 * a - q * s)) div s")).drop("s", "q")


def _first(scored: DataFrame, by: list, top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` for each language's first ``top`` phrases of ``docs(text, lang)``, by score and
    ``a`` descending, then phrase ascending.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.  ``a`` counts
    a phrase's occurrences within pieces, overlaps included, ``n`` all words of the language.  Cut after its first k words
    the parts occur ``l`` and ``r`` times; the score is ``floor(2000000 * a / (l + r))`` at the cut where that is least, ties to
    the smallest k.  Phrases that a longer candidate holds and has ``absorbed`` per cent of are dropped.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they occur; other
    columns are not read; an empty table gives no rows.  Words are told apart by 64-bit hashes within a block.
    """
    spark = docs.sparkSession
    blocks = stash(packed(docs, s))
    total = blocks.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    buckets = max(8, min(4 * partitions(spark), total // s.bucket_bytes))
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = stash(each.groupBy("lang", "word").agg(F.sum("c").alias("f")))
    often = words.where(F.col("f") >= s.min_count).withColumn("one", F.lit(1).cast("long"))
    ranked = stash(running(often, [], [F.col("f").desc(), F.col("lang"), F.col("word")], {"rank": "one"}).select("lang", "word", "f", "rank"))
    if ranked.count() >= 1 << 31:
        raise ValueError("more than 2^31 frequent words: raise min_count")
    found = stash(_phrases(blocks, ranked, buckets, s))
    tidy(spark)

    found = found.withColumn("ranks", F.expr(_RANKS))
    # a phrase's parts of two words and more: prefixes (1), suffixes (2), halves are both, the middle of four words (0)
    longer = found.where("size(ranks) > 2")
    part = lambda role, k, at, n: F.struct(F.lit(role).alias("role"), F.lit(k).alias("k"), F.slice("ranks", at, n).alias("part"))
    three = F.array(part(1, 2, 1, 2), part(2, 1, 2, 2))
    four = F.array(part(1, 3, 1, 3), part(1, 2, 1, 2), part(2, 2, 3, 2), part(2, 1, 2, 3), part(0, 0, 2, 2))
    pieces = F.inline(F.when(F.size("ranks") == 3, three).otherwise(four))
    parts = longer.select(F.col("high").alias("of_high"), F.col("low").alias("of_low"), F.col("a").alias("whole"), pieces)
    parts = parts.select("of_high", "of_low", "whole", "role", "k", *_key("part"))
    most = parts.groupBy("high", "low").agg(F.max("whole").alias("whole"))
    asked = parts.where("role > 0").join(found.select("high", "low", F.col("a").alias("f")), ["high", "low"])
    asked = asked.select(F.col("of_high").alias("high"), F.col("of_low").alias("low"), "role", "k", "f")
    # the first word is the part before k = 1, the last the part behind the last k; words and texts come by rank
    spelt = found.select("high", "low", F.size("ranks").alias("size"), F.posexplode("ranks").alias("at", "rank")).join(ranked, "rank")
    ends = spelt.where("at = 0 or at = size - 1").select("high", "low", F.expr("if(at = 0, 1, 2)").alias("role"), F.expr("if(at = 0, 1, size - 1)").alias("k"), "f")
    one_cut = F.struct(F.col("k"), *(F.max(F.when(F.col("role") == role, F.col("f"))).alias(name) for role, name in ((1, "l"), (2, "r"))))
    cuts = ends.unionByName(asked).groupBy("high", "low", "k").agg(one_cut.alias("cut"))
    cuts = cuts.join(found.select("high", "low", "a"), ["high", "low"]).select("high", "low", "a", "cut.*")
    chosen = _scored(cuts).groupBy("high", "low").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("high", "low", "x.*")
    phrase = F.expr("array_join(transform(array_sort(collect_list(struct(at, word))), x -> decode(x.word, 'UTF-8')), ' ')")
    texts = spelt.groupBy("high", "low").agg(phrase.alias("phrase"), F.first("lang").alias("lang"))
    kept = chosen.join(most, ["high", "low"], "left").where(F.expr(f"whole is null or 100 * whole < {s.absorbed} * a"))
    best = kept.join(texts, ["high", "low"])
    width = partitions(spark)
    while width > 1:  # each round leaves ``top`` of each share of a language, so that no task gets all of a language
        best = _first(best, ["lang", F.pmod(F.xxhash64("phrase"), F.lit(width))], s.top).drop("rank")
        width //= 64
    best = _first(best, ["lang"], s.top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
g as (
  select lang, k, unnest(list_transform(generate_series(1, len(words) - k + 1), lambda i: array_to_string(words[i : i + k - 1], ' '))) as phrase
  from w, (values (1), (2), (3), (4)) as z(k) where len(words) >= k),
c as (select lang, k, phrase, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from c where k = 1 group by lang),
cand as (select *, string_split(phrase, ' ') as ws from c where k > 1 and a >= 30),
cut as (
  select x.lang, x.phrase, x.a, j, l.a as l, r.a as r, ((2000000::hugeint * x.a) // (l.a + r.a))::bigint as score
  from (select lang, phrase, a, ws, unnest(generate_series(1, k - 1)) as j from cand) x
  join c l on l.lang = x.lang and l.phrase = array_to_string(x.ws[1 : x.j], ' ')
  join c r on r.lang = x.lang and r.phrase = array_to_string(x.ws[x.j + 1 :], ' ')),
least as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inner_ as (
  select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(a) as whole
  from (select lang, a, ws, k, m, unnest(generate_series(1, k - m + 1)) as i from cand, (values (2), (3)) as z(m) where m < k) group by all),
kept as (select least.* from least left join inner_ using (lang, phrase) where whole is null or 100 * whole < 80 * least.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n.n, score from ranked join n using (lang) where rank <= 2000
"""
