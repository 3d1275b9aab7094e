"""Quality rules by compression bands: how far zstandard shrinks a text, as a whole and in fixed chunks.

Repetitive text shrinks too far, noise hardly at all, and a short text shrinks less than a long one of the same kind,
so every band is a line in the logarithm of the length.  Texts are measured in a form that gives letters of any alphabet
one byte, so that a band holds for all alphabets.  Judging is one pass without a shuffle; limits for another kind
of text come from :func:`calibrate`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.llm.kernels import slices

_SYMBOLS = b"#*$%&|<>"
#: ASCII signs that prose does without: all but letters, digits, blanks and ``.,;:!?'"()-``.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-")

# Limits by length on ratio = compressed / plain: (bytes of the one-byte form, low, high).  The low side leaves room for
# formulaic prose: half of 3,500 licences, manuals and notes in English of a Debian system and of Python packages lie at
# 0.56 (1-2 KB), 0.45, 0.41, 0.38, 0.33 (16-40 KB), 0.29, one in twenty at 0.41, 0.35, 0.31, 0.29, 0.25, 0.19 or below.  From
# 512 to 16384 bytes the high side is what :func:`calibrate` gives on the sample's good texts, and less than one in a
# hundred of those documents exceeds it.  The ends are drawn out.
LIMITS = (
    (64, 0.480, 1.300), (256, 0.440, 0.950), (512, 0.420, 0.800), (1024, 0.385, 0.715), (2048, 0.340, 0.631), (4096, 0.310, 0.589), (8192, 0.285, 0.566), (16384, 0.260, 0.541),
    (65536, 0.200, 0.520), (1 << 24, 0.170, 0.520),
)


@dataclass(frozen=True)
class Bands:
    """Limits on ratio = compressed / plain bytes.  ``(bytes, low, high)`` steps give the limits at those lengths;
    between two steps the limits are interpolated over the logarithm of the length.  A chunk is held to the limits of a
    text of its length, with ``chunk_slack`` to spare on either side."""

    level: int = 3
    chunk: int = 2048
    steps: tuple[tuple[int, float, float], ...] = LIMITS
    chunk_slack: float = 0.01
    #: Added to the high limits of text that is all outside its 127 letters, as scripts with thousands of signs are.
    wide_slack: float = 0.12
    #: The share of the compressed size that goes when signs are taken out of the text.  Of the documents named at LIMITS one
    #: in a hundred of the licences exceeds 0.06, of the manuals and notes, which hold tables and addresses, 0.138.
    sign_share: float = 0.14
    #: The share of chunks (by bytes) that may lie outside their band.
    bad_share: float = 0.30
    min_words: int = 50
    max_repeat_percent: int = 50

    def limits(self, n: int) -> tuple[float, float]:
        x = np.log(max(n, 1))
        at = [np.log(s[0]) for s in self.steps]
        return float(np.interp(x, at, [s[1] for s in self.steps])), float(np.interp(x, at, [s[2] for s in self.steps]))


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("whole_ratio", T.DoubleType()),
        T.StructField("bad_chunk_share", T.DoubleType()),
        T.StructField("sign_share", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words inside a 3-word window that occurs twice."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    letters = len(raw) - sum(raw.count(x) for x in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    if len(text) != len(raw):
        letters -= int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
    symbols = sum(raw.count(_SYMBOLS[i : i + 1]) for i in range(len(_SYMBOLS)))
    seen: set[bytes] = set()
    repeated = 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                repeated += 1
            elif line and not line.isspace():
                seen.add(line)
    return len(words), letters, symbols, repeated, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for w in words), np.int64, n)
    v = len(number)
    key = ids[:-2] * v + ids[1:-1]
    if v >= 1 << 20:
        key = np.unique(key, return_inverse=True)[1]
    key = key * v + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j : n - 2 + j] |= twice
    return int(covered.sum())


def one_byte_form(text: str) -> tuple[bytes, float]:
    """``text`` with a byte for each ASCII sign and each of its 127 most frequent others, and the share of its signs that are
    none of these and take 4 bytes.

    In UTF-8 a script's letters take two or three bytes, of which the first say nothing, so text in it would shrink further
    than the same text in Latin letters.
    """
    if text.isascii():
        return text.encode(), 0.0
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(signs >= 128)
    letters, place, n = np.unique(signs[at], return_inverse=True, return_counts=True)
    order = np.lexsort((letters, -n))[:127]
    code = np.full(len(letters), 255)
    code[np.sort(order)] = 128 + np.arange(len(order))  # in the script's order
    out = signs.astype(np.uint8)
    out[at] = code[place]
    wide = np.flatnonzero(out == 255)
    if not len(wide):
        return out.tobytes(), 0.0
    rest = signs[wide]
    form = np.insert(out, np.repeat(wide + 1, 3), np.stack([rest >> 16, rest >> 8 & 255, rest & 255], axis=1).astype(np.uint8).ravel())
    return form.tobytes(), len(wide) / len(signs)


class Judge:
    """The verdict on one text after another; made once in a task."""

    def __init__(self, bands: Bands):
        import zstandard

        self.bands = bands
        self.zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)

    def compression(self, text: str) -> tuple[float, float, float, bool]:
        """Ratio of the whole, share of bytes in chunks outside their band, share of the compressed size that signs take, and
        whether the text stays."""
        b = self.bands
        raw, wide = one_byte_form(text)
        if not raw:
            return 0.0, 0.0, 0.0, False
        size = len(self.zstd.compress(raw))
        whole = size / len(raw)
        plain = raw.translate(None, _SIGNS)
        signs = 1 - len(self.zstd.compress(plain)) / size if len(plain) < len(raw) else 0.0
        low, high = b.limits(len(raw))
        spare = wide * b.wide_slack
        fits = low <= whole <= high + spare
        bad = 0
        for at in range(0, len(raw), b.chunk):
            piece = raw[at : at + b.chunk]
            if at and len(piece) < b.chunk // 4:  # a short rest is judged with what comes before it
                piece = raw[len(raw) - b.chunk // 4 :]
            part = min(b.chunk, len(raw) - at)
            lo, hi = b.limits(len(piece))
            if not lo - b.chunk_slack <= len(self.zstd.compress(piece)) / len(piece) <= hi + b.chunk_slack + spare:
                bad += part
        share = bad / len(raw)
        return whole, share, signs, fits and share <= b.bad_share and signs <= b.sign_share

    def row(self, text: str | None) -> tuple:
        n_words, letters, symbols, lines, repeats = measure(text)
        failed = n_words < self.bands.min_words or 100 * repeats > self.bands.max_repeat_percent * n_words
        whole, share, signs, fits = self.compression(text or "")
        return n_words, letters, symbols, lines, repeats, failed, whole, share, signs, fits and not failed


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    A null or empty text has no words, fails the base rules and is not kept; a text of any length is measured whole.
    Repeated rows give repeated results, a null ``doc_id`` stays null, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        for batch in slices(batches):
            rows = [judge.row(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 10
            arrays = [batch.column(0).cast(pa.int64())]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=RESULT.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, RESULT)


def calibrate(docs: DataFrame, bands: Bands = Bands(), share: float = 0.005, low_margin: float = 0.006, high_margin: float = 0.1, least: int = 40) -> Bands:
    """``bands`` with limits from the texts of ``docs``, which should be good ones: for each power of two of bytes the
    ratios that ``share`` of the texts within half an octave stay below or exceed, and the margins.

    All rows that pass the base rules count; octaves with fewer than ``least`` of them are left to interpolation.  With
    no octave left the limits stay as they are.  The driver sees a row for each octave.
    """
    size = F.octet_length(docs["text"].cast("string"))
    sized = docs.select(F.lit(None).cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where(size > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        for batch in slices(batches):
            rows = [(len(one_byte_form(t or "")[0]), judge.row(t)) for t in batch.column(1).to_pylist()]
            rows = [(n, r[6]) for n, r in rows if not r[5]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["n", "ratio"])

    ratios = sized.mapInArrow(run, "n long, ratio double")
    octave = F.round(F.log2("n")).cast("int").alias("octave")
    found = ratios.groupBy(octave).agg(F.count("*").alias("texts"), F.percentile_approx("ratio", [share, 1 - share], 10_000).alias("q")).where(F.col("texts") >= least).orderBy("octave").collect()
    steps = tuple((1 << r["octave"], r["q"][0] - low_margin, r["q"][1] + high_margin) for r in found)
    return replace(bands, steps=steps) if steps else bands


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs``, all their columns, that the rules keep."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        for batch in slices(batches):
            yield batch.filter(pa.array([judge.row(t)[-1] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
