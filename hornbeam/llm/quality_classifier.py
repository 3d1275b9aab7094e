"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, shrinks a text more.

Two dictionaries are trained from labelled text.  A text is cut into chunks, each chunk is compressed with either
dictionary, and ``(bad size - good size) / plain size`` over all chunks is the raw score.  A logistic curve fitted on
labelled texts turns it into a probability.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.llm.kernels import slices


@dataclass(frozen=True)
class Settings:
    """``max_rows`` and ``max_bytes`` bound, for each label, the labelled sample that reaches the driver: rows in the
    order of a hash, a text that would pass the byte bound is left out.  Scoring has no bound."""

    max_rows: int = 2000
    max_bytes: int = 6_000_000
    dictionary_bytes: int = 1 << 17
    chunk: int = 1024
    level: int = 6


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    settings: Settings

    def scorer(self):
        import zstandard

        level = self.settings.level
        two = []
        for raw in (self.good, self.bad):
            # with its tables of symbol frequencies where it was trained, else as content alone
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=level)
            two.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
        good, bad = two
        step = self.settings.chunk

        def raw_score(text: str | None) -> float:
            data = (text or "").encode("utf-8", "surrogatepass")
            if not data:
                return 0.0
            pieces = [data[i : i + step] for i in range(0, len(data), step)]
            return (sum(len(bad.compress(p)) for p in pieces) - sum(len(good.compress(p)) for p in pieces)) / len(data)

        return raw_score

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * raw + self.offset, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[int, str]]:
    """At most ``max_rows`` texts and ``max_bytes`` bytes for each label 0 and 1, chosen by a hash of the id.

    ``labels`` has ``doc_id`` and ``label``; other labels and null ids are ignored, of a repeated id one row counts.
    """
    ids = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = ids.withColumn("rank_hash", F.xxhash64("doc_id"))
    picked = None
    for label in (0, 1):
        part = ids.where(F.col("label") == label).orderBy("rank_hash", "doc_id").limit(settings.max_rows)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * max_rows ids: a bound that no input can pass
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "rank_hash").agg(F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    texts = texts.where(size.between(1, settings.max_bytes)).withColumn(
        "upto", F.sum(size).over(Window.partitionBy("label").orderBy("rank_hash", "doc_id"))
    )
    rows = texts.where(F.col("upto") <= settings.max_bytes).select("label", "text", "rank_hash").collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0], r[2], r[1]))]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary trained on pieces cut evenly from all the texts, so that no text fills it alone."""
    import zstandard

    samples = [t[i : i + 512] for t in texts for i in range(0, len(t), 512)]
    samples = [s for s in samples if len(s) >= 16]
    try:
        trained = zstandard.train_dictionary(size, samples, k=256, d=8, steps=1, threads=1)
        return trained.as_bytes()
    except zstandard.ZstdError:  # too few samples to train from: the samples themselves serve
        return b"".join(samples)[-size:]


def _fit(raw: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Platt's logistic calibration: Newton steps on smoothed targets; ``share`` of all labelled rows have label 1."""
    n = np.array([(label == 0).sum(), (label == 1).sum()], float)
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(label == 1, share / n[1], (1 - share) / n[0])
    scale = max(float(np.std(raw)), 1e-9)
    x = np.stack([raw / scale, np.ones_like(raw)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - target)) + np.array([1e-4 * w[0], 0.0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from ``labels(doc_id, label)`` and the texts of ``docs``.

    Two thirds of the sample fill the dictionaries and the rest, which they have not seen, fits the calibration.  With
    no usable text of one of the labels there is nothing to tell apart and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, settings)
    by = {v: [t.encode("utf-8", "surrogatepass") for label, t in sample if label == v] for v in (0, 1)}
    if min(map(len, by.values())) < 3:
        return Model(b"", b"", 0.0, 0.0, settings)
    cut = {v: [t for i, t in enumerate(x) if i % 3] for v, x in by.items()}
    draft = Model(_dictionary(cut[1], settings.dictionary_bytes), _dictionary(cut[0], settings.dictionary_bytes), 1.0, 0.0, settings)
    score = draft.scorer()
    rest = [(score(t.decode("utf-8", "surrogatepass")), v) for v, x in by.items() for i, t in enumerate(x) if i % 3 == 0]
    counts = {r[0]: r[1] for r in labels.where("label in (0, 1)").groupBy("label").count().collect()}
    slope, offset = _fit(np.array([r for r, _ in rest]), np.array([v for _, v in rest]), counts[1] / (counts[0] + counts[1]))
    return Model(draft.good, draft.bad, slope, offset, settings)


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("raw", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, raw, score, predicted`` for every row; a null or empty text gets the score of a raw score of 0.

    Whole texts are compressed, however long.  Repeated rows give repeated results, columns other than ``doc_id`` and
    ``text`` are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_score = model.scorer() if model.slope else (lambda text: 0.0)
        for batch in slices(batches):
            raw = np.array([raw_score(t) for t in batch.column(1).to_pylist()], float)
            score = model.probability(raw)
            arrays = [batch.column(0), pa.array(raw), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=RESULT.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, RESULT)
