"""Streaming shapes: appending results once by key, windows over event time, incremental run summaries, budget gates."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hornbeam.sources.store import folder


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from a batch read."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_by_key(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key once while its watermark lasts."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows, final once the watermark has passed."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, by: str, late: str = "1 day") -> DataFrame:
    """Sessions that a gap ends: their start, end and size."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("n"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def budget_gate(stream: DataFrame, key: str, limit: float, estimate: float) -> DataFrame:
    """``key, ord, spent, allowed`` for every run as it comes: whether what is spent and an estimate stay within a limit.

    The state is one sum a key.  Rows of one batch go by ``ord``.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (spent,) = state.get if state.exists else (0.0,)
        rows = pd.concat(list(frames)).sort_values("ord")
        before = spent + rows["cost"].cumsum().shift(fill_value=0.0)
        state.update((float(spent + rows["cost"].sum()),))
        yield pd.DataFrame({key: k[0], "ord": rows["ord"], "spent": before, "allowed": before + estimate <= limit})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, "ord", "cost").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ord long, spent double, allowed boolean", "spent double", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, a table in the shared folder.

    ``append`` adds each batch to the files; ``complete`` replaces what is there by the batch, which is the whole result
    so far.  Nothing of it is held by the driver.
    """
    base, log = folder(spark, name), folder(spark, f"{name}-log")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = out.format("parquet").option("path", base).start()
    else:
        query = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(base)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def appended(stream: DataFrame, path: str, checkpoint: str | None = None):
    """An append-only file sink that resumes where it stopped; returns the finished query."""
    q = stream.writeStream.outputMode("append").format("json").option("path", path)
    q = q.option("checkpointLocation", checkpoint or folder(stream.sparkSession, "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Micro-batches through a function: the shape of a cache that is flushed every so often."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class Progress(StreamingQueryListener):
    """Rows and batches of each query so far, and how each ended: add it by ``spark.streams.addListener``.  It keeps three
    numbers a query, whatever runs through."""

    def __init__(self) -> None:
        self.seen: dict[str, dict] = {}
        self._ended = threading.Condition()

    def _of(self, run) -> dict:
        return self.seen.setdefault(str(run), {"name": None, "batches": 0, "rows": 0, "ended": False, "error": None})

    def onQueryStarted(self, event) -> None:
        self._of(event.runId)["name"] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = self._of(p.runId)
        at["batches"], at["rows"] = at["batches"] + 1, at["rows"] + p.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._of(event.runId).update(ended=True, error=event.exception)
            self._ended.notify_all()

    def wait(self, run, seconds: float = 30.0) -> dict:
        """What is known of a query once its end has been told; events come some time after it."""
        with self._ended:
            self._ended.wait_for(lambda: self._of(run)["ended"], seconds)
        return dict(self._of(run))
