"""Results kept by key and by a digest of what they were made from.

A cache is a folder of batches and a folder of manifests.  A batch counts once its manifest is there, which is written
last, so an interrupted run leaves nothing half done, and a batch written again under its name replaces itself.  A result
is reused only while its digest is that of its input; what is new or changed is computed in batches, each kept at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornbeam.operators.inference import hash_index
from hornbeam.sources.history import existing
from hornbeam.sources.store import remove

DIGEST, BATCH = "input_digest", "batch"


class KeyedCache:
    """Rows ``keys..., input_digest, ...`` under ``path``, which all executors have to see.

    ``batch`` names start with a number that rises with every call of :meth:`put` or :meth:`fill`: of rows with one key the
    one of the latest batch counts, of equals in a batch an arbitrary one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def batches(self) -> DataFrame | None:
        """``batch, rows`` of what is complete, or None without any."""
        root = f"{self.path}/manifest"
        return self.spark.read.schema("batch string, rows long").json(f"{root}/*") if existing(self.spark, [root]) else None

    def rows(self) -> DataFrame | None:
        """All rows of complete batches; those without a manifest are left out by the name of their folder."""
        told = self.batches()
        if told is None:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(f"{self.path}/data")
        return rows.withColumn(BATCH, F.col(BATCH).cast("string")).join(told.select(BATCH), BATCH, "left_semi")

    def read(self) -> DataFrame | None:
        """Each key's latest row, with its digest and batch; None for an empty cache."""
        rows = self.rows()
        if rows is None:
            return None
        latest = Window.partitionBy(*self.keys).orderBy(F.col(BATCH).desc())  # as many rows as a key was computed
        return rows.withColumn("__at", F.row_number().over(latest)).where("__at = 1").drop("__at")

    def put(self, rows: DataFrame, batch: str) -> int:
        """Keep ``rows`` as a batch, in place of one of that name; returns their number.  Safe to repeat."""
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{BATCH}={batch}")
        n = self.spark.read.parquet(f"{self.path}/data/{BATCH}={batch}").count()
        self.spark.createDataFrame([(batch, n)], "batch string, rows long").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{batch}")
        return n

    def pending(self, inputs: DataFrame) -> DataFrame:
        """Rows of ``inputs(keys..., input_digest, ...)`` without a result of equal digest."""
        kept = self.read()
        return inputs if kept is None else inputs.join(kept.select(*self.keys, DIGEST), [*self.keys, DIGEST], "left_anti")

    def fill(self, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], batches: int, number: int) -> DataFrame | None:
        """Compute what is pending in ``batches`` parts by a hash of the key, keep each part as it is done, and return the
        results that ``inputs`` ask for.  ``compute`` gets input rows and returns ``keys..., input_digest, ...``.  A run that is
        stopped goes on where it was when it is called again; ``number`` orders runs."""
        todo = self.pending(inputs)
        at = hash_index(F.lit(batches), *(F.col(k) for k in self.keys))
        parts = [r[0] for r in todo.select(at.alias("at")).distinct().orderBy("at").collect()]  # ``batches`` at most
        for i in parts:
            self.put(compute(todo.where(at == i)), f"{number:06d}-{i:06d}")
        kept = self.read()
        return None if kept is None else kept.join(inputs.select(*self.keys, DIGEST), [*self.keys, DIGEST], "left_semi")

    def sink(self, number: int) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: a micro-batch that comes again replaces itself."""
        return lambda rows, i: self.put(rows, f"{number:06d}-stream-{i:09d}") and None

    def compact(self, number: int) -> None:
        """Put all latest rows into one batch and remove the others."""
        kept, told = self.read(), self.batches()
        if kept is None:
            return
        old = [r[0] for r in told.select(BATCH).collect()]  # names of batches
        self.put(kept.drop(BATCH), f"{number:06d}-all")
        for name in old:
            remove(self.spark, f"{self.path}/manifest/{name}")
            remove(self.spark, f"{self.path}/data/{BATCH}={name}")


def digest(*columns: Column | str) -> Column:
    """A digest of what a result is made from; nulls count, lists are sorted by the caller."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
