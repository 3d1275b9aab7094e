"""Tables written to the folder that all executors share: lineage is cut, and a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[str, str]] = []  # (application, path) of every table not yet removed


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where none is named a temporary one is made, on one machine only: on a
    cluster each executor would write to a disk of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="hornbeam-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that others write; :func:`scratch` removes it with the rest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return path


#: For rows of a megabyte: the writer looks at its size after every row, not after the first hundred, and closes groups of
#: rows early, as a reader takes up to a group of rows at once.
_WIDE = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.max": 1, "parquet.block.size": 16 << 20}


def written(df: DataFrame, name: str = "table", wide: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder.  :func:`discard` or :func:`scratch` removes it once nothing reads it."""
    spark, schema = df.sparkSession, df.schema
    path = folder(spark, name)
    df.write.option("compression", "zstd").options(**_WIDE if wide else {}).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stash_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(df: DataFrame) -> None:
    path = getattr(df, "stash_path", None)
    if path:
        remove(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame] | None = None) -> Iterator[None]:
    """Remove, at the end of the block or when it fails, the tables that were written in it, but for those in ``keep``:
    results that read them have to be written (and kept) inside the block."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        stay = {getattr(df, "stash_path", None) for df in keep or ()}
        own = spark.sparkContext.applicationId
        gone = [x for x in _WRITTEN if x not in before and x[0] == own and x[1] not in stay]
        for _, path in gone:
            remove(spark, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x not in gone]
