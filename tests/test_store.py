"""Written tables, their removal, and the streaming sinks."""

import os

import pytest
from pyspark.sql import functions as F

from hornbeam.sources import store
from hornbeam.streaming import streams


def there(path):
    return os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_scratch_removes_what_it_made(spark):
    kept, inner = [], []
    outside = store.written(spark.range(3).toDF("id"))
    with store.scratch(spark, kept):
        a = store.written(spark.range(5).toDF("id"))
        kept.append(store.written(a.where("id > 2")))
        inner.append(a.stash_path)
    assert not there(inner[0]) and kept[0].count() == 2 and outside.count() == 3
    store.discard(kept[0])
    store.discard(outside)
    assert not there(outside.stash_path)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://x:7077"

    with pytest.raises(RuntimeError):
        store.shared_dir(Fake)


def test_streams_drain_to_files_and_report(spark, tmp_path):
    spark.range(50).withColumn("k", F.col("id") % 3).repartition(4).write.parquet(str(tmp_path / "in"))
    told = streams.Progress()
    spark.streams.addListener(told)
    stream = streams.event_stream(spark, str(tmp_path / "in"))
    got = streams.drained(spark, stream.groupBy("k").agg(F.count("*").alias("n")), "complete", "counts")
    assert sorted(map(tuple, got.collect())) == [(0, 17), (1, 17), (2, 16)]
    assert streams.drained(spark, stream, "append", "rows").count() == 50
    q = streams.appended(stream, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 50
    seen = told.wait(q.runId)
    assert seen["rows"] == 50 and seen["ended"] and seen["error"] is None and seen["batches"] >= 4
    spark.streams.removeListener(told)


def test_keyed_cache(spark, tmp_path):
    from pyspark.sql import functions as F

    from hornbeam.sources.cache import DIGEST, KeyedCache, digest

    cache = KeyedCache(spark, str(tmp_path / "cache"), ["k"])
    inputs = lambda rows: spark.createDataFrame(rows, "k int, v string").select("k", digest("v").alias(DIGEST))
    assert cache.read() is None and cache.fill(inputs([]), lambda t: t, 3, 1) is None
    calls = []

    def compute(part):
        if len(calls) == 2:
            raise RuntimeError("stopped")
        calls.append(part.count())
        return part.withColumn("r", F.col("k") * 10)

    rows = [(i, "a") for i in range(40)] + [(None, "a"), (99, None)]
    try:
        cache.fill(inputs(rows), compute, 4, 1)
        raise AssertionError("not stopped")
    except RuntimeError:
        pass
    assert cache.read().count() == sum(calls) and 0 < cache.pending(inputs(rows[:40])).count() == 40 - cache.read().where("k < 40").count()
    again = []

    def count(part):
        again.append(part.count())
        return part.withColumn("r", F.col("k") * 10)

    changed = [(i, "b" if i < 5 else "a") for i in range(40)] + [(99, None)]
    out = {r["k"]: r["r"] for r in cache.fill(inputs(changed), count, 4, 2).collect()}
    assert out == {**{i: i * 10 for i in range(40)}, 99: 990}
    assert cache.fill(inputs(changed), count, 4, 3).count() == 41 and cache.pending(inputs(changed)).count() == 0
    # a batch without a manifest does not count; one that comes again replaces itself
    inputs([(77, "z")]).withColumn("r", F.lit(1)).write.parquet(str(tmp_path / "cache/data/batch=000009-000000"))
    assert cache.read().where("k = 77").count() == 0
    keep = cache.sink(10)
    for _ in range(2):
        keep(inputs([(78, "z"), (3, "b")]).withColumn("r", F.lit(7)), 5)
    assert cache.read().where("k = 78").count() == 1 and cache.read().where("k = 3").first()["r"] == 7
    before = sorted((r["k"] is None, r["k"] or 0, r["r"] or 0) for r in cache.read().collect())
    cache.compact(11)
    assert cache.batches().count() == 1 and sorted((r["k"] is None, r["k"] or 0, r["r"] or 0) for r in cache.read().collect()) == before


def test_scratch_removes_what_a_failing_block_wrote(spark):
    from hornbeam.sources import store

    try:
        with store.scratch(spark):
            t = store.written(spark.range(3), "gone")
            path = store.folder(spark, "files")
            spark.range(2).write.parquet(path)
            raise RuntimeError
    except RuntimeError:
        pass
    from hornbeam.sources.history import existing

    assert existing(spark, [t.stash_path, path]) == []
