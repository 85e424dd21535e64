"""Watching a directory: snapshots are compared and the batch pipeline runs again when they differ.

The file source never gives a file again that was overwritten, and no removals, so a processing-time trigger takes a
snapshot of (path, state) and compares it with the last one. Events between two triggers are seen together; none is lost.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.sources.files import listing

_STATE = "path string, state string"
log = logging.getLogger(__name__)


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).select(F.col("url").alias("path"), F.concat_ws("/", F.col("modified_at").cast("string"), F.col("length").cast("string")).alias("state"))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): `created`, `modified` or `removed`; a path that comes several times is compared by all its states."""
    one = lambda df, name: df.groupBy("path").agg(F.sum(F.xxhash64("state").cast("decimal(20,0)")).alias(name))
    both = one(before, "old").join(one(after, "new"), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def watch(spark: SparkSession, root: str, regenerate: Callable[[DataFrame], None], checkpoint: str, every: str = "500 milliseconds") -> StreamingQuery:
    """Call `regenerate` with the changes whenever there are any; its failures are logged and the stream goes on. The last
    snapshot that was worked off is a table in the checkpoint folder, under its number: a stream that is started again goes on
    from there, and older snapshots are removed."""
    folder = f"{checkpoint}/snapshots"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers() -> list[int]:
        """The snapshots that are whole: `done` is written after a snapshot was worked off."""
        names = [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
        return sorted(int(n.removesuffix(".done")) for n in names if n.endswith(".done"))

    def step(_: DataFrame, epoch: int) -> None:
        try:
            # the snapshot is a table before it is compared: a file that changes meanwhile differs from it next time
            last = (numbers() or [0])[-1]
            snapshot(spark, root).write.mode("overwrite").parquet(f"{folder}/{last + 1}")
            now = spark.read.schema(_STATE).parquet(f"{folder}/{last + 1}")
            before = spark.read.schema(_STATE).parquet(f"{folder}/{last}") if last else spark.createDataFrame([], _STATE)
            changes = changes_between(before, now)
            if not changes.isEmpty():
                regenerate(changes)
                fs.create(path(f"{folder}/{last + 1}.done")).close()
                for old in (f"{last}", f"{last}.done"):
                    fs.delete(path(f"{folder}/{old}"), True)
        except Exception:
            log.exception("regeneration failed")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).trigger(processingTime=every).option("checkpointLocation", f"{checkpoint}/stream").start()
