"""Extension: a stream of changed files keeps a store up to date.

Each micro-batch is one incremental refresh over the files that changed; the latest version of a path in a batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions import paths
from graphloom.sources import index, store

FILES = "path STRING, mtime BIGINT, content STRING"


def apply_changes(old: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
    """Tables after a batch (path, mtime, content; null content: deleted)."""
    w = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc_nulls_first("content"))
    last = batch.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("language", paths.language(F.col("path")))
    found = last.where("content is not null and language is not null")
    others = old["files"].join(last.select("path"), "path", "left_anti").select("path", "mtime", "language", F.lit("").alias("content"))
    tables, _ = index.refresh(old, others.unionByName(found.select("path", "mtime", "language", "content")))
    return tables


def watch(changes: DataFrame, at: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs ``apply_changes`` for each micro-batch of a streaming frame of changed files."""

    def step(batch: DataFrame, epoch: int) -> None:
        s = store.Store(batch.sparkSession, at)
        s.write(apply_changes(s.read(), batch))

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()
