"""The index: five Parquet tables in one folder, replaced as a whole; upserts, cascades and incremental classification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schema import DDL, schema
from graphloom.shared import written

#: Tables with a file's rows.
OWNED = ("symbols", "refs", "imports", "exports")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new``, and the rows of ``old`` with other keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the rows of files ``gone`` (file_id); references to their symbols go too."""
    out = {n: d.join(gone, "file_id", "left_anti").select(*d.columns) for n, d in tables.items() if n in OWNED}
    if "refs" in out and "symbols" in tables:
        dead = tables["symbols"].join(gone, "file_id", "left_semi").select("id")
        refs = out["refs"].join(dead.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(dead.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        out["refs"] = refs.select(*tables["refs"].columns)
    if "files" in tables:
        out["files"] = tables["files"].join(gone, tables["files"]["id"] == gone["file_id"], "left_anti")
    return out


def classify(existing: DataFrame, found: DataFrame, first_id: int | None = None) -> DataFrame:
    """(id, path, mtime, state, ...) by a full outer join on path of ``existing`` (id, path, mtime) and ``found`` (path, mtime, ...).

    unchanged: stored no earlier than found; changed keeps its id; deleted: found no more; new gets ids from ``first_id``
    (by default the largest one plus 1) in the order of paths. New files are numbered within ranges of a distributed sort
    and shifted by the ranges' counts, not in one task.
    """
    e = existing.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("mtime").alias("_old"))
    both = found.join(e, found["path"] == e["_path"], "full_outer")
    state = F.when(F.col("path").isNull(), "deleted").when(F.col("_path").isNull(), "new").when(F.col("_old") >= F.col("mtime"), "unchanged").otherwise("changed")
    both = both.withColumn("state", state).withColumn("path", F.coalesce("path", "_path")).withColumn("mtime", F.coalesce("mtime", "_old"))
    known = both.where("state <> 'new'").withColumn("id", F.col("_id"))
    fresh = both.where("state = 'new'")
    # a sort by ranges; then a row's number is its place in its range plus the ranges' sizes before
    fresh = written(fresh.orderBy("path").withColumn("_m", F.monotonically_increasing_id()), "new-files")
    fresh = fresh.withColumn("_block", F.shiftright("_m", 33)).withColumn("_k", F.col("_m").bitwiseAND((1 << 33) - 1) + 1).drop("_m")
    before = fresh.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per range, as many as shuffle partitions
    start = F.lit(first_id) if first_id is not None else F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0)) + 1
    fresh = fresh.join(F.broadcast(before), "_block").withColumn("id", start + F.col("_k") + F.col("_before") - 1).drop("_block", "_k", "_before")
    return known.unionByName(fresh.select(*known.columns)).drop("_id", "_path", "_old")


class Store:
    """Versions of the index under one folder; a small pointer file names the current one, so readers see all or nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        at = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(at):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def read(self) -> dict[str, DataFrame]:
        """The five tables; empty ones for a new store."""
        v = self.current()
        if v is None:
            return {t: self.spark.createDataFrame([], schema(t)) for t in DDL}
        return {t: self.spark.read.schema(schema(t)).parquet(f"{self.path}/{v}/{t}") for t in DDL}

    def write(self, tables: dict[str, DataFrame]) -> None:
        """A new version of all five tables. The pointer is replaced by one rename; the version before stays for readers that hold it, older ones go."""
        old, v = self.current(), f"v-{uuid.uuid4().hex}"
        for t in DDL:
            df = tables[t].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(t)))
            df.write.parquet(f"{self.path}/{v}/{t}")
        tmp, at = self._path(f"{self.path}/CURRENT.{v}"), self._path(f"{self.path}/CURRENT")
        out = self._fs.create(tmp, True)
        out.write(bytearray(v.encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        how = sc._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(tmp), self._fs.makeQualified(at), how)
        for x in self._fs.listStatus(self._path(self.path)):
            if x.getPath().getName().startswith("v-") and x.getPath().getName() not in (v, old):
                self._fs.delete(x.getPath(), True)
