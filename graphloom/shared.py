"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (as in tests) a folder of this machine is made; on a cluster an
    unset value is an error, as no machine-local folder would be seen by the other executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        _left.append((spark, _own[app]))
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and its lineage cut so that lost executors cost a reread only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def drop_written(*dfs: DataFrame) -> None:
    """Frees tables of ``written`` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_graphloom_path", None)
        if path:
            _remove(df.sparkSession, path)
