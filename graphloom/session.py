"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_GROWS = "spark.sql.sources.fileCompressionFactor"


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the application's Python files, once, so that Python workers can import it wherever they run.

    Arrow batches are cut to 1,000 rows unless the session asks otherwise: rows hold whole texts, and a batch is held
    several times over while it is handed to Python. Files are taken for ten times their size on disk unless the session
    asks otherwise: sorted ids and repeated texts are stored in a byte or less, and a table that seems small is sent to
    the driver and to all executors.
    """
    sc = spark.sparkContext
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, "1000")
    if float(spark.conf.get(_GROWS, "1.0")) == 1:
        spark.conf.set(_GROWS, "10.0")
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="graphloom-py-"), "graphloom.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        sc.addPyFile(at)
        _shipped.add(sc.applicationId)
    return spark


def session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "12g", more: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=more or {})
        .getOrCreate()
    )
