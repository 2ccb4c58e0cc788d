"""Intermediate tables in the folder that driver and executors share, and column names that clash with none."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

MADE: dict[str, SparkSession] = {}
#: Settings while a table is written: its shuffles' files go with it, and what passes to Python comes in small batches,
#: of which JVM and worker hold some copies each.
WHILE_WRITTEN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all of them are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corrobora-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A fresh path under the shared folder, removed when the driver ends if nobody drops it before."""
    path = f"{shared_dir(spark)}/corrobora/{uuid.uuid4().hex}"
    if not MADE:
        atexit.register(_sweep)
    MADE[path] = spark
    return path


def _sweep() -> None:
    for path, spark in list(MADE.items()):
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes one path; a driver that is already going down leaves it to the folder's owner."""
    MADE.pop(path, None)
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: ``df`` as a table in the shared folder, which outlives any executor.

    The shuffles that made it are of no more use then, and leave the executors' disks at once.
    """
    spark = df.sparkSession
    path, before = scratch(spark), {k: spark.conf.get(k, None) for k in WHILE_WRITTEN}
    for key, value in WHILE_WRITTEN.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        for root in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = urlparse(root).path
            for made in [m for m in MADE if urlparse(m).path == path]:
                drop(df.sparkSession, made)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores appended until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
