"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What the plans of this package rely on; every one can be set by the cluster.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster use its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("fleetvitals")
    settings = {
        **PLAN_SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Building a plan records no Python call sites: half the time of a wide report.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where it is unset (tests, local runs) is a temporary folder made, and
    it is then set, so that every caller of the session sees the same one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.path.join(tempfile.gettempdir(), "fleetvitals-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is read more than once to the shared folder, and read it back.

    It cuts the plan as a checkpoint does, and keeps columns prunable. The folder
    goes when the driver ends.
    """
    path = os.path.join(new_folder(df.sparkSession, name), "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Whether shuffle files go when the job that wrote them ends (fixed name).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_inside: Counter[SparkSession] = Counter()
_before: dict[SparkSession, str | None] = {}
_counting = threading.Lock()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs that end in here leave no shuffle files.

    Otherwise these stay until the driver happens to collect its garbage, beside those of
    all later jobs. The session's own setting comes back with the last one to leave.
    """
    with _counting:
        if not _inside[spark]:
            _before[spark] = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _inside[spark] += 1
    try:
        yield
    finally:
        with _counting:
            _inside[spark] -= 1
            if not _inside[spark]:
                del _inside[spark]
                value = _before.pop(spark)
                if value is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, value)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    folder, files = _folder(spark, path)
    return files.exists(folder)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the caller's own results, if it is there."""
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared folder, removed when the driver ends."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    folder, files = _folder(spark, path)
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path
