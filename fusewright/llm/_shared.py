"""Session helpers of the subpackage: shared folders, staged tables, sources and imports on executors."""
from __future__ import annotations

import contextlib
import os
import pathlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from fusewright.plans.staging import shared_folder

#: With this setting Spark removes the shuffle files of a query once it has ended. It needs Spark's classic API, not Connect.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed and they start elsewhere."""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


_writing: dict[int, list] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """The setting is on while any thread writes; the last one puts back what the first one found."""
    own = id(spark._jsparkSession)
    with _lock:
        held = _writing.setdefault(own, [0, spark.conf.get(_SHUFFLE_CLEANUP, None)])
        held[0] += 1
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _writing[own]
                spark.conf.unset(_SHUFFLE_CLEANUP) if held[1] is None else spark.conf.set(_SHUFFLE_CLEANUP, held[1])


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage: the frame as a table in the shared folder, written once and read back by column.

    A table goes when ``discard`` is called on the frame, or else when the application ends. The shuffle files that led to it go
    as soon as it is written.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/fusewright-{uuid.uuid4().hex}"
    with _cleaning(spark):
        frame.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged_at = path
    return out


def checkpointed(frame: DataFrame) -> DataFrame:
    """The lineage cut by checkpoint() in the shared folder, for steps that need the partitions and their order as they are."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``cut`` returned and that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(frame._staged_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(wanted: str, taken) -> str:
    """``wanted``, or with as many underscores before it as keep it apart from all columns (by any case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
