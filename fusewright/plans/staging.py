"""Steps that several later ones read are written once, to the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset a temporary one, but only on a single machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fusewright-"))
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/fusewright-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def staged(frame: DataFrame) -> DataFrame:
    """The frame's rows, worked out once, written as a table to the shared folder and read back by column."""
    spark = frame.sparkSession
    path = new_folder(spark)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged_at = path
    return out


def spread(frame: DataFrame) -> DataFrame:
    """The rows dealt out evenly to all cores. Parsing a text costs far more than reading it, and a file of some MB is one task's, however many its rows."""
    spark = frame.sparkSession
    return frame.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def release(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``staged`` returned and that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(frame._staged_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
