"""Fusion of a stream of source profiles.

Parsing and projection are expressions and work on streams as they are. Fusion needs all sources of a candidate, but not their profiles: their
combined claims (``operators.claims``) are enough, and those merge. So a stream's state is a table of combined claims, cut into buckets by
the hash of the candidate. A batch's profiles are combined, merged with the newest state of the buckets that they touch, and
written as those buckets' next state; profiles of earlier batches are never read again. What a batch reads and writes follows the batch and the
number of candidates in its buckets, not the number of batches before.

Batch ``n`` reads states of batches before ``n`` only, and writes its own folder. A batch that is repeated after a failure therefore begins from
the same state and overwrites what it wrote, so that its profiles count once. A bucket's last two states are kept for that.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fusewright.operators.claims import SCHEMA, claims, combine
from fusewright.operators.fuse import records, together
from fusewright.settings import Settings

#: A folder's layout: the buckets of its table of claims.
BUCKETS = 256


def _states(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """The batches that have a state of each bucket, ascending."""
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/batch=*/bucket=*"))
    out: dict[int, list[int]] = {}
    for s in found or []:
        path = s.getPath()
        out.setdefault(int(path.getName().removeprefix("bucket=")), []).append(int(path.getParent().getName().removeprefix("batch=")))
    return {k: sorted(v) for k, v in out.items()}


def _read(spark: SparkSession, folder: str, newest: dict[int, int]) -> DataFrame:
    """The states of buckets, each of the batch that is named."""
    paths = [f"{folder}/state/batch={n}/bucket={b}" for b, n in sorted(newest.items())]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def fuse_stream(profiles: DataFrame, folder: str, settings: Settings | None = None, **trigger) -> StreamingQuery:
    """Starts the stream. ``folder/state`` has the combined claims, ``folder/fused`` the records that each batch changed by ``batch``.

    The newest batch with a candidate has its record; ``current`` has all records, from the state.
    """
    settings = settings or Settings()

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("candidate_key"), F.lit(BUCKETS)).cast("int")
        arrived = f"{folder}/arrived"
        combine(claims(batch)).withColumn("bucket", bucket).write.mode("overwrite").parquet(arrived)
        new = spark.read.schema(SCHEMA + ", bucket int").parquet(arrived)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        states = {b: [n for n in ns if n < number] for b, ns in _states(spark, folder).items() if b in touched}
        old = _read(spark, folder, {b: ns[-1] for b, ns in states.items() if ns})
        state = f"{folder}/state/batch={number}"
        combine(new.select(*old.columns).unionByName(old)).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(state)
        mine = _read(spark, folder, dict.fromkeys(touched, number)).alias("p")
        keys = new.select("candidate_key").distinct().alias("t")
        mine = mine.join(keys, F.col("p.candidate_key").eqNullSafe(F.col("t.candidate_key")), "left_semi")
        records(together(mine, settings)).write.mode("overwrite").parquet(f"{folder}/fused/batch={number}")
        files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for b, ns in states.items():
            for n in ns[:-1]:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/batch={n}/bucket={b}"), True)

    writer = profiles.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()


def current(spark: SparkSession, folder: str, settings: Settings | None = None) -> DataFrame:
    """The record of each candidate, from the newest state of every bucket."""
    state = _read(spark, folder, {b: ns[-1] for b, ns in _states(spark, folder).items()})
    return records(together(state, settings or Settings()))
