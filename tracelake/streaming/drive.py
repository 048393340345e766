"""Run a stream to its end, as tests and registered queries do."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Partitions of a stream's state for each core. They last as long as its checkpoint, and each costs a store, a commit and a call of Python for every stateful operator
#: and batch, rows or none; so they go by the cores that work on them, not by the size of what is there when the stream starts.
PER_CORE = 2


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of the cluster, ``spark.checkpoint.dir``; state and results of streams have no other place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stateful(spark: SparkSession):
    """Streams that are started within keep their state in RocksDB, in ``PER_CORE`` partitions a core at most; one that is restarted keeps what its checkpoint says.

    Batches for Python end by their number of rows alone: with a limit of bytes Spark sums up the buffers of all columns anew with each row.
    """
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), PER_CORE * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(parts), "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1)}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there now, written to a shared folder and read again."""
    spark = stream.sparkSession
    out, place = folder(spark, "stream-out"), folder(spark, "stream-state")
    with stateful(spark):
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
