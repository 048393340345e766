"""What the operators share: staged tables, size-checked joins, scans of texts, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side goes to every executor only if it has been counted and holds at most so many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write a table in hash buckets of its keys and read it again: later joins on them shuffle the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), *keys).option("path", stage_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


#: A row's own key, where doc_id may be null or repeated.
ROW = "_row"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_rows(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table with a key for each row, written once, so that every later read gives a row the same key; and the key's name."""
    row = free_name(df, ROW)
    return staged(df.withColumn(row, F.monotonically_increasing_id()), name), row


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, items: str | None = None, item_bytes: int = 0) -> DataFrame:
    """Mark a join side for broadcast if its counted rows, and the counted items of an array column, fit the limit; otherwise leave it to a shuffled join."""
    counts = [F.count("*").alias("rows"), F.coalesce(F.sum(F.array_size(items)), F.lit(0)).alias("items")] if items else [F.count("*").alias("rows"), F.lit(0).alias("items")]
    found = df.agg(*counts).first()
    return F.broadcast(df) if found["rows"] * row_bytes + found["items"] * item_bytes <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def release() -> None:
    """Give the memory that a task has freed back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def scan(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``work`` over the Arrow batches of each partition; it yields columns (name to array), written with ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            arrays = [
                x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=True)
                for f, x in ((f, columns[f.name]) for f in arrow)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            del arrays, columns
        release()

    return df.mapInArrow(run, schema)


def grouped(groups, work: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` that gives back the memory of large groups."""

    def run(key, table):
        out = work(key, table)
        large = table.nbytes > 1 << 20
        del table
        if large:
            release()
        return out

    return groups.applyInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    """A string column as UTF-8 bytes, null as None."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links, as (node, component): the smallest node that links reach.

    Each round takes the least label among a node's neighbours and then the label
    of that label, so a chain of n links needs about log n rounds. Every round is a
    written table; nothing is collected but the number of changed labels.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = staged(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy("u").agg(F.min("component").alias("m"))
            .join(labels.withColumnRenamed("node", "u"), "u")
            .select(F.col("u").alias("node"), F.least("m", "component").alias("l"), F.col("component").alias("old"))
        )
        jump = labels.select(F.col("node").alias("l"), F.col("component").alias("ll"))
        new = staged(near.join(jump, "l", "left").select("node", F.least("l", F.coalesce("ll", "l")).alias("component"), "old"), "labels")
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
