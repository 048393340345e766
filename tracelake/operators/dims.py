"""Joins with dimensions: process groups, containers, topology, hosts, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inherit_from_group(df: DataFrame, dim: DataFrame, cols: list[str]) -> DataFrame:
    """Attributes of a task, or else those of its process (tgid)."""
    own = dim.select("hostname", "pid", *[F.col(c).alias(f"_o_{c}") for c in cols])
    group = dim.select("hostname", F.col("pid").alias("tgid"), *[F.col(c).alias(f"_g_{c}") for c in cols])
    out = df.join(own, ["hostname", "pid"], "left").join(group, ["hostname", "tgid"], "left")
    return out.withColumns({c: F.coalesce(f"_o_{c}", f"_g_{c}") for c in cols}).drop(*[f"_{k}_{c}" for k in "og" for c in cols])


def with_topology(df: DataFrame, topology: DataFrame) -> DataFrame:
    """Node and sibling of each event's CPU."""
    return df.join(topology.select("hostname", "cpu", "ldom", "lcpu_sibling", "pcpu_idx"), ["hostname", "cpu"], "left")


def flows_with_hosts(flows: DataFrame, local_ips: DataFrame) -> DataFrame:
    """The remote end of each flow by host name where another captured host has the address, else by address."""
    return flows.join(local_ips.select(F.col("ip").alias("rip"), F.col("hostname").alias("remote")), "rip", "left").withColumn("dest", F.coalesce("remote", "rip")).drop("remote")


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Changes between two snapshots: new keys are flagged ``***`` with their values, changed ones carry the differences, unchanged ones are left out.

    ``ratio`` is the last value's change by the first's, null where that is 0.
    """
    old = before.select(*key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_had"))
    j = after.join(old, key, "left")
    out = j.select(*key, *[(F.col(v) - F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], F.when(F.col("_had").isNull(), "***").otherwise("").alias("flag"))
    changed = F.lit(False)
    for v in values:
        changed = changed | (F.col(v) != 0)
    return out.where((F.col("flag") == "***") | changed).withColumn("ratio", F.when(F.col(values[0]) != 0, F.col(values[-1]) / F.col(values[0])))


def container_stats(tasks: DataFrame, containers: DataFrame, io: DataFrame | None = None) -> DataFrame:
    """CPU, run-queue, memory and I/O of each container; tasks of none, nor their process, are of "system"."""
    c = inherit_from_group(tasks, containers.select("hostname", "pid", F.col("name").alias("container")), ["container"]).withColumn("container", F.coalesce("container", F.lit("system")))
    if io is not None:
        c = c.join(io.where("rw is null").select("hostname", "pid", "ios", "kb"), ["hostname", "pid"], "left")
    else:
        c = c.withColumns({"ios": F.lit(0), "kb": F.lit(0.0)})
    return c.groupBy("hostname", "container").agg(F.count("*").alias("tasks"), F.sum("run_ns").alias("run_ns"), F.sum("runq_ns").alias("runq_ns"), F.sum("sys_ns").alias("sys_ns"), F.sum(F.coalesce("rss", F.lit(0))).alias("rss"), F.sum(F.coalesce("ios", F.lit(0))).alias("ios"), F.sum(F.coalesce("kb", F.lit(0.0))).alias("kb"))


def with_call_names(calls: DataFrame, names: DataFrame, archs: tuple[str, str] = ("x86_64", "i386")) -> DataFrame:
    """Calls with ``call``, the name of their number on their architecture: the first of ``archs`` for calls of 64 bits, the second for those of 32. A number without a name stands for itself."""
    arch = F.when(F.coalesce(F.col("is32bit"), F.lit(0)) == 0, archs[0]).otherwise(archs[1])
    n = names.select(F.col("arch").alias("_arch"), F.col("syscallno").alias("_no"), F.col("name").alias("_name"))
    out = calls.withColumn("_a", arch).join(n, (F.col("_a") == F.col("_arch")) & (F.col("syscallno") == F.col("_no")), "left")
    return out.withColumn("call", F.coalesce("_name", F.col("syscallno").cast("string"))).drop("_a", "_arch", "_no", "_name")
