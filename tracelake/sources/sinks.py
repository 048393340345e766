"""Sinks: reports as CSV or Parquet, task trees and wait graphs as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report with a header in each part file; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).csv(path)


def pid_tree(edges: DataFrame) -> DataFrame:
    """Per task a tree: waits by call, then by sleep function, then by waker. A task's tree is as large as its different wakers; counts are summed first."""
    w = edges.groupBy("hostname", "sleeper", "s_scall", "slpfunc", "waker").agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"))
    f = w.groupBy("hostname", "sleeper", "s_scall", "slpfunc").agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"), F.sort_array(F.collect_list(F.struct("waker", "cnt", "sleep_ns"))).alias("wakers"))
    s = f.groupBy("hostname", "sleeper", "s_scall").agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"), F.sort_array(F.collect_list(F.struct("slpfunc", "cnt", "sleep_ns", "wakers"))).alias("functions"))
    return s.groupBy("hostname", F.col("sleeper").alias("pid")).agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"), F.sort_array(F.collect_list(F.struct("s_scall", "cnt", "sleep_ns", "functions"))).alias("syscalls"))


def write_pid_json(edges: DataFrame, path: str) -> None:
    pid_tree(edges).write.json(path)


def graph_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row a host with arrays of nodes and links; a bounded graph (depth and top-n) by construction."""
    n = nodes.groupBy("hostname").agg(F.sort_array(F.collect_list(F.struct("depth", "pid"))).alias("nodes"))
    k = links.groupBy("hostname").agg(F.sort_array(F.collect_list(F.struct("waker", "sleeper", "cnt", "sleep_ns"))).alias("links"))
    return n.join(k, "hostname", "left")


def write_graph_json(nodes: DataFrame, links: DataFrame, path: str) -> None:
    graph_json(nodes, links).write.json(path)
