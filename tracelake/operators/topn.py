"""Rankings. Every one breaks ties by the keys that it is given, so that results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(by: str, tie: list[str]):
    return [F.desc_nulls_last(by), *[F.asc(c) for c in tie]]


def page(df: DataFrame, by: str, n: int, skip: int = 0, tie: list[str] | None = None) -> DataFrame:
    """The n largest rows after the first ``skip``; a negative n skips so many rows and gives the rest."""
    ordered = df.orderBy(*_order(by, tie or []))
    if n < 0:
        return ordered.offset(-n)
    return ordered.offset(skip).limit(n) if skip else ordered.limit(n)


def top_n_per(df: DataFrame, group: list[str], by: str, n: int, tie: list[str] | None = None) -> DataFrame:
    """The n largest rows of each group; Spark keeps only n rows of a group in each task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*_order(by, tie or []))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


#: Measures by which entities are ranked, and the column of each.
TASKS = {"runtime": "run_ns", "systime": "sys_ns", "stealtime": "steal_ns", "runqtime": "runq_ns", "sleeps": "sleeps", "wakeups": "wakeups", "iocnt": "ios", "mp_iocnt": "mp_ios", "records": "n", "hits": "total", "sys_hits": "sys", "user_hits": "usr", "rss": "rss", "vss": "vss", "spins": "spins"}
DEVICES = {"count": "ios", "avserv": "avserv_ms", "avwait": "avwait_ms", "requeue": "requeues", "name": "devname", "mapper": "mapname"}
FILES = {"syscalls": "syscalls", "errors": "errs", "elapsed": "elapsed_ns", "opens": "opens", "pgcache": "pgcache", "logical": "bytes", "physical": "ios"}
SOCKETS = {"syscalls": "calls", "errors": "errs", "elapsed": "elapsed_ns", "opens": "opens", "bytes": "bytes"}


def top_tasks(df: DataFrame, by: str = "runtime", n: int = 10) -> DataFrame:
    return page(df, TASKS[by], n, tie=["hostname", "pid"])


def top_devices(stats: DataFrame, by: str = "avserv", n: int = 10, busy: bool | None = None, seconds: float | None = None, limit: float = 5.0) -> DataFrame:
    """Devices by a measure of their totals; ``busy`` keeps those with at least (or at most) ``limit`` requests a second."""
    d = stats.where("rw is null")
    if busy is not None:
        rate = F.col("ios") / seconds
        d = d.where(rate >= limit if busy else rate <= limit)
    return page(d, DEVICES[by], n, tie=["hostname", "dev"])


def top_files(stats: DataFrame, by: str = "syscalls", n: int = 10) -> DataFrame:
    return page(stats, FILES[by], n, tie=["hostname", "dev", "node"])


def top_sockets(stats: DataFrame, by: str = "syscalls", n: int = 10, level: str = "conn") -> DataFrame:
    s = stats.where(F.col("level") == level).withColumns({"calls": F.col("rx") + F.col("tx"), "bytes": F.col("rx_bytes") + F.col("tx_bytes")})
    return page(s, SOCKETS[by], n, tie=["hostname", "lip", "lport", "rip", "rport"])


def top_futexes(stats: DataFrame, by: str = "count", n: int = 10) -> DataFrame:
    """Futexes by count or time; ``total`` is the number of all and ``shown`` of those in the list."""
    total = stats.groupBy("hostname").agg(F.count("*").alias("total"))
    shown = page(stats, {"count": "cnt", "time": "elapsed_ns"}[by], n, tie=["hostname", "space", "addr"])
    return shown.join(F.broadcast(total), "hostname").withColumn("shown", F.least(F.col("total"), F.lit(n)))


def top_cluster(df: DataFrame, by: str, n: int = 10, tie: list[str] | None = None) -> DataFrame:
    """The first n of all hosts."""
    return page(df, by, n, tie=tie or ["hostname"])


def top_containers(stats: DataFrame, by: str = "run_ns", n: int = 10, inside: DataFrame | None = None, inside_by: str = "run_ns", inside_n: int = 5) -> DataFrame:
    """Containers by a measure, or with ``inside`` (rows of tasks with their container) the first tasks of each of them."""
    top = page(stats, by, n, tie=["hostname", "container"])
    if inside is None:
        return top
    return top_n_per(inside.join(top.select("hostname", "container"), ["hostname", "container"], "left_semi"), ["hostname", "container"], inside_by, inside_n, tie=["pid"])
