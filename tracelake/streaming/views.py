"""All live views from one query: stateful pairing and accounting first, windows next, and a sink that a replayed batch overwrites.

Each source of times (calls, requests, interrupts, tasks, CPUs) is one stateful operator; what it emits feeds every view that needs it, so a stream is paired
once whatever the number of views. All but requests meet in one aggregate of windows, whose rows leave once, when the watermark passes a window's end. Requests, of which
nearly each has a device and window of its own, are summed where they are paired; sums leave once, too, a row for each share of a device in the same batch, and the sink adds them up.

Views: task, cpu, disk, file, net, futex, irq, wait, profile, container and syscall; and the drill-downs of a task, ``task.syscall``, ``task.wait`` and ``task.file``, whose
``entity`` is the task. ``key`` names what is measured. n counts (calls, requests, samples, stretches begun), ns is time, bytes what was moved and errs the calls that failed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import topn
from ..operators.syscalls import FUTEX, is_err, moved_bytes
from . import live
from .drive import stateful

MEASURES = "start timestamp, hostname string, view string, entity string, key string, n long, ns long, max_ns long, bytes long, errs long"
VIEWS = ["task", "cpu", "disk", "file", "net", "futex", "irq", "wait", "profile", "container", "syscall", "task.syscall", "task.wait", "task.file"]


def _row(view: str, key, n=1, ns=0, size=0, errs=0, entity=None):
    as_col = lambda x: x if not isinstance(x, int) else F.lit(x)
    return F.struct(
        F.lit(view).alias("view"), (F.lit(None) if entity is None else entity).cast("string").alias("entity"), key.cast("string").alias("key"), as_col(n).cast("long").alias("n"),
        as_col(ns).cast("long").alias("ns"), as_col(size).cast("long").alias("bytes"), as_col(errs).cast("long").alias("errs"),
    )


def _fed(df: DataFrame, time: str, *rows) -> DataFrame:
    """The rows of views that each row feeds; null ones are none."""
    out = df.select(F.col(time).alias("event_time"), "hostname", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("v"))
    return out.select("event_time", "hostname", "v.*")


def _of_calls(stream: DataFrame, keep_ms: int) -> DataFrame:
    ns, size, errs = F.col("elapsed"), moved_bytes(), F.when(is_err(F.col("ret")), 1).otherwise(0)
    file, net = F.concat_ws(":", "dev", "inode"), F.concat_ws(">", "laddr", "raddr")
    return _fed(
        live.stream_pair_syscalls(stream, keep_ms), "exit_time", _row("syscall", F.col("syscallno"), 1, ns, size, errs), _row("task.syscall", F.col("syscallno"), 1, ns, size, errs, F.col("pid")),
        F.when(F.col("inode").isNotNull(), _row("file", file, 1, ns, size, errs)), F.when(F.col("inode").isNotNull(), _row("task.file", file, 1, ns, size, errs, F.col("pid"))),
        F.when(F.col("laddr").isNotNull(), _row("net", net, 1, ns, size, errs)), F.when(F.col("syscallno") == FUTEX, _row("futex", F.col("arg0"), 1, ns, 0, errs)),
    )


def _of_tasks(stream: DataFrame, every_ns: int, containers: DataFrame | None) -> DataFrame:
    tasks = live.stream_task_states(stream, every_ns)
    if containers is not None:
        named = containers.select("hostname", F.col("pid").alias("id"), F.col("name").alias("container")).dropDuplicates(["hostname", "id"])
        tasks = tasks.join(named, ["hostname", "id"], "left")
    else:
        tasks = tasks.withColumn("container", F.lit(None).cast("string"))
    runs, sleeps = F.col("state") == "RUNNING", (F.col("state") == "SWTCH") & F.col("label").isNotNull()
    return _fed(
        tasks, "closed", F.when(runs, _row("task", F.col("id"), F.col("n"), F.col("ns"))), F.when(runs, _row("container", F.coalesce("container", F.lit("system")), F.col("n"), F.col("ns"))),
        F.when(sleeps, _row("wait", F.col("label"), F.col("n"), F.col("ns"))), F.when(sleeps, _row("task.wait", F.col("label"), F.col("n"), F.col("ns"), entity=F.col("id"))),
    )


def _of_disks(stream: DataFrame, every_ns: int, keep_ms: int) -> DataFrame:
    """Rows of ``MEASURES``, for each share of a device one."""
    row = _row("disk", F.col("dev"), F.col("n"), F.col("svtm"), F.col("sectors") * 512).withField("start", F.col("start")).withField("hostname", F.col("hostname")).withField("max_ns", F.col("max_svtm"))
    return live.stream_block_sums(stream, every_ns, keep_ms).select(row.alias("v")).select(*[f"v.{c}" for c in live.names_of(MEASURES)])


def measures(stream: DataFrame, every_ns: int, containers: DataFrame | None = None, keep_ms: int = 600_000, views: list[str] | None = None) -> DataFrame:
    """Measures of ``views`` (all by default) in each window of ``every_ns``; a source that feeds none of them is not made. A disk may have many rows of a window, which ``added`` sums.

    ``containers`` (hostname, pid, name) is a dimension that is read anew in each batch; tasks without one are of the system.
    """
    samples = lambda: live.chosen(stream, "event = 'hardclock' and pid > 0")
    sources = [
        (["syscall", "task.syscall", "file", "task.file", "net", "futex"], lambda: _of_calls(stream, keep_ms)), (["task", "container", "wait", "task.wait"], lambda: _of_tasks(stream, every_ns, containers)),
        (["cpu"], lambda: _fed(live.stream_cpu_states(stream, every_ns), "closed", F.when(F.col("state") == "RUNNING", _row("cpu", F.col("id"), F.col("n"), F.col("ns"))))),
        (["irq"], lambda: _fed(live.stream_pair_irq(stream), "end_time", _row("irq", F.concat_ws(":", "kind", "irq"), 1, F.col("time")))),
        (["profile"], lambda: _fed(samples(), "event_time", F.when(F.size("hc.ips") > 1, _row("profile", F.get("hc.ips", F.lit(1)))))),
    ]
    parts = [make() for feeds, make in sources if views is None or set(feeds) & set(views)]
    disks = [_of_disks(stream, every_ns, keep_ms)] if views is None or "disk" in views else []
    if parts:
        rows = reduce(DataFrame.unionByName, parts)
        if views is not None:
            rows = rows.where(F.col("view").isin(views))
        parts = [_windows(rows, every_ns)]
    return reduce(DataFrame.unionByName, [*parts, *disks])


def _windows(rows: DataFrame, every_ns: int) -> DataFrame:
    out = rows.groupBy(F.window("event_time", f"{every_ns // 1_000_000} milliseconds"), "hostname", "view", "entity", "key").agg(
        F.sum("n").alias("n"), F.sum("ns").alias("ns"), F.max("ns").alias("max_ns"), F.sum("bytes").alias("bytes"), F.sum("errs").alias("errs"),
    )
    return out.select(F.col("window.start").alias("start"), *live.names_of(MEASURES)[1:])


def added(df: DataFrame) -> DataFrame:
    """One row of measures for each window and key; all rows of a window are in the same batch."""
    sums = [F.sum(c).alias(c) if c != "max_ns" else F.max(c).alias(c) for c in live.names_of(MEASURES)[5:]]
    return df.groupBy(*live.names_of(MEASURES)[:5]).agg(*sums)


def ranked(df: DataFrame, n: int, every_ns: int) -> DataFrame:
    """The first n rows of each window, host, view and entity by time, then count; with rates a second and the share of the window that the time is."""
    top = topn.top_n_per(df.withColumn("_by", F.struct("ns", "n")), ["start", "hostname", "view", "entity"], "_by", n, ["key"]).drop("_by")
    seconds = every_ns / 1e9
    return top.withColumns({"n_s": F.col("n") / seconds, "bytes_s": F.col("bytes") / seconds, "avg_ns": F.when(F.col("n") > 0, F.expr("ns div n")), "busy_pct": 100.0 * F.col("ns") / every_ns})


def start(measured: DataFrame, out: str, checkpoint: str, n: int, every_ns: int, only: dict | None = None, once: bool = False):
    """Start a query that writes the ranked rows of each batch to a folder of its number under ``out``.

    A batch that runs again after a failure has the same number and rows and replaces what it wrote before. ``only`` ({"view": ..., "entity": ..., "key": ...}) drills down;
    ``once`` ends the query when all that is there now has been read. ``checkpoint`` is where a restart goes on from.
    """
    spark = measured.sparkSession
    for column, value in (only or {}).items():
        measured = measured.where(F.col(column) == value)

    def write(df: DataFrame, batch: int) -> None:
        ranked(added(df), n, every_ns).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with stateful(spark):
        writer = measured.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
        return (writer.trigger(availableNow=True) if once else writer).start()


def written(spark, out: str) -> DataFrame:
    """All rows that ``start`` has written."""
    schema = f"{MEASURES}, n_s double, bytes_s double, avg_ns long, busy_pct double"
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
