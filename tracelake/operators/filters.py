"""Filters, predicates and projections over traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CAUSAL, ORDER
from .hot import Scan, parted

#: Sector numbers that name no place on a device (fixed values).
INVALID_SECTORS = [0, -1, 0x7FFFFFFFFFF, 0x7FFF00000000]
#: Request flag bits of a flush (fixed value).
FLUSH = 1 << 14
#: Events of a tool's default set.
TOOLS = {
    "disk": ["block_rq_insert", "block_rq_issue", "block_rq_complete", "block_rq_requeue", "block_rq_abort"],
    "task": ["sched_switch", "sched_wakeup", "sched_wakeup_new", "sys_enter", "sys_exit", "hardclock", "irq_handler_entry", "irq_handler_exit", "softirq_entry", "softirq_exit"],
    "wait": ["sched_switch", "sched_wakeup", "sched_wakeup_new"],
    "runq": ["sched_switch", "sched_wakeup", "sched_wakeup_new", "sched_migrate_task"],
    "profile": ["hardclock"],
    "futex": ["sys_enter", "sys_exit", "sched_wakeup"],
    "file": ["sys_enter", "sys_exit", "cache_insert", "cache_evict"],
    "power": ["power_start", "power_end", "power_freq"],
}
SUBSYSTEMS = {"sched": "sched_", "block": "block_rq_", "syscalls": "sys_", "irq": "irq_handler_", "softirq": "softirq_", "power": "power_", "pagecache": "cache_", "memory": "mm_"}


def bounds(df: DataFrame) -> DataFrame:
    """First and last time of each host's capture; one row a host."""
    return df.groupBy("hostname").agg(F.min("hrtime").alias("t0"), F.max("hrtime").alias("t1"))


def time_range(df: DataFrame, start_ns: int, end_ns: int, absolute: bool = False) -> DataFrame:
    """Events from start to end, both included; relative to each host's first event unless absolute, which reaches the scan."""
    if absolute:
        return df.where(F.col("hrtime").between(start_ns, end_ns))
    return df.join(F.broadcast(bounds(df).select("hostname", "t0")), "hostname").where((F.col("hrtime") - F.col("t0")).between(start_ns, end_ns)).drop("t0")


def entity_filter(df: DataFrame, pid=(), tgid=(), cpu=(), dev=(), causal: bool = True) -> DataFrame:
    """Events of any of the entities; events that can name an entity on their other side always pass unless ``causal`` is false."""
    test = F.lit(False)
    for name, values in (("pid", pid), ("tgid", tgid), ("cpu", cpu), ("blk.dev", dev)):
        if values:
            test = test | F.coalesce(F.col(name).isin(list(values)), F.lit(False))
    if pid:  # the second test, of both sides, after pairing
        test = test | F.coalesce(F.col("wk.target_pid").isin(list(pid)), F.lit(False)) | F.coalesce(F.col("sw.next_pid").isin(list(pid)), F.lit(False))
    if not (pid or tgid or cpu or dev):
        return df
    return df.where(test | F.col("event").isin(CAUSAL)) if causal else df.where(test)


def select_events(df: DataFrame, events=(), subsys=(), tool: str | None = None) -> DataFrame:
    """Events by name, by subsystem or by a tool's set; without any choice all."""
    names = [*events, *(TOOLS[tool] if tool else [])]
    if not names and not subsys:
        return df
    test = F.col("event").isin(names) if names else F.lit(False)
    for s in subsys:
        test = test | F.col("event").startswith(SUBSYSTEMS[s])
    return df.where(test)


def drop_syscalls(df: DataFrame, numbers: list[int]) -> DataFrame:
    """All events but enters and exits of the given calls."""
    return df.where(~(F.col("event").isin("sys_enter", "sys_exit") & F.coalesce(F.col("sys.syscallno").isin(numbers), F.lit(False))))


def device_class(df: DataFrame, keep: str, mapper_major: int, dev: Column | None = None) -> DataFrame:
    """Physical, mapper or all devices, by the major number in the bits from 20 up."""
    is_mapper = F.shiftright(F.col("dev") if dev is None else dev, 20) == mapper_major
    return {"all": lambda: df, "mapper": lambda: df.where(is_mapper), "physical": lambda: df.where(~is_mapper)}[keep]()


def valid_sector(sector: Column) -> Column:
    return ~sector.isin(INVALID_SECTORS)


def is_barrier(sector: Column, flags: Column) -> Column:
    """A flush without a place on the device."""
    return ~valid_sector(sector) & (flags.bitwiseAND(F.lit(FLUSH)) != 0)


def capture_gaps(df: DataFrame) -> DataFrame:
    """hostname, cpu, start, end, gap_ns, events_lost: on a CPU the next event must belong to the task last switched in, and sequence numbers of a
    capture must follow each other; where neither the task nor the sequence fits, events were lost."""
    w = Window.partitionBy("hostname", "cpu").orderBy("hrtime", "cpu_seqno")
    running = F.when(F.col("event") == "sched_switch", F.col("sw.next_pid")).otherwise(F.col("pid"))
    seen = df.where("pid >= 0").select("hostname", "cpu", "hrtime", "cpu_seqno", "pid", F.lag(running).over(w).alias("expected"), F.lag("hrtime").over(w).alias("start"), (F.col("cpu_seqno") - F.lag("cpu_seqno").over(w)).alias("step"))
    return seen.where("expected is not null and expected <> pid").select(
        "hostname", "cpu", "start", F.col("hrtime").alias("end"), (F.col("hrtime") - F.col("start")).alias("gap_ns"), F.greatest(F.col("step") - 1, F.lit(0)).alias("events_lost")
    )


def mask_gaps(intervals: DataFrame, gaps: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """State intervals (hostname, cpu, start, end, state, ns) whose RUNNING or RUNQ time crosses a gap of their CPU become UNKNOWN and are not charged.

    Gaps and the ends of intervals of a CPU are put in one order: an interval is crossed if the farthest end of the gaps that begin before its end lies after its start. So
    every row is read once, however long intervals and gaps are. ``cuts`` are those of hot CPUs, by time.
    """
    own = F.struct(*[F.col(c) for c in intervals.columns])
    ends = intervals.select("hostname", "cpu", F.col("end").alias("hrtime"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("ge"), own.alias("_i"))
    starts = gaps.select("hostname", "cpu", F.col("start").alias("hrtime"), F.lit(1).alias("turn"), F.col("end").alias("ge"))

    def work(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
        scan = Scan(("hostname", "cpu"), ("hrtime", "turn"), cuts)
        return scan.bare(scan.running(scan.sliced(rows), "_reach", F.col("ge"), "max"))

    met = parted(ends.unionByName(starts, allowMissingColumns=True), cuts, work).where("turn = 0")
    # A task's rows that begin together are crossed together.
    together = Window.partitionBy("hostname", "pid", "start")
    out = met.select("_i.*", F.coalesce(F.col("_reach") > F.col("_i.start"), F.lit(False)).alias("_hit")).withColumn("_hit", F.max("_hit").over(together))
    bad = F.col("_hit") & F.col("state").isin("RUNNING", "RUNQ")
    return out.withColumns({"ns": F.when(bad, F.lit(0)).otherwise(F.col("ns")), "state": F.when(bad, "UNKNOWN").otherwise(F.col("state"))}).drop("_hit")


def format_time(df: DataFrame, mode: str = "rel", anchor_ns: int = 0, name: str = "time") -> DataFrame:
    """The event time as seconds from the first event, raw, wall clock or epoch seconds; ``anchor_ns`` is the wall clock at hrtime 0."""
    if mode == "rel":
        return df.join(F.broadcast(bounds(df).select("hostname", "t0")), "hostname").withColumn(name, (F.col("hrtime") - F.col("t0")) / 1e9).drop("t0")
    wall = F.col("hrtime") + anchor_ns
    micros = F.expr(f"(hrtime + {anchor_ns}) div 1000")  # whole numbers: a double cannot hold the nanoseconds of today
    value = {"abs": F.col("hrtime"), "epoch": wall / 1e9, "fmt": F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss.SSSSSS")}[mode]
    return df.withColumn(name, value)


def partition_by_slice(df: DataFrame, ms: int = 1) -> DataFrame:
    """A ``time_slice`` column and rows clustered by it, so that files written from the result can be pruned by time."""
    return df.withColumn("time_slice", F.expr(f"hrtime div {ms * 1_000_000}")).repartitionByRange("hostname", "time_slice").sortWithinPartitions("hostname", *ORDER)


def futex_addr(calls: DataFrame, uaddr: int) -> DataFrame:
    return calls.where(F.col("addr") == uaddr)


def runq_pid(latencies: DataFrame, pid: int) -> DataFrame:
    return latencies.where(F.col("pid") == pid)


def rq_delay(latencies: DataFrame, usecs: int) -> DataFrame:
    """Run-queue delays above a limit."""
    return latencies.where(F.col("latency_us") > usecs)


def browse(df: DataFrame, family: str) -> DataFrame:
    """Events of one family with its fields as columns, in order of time."""
    return df.where(F.col(family).isNotNull()).select("hostname", "hrtime", "cpu", "cpu_seqno", "pid", "tgid", "event", f"{family}.*").orderBy("hrtime", F.col("cpu"), F.col("cpu_seqno"))
