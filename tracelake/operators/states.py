"""Task and CPU states: what a task does while it runs, and what it waits for.

``task_state_intervals`` turns events into one row for each interval in which a task keeps its
state. It is a chain of windows over (hostname, pid), which Spark plans as one shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import bounds
from .hot import SLICES, Scan, hot_cuts, parted

#: Bits of a previous state that say that the task ends (fixed values).
EXIT_BITS = 0x10 | 0x20 | 0x40
#: How the second event profile names a wait.
WIN_SLEEP = ("Waiting", "Terminated")
#: Upper edges of histogram buckets in microseconds, of run-queue latencies and of idle times (fixed values).
RUNQ_EDGES = [5, 10, 20, 50, 100, 500, 1000, 2000, 10000, 20000]
IDLE_EDGES = [10, 20, 30, 40, 50, 60, 75, 100, 125, 150, 200, 500, 1000, 5000, 20000]


def task_points(df: DataFrame, gaps: DataFrame | None = None, measures: bool = False) -> DataFrame:
    """One row for each task that an event affects: kind in, out, wake, enter, exit, irq+, irq-, sample or gap.

    With ``measures`` a switch-out carries steal time, priority and sizes, and a wakeup gives the waker a row too, of
    kind wakes: all that ``task_cpu`` needs comes from this one table.
    """
    ev = F.col("event")
    none = F.lit(None)

    size = F.struct(F.col("sw.stealtime").alias("steal"), F.col("sw.prev_prio").alias("prio"), F.col("sw.total_rss").alias("rss"), F.col("sw.total_vm").alias("vss"))

    def point(pid, kind, asleep=none, mode=none, scall=none, waker=none, ips=none, new=none):
        told = [F.when(F.lit(kind == "out"), size).alias("size")] if measures else []
        return F.struct(
            *told,
            pid.cast("long").alias("pid"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), asleep.cast("string").alias("asleep"), mode.cast("string").alias("mode"),
            scall.cast("int").alias("scall"), waker.cast("long").alias("waker"), ips.cast("array<bigint>").alias("ips"), new.cast("boolean").alias("new"),
        )

    prev = F.col("sw.prev_state")
    asleep = F.when(prev == 0, "Q").when(prev.bitwiseAND(F.lit(EXIT_BITS)) != 0, "Z").otherwise("S")
    # A sample in interrupt context says nothing of the task; else its first context marker tells the mode.
    sample = F.when(F.col("hc.preempt_count") >= 256, none).when(F.get("hc.ips", F.lit(0)) == -512, "USER").otherwise("SYS")
    woken = [point(F.col("pid"), "wakes")] if measures else []
    rows = (
        F.when(ev == "sched_switch", F.array(point(F.col("pid"), "out", asleep, ips=F.col("sw.ips")), point(F.col("sw.next_pid"), "in")))
        .when(ev.isin("sched_wakeup", "sched_wakeup_new") & (F.col("wk.success") == 1), F.array(point(F.col("wk.target_pid"), "wake", waker=F.col("pid"), new=F.col("wk.is_new")), *woken))
        .when(ev == "sys_enter", F.array(point(F.col("pid"), "enter", mode=F.lit("SYS"), scall=F.col("sys.syscallno"))))
        .when(ev == "sys_exit", F.array(point(F.col("pid"), "exit", mode=F.lit("USER"), scall=F.lit(-1))))
        .when(ev.isin("irq_handler_entry", "softirq_entry"), F.array(point(F.col("pid"), "irq+", mode=F.when(ev == "softirq_entry", "SOFTIRQ").otherwise("HARDIRQ"))))
        .when(ev.isin("irq_handler_exit", "softirq_exit"), F.array(point(F.col("pid"), "irq-")))
        .when((ev == "hardclock") & sample.isNotNull(), F.array(point(F.col("pid"), "sample", mode=sample)))
    )
    head = ["hostname", "hrtime", "cpu", "cpu_seqno", *(["event_time"] if "event_time" in df.columns else [])]
    points = df.select(*head, F.explode(rows).alias("p")).select(*head, "p.*").where("pid > 0")
    if gaps is None:
        return points
    w = Window.partitionBy("hostname", "pid").orderBy("hrtime", "cpu_seqno")
    seen = points.select("hostname", "pid", "cpu", F.col("hrtime").alias("since"), F.lead("hrtime", 1, (1 << 62)).over(w).alias("until"))
    hit = seen.join(gaps.select("hostname", "cpu", F.col("end").alias("hrtime")), ["hostname", "cpu"]).where("since < hrtime and hrtime <= until")
    return points.unionByName(hit.select("hostname", "hrtime", "cpu", F.lit(-1).cast("long").alias("cpu_seqno"), "pid", F.lit("gap").alias("kind")), allowMissingColumns=True)


def hot_tasks(df: DataFrame, slices: int = SLICES) -> DataFrame | None:
    """Cuts of the tasks that are hot (see ``hot``), for intervals, latencies and calls."""
    return hot_cuts(task_points(df).select("hostname", "pid", "hrtime"), ("hostname", "pid"), "hrtime", slices)


def task_state_intervals(df: DataFrame, gaps: DataFrame | None = None, cuts: DataFrame | None = None, points: DataFrame | None = None, span: DataFrame | None = None) -> DataFrame:
    """hostname, pid, cpu, state, mode, start, end, ns, ended_by, waker, scall, ips, seqno of each interval.

    ``points`` (``task_points``, of all events and gaps) and ``span`` (``bounds``) are for callers that have them already.

    state is N (before anything is known, or after a gap), RUNNING, RUNQ, SWTCH or ZOMBIE. mode is SYS, USER, HARDIRQ,
    SOFTIRQ or null. ns is 0 where nothing is charged: N, ZOMBIE, and RUNNING or RUNQ intervals that a gap ends.
    """
    t = F.broadcast(bounds(df) if span is None else span)  # a row a host
    return parted(task_points(df, gaps) if points is None else points.where("kind <> 'wakes'").drop("size"), cuts, lambda points, cuts: _intervals(points, t, cuts))


def _intervals(points: DataFrame, t: DataFrame, cuts: DataFrame | None) -> DataFrame:
    keys = ["hostname", "pid"]
    scan = Scan(keys, ("hrtime", "cpu", "cpu_seqno"), cuts)
    place = F.struct("hrtime", "cpu", "cpu_seqno")
    kind = F.col("kind")
    runs = kind.isin("in", "enter", "exit", "sample")

    # Wakeups of a task that runs are no events.
    p = scan.last(scan.sliced(points), {"running": F.when(runs, 1).when(kind.isin("out", "gap"), 0)})
    p = p.where("not (kind = 'wake' and coalesce(running, 0) = 1)")
    # Base state before each row: what was set last, unknown if a gap came since while running or queued.
    setter = F.when(runs, "R").when(kind == "out", F.col("asleep")).when(kind == "wake", "Q")
    p = p.withColumn("setter", F.when(kind == "sample", None).otherwise(setter))
    p = scan.last(p, {"set": F.when(setter.isNotNull(), F.struct(place.alias("n"), setter.alias("base"))), "gap_at": F.when(kind == "gap", place)})
    live = F.col("set.base").isin("R", "Q")
    p = p.withColumn("base", F.when(F.col("set").isNull() | (live & F.coalesce(F.col("gap_at") > F.col("set.n"), F.lit(False))), "N").otherwise(F.col("set.base")))
    p = scan.running(p.where("not (kind = 'gap' and base not in ('R', 'Q'))"), "epoch", F.when(kind == "gap", 1).otherwise(0))
    # A sample labels the open interval; it begins one only where nothing is known.
    sample = F.when(kind == "sample", F.struct("hrtime", "mode"))
    if cuts is None:
        e = Window.partitionBy("pid", "hostname", "epoch").orderBy("hrtime", "cpu", "cpu_seqno")
        p = p.withColumn("first_sample", F.first(sample, True).over(e.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        scan = Scan(keys, ("epoch", "hrtime", "cpu", "cpu_seqno"))  # epochs rise with time: the order of that window, so no third sort
    else:
        firsts = p.where(kind == "sample").groupBy(*keys, "epoch").agg(F.min_by(sample, place).alias("first_sample"))
        p = p.join(firsts, [*keys, "epoch"], "left")
    p = p.where("not (kind = 'sample' and base <> 'N')")
    state = F.when(kind.isin("irq+", "irq-"), F.when(F.col("base") == "N", "N").otherwise(F.col("base"))).when(kind == "gap", "N").otherwise(F.coalesce("setter", F.lit("R")))
    p = scan.last(p, {
        "call": F.when(kind.isin("enter", "exit") & F.col("mode").isNotNull(), F.struct("epoch", "mode")), "irq": F.when(kind == "irq+", F.col("mode")).otherwise(F.lit("")),
        "open_call": F.when(kind.isin("enter", "exit"), F.col("scall")).when(kind == "gap", F.lit(-1)),
    }, upto=True)
    p = scan.next(scan.last(p, {"earlier": F.lit(True)}), "then", F.struct("hrtime", "kind", "waker"))
    p = p.join(t, "hostname")
    p = p.withColumns({
        "end": F.coalesce("then.hrtime", "t1"), "next_kind": F.col("then.kind"), "next_waker": F.col("then.waker"), "code": state, "order": F.when(F.col("earlier").isNull(), 1),
        "call_mode": F.when(F.col("call.epoch") == F.col("epoch"), F.col("call.mode")),
    })
    labelled = F.when(F.col("irq") != "", F.col("irq")).otherwise(F.coalesce("call_mode", F.when(F.col("first_sample.hrtime") <= F.col("end"), F.col("first_sample.mode"))))
    charged = ~F.col("code").isin("N", "Z") & ~(F.coalesce(F.col("next_kind"), F.lit("")).eqNullSafe("gap") & F.col("code").isin("R", "Q"))
    name = F.when(F.col("code") == "R", "RUNNING").when(F.col("code") == "Q", "RUNQ").when(F.col("code") == "S", "SWTCH").when(F.col("code") == "Z", "ZOMBIE").otherwise("N")
    # The first row of a task gives the time before it too; one pass gives both.
    p = p.withColumn("before", F.explode(F.when(F.col("order") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    either = lambda before, after: F.when(F.col("before"), before).otherwise(after)
    return p.select(*keys, "cpu", either(F.lit("N"), name).alias("state"), either(F.lit(None), labelled).alias("mode"), either(F.col("t0"), F.col("hrtime")).alias("start"), either(F.col("hrtime"), F.col("end")).alias("end"),
                    either(F.lit(0), F.when(charged, F.col("end") - F.col("hrtime")).otherwise(0)).cast("long").alias("ns"), either(F.col("kind"), F.col("next_kind")).alias("ended_by"), either(F.col("waker"), F.col("next_waker")).alias("waker"),
                    either(F.lit(-1), F.coalesce("open_call", F.lit(-1))).alias("scall"), either(F.lit(None), F.col("ips")).alias("ips"), either(F.lit(-1), F.col("cpu_seqno")).cast("long").alias("seqno"))


def _ns(test: str):
    return F.coalesce(F.sum(F.when(F.expr(test), F.col("ns"))), F.lit(0))


SYS = "state = 'RUNNING' and coalesce(mode, 'SYS') = 'SYS'"


def task_cpu(df: DataFrame, intervals: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """Per task: run, sys, user, irq, runq, sleep and total ns; counts of switches, sleeps, preemptions, wakeups and settings to the run queue; steal, memory, priorities, last CPU, migrations.

    All counts come from one table of points (``task_points`` with measures), which may be given.
    """
    iv = task_state_intervals(df) if intervals is None else intervals
    times = iv.groupBy("hostname", "pid").agg(
        _ns("state = 'RUNNING'").alias("run_ns"), _ns(SYS).alias("sys_ns"), _ns("state = 'RUNNING' and mode = 'USER'").alias("user_ns"),
        _ns("state = 'RUNNING' and mode in ('HARDIRQ', 'SOFTIRQ')").alias("irq_ns"), _ns("state = 'RUNQ'").alias("runq_ns"), _ns("state = 'SWTCH'").alias("sleep_ns"), F.sum("ns").alias("total_ns"),
    )
    p = task_points(df, measures=True) if points is None else points
    kind, at = F.col("kind"), F.struct("hrtime", "cpu_seqno")
    here = ~kind.isin("wake", "wakes", "gap")
    w = Window.partitionBy("hostname", "pid").orderBy("hrtime", "cpu", "cpu_seqno").rowsBetween(Window.unboundedPreceding, -1)
    seen = p.withColumn("moved", here & (F.col("cpu") != F.last(F.when(here, F.col("cpu")), True).over(w)))
    size = lambda c: F.max_by(f"size.{c}", F.when(F.col(f"size.{c}") > 0, at))
    counts = seen.groupBy("hostname", "pid").agg(
        F.count_if(kind == "out").alias("switches"), F.count_if((kind == "out") & (F.col("asleep") != "Q")).alias("sleeps"), F.count_if((kind == "out") & (F.col("asleep") == "Q")).alias("preempts"),
        F.count_if(kind == "in").alias("setrq"), F.max(F.when(here, F.coalesce(F.col("asleep") == "Z", F.lit(False)))).alias("terminated"), F.max_by("cpu", F.when(here, at)).alias("last_cpu"), F.count_if(F.coalesce("moved", F.lit(False))).alias("migrations"),
        F.sum("size.steal").alias("steal_ns"), F.max("size.prio").alias("prio_hi"), F.min("size.prio").alias("prio_lo"), size("rss").alias("rss"), size("vss").alias("vss"), F.count_if(kind == "wakes").alias("wakeups"),
    )
    return times.join(counts, ["hostname", "pid"], "left").fillna(0, ["switches", "sleeps", "preempts", "setrq", "wakeups", "steal_ns", "migrations"])


def mem_top(df: DataFrame, by: str = "rss") -> DataFrame:
    """Last sample of resident (or virtual) size that is not 0, for each task."""
    size = F.col("sw.total_rss" if by == "rss" else "sw.total_vm")
    return df.where("event = 'sched_switch' and pid > 0").where(size > 0).groupBy("hostname", "pid").agg(F.max_by(size, F.struct("hrtime", "cpu_seqno")).alias(by))


def cpu_intervals(df: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """hostname, cpu, start, end, ns, pid (0 = idle): what each CPU runs between switches."""
    w = Window.partitionBy("hostname", "cpu").orderBy("hrtime", "cpu_seqno")
    sw = df.where("event = 'sched_switch'").select("hostname", "cpu", "hrtime", "cpu_seqno", F.col("sw.next_pid").alias("next"), F.col("sw.stealtime").alias("steal"))
    sw = sw.join(F.broadcast(bounds(df) if span is None else span), "hostname")
    return sw.select("hostname", "cpu", F.col("hrtime").alias("start"), F.coalesce(F.lead("hrtime").over(w), "t1").alias("end"), F.col("next").alias("pid"), "steal").withColumn("ns", F.col("end") - F.col("start"))


def cpu_time(df: DataFrame, topology: DataFrame, intervals: DataFrame | None = None, span: DataFrame | None = None) -> DataFrame:
    """Per CPU: total, busy, sys, user, irq, idle ns and switches; a CPU without events is idle for the whole capture."""
    span = bounds(df) if span is None else span
    iv = task_state_intervals(df) if intervals is None else intervals
    run = iv.where("state = 'RUNNING'").groupBy("hostname", "cpu").agg(_ns(SYS).alias("sys_ns"), _ns("mode = 'USER'").alias("user_ns"), _ns("mode in ('HARDIRQ', 'SOFTIRQ')").alias("irq_ns"))
    idle = cpu_intervals(df, span).groupBy("hostname", "cpu").agg(
        F.sum(F.when(F.col("pid") == 0, F.col("ns")).otherwise(0)).alias("idle_ns"), F.sum(F.when(F.col("pid") != 0, F.col("ns")).otherwise(0)).alias("busy_ns"), F.count("*").alias("switches"), F.sum(F.coalesce("steal", F.lit(0))).alias("steal_ns")
    )
    out = topology.select("hostname", "cpu", "ldom").join(idle, ["hostname", "cpu"], "left").join(run, ["hostname", "cpu"], "left").join(F.broadcast(span), "hostname")
    out = out.withColumn("idle_ns", F.coalesce("idle_ns", F.col("t1") - F.col("t0"))).fillna(0)
    return out.select("hostname", "ldom", "cpu", (F.col("idle_ns") + F.col("busy_ns")).alias("total_ns"), "busy_ns", "sys_ns", "user_ns", "irq_ns", "idle_ns", "steal_ns", "switches")


_CPU_SUMS = ["total_ns", "busy_ns", "sys_ns", "user_ns", "irq_ns", "idle_ns", "steal_ns", "switches"]


def node_cpu_time(cpus: DataFrame) -> DataFrame:
    """Nodes (ldom), hosts (ldom null) and all hosts (hostname null) as sums of CPUs, with their number and the busy share."""
    out = cpus.rollup("hostname", "ldom").agg(F.count("*").alias("n_cpus"), *[F.sum(c).alias(c) for c in _CPU_SUMS])
    return out.withColumn("busy_pct", F.when(F.col("total_ns") > 0, 100.0 * F.col("busy_ns") / F.col("total_ns")))


def global_cpu_time(cpus: DataFrame) -> DataFrame:
    return node_cpu_time(cpus).where("ldom is null and hostname is not null").drop("ldom")


def runq_latency(df: DataFrame, topology: DataFrame | None = None, cuts: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """hostname, pid, cpu, ready_ts, run_ts, latency_us, migrated, node_migrated: from the wakeup or preemption that queued a task to its next switch-in."""
    points = task_points(df) if points is None else points.drop("size")
    out = parted(points.where("kind in ('in', 'out', 'wake', 'enter', 'exit')"), cuts, _latencies)
    if topology is None:
        return out.drop("last_cpu")
    t = topology.select("hostname", "cpu", "ldom")
    out = out.join(F.broadcast(t), ["hostname", "cpu"], "left").join(F.broadcast(t.select("hostname", F.col("cpu").alias("last_cpu"), F.col("ldom").alias("last_ldom"))), ["hostname", "last_cpu"], "left")
    return out.withColumn("node_migrated", F.coalesce(F.col("ldom") != F.col("last_ldom"), F.lit(False))).drop("last_cpu", "last_ldom")


def _latencies(points: DataFrame, cuts: DataFrame | None) -> DataFrame:
    scan = Scan(("hostname", "pid"), ("hrtime", "cpu", "cpu_seqno"), cuts)
    kind = F.col("kind")
    runs = kind.isin("in", "enter", "exit")
    p = scan.last(scan.sliced(points), {"running": F.when(runs, 1).when(kind == "out", 0)}).where("not (kind = 'wake' and coalesce(running, 0) = 1)")
    state = F.when(runs, "R").when(kind == "wake", "Q").otherwise(F.col("asleep"))
    p = scan.last(p.withColumn("state", state), {"old": F.col("state")})  # never null
    p = p.withColumn("ready", F.when((F.col("state") == "Q") & (~F.col("old").eqNullSafe("Q") | F.coalesce("new", F.lit(False))), F.struct("hrtime", "cpu")))
    p = scan.last(p, {"q": F.col("ready"), "last_cpu": F.when(kind != "wake", F.col("cpu"))})
    return p.where("kind = 'in' and old = 'Q'").select("hostname", "pid", "cpu", F.col("q.hrtime").alias("ready_ts"), F.col("hrtime").alias("run_ts"), F.expr("(hrtime - q.hrtime) div 1000").alias("latency_us"), "last_cpu",
                                                     F.coalesce(F.col("cpu") != F.col("last_cpu"), F.lit(False)).alias("migrated"))


_BY = {"pid": ["hostname", "pid"], "pid_cpu": ["hostname", "pid", "cpu"], "cpu": ["hostname", "cpu"], "node": ["hostname", "ldom"], "host": ["hostname"]}


def runq_stats(latencies: DataFrame, by: str = "pid") -> DataFrame:
    """Count, total, mean and longest run-queue latency, and migrations, by pid, pid_cpu, cpu, node or host."""
    node = [F.count_if("node_migrated").alias("node_migrations")] if "node_migrated" in latencies.columns else []
    return latencies.groupBy(*_BY[by]).agg(
        F.count("*").alias("cnt"), F.sum("latency_us").alias("total_us"), F.expr("sum(latency_us) div count(*)").alias("avg_us"), F.max("latency_us").alias("max_us"), F.count_if("migrated").alias("migrations"), *node
    )


def runq_levels(latencies: DataFrame) -> DataFrame:
    """``runq_stats`` of tasks on each CPU, tasks, CPUs and hosts in one aggregate; ``level`` tells them apart."""
    sets = [[F.col(c) for c in _BY[by]] for by in ("pid_cpu", "pid", "cpu", "host")]
    out = latencies.groupingSets(sets, "hostname", "pid", "cpu").agg(
        F.count("*").alias("cnt"), F.sum("latency_us").alias("total_us"), F.max("latency_us").alias("max_us"), F.count_if("migrated").alias("migrations"), F.grouping_id("hostname", "pid", "cpu").alias("_g"),
    )
    level = F.when(F.col("_g") == 0, "pid_cpu").when(F.col("_g") == 1, "pid").when(F.col("_g") == 2, "cpu").otherwise("host")
    return out.select("hostname", level.alias("level"), "pid", "cpu", "cnt", "total_us", F.expr("total_us div cnt").alias("avg_us"), "max_us", "migrations")


def wide_sum(ns):
    """A sum of nanoseconds that no number of rows overflows, as decimal(38,0)."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    return F.sum(ns.cast("decimal(20,0)")).cast("decimal(38,0)")


def bucket(value, edges: list):
    """The number of edges that a value has reached: 0 below the first, len(edges) from the last on."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(value < edges[k], F.lit(k)).otherwise(out)
    return out


def runq_hist(latencies: DataFrame, by: str = "cpu") -> DataFrame:
    """Run-queue latencies in buckets of ``RUNQ_EDGES`` microseconds, one row a bucket."""
    return latencies.withColumn("bucket", bucket(F.col("latency_us"), RUNQ_EDGES)).groupBy(*_BY[by], "bucket").agg(F.count("*").alias("n"))


def idle_intervals(df: DataFrame) -> DataFrame:
    return cpu_intervals(df).where("pid = 0")


def idle_hist(df: DataFrame) -> DataFrame:
    """Idle intervals of each CPU in 16 buckets of microseconds."""
    return idle_intervals(df).withColumn("bucket", bucket(F.expr("ns div 1000"), IDLE_EDGES)).groupBy("hostname", "cpu", "bucket").agg(F.count("*").alias("n"))


def idle_at(df: DataFrame, t: int) -> DataFrame:
    """CPUs idle at a moment: their number, mean and longest idle interval, and the CPU of the longest."""
    return idle_intervals(df).where((F.col("start") <= t) & (F.col("end") > t)).groupBy("hostname").agg(
        F.count("*").alias("n_idle"), F.expr("sum(ns) div count(*)").alias("avg_idle"), F.max("ns").alias("max_idle"), F.max_by("cpu", F.struct("ns", "cpu")).alias("cpu")
    )


def ht_states(df: DataFrame, topology: DataFrame) -> DataFrame:
    """hostname, pcpu_idx, ldom, cpu, cpu_seqno, start, end, ns, first, second: whether the two logical CPUs of a physical one are busy, interval by interval."""
    t = topology.select("hostname", "cpu", "pcpu_idx", "ldom", (F.col("cpu") > F.col("lcpu_sibling")).cast("int").alias("side"))
    e = df.where("event = 'sched_switch'").select("hostname", "cpu", "hrtime", "cpu_seqno", (F.col("sw.next_pid") != 0).alias("busy")).join(F.broadcast(t), ["hostname", "cpu"])
    w = Window.partitionBy("hostname", "pcpu_idx").orderBy("hrtime", "cpu", "cpu_seqno")
    side = lambda k: F.last(F.when(F.col("side") == k, F.col("busy")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = e.join(F.broadcast(bounds(df)), "hostname").select("hostname", "pcpu_idx", "ldom", "cpu", "cpu_seqno", F.col("hrtime").alias("start"), F.coalesce(F.lead("hrtime").over(w), "t1").alias("end"), side(0).alias("first"), side(1).alias("second"))
    return out.where("first is not null and second is not null").withColumn("ns", F.col("end") - F.col("start"))


def ht_usage(df: DataFrame, topology: DataFrame) -> DataFrame:
    """Time of each physical CPU by the state of both siblings."""
    s = lambda a, b: F.sum(F.when((F.col("first") == a) & (F.col("second") == b), F.col("ns")).otherwise(0))
    return ht_states(df, topology).groupBy("hostname", "pcpu_idx").agg(s(False, False).alias("double_idle"), s(True, False).alias("lcpu1_busy"), s(False, True).alias("lcpu2_busy"), s(True, True).alias("double_busy"))


#: Widths of dyadic bins, as powers of two of a nanosecond: from a microsecond to some 13 days.
LEVELS = (10, 50)


def interval_bins(start, end):
    """The bins of an interval: its level is that of the least width which is no less than its length, so it touches two bins there at most (more only above the last level)."""
    level = F.least(F.greatest(F.ceil(F.log2((end - start).cast("double"))).cast("int"), F.lit(LEVELS[0])), F.lit(LEVELS[1]))
    first, last = F.call_function("shiftright", start, level), F.call_function("shiftright", end - 1, level)
    return F.transform(F.sequence(first, last), lambda b: F.struct(level.alias("level"), b.alias("bin")))


def moment_bins(t):
    """The bin of a moment at each level."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(t, k).alias("bin")) for k in range(LEVELS[0], LEVELS[1] + 1)])


def ht_dbdi(df: DataFrame, topology: DataFrame, unit: int = 1) -> DataFrame:
    """When a pair turns double busy, how long another pair of the host has been double idle at longest, in 16 buckets.

    States follow each other by hrtime as it is; moments and idle intervals are then measured in units of ``unit`` nanoseconds.
    Moments and idle intervals meet in dyadic bins (``bins``), so the join is on equal keys and an interval has two rows at most, however long it is.
    """
    s = ht_states(df, topology)
    w = Window.partitionBy("hostname", "pcpu_idx").orderBy("start", "cpu", "cpu_seqno")
    both = (F.col("first") & F.col("second"))
    turned = s.withColumn("was", F.lag(both).over(w)).where(both & ~F.coalesce("was", F.lit(False))).select("hostname", F.col("pcpu_idx").alias("p"), F.expr(f"start div {unit}").alias("t")).withColumn("bin", F.explode(moment_bins(F.col("t"))))
    idle = s.where("not first and not second").select("hostname", "pcpu_idx", F.expr(f"start div {unit}").alias("start"), F.expr(f"end div {unit}").alias("end")).where("start < end").select("hostname", "pcpu_idx", "start", "end", F.explode(interval_bins(F.col("start"), F.col("end"))).alias("bin"))
    met = turned.join(idle, ["hostname", "bin"]).where("p <> pcpu_idx and start <= t and t < end").groupBy("hostname", "p", "t").agg(F.max(F.col("t") - F.col("start")).alias("idle_ns"))
    return met.withColumn("bucket", bucket(F.expr("idle_ns div 1000"), IDLE_EDGES)).groupBy("hostname", F.col("p").alias("pcpu_idx"), "bucket").agg(F.count("*").alias("n"))


def msr_stats(df: DataFrame, by: str = "pid") -> DataFrame:
    """Hardware counters: per task switch-out less switch-in, per CPU less the switch before. Counters are references, hits missed, instructions, cycles, actual, reference clocks, interrupts."""
    names = ["llc_ref", "llc_miss", "instrs", "cycles", "act_clk", "ref_clk", "smi"]
    w = Window.partitionBy("hostname", "cpu").orderBy("hrtime", "cpu_seqno")
    d = df.where("event = 'sched_switch' and sw.msr is not null").select("hostname", "cpu", "pid", F.col("sw.msr").alias("cur"), F.lag("sw.msr").over(w).alias("prev"), F.lag("sw.next_pid").over(w).alias("in_pid"))
    d = d.where("prev is not null" + (" and in_pid = pid" if by == "pid" else "")).withColumn("d", F.zip_with("cur", "prev", lambda a, b: a - b))
    keys = ["hostname", by]
    out = d.groupBy(*keys).agg(*[F.sum(F.col("d")[i]).alias(n) for i, n in enumerate(names)])
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return out.withColumns({"llc_hit_pct": F.when(F.col("llc_ref") != 0, 100.0 * (F.col("llc_ref") - F.col("llc_miss")) / F.col("llc_ref")), "cpi": ratio("cycles", "instrs"), "clock_ratio": ratio("act_clk", "ref_clk")})


def wakeup_streaks(df: DataFrame) -> DataFrame:
    """Longest run of wakeups of different targets by one task without a switch-out or system call in between, when it was reached first, and how often."""
    w = Window.partitionBy("hostname", "pid").orderBy("hrtime", "cpu", "cpu_seqno")
    e = df.where("pid > 0").where("event in ('sched_switch', 'sys_enter', 'sys_exit') or (event in ('sched_wakeup', 'sched_wakeup_new') and wk.success = 1)")
    e = e.withColumn("reset", (F.col("wk").isNull()).cast("int")).withColumn("island", F.sum("reset").over(w))
    i = Window.partitionBy("hostname", "pid", "island").orderBy("hrtime", "cpu", "cpu_seqno")
    e = e.where("wk is not null").withColumn("other", (~F.col("wk.target_pid").eqNullSafe(F.lag("wk.target_pid").over(i))).cast("int")).withColumn("streak", F.sum("other").over(i))
    tops = e.groupBy("hostname", "pid", "island").agg(F.max("streak").alias("streak"), F.min_by("hrtime", F.struct(-F.col("streak"), F.col("hrtime"))).alias("t"))
    return _streak_hits(tops)


def _streak_hits(tops: DataFrame) -> DataFrame:
    counted = tops.groupBy("hostname", "pid", "streak").agg(F.count("*").alias("hits"), F.min("t").alias("t"))
    best = F.struct("streak", "hits", "t")
    return counted.groupBy("hostname", "pid").agg(F.max(best).alias("b")).select("hostname", "pid", F.col("b.streak").alias("max_wakeups"), F.col("b.t").alias("when"), F.col("b.hits").cast("long").alias("hits"))


def migrations(df: DataFrame, topology: DataFrame) -> DataFrame:
    """Changes of CPU and of node between the events of a task."""
    w = Window.partitionBy("hostname", "pid").orderBy("hrtime", "cpu", "cpu_seqno")
    p = task_points(df).where("kind <> 'wake'").join(F.broadcast(topology.select("hostname", "cpu", "ldom")), ["hostname", "cpu"], "left")
    p = p.select("hostname", "pid", (F.col("cpu") != F.lag("cpu").over(w)).alias("c"), (F.col("ldom") != F.lag("ldom").over(w)).alias("n"))
    return p.groupBy("hostname", "pid").agg(F.count_if(F.coalesce("c", F.lit(False))).alias("cpu_migrations"), F.count_if(F.coalesce("n", F.lit(False))).alias("node_migrations"))


def uflt_sleep(intervals: DataFrame) -> DataFrame:
    """Sleeps outside of system calls, which are user page faults: count and time per task."""
    return intervals.where("state = 'SWTCH' and ended_by = 'wake' and mode = 'USER'").groupBy("hostname", "pid").agg(F.count("*").alias("cnt"), F.sum("ns").alias("sleep_ns"))


def syscall_breakdown(intervals: DataFrame) -> DataFrame:
    """Sleep, run-queue and CPU time inside each system call of each task."""
    return intervals.where("scall >= 0").groupBy("hostname", "pid", F.col("scall").alias("syscallno")).agg(_ns("state = 'SWTCH'").alias("sleep_ns"), _ns("state = 'RUNQ'").alias("runq_ns"), _ns("state = 'RUNNING'").alias("cpu_ns"))


def capture_quality(df: DataFrame) -> DataFrame:
    """Events, gaps and lost events of each CPU."""
    gaps = capture_gaps_of(df).groupBy("hostname", "cpu").agg(F.count("*").alias("gaps"), F.sum("events_lost").alias("events_lost"))
    return df.groupBy("hostname", "cpu").agg(F.count("*").alias("events")).join(gaps, ["hostname", "cpu"], "left").fillna(0)


def capture_gaps_of(df: DataFrame) -> DataFrame:
    from .filters import capture_gaps

    return capture_gaps(df)


def count_levels(df: DataFrame) -> DataFrame:
    """Events of hosts, types, tasks and tasks by type in one aggregate; ``level`` tells them apart."""
    sets = [[F.col(c) for c in cols] for cols in (["hostname"], ["hostname", "event"], ["hostname", "pid"], ["hostname", "pid", "event"])]
    out = df.groupingSets(sets, "hostname", "pid", "event").agg(F.count("*").alias("n"), F.grouping_id("hostname", "pid", "event").alias("_g"))
    level = F.when(F.col("_g") == 0, "pid_event").when(F.col("_g") == 1, "pid").when(F.col("_g") == 2, "event").otherwise("host")
    return out.select("hostname", level.alias("level"), "pid", "event", "n")


def trace_counts(df: DataFrame, by: str = "event") -> DataFrame:
    """Events by type, task, or both, with their share of all events of the host."""
    keys = {"event": ["event"], "pid": ["pid"], "pid_event": ["pid", "event"]}[by]
    out = df.groupBy("hostname", *keys).agg(F.count("*").alias("n"))
    return out.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("hostname")))
