"""Composite reports: named results of many operators over shared intermediate tables.

A report maps the names of its sections, in a fixed order, to DataFrames that are made when they are asked for. Points, intervals, calls and requests are
persisted once; whoever asks for a few sections computes only those. With ``stage`` the trace is read
once: one write puts it into the shared folder in parts by what reads them, and observes on the way how
many events each part has, so that sections without input are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import blockio, dims, graph, power, stacks, states, syscalls, topn, windows
from ..operators.filters import bounds
from ..streaming.drive import folder
from . import rules

#: Parts of a staged trace and the events of each; all others go to the part ``other``.
PARTS = {"sched": "sched_", "sys": "sys_", "blk": "block_", "hc": "hardclock", "irq": ("irq_", "softirq_"), "pwr": "power_", "pgc": "cache_"}
#: Sections of the host report by the beginnings of their names, and the part without which they are empty.
NEEDS = {"1.1.3": "pwr", "1.2": "sched", "1.4": "hc", "1.5": "sched", "1.6": "irq", "2.1": "sched", "2.2": "sched", "2.3": "sys", "3.": "sys", "4.1 ": "blk", "4.2": "blk", "4.3": "blk", "4.4": "blk", "4.5": "blk", "4.7": "blk", "4.8": "blk", "4.9": "blk", **{f"5 {level}": "sys" for level in syscalls.SOCKET_LEVELS}, "6.2": "sched", "6.3": "sched"}


def part_of(event) -> F.Column:
    """The part that an event belongs to."""
    out = F.lit("other")
    for name, heads in PARTS.items():
        tests = [event.startswith(h) for h in ((heads,) if isinstance(heads, str) else heads)]
        out = F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], name).otherwise(out)
    return out


def staged(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The trace written once to the shared folder with a column ``part``, and the number of events of each part as the write saw them. There is no shuffle; reading one part skips the files of the others."""
    seen, part = Observation(), F.col("part")
    path = folder(df.sparkSession, "trace")
    told = df.withColumn("part", part_of(F.col("event"))).observe(seen, *[F.count_if(part == p).alias(p) for p in (*PARTS, "other")])
    told.write.partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(told.schema).parquet(path), dict(seen.get)


class Sections(Mapping):
    """Names of sections and their DataFrames; a section's plan is made on the first access, so that one section of a report costs one plan."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


class Shared:
    """The tables that most sections read, each made once and spilled to disk where memory is short.

    ``counts`` holds the events of each part if the trace is staged, else nothing. A trace that tells the ``part`` of its events (as a staged one does) is read by parts, so
    that a source of other parts is not touched. ``once`` is for whoever asks for one section: calls, requests and intervals, which a section reads once, are not kept then.
    """

    def __init__(self, df: DataFrame, topology: DataFrame, stage: bool = False, once: bool = False):
        self.once = once
        self.kept: list[DataFrame] = []
        self.counts: dict[str, int] = {}
        if stage:
            df, self.counts = staged(df)
        self.df, self.topology = df, topology
        self.part = lambda *names: df.where(F.col("part").isin(*names)) if "part" in df.columns else df

    def kept_of(self, x: DataFrame) -> DataFrame:
        self.kept.append(x.persist(StorageLevel.MEMORY_AND_DISK))
        return self.kept[-1]

    def _read(self, x: DataFrame) -> DataFrame:
        return x if self.once else self.kept_of(x)

    @property
    def _of_tasks(self) -> DataFrame:
        return self.part("sched", "sys", "hc", "irq")

    @cached_property
    def span(self) -> DataFrame:
        return self.kept_of(bounds(self.df))

    @cached_property
    def points(self) -> DataFrame:
        """By task once: intervals, latencies and counts all go on from here without another shuffle."""
        return self.kept_of(states.task_points(self._of_tasks, measures=True).repartition("hostname", "pid"))

    @cached_property
    def intervals(self) -> DataFrame:
        return self._read(states.task_state_intervals(self._of_tasks, points=self.points, span=self.span))

    @cached_property
    def calls(self) -> DataFrame:
        return self._read(syscalls.pair_syscalls(self.part("sys")))

    @cached_property
    def io(self) -> DataFrame:
        return self._read(blockio.pair_block_io(self.part("blk")))

    @cached_property
    def latencies(self) -> DataFrame:
        return states.runq_latency(self._of_tasks, self.topology, points=self.points)

    @cached_property
    def tasks(self) -> DataFrame:
        return states.task_cpu(self._of_tasks, self.intervals, self.points)

    @cached_property
    def cpus(self) -> DataFrame:
        return states.cpu_time(self.part("sched"), self.topology, self.intervals, self.span)

    @cached_property
    def samples(self) -> DataFrame:
        return stacks.profile_samples(self.part("hc"))

    @cached_property
    def slept(self) -> DataFrame:
        return stacks.sleeps(self.intervals)

    @cached_property
    def bound(self) -> DataFrame:
        return syscalls.bind_fd(self.calls)

    @cached_property
    def devices(self) -> DataFrame:
        return blockio.io_stats(self.io)

    @cached_property
    def task_io(self) -> DataFrame:
        return blockio.io_stats(self.io.withColumnRenamed("issue_pid", "pid"), ("hostname", "pid"))

    @cached_property
    def flows(self) -> DataFrame:
        return syscalls.socket_calls(self.bound)

    @cached_property
    def socks(self) -> DataFrame:
        return syscalls.socket_stats(self.flows)

    @cached_property
    def files(self) -> DataFrame:
        return syscalls.file_stats(self.bound)

    @cached_property
    def irqs(self) -> DataFrame:
        return power.pair_irq(self.part("irq"))

    @cached_property
    def futexes(self) -> DataFrame:
        """With wakers, who may be in any event of the scheduler."""
        return syscalls.futex_stats(syscalls.futex_wakers(syscalls.futex_calls(self.calls), self.part("sched")))

    @cached_property
    def edges(self) -> DataFrame:
        return graph.wakeup_edges(graph.wakeups(self.part("sched", "sys"), self.intervals))

    def filled(self, sections: dict[str, Callable[[], DataFrame]]) -> Sections:
        """Without the sections whose part of the trace is known to be empty."""
        gone = {p for p, n in self.counts.items() if n == 0}
        return Sections({k: v for k, v in sections.items() if not any(k.startswith(head) and p in gone for head, p in NEEDS.items())})

    def release(self) -> None:
        for x in self.kept:
            x.unpersist()


def host_report(df: DataFrame, topology: DataFrame, symbols: DataFrame | None = None, facts: DataFrame | None = None, devices: DataFrame | None = None, containers: DataFrame | None = None, processes: DataFrame | None = None, seconds: float | None = None, n: int = 20, shared: Shared | None = None) -> Sections:
    """The sections of a host report by number; those whose dimension is not given are left out."""
    s = shared or Shared(df, topology)
    df = s.df
    out = {
        "1.1 global CPU": lambda: states.global_cpu_time(s.cpus), "1.1.1 per CPU": lambda: s.cpus, "1.1.2 per node": lambda: states.node_cpu_time(s.cpus).where("ldom is not null"), "1.1.3 power": lambda: power.power_stats(s.part("pwr"), s.span), "1.1.4 hyper-threads": lambda: states.ht_usage(df, topology),
        "1.2.1 tasks by run time": lambda: topn.top_tasks(s.tasks, "runtime", n), "1.2.2 tasks by system time": lambda: topn.top_tasks(s.tasks, "systime", n), "1.2.3 tasks by steal time": lambda: topn.top_tasks(s.tasks, "stealtime", n),
        "1.3.1 event types": lambda: states.trace_counts(df), "1.3.2 tasks by events": lambda: topn.top_tasks(states.trace_counts(df, "pid"), "records", n), "1.3.3 event types per task": lambda: topn.top_n_per(states.trace_counts(df, "pid_event"), ["hostname", "pid"], "n", 10, ["event"]),
        "1.4.1 profile states": lambda: stacks.profile_states(s.samples, ("hostname",)), "1.4.2 profile by CPU": lambda: stacks.profile_states(s.samples), "1.4.4 profile stacks": lambda: topn.page(stacks.profile_stacks(s.samples), "hits", n, tie=["hostname", "state"]),
        "1.5 thundering herd": lambda: topn.page(states.wakeup_streaks(s.part("sched", "sys")), "max_wakeups", n, tie=["hostname", "pid"]),
        "1.6.1 hard IRQ": lambda: power.irq_stats(s.irqs).where("kind = 'hard'"), "1.6.2 hard IRQ by CPU": lambda: power.irq_stats(s.irqs, "cpu_irq").where("kind = 'hard'"), "1.6.3 soft IRQ": lambda: power.irq_stats(s.irqs).where("kind = 'soft'"),
        "2.1.1 wait functions": lambda: stacks.sleep_funcs(s.slept, ("hostname",)), "2.1.2 wait stacks": lambda: topn.page(stacks.stack_stats(s.slept), "sleep_ns", n, tie=["hostname"]), "2.1.3 tasks by sleeps": lambda: topn.top_tasks(s.tasks, "sleeps", n),
        "2.1.4 wait functions by task": lambda: topn.top_n_per(stacks.sleep_funcs(s.slept), ["hostname", "pid"], "sleep_ns", 5, ["frame"]),
        "2.2.1 run-queue histogram": lambda: states.runq_hist(s.latencies), "2.2.2 run-queue statistics": lambda: states.runq_stats(s.latencies, "cpu"), "2.2.3 tasks by run-queue time": lambda: topn.top_tasks(s.tasks, "runqtime", n),
        "2.3.1 futex by count": lambda: topn.top_futexes(s.futexes, "count", n), "2.3.2 futex by time": lambda: topn.top_futexes(s.futexes, "time", n),
        "3.1 files by calls": lambda: topn.top_files(s.files, "syscalls", n), "3.2 files by time": lambda: topn.top_files(s.files, "elapsed", n), "3.3 files by errors": lambda: topn.top_files(s.files.where("errs > 0"), "errors", n), "3.4 file detail": lambda: topn.top_n_per(s.bound.groupBy("hostname", "dev", "node", "syscallno").agg(F.count("*").alias("cnt"), F.sum("elapsed").alias("elapsed_ns")), ["hostname", "dev", "node"], "cnt", 5, ["syscallno"]),
        "4.1 global I/O": lambda: blockio.io_stats(s.io, ("hostname",), wide=True), "4.2.1 busiest disks": lambda: topn.top_devices(s.devices, "count", n), "4.2.4 wait time": lambda: topn.top_devices(s.devices, "avwait", n), "4.2.5 requeues": lambda: topn.top_devices(s.devices.where("requeues > 0"), "requeue", n), "4.2.6 I/O histogram": lambda: blockio.io_hist(s.io, by=("hostname",)),
        "4.7 tasks by physical I/O": lambda: topn.top_tasks(s.task_io.where("rw is null"), "iocnt", n), "4.8 block re-reads": lambda: blockio.hot_blocks(s.io).where("rw = 0"), "4.9 block re-writes": lambda: blockio.hot_blocks(s.io).where("rw = 1"),
        **{f"5 {level}": lambda level=level: topn.top_sockets(s.socks, "syscalls", n, level) for level in syscalls.SOCKET_LEVELS},
        "6.2 resident size": lambda: topn.page(states.mem_top(s.part("sched"), "rss"), "rss", n, tie=["hostname", "pid"]), "6.3 virtual size": lambda: topn.page(states.mem_top(s.part("sched"), "vss"), "vss", n, tie=["hostname", "pid"]),
    }
    if seconds:
        out["4.2.2 service time, io/s >= 5"] = lambda: topn.top_devices(s.devices, "avserv", n, True, seconds)
        out["4.2.3 service time, io/s <= 5"] = lambda: topn.top_devices(s.devices, "avserv", n, False, seconds)
    if symbols is not None:
        funcs = stacks.symbolize(s.samples, symbols, "pc")
        out["1.4.3 kernel functions"] = lambda: stacks.profile_funcs(funcs)
        out["1.4.5 functions by task"] = lambda: topn.top_n_per(stacks.profile_funcs(funcs, ("hostname", "pid")), ["hostname", "pid"], "hits", 5, ["func"])
    if devices is not None:
        for k, level in (("4.3.1 mapper devices", "mapper"), ("4.4 HBA totals", "hba"), ("4.5 WWN totals", "wwn")):
            out[k] = lambda level=level: blockio.io_rollup(s.devices, devices, level)
        out["4.3.2 mapper by service time"] = lambda: topn.page(out["4.3.1 mapper devices"]().where("rw is null"), "avserv_ms", n, tie=["hostname", "mapname"])
    if facts is not None:
        out["4.10 I/O controllers"] = lambda: facts.where("kind = 'controller'")
        out["5.7 retransmits and timeouts"] = lambda: facts.where("kind = 'tcp'")
        out["6.1 memory per node"] = lambda: facts.where("kind like 'node_%'")
    if processes is not None:
        roles = stacks.ora_roles(s.tasks, processes, s.task_io)
        out["7.1 database SIDs"] = lambda: roles.groupBy("hostname", "sid").agg(F.sum("tasks").alias("tasks"), F.sum("run_ns").alias("run_ns"), F.sum("ios").alias("ios"))
        for k, role in enumerate(("lgwr", "arch", "dbw", "pquery", "shared_server", "ioslave"), 2):
            out[f"7.{k} {role}"] = lambda role=role: roles.where(F.col("role") == role)
    if containers is not None:
        c = dims.container_stats(s.tasks.withColumn("tgid", F.col("pid")), containers, s.task_io)
        out["8.1 containers"] = lambda: containers
        out["8.2 container CPU"] = lambda: topn.top_containers(c, "run_ns", n)
        out["8.3 container I/O"] = lambda: topn.top_containers(c, "ios", n)
    out["10 findings"] = lambda: host_findings(s, facts, devices, seconds)
    return s.filled(out)


def host_findings(s: Shared, facts: DataFrame | None = None, devices: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    # Two rules read the requests: if nobody else does, no more is kept of them than both take.
    io = s.kept_of(s.io.select(*blockio.STATED)) if s.once else s.io
    parts = [
        rules.rules_cpu(states.global_cpu_time(s.cpus), power.power_stats(s.part("pwr"), s.span)), rules.rules_runq(states.runq_stats(s.latencies)), rules.rules_disk(blockio.io_stats(io), blockio.hot_blocks(io), devices, facts),
        rules.rules_syscall(syscalls.syscall_stats(s.calls)), rules.rules_irq(power.irq_stats(s.irqs), seconds or 1.0),
    ]
    if facts is not None:
        parts.append(rules.rules_host(facts))
    return rules.findings(*parts)


def all_reports(df: DataFrame, topology: DataFrame, n: int = 20, containers: DataFrame | None = None, every_ms: int = 100, shared: Shared | None = None) -> Sections:
    """Task, disk, file, socket, profile, run-queue, wait, futex, timeline, event and container results from one reading of the trace. Run-queue and event results have all levels, each from one aggregate."""
    s = shared or Shared(df, topology, stage=True)
    out = {
        "task": lambda: s.tasks, "disk": lambda: s.devices, "file": lambda: s.files, "socket": lambda: s.socks, "profile": lambda: stacks.profile_states(s.samples), "runq": lambda: states.runq_stats(s.latencies, "pid_cpu"),
        "wait": lambda: stacks.sleep_funcs(s.slept), "futex": lambda: syscalls.futex_stats(syscalls.futex_calls(s.calls)), "timeline": lambda: windows.timeline(s.df, s.intervals, every_ms, latencies=s.latencies, span=s.span),
        "run-queue levels": lambda: states.runq_levels(s.latencies), "event levels": lambda: states.count_levels(s.df), "syscall": lambda: syscalls.syscall_stats(s.calls),
    }
    if containers is not None:
        out["container"] = lambda: dims.container_stats(s.tasks.withColumn("tgid", F.col("pid")), containers, s.task_io)
    return Sections(out)


def task_report(df: DataFrame, topology: DataFrame, pid: int, shared: Shared | None = None) -> Sections:
    """One task: scheduler, counters, latencies, waits, wakers and wakees, profile, calls, descriptors, page cache, I/O, futexes, memory."""
    s = shared or Shared(df, topology)
    one = lambda d, c="pid": d.where(F.col(c) == pid)
    df = s.df
    return Sections({
        "scheduler activity": lambda: one(s.tasks), "CPU counters": lambda: one(states.msr_stats(df)), "run-queue latency": lambda: one(states.runq_stats(s.latencies)), "run-queue histogram": lambda: one(states.runq_hist(s.latencies, "pid")), "sleep functions": lambda: one(stacks.sleep_funcs(s.slept)),
        "sleep stacks": lambda: one(stacks.stack_stats(s.slept, ("hostname", "pid"))), "wakers": lambda: graph.coop_tree(one(s.edges, "sleeper")), "wakees": lambda: graph.coop_tree(one(s.edges, "waker"), "waker"), "profile": lambda: stacks.profile_states(one(s.samples), ("hostname", "pid")),
        "syscalls": lambda: one(syscalls.syscall_stats(s.calls)), "syscall times": lambda: one(states.syscall_breakdown(s.intervals)), "ioctl": lambda: one(syscalls.ioctl_stats(s.calls)), "file descriptors": lambda: syscalls.file_stats(one(s.bound), "fd"), "page cache": lambda: one(syscalls.pgcache_stats(df, "pid")),
        "physical I/O": lambda: blockio.io_stats(one(s.io, "issue_pid")), "futex": lambda: syscalls.futex_stats(one(syscalls.futex_calls(s.calls)), "addr_pid"), "memory": lambda: one(states.mem_top(s.part("sched"))),
    })


def cluster_report(df: DataFrame, topology: DataFrame, local_ips: DataFrame | None = None, n: int = 20, shared: Shared | None = None) -> Sections:
    """All hosts: a row for each server, and the first tasks, devices, functions, sockets and futexes over all of them."""
    s = shared or Shared(df, topology)
    df = s.df
    hosts = states.global_cpu_time(s.cpus)
    out = {
        "per-server summary": lambda: hosts, "servers by run time": lambda: topn.top_cluster(hosts, "busy_ns", n), "servers by system time": lambda: topn.top_cluster(hosts, "sys_ns", n), "power": lambda: power.power_stats(s.part("pwr"), s.span), "hyper-threads": lambda: states.ht_usage(df, topology),
        "tasks by run time": lambda: topn.top_cluster(s.tasks, "run_ns", n, ["hostname", "pid"]), "tasks by system time": lambda: topn.top_cluster(s.tasks, "sys_ns", n, ["hostname", "pid"]), "tasks by switches": lambda: topn.top_cluster(s.tasks, "switches", n, ["hostname", "pid"]),
        "profile states": lambda: stacks.profile_states(s.samples, ("hostname",)), "thundering herd": lambda: topn.top_cluster(states.wakeup_streaks(s.part("sched", "sys")), "max_wakeups", n, ["hostname", "pid"]), "wait functions by task": lambda: topn.top_cluster(stacks.sleep_funcs(s.slept), "sleep_ns", n, ["hostname", "pid", "frame"]),
        "run-queue statistics": lambda: states.runq_stats(s.latencies, "host"), "tasks by run-queue time": lambda: topn.top_cluster(s.tasks, "runq_ns", n, ["hostname", "pid"]), "futexes": lambda: topn.top_cluster(syscalls.futex_stats(syscalls.futex_calls(s.calls)), "cnt", n, ["hostname", "space", "addr"]),
        "devices": lambda: topn.top_cluster(s.devices.where("rw is null"), "ios", n, ["hostname", "dev"]), "global I/O": lambda: blockio.io_stats(s.io, ("hostname",), wide=True), "files": lambda: topn.top_cluster(s.files, "syscalls", n, ["hostname", "dev", "node"]),
        "IP pairs": lambda: topn.top_sockets(s.socks, "syscalls", n, "ip_pair"), "sockets": lambda: topn.top_sockets(s.socks, "syscalls", n), "findings": lambda: host_findings(s),
    }
    if local_ips is not None:
        out["flows"] = lambda: dims.flows_with_hosts(s.flows, local_ips).groupBy("hostname", "dest").agg(F.count_if(F.col("dir") == "rx").alias("rx"), F.sum(F.when(F.col("dir") == "rx", F.col("bytes"))).alias("rx_bytes"), F.count_if(F.col("dir") == "tx").alias("tx"), F.sum(F.when(F.col("dir") == "tx", F.col("bytes"))).alias("tx_bytes"))
    return Sections(out)


def io_scatter(io: DataFrame, limit: int = 20_000) -> DataFrame:
    """The first requests of a capture for a chart: time, device, rw, sector, length, pids, queue and service time."""
    return io.select("hostname", F.col("issue_ts").alias("time"), F.col("dev").alias("device"), "rw", "sector", F.col("nr_sectors").alias("length"), F.col("insert_pid").alias("qpid"), F.col("issue_pid").alias("spid"), F.col("qtm").alias("qtime"), F.col("svtm").alias("svctime")).orderBy("time", "hostname", "device", "sector", "length", "spid").limit(limit)


def futex_scatter(futexes: DataFrame, limit: int = 20_000) -> DataFrame:
    return futexes.select("hostname", F.col("exit").alias("time"), "cpu", "pid", F.col("ret").alias("retval"), F.col("elapsed").alias("sctime"), "addr", "op", F.get("args", F.lit(2)).alias("val")).orderBy("time", "cpu", "pid").limit(limit)


def task_switches(df: DataFrame, pid: int) -> DataFrame:
    """Switches and wakeups of one task in order."""
    p = states.task_points(df.where((F.col("pid") == pid) | (F.col("sw.next_pid") == pid) | (F.col("wk.target_pid") == pid))).where(F.col("pid") == pid)
    return p.where("kind in ('in', 'out', 'wake')").select("hostname", "hrtime", "cpu", "kind", "waker").orderBy("hrtime", "cpu")
