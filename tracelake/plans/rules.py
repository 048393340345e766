"""Findings: thresholds over the results of the operators. All limits are parameters, with their usual values (fixed values)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES = {
    "cpu_bottleneck": ("high", "CPUs are idle less than 10 % of the time"), "cpu_steal": ("high", "another guest takes 10 % or more of the CPU"), "power_saving": ("info", "deep idle states are in use"),
    "runq_delay": ("medium", "a task waited more than 100 ms for a CPU"), "disk_service": ("high", "mean service time of a device is above 30 ms"), "disk_barriers": ("medium", "more than 20 write barriers"),
    "disk_requeues": ("medium", "requests were requeued"), "block_rereads": ("medium", "blocks are read again and again"), "multipath_policy": ("medium", "round-robin multipath on a kernel that suffers from it"), "io_controller": ("info", "large requests on a controller that splits them"),
    "tasklets": ("high", "tasklets take more than half a core"), "block_softirq": ("high", "block interrupts take more than a core"), "semget_errors": ("medium", "many failed semget calls"), "short_polls": ("medium", "many polls of less than 2 us"),
    "numa_off": ("high", "NUMA is switched off"), "clocksource": ("high", "the clock source is not tsc"), "mitigations": ("info", "CPU mitigations are on"), "node_memory": ("medium", "memory is not spread evenly over nodes"), "node_free": ("high", "a node has less than 100 MB of free memory"), "tcp_timeouts": ("high", "TCP timeouts occurred"),
    "hot_function": ("medium", "a function takes a large share of the profile"), "hot_stack": ("medium", "a known call path takes time"),
}
#: Function (pattern), least share in percent, least hits, code.
HOT_FUNCTIONS = [("semtimedop%", 2.0, 0, "hot_function"), ("semctl%", 2.0, 0, "hot_function"), ("sk_busy_loop%", 0.5, 0, "hot_function"), ("%spin_lock%", 2.0, 0, "hot_function"), ("alloc_pages%", 1.0, 0, "hot_function"), ("free_pages%", 1.0, 0, "hot_function"), ("start_this_handle%", 0.0, 100, "hot_function")]
#: Marker frames of which two or more must be in one stack, least hits, code.
HOT_STACKS = [(["hugetlb_fault", "huge_pmd_share", "hugetlb_no_page"], 1, "hot_stack"), (["semtimedop", "sem_lock", "try_atomic_semop"], 1, "hot_stack"), (["kstat_irqs", "show_stat", "seq_read"], 1, "hot_stack"), (["migrate_pages", "migrate_misplaced_page", "numa_migrate_prep"], 1, "hot_stack"), (["xfs_file_dio_aio_read", "xfs_ilock", "down_read"], 500, "hot_stack")]


def finding(df: DataFrame, code: str, evidence) -> DataFrame:
    return df.select("hostname", F.lit(code).alias("code"), evidence.cast("string").alias("evidence"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def rules_cpu(hosts: DataFrame, power: DataFrame | None = None, idle_pct: float = 10.0, steal_pct: float = 10.0) -> DataFrame:
    """From CPU times per host (global_cpu_time) and power statistics."""
    idle, steal = 100.0 * F.col("idle_ns") / F.col("total_ns"), 100.0 * F.col("steal_ns") / F.col("total_ns")
    parts = [finding(hosts.where(idle < idle_pct), "cpu_bottleneck", F.round(idle, 2)), finding(hosts.where(steal >= steal_pct), "cpu_steal", F.round(steal, 2))]
    if power is not None:
        parts.append(finding(power.where("cstate > 1 and ns > 0"), "power_saving", F.col("cstate")))
    return _union(parts)


def rules_runq(stats: DataFrame, max_us: int = 100_000) -> DataFrame:
    return finding(stats.where(F.col("max_us") > max_us), "runq_delay", F.col("pid"))


def rules_disk(stats: DataFrame, hot: DataFrame | None = None, devices: DataFrame | None = None, facts: DataFrame | None = None, serv_ms: float = 30.0, barriers: int = 20, rereads: int = 50, kernels: tuple[str, ...] = ("2.6.32",), controllers: tuple[str, ...] = ("hpsa",)) -> DataFrame:
    """From device statistics, blocks read again, the device table and host facts."""
    total = stats.where("rw is null")
    parts = [finding(total.where(F.col("avserv_ms") > serv_ms), "disk_service", F.col("dev")), finding(total.where(F.col("barriers") > barriers), "disk_barriers", F.col("dev")), finding(total.where("requeues > 0"), "disk_requeues", F.col("dev"))]
    if hot is not None:
        parts.append(finding(hot.where((F.col("rw") == 0) & (F.col("n") > rereads)), "block_rereads", F.col("dev")))
    if facts is not None:
        if devices is not None:
            old = facts.where("key = 'kernel'").where(reduce(lambda a, b: a | b, [F.col("value").startswith(k) for k in kernels])).select("hostname")
            parts.append(finding(devices.where("mp_policy like 'round-robin%'").join(old, "hostname", "left_semi"), "multipath_policy", F.col("dev")))
        parts.append(finding(facts.where(F.col("kind") == "controller").where(F.col("key").isin(list(controllers)) & (F.expr("try_cast(value as bigint)") > 1 << 20)), "io_controller", F.col("key")))
    return _union(parts)


def rules_irq(stats: DataFrame, seconds: float) -> DataFrame:
    """From soft interrupts by name over a capture of so many seconds."""
    cores = F.col("time_ns") / 1e9 / seconds
    return _union([finding(stats.where((F.col("name") == "TASKLET") & (F.col("cnt") > 100_000) & (cores > 0.5)), "tasklets", F.round(cores, 2)), finding(stats.where((F.col("name") == "BLOCK") & (F.col("cnt") > 10_000) & (cores > 1)), "block_softirq", F.round(cores, 2))])


def rules_profile(funcs: DataFrame, rules: list = HOT_FUNCTIONS) -> DataFrame:
    """From the profile by function: a few rules, each a pattern with its limits."""
    test, code = F.lit(False), F.lit(None).cast("string")
    for pattern, pct, hits, name in rules:
        one = F.col("func").like(pattern) & (F.col("pct") > pct) & (F.col("hits") > hits)
        test, code = test | one, F.when(one, name).otherwise(code)
    return funcs.where(test).select("hostname", code.alias("code"), F.col("func").alias("evidence"))


def rules_stack(stack_counts: DataFrame, count: str = "hits", rules: list = HOT_STACKS) -> DataFrame:
    """From symbolised stacks: two or more marker frames of a rule in one stack."""
    parts = []
    for markers, least, code in rules:
        both = F.size(F.array_intersect("stack", F.array(*[F.lit(m) for m in markers]))) >= 2
        parts.append(finding(stack_counts.where(both & (F.col(count) >= least)), code, F.lit(markers[0])))
    return _union(parts)


def rules_syscall(stats: DataFrame, semget: int = 64, poll: int = 7) -> DataFrame:
    return _union([finding(stats.where((F.col("syscallno") == semget) & (F.col("errs") > 100)), "semget_errors", F.col("errs")), finding(stats.where((F.col("syscallno") == poll) & (F.col("cnt") > 10_000) & (F.col("elapsed_ns") / F.col("cnt") < 2000)), "short_polls", F.col("cnt"))])


def rules_host(facts: DataFrame) -> DataFrame:
    """From host facts (kind, key, value)."""
    num = F.expr("try_cast(value as double)")
    mem = facts.where("kind = 'node_total_mb'").groupBy("hostname").agg(F.min(num).alias("lo"), F.max(num).alias("hi"))
    return _union([
        finding(facts.where("key = 'cmdline' and value like '%numa=off%'"), "numa_off", F.col("value")), finding(facts.where("key = 'clocksource' and value <> 'tsc'"), "clocksource", F.col("value")),
        finding(facts.where("kind = 'mitigation' and value like 'Mitigation%'"), "mitigations", F.col("key")), finding(mem.where("lo < 0.95 * hi"), "node_memory", F.col("lo")),
        finding(facts.where("kind = 'node_free_mb'").where(num < 100), "node_free", F.col("key")), finding(facts.where("key = 'TCPTimeouts'").where(num > 0), "tcp_timeouts", F.col("value")),
    ])


def findings(*rules: DataFrame) -> DataFrame:
    """One row for each host and code with severity, message and the least piece of evidence."""
    found = _union(list(rules)).groupBy("hostname", "code").agg(F.min("evidence").alias("evidence"), F.count("*").alias("n"))
    severity = F.create_map(*[F.lit(x) for k, v in MESSAGES.items() for x in (k, v[0])])
    message = F.create_map(*[F.lit(x) for k, v in MESSAGES.items() for x in (k, v[1])])
    return found.select("hostname", "code", F.try_element_at(severity, F.col("code")).alias("severity"), F.try_element_at(message, F.col("code")).alias("message"), "evidence", "n")
