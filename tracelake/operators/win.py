"""The second event profile: the same operators over the events of another kernel.

Its events come as a table with hostname, hrtime, cpu, cpu_seqno, pid, event and the columns that
each operator names; they are brought to the shape of the trace table and go through the same code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import as_trace, family
from . import blockio, power, stacks, states, syscalls

SLEEPING = ("Waiting", "Terminated")
TCP_EVENTS = ["connect", "disconnect", "retransmit", "accept", "reconnect", "fail", "copy"]


def thread_trace(df: DataFrame) -> DataFrame:
    """Context switches (cswitch: old_tid, new_tid, old_state, wait_reason), ready events (ready: tid) and the stack record that follows a switch."""
    w = Window.partitionBy("hostname", "cpu").orderBy("hrtime", "cpu_seqno")
    d = df.withColumn("next_stack", F.when(F.lead("event").over(w) == "stack", F.lead("stack").over(w)))
    e = F.col("event")
    return as_trace(d.where("event in ('cswitch', 'ready')").select(
        "hostname", F.lit("win").alias("capture_id"), "hrtime", "cpu", "cpu_seqno", F.when(e == "cswitch", "sched_switch").otherwise("sched_wakeup").alias("event"),
        F.when(e == "cswitch", F.col("old_tid")).otherwise(F.col("pid")).alias("pid"), F.col("pid").alias("tgid"),
        F.when(e == "cswitch", family("sw", prev_state=F.when(F.col("old_state").isin(*SLEEPING), F.when(F.col("old_state") == "Terminated", 16).otherwise(1)).otherwise(0), next_pid=F.col("new_tid"), ips=F.col("next_stack"))).alias("sw"),
        F.when(e == "ready", family("wk", target_pid=F.col("tid"), success=F.lit(1), is_new=F.lit(False))).alias("wk"),
    ))


def task_state_intervals(df: DataFrame) -> DataFrame:
    """State intervals of threads; sleeps carry the reason of their wait."""
    iv = states.task_state_intervals(thread_trace(df))
    why = df.where("event = 'cswitch'").select("hostname", F.col("old_tid").alias("pid"), F.col("hrtime").alias("start"), F.col("cpu_seqno").alias("seqno"), F.col("wait_reason").alias("_why"))
    return iv.join(why, ["hostname", "pid", "start", "seqno"], "left").withColumn("wait_reason", F.when(F.col("state") == "SWTCH", F.col("_why"))).drop("_why")


def wait_reasons(intervals: DataFrame, by: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """Sleeps by function and reason."""
    s = stacks.sleeps(intervals)
    return s.groupBy(*by, "frame", "wait_reason").agg(F.count("*").alias("cnt"), F.sum("ns").alias("sleep_ns"), F.max("ns").alias("max_ns"))


def pair_syscalls_nested(df: DataFrame) -> DataFrame:
    """hostname, pid, address, enter, exit, elapsed, depth: calls nest, and an exit closes the innermost open one.

    Within a depth enters and exits alternate, so the exit at a depth closes the enter before it there. Exits without an open call are ignored: the depth is the
    running sum less its running minimum.
    """
    w = Window.partitionBy("hostname", "pid").orderBy("hrtime", "cpu_seqno").rowsBetween(Window.unboundedPreceding, 0)
    e = df.where("event in ('sys_enter', 'sys_exit')").withColumn("step", F.when(F.col("event") == "sys_enter", 1).otherwise(-1))
    e = e.withColumn("s", F.sum("step").over(w)).withColumn("level", F.col("s") - F.least(F.lit(0), F.min("s").over(w))).withColumn("depth", F.when(F.col("step") == 1, F.col("level")).otherwise(F.col("level") + 1))
    d = Window.partitionBy("hostname", "pid", "depth").orderBy("hrtime", "cpu_seqno")
    e = e.withColumn("open", F.lag(F.struct("step", "hrtime", "address")).over(d))
    return e.where("step = -1 and open.step = 1").select("hostname", "pid", F.col("open.address").alias("address"), F.col("open.hrtime").alias("enter"), F.col("hrtime").alias("exit"), (F.col("hrtime") - F.col("open.hrtime")).alias("elapsed"), "depth")


def spin_stats(df: DataFrame, by: str = "caller") -> DataFrame:
    """Spinlocks by caller, task or host: count, spins, cycles waited and held."""
    keys = {"caller": ["caller"], "pid": ["pid"], "global": []}[by]
    return df.where("event = 'spinlock'").groupBy("hostname", *keys).agg(F.count("*").alias("cnt"), F.sum("spins").alias("spins"), F.sum("wait_cycles").alias("wait_cycles"), F.sum("held_cycles").alias("held_cycles"))


def isr_dpc_stats(df: DataFrame, by: str = "irq") -> DataFrame:
    """Interrupt and deferred-call times, which the event itself carries."""
    pairs = df.where("event in ('isr', 'dpc')").select("hostname", "cpu", F.when(F.col("event") == "isr", "hard").otherwise("soft").alias("kind"), F.col("vector").alias("irq"), F.col("routine").alias("name"), F.col("duration").alias("time"))
    return power.irq_stats(pairs, by)


def profile_samples(df: DataFrame) -> DataFrame:
    """Profile samples (pc, user, dpc) in the shape of the other profile."""
    state = F.when(F.col("dpc"), "INTR").when(F.col("pid") == 0, "IDLE").when(F.col("user"), "USER").otherwise("SYS")
    return df.where("event = 'sample'").select("hostname", "cpu", "pid", "hrtime", state.alias("state"), "pc", F.array("pc").alias("stack"))


def disk_io(df: DataFrame, clock_hz: int) -> DataFrame:
    """Completions that carry their service time in ticks, as completed requests."""
    kind = F.when(F.col("event") == "disk_read", 0).when(F.col("event") == "disk_write", 1).otherwise(2)
    d = df.where("event in ('disk_read', 'disk_write', 'disk_flush')")
    serv = F.expr(f"response_ticks * 1000000000 div {clock_hz}")
    return d.select("hostname", "dev", "sector", F.lit(0).alias("req"), kind.alias("rw"), F.expr("bytes div 512").alias("nr_sectors"), (F.col("hrtime") - serv).alias("insert_ts"), (F.col("hrtime") - serv).alias("issue_ts"), F.col("hrtime").alias("complete_ts"),
                    F.lit(None).cast("long").alias("qtm"), serv.alias("svtm"), F.col("pid").alias("insert_pid"), F.col("pid").alias("issue_pid"), F.lit(0).cast("long").alias("requeues"), F.col("cpu_seqno").alias("seqno"), "cpu", F.lit(0).cast("long").alias("flags"), "file_object")


def io_stats(df: DataFrame, clock_hz: int, by: tuple[str, ...] = ("hostname", "dev")) -> DataFrame:
    return blockio.io_stats(disk_io(df, clock_hz), by)


def fileobj_stats(df: DataFrame) -> DataFrame:
    """Logical reads and writes of each file object and task, under the last name that the object was given before."""
    w = Window.partitionBy("hostname", "file_object").orderBy("hrtime", "cpu_seqno").rowsBetween(Window.unboundedPreceding, -1)
    e = df.where("event in ('file_read', 'file_write', 'file_name')").withColumn("name", F.last(F.when(F.col("event") == "file_name", F.col("file_name")), True).over(w)).where("event <> 'file_name'")
    rd = F.col("event") == "file_read"
    return e.groupBy("hostname", "pid", "file_object", "name").agg(F.count_if(rd).alias("reads"), F.sum(F.when(rd, F.col("bytes")).otherwise(0)).alias("rd_bytes"), F.count_if(~rd).alias("writes"), F.sum(F.when(~rd, F.col("bytes")).otherwise(0)).alias("wr_bytes"))


def net_flows(df: DataFrame) -> DataFrame:
    """Packets sent and received, every one of them, as network calls."""
    return df.where("event in ('send', 'recv')").select("hostname", "lip", "lport", "rip", "rport", F.when(F.col("event") == "recv", "rx").otherwise("tx").alias("dir"), "bytes", F.lit(0).alias("err"), "pid")


def net_stats(df: DataFrame) -> DataFrame:
    return syscalls.socket_stats(net_flows(df))


def tcp_events(df: DataFrame) -> DataFrame:
    """Connection events of each connection, one column a kind."""
    return df.where(F.col("event").isin(TCP_EVENTS)).groupBy("hostname", "lip", "lport", "rip", "rport").pivot("event", TCP_EVENTS).count().fillna(0, TCP_EVENTS)


def win_dims(df: DataFrame) -> dict[str, DataFrame]:
    """Process, image, service and disk tables from their events, the last of each key."""
    def last(event: str, keys: list[str], cols: list[str]) -> DataFrame:
        rows = df.where(F.col("event") == event).groupBy("hostname", *keys).agg(F.max_by(F.struct(*cols), F.struct("hrtime", "cpu_seqno")).alias("v"))
        return rows.select("hostname", *keys, "v.*")

    return {"processes": last("process", ["pid"], ["name", "parent"]), "images": last("image", ["pid", "base"], ["size", "name"]), "services": last("service", ["pid"], ["name"]), "disks": last("disk", ["dev"], ["name"])}


def in_images(df: DataFrame, images: DataFrame, page_bits: int = 20) -> DataFrame:
    """Addresses (pid, pc) with the image that holds them; images are cut into pages, so the range test runs within equal pages only."""
    i = images.select("hostname", "pid", "base", "size", F.col("name").alias("image"), F.explode(F.expr(f"sequence(shiftrightunsigned(base, {page_bits}), shiftrightunsigned(base + size - 1, {page_bits}))")).alias("page"))
    d = df.withColumn("page", F.expr(f"shiftrightunsigned(pc, {page_bits})")).join(i, ["hostname", "pid", "page"], "left")
    return d.withColumn("image", F.when((F.col("pc") >= F.col("base")) & (F.col("pc") < F.col("base") + F.col("size")), F.col("image"))).drop("page", "base", "size")
