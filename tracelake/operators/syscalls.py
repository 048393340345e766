"""System calls: pairing, statistics, asynchronous I/O, files, sockets and futexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hot import Scan, parted

#: Numbers of calls that move data, by direction (fixed values, 64-bit).
READS = {0: "read", 17: "pread64", 19: "readv", 45: "recvfrom", 47: "recvmsg", 295: "preadv"}
WRITES = {1: "write", 18: "pwrite64", 20: "writev", 44: "sendto", 46: "sendmsg", 296: "pwritev"}
OPENS = {2: "open", 257: "openat"}
LSEEK, IOCTL, FUTEX, IO_SETUP, IO_SUBMIT, IO_GETEVENTS, CLONE, FORK, VFORK, EXECVE = 8, 16, 202, 206, 209, 208, 56, 57, 58, 59
CLONE_THREAD = 0x10000
EAGAIN, ETIMEDOUT, EBADF = -11, -110, -9
FUTEX_PRIVATE = 128
#: Operations of asynchronous I/O: plain and vectored reads and writes (fixed values).
AIO_PLAIN, AIO_READ, AIO_WRITE = [0, 1], [0, 7], [1, 8]


def is_err(ret):
    return ret.between(-4095, -1)


def pair_syscalls(df: DataFrame, gaps: DataFrame | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """hostname, pid, tgid, cpu, syscallno, is32bit, enter, exit, elapsed, ret, args and what the exit tells of file and addresses.

    An exit closes the task's last enter if it has the same number (or -1); another one is dropped and leaves the call open; a later
    enter replaces it. Gaps of a CPU drop the calls that are open on it. ``cuts`` are those of hot tasks (``states.hot_tasks``).
    """
    e = df.where("event in ('sys_enter', 'sys_exit')").select("hostname", "pid", "tgid", "cpu", "hrtime", "cpu_seqno", "event", "sys")
    open_ = F.when(F.col("event") == "sys_enter", F.struct("hrtime", "cpu", "cpu_seqno", "sys"))

    def work(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
        scan = Scan(("hostname", "pid"), ("hrtime", "cpu", "cpu_seqno"), cuts)
        return scan.bare(scan.last(scan.sliced(rows), {"open": open_}))

    x = parted(e, cuts, work).where("event = 'sys_exit' and open is not null and (sys.syscallno = open.sys.syscallno or sys.syscallno = -1)")
    once = Window.partitionBy("hostname", "pid", "open.hrtime", "open.cpu", "open.cpu_seqno").orderBy("hrtime", "cpu", "cpu_seqno")
    x = x.withColumn("k", F.row_number().over(once)).where("k = 1")
    out = x.select(
        "hostname", "pid", "tgid", "cpu", F.col("open.sys.syscallno").alias("syscallno"), F.coalesce("open.sys.is32bit", F.lit(0)).alias("is32bit"), F.col("open.hrtime").alias("enter"), F.col("hrtime").alias("exit"),
        (F.col("hrtime") - F.col("open.hrtime")).alias("elapsed"), F.col("sys.ret").alias("ret"), F.col("open.sys.args").alias("args"), F.col("open.sys.filename").alias("filename"), F.col("open.sys.iocbs").alias("iocbs"),
        F.col("sys.io_events").alias("io_events"), F.col("sys.dev").alias("dev"), F.col("sys.inode").alias("inode"), "sys.laddr", "sys.lport", "sys.raddr", "sys.rport", F.col("cpu_seqno").alias("seqno"),
    )
    if gaps is None:
        return out
    g = gaps.select("hostname", "cpu", F.col("end").alias("g"))
    lost = out.join(g, ["hostname", "cpu"]).where("enter < g and g <= exit").select("hostname", "pid", "enter", "seqno").distinct()
    return out.join(lost, ["hostname", "pid", "enter", "seqno"], "left_anti")


_KEYS = {"pid": ["hostname", "pid", "is32bit", "syscallno"], "host": ["hostname", "is32bit", "syscallno"], "pid_all": ["hostname", "pid"]}


def moved_bytes():
    """Bytes that a call moved: its result, for calls that move data."""
    return F.when(F.col("syscallno").isin([*READS, *WRITES]) & (F.col("ret") > 0), F.col("ret")).otherwise(0)


def syscall_stats(calls: DataFrame, by: str = "pid", seconds: float | None = None) -> DataFrame:
    """Count, elapsed, mean, longest, errors, bytes and mean size of calls."""
    out = calls.groupBy(*_KEYS[by]).agg(
        F.count("*").alias("cnt"), F.sum("elapsed").alias("elapsed_ns"), F.expr("sum(elapsed) div count(*)").alias("avg_ns"), F.max("elapsed").alias("max_ns"), F.count_if(is_err(F.col("ret"))).alias("errs"), F.sum(moved_bytes()).alias("bytes"),
    ).withColumn("avsz", F.expr("bytes div cnt"))
    return out.withColumns({"rate": F.col("cnt") / seconds, "kb_s": F.col("bytes") / 1024 / seconds}) if seconds else out


def ioctl_stats(calls: DataFrame, number: int = IOCTL) -> DataFrame:
    """ioctl calls of each descriptor and request."""
    return calls.where(F.col("syscallno") == number).groupBy("hostname", "pid", F.get("args", F.lit(0)).alias("fd"), F.get("args", F.lit(1)).alias("request")).agg(F.count("*").alias("cnt"), F.sum("elapsed").alias("elapsed_ns"), F.max("elapsed").alias("max_ns"), F.count_if(is_err(F.col("ret"))).alias("errs"))


def pair_aio(calls: DataFrame) -> DataFrame:
    """hostname, ctx, iocb, pid, fd, op, bytes, elapsed: a submitted operation with the first completion after it on the same context and block."""
    sub = calls.where(F.col("syscallno") == IO_SUBMIT).select("hostname", F.get("args", F.lit(0)).alias("ctx"), "pid", F.col("enter").alias("t"), F.explode("iocbs").alias("b"))
    sub = sub.select("hostname", "ctx", F.col("b.iocb").alias("iocb"), "t", F.lit(0).alias("done"), "pid", F.col("b.fd").alias("fd"), F.col("b.op").alias("op"), F.col("b.nbytes").alias("n"))
    got = calls.where(F.col("syscallno") == IO_GETEVENTS).select("hostname", F.get("args", F.lit(0)).alias("ctx"), F.col("exit").alias("t"), F.explode("io_events").alias("e"))
    got = got.select("hostname", "ctx", F.col("e.obj").alias("iocb"), "t", F.lit(1).alias("done"), F.col("e.res").alias("n"))
    w = Window.partitionBy("hostname", "ctx", "iocb").orderBy("t", "done")
    both = sub.unionByName(got, allowMissingColumns=True).withColumn("s", F.last(F.when(F.col("done") == 0, F.struct("t", "pid", "fd", "op", "n")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("again", F.lag("done").over(w))
    met = both.where("done = 1 and s is not null and again = 0")
    return met.where(~F.col("s.op").isin(AIO_PLAIN) | (F.col("s.n") == F.col("n"))).select("hostname", "ctx", "iocb", "s.pid", "s.fd", "s.op", F.col("n").alias("bytes"), (F.col("t") - F.col("s.t")).alias("elapsed"))


def aio_stats(aio: DataFrame, by: tuple[str, ...] = ("hostname", "pid")) -> DataFrame:
    """Asynchronous reads and writes: count, bytes, time and longest."""
    pick = lambda ops, c: F.when(F.col("op").isin(ops), F.col(c))
    cols = [f(pick(ops, c)).alias(n) for n, ops, f, c in (
        ("rd_cnt", AIO_READ, F.count, "elapsed"), ("rd_bytes", AIO_READ, F.sum, "bytes"), ("rd_ns", AIO_READ, F.sum, "elapsed"), ("rd_max", AIO_READ, F.max, "elapsed"),
        ("wr_cnt", AIO_WRITE, F.count, "elapsed"), ("wr_bytes", AIO_WRITE, F.sum, "bytes"), ("wr_ns", AIO_WRITE, F.sum, "elapsed"), ("wr_max", AIO_WRITE, F.max, "elapsed"))]
    return aio.groupBy(*by).agg(*cols).fillna(0)


def bind_fd(calls: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Calls with the file or socket that their descriptor (first argument) is bound to: the last binding of the process seen before or at the call, or a snapshot's.

    Descriptors from 0 to 65535; calls that fail with EBADF are left out.
    """
    fd = F.get("args", F.lit(0))
    c = calls.where((fd >= 0) & (fd < 65536) & ~F.coalesce(F.col("ret") == EBADF, F.lit(False))).withColumn("fd", fd)
    bound = F.when(F.col("dev").isNotNull() | F.col("laddr").isNotNull(), F.struct("dev", F.col("inode").alias("node"), "laddr", "lport", "raddr", "rport", F.col("filename").alias("fname")))
    c = c.withColumn("binding", bound).withColumn("is_call", F.lit(True))
    if snapshot is not None:
        s = snapshot.select("hostname", F.coalesce("tgid", "pid").alias("tgid"), "fd", F.struct("dev", "node", "laddr", "lport", "raddr", "rport", "fname").cast(c.schema["binding"].dataType).alias("binding"), F.lit(-(1 << 62)).alias("exit"), F.lit(False).alias("is_call"))
        c = c.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("hostname", "tgid", "fd").orderBy("exit", "seqno").rowsBetween(Window.unboundedPreceding, 0)
    out = c.withColumn("b", F.last("binding", True).over(w)).where("is_call").drop("binding", "is_call", "dev", "laddr", "lport", "raddr", "rport", "inode")
    return out.select("*", "b.*").drop("b")


_FILE_KEYS = {"fd": ["hostname", "tgid", "fd"], "file": ["hostname", "dev", "node"], "pid": ["hostname", "pid"]}


def file_stats(bound: DataFrame, by: str = "file") -> DataFrame:
    """Calls, time, seeks, reads, writes, errors, bytes and opens of each descriptor, file (dev, node) or task."""
    n = F.col("syscallno")
    return bound.groupBy(*_FILE_KEYS[by]).agg(
        F.count("*").alias("syscalls"), F.sum("elapsed").alias("elapsed_ns"), F.max("elapsed").alias("max_ns"), F.count_if(n == LSEEK).alias("lseeks"), F.count_if(n.isin(list(READS))).alias("reads"), F.count_if(n.isin(list(WRITES))).alias("writes"),
        F.count_if(is_err(F.col("ret"))).alias("errs"), F.sum(moved_bytes()).alias("bytes"), F.count_if(n.isin(list(OPENS))).alias("opens"),
    )


def pgcache_stats(df: DataFrame, by: str = "file") -> DataFrame:
    """Page-cache inserts and evictions by file (dev, inode), task and file, or host."""
    keys = {"file": [F.col("pgc.dev").alias("dev"), F.col("pgc.i_ino").alias("i_ino")], "pid": ["pid", F.col("pgc.dev").alias("dev"), F.col("pgc.i_ino").alias("i_ino")], "host": []}[by]
    return df.where("event in ('cache_insert', 'cache_evict')").groupBy("hostname", *keys).agg(F.count_if(F.col("event") == "cache_insert").alias("inserts"), F.count_if(F.col("event") == "cache_evict").alias("evicts"))


#: Columns of each grouping of network traffic.
SOCKET_LEVELS = {"conn": ["lip", "lport", "rip", "rport"], "ip_pair": ["lip", "rip"], "lip": ["lip"], "rip": ["rip"], "lport": ["lport"], "rport": ["rport"]}


def socket_calls(bound: DataFrame) -> DataFrame:
    """Data calls on sockets as (hostname, lip, lport, rip, rport, dir, bytes, err, pid)."""
    n = F.col("syscallno")
    return bound.where(F.col("laddr").isNotNull() & n.isin([*READS, *WRITES])).select("hostname", F.col("laddr").alias("lip"), "lport", F.col("raddr").alias("rip"), "rport", F.when(n.isin(list(READS)), "rx").otherwise("tx").alias("dir"), moved_bytes().alias("bytes"), is_err(F.col("ret")).cast("int").alias("err"), "pid")


def socket_stats(flows: DataFrame, levels: tuple[str, ...] = tuple(SOCKET_LEVELS)) -> DataFrame:
    """Reads, writes, their KB and errors at all levels in one pass (grouping sets); ``level`` names the level of a row."""
    cols = ["lip", "lport", "rip", "rport"]
    sets = [[F.col("hostname"), *[F.col(c) for c in SOCKET_LEVELS[x]]] for x in levels]
    rd = F.col("dir") == "rx"
    out = flows.groupingSets(sets, "hostname", *cols).agg(
        F.count_if(rd).alias("rx"), F.sum(F.when(rd, F.col("bytes")).otherwise(0)).alias("rx_bytes"), F.count_if(~rd).alias("tx"), F.sum(F.when(~rd, F.col("bytes")).otherwise(0)).alias("tx_bytes"), F.sum("err").alias("errs"),
        F.max("pid").alias("last_pid"), *[F.grouping(c).alias(f"_{c}") for c in cols],
    )
    level = F.lit(None)
    for x in levels:
        test = F.lit(True)
        for c in cols:
            test = test & (F.col(f"_{c}") == (0 if c in SOCKET_LEVELS[x] else 1))
        level = F.when(test, x).otherwise(level)
    return out.withColumn("level", level).drop(*[f"_{c}" for c in cols])


def futex_calls(calls: DataFrame, number: int = FUTEX) -> DataFrame:
    """Futex calls with space (the process of a private futex, 0 of a shared one), addr and op."""
    op = F.get("args", F.lit(1))
    return calls.where(F.col("syscallno") == number).withColumns({"addr": F.get("args", F.lit(0)), "op": op.bitwiseAND(F.lit(127)), "space": F.when(op.bitwiseAND(F.lit(FUTEX_PRIVATE)) != 0, F.col("tgid")).otherwise(0)})


_FUTEX = {"addr": [], "addr_op": ["op"], "addr_pid": ["pid"], "addr_op_pid": ["op", "pid"]}


def futex_stats(futexes: DataFrame, by: str = "addr") -> DataFrame:
    """Calls on each futex: count, kinds of errors, mean result, time; with a ``waker`` column also who ended the longest wait."""
    ret = F.col("ret")
    more = [F.max_by("waker", F.struct("elapsed", "exit")).alias("max_waker")] if "waker" in futexes.columns else []
    return futexes.groupBy("hostname", "space", "addr", *_FUTEX[by]).agg(
        F.count("*").alias("cnt"), F.count_if(ret == EAGAIN).alias("eagain"), F.count_if(ret == ETIMEDOUT).alias("etimedout"), F.count_if(is_err(ret) & ~ret.isin(EAGAIN, ETIMEDOUT)).alias("other_err"),
        F.avg(F.when(ret >= 0, ret)).alias("avg_ret"), F.sum("elapsed").alias("elapsed_ns"), F.expr("sum(elapsed) div count(*)").alias("avg_ns"), F.max("elapsed").alias("max_ns"), *more,
    )


def futex_wakers(futexes: DataFrame, df: DataFrame) -> DataFrame:
    """Futex calls with the task that woke the caller last while the call was open."""
    wakes = df.where("event in ('sched_wakeup', 'sched_wakeup_new') and wk.success = 1").select("hostname", F.col("wk.target_pid").alias("pid"), F.col("hrtime").alias("t"), F.col("pid").alias("w"))
    calls = futexes.select("hostname", "pid", F.col("exit").alias("t"), F.struct(*futexes.columns).alias("call"))
    w = Window.partitionBy("hostname", "pid").orderBy("t", F.col("call").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    both = calls.unionByName(wakes, allowMissingColumns=True).withColumn("last", F.last(F.when(F.col("w").isNotNull(), F.struct("t", "w")), True).over(w))
    return both.where("call is not null").select("call.*", F.when(F.col("last.t") >= F.col("call.enter"), F.col("last.w")).alias("waker"))


def lineage(calls: DataFrame, processes: DataFrame | None = None) -> DataFrame:
    """hostname, pid, tgid, ppid, cmd of tasks made during the capture; the command is the last one that the task executed, else its parent's."""
    made = calls.where(F.col("syscallno").isin(CLONE, FORK, VFORK) & (F.col("ret") > 0))
    thread = (F.col("syscallno") == CLONE) & (F.coalesce(F.get("args", F.lit(0)), F.lit(0)).bitwiseAND(F.lit(CLONE_THREAD)) != 0)
    child = made.select("hostname", F.col("ret").alias("child"), F.when(thread, F.col("tgid")).otherwise(F.col("ret")).alias("tgid"), F.col("pid").alias("maker"), thread.alias("thread"), F.col("exit").alias("born"))
    run = calls.where((F.col("syscallno") == EXECVE) & (F.coalesce("ret", F.lit(0)) == 0)).groupBy("hostname", "pid").agg(F.max_by("filename", "exit").alias("ran"))
    out = child.join(run.withColumnRenamed("pid", "child"), ["hostname", "child"], "left")
    if processes is not None:
        out = out.join(processes.select("hostname", F.col("pid").alias("maker"), F.col("ppid").alias("maker_ppid"), F.col("cmd").alias("maker_cmd")), ["hostname", "maker"], "left")
    else:
        out = out.withColumns({"maker_ppid": F.lit(None).cast("long"), "maker_cmd": F.lit(None).cast("string")})
    return out.select("hostname", F.col("child").alias("pid"), "tgid", F.when(F.col("thread"), F.col("maker_ppid")).otherwise(F.col("maker")).alias("ppid"), F.coalesce("ran", "maker_cmd").alias("cmd"), "born")
