"""Symbols, call stacks, sleep functions and CPU profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Context markers in stacks, the farthest distance from a symbol, and the depth of a stack (fixed values).
USER_MARK, KERNEL_MARK, REACH, DEPTH = -512, -128, 0x10000, 16
_SIGN = 1 << 63


def unsigned(col: Column) -> Column:
    """A 64-bit pattern as a number that orders as if it had no sign."""
    return F.when(col >= 0, col.cast("decimal(20,0)")).otherwise(col.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)"))


def symbolize(df: DataFrame, symbols: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """sym and offset of the nearest symbol at or below an address, at most ``REACH`` away; markers and the rest have none.

    An as-of join: symbols and addresses are cut into pages of ``REACH``; an address looks at its own page and the one below, each of which has
    been told its symbols. Pages keep the window of every key bounded.
    """
    page = lambda c: F.expr(f"shiftrightunsigned({c}, 16)")
    a = df.withColumn("_id", F.struct(*[F.col(c) for c in df.columns])).select(*keys, "_id", F.col(col).alias("addr")).where("addr not in (-512, -128)").select(*keys, "addr").distinct()
    s = symbols.select(*keys, "addr", "sym").withColumn("page", F.explode(F.array(page("addr"), page("addr") + 1))).withColumn("is_sym", F.lit(1))
    both = a.withColumn("page", page("addr")).withColumn("is_sym", F.lit(0)).unionByName(s.select(*keys, F.col("addr"), "page", "is_sym", "sym"), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "page").orderBy(F.expr("addr ^ -9223372036854775808"), F.desc("is_sym"), "sym").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("n", F.last(F.when(F.col("is_sym") == 1, F.struct("addr", "sym")), True).over(w)).where("is_sym = 0")
    found = near.where(F.col("n").isNotNull() & ((F.col("addr") - F.col("n.addr")) < REACH)).select(*keys, F.col("addr").alias(col), "n.sym", (F.col("addr") - F.col("n.addr")).alias("offset"))
    return df.join(found, [*keys, col], "left")


#: How the user mark stands in a stack of names.
USER = "<user>"


def symbolize_stacks(df: DataFrame, symbols: DataFrame, col: str = "stack", name: str = "frames", keys: tuple[str, ...] = ()) -> DataFrame:
    """``name``: the stack of addresses ``col`` as names, ``USER`` where user frames begin; addresses without a symbol are named in hex. Null stacks stay null.

    ``symbols`` have space (kernel or user), addr and sym, and ``keys`` where symbols belong to one host or program. Each different stack is taken apart once, each different
    address of all stacks is looked up once, by the as-of join, and stacks are put together again by place. Frames are the kernel's up to a user mark, and from a kernel mark on.
    """
    marker = lambda x: x.isin(USER_MARK, KERNEL_MARK)
    stacks = df.select(*keys, col).where(F.col(col).isNotNull()).distinct()
    marks = F.filter(F.transform(col, lambda x, i: F.when(marker(x), F.struct(i.alias("i"), x.alias("x")))), lambda m: m.isNotNull())
    space = lambda marks, i: F.when(F.element_at(F.concat(F.array(F.lit(KERNEL_MARK).cast("long")), F.transform(F.filter(marks, lambda m: m["i"] < i), lambda m: m["x"])), -1) == USER_MARK, "user").otherwise("kernel")
    frames = stacks.withColumn("_marks", marks).select(*keys, col, "_marks", F.posexplode(col).alias("_at", "addr")).select(*keys, col, "_at", "addr", space(F.col("_marks"), F.col("_at")).alias("space"))
    known = symbolize(frames.where(~marker(F.col("addr"))).select(*keys, "space", "addr").distinct(), symbols, "addr", (*keys, "space"))
    own = (*keys, "space", "addr")
    known = known.select(*[F.col(c).alias(f"_{c}") for c in own], "sym")
    met = frames.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own], "left")
    called = F.when(F.col("addr") == USER_MARK, USER).when(F.col("addr") != KERNEL_MARK, F.coalesce("sym", F.concat(F.lit("0x"), F.lower(F.hex("addr")))))
    named = met.groupBy(*keys, col).agg(F.array_sort(F.collect_list(F.when(called.isNotNull(), F.struct("_at", called.alias("f"))))).alias("_f"))
    named = named.select(*[F.col(c).alias(f"_{c}") for c in (*keys, col)], F.transform("_f", lambda x: x["f"]).alias(name))
    out = df.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, col)], "left")
    # An empty stack has no frames to put together.
    return out.select(*df.columns, F.when(F.size(col) == 0, F.array().cast("array<string>")).otherwise(F.col(name)).alias(name))


def trim_stack(ips: Column, overhead: list) -> Column:
    """A stack without its leading scheduler or interrupt frames: what follows the last overhead frame before the next context marker; at most ``DEPTH`` frames."""
    marker = lambda x: x.cast("string").isin(str(USER_MARK), str(KERNEL_MARK))
    body = F.when(marker(F.get(ips, F.lit(0))), F.slice(ips, 2, F.greatest(F.size(ips) - 1, F.lit(0)))).otherwise(ips)
    spots = F.transform(body, lambda x, i: F.when(marker(x), -(i + 1)).when(x.isin(overhead), i + 1).otherwise(0))
    ends = F.array_max(F.filter(spots, lambda x: x < 0))  # the nearest marker has the largest negative place
    limit = F.coalesce(-ends, F.size(body) + 1)
    last = F.coalesce(F.array_max(F.filter(spots, lambda x: (x > 0) & (x < limit))), F.lit(0))
    return F.slice(body, last + 1, F.lit(DEPTH))


def sleeps(intervals: DataFrame, overhead: list | None = None) -> DataFrame:
    """Sleep intervals that a wakeup ended, with their trimmed stack and its first frame."""
    s = intervals.where("state = 'SWTCH' and ended_by = 'wake'").withColumn("stack", trim_stack(F.coalesce("ips", F.array().cast("array<bigint>")), overhead or []))
    return s.withColumn("frame", F.get("stack", F.lit(0)))


def sleep_funcs(slept: DataFrame, by: tuple[str, ...] = ("hostname", "pid"), frame: str = "frame") -> DataFrame:
    """Sleeps by their function: count, time, mean and longest."""
    return slept.groupBy(*by, frame).agg(F.count("*").alias("cnt"), F.sum("ns").alias("sleep_ns"), F.expr("sum(ns) div count(*)").alias("avg_ns"), F.max("ns").alias("max_ns"))


def stack_stats(slept: DataFrame, by: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """Sleeps by their whole stack."""
    return slept.groupBy(*by, "stack").agg(F.count("*").alias("cnt"), F.sum("ns").alias("sleep_ns"))


def profile_samples(df: DataFrame) -> DataFrame:
    """Profile samples with state USER, SYS, IDLE or INTR, the place of the CPU (pc) and the stack without markers."""
    hc = F.col("hc.preempt_count")
    state = F.when(hc >= 256, "INTR").when(F.col("pid") == 0, "IDLE").when(F.get("hc.ips", F.lit(0)) == USER_MARK, "USER").otherwise("SYS")
    stack = F.filter("hc.ips", lambda x: ~x.isin(USER_MARK, KERNEL_MARK))
    return df.where("event = 'hardclock'").select("hostname", "cpu", "pid", "hrtime", state.alias("state"), F.get(stack, F.lit(0)).alias("pc"), F.slice(stack, 1, DEPTH).alias("stack"))


def profile_states(samples: DataFrame, by: tuple[str, ...] = ("hostname", "cpu")) -> DataFrame:
    """Samples of each state and their share of the busy and idle total."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = samples.groupBy(*by).agg(F.count("*").alias("total"), n("USER").alias("usr"), n("SYS").alias("sys"), n("IDLE").alias("idle"), n("INTR").alias("intr"))
    return out.withColumns({f"{c}_pct": 100.0 * F.col(c) / F.col("total") for c in ("usr", "sys", "idle", "intr")})


def profile_funcs(symbolized: DataFrame, by: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """Samples outside of idle by state and function, with the share of all of the host; addresses without a symbol are unknown of their state."""
    busy = symbolized.where("state <> 'IDLE'").withColumn("func", F.coalesce("sym", F.concat(F.lit("UNKNOWN_"), F.col("state"))))
    out = busy.groupBy(*by, "state", "func").agg(F.count("*").alias("hits"))
    return out.withColumn("pct", 100.0 * F.col("hits") / F.sum("hits").over(Window.partitionBy("hostname")))


def profile_stacks(samples: DataFrame, by: tuple[str, ...] = ("hostname",)) -> DataFrame:
    out = samples.where("state <> 'IDLE'").groupBy(*by, "state", "stack").agg(F.count("*").alias("hits"))
    return out.withColumn("pct", 100.0 * F.col("hits") / F.sum("hits").over(Window.partitionBy("hostname")))


#: Kinds of waits of a database task by the beginning of a user frame's name, in order; a rule may need another user frame before it (fixed values).
DB_WAITS = [
    ("db file sequential read", "ksfdread", None),
    ("log file switch", "kcrfws", None),
    ("enq: TX row lock", "ktuGetTxForXid", None),
    ("buffer busy", "kcbzwb", None),
    ("latch: cache buffers", "kcbget", "ksl_get_shared_latch"),
    ("gc current multi block read", "kcbzibmlt", "epoll_wait"),
    ("gc current block read", "kcbzib", "epoll_wait"),
    ("log file sync, polling", "kcrf_commit_force_int", "nanosleep"),
    ("log file sync, post/wait", "kcrf_commit_force_int", None),
    ("net from dblink", "npixfc", "snttread"),
    ("net from dblink", "ttcdrv", "snttread"),
    ("net from client", "opitsk", "snttread"),
    ("cursor: pin S", "kkscsCheckCursor", "kgxSharedExamine"),
    ("latch: sequence", "kdn", "kslgetl"),
    ("latch: undo", "ktuisonline1", "kslgetl"),
]
#: The same for kernel frames (fixed values).
DB_KERNEL_WAITS = [("db async I/O", "read_events", None)]


def ora_waits(slept: DataFrame, by: tuple[str, ...] = ("hostname", "pid"), stack: str = "stack", rules: list = DB_WAITS, kernel_rules: list = (), user_mark: str | None = None) -> DataFrame:
    """Sleeps of database tasks by the first frame of their symbolised stack that a rule fits; of several rules for a frame the first in the list counts.

    A rule that needs another frame fits only frames after it. With ``user_mark`` frames after that entry are the user's and those before it the kernel's, to
    which ``kernel_rules`` apply; without, all frames count as the user's.
    """
    both = [*[(*r, True) for r in rules], *[(*r, False) for r in kernel_rules]]
    needs = sorted({(earlier, user) for _, _, earlier, user in both if earlier})

    def step(state: Column, x: Column) -> Column:
        side = lambda user: F.lit(user) if user_mark is None else state["user"] == F.lit(user)
        begins = lambda prefix, user: F.coalesce(x.startswith(prefix), F.lit(False)) & side(user)
        hit, seen = state["wait"], state["seen"]
        for name, prefix, earlier, user in both:
            met = state["seen"].bitwiseAND(F.lit(1 << needs.index((earlier, user)))) != 0 if earlier else F.lit(True)
            hit = F.coalesce(hit, F.when(begins(prefix, user) & met, name))
        for n, (earlier, user) in enumerate(needs):
            seen = seen.bitwiseOR(F.when(begins(earlier, user), 1 << n).otherwise(0))
        user = F.lit(True) if user_mark is None else state["user"] | F.coalesce(x == user_mark, F.lit(False))
        return F.struct(user.alias("user"), seen.alias("seen"), hit.alias("wait"))

    start = F.struct(F.lit(user_mark is None).alias("user"), F.lit(0).alias("seen"), F.lit(None).cast("string").alias("wait"))
    found = slept.withColumn("wait", F.reduce(stack, start, step)["wait"]).where("wait is not null")
    return found.groupBy(*by, "wait").agg(F.count("*").alias("cnt"), F.expr("sum(ns) div count(*)").alias("avg_ns"), F.max("ns").alias("max_ns"), F.sum("ns").alias("sleep_ns"))


#: Database background roles by the beginning of the command; of several the last counts (fixed values).
DB_ROLES = [("lgwr", "ora_lgwr"), ("arch", "ora_arc"), ("dbw", "ora_dbw"), ("pquery", "ora_p0"), ("shared_server", "ora_s0"), ("ioslave", "ora_i")]


def ora_roles(tasks: DataFrame, processes: DataFrame, io: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """Run, run-queue and I/O sums of database tasks by role and instance, which the end of the command names."""
    found = F.lit(None).cast("string")
    for name, prefix in DB_ROLES:
        found = F.when(F.col("cmd").startswith(prefix), name).otherwise(found)
    p = processes.select("hostname", "pid", found.alias("role"), F.regexp_extract("cmd", r"^[a-z]+_[a-z0-9]+_(\w+)$", 1).alias("sid")).where("role is not null")
    j = tasks.join(p, ["hostname", "pid"])
    if io is not None:
        j = j.join(io.where("rw is null").select("hostname", "pid", "ios"), ["hostname", "pid"], "left")
    else:
        j = j.withColumn("ios", F.lit(0))
    out = j.groupBy("hostname", "sid", "role").agg(F.count("*").alias("tasks"), F.sum("run_ns").alias("run_ns"), F.sum("runq_ns").alias("runq_ns"), F.sum("sleep_ns").alias("sleep_ns"), F.sum(F.coalesce("ios", F.lit(0))).alias("ios"))
    return out.where(F.col("role") == role) if role else out
