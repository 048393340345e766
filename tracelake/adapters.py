"""The driver's tables as traces, by the same expressions in Spark and in SQL.

They exist to exercise the operators. ``events`` becomes task events, ``orders`` with
``lineitem`` block I/O, ``lineitem`` with its parties network flows, ``part`` a symbol
table, ``conversations`` call stacks, ``nation`` and ``region`` a CPU topology.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import as_trace, family

HOUR = 3_600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hostname, hrtime, cpu, cpu_seqno, usr, event_type, k, value of the events table."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('h', user_id % 2)").alias("hostname"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("hrtime"),
        F.expr("cast((user_id div 2 + event_id div 64) % 4 as int)").alias("cpu"), F.col("event_id").alias("cpu_seqno"), F.col("user_id").alias("usr"),
        "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "value",
    )


def task_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup: syscall enter; error: syscall exit; click: switch-out; view: switch-in; purchase: wakeup by the next user."""
    e = flat_events(spark, sf_dir)
    kind = F.col("event_type")
    is_ = lambda x: kind == x
    none = F.lit(None)
    ips = F.expr("array(bigint(k * 16), bigint(k % 7 * 1600 + 5), bigint(1))")
    return as_trace(e.select(
        "hostname", F.lit("c0").alias("capture_id"), "hrtime",
        F.when(is_("signup"), "sys_enter").when(is_("error"), "sys_exit").when(is_("purchase"), "sched_wakeup").otherwise("sched_switch").alias("event"),
        "cpu", "cpu_seqno",
        F.when(is_("view"), F.lit(0)).when(is_("purchase"), F.col("usr") + 1).otherwise(F.col("usr")).cast("long").alias("pid"),
        F.when(is_("view"), F.lit(0)).otherwise(F.expr("usr - usr % 4")).cast("long").alias("tgid"),
        F.when(is_("click"), family("sw", prev_state=F.expr("k % 3"), next_pid=F.lit(0), next_tgid=F.lit(0), total_rss=F.expr("k * 10"), total_vm=F.expr("k * 40"), stealtime=F.expr("k * 1000"), prev_prio=F.expr("k + 20"), ips=ips, msr=F.expr("array(bigint(k), bigint(k*2), bigint(k*3), bigint(k*5), bigint(k*7), bigint(k*9), bigint(0))")))
        .when(is_("view"), family("sw", prev_state=F.lit(0), next_pid=F.col("usr"), next_tgid=F.expr("usr - usr % 4"), next_prio=F.expr("k + 20"), msr=F.expr("array(bigint(0), bigint(0), bigint(0), bigint(0), bigint(0), bigint(0), bigint(0))"))).alias("sw"),
        F.when(is_("purchase"), family("wk", target_pid=F.col("usr"), target_cpu=F.col("cpu"), success=F.lit(1), is_new=F.lit(False))).alias("wk"),
        F.when(is_("signup"), family("sys", syscallno=F.expr("k % 8"), is32bit=F.lit(0), args=F.expr("array(bigint(k % 16), bigint(k), bigint(value))")))
        .when(is_("error"), family("sys", syscallno=F.expr("k % 8"), is32bit=F.lit(0), ret=F.expr("if(k % 5 = 0, -11, bigint(floor(value)))"), dev=F.expr("k % 3"), inode=F.col("k"), laddr=F.expr("concat('10.0.0.', usr % 3)"), lport=F.expr("1000 + k % 4"), raddr=F.expr("concat('10.0.1.', k % 5)"), rport=F.expr("80 + k % 2"))).alias("sys"),
        none.alias("hc"),
    ).drop("hc"))


def block_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, issue and complete of a request for each line item."""
    io = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.expr("concat('h', l_suppkey % 2)").alias("hostname"), F.lit("c0").alias("capture_id"), F.expr("cast(o_custkey % 4 as int)").alias("cpu"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("cpu_seqno"), F.col("o_custkey").alias("pid"), F.col("o_custkey").alias("tgid"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("insert_ts"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_quantity").cast("long").alias("q"),
        F.col("l_suppkey").alias("dev"), F.expr("l_partkey * 8").alias("sector"), F.expr("if(l_returnflag = 'R', 1, 0)").cast("long").alias("rw"),
    )
    blk = family("blk", dev=F.col("dev"), sector=F.col("sector"), cmd_flags=F.col("rw"), nr_sectors=F.col("q"), bytes=F.expr("q * 512"))
    issue = F.col("insert_ts") + F.col("ln") * HOUR
    steps = F.explode(F.array(
        F.struct(F.lit("block_rq_insert").alias("event"), F.col("insert_ts").alias("hrtime")),
        F.struct(F.lit("block_rq_issue").alias("event"), issue.alias("hrtime")),
        F.struct(F.lit("block_rq_complete").alias("event"), (issue + (F.col("q") + 1) * HOUR).alias("hrtime")),
    ))
    return as_trace(io.withColumn("blk", blk).withColumn("step", steps).select("hostname", "capture_id", "step.hrtime", "step.event", "cpu", "cpu_seqno", "pid", "tgid", "blk"))


def profile_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile sample for each event: its place in the symbol table and whether it is in user or kernel mode."""
    return as_trace(flat_events(spark, sf_dir).select(
        "hostname", F.lit("c0").alias("capture_id"), "hrtime", F.lit("hardclock").alias("event"), "cpu", "cpu_seqno",
        F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.col("usr")).cast("long").alias("pid"), F.expr("usr - usr % 4").alias("tgid"),
        family("hc", preempt_count=F.expr("if(k % 11 = 0, 256, 0)"), ips=F.expr("array(bigint(if(k % 2 = 0, -512, -128)), bigint(k * 16 + 3), bigint(k % 7 * 1600 + 5))")).alias("hc"),
    ))


def cpu_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupts and idle states on a CPU: signup and view begin and end an interrupt, click and purchase enter and leave a state, error sets a frequency."""
    is_ = lambda *x: F.col("event_type").isin(*x)
    return as_trace(flat_events(spark, sf_dir).select(
        "hostname", F.lit("c0").alias("capture_id"), "hrtime",
        F.when(is_("signup"), F.expr("if(k % 2 = 0, 'irq_handler_entry', 'softirq_entry')")).when(is_("view"), F.expr("if(k % 2 = 0, 'irq_handler_exit', 'softirq_exit')"))
        .when(is_("click"), "power_start").when(is_("purchase"), "power_end").otherwise("power_freq").alias("event"),
        "cpu", "cpu_seqno", F.col("usr").alias("pid"), F.col("usr").alias("tgid"),
        F.when(is_("signup", "view"), family("irq", kind=F.expr("if(k % 2 = 0, 'hard', 'soft')"), irq=F.expr("k % 4"), name=F.expr("concat('irq', k % 4)"))).alias("irq"),
        F.when(is_("click", "purchase", "error"), family("pwr", state=F.expr("1 + k % 3"), freq=F.expr("1000000 + k * 1000"), tgt_cpu=F.col("cpu"))).alias("pwr"),
    ))


def memory_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-cache inserts and evictions."""
    return as_trace(flat_events(spark, sf_dir).where("event_type in ('click', 'view')").select(
        "hostname", F.lit("c0").alias("capture_id"), "hrtime", F.expr("if(event_type = 'click', 'cache_insert', 'cache_evict')").alias("event"), "cpu", "cpu_seqno",
        F.col("usr").alias("pid"), F.expr("usr - usr % 4").alias("tgid"), family("pgc", dev=F.expr("k % 3"), i_ino=F.col("k"), index=F.col("cpu_seqno")).alias("pgc"),
    ))


def futex_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futex calls (number 202): signup enters one, error leaves it."""
    return as_trace(flat_events(spark, sf_dir).where("event_type in ('signup', 'error')").select(
        "hostname", F.lit("c0").alias("capture_id"), "hrtime", F.expr("if(event_type = 'signup', 'sys_enter', 'sys_exit')").alias("event"), "cpu", "cpu_seqno",
        F.col("usr").alias("pid"), F.expr("usr - usr % 4").alias("tgid"),
        family("sys", syscallno=F.lit(202), is32bit=F.lit(0), args=F.expr("array(bigint(k % 10 * 64), bigint(k % 3 + if(k % 4 = 0, 128, 0)), bigint(1))"), ret=F.expr("case when k % 7 = 0 then -11 when k % 7 = 1 then -110 when k % 7 = 2 then -22 else 0 end")).alias("sys"),
    ))


def topology(spark: SparkSession) -> DataFrame:
    """Four CPUs of two nodes on each of two hosts; CPUs 0 and 1, 2 and 3 are siblings."""
    return spark.range(8).select(
        F.expr("concat('h', id div 4)").alias("hostname"), F.expr("cast(id % 4 as int)").alias("cpu"), F.expr("cast(id % 4 div 2 as int)").alias("ldom"),
        F.expr("cast(id % 4 + if(id % 2 = 0, 1, -1) as int)").alias("lcpu_sibling"), F.expr("cast(id % 4 div 2 as int)").alias("pcpu_idx"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol at every 16th address, named after a part."""
    return table(spark, sf_dir, "part").select(F.lit("kernel").alias("space"), F.expr("p_partkey * 16").alias("addr"), F.col("p_name").alias("sym"))


#: Names of the frames of ``database_trace``, by the number of a part: the user's and the kernel's. Numbers without a rule's frame fall on the first ones.
USER_FRAMES = "main opimai ksfdread kcrfws ktuGetTxForXid kcbzwb kcbget ksl_get_shared_latch kcbzibmlt kcbzib epoll_wait kcrf_commit_force_int nanosleep npixfc snttread ttcdrv opitsk kkscsCheckCursor kgxSharedExamine kdn kslgetl ktuisonline1".split()
KERNEL_FRAMES = "schedule read_events hugetlb_fault huge_pmd_share hugetlb_no_page semtimedop sem_lock try_atomic_semop kstat_irqs show_stat seq_read".split()
FRAMES = 150


def database_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of tasks whose switch-outs have stacks of two kernel frames and three user frames, each an address in a symbol of ``frame_symbols``."""
    at = lambda a, b, k: f"bigint((1 + (cpu_seqno * {a} + pid * {b}) % {FRAMES}) * 16 + {k})"
    ips = F.expr(f"array(bigint(-128), {at(3, 1, 2)}, {at(11, 5, 4)}, bigint(-512), {at(7, 3, 5)}, {at(13, 0, 7)}, {at(29, 11, 15)})")
    t = task_trace(spark, sf_dir)
    return t.withColumn("sw", F.when(F.col("sw.ips").isNotNull(), F.col("sw").withField("ips", ips)).otherwise(F.col("sw")))


def frame_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel and a user symbol at every 16th address."""
    p = table(spark, sf_dir, "part").where(f"p_partkey between 1 and {FRAMES}")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names)).cast("int"))
    return p.select(F.explode(F.array(F.struct(F.lit("kernel").alias("space"), pick(KERNEL_FRAMES).alias("sym")), F.struct(F.lit("user").alias("space"), F.concat(pick(USER_FRAMES), F.lit("+")).alias("sym")))).alias("s"), F.expr("p_partkey * 16").alias("addr")).select("s.space", "addr", "s.sym")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network calls between the nations of customer and supplier of each line item."""
    t = {x: table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(
        F.lit("h0").alias("hostname"), F.expr("concat('10.0.0.', c_nationkey)").alias("lip"), F.expr("cast(l_linenumber + 1000 as int)").alias("lport"),
        F.expr("concat('10.0.1.', s_nationkey)").alias("rip"), F.expr("if(l_returnflag = 'R', 443, 80)").alias("rport"),
        F.expr("if(l_linestatus = 'F', 'rx', 'tx')").alias("dir"), F.expr("bigint(floor(l_extendedprice))").alias("bytes"), F.expr("if(l_discount > 0.08, 1, 0)").alias("err"), F.col("o_custkey").alias("pid"),
    )


# The same in SQL.

EV = """ev AS (
  SELECT 'h' || (user_id % 2) AS hostname, epoch_us(ts) * 1000 AS hrtime, CAST((user_id // 2 + event_id // 64) % 4 AS INTEGER) AS cpu, event_id AS cpu_seqno, user_id AS usr,
         event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events)"""
IO = f"""io AS (
  SELECT 'h' || (l_suppkey % 2) AS hostname, CAST(o_custkey % 4 AS INTEGER) AS cpu, l_orderkey * 8 + l_linenumber AS cpu_seqno, o_custkey AS pid,
         epoch_us(o_orderdate) * 1000 AS ins, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS dev, l_partkey * 8 AS sector,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS rw FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
bt AS (
  SELECT *, 'block_rq_insert' AS event, ins AS hrtime FROM io
  UNION ALL SELECT *, 'block_rq_issue', ins + ln * {HOUR} FROM io
  UNION ALL SELECT *, 'block_rq_complete', ins + ln * {HOUR} + (q + 1) * {HOUR} FROM io)"""
FLOWS = """fl AS (
  SELECT '10.0.0.' || c_nationkey AS lip, CAST(l_linenumber + 1000 AS INTEGER) AS lport, '10.0.1.' || s_nationkey AS rip,
         CASE WHEN l_returnflag = 'R' THEN 443 ELSE 80 END AS rport, CASE WHEN l_linestatus = 'F' THEN 'rx' ELSE 'tx' END AS dir,
         CAST(floor(l_extendedprice) AS BIGINT) AS bytes, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS err, o_custkey AS pid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
