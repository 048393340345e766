"""Registered queries of the sources: given tables are written out as listings and logs, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from .adapters import EV, IO
from .operators import dims
from .registry import query
from .sources import readers
from .streaming.drive import folder


def told(df: DataFrame) -> DataFrame:
    """Missing numbers as -1, for comparison."""
    return df.na.fill(-1)


def listing(lines: DataFrame, name: str) -> str:
    """Text files below a directory for each host; ``lines`` has hostname and value."""
    path = folder(lines.sparkSession, name)
    lines.select("hostname", "value").write.partitionBy("hostname").text(path)
    return path


LOG_SQL = f"""WITH {EV}
SELECT CASE WHEN event_type <> 'click' THEN hrtime ELSE -1 END AS hrtime,
       CASE event_type WHEN 'purchase' THEN 'sched_wakeup' WHEN 'signup' THEN 'sys_enter' WHEN 'view' THEN 'power_start' WHEN 'error' THEN 'hardclock' END AS event,
       CASE WHEN event_type <> 'click' THEN cpu ELSE -1 END AS cpu, CASE WHEN event_type <> 'click' THEN usr ELSE -1 END AS pid,
       CASE WHEN event_type <> 'click' THEN usr - usr % 4 ELSE -1 END AS tgid, CASE WHEN event_type = 'purchase' THEN usr + 1 ELSE -1 END AS target_pid,
       CASE WHEN event_type = 'signup' THEN k % 8 ELSE -1 END AS syscallno, CASE WHEN event_type = 'signup' THEN k * 2 ELSE -1 END AS arg1,
       CASE WHEN event_type = 'view' THEN k * 1000 ELSE -1 END AS freq, CASE WHEN event_type = 'error' THEN k * 16 + 3 ELSE -1 END AS frame,
       CASE WHEN event_type = 'click' THEN 'lost ' || k || ' events' END AS corrupt, CASE WHEN event_type <> 'click' THEN cpu_seqno ELSE -1 END AS seqno
FROM ev"""


@query("s2_read_trace_text", LOG_SQL)
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a text log; every click is a line that is no event."""
    head = "concat(hrtime div 1000000000, '.', lpad(hrtime % 1000000000, 9, '0'), ' cpu=', cpu, ' pid=', usr, ' tgid=', usr - usr % 4, ' '"
    tail = """, case event_type when 'purchase' then concat('sched_wakeup target_pid=', usr + 1, ' prio=120 target_cpu=', cpu, ' success=1')
        when 'signup' then concat('sys_enter syscall=', k % 8, ' is32bit=0 args=', k, ',', k * 2) when 'view' then concat('power_start state=1 freq=', k * 1000)
        else concat('hardclock preempt_count=0 stack=', k * 16 + 3, ',5') end, ' seqno=', cpu_seqno)"""
    lines = ad.flat_events(spark, sf).select("hostname", F.expr(f"if(event_type = 'click', concat('lost ', k, ' events'), {head}{tail})").alias("value"))
    t = readers.read_trace_text(spark, listing(lines, "trace-log"), "h0")
    return told(t.select(
        "hrtime", "event", "cpu", "pid", "tgid", F.col("wk.target_pid").alias("target_pid"), F.col("sys.syscallno").cast("long").alias("syscallno"),
        F.get("sys.args", 1).alias("arg1"), F.col("pwr.freq").cast("long").alias("freq"), F.get("hc.ips", 0).alias("frame"), F.col("_corrupt").alias("corrupt"),
        F.when(F.col("_corrupt").isNull(), F.col("cpu_seqno")).alias("seqno"),
    ))


@query("s4_read_cluster", f"""WITH {IO} SELECT hostname, 'c0' AS capture_id, event, count(*) AS n, CAST(sum(q) AS BIGINT) AS sectors, min(hrtime) AS t0, max(hrtime) AS t1
FROM bt GROUP BY hostname, event""")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """The block trace written by host, and all hosts read by one pattern."""
    path = folder(spark, "cluster")
    readers.write_trace(ad.block_trace(spark, sf), path)
    t = readers.read_cluster(spark, f"{path}/hostname=*")
    return t.groupBy("hostname", "capture_id", "event").agg(F.count("*").alias("n"), F.sum("blk.nr_sectors").alias("sectors"), F.min("hrtime").alias("t0"), F.max("hrtime").alias("t1"))


@query("s5_read_processes", """SELECT 'h' || (c_custkey % 2) AS host, c_custkey AS pid, c_custkey - c_custkey % 4 AS tgid, c_custkey % 7 AS ppid, CAST(c_custkey % 4 + 1 AS INTEGER) AS nlwp,
       c_name || ' --segment ' || c_mktsegment AS cmd FROM customer""")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """A thread for each customer, four to a process."""
    line = F.expr("""concat('user', c_nationkey, '  ', c_custkey - c_custkey % 4, ' ', c_custkey % 7, ' ', c_custkey, '  0 ', c_custkey % 4 + 1, ' 10:00 ?  00:00:01 ',
        c_name, ' --segment ', c_mktsegment)""")
    c = ad.table(spark, sf, "customer").select(F.expr("concat('h', c_custkey % 2)").alias("hostname"), line.alias("value"))
    return readers.read_processes(spark, listing(c, "processes"))


@query("s6_read_open_files", """SELECT 'h' || (o_orderkey % 2) AS host, o_custkey AS pid, CAST(o_orderkey % 1000 AS INTEGER) AS fd, CASE WHEN o_orderkey % 3 = 0 THEN 'IPv4' ELSE 'REG' END AS ftype,
       CASE WHEN o_orderkey % 3 <> 0 THEN (8 * 1048576 + o_orderkey % 16)::BIGINT ELSE -1 END AS dev, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE -1 END AS node,
       CASE WHEN o_orderkey % 3 = 0 THEN '10.0.0.' || (o_orderkey % 250) || ':80->10.0.1.7:' || (o_orderkey % 60000) ELSE '/data/file ' || o_orderkey END AS fname,
       CASE WHEN o_orderkey % 3 = 0 THEN '10.0.0.' || (o_orderkey % 250) END AS laddr, CASE WHEN o_orderkey % 3 = 0 THEN 80 ELSE -1 END AS lport,
       CASE WHEN o_orderkey % 3 = 0 THEN '10.0.1.7' END AS raddr, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 60000 AS INTEGER) ELSE -1 END AS rport FROM orders""")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    """An open file, or a connection, for each order."""
    line = F.expr("""concat('app ', o_custkey, ' root ', o_orderkey % 1000, 'u ', if(o_orderkey % 3 = 0,
        concat('IPv4 4711 0t0 TCP 10.0.0.', o_orderkey % 250, ':80->10.0.1.7:', o_orderkey % 60000),
        concat('REG 8,', o_orderkey % 16, ' 4096 ', o_orderkey, ' /data/file ', o_orderkey)))""")
    o = ad.table(spark, sf, "orders").select(F.expr("concat('h', o_orderkey % 2)").alias("hostname"), line.alias("value"))
    return told(readers.read_open_files(spark, listing(o, "open-files")))


@query("s7_read_topology", """SELECT 'n' || n AS host, CAST(c AS INTEGER) AS cpu, CAST(c // m AS INTEGER) AS ldom, CAST(CASE WHEN c < m THEN c + m ELSE c - m END AS INTEGER) AS lcpu_sibling,
       CAST(c % m AS INTEGER) AS pcpu_idx FROM (SELECT n, m, unnest(range(0, 2 * m)) AS c FROM (SELECT n_nationkey AS n, n_nationkey % 3 + 1 AS m FROM nation))""")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    """A host for each nation, of two nodes; a CPU's sibling is on the other node."""
    lines = F.expr("""flatten(array(array(concat('node 0 cpus: 0-', m - 1), concat('node 1 cpus: ', m, '-', 2 * m - 1), 'available: 2 nodes'),
        transform(sequence(0L, m - 1), i -> concat('siblings: ', i, ',', i + m))))""")
    n = ad.table(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("hostname"), F.expr("bigint(n_nationkey % 3 + 1)").alias("m"))
    return readers.read_topology(spark, listing(n.select("hostname", F.explode(lines).alias("value")), "topology"))


@query("s8_read_devices", """SELECT 'h' || (s_suppkey % 2) AS host, s_suppkey + 8388608 AS dev, 'sd' || s_suppkey AS devname, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 16 ELSE -1 END AS devpath,
       CASE WHEN s_suppkey % 4 = 0 THEN 'mpath' || (s_suppkey % 5) END AS mapname, '0x' || (5000 + s_nationkey) AS wwn, CASE WHEN s_suppkey % 4 = 0 THEN 'round-robin' END AS mp_policy FROM supplier""")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    """A device for each supplier; some have a path, some a mapper."""
    line = F.expr("""concat('dev=0x', hex(s_suppkey + 8388608), ' name=sd', s_suppkey, if(s_suppkey % 3 = 0, concat(' path=0x', hex(s_suppkey * 16)), ''),
        if(s_suppkey % 4 = 0, concat(' mapper=mpath', s_suppkey % 5, ' policy=round-robin'), ''), ' wwn=0x', 5000 + s_nationkey)""")
    s = ad.table(spark, sf, "supplier").select(F.expr("concat('h', s_suppkey % 2)").alias("hostname"), line.alias("value"))
    return told(readers.read_devices(spark, listing(s, "devices")))


@query("s9_read_symbols", """SELECT 'h0' AS host, 'kernel' AS space, -2147483648 + p_partkey * 16 AS addr, 'sym_' || p_partkey AS sym, CASE WHEN p_partkey % 3 = 0 THEN 'mod' || (p_partkey % 7) END AS module
FROM part WHERE p_partkey % 5 <> 0""")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    """A kernel address for each part, in the upper half of 64 bits; every fifth is data and no function."""
    line = F.expr("""concat(lower(hex(-2147483648 + p_partkey * 16)), if(p_partkey % 5 = 0, ' D ', if(p_partkey % 2 = 0, ' T ', ' t ')), 'sym_', p_partkey,
        if(p_partkey % 3 = 0, concat(' [mod', p_partkey % 7, ']'), ''))""")
    return readers.read_symbols(spark, listing(ad.table(spark, sf, "part").select(F.lit("h0").alias("hostname"), line.alias("value")), "symbols"))


@query("s10_read_containers", """SELECT 'h' || (c_custkey % 2) AS host, 'c0ffee00000' || (c_custkey % 10) AS container_id, CASE WHEN c_custkey % 10 < 9 THEN 'web_' || (c_custkey % 10) END AS name,
       CASE WHEN c_custkey % 10 < 9 THEN 'image:' || (c_custkey % 10) END AS image, c_custkey AS pid FROM customer""")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """A task for each customer in one of ten containers, of which the last is not listed."""
    c = ad.table(spark, sf, "customer").select(F.expr("concat('h', c_custkey % 2)").alias("hostname"), F.expr("concat(c_custkey, ' 3:memory:/docker/c0ffee00000', c_custkey % 10, repeat('ab', 26))").alias("value"))
    ids = ad.table(spark, sf, "customer").select(F.expr("concat('h', c_custkey % 2)").alias("hostname"), F.expr("c_custkey % 10").alias("i")).where("i < 9").distinct()
    return readers.read_containers(spark, listing(c.union(ids.select("hostname", F.expr("concat('c0ffee00000', i, ' image:', i, ' Up 3 days web_', i)"))), "containers"))


@query("s11_read_thread_names", """SELECT 'h' || (c_custkey % 2) AS host, c_custkey AS pid, CASE WHEN c_custkey % 3 = 0 THEN 'worker ' || c_custkey ELSE c_name END AS thread_name,
       CASE WHEN c_custkey % 3 = 0 THEN 'java' ELSE 'db' END AS kind FROM customer""")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """A name for each customer's thread, from a stack dump or from a database."""
    line = F.expr("""if(c_custkey % 3 = 0, concat('"worker ', c_custkey, '" #7 prio=5 nid=0x', lower(hex(c_custkey)), ' runnable'), concat('  ', c_custkey, ' ', c_name, ' '))""")
    c = ad.table(spark, sf, "customer").select(F.expr("concat('h', c_custkey % 2)").alias("hostname"), line.alias("value"))
    return readers.read_thread_names(spark, listing(c, "thread-names"))


@query("s12_read_host_facts", """SELECT 'r' || n_regionkey AS host, CASE n_nationkey % 3 WHEN 0 THEN 'irq' WHEN 1 THEN 'cstate' ELSE 'mem' END AS kind, CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation""")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """A fact for each nation, on the host of its region."""
    line = F.expr("concat(case n_nationkey % 3 when 0 then 'irq' when 1 then 'cstate' else 'mem' end, '  ', n_nationkey, ' = ', n_name, '  ')")
    n = ad.table(spark, sf, "nation").select(F.expr("concat('r', n_regionkey)").alias("hostname"), line.alias("value"))
    return readers.read_host_facts(spark, listing(n, "facts"))


@query("c2_call_names", """SELECT l_orderkey, l_linenumber, coalesce(CASE l_linenumber % 2 WHEN 0 THEN CASE WHEN p_partkey % 5 <> 0 THEN 'call_' || p_partkey END ELSE CASE WHEN p_partkey % 7 <> 0 THEN 'old_' || p_partkey END END,
CAST(l_partkey AS VARCHAR)) AS call FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def c2_names(spark: SparkSession, sf: str) -> DataFrame:
    """A system call for each part on either architecture, from a header and from a table; some numbers have no name."""
    path = folder(spark, "call-names")
    p = ad.table(spark, sf, "part")
    wide = p.where("p_partkey % 5 <> 0").select(F.lit("x86_64").alias("arch"), F.expr("concat('#define __NR_call_', p_partkey, ' ', p_partkey)").alias("value"))
    old = p.where("p_partkey % 7 <> 0").select(F.lit("i386").alias("arch"), F.expr("concat(p_partkey, '\ti386\told_', p_partkey, '\tsys_old_', p_partkey)").alias("value"))
    wide.union(old).write.partitionBy("arch").text(path)
    calls = ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("int(l_linenumber % 2)").alias("is32bit"), F.col("l_partkey").cast("int").alias("syscallno"))
    return dims.with_call_names(calls, readers.read_call_names(spark, path)).select("l_orderkey", "l_linenumber", "call")
