"""The registered queries of the trace operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as ad
from .adapters import EV, FLOWS, HOUR, IO
from .functions import scalars as sc
from .operators import blockio, dims, filters, graph, power, stacks, states, syscalls, topn, windows
from .operators.hot import settled, written
from .registry import query, sql_of
from .schema import HEADER, as_trace

# Parts of the SQL that several queries share.

POINTS = f"""WITH {EV},
pt AS (
  SELECT hostname, hrtime, cpu, cpu_seqno, usr AS pid, k,
         CASE event_type WHEN 'signup' THEN 'enter' WHEN 'error' THEN 'exit' WHEN 'click' THEN 'out' WHEN 'view' THEN 'in' ELSE 'wake' END AS kind,
         CASE WHEN event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN 'Q' ELSE 'S' END END AS asleep FROM ev WHERE usr > 0),
b AS (SELECT hostname, min(hrtime) AS t0, max(hrtime) AS t1 FROM ev GROUP BY hostname),
r AS (
  SELECT *, last_value(CASE WHEN kind IN ('in', 'enter', 'exit') THEN 1 WHEN kind = 'out' THEN 0 END IGNORE NULLS)
            OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM pt),
kept AS (SELECT * FROM r WHERE NOT (kind = 'wake' AND coalesce(running, 0) = 1)),
iv AS (
  SELECT hostname, pid, cpu, cpu_seqno, k, kind, hrtime AS start, coalesce(lead(hrtime) OVER w, t1) AS "end", lead(kind) OVER w AS ended_by, lead(k) OVER w AS next_k,
         CASE WHEN kind IN ('in', 'enter', 'exit') THEN 'RUNNING' WHEN kind = 'wake' OR asleep = 'Q' THEN 'RUNQ' ELSE 'SWTCH' END AS state,
         coalesce(last_value(CASE kind WHEN 'enter' THEN 'SYS' WHEN 'exit' THEN 'USER' END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 'NONE') AS mode,
         coalesce(last_value(CASE kind WHEN 'enter' THEN k % 8 WHEN 'exit' THEN -1 END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), -1) AS scall
  FROM kept JOIN b USING (hostname) WINDOW w AS (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno)),
ivn AS (SELECT *, "end" - start AS ns FROM iv)
"""

CALLS = f"""WITH {EV},
e AS (SELECT hostname, usr AS pid, usr - usr % 4 AS tgid, cpu, hrtime, cpu_seqno, event_type, k, value FROM ev WHERE event_type IN ('signup', 'error')),
x AS (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN {{'t': hrtime, 'c': cpu, 's': cpu_seqno, 'k': k, 'v': value}} END IGNORE NULLS)
            OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op FROM e),
m AS (SELECT * FROM x WHERE event_type = 'error' AND op IS NOT NULL AND k % 8 = op.k % 8),
calls AS (
  SELECT hostname, pid, tgid, cpu, op.k % 8 AS syscallno, op.t AS enter, hrtime AS exit, hrtime - op.t AS elapsed, CASE WHEN k % 5 = 0 THEN -11 ELSE CAST(floor(value) AS BIGINT) END AS ret,
         op.k % 16 AS arg0, k, cpu_seqno FROM m QUALIFY row_number() OVER (PARTITION BY hostname, pid, op.t, op.c, op.s ORDER BY hrtime, cpu, cpu_seqno) = 1),
calls2 AS (SELECT *, CASE WHEN syscallno IN (0, 1) AND ret > 0 THEN ret ELSE 0 END AS bytes, CASE WHEN ret BETWEEN -4095 AND -1 THEN 1 ELSE 0 END AS err FROM calls)
"""

REQS = f"""WITH {IO},
n AS (
  SELECT *, 'x' AS z, coalesce(sum(CASE WHEN event = 'block_rq_complete' THEN 1 ELSE 0 END) OVER (
            PARTITION BY hostname, dev, sector ORDER BY hrtime, cpu_seqno, CASE event WHEN 'block_rq_insert' THEN 0 WHEN 'block_rq_issue' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS req FROM bt),
g AS (
  SELECT hostname, dev, sector, req,
         arg_max(hrtime, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_insert') AS i, arg_max(hrtime, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_issue') AS s, arg_max(hrtime, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_complete') AS c,
         arg_max(pid, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_insert') AS ip, arg_max(pid, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_issue') AS sp,
         arg_max(q, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_issue') AS qs, arg_max(q, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_complete') AS qc, arg_max(q, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_insert') AS qi,
         arg_max(rw, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_complete') AS rw, arg_max(cpu_seqno, (hrtime, cpu_seqno, q, pid)) FILTER (WHERE event = 'block_rq_issue') AS seqno
  FROM n GROUP BY hostname, dev, sector, req),
rq AS (
  SELECT hostname, dev, sector, req, rw, coalesce(qs, qc, qi) AS nr_sectors, coalesce(i, s) AS insert_ts, s AS issue_ts, c AS complete_ts,
         CASE WHEN s IS NULL THEN NULL WHEN coalesce(i, s) <= s THEN s - coalesce(i, s) END AS qtm, c - coalesce(s, i) AS svtm, coalesce(ip, sp) AS insert_pid, sp AS issue_pid, seqno
  FROM g WHERE c IS NOT NULL AND (i IS NOT NULL OR s IS NOT NULL)),
sq AS (SELECT *, coalesce(sector = lag(sector + nr_sectors) OVER (PARTITION BY hostname, dev, rw ORDER BY insert_ts, seqno, sector), false) AS sequential FROM rq),
st AS (
  SELECT hostname, dev, rw2 AS rw, count(*) AS ios, CAST(sum(nr_sectors) AS BIGINT) AS sectors, CAST(coalesce(sum(qtm), 0) AS BIGINT) AS wait_ns, CAST(sum(svtm) AS BIGINT) AS serv_ns, count(qtm) AS waits, count(*) FILTER (WHERE sequential) AS seq,
         coalesce(max(qtm), 0) AS max_wait_ns, max(svtm) AS max_serv_ns, count(*) - count(*) FILTER (WHERE sequential) AS rnd
  FROM (SELECT *, unnest([rw, NULL]) AS rw2 FROM sq WHERE rw <= 1 AND svtm > 0) GROUP BY hostname, dev, rw2)
"""

# Block I/O.


def io_of(spark, sf):
    return blockio.pair_block_io(ad.block_trace(spark, sf))


STATS = ["hostname", "dev", "rw", "ios", "sectors", "wait_ns", "serv_ns", "waits", "seq", "max_wait_ns", "max_serv_ns", "rnd"]


@query("flagship_top_devices", REQS + "SELECT hostname, dev, ios, sectors, serv_ns / ios / 1e6 AS avserv_ms, wait_ns / waits / 1e6 AS avwait_ms, seq, rnd FROM st WHERE rw IS NULL ORDER BY avserv_ms DESC, hostname, dev LIMIT 20")
def flagship(spark, sf):
    top = topn.top_devices(blockio.io_stats(io_of(spark, sf)), "avserv", 20)
    return top.select("hostname", "dev", "ios", "sectors", "avserv_ms", "avwait_ms", "seq", "rnd")


@query("s1_read_trace", f"WITH {IO} SELECT hostname, event, count(*) AS n, CAST(sum(q) AS BIGINT) AS sectors FROM bt GROUP BY hostname, event")
def s1(spark, sf):
    return ad.block_trace(spark, sf).groupBy("hostname", "event").agg(F.count("*").alias("n"), F.sum("blk.nr_sectors").alias("sectors"))


@query("s3_merge_captures", f"WITH {EV}, {IO} SELECT hostname, count(*) AS n, min(hrtime) AS t0, max(hrtime) AS t1 FROM (SELECT hostname, hrtime FROM bt UNION ALL SELECT hostname, hrtime FROM ev) GROUP BY hostname")
def s3(spark, sf):
    from .sources.readers import merge_captures

    return merge_captures(ad.block_trace(spark, sf), ad.task_trace(spark, sf)).groupBy("hostname").agg(F.count("*").alias("n"), F.min("hrtime").alias("t0"), F.max("hrtime").alias("t1"))


@query("j2_pair_block_io", REQS + "SELECT hostname, dev, sector, req, rw, nr_sectors, insert_ts, issue_ts, complete_ts, qtm, svtm, insert_pid, issue_pid FROM rq")
def j2(spark, sf):
    return io_of(spark, sf).select("hostname", "dev", "sector", "req", "rw", "nr_sectors", "insert_ts", "issue_ts", "complete_ts", "qtm", "svtm", "insert_pid", "issue_pid")


@query("j3_resolve_merged", REQS.split("rq AS (")[0].replace("FROM bt)", "FROM bt WHERE NOT (event = 'block_rq_insert' AND sector % 3 = 0))") + """
m AS (
  SELECT a.hostname, a.dev, a.sector, a.req, arg_max(x.i, (x.i, x.sector, x.ip)) AS mi, arg_max(x.ip, (x.i, x.sector, x.ip)) AS mp FROM g a JOIN g x ON a.hostname = x.hostname AND a.dev = x.dev
  WHERE a.s IS NOT NULL AND a.i IS NULL AND x.i IS NOT NULL AND x.s IS NULL AND x.sector >= a.sector AND x.sector + coalesce(x.qs, x.qc, x.qi) <= a.sector + coalesce(a.qs, a.qc, a.qi) AND x.i <= a.s GROUP BY 1, 2, 3, 4)
SELECT g.hostname, g.dev, g.sector, g.req, coalesce(i, mi, s) AS insert_ts, s AS issue_ts, coalesce(ip, mp, sp) AS insert_pid
FROM g LEFT JOIN m ON m.hostname = g.hostname AND m.dev = g.dev AND m.sector = g.sector AND m.req = g.req WHERE c IS NOT NULL AND (coalesce(i, mi) IS NOT NULL OR s IS NOT NULL)""")
def j3(spark, sf):
    t = ad.block_trace(spark, sf)
    odd = t.where("not (event = 'block_rq_insert' and blk.sector % 3 = 0)")  # inserts of a third of the sectors are elsewhere
    return blockio.pair_block_io(odd, resolve=True).select("hostname", "dev", "sector", "req", "insert_ts", "issue_ts", "insert_pid")


@query("j4_requeue_abort", f"WITH {IO} SELECT hostname, dev, count(*) FILTER (WHERE q % 5 = 0 AND q % 10 <> 0) AS requeues, count(*) FILTER (WHERE q % 10 = 0) AS aborts FROM bt WHERE event = 'block_rq_issue' AND q % 5 = 0 GROUP BY hostname, dev")
def j4(spark, sf):
    t = ad.block_trace(spark, sf).where("event = 'block_rq_issue' and blk.nr_sectors % 5 = 0").withColumn("event", F.expr("if(blk.nr_sectors % 10 = 0, 'block_rq_abort', 'block_rq_requeue')"))
    return blockio.requeue_abort(t)


@query("a23_io_stats", REQS + "SELECT hostname, dev, rw, ios, sectors, wait_ns, serv_ns, waits, seq, max_wait_ns, max_serv_ns, rnd FROM st")
def a23(spark, sf):
    return blockio.io_stats(io_of(spark, sf)).select(*STATS)


@query("w2_seq_random", REQS + "SELECT hostname, dev, rw, sequential, count(*) AS n FROM sq GROUP BY hostname, dev, rw, sequential")
def w2(spark, sf):
    return blockio.seq_random(io_of(spark, sf)).groupBy("hostname", "dev", "rw", "sequential").agg(F.count("*").alias("n"))


@query("w3_queue_len", f"""WITH {IO},
s AS (SELECT hostname, dev, sum(CASE event WHEN 'block_rq_insert' THEN 1 ELSE -1 END) OVER w AS s, hrtime, cpu_seqno, CASE event WHEN 'block_rq_insert' THEN 1 ELSE -1 END AS step FROM bt WHERE event <> 'block_rq_complete'
      WINDOW w AS (PARTITION BY hostname, dev ORDER BY hrtime, cpu_seqno, CASE event WHEN 'block_rq_insert' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING)),
l AS (SELECT hostname, dev, s - least(0, min(s) OVER (PARTITION BY hostname, dev ORDER BY hrtime, cpu_seqno, step DESC ROWS UNBOUNDED PRECEDING)) AS len FROM s)
SELECT hostname, dev, round(avg(len), 6) AS avque, CAST(max(len) AS BIGINT) AS maxque, count(*) AS queue_ops FROM l GROUP BY hostname, dev""")
def w3(spark, sf):
    return blockio.queue_len(ad.block_trace(spark, sf)).withColumn("avque", F.round("avque", 6))


@query("a25_io_hist", REQS + f"SELECT hostname, dev, rw, least(CAST(floor(svtm / {HOUR * 5}) AS INTEGER), 9) AS bucket, count(*) AS n FROM rq WHERE rw <= 1 AND svtm > 0 GROUP BY 1, 2, 3, 4")
def a25(spark, sf):
    return blockio.io_hist(io_of(spark, sf), [HOUR * 5 / 1e6 * k for k in range(1, 10)])


@query("a26_hot_blocks", REQS + "SELECT hostname, dev, sector, rw, count(*) AS n FROM rq WHERE rw <= 1 GROUP BY hostname, dev, sector, rw HAVING count(*) >= 2")
def a26(spark, sf):
    return blockio.hot_blocks(io_of(spark, sf), 2)


def devices(spark, sf):
    return ad.table(spark, sf, "supplier").select(
        F.expr("concat('h', s_suppkey % 2)").alias("hostname"), F.col("s_suppkey").alias("dev"), F.col("s_name").alias("devname"), F.expr("bigint(s_nationkey) * 65536 + s_suppkey % 7").alias("devpath"), F.expr("concat('m', s_suppkey % 5)").alias("mapname"),
        F.expr("concat('w', s_nationkey)").alias("wwn"), F.lit("round-robin").alias("mp_policy"))


for _level, _col, _sql in (("hba", "hba", "s_nationkey * 65536"), ("wwn", "wwn", "'w' || s_nationkey"), ("mapper", "mapname", "'m' || (s_suppkey % 5)")):

    @query(f"a24_io_rollup_{_level}", REQS + f"SELECT hostname, {_sql} AS {_col}, rw, CAST(sum(ios) AS BIGINT) AS ios, CAST(sum(sectors) AS BIGINT) AS sectors, max(max_wait_ns) AS max_wait_ns, max(max_serv_ns) AS max_serv_ns FROM st JOIN supplier ON dev = s_suppkey GROUP BY 1, 2, 3")
    def a24(spark, sf, level=_level, col=_col):
        return blockio.io_rollup(blockio.io_stats(io_of(spark, sf)), devices(spark, sf), level).select("hostname", col, "rw", "ios", "sectors", "max_wait_ns", "max_serv_ns")


@query("j13_device_paths", REQS + "SELECT st.hostname, dev, ios, s_name AS devname, s_nationkey * 65536 AS hba FROM st JOIN supplier ON dev = s_suppkey WHERE rw IS NULL")
def j13(spark, sf):
    return blockio.with_device_paths(blockio.io_stats(io_of(spark, sf)).where("rw is null"), devices(spark, sf)).select("hostname", "dev", "ios", "devname", "hba")


@query("t2_top_devices", REQS + "SELECT hostname, dev, ios FROM st WHERE rw IS NULL ORDER BY ios DESC, hostname, dev LIMIT 10")
def t2(spark, sf):
    return topn.top_devices(blockio.io_stats(io_of(spark, sf)), "count", 10).select("hostname", "dev", "ios")


# Filters.


@query("f1_time_range", f"WITH {EV} SELECT ev.hostname, event_type, count(*) AS n FROM ev JOIN (SELECT hostname, min(hrtime) AS t0 FROM ev GROUP BY hostname) b ON ev.hostname = b.hostname WHERE hrtime - t0 BETWEEN {24 * HOUR} AND {48 * HOUR} GROUP BY 1, 2")
def f1(spark, sf):
    return filters.time_range(ad.flat_events(spark, sf), 24 * HOUR, 48 * HOUR).groupBy("hostname", "event_type").agg(F.count("*").alias("n"))


@query("f2_entity_filter", f"WITH {EV} SELECT hostname, hrtime, usr FROM ev WHERE event_type IN ('click', 'view', 'purchase') OR (event_type IN ('signup', 'error') AND usr IN (3, 5, 7))")
def f2(spark, sf):
    t = filters.entity_filter(ad.task_trace(spark, sf), pid=[3, 5, 7])
    return t.select("hostname", "hrtime", F.coalesce("wk.target_pid", F.when(F.col("pid") == 0, F.col("sw.next_pid")), "pid").alias("usr"))


@query("f3_select_events", f"WITH {EV} SELECT hostname, count(*) AS n FROM ev WHERE event_type IN ('click', 'view', 'purchase') GROUP BY hostname")
def f3(spark, sf):
    return filters.select_events(ad.task_trace(spark, sf), subsys=["sched"]).groupBy("hostname").agg(F.count("*").alias("n"))


@query("f4_drop_syscalls", f"WITH {EV} SELECT hostname, count(*) AS n FROM ev WHERE NOT (event_type IN ('signup', 'error') AND k % 8 IN (0, 3)) GROUP BY hostname")
def f4(spark, sf):
    return filters.drop_syscalls(ad.task_trace(spark, sf), [0, 3]).groupBy("hostname").agg(F.count("*").alias("n"))


@query("f5_device_class", f"WITH {IO} SELECT dev, count(*) AS n FROM bt WHERE dev % 5 = 2 GROUP BY dev")
def f5(spark, sf):
    return filters.device_class(ad.block_trace(spark, sf), "mapper", 2, F.expr("(blk.dev % 5) * 1048576 + blk.dev")).groupBy(F.col("blk.dev").alias("dev")).agg(F.count("*").alias("n"))


@query("f6_sectors", f"WITH {IO} SELECT dev, count(*) AS n, count(*) FILTER (WHERE sector = 0) AS invalid FROM bt GROUP BY dev")
def f6(spark, sf):
    return ad.block_trace(spark, sf).groupBy(F.col("blk.dev").alias("dev")).agg(F.count("*").alias("n"), F.count_if(~filters.valid_sector(F.col("blk.sector"))).alias("invalid"))


GAPS = f"""WITH {EV},
p AS (SELECT hostname, cpu, hrtime, cpu_seqno, CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN usr + 1 ELSE usr END AS pid,
      CASE event_type WHEN 'view' THEN usr WHEN 'click' THEN 0 WHEN 'purchase' THEN usr + 1 ELSE usr END AS nxt FROM ev),
l AS (SELECT *, lag(nxt) OVER w AS expected, lag(hrtime) OVER w AS start, cpu_seqno - lag(cpu_seqno) OVER w AS step FROM p WHERE pid >= 0
      WINDOW w AS (PARTITION BY hostname, cpu ORDER BY hrtime, cpu_seqno)),
gap AS (SELECT hostname, cpu, start, hrtime AS "end", hrtime - start AS gap_ns, greatest(step - 1, 0) AS events_lost FROM l WHERE expected IS NOT NULL AND expected <> pid)
"""


@query("f7_capture_gaps", GAPS + "SELECT * FROM gap")
def f7(spark, sf):
    return filters.capture_gaps(ad.task_trace(spark, sf))


UNIT = 3600  # the capture is a month long: slices of an hour


@query("f8_mask_gaps", POINTS + ", " + GAPS.split("FROM events),\n", 1)[1] + f""",
st AS (SELECT hostname, pid, cpu, state, start // {UNIT} AS a, "end" // {UNIT} AS z, ns FROM ivn
       UNION ALL SELECT hostname, pid, cpu, 'N', t0 // {UNIT}, start // {UNIT}, 0 FROM (
         SELECT ivn.*, t0, row_number() OVER (PARTITION BY ivn.hostname, pid ORDER BY start, cpu, cpu_seqno) AS n FROM ivn JOIN b ON b.hostname = ivn.hostname) WHERE n = 1),
hit AS (SELECT DISTINCT st.hostname, pid, a FROM st JOIN gap ON gap.hostname = st.hostname AND gap.cpu = st.cpu AND a < gap."end" // {UNIT} AND z > gap.start // {UNIT}),
m AS (SELECT st.hostname, st.pid, hit.a IS NOT NULL AND state IN ('RUNNING', 'RUNQ') AS bad, state, ns FROM st LEFT JOIN hit ON hit.hostname = st.hostname AND hit.pid = st.pid AND hit.a = st.a)
SELECT hostname, pid, CASE WHEN bad THEN 'UNKNOWN' ELSE state END AS state, CAST(sum(CASE WHEN bad THEN 0 ELSE ns END) AS BIGINT) AS ns FROM m GROUP BY 1, 2, 3""")
def f8(spark, sf):
    t = ad.task_trace(spark, sf)
    scaled = lambda d: d.withColumns({c: F.expr(f"`{c}` div {UNIT}") for c in ("start", "end")})
    states_ = scaled(states.task_state_intervals(t).select("hostname", "pid", "cpu", "state", "start", "end", "ns"))
    return filters.mask_gaps(states_, scaled(filters.capture_gaps(t).select("hostname", "cpu", "start", "end"))).groupBy("hostname", "pid", "state").agg(F.sum("ns").alias("ns"))


@query("f9_format_time", f"WITH {EV} SELECT hostname, cpu_seqno, strftime(make_timestamp(hrtime // 1000), '%Y-%m-%d %H:%M:%S.%f') AS time FROM ev")
def f9(spark, sf):
    return filters.format_time(ad.flat_events(spark, sf), "fmt").select("hostname", "cpu_seqno", "time")


@query("f10_time_slices", f"WITH {EV} SELECT hostname, hrtime // 3600000000000 AS time_slice, count(*) AS n FROM ev GROUP BY 1, 2")
def f10(spark, sf):
    return filters.partition_by_slice(ad.flat_events(spark, sf), 3_600_000).groupBy("hostname", "time_slice").agg(F.count("*").alias("n"))


@query("f12_browse", f"WITH {EV} SELECT hostname, hrtime, cpu, cpu_seqno, usr + 1 AS pid, usr AS target_pid FROM ev WHERE event_type = 'purchase'")
def f12(spark, sf):
    return filters.browse(ad.task_trace(spark, sf), "wk").select("hostname", "hrtime", "cpu", "cpu_seqno", "pid", "target_pid")


# Task and CPU states.


@query("a1_task_state_intervals", POINTS + """SELECT hostname, pid, state, mode, CAST(sum(ns) AS BIGINT) AS ns, count(*) AS n FROM ivn GROUP BY hostname, pid, state, mode""")
def a1(spark, sf):
    iv = states.task_state_intervals(ad.task_trace(spark, sf)).where("state <> 'N'")
    return iv.groupBy("hostname", "pid", "state", F.coalesce("mode", F.lit("NONE")).alias("mode")).agg(F.sum("ns").alias("ns"), F.count("*").alias("n"))


TASK = POINTS + """,
cp AS (SELECT hostname, pid, count(*) FILTER (WHERE kind = 'out') AS switches, count(*) FILTER (WHERE kind = 'out' AND asleep <> 'Q') AS sleeps, count(*) FILTER (WHERE kind = 'in') AS setrq FROM pt WHERE kind <> 'wake' GROUP BY hostname, pid)
SELECT hostname, pid, CAST(sum(CASE WHEN state = 'RUNNING' THEN ns ELSE 0 END) AS BIGINT) AS run_ns, CAST(sum(CASE WHEN state = 'RUNNING' AND mode <> 'USER' THEN ns ELSE 0 END) AS BIGINT) AS sys_ns, CAST(sum(CASE WHEN state = 'RUNNING' AND mode = 'USER' THEN ns ELSE 0 END) AS BIGINT) AS user_ns,
       CAST(sum(CASE WHEN state = 'RUNQ' THEN ns ELSE 0 END) AS BIGINT) AS runq_ns, CAST(sum(CASE WHEN state = 'SWTCH' THEN ns ELSE 0 END) AS BIGINT) AS sleep_ns, coalesce(max(switches), 0) AS switches, coalesce(max(sleeps), 0) AS sleeps, coalesce(max(setrq), 0) AS setrq
FROM ivn LEFT JOIN cp USING (hostname, pid) GROUP BY hostname, pid"""
TASK_COLS = ["hostname", "pid", "run_ns", "sys_ns", "user_ns", "runq_ns", "sleep_ns", "switches", "sleeps", "setrq"]


@query("a2_task_cpu", TASK)
def a2(spark, sf):
    return states.task_cpu(ad.task_trace(spark, sf)).select(*TASK_COLS)


@query("t1_top_tasks", TASK + " ORDER BY run_ns DESC, hostname, pid LIMIT 10")
def t1(spark, sf):
    return topn.top_tasks(states.task_cpu(ad.task_trace(spark, sf)), "runtime", 10).select(*TASK_COLS)


@query("t7_page_skip", TASK + " ORDER BY sleep_ns DESC, hostname, pid OFFSET 100")
def t7(spark, sf):
    return topn.page(states.task_cpu(ad.task_trace(spark, sf)).select(*TASK_COLS), "sleep_ns", -100, tie=["hostname", "pid"])


@query("t8_top_cluster", TASK + " ORDER BY switches DESC, hostname, pid LIMIT 15")
def t8(spark, sf):
    return topn.top_cluster(states.task_cpu(ad.task_trace(spark, sf)).select(*TASK_COLS), "switches", 15, ["hostname", "pid"])


CPU = f"""WITH {EV},
b AS (SELECT hostname, min(hrtime) AS t0, max(hrtime) AS t1 FROM ev GROUP BY hostname),
sw AS (SELECT ev.hostname, cpu, hrtime, event_type, coalesce(lead(hrtime) OVER (PARTITION BY ev.hostname, cpu ORDER BY hrtime, cpu_seqno), t1) - hrtime AS ns, k FROM (SELECT hostname, cpu, hrtime, cpu_seqno, k, CASE WHEN usr = 0 THEN 'click' ELSE event_type END AS event_type FROM ev WHERE event_type IN ('click', 'view')) ev JOIN b ON ev.hostname = b.hostname),
idle AS (SELECT hostname, cpu, CAST(sum(CASE WHEN event_type = 'click' THEN ns ELSE 0 END) AS BIGINT) AS idle_ns, CAST(sum(CASE WHEN event_type = 'view' THEN ns ELSE 0 END) AS BIGINT) AS busy_ns, count(*) AS switches FROM sw GROUP BY hostname, cpu),
top AS (SELECT 'h' || (i // 4) AS hostname, CAST(i % 4 AS INTEGER) AS cpu, CAST(i % 4 // 2 AS INTEGER) AS ldom FROM range(8) t(i)),
cpus AS (SELECT top.hostname, ldom, top.cpu, coalesce(idle_ns, t1 - t0) AS idle_ns, coalesce(busy_ns, 0) AS busy_ns, coalesce(switches, 0) AS switches FROM top JOIN b ON top.hostname = b.hostname LEFT JOIN idle ON idle.hostname = top.hostname AND idle.cpu = top.cpu)
"""


def cpus_of(spark, sf):
    return states.cpu_time(ad.task_trace(spark, sf), ad.topology(spark))


@query("a3_cpu_time", CPU + "SELECT * FROM cpus")
def a3(spark, sf):
    return cpus_of(spark, sf).select("hostname", "ldom", "cpu", "idle_ns", "busy_ns", "switches")


@query("a4_node_cpu_time", CPU + "SELECT hostname, ldom, count(*) AS n_cpus, CAST(sum(idle_ns) AS BIGINT) AS idle_ns, CAST(sum(busy_ns) AS BIGINT) AS busy_ns FROM cpus GROUP BY ROLLUP (hostname, ldom)")
def a4(spark, sf):
    return states.node_cpu_time(cpus_of(spark, sf)).select("hostname", "ldom", "n_cpus", "idle_ns", "busy_ns")


HT = f"""WITH {EV},
b AS (SELECT hostname, max(hrtime) AS t1 FROM ev GROUP BY hostname),
e AS (SELECT hostname, cpu, cpu // 2 AS p, cpu % 2 AS side, hrtime, cpu_seqno, event_type = 'view' AND usr <> 0 AS busy FROM ev WHERE event_type IN ('click', 'view')),
s AS (
  SELECT e.hostname, p, cpu, cpu_seqno, hrtime AS start, coalesce(lead(hrtime) OVER w, t1) AS "end", last_value(CASE WHEN side = 0 THEN busy END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS a,
         last_value(CASE WHEN side = 1 THEN busy END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS z
  FROM e JOIN b ON b.hostname = e.hostname WINDOW w AS (PARTITION BY e.hostname, p ORDER BY hrtime, cpu, cpu_seqno)),
ht AS (SELECT *, "end" - start AS ns FROM s WHERE a IS NOT NULL AND z IS NOT NULL)
"""


@query("a5_ht_usage", HT + """SELECT hostname, p AS pcpu_idx, CAST(sum(CASE WHEN NOT a AND NOT z THEN ns ELSE 0 END) AS BIGINT) AS double_idle, CAST(sum(CASE WHEN a AND NOT z THEN ns ELSE 0 END) AS BIGINT) AS lcpu1_busy,
CAST(sum(CASE WHEN NOT a AND z THEN ns ELSE 0 END) AS BIGINT) AS lcpu2_busy, CAST(sum(CASE WHEN a AND z THEN ns ELSE 0 END) AS BIGINT) AS double_busy FROM ht GROUP BY 1, 2""")
def a5(spark, sf):
    return states.ht_usage(ad.task_trace(spark, sf), ad.topology(spark))


@query("a6_ht_dbdi", HT + """, h AS (SELECT *, start // 1000000 AS t, "end" // 1000000 AS u FROM ht),
w AS (SELECT *, coalesce(lag(a AND z) OVER (PARTITION BY hostname, p ORDER BY start, cpu, cpu_seqno), false) AS was FROM h),
m AS (SELECT w.hostname, w.p, w.t, max(w.t - i.t) AS idle FROM w JOIN h i ON i.hostname = w.hostname AND i.p <> w.p AND i.t <= w.t AND w.t < i.u WHERE w.a AND w.z AND NOT w.was AND NOT i.a AND NOT i.z GROUP BY 1, 2, 3)
SELECT hostname, p AS pcpu_idx, CAST(list_sum(list_transform([10, 20, 30, 40, 50, 60, 75, 100, 125, 150, 200, 500, 1000, 5000, 20000], lambda x: CASE WHEN idle // 1000 >= x THEN 1 ELSE 0 END)) AS INTEGER) AS bucket, count(*) AS n
FROM m GROUP BY 1, 2, 3""")
def a6(spark, sf):
    return states.ht_dbdi(ad.task_trace(spark, sf), ad.topology(spark), 1_000_000)  # the capture is a month long


LAT = f"""WITH {EV},
pt AS (SELECT hostname, hrtime, cpu, cpu_seqno, usr AS pid, CASE event_type WHEN 'click' THEN 'out' WHEN 'view' THEN 'in' WHEN 'purchase' THEN 'wake' ELSE 'call' END AS kind, k FROM ev WHERE usr > 0),
r AS (SELECT *, last_value(CASE WHEN kind IN ('in', 'call') THEN 1 WHEN kind = 'out' THEN 0 END IGNORE NULLS) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM pt),
s AS (SELECT *, CASE WHEN kind IN ('in', 'call') THEN 'R' WHEN kind = 'wake' OR k % 3 = 0 THEN 'Q' ELSE 'S' END AS state FROM r WHERE NOT (kind = 'wake' AND coalesce(running, 0) = 1)),
o AS (SELECT *, lag(state) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno) AS old FROM s),
q AS (SELECT *, last_value(CASE WHEN state = 'Q' AND old IS DISTINCT FROM 'Q' THEN hrtime END IGNORE NULLS) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ready FROM o),
lat AS (SELECT hostname, pid, cpu, ready AS ready_ts, hrtime AS run_ts, (hrtime - ready) // 1000 AS latency_us FROM q WHERE kind = 'in' AND old = 'Q')
"""


def latencies_of(spark, sf):
    return states.runq_latency(ad.task_trace(spark, sf), ad.topology(spark))


@query("j7_runq_latency", LAT + "SELECT * FROM lat")
def j7(spark, sf):
    return latencies_of(spark, sf).select("hostname", "pid", "cpu", "ready_ts", "run_ts", "latency_us")


@query("f11_rq_delay", LAT + "SELECT hostname, pid, run_ts, latency_us FROM lat WHERE latency_us > 86400000000")
def f11(spark, sf):
    return filters.rq_delay(latencies_of(spark, sf), 86_400_000_000).select("hostname", "pid", "run_ts", "latency_us")


@query("a7_runq_stats", LAT + "SELECT hostname, cpu, count(*) AS cnt, CAST(sum(latency_us) AS BIGINT) AS total_us, CAST(sum(latency_us) AS BIGINT) // count(*) AS avg_us, max(latency_us) AS max_us FROM lat GROUP BY hostname, cpu")
def a7(spark, sf):
    return states.runq_stats(latencies_of(spark, sf), "cpu").select("hostname", "cpu", "cnt", "total_us", "avg_us", "max_us")


@query("a8_runq_hist", LAT + "SELECT hostname, pid, CASE WHEN latency_us < 5 THEN 0 WHEN latency_us < 10 THEN 1 WHEN latency_us < 20 THEN 2 WHEN latency_us < 50 THEN 3 WHEN latency_us < 100 THEN 4 WHEN latency_us < 500 THEN 5 WHEN latency_us < 1000 THEN 6 WHEN latency_us < 2000 THEN 7 WHEN latency_us < 10000 THEN 8 WHEN latency_us < 20000 THEN 9 ELSE 10 END AS bucket, count(*) AS n FROM lat GROUP BY 1, 2, 3")
def a8(spark, sf):
    return states.runq_hist(latencies_of(spark, sf), "pid")


@query("a9_idle_hist", CPU + "SELECT hostname, cpu, count(*) AS n FROM sw WHERE event_type = 'click' GROUP BY hostname, cpu")
def a9(spark, sf):
    return states.idle_hist(ad.task_trace(spark, sf)).groupBy("hostname", "cpu").agg(F.sum("n").alias("n"))


T_IDLE = 1_704_844_800_000_000_000


@query("a10_idle_at", CPU + f"SELECT hostname, count(*) AS n_idle, max(ns) AS max_idle, arg_max(cpu, (ns, cpu)) AS cpu FROM sw WHERE event_type = 'click' AND hrtime <= {T_IDLE} AND hrtime + ns > {T_IDLE} GROUP BY hostname")
def a10(spark, sf):
    return states.idle_at(ad.task_trace(spark, sf), T_IDLE).select("hostname", "n_idle", "max_idle", "cpu")


@query("a13_uflt_sleep", POINTS + "SELECT hostname, pid, count(*) AS cnt, CAST(sum(ns) AS BIGINT) AS sleep_ns FROM ivn WHERE state = 'SWTCH' AND ended_by = 'wake' AND mode = 'USER' GROUP BY hostname, pid")
def a13(spark, sf):
    return states.uflt_sleep(states.task_state_intervals(ad.task_trace(spark, sf)))


@query("a14_msr_stats", f"""WITH {EV},
d AS (SELECT hostname, cpu, hrtime, cpu_seqno, CASE event_type WHEN 'click' THEN k ELSE 0 END AS c FROM ev WHERE event_type IN ('click', 'view')),
l AS (SELECT hostname, cpu, c - lag(c) OVER (PARTITION BY hostname, cpu ORDER BY hrtime, cpu_seqno) AS d FROM d),
g AS (SELECT hostname, cpu, CAST(sum(d) AS BIGINT) AS s FROM l WHERE d IS NOT NULL GROUP BY 1, 2)
SELECT hostname, cpu, s AS llc_ref, 2 * s AS llc_miss, 3 * s AS instrs, 5 * s AS cycles, 7 * s AS act_clk, 9 * s AS ref_clk, 0 * s AS smi, CASE WHEN s <> 0 THEN 100.0::DOUBLE * (s - 2 * s) / s END AS llc_hit_pct,
       CASE WHEN s <> 0 THEN (5 * s) / (3 * s) END AS cpi, CASE WHEN s <> 0 THEN (7 * s) / (9 * s) END AS clock_ratio FROM g""")
def a14(spark, sf):
    return states.msr_stats(ad.task_trace(spark, sf), "cpu")


@query("a16_syscall_breakdown", POINTS + "SELECT hostname, pid, scall AS syscallno, CAST(sum(CASE WHEN state = 'SWTCH' THEN ns ELSE 0 END) AS BIGINT) AS sleep_ns, CAST(sum(CASE WHEN state = 'RUNQ' THEN ns ELSE 0 END) AS BIGINT) AS runq_ns, CAST(sum(CASE WHEN state = 'RUNNING' THEN ns ELSE 0 END) AS BIGINT) AS cpu_ns FROM ivn WHERE scall >= 0 GROUP BY hostname, pid, scall")
def a16(spark, sf):
    return states.syscall_breakdown(states.task_state_intervals(ad.task_trace(spark, sf)))


@query("a31_trace_counts", f"WITH {EV}, t AS (SELECT hostname, CASE event_type WHEN 'signup' THEN 'sys_enter' WHEN 'error' THEN 'sys_exit' WHEN 'purchase' THEN 'sched_wakeup' ELSE 'sched_switch' END AS event FROM ev) SELECT hostname, event, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY hostname) AS pct FROM t GROUP BY hostname, event")
def a31(spark, sf):
    return states.trace_counts(ad.task_trace(spark, sf))


@query("a35_mem_top", f"WITH {EV} SELECT hostname, usr AS pid, arg_max(k * 10, (hrtime, cpu_seqno)) AS rss FROM ev WHERE event_type = 'click' AND k > 0 AND usr > 0 GROUP BY hostname, usr")
def a35(spark, sf):
    return states.mem_top(ad.task_trace(spark, sf))


@query("a39_capture_quality", GAPS + """SELECT l.hostname, l.cpu, count(*) AS events, count(*) FILTER (WHERE expected IS NOT NULL AND expected <> pid) AS gaps,
CAST(coalesce(sum(greatest(step - 1, 0)) FILTER (WHERE expected IS NOT NULL AND expected <> pid), 0) AS BIGINT) AS events_lost FROM l GROUP BY 1, 2""")
def a39(spark, sf):
    return states.capture_quality(ad.task_trace(spark, sf))


@query("w1_wakeup_streaks", f"""WITH {EV},
e AS (SELECT hostname, CASE event_type WHEN 'purchase' THEN usr + 1 ELSE usr END AS pid, usr AS target, event_type = 'purchase' AS wk, hrtime, cpu, cpu_seqno FROM ev WHERE event_type <> 'view'),
i AS (SELECT *, sum(CASE WHEN wk THEN 0 ELSE 1 END) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS UNBOUNDED PRECEDING) AS island FROM e WHERE pid > 0),
o AS (SELECT *, CASE WHEN target IS DISTINCT FROM lag(target) OVER (PARTITION BY hostname, pid, island ORDER BY hrtime, cpu, cpu_seqno) THEN 1 ELSE 0 END AS other FROM i WHERE wk),
k AS (SELECT *, CAST(sum(other) OVER (PARTITION BY hostname, pid, island ORDER BY hrtime, cpu, cpu_seqno ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM o),
top AS (SELECT hostname, pid, island, max(streak) AS streak, arg_min(hrtime, (-streak, hrtime)) AS t FROM k GROUP BY 1, 2, 3),
n AS (SELECT hostname, pid, streak, count(*) AS hits, min(t) AS t FROM top GROUP BY 1, 2, 3)
SELECT hostname, pid, streak AS max_wakeups, t AS "when", hits FROM n QUALIFY row_number() OVER (PARTITION BY hostname, pid ORDER BY streak DESC) = 1""")
def w1(spark, sf):
    return states.wakeup_streaks(ad.task_trace(spark, sf))


@query("w4_migrations", POINTS + """, q AS (
  SELECT hostname, pid, cpu, lag(cpu) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno) AS old FROM pt WHERE kind <> 'wake')
SELECT hostname, pid, count(*) FILTER (WHERE cpu <> old) AS cpu_migrations, count(*) FILTER (WHERE cpu // 2 <> old // 2) AS node_migrations FROM q GROUP BY hostname, pid""")
def w4(spark, sf):
    return states.migrations(ad.task_trace(spark, sf), ad.topology(spark))


@query("w5_timeline", POINTS + f""", p AS (SELECT ivn.hostname, state, start, "end", t0, unnest(range((start - t0) // {24 * HOUR}, ("end" - 1 - t0) // {24 * HOUR} + 1)) AS slot FROM ivn JOIN b ON ivn.hostname = b.hostname WHERE ns > 0),
c AS (SELECT hostname, slot, state, least("end", t0 + (slot + 1) * {24 * HOUR}) - greatest(start, t0 + slot * {24 * HOUR}) AS ns FROM p)
SELECT hostname, slot, CAST(sum(CASE WHEN state = 'RUNNING' THEN ns ELSE 0 END) AS BIGINT) AS run_ns, CAST(sum(CASE WHEN state = 'RUNQ' THEN ns ELSE 0 END) AS BIGINT) AS runq_ns, CAST(sum(CASE WHEN state = 'SWTCH' THEN ns ELSE 0 END) AS BIGINT) AS sleep_ns FROM c GROUP BY hostname, slot""")
def w5(spark, sf):
    t = ad.task_trace(spark, sf)
    return windows.timeline(t, states.task_state_intervals(t), 24 * 3_600_000).select("hostname", "slot", "run_ns", "runq_ns", "sleep_ns")


@query("w6_with_pct", f"WITH {EV}, g AS (SELECT hostname, usr, count(*) AS n FROM ev GROUP BY hostname, usr) SELECT hostname, usr, n, 100.0 * n / sum(n) OVER (PARTITION BY hostname) AS n_pct FROM g")
def w6(spark, sf):
    return windows.with_pct(ad.flat_events(spark, sf).groupBy("hostname", "usr").agg(F.count("*").alias("n")), "n")


@query("w7_pareto", f"""WITH {EV}, g AS (SELECT hostname, usr, count(*) AS n FROM ev GROUP BY hostname, usr),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY hostname ORDER BY n DESC, usr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(n) OVER (PARTITION BY hostname) AS total, row_number() OVER (PARTITION BY hostname ORDER BY n DESC, usr) AS rank FROM g)
SELECT hostname, usr, n, rank, 100.0 * (bf + n) / total AS running_pct FROM s WHERE 100.0 * bf / total < 80""")
def w7(spark, sf):
    return windows.pareto(ad.flat_events(spark, sf).groupBy("hostname", "usr").agg(F.count("*").alias("n")), "n", 80.0, tie=("usr",))


@query("w8_with_prev", f"WITH {EV} SELECT hostname, usr AS pid, cpu_seqno, last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY hostname, usr ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_k FROM ev")
def w8(spark, sf):
    e = ad.flat_events(spark, sf).withColumnRenamed("usr", "pid")
    return windows.with_prev(e, {"last_k": F.when(F.col("event_type") == "signup", F.col("k"))}).select("hostname", "pid", "cpu_seqno", "last_k")


@query("z6_replay", f"WITH {EV} SELECT ev.hostname, (hrtime - t0) // {24 * HOUR} AS step, event_type AS event, count(*) AS n FROM ev JOIN (SELECT hostname, min(hrtime) AS t0 FROM ev GROUP BY hostname) b ON b.hostname = ev.hostname GROUP BY 1, 2, 3")
def z6(spark, sf):
    return windows.replay(ad.flat_events(spark, sf).withColumnRenamed("event_type", "event"), 24 * HOUR)


# System calls.


def calls_of(spark, sf):
    return syscalls.pair_syscalls(ad.task_trace(spark, sf))


@query("j1_pair_syscalls", CALLS + "SELECT hostname, pid, syscallno, enter, exit, elapsed, ret FROM calls")
def j1(spark, sf):
    return calls_of(spark, sf).select("hostname", "pid", "syscallno", "enter", "exit", "elapsed", "ret")


@query("a15_syscall_stats", CALLS + "SELECT hostname, pid, syscallno, count(*) AS cnt, CAST(sum(elapsed) AS BIGINT) AS elapsed_ns, max(elapsed) AS max_ns, CAST(sum(err) AS BIGINT) AS errs, CAST(sum(bytes) AS BIGINT) AS bytes FROM calls2 GROUP BY hostname, pid, syscallno")
def a15(spark, sf):
    return syscalls.syscall_stats(calls_of(spark, sf)).select("hostname", "pid", "syscallno", "cnt", "elapsed_ns", "max_ns", "errs", "bytes")


@query("a17_ioctl_stats", CALLS + "SELECT hostname, pid, arg0 AS fd, count(*) AS cnt, CAST(sum(elapsed) AS BIGINT) AS elapsed_ns, CAST(sum(err) AS BIGINT) AS errs FROM calls2 WHERE syscallno = 3 GROUP BY hostname, pid, arg0")
def a17(spark, sf):
    s = syscalls.ioctl_stats(calls_of(spark, sf), 3)
    return s.groupBy("hostname", "pid", "fd").agg(F.sum("cnt").alias("cnt"), F.sum("elapsed_ns").alias("elapsed_ns"), F.sum("errs").alias("errs"))


BOUND = CALLS + """,
bd AS (SELECT *, k % 3 AS dev, k AS node, '10.0.0.' || (pid % 3) AS lip, 1000 + k % 4 AS lport, '10.0.1.' || (k % 5) AS rip, 80 + k % 2 AS rport FROM calls2 WHERE ret <> -9)
"""


def bound_of(spark, sf):
    return syscalls.bind_fd(calls_of(spark, sf))


@query("j11_bind_fd", BOUND + "SELECT hostname, pid, arg0 AS fd, exit, dev, node, lip AS laddr FROM bd")
def j11(spark, sf):
    return bound_of(spark, sf).select("hostname", "pid", "fd", "exit", "dev", "node", "laddr")


@query("a18_file_stats", BOUND + "SELECT hostname, dev, node, count(*) AS syscalls, CAST(sum(elapsed) AS BIGINT) AS elapsed_ns, count(*) FILTER (WHERE syscallno = 0) AS reads, count(*) FILTER (WHERE syscallno = 1) AS writes, CAST(sum(err) AS BIGINT) AS errs, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE syscallno = 2) AS opens FROM bd GROUP BY hostname, dev, node")
def a18(spark, sf):
    return syscalls.file_stats(bound_of(spark, sf)).select("hostname", "dev", "node", "syscalls", "elapsed_ns", "reads", "writes", "errs", "bytes", "opens")


@query("t3_top_files", BOUND + "SELECT hostname, dev, node, count(*) AS syscalls FROM bd GROUP BY hostname, dev, node ORDER BY syscalls DESC, hostname, dev, node LIMIT 10")
def t3(spark, sf):
    return topn.top_files(syscalls.file_stats(bound_of(spark, sf)), "syscalls", 10).select("hostname", "dev", "node", "syscalls")


@query("a19_pgcache_stats", f"WITH {EV} SELECT hostname, k % 3 AS dev, k AS i_ino, count(*) FILTER (WHERE event_type = 'click') AS inserts, count(*) FILTER (WHERE event_type = 'view') AS evicts FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3")
def a19(spark, sf):
    return syscalls.pgcache_stats(ad.memory_trace(spark, sf))


SOCK = "count(*) FILTER (WHERE dir = 'rx') AS rx, CAST(coalesce(sum(bytes) FILTER (WHERE dir = 'rx'), 0) AS BIGINT) AS rx_bytes, count(*) FILTER (WHERE dir = 'tx') AS tx, CAST(coalesce(sum(bytes) FILTER (WHERE dir = 'tx'), 0) AS BIGINT) AS tx_bytes, CAST(sum(err) AS BIGINT) AS errs, max(pid) AS last_pid"


@query("a21_socket_stats", f"WITH {FLOWS} SELECT 'h0' AS hostname, lip, lport, rip, rport, CASE grouping(lip, lport, rip, rport) WHEN 0 THEN 'conn' WHEN 5 THEN 'ip_pair' WHEN 7 THEN 'lip' WHEN 13 THEN 'rip' WHEN 11 THEN 'lport' ELSE 'rport' END AS level, {SOCK} FROM fl GROUP BY GROUPING SETS ((lip, lport, rip, rport), (lip, rip), (lip), (rip), (lport), (rport))")
def a21(spark, sf):
    return syscalls.socket_stats(ad.flows(spark, sf))


@query("t4_top_sockets", f"WITH {FLOWS} SELECT lip, rip, count(*) AS calls FROM fl GROUP BY lip, rip ORDER BY calls DESC, lip, rip LIMIT 10")
def t4(spark, sf):
    return topn.top_sockets(syscalls.socket_stats(ad.flows(spark, sf), ("ip_pair",)), "syscalls", 10, "ip_pair").select("lip", "rip", "calls")


@query("a21_calls_to_flows", BOUND + f""", fl AS (SELECT hostname, lip, lport, rip, rport, CASE syscallno WHEN 0 THEN 'rx' ELSE 'tx' END AS dir, bytes, err, pid FROM bd WHERE syscallno IN (0, 1))
SELECT hostname, lip, lport, rip, rport, CASE grouping(lip, lport, rip, rport) WHEN 0 THEN 'conn' WHEN 5 THEN 'ip_pair' WHEN 7 THEN 'lip' WHEN 13 THEN 'rip' WHEN 11 THEN 'lport' ELSE 'rport' END AS level, {SOCK}
FROM fl GROUP BY GROUPING SETS ((hostname, lip, lport, rip, rport), (hostname, lip, rip), (hostname, lip), (hostname, rip), (hostname, lport), (hostname, rport))""")
def a21b(spark, sf):
    return syscalls.socket_stats(syscalls.socket_calls(bound_of(spark, sf)))


FUT = f"""WITH {EV},
e AS (SELECT hostname, usr AS pid, usr - usr % 4 AS tgid, cpu, hrtime, cpu_seqno, event_type, k FROM ev WHERE event_type IN ('signup', 'error')),
x AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN {{'t': hrtime, 's': cpu_seqno, 'k': k}} END IGNORE NULLS) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op FROM e),
c AS (SELECT hostname, pid, tgid, cpu, op.t AS enter, hrtime AS exit, hrtime - op.t AS elapsed, op.k % 10 * 64 AS addr, op.k % 3 AS op, CASE WHEN op.k % 4 = 0 THEN tgid ELSE 0 END AS space, CASE k % 7 WHEN 0 THEN -11 WHEN 1 THEN -110 WHEN 2 THEN -22 ELSE 0 END AS ret
      FROM x WHERE event_type = 'error' AND op IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hostname, pid, op.t, op.s ORDER BY hrtime, cpu, cpu_seqno) = 1),
f AS (SELECT hostname, space, addr, count(*) AS cnt, count(*) FILTER (WHERE ret = -11) AS eagain, count(*) FILTER (WHERE ret = -110) AS etimedout, count(*) FILTER (WHERE ret = -22) AS other_err, CAST(sum(elapsed) AS BIGINT) AS elapsed_ns, max(elapsed) AS max_ns FROM c GROUP BY hostname, space, addr)
"""


def futex_of(spark, sf):
    return syscalls.futex_calls(syscalls.pair_syscalls(ad.futex_trace(spark, sf)))


@query("a22_futex_stats", FUT + "SELECT * FROM f")
def a22(spark, sf):
    return syscalls.futex_stats(futex_of(spark, sf)).select("hostname", "space", "addr", "cnt", "eagain", "etimedout", "other_err", "elapsed_ns", "max_ns")


@query("t5_top_futexes", FUT + "SELECT f.hostname, space, addr, cnt, total, least(total, 10) AS shown FROM f JOIN (SELECT hostname, count(*) AS total FROM f GROUP BY hostname) t ON t.hostname = f.hostname ORDER BY cnt DESC, f.hostname, space, addr LIMIT 10")
def t5(spark, sf):
    return topn.top_futexes(syscalls.futex_stats(futex_of(spark, sf)), "count", 10).select("hostname", "space", "addr", "cnt", "total", "shown")


@query("j16_futex_wakers", FUT + """, wk AS (SELECT hostname, usr AS pid, hrtime AS t, usr + 1 AS w FROM ev WHERE event_type = 'purchase'),
fw AS (SELECT c.*, CASE WHEN wk.t >= enter THEN w END AS waker FROM c ASOF LEFT JOIN wk ON wk.hostname = c.hostname AND wk.pid = c.pid AND c.exit >= wk.t)
SELECT hostname, space, addr, count(*) AS cnt, count(*) FILTER (WHERE ret = -11) AS eagain, count(*) FILTER (WHERE ret = -110) AS etimedout, count(*) FILTER (WHERE ret = -22) AS other_err,
       CAST(avg(ret) FILTER (WHERE ret >= 0) AS DOUBLE) AS avg_ret, CAST(sum(elapsed) AS BIGINT) AS elapsed_ns, CAST(sum(elapsed) AS BIGINT) // count(*) AS avg_ns, max(elapsed) AS max_ns, first(waker ORDER BY elapsed DESC, exit DESC) AS max_waker
FROM fw GROUP BY 1, 2, 3""")
def j16(spark, sf):
    t = ad.futex_trace(spark, sf).unionByName(ad.task_trace(spark, sf).where("event = 'sched_wakeup'"))
    return syscalls.futex_stats(syscalls.futex_wakers(futex_of(spark, sf), t))


# Stacks and profile.


@query("j8_symbolize", f"WITH {EV} SELECT hostname, cpu_seqno, k * 16 + 3 AS pc, p_name AS sym, 3 AS \"offset\" FROM ev JOIN part ON p_partkey = k")
def j8(spark, sf):
    e = ad.flat_events(spark, sf).select("hostname", "cpu_seqno", F.expr("bigint(k * 16 + 3)").alias("pc"))
    return stacks.symbolize(e, ad.symbols(spark, sf), "pc")


@query("j9_trim_stack", f"WITH {EV} SELECT hostname, cpu_seqno, CASE WHEN k < 10 THEN [k % 7 * 1600 + 5, 1] ELSE [k * 16, k % 7 * 1600 + 5, 1] END AS stack FROM ev WHERE event_type = 'click'")
def j9(spark, sf):
    t = ad.task_trace(spark, sf).where("event = 'sched_switch' and sw.ips is not null")
    return t.select("hostname", "cpu_seqno", stacks.trim_stack(F.col("sw.ips"), [k * 16 for k in range(10)]).alias("stack"))


SLEPT = POINTS + ", sl AS (SELECT *, k * 16 AS frame FROM ivn WHERE state = 'SWTCH' AND ended_by = 'wake')\n"


def slept_of(spark, sf):
    return stacks.sleeps(states.task_state_intervals(ad.task_trace(spark, sf)))


@query("a11_sleep_funcs", SLEPT + "SELECT hostname, pid, frame, count(*) AS cnt, CAST(sum(ns) AS BIGINT) AS sleep_ns, max(ns) AS max_ns FROM sl GROUP BY hostname, pid, frame")
def a11(spark, sf):
    return stacks.sleep_funcs(slept_of(spark, sf)).select("hostname", "pid", "frame", "cnt", "sleep_ns", "max_ns")


@query("a12_stack_stats", SLEPT + "SELECT hostname, k * 16 AS f0, k % 7 * 1600 + 5 AS f1, count(*) AS cnt, CAST(sum(ns) AS BIGINT) AS sleep_ns FROM sl GROUP BY 1, 2, 3")
def a12(spark, sf):
    return stacks.stack_stats(slept_of(spark, sf)).select("hostname", F.col("stack")[0].alias("f0"), F.col("stack")[1].alias("f1"), "cnt", "sleep_ns")


PROF = f"WITH {EV}, s AS (SELECT hostname, cpu, CASE WHEN event_type = 'view' THEN 0 ELSE usr END AS pid, k, CASE WHEN k % 11 = 0 THEN 'INTR' WHEN event_type = 'view' OR usr = 0 THEN 'IDLE' WHEN k % 2 = 0 THEN 'USER' ELSE 'SYS' END AS state FROM ev)\n"


@query("a27_profile_states", PROF + "SELECT hostname, cpu, count(*) AS total, count(*) FILTER (WHERE state = 'USER') AS usr, count(*) FILTER (WHERE state = 'SYS') AS sys, count(*) FILTER (WHERE state = 'IDLE') AS idle, count(*) FILTER (WHERE state = 'INTR') AS intr FROM s GROUP BY hostname, cpu")
def a27(spark, sf):
    return stacks.profile_states(stacks.profile_samples(ad.profile_trace(spark, sf))).select("hostname", "cpu", "total", "usr", "sys", "idle", "intr")


@query("a28_profile_funcs", PROF + "SELECT hostname, state, p_name AS func, count(*) AS hits, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY hostname) AS pct FROM s JOIN part ON p_partkey = k WHERE state <> 'IDLE' GROUP BY hostname, state, p_name")
def a28(spark, sf):
    return stacks.profile_funcs(stacks.symbolize(stacks.profile_samples(ad.profile_trace(spark, sf)), ad.symbols(spark, sf), "pc"))


@query("a28_profile_stacks", PROF + "SELECT hostname, state, k * 16 + 3 AS f0, count(*) AS hits FROM s WHERE state <> 'IDLE' GROUP BY 1, 2, 3")
def a28b(spark, sf):
    return stacks.profile_stacks(stacks.profile_samples(ad.profile_trace(spark, sf))).groupBy("hostname", "state", F.col("stack")[0].alias("f0")).agg(F.sum("hits").alias("hits"))


@query("a33_ora_waits", SLEPT + "SELECT hostname, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'third' END AS wait, count(*) AS cnt, CAST(sum(ns) AS BIGINT) AS sleep_ns FROM sl WHERE k % 2 = 0 OR k % 3 = 0 GROUP BY 1, 2")
def a33(spark, sf):
    s = slept_of(spark, sf).withColumn("stack", F.array(F.expr("if(stack[0] div 16 % 2 = 0, 'kcevn_x', 'kcodd_x')"), F.expr("if(stack[0] div 16 % 3 = 0, 'thr_x', 'oth_x')")))
    return stacks.ora_waits(s, ("hostname",), "stack", [("even", "kcevn", None), ("third", "thr", "kcodd")]).select("hostname", "wait", "cnt", "sleep_ns")


@query("a33_ora_waits_by_frame", SLEPT + """, w AS (SELECT hostname, ns, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 7 = 0 THEN 'db async I/O' WHEN k % 5 = 2 THEN 'db file sequential read' WHEN k % 5 = 0 AND k % 2 = 0 THEN 'net from client'
      WHEN k % 5 = 1 AND k % 2 = 1 THEN 'gc current multi block read' WHEN k % 5 = 3 AND k % 2 = 1 THEN 'latch: sequence' END AS wait FROM sl)
SELECT hostname, wait, count(*) AS cnt, max(ns) AS max_ns, CAST(sum(ns) AS BIGINT) AS sleep_ns FROM w WHERE wait IS NOT NULL GROUP BY 1, 2""")
def a33b(spark, sf):
    """The rule tables over stacks made of the sleep function: a kernel frame, the mark, a frame that some rules need, and the frame of a rule; a fifth in an order that fits none."""
    k = F.col("_k")
    last = F.when(k % 5 == 0, "opitsk_main").when(k % 5 == 1, "kcbzibmlt").when(k % 5 == 2, "ksfdread").when(k % 5 == 3, "kdnwor").otherwise("main")
    need = F.when(k % 2 == 0, "snttread").otherwise(F.when(k % 5 == 3, "kslgetl").otherwise("epoll_wait"))
    s = slept_of(spark, sf).withColumn("_k", F.expr("get(stack, 0) div 16")).withColumn("stack", F.array(F.when(k % 7 == 0, "read_events").otherwise("schedule"), F.lit("<user>"), need, last))
    s = s.withColumn("stack", F.when(k % 5 == 4, F.array(F.lit("ksfdread"), F.lit("<user>"), F.lit("opitsk"), F.lit("snttread"))).otherwise(F.col("stack")))
    return stacks.ora_waits(s, ("hostname",), "stack", kernel_rules=stacks.DB_KERNEL_WAITS, user_mark="<user>").select("hostname", "wait", "cnt", "max_ns", "sleep_ns")


# Interrupts and power.

IRQ = f"""WITH {EV},
e AS (SELECT hostname, cpu, hrtime, cpu_seqno, k, CASE WHEN k % 2 = 0 THEN 'hard' ELSE 'soft' END AS kind, event_type = 'signup' AS entry FROM ev WHERE event_type IN ('signup', 'view')),
p AS (SELECT *, lag({{'e': entry, 't': hrtime, 'k': k}}) OVER (PARTITION BY hostname, cpu, kind ORDER BY hrtime, cpu_seqno) AS prev FROM e),
q AS (SELECT *, coalesce(NOT entry AND prev.e, false) AS closes FROM p),
h AS (SELECT *, coalesce(sum(CASE WHEN closes AND kind = 'hard' THEN hrtime - prev.t END) OVER (PARTITION BY hostname, cpu ORDER BY hrtime, cpu_seqno ROWS UNBOUNDED PRECEDING), 0) AS hard FROM q),
i AS (SELECT *, lag(hard) OVER (PARTITION BY hostname, cpu, kind ORDER BY hrtime, cpu_seqno) AS before FROM h),
pairs AS (SELECT hostname, cpu, kind, prev.k % 4 AS irq, prev.t AS start, hrtime AS "end", CAST(hrtime - prev.t - CASE WHEN kind = 'soft' THEN hard - coalesce(before, 0) ELSE 0 END AS BIGINT) AS time FROM i WHERE closes)
"""


def irqs_of(spark, sf):
    return power.pair_irq(ad.cpu_trace(spark, sf))


@query("j5_pair_irq", IRQ + "SELECT * FROM pairs")
def j5(spark, sf):
    return irqs_of(spark, sf).select("hostname", "cpu", "kind", "irq", "start", "end", "time")


@query("a29_irq_stats", IRQ + "SELECT hostname, kind, irq, count(*) AS cnt, CAST(sum(time) AS BIGINT) AS time_ns FROM pairs GROUP BY hostname, kind, irq")
def a29(spark, sf):
    return power.irq_stats(irqs_of(spark, sf)).select("hostname", "kind", "irq", "cnt", "time_ns")


@query("a30_power_stats", f"""WITH {EV},
b AS (SELECT hostname, min(hrtime) AS t0, max(hrtime) AS t1 FROM ev GROUP BY hostname),
e AS (SELECT ev.hostname, cpu, hrtime, CASE WHEN event_type = 'click' THEN 1 + k % 3 ELSE 0 END AS cstate, t0, coalesce(lead(hrtime) OVER w, t1) AS nxt, row_number() OVER w AS n FROM ev JOIN b ON b.hostname = ev.hostname WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY ev.hostname, cpu ORDER BY hrtime, cpu_seqno)),
i AS (SELECT hostname, cpu, 0 AS cstate, hrtime - t0 AS ns FROM e WHERE n = 1 UNION ALL SELECT hostname, cpu, cstate, nxt - hrtime FROM e),
f AS (SELECT hostname, cpu, count(*) FILTER (WHERE event_type <> 'error') AS events, count(*) FILTER (WHERE event_type = 'error') AS freq_changes, max(CASE WHEN event_type = 'error' THEN 1000000 + k * 1000 END) AS freq_hi FROM ev WHERE event_type IN ('click', 'purchase', 'error') GROUP BY hostname, cpu)
SELECT i.hostname, i.cpu, cstate, CAST(sum(ns) AS BIGINT) AS ns, max(events) AS events, max(freq_changes) AS freq_changes, max(freq_hi) AS freq_hi FROM i JOIN f ON f.hostname = i.hostname AND f.cpu = i.cpu GROUP BY 1, 2, 3""")
def a30(spark, sf):
    return power.power_stats(ad.cpu_trace(spark, sf)).select("hostname", "cpu", "cstate", "ns", "events", "freq_changes", "freq_hi")


# Wakeups.


def woken_of(spark, sf):
    return graph.wakeups(ad.task_trace(spark, sf))


EDGES = POINTS + ", ed AS (SELECT hostname, pid + 1 AS waker, pid AS sleeper, count(*) AS cnt, CAST(sum(CASE WHEN state = 'SWTCH' THEN ns ELSE 0 END) AS BIGINT) AS sleep_ns FROM ivn WHERE ended_by = 'wake' AND state = 'SWTCH' GROUP BY 1, 2, 3)\n"


@query("j15_wakeup_edges", EDGES + "SELECT * FROM ed")
def j15(spark, sf):
    e = graph.wakeup_edges(woken_of(spark, sf).where("known"))
    return e.groupBy("hostname", "waker", "sleeper").agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"))


@query("a37_waited_for", EDGES + "SELECT hostname, waker AS pid, CAST(sum(sleep_ns) AS BIGINT) AS ns FROM ed GROUP BY hostname, waker")
def a37(spark, sf):
    return graph.waited_for(graph.wakeup_edges(woken_of(spark, sf).where("known"))).select("hostname", "pid", "ns")


WOKEN = POINTS + """,
fi AS (SELECT ivn.*, t0, row_number() OVER (PARTITION BY ivn.hostname, pid ORDER BY start, cpu, cpu_seqno) AS n FROM ivn JOIN b ON b.hostname = ivn.hostname),
sl AS (SELECT hostname, pid AS sleeper, "end", ns AS sleep_ns, scall AS s_scall, CAST(k * 16 AS BIGINT) AS slpfunc FROM ivn WHERE ended_by = 'wake' AND state = 'SWTCH'
       UNION ALL SELECT hostname, pid, start, 0, -1, NULL FROM fi WHERE n = 1 AND kind = 'wake'),
ca AS (SELECT hostname, CASE event_type WHEN 'purchase' THEN usr + 1 ELSE usr END AS waker, usr AS sleeper, hrtime AS "end", cpu, cpu_seqno, event_type,
       CASE event_type WHEN 'signup' THEN {'no': k % 8, 'arg': k % 16} WHEN 'error' THEN {'no': -1, 'arg': NULL} END AS call FROM ev WHERE event_type IN ('signup', 'error', 'purchase')),
oc AS (SELECT *, last_value(call IGNORE NULLS) OVER (PARTITION BY hostname, waker ORDER BY "end", cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM ca),
wo AS (SELECT sl.hostname, sl.sleeper, sl.sleeper + 1 AS waker, coalesce(open.no, -1) AS w_scall, CAST(open.arg AS BIGINT) AS w_arg0, s_scall, slpfunc, sleep_ns
       FROM sl LEFT JOIN (SELECT * FROM oc WHERE event_type = 'purchase') oc ON oc.hostname = sl.hostname AND oc.sleeper = sl.sleeper AND oc."end" = sl."end")
"""


@query("a36_coop_tree", WOKEN + """SELECT hostname, sleeper, waker, w_scall, w_arg0, s_scall, slpfunc, count(*) AS cnt, CAST(sum(sleep_ns) AS BIGINT) AS sleep_ns, CAST(5 - bit_count(CAST(grouping(hostname, sleeper, waker, w_scall, w_arg0, s_scall, slpfunc) AS BIGINT)) AS INTEGER) AS level
FROM wo GROUP BY ROLLUP (hostname, sleeper, waker, w_scall, w_arg0, s_scall, slpfunc) HAVING grouping(hostname, sleeper, waker, w_scall, w_arg0, s_scall, slpfunc) < 32""")
def a36(spark, sf):
    return graph.coop_tree(graph.wakeup_edges(woken_of(spark, sf)))


@query("t6_top_n_per", EDGES + "SELECT hostname, waker, sleeper, sleep_ns FROM ed QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY sleep_ns DESC, waker, sleeper) <= 5")
def t6(spark, sf):
    return topn.top_n_per(j15(spark, sf), ["hostname"], "sleep_ns", 5, ["waker", "sleeper"]).select("hostname", "waker", "sleeper", "sleep_ns")


def graph_of(spark, sf):
    t = ad.task_trace(spark, sf)
    iv = states.task_state_intervals(t)
    totals = iv.groupBy("hostname", "pid").agg(F.sum(F.when(F.col("state") == "SWTCH", F.col("ns")).otherwise(0)).alias("sleep_total"))
    return graph.wait_graph(graph.wakeup_edges(graph.wakeups(t, iv)), totals, 20, 3, 1.0)


GRAPH = WOKEN + """,
tot AS (SELECT hostname, pid AS sleeper, sum(CASE WHEN state = 'SWTCH' THEN ns ELSE 0 END) AS total FROM ivn GROUP BY 1, 2),
ed AS (SELECT hostname, waker, sleeper, count(*) AS cnt, CAST(sum(sleep_ns) AS BIGINT) AS sleep_ns FROM wo WHERE waker NOT IN (0, -1) AND sleeper NOT IN (0, -1) GROUP BY 1, 2, 3),
e AS (SELECT ed.* FROM ed JOIN tot ON tot.hostname = ed.hostname AND tot.sleeper = ed.sleeper WHERE 100.0 * sleep_ns >= 1.0 * total),
bo AS (SELECT hostname, here, "to", max(sleep_ns) AS ns FROM (SELECT hostname, sleeper AS here, waker AS "to", sleep_ns FROM e UNION ALL SELECT hostname, waker, sleeper, sleep_ns FROM e) GROUP BY 1, 2, 3),
best AS (SELECT hostname, here, "to" FROM bo QUALIFY row_number() OVER (PARTITION BY hostname, here ORDER BY ns DESC, "to") <= 10),
n0 AS (SELECT DISTINCT hostname, CAST(20 AS BIGINT) AS pid, 0 AS depth FROM e),
n1 AS (SELECT * FROM n0 UNION ALL SELECT DISTINCT best.hostname, "to", 1 FROM n0 JOIN best ON best.hostname = n0.hostname AND here = pid WHERE (best.hostname, "to") NOT IN (SELECT (hostname, pid) FROM n0)),
n2 AS (SELECT * FROM n1 UNION ALL SELECT DISTINCT best.hostname, "to", 2 FROM n1 JOIN best ON best.hostname = n1.hostname AND here = pid WHERE depth = 1 AND (best.hostname, "to") NOT IN (SELECT (hostname, pid) FROM n1)),
n3 AS (SELECT * FROM n2 UNION ALL SELECT DISTINCT best.hostname, "to", 3 FROM n2 JOIN best ON best.hostname = n2.hostname AND here = pid WHERE depth = 2 AND (best.hostname, "to") NOT IN (SELECT (hostname, pid) FROM n2))
"""


@query("a38_wait_graph_nodes", GRAPH + "SELECT * FROM n3")
def a38(spark, sf):
    return graph_of(spark, sf)[0]


@query("a38_wait_graph_links", GRAPH + "SELECT * FROM e WHERE (hostname, waker) IN (SELECT (hostname, pid) FROM n3) AND (hostname, sleeper) IN (SELECT (hostname, pid) FROM n3)")
def a38b(spark, sf):
    return graph_of(spark, sf)[1]


# Dimensions.


@query("j10_inherit_from_group", f"WITH {EV}, t AS (SELECT DISTINCT hostname, usr AS pid, usr - usr % 4 AS tgid FROM ev) SELECT t.hostname, pid, tgid, 'Customer#' || lpad(CAST(CASE WHEN pid % 3 = 0 THEN pid ELSE tgid END AS VARCHAR), 9, '0') AS cmd FROM t WHERE pid % 3 = 0 OR (tgid % 3 = 0 AND tgid % 2 = pid % 2)")
def j10(spark, sf):
    t = ad.flat_events(spark, sf).select("hostname", F.col("usr").alias("pid"), F.expr("usr - usr % 4").alias("tgid")).distinct()
    d = ad.table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.expr("concat('h', c_custkey % 2)").alias("hostname"), F.col("c_custkey").alias("pid"), F.col("c_name").alias("cmd"))
    return dims.inherit_from_group(t, d, ["cmd"]).where("cmd is not null")


@query("j14_with_topology", f"WITH {EV} SELECT hostname, cpu // 2 AS ldom, count(*) AS n FROM ev GROUP BY 1, 2")
def j14(spark, sf):
    return dims.with_topology(ad.flat_events(spark, sf), ad.topology(spark)).groupBy("hostname", "ldom").agg(F.count("*").alias("n"))


@query("j17_flows_with_hosts", f"WITH {FLOWS} SELECT lip, coalesce(n_name, rip) AS dest, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM fl LEFT JOIN nation ON rip = '10.0.1.' || n_nationkey AND n_regionkey < 3 GROUP BY 1, 2")
def j17(spark, sf):
    ips = ad.table(spark, sf, "nation").where("n_regionkey < 3").select(F.expr("concat('10.0.1.', n_nationkey)").alias("ip"), F.col("n_name").alias("hostname"))
    return dims.flows_with_hosts(ad.flows(spark, sf), ips).groupBy("lip", "dest").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("j18_snapshot_diff", """WITH o AS (SELECT o_custkey AS c, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
a AS (SELECT o_custkey AS c, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT a.c, a.n - coalesce(o.n, 0) AS n, a.v - coalesce(o.v, 0) AS v, CASE WHEN o.c IS NULL THEN '***' ELSE '' END AS flag FROM a LEFT JOIN o ON a.c = o.c WHERE o.c IS NULL OR a.n <> o.n OR a.v <> o.v""")
def j18(spark, sf):
    snap = lambda day: ad.table(spark, sf, "orders").where(f"o_orderdate < timestamp_ntz '{day}'").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"), F.sum(F.expr("bigint(floor(o_totalprice))")).alias("v"))
    return dims.snapshot_diff(snap("1996-01-01"), snap("1998-01-01"), ["c"], ["n", "v"]).select("c", "n", "v", "flag")


# Column expressions.


@query("c1_decode_flags", "SELECT o_orderkey, CASE WHEN o_custkey % 8 = 0 THEN 'RUN' ELSE array_to_string(list_filter([CASE WHEN o_custkey % 2 = 1 THEN 'INTERRUPTIBLE' END, CASE WHEN o_custkey // 2 % 2 = 1 THEN 'UNINTERRUPTIBLE' END, CASE WHEN o_custkey // 4 % 2 = 1 THEN 'STOPPED' END], lambda x: x IS NOT NULL), '|') END AS state FROM orders")
def c1(spark, sf):
    return ad.table(spark, sf, "orders").select("o_orderkey", sc.task_state_str(F.expr("o_custkey % 8")).alias("state"))


@query("c2_decode_enum", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'SEEK_SET' WHEN 1 THEN 'SEEK_CUR' WHEN 2 THEN 'SEEK_END' ELSE '3' END AS whence FROM lineitem")
def c2(spark, sf):
    return ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sc.decode_enum(F.expr("l_linenumber % 4"), sc.WHENCE).alias("whence"))


def names_sql(value, names):
    """The name of a number, or the number itself."""
    return f"CASE {value} {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in names.items())} ELSE CAST({value} AS VARCHAR) END"


ENUMS = {"sig": ("l_orderkey % 40", sc.SIGNALS), "fcntl": ("l_partkey % 45", sc.FCNTL), "fcntl_linux": ("1020 + l_suppkey % 25", sc.FCNTL), "semctl": ("l_suppkey % 24", sc.SEMCTL), "ipc": ("l_orderkey % 28", sc.IPC_CALLS), "futex": ("l_partkey % 16", sc.FUTEX_OPS),
         "domain": ("l_linenumber * 5 % 20", sc.SOCKET_DOMAINS), "socket": ("l_linenumber % 12", sc.SOCKET_TYPES)}


@query("c2_decode_all", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{names_sql(v, t)} AS {n}' for n, (v, t) in ENUMS.items())} FROM lineitem")
def c2b(spark, sf):
    return ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[sc.decode_enum(F.expr(v), t).alias(n) for n, (v, t) in ENUMS.items()])


@query("c3_ip_port_str", "SELECT o_orderkey, (o_orderkey // 16777216 % 256) || '.' || (o_orderkey // 65536 % 256) || '.' || (o_orderkey // 256 % 256) || '.' || (o_orderkey % 256) || ':' || o_custkey AS addr FROM orders")
def c3(spark, sf):
    return ad.table(spark, sf, "orders").select("o_orderkey", sc.ip_port_str(sc.ipv4_str(F.col("o_orderkey")), F.col("o_custkey")).alias("addr"))


@query("c4_fmt_dev", "SELECT o_orderkey, '0x' || lower(lpad(hex(o_orderkey), 8, '0')) AS dev, o_orderkey >> 20 AS major FROM orders")
def c4(spark, sf):
    return ad.table(spark, sf, "orders").select("o_orderkey", sc.fmt_dev(F.col("o_orderkey")).alias("dev"), sc.dev_major(F.col("o_orderkey")).alias("major"))


@query("c5_units", f"WITH {EV} SELECT cpu_seqno, hrtime // 1000 AS us, k / 2 AS kb, k / 2048 AS mb FROM ev")
def c5(spark, sf):
    return ad.flat_events(spark, sf).select("cpu_seqno", F.expr("hrtime div 1000").alias("us"), sc.kbytes(F.col("k")).alias("kb"), sc.mbytes(F.col("k")).alias("mb"))


@query("c6_stack_str", f"WITH {EV} SELECT cpu_seqno, (k * 16) || ' ' || (k % 7 * 1600 + 5) || ' 1' AS stack FROM ev WHERE event_type = 'click'")
def c6(spark, sf):
    return ad.task_trace(spark, sf).where("sw.ips is not null").select("cpu_seqno", sc.stack_str(F.col("sw.ips")).alias("stack"))


@query("c7_keys", FUT + "SELECT space, addr, count(*) AS n FROM c GROUP BY space, addr")
def c7(spark, sf):
    c = syscalls.pair_syscalls(ad.futex_trace(spark, sf)).withColumn("key", sc.futex_key(F.col("tgid"), F.col("args")[0], F.col("args")[1]))
    return c.groupBy("key").agg(F.count("*").alias("n")).select("key.space", "key.addr", "n")


@query("c8_errors", CALLS + "SELECT hostname, CASE WHEN err = 1 THEN -ret END AS errno, count(*) AS n FROM calls2 GROUP BY 1, 2")
def c8(spark, sf):
    return calls_of(spark, sf).groupBy("hostname", sc.errno(F.col("ret")).alias("errno")).agg(F.count("*").alias("n"))


# Second profile, rules, reports, sinks, streams.


def win_events(spark, sf):
    """The events table as events of the second profile; what a column means depends on the kind."""
    e = ad.flat_events(spark, sf)
    return e.select(
        "hostname", "hrtime", "cpu", "cpu_seqno", F.col("usr").alias("pid"), "k", "value", "event_type", F.col("usr").alias("old_tid"), F.expr("usr + 1").alias("new_tid"), F.expr("if(k % 3 = 0, 'Ready', 'Waiting')").alias("old_state"), F.expr("concat('reason', k % 4)").alias("wait_reason"),
        F.expr("usr").alias("tid"), F.expr("array(bigint(k))").alias("stack"), F.expr("bigint(k % 10)").alias("caller"), F.expr("bigint(k)").alias("spins"), F.expr("bigint(k * 3)").alias("wait_cycles"), F.expr("bigint(k * 5)").alias("held_cycles"), F.expr("k % 4").alias("vector"), F.expr("concat('r', k % 4)").alias("routine"),
        F.expr("bigint(k * 100)").alias("duration"), F.expr("bigint(k % 6)").alias("dev"), F.expr("bigint(k * 8)").alias("sector"), F.expr("bigint(k * 512 + 512)").alias("bytes"), F.expr("bigint(k + 1)").alias("response_ticks"), F.expr("bigint(k % 9)").alias("file_object"), F.expr("concat('f', k)").alias("file_name"),
        F.expr("bigint(k * 16 + 3)").alias("pc"), F.expr("k % 2 = 0").alias("user"), F.expr("k % 11 = 0").alias("dpc"), F.expr("concat('10.0.0.', usr % 3)").alias("lip"), F.expr("1000 + k % 4").alias("lport"), F.expr("concat('10.0.1.', k % 5)").alias("rip"), F.expr("80 + k % 2").alias("rport"), F.expr("bigint(k % 50)").alias("address"),
    )


def fitted(df):
    """Sums of a few hosts (decimal(38,0)) as BIGINT, which their SQL casts to; where one does not fit, and SQL gives an error, that column stays decimal(38,0) and exact."""
    wide = [c for c, t in df.dtypes if t == "decimal(38,0)"]
    if not wide:
        return df
    df = settled(df)
    fits = df.agg(*[F.expr(f"coalesce(max(abs({c})) <= {2**63 - 1}, true)").alias(c) for c in wide]).first()
    return df.withColumns({c: F.col(c).cast("bigint") for c in wide if fits[c]})


def named(df, **kinds):
    """Rows of the given event types under the names that an operator of the second profile knows."""
    name = F.lit(None)
    for old, new in kinds.items():
        name = F.when(F.col("event_type") == old, new).otherwise(name)
    return df.withColumn("event", name).where("event is not null")


from .operators import win  # noqa: E402


WIN = f"""WITH {EV},
w AS (SELECT *, CASE WHEN lead(event_type) OVER c = 'view' THEN lead(k) OVER c END AS frame FROM ev WHERE event_type IN ('click', 'purchase', 'view') WINDOW c AS (PARTITION BY hostname, cpu ORDER BY hrtime, cpu_seqno)),
t AS (SELECT * FROM w WHERE event_type <> 'view'),
b AS (SELECT hostname, max(hrtime) AS t1 FROM t GROUP BY hostname),
pt AS (SELECT hostname, hrtime, cpu, cpu_seqno, usr AS pid, CASE event_type WHEN 'click' THEN 'out' ELSE 'wake' END AS kind, k, frame FROM t UNION ALL SELECT hostname, hrtime, cpu, cpu_seqno, usr + 1, 'in', NULL, NULL FROM t WHERE event_type = 'click'),
r AS (SELECT *, last_value(CASE kind WHEN 'in' THEN 1 WHEN 'out' THEN 0 END IGNORE NULLS) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM pt WHERE pid > 0),
iv AS (
  SELECT r.hostname, pid, CASE WHEN kind = 'in' THEN 'RUNNING' WHEN kind = 'wake' OR k % 3 = 0 THEN 'RUNQ' ELSE 'SWTCH' END AS state, coalesce(lead(hrtime) OVER p, t1) - hrtime AS ns, lead(kind) OVER p AS ended_by, k, frame
  FROM r JOIN b ON b.hostname = r.hostname WHERE NOT (kind = 'wake' AND coalesce(running, 0) = 1) WINDOW p AS (PARTITION BY r.hostname, pid ORDER BY hrtime, cpu, cpu_seqno))
"""


@query("x1_win_states", WIN + "SELECT hostname, state, count(*) AS n, CAST(sum(ns) AS BIGINT) AS ns FROM (SELECT hostname, state, ns FROM iv UNION ALL SELECT DISTINCT ON (hostname, pid) hostname, 'N', 0 FROM iv) GROUP BY 1, 2")
def x1(spark, sf):
    return fitted(win.task_state_intervals(named(win_events(spark, sf), click="cswitch", purchase="ready", view="stack")).groupBy("hostname", "state").agg(F.count("*").alias("n"), states.wide_sum("ns").alias("ns")))


@query("x2_wait_reasons", WIN + "SELECT hostname, CAST(frame AS BIGINT) AS frame, 'reason' || (k % 4) AS wait_reason, count(*) AS cnt, CAST(sum(ns) AS BIGINT) AS sleep_ns, max(ns) AS max_ns FROM iv WHERE state = 'SWTCH' AND ended_by = 'wake' GROUP BY 1, 2, 3")
def x2(spark, sf):
    return win.wait_reasons(win.task_state_intervals(named(win_events(spark, sf), click="cswitch", purchase="ready", view="stack")))


@query("x3_nested_syscalls", f"""WITH {EV},
e AS (SELECT hostname, usr AS pid, hrtime, cpu_seqno, CAST(k % 50 AS BIGINT) AS address, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS step FROM ev WHERE event_type IN ('signup', 'error')),
s AS (SELECT *, sum(step) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu_seqno ROWS UNBOUNDED PRECEDING) AS s FROM e),
l AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu_seqno ROWS UNBOUNDED PRECEDING)) + CASE step WHEN 1 THEN 0 ELSE 1 END AS depth FROM s),
o AS (SELECT *, lag({{'s': step, 't': hrtime, 'a': address}}) OVER (PARTITION BY hostname, pid, depth ORDER BY hrtime, cpu_seqno) AS op FROM l)
SELECT hostname, pid, op.a AS address, op.t AS enter, hrtime AS exit, hrtime - op.t AS elapsed, CAST(depth AS BIGINT) AS depth FROM o WHERE step = -1 AND op.s = 1""")
def x3(spark, sf):
    return win.pair_syscalls_nested(named(win_events(spark, sf), signup="sys_enter", error="sys_exit"))


@query("x4_spin_stats", f"WITH {EV} SELECT hostname, CAST(k % 10 AS BIGINT) AS caller, count(*) AS cnt, CAST(sum(k) AS BIGINT) AS spins, CAST(sum(k * 3) AS BIGINT) AS wait_cycles, CAST(sum(k * 5) AS BIGINT) AS held_cycles FROM ev WHERE event_type = 'click' GROUP BY 1, 2")
def x4(spark, sf):
    return win.spin_stats(named(win_events(spark, sf), click="spinlock"))


@query("x5_isr_dpc", f"WITH {EV} SELECT hostname, CASE event_type WHEN 'click' THEN 'hard' ELSE 'soft' END AS kind, k % 4 AS irq, count(*) AS cnt, CAST(sum(k * 100) AS BIGINT) AS time_ns FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3")
def x5(spark, sf):
    return win.isr_dpc_stats(named(win_events(spark, sf), click="isr", view="dpc")).select("hostname", "kind", "irq", "cnt", "time_ns")


@query("x6_profile", f"WITH {EV}, s AS (SELECT hostname, cpu, CASE WHEN k % 11 = 0 THEN 'INTR' WHEN usr = 0 THEN 'IDLE' WHEN k % 2 = 0 THEN 'USER' ELSE 'SYS' END AS state FROM ev WHERE event_type = 'view') SELECT hostname, cpu, count(*) AS total, count(*) FILTER (WHERE state = 'USER') AS usr, count(*) FILTER (WHERE state = 'SYS') AS sys, count(*) FILTER (WHERE state = 'IDLE') AS idle, count(*) FILTER (WHERE state = 'INTR') AS intr FROM s GROUP BY 1, 2")
def x6(spark, sf):
    return stacks.profile_states(win.profile_samples(named(win_events(spark, sf), view="sample"))).select("hostname", "cpu", "total", "usr", "sys", "idle", "intr")


@query("x7_disk", f"""WITH {EV}, d AS (SELECT hostname, CAST(k % 6 AS BIGINT) AS dev, unnest([CASE event_type WHEN 'click' THEN 0 ELSE 1 END, NULL]) AS rw, CAST((k + 1) AS BIGINT) * 1000000000 // 1000000 AS serv, k + 1 AS sectors FROM ev WHERE event_type IN ('click', 'view'))
SELECT hostname, dev, rw, count(*) AS ios, CAST(sum(sectors) AS BIGINT) AS sectors, CAST(sum(serv) AS BIGINT) AS serv_ns, max(serv) AS max_serv_ns FROM d GROUP BY 1, 2, 3""")
def x7(spark, sf):
    return win.io_stats(named(win_events(spark, sf), click="disk_read", view="disk_write"), 1_000_000).select("hostname", "dev", "rw", "ios", "sectors", "serv_ns", "max_serv_ns")


@query("x8_fileobj", f"WITH {EV}, e AS (SELECT hostname, usr AS pid, CAST(k % 9 AS BIGINT) AS file_object, event_type, k, last_value(CASE WHEN event_type = 'signup' THEN 'f' || k END IGNORE NULLS) OVER (PARTITION BY hostname, k % 9 ORDER BY hrtime, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS name FROM ev WHERE event_type IN ('click', 'view', 'signup')) SELECT hostname, pid, file_object, name, count(*) FILTER (WHERE event_type = 'click') AS reads, count(*) FILTER (WHERE event_type = 'view') AS writes FROM e WHERE event_type <> 'signup' GROUP BY 1, 2, 3, 4")
def x8(spark, sf):
    return win.fileobj_stats(named(win_events(spark, sf), click="file_read", view="file_write", signup="file_name")).select("hostname", "pid", "file_object", "name", "reads", "writes")


@query("x9_net", f"WITH {EV} SELECT hostname, '10.0.0.' || (usr % 3) AS lip, count(*) AS n, CAST(sum(k * 512 + 512) AS BIGINT) AS bytes FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def x9(spark, sf):
    s = win.net_stats(named(win_events(spark, sf), click="send", view="recv")).where("level = 'lip'")
    return s.select("hostname", "lip", (F.col("rx") + F.col("tx")).alias("n"), (F.col("rx_bytes") + F.col("tx_bytes")).alias("bytes"))


@query("x10_tcp_events", f"WITH {EV} SELECT hostname, '10.0.0.' || (usr % 3) AS lip, 1000 + k % 4 AS lport, '10.0.1.' || (k % 5) AS rip, 80 + k % 2 AS rport, count(*) FILTER (WHERE event_type = 'click') AS connect, count(*) FILTER (WHERE event_type = 'view') AS retransmit FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3, 4, 5")
def x10(spark, sf):
    return win.tcp_events(named(win_events(spark, sf), click="connect", view="retransmit")).select("hostname", "lip", "lport", "rip", "rport", "connect", "retransmit")


@query("x11_dims", f"WITH {EV} SELECT hostname, usr AS pid, arg_max('f' || k, (hrtime, cpu_seqno)) AS name FROM ev WHERE event_type = 'click' GROUP BY 1, 2")
def x11(spark, sf):
    d = named(win_events(spark, sf), click="service").withColumnRenamed("file_name", "name").withColumns({"parent": F.lit(0), "base": F.lit(0), "size": F.lit(0)})
    return win.win_dims(d)["services"]


from .plans import reports, rules  # noqa: E402


@query("d1_rules_cpu", CPU + "SELECT hostname, 'cpu_bottleneck' AS code FROM (SELECT hostname, sum(idle_ns) AS i, sum(idle_ns + busy_ns) AS t FROM cpus GROUP BY hostname) WHERE 100.0 * i / t < 60")
def d1(spark, sf):
    return rules.rules_cpu(states.global_cpu_time(cpus_of(spark, sf)), None, 60.0, 101.0).select("hostname", "code")


@query("d2_rules_runq", LAT + "SELECT hostname, CAST(pid AS VARCHAR) AS evidence FROM lat GROUP BY hostname, pid HAVING max(latency_us) > 100000")
def d2(spark, sf):
    return rules.rules_runq(states.runq_stats(latencies_of(spark, sf))).select("hostname", "evidence")


@query("d3_rules_disk", REQS + "SELECT hostname, CAST(dev AS VARCHAR) AS evidence FROM st WHERE rw IS NULL AND serv_ns / ios / 1e6 > 95000000")
def d3(spark, sf):
    return rules.rules_disk(blockio.io_stats(io_of(spark, sf)), serv_ms=95_000_000.0).where("code = 'disk_service'").select("hostname", "evidence")


@query("d4_rules_irq", IRQ + """, g AS (SELECT hostname, irq, sum(time) / 1e9 / 86400 AS cores, count(*) * 100000 AS cnt FROM pairs GROUP BY hostname, kind, irq)
SELECT hostname, CASE WHEN irq % 2 = 0 THEN 'tasklets' ELSE 'block_softirq' END AS code, CAST(round(cores, 2) AS VARCHAR) AS evidence FROM g WHERE (irq % 2 = 0 AND cnt > 100000 AND cores > 0.5) OR (irq % 2 = 1 AND cnt > 10000 AND cores > 1)""")
def d4(spark, sf):
    s = power.irq_stats(irqs_of(spark, sf)).withColumns({"name": F.expr("if(irq % 2 = 0, 'TASKLET', 'BLOCK')"), "cnt": F.expr("cnt * 100000")})
    return rules.rules_irq(s, 86_400.0)


@query("d5_rules_profile", PROF + ", f AS (SELECT hostname, state, p_name AS func, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY hostname) AS pct FROM s JOIN part ON p_partkey = k WHERE state <> 'IDLE' GROUP BY 1, 2, 3) SELECT hostname, func AS evidence FROM f WHERE func LIKE 'small%' AND pct > 1")
def d5(spark, sf):
    f = stacks.profile_funcs(stacks.symbolize(stacks.profile_samples(ad.profile_trace(spark, sf)), ad.symbols(spark, sf), "pc"))
    return rules.rules_profile(f, [("small%", 1.0, 0, "hot_function")]).select("hostname", "evidence")


@query("d6_rules_stack", "SELECT hostname, 'hot_stack' AS code, 'the' AS evidence FROM (SELECT DISTINCT 'h' || (conv_id % 2) AS hostname, text FROM conversations) WHERE len(list_intersect(string_split(text, ' '), ['the', 'of', 'de', 'la', 'der'])) >= 2")
def d6(spark, sf):
    words = ad.table(spark, sf, "conversations").select(F.expr("concat('h', conv_id % 2)").alias("hostname"), F.split("text", " ").alias("stack")).groupBy("hostname", "stack").agg(F.count("*").alias("hits"))
    return rules.rules_stack(words, "hits", [(["the", "of", "de", "la", "der"], 1, "hot_stack")])


@query("d7_rules_syscall", CALLS + "SELECT hostname, CAST(sum(err) AS BIGINT)::VARCHAR AS evidence FROM calls2 WHERE syscallno = 5 GROUP BY hostname HAVING sum(err) > 100")
def d7(spark, sf):
    return rules.rules_syscall(syscalls.syscall_stats(calls_of(spark, sf), "host"), semget=5).where("code = 'semget_errors'").select("hostname", "evidence")


@query("d8_rules_host", "SELECT 'h' || (s_suppkey % 2) AS hostname, s_name AS evidence FROM supplier WHERE s_acctbal < 100")
def d8(spark, sf):
    facts = ad.table(spark, sf, "supplier").select(F.expr("concat('h', s_suppkey % 2)").alias("hostname"), F.lit("node_free_mb").alias("kind"), F.col("s_name").alias("key"), F.col("s_acctbal").cast("string").alias("value"))
    return rules.rules_host(facts).where("code = 'node_free'").select("hostname", "evidence")


def all_events(spark, sf):
    """Every kind of event that the adapters make, as one trace that tells the part of each event: whoever reads some parts does not make the events of other adapters."""
    event = reports.part_of(F.col("event"))
    told = [(ad.task_trace, event), (ad.block_trace, F.lit("blk")), (ad.profile_trace, F.lit("hc")), (ad.cpu_trace, event), (ad.memory_trace, F.lit("pgc"))]
    parts = [make(spark, sf).withColumn("part", part) for make, part in told]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Interrupts of the example traces have names that no rule asks for.
D9 = f"""WITH f AS (
  SELECT hostname, 'power_saving' AS code, CAST(cstate AS VARCHAR) AS evidence FROM ({sql_of('a30_power_stats')}) WHERE cstate > 1 AND ns > 0
  UNION ALL SELECT hostname, 'runq_delay', evidence FROM ({sql_of('d2_rules_runq')})
  UNION ALL SELECT hostname, 'disk_service', CAST(dev AS VARCHAR) FROM ({REQS} SELECT * FROM st) WHERE rw IS NULL AND serv_ns / ios / 1e6 > 30
  UNION ALL SELECT hostname, 'block_rereads', CAST(dev AS VARCHAR) FROM ({sql_of('a26_hot_blocks')}) WHERE rw = 0 AND n > 50
  UNION ALL SELECT hostname, 'short_polls', CAST(cnt AS VARCHAR) FROM ({sql_of('a15_syscall_stats')}) WHERE syscallno = 7 AND cnt > 10000 AND elapsed_ns / cnt < 2000
  UNION ALL SELECT hostname, 'cpu_bottleneck', CAST(round(100.0 * sum(idle_ns) / sum(idle_ns + busy_ns), 2) AS VARCHAR) FROM ({sql_of('a3_cpu_time')}) GROUP BY hostname HAVING 100.0 * sum(idle_ns) / sum(idle_ns + busy_ns) < 10)
SELECT hostname, code, CASE code {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in rules.MESSAGES.items())} END AS severity,
       CASE code {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in rules.MESSAGES.items())} END AS message, min(evidence) AS evidence, count(*) AS n FROM f GROUP BY hostname, code"""


@query("d9_findings", D9)
def d9(spark, sf):
    return reports.host_findings(reports.Shared(all_events(spark, sf), ad.topology(spark), once=True), seconds=86_400.0)


def section(name, part, trace=None, cols=None):
    """A registered query for one section of a report over a trace."""

    def run(spark, sf):
        t, top = (trace or all_events)(spark, sf), ad.topology(spark)
        s = reports.Shared(t, top, once=True)  # one section: neither a staged copy of the trace nor kept requests
        found = {"p1": lambda: reports.host_report(t, top, devices=devices(spark, sf), shared=s), "p2": lambda: reports.all_reports(t, top, shared=s), "p3": lambda: reports.task_report(t, top, 20, shared=s), "p4": lambda: reports.cluster_report(t, top, shared=s)}[name]()
        return fitted(found[part].select(*cols) if cols else found[part])

    return run


DISKS = """SELECT hostname, dev, rw, ios, sectors, wait_ns, serv_ns, waits, seq, CAST(0 AS BIGINT) AS requeues, CAST(0 AS BIGINT) AS barriers, max_wait_ns, max_serv_ns, sectors / 2 AS kb, rnd,
serv_ns / ios / 1e6 AS avserv_ms, CASE WHEN waits > 0 THEN wait_ns / waits / 1e6 ELSE 0.0 END AS avwait_ms, sectors // 2 // ios AS avsz_kb FROM st"""
RUNQ = LAT + """, lc AS (SELECT *, last_value(CASE WHEN kind <> 'wake' THEN cpu END IGNORE NULLS) OVER (PARTITION BY hostname, pid ORDER BY hrtime, cpu, cpu_seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_cpu FROM q),
la AS (SELECT hostname, cpu, (hrtime - ready) // 1000 AS us, coalesce(cpu <> last_cpu, false) AS moved, coalesce(cpu // 2 <> last_cpu // 2, false) AS left_node FROM lc WHERE kind = 'in' AND old = 'Q')
SELECT hostname, cpu, count(*) AS cnt, CAST(sum(us) AS BIGINT) AS total_us, CAST(sum(us) AS BIGINT) // count(*) AS avg_us, max(us) AS max_us, count(*) FILTER (WHERE moved) AS migrations, count(*) FILTER (WHERE left_node) AS node_migrations FROM la GROUP BY 1, 2"""

for _name, _part, _sql in (
    ("p1", "2.2.2 run-queue statistics", RUNQ), ("p1", "4.2.1 busiest disks", REQS + DISKS + " WHERE rw IS NULL ORDER BY ios DESC, hostname, dev LIMIT 20"), ("p2", "disk", REQS + DISKS), ("p3", "scheduler activity", None), ("p4", "tasks by run time", None),
):
    query(f"{_name}_{_part.split(' ', 1)[-1].replace(' ', '_').replace('-', '_')}", _sql)(section(_name, _part))


def task_and_block(spark, sf):
    return ad.task_trace(spark, sf).unionByName(ad.block_trace(spark, sf))


def runq_sql(keys):
    """Run-queue statistics by other keys."""
    return RUNQ.split("SELECT hostname, cpu, count(*) AS cnt")[0].replace("(SELECT hostname, cpu, (hrtime", "(SELECT hostname, pid, cpu, (hrtime") + f"""SELECT {keys}, count(*) AS cnt, CAST(sum(us) AS BIGINT) AS total_us, CAST(sum(us) AS BIGINT) // count(*) AS avg_us,
max(us) AS max_us, count(*) FILTER (WHERE moved) AS migrations, count(*) FILTER (WHERE left_node) AS node_migrations FROM la GROUP BY ALL"""


RUNQ_LEVELS = runq_sql("hostname, pid, cpu, CASE grouping(hostname, pid, cpu) WHEN 0 THEN 'pid_cpu' WHEN 1 THEN 'pid' WHEN 2 THEN 'cpu' ELSE 'host' END AS level").replace(
    "GROUP BY ALL", "GROUP BY GROUPING SETS ((hostname, pid, cpu), (hostname, pid), (hostname, cpu), (hostname))").replace(", count(*) FILTER (WHERE left_node) AS node_migrations", "")
EVENT_LEVELS = f"""WITH {EV}, {IO},
t AS (SELECT hostname, CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN usr + 1 ELSE usr END AS pid, CASE event_type WHEN 'signup' THEN 'sys_enter' WHEN 'error' THEN 'sys_exit' WHEN 'purchase' THEN 'sched_wakeup' ELSE 'sched_switch' END AS event FROM ev
      UNION ALL SELECT hostname, pid, event FROM bt)
SELECT hostname, CASE grouping(hostname, pid, event) WHEN 0 THEN 'pid_event' WHEN 1 THEN 'pid' WHEN 2 THEN 'event' ELSE 'host' END AS level, pid, event, count(*) AS n
FROM t GROUP BY GROUPING SETS ((hostname), (hostname, event), (hostname, pid), (hostname, pid, event))"""
HOST_IO = REQS + """SELECT hostname, rw, CAST(sum(ios) AS BIGINT) AS ios, CAST(sum(sectors) AS BIGINT) AS sectors, CAST(sum(wait_ns) AS BIGINT) AS wait_ns, CAST(sum(serv_ns) AS BIGINT) AS serv_ns,
CAST(sum(waits) AS BIGINT) AS waits, CAST(sum(seq) AS BIGINT) AS seq, max(max_wait_ns) AS max_wait_ns, max(max_serv_ns) AS max_serv_ns FROM st GROUP BY hostname, rw"""
HOST_IO_COLS = ["hostname", "rw", "ios", "sectors", "wait_ns", "serv_ns", "waits", "seq", "max_wait_ns", "max_serv_ns"]
TASK_IO = REQS.replace("AS sequential FROM rq)", "AS sequential FROM rq WHERE issue_pid = 20)") + "SELECT hostname, dev, rw, ios, sectors, wait_ns, serv_ns, waits, seq, max_wait_ns, max_serv_ns, rnd FROM st"
CPU_COLS = ["hostname", "ldom", "cpu", "idle_ns", "busy_ns", "switches"]
NODE_COLS = ["hostname", "n_cpus", "idle_ns", "busy_ns"]
WAIT_COLS = ["hostname", "pid", "frame", "cnt", "sleep_ns", "max_ns"]
FUTEX_COLS = ["hostname", "space", "addr", "cnt", "eagain", "etimedout", "other_err", "elapsed_ns", "max_ns"]
IRQ_COLS = ["hostname", "kind", "irq", "cnt", "time_ns"]
FILE_COLS = ["hostname", "dev", "node", "syscalls", "elapsed_ns", "reads", "writes", "errs", "bytes", "opens"]


def first(by, tie="hostname, pid"):
    return f"ORDER BY {by} DESC, {tie} LIMIT 20"


#: Report, section, trace, SQL (or the query whose SQL it is), what the section takes of it, columns (all if none are named).
SECTIONS = [
    ("p1", "1.1.1 per CPU", ad.task_trace, "a3_cpu_time", "", CPU_COLS),
    ("p1", "1.1.2 per node", ad.task_trace, "a4_node_cpu_time", "WHERE ldom IS NOT NULL", ["hostname", "ldom", *NODE_COLS[1:]]),
    ("p1", "1.1.4 hyper-threads", ad.task_trace, "a5_ht_usage", "", None),
    ("p1", "1.2.1 tasks by run time", ad.task_trace, "a2_task_cpu", first("run_ns"), TASK_COLS),
    ("p1", "1.2.2 tasks by system time", ad.task_trace, "a2_task_cpu", first("sys_ns"), TASK_COLS),
    ("p1", "1.3.1 event types", ad.task_trace, "a31_trace_counts", "", ["hostname", "event", "n", "pct"]),
    ("p1", "1.4.2 profile by CPU", ad.profile_trace, "a27_profile_states", "", ["hostname", "cpu", "total", "usr", "sys", "idle", "intr"]),
    ("p1", "1.6.1 hard IRQ", ad.cpu_trace, "a29_irq_stats", "WHERE kind = 'hard'", IRQ_COLS),
    ("p1", "1.6.3 soft IRQ", ad.cpu_trace, "a29_irq_stats", "WHERE kind = 'soft'", IRQ_COLS),
    ("p1", "2.1.3 tasks by sleeps", ad.task_trace, "a2_task_cpu", first("sleeps"), TASK_COLS),
    ("p1", "2.2.3 tasks by run-queue time", ad.task_trace, "a2_task_cpu", first("runq_ns"), TASK_COLS),
    ("p1", "2.3.1 futex by count", ad.futex_trace, "a22_futex_stats", first("cnt", "hostname, space, addr"), ["hostname", "space", "addr", "cnt", "eagain", "etimedout", "other_err", "elapsed_ns", "max_ns"]),
    ("p1", "2.3.2 futex by time", ad.futex_trace, "a22_futex_stats", first("elapsed_ns", "hostname, space, addr"), ["hostname", "space", "addr", "cnt", "eagain", "etimedout", "other_err", "elapsed_ns", "max_ns"]),
    ("p1", "3.1 files by calls", ad.task_trace, "a18_file_stats", first("syscalls", "hostname, dev, node"), FILE_COLS),
    ("p1", "3.2 files by time", ad.task_trace, "a18_file_stats", first("elapsed_ns", "hostname, dev, node"), FILE_COLS),
    ("p1", "4.1 global I/O", ad.block_trace, HOST_IO, "", HOST_IO_COLS),
    ("p1", "4.2.4 wait time", ad.block_trace, REQS + DISKS, "WHERE rw IS NULL " + first("avwait_ms", "hostname, dev"), None),
    ("p1", "4.8 block re-reads", ad.block_trace, "a26_hot_blocks", "WHERE rw = 0 AND n >= 3", ["hostname", "dev", "sector", "rw", "n"]),
    ("p1", "4.9 block re-writes", ad.block_trace, "a26_hot_blocks", "WHERE rw = 1 AND n >= 3", ["hostname", "dev", "sector", "rw", "n"]),
    ("p1", "6.2 resident size", ad.task_trace, "a35_mem_top", first("rss"), None),
    ("p2", "task", ad.task_trace, "a2_task_cpu", "", TASK_COLS),
    ("p2", "runq", ad.task_trace, runq_sql("hostname, pid, cpu"), "", None),
    ("p2", "wait", ad.task_trace, "a11_sleep_funcs", "", WAIT_COLS),
    ("p2", "syscall", ad.task_trace, "a15_syscall_stats", "", ["hostname", "pid", "syscallno", "cnt", "elapsed_ns", "max_ns", "errs", "bytes"]),
    ("p2", "futex", ad.futex_trace, "a22_futex_stats", "", FUTEX_COLS),
    ("p2", "profile", ad.profile_trace, "a27_profile_states", "", ["hostname", "cpu", "total", "usr", "sys", "idle", "intr"]),
    ("p2", "run-queue levels", task_and_block, RUNQ_LEVELS, "", None),
    ("p2", "event levels", task_and_block, EVENT_LEVELS, "", None),
    ("p3", "scheduler activity", ad.task_trace, "a2_task_cpu", "WHERE pid = 20", TASK_COLS),
    ("p3", "run-queue latency", ad.task_trace, runq_sql("hostname, pid"), "WHERE pid = 20", None),
    ("p3", "run-queue histogram", ad.task_trace, "a8_runq_hist", "WHERE pid = 20", None),
    ("p3", "sleep functions", ad.task_trace, "a11_sleep_funcs", "WHERE pid = 20", WAIT_COLS),
    ("p3", "syscalls", ad.task_trace, "a15_syscall_stats", "WHERE pid = 20", ["hostname", "pid", "syscallno", "cnt", "elapsed_ns", "max_ns", "errs", "bytes"]),
    ("p3", "physical I/O", ad.block_trace, TASK_IO, "", STATS),
    ("p3", "memory", ad.task_trace, "a35_mem_top", "WHERE pid = 20", None),
    ("p4", "per-server summary", ad.task_trace, "a4_node_cpu_time", "WHERE ldom IS NULL AND hostname IS NOT NULL", NODE_COLS),
    ("p4", "servers by run time", ad.task_trace, "a4_node_cpu_time", "WHERE ldom IS NULL AND hostname IS NOT NULL", NODE_COLS),
    ("p4", "hyper-threads", ad.task_trace, "a5_ht_usage", "", None),
    ("p4", "tasks by run time", ad.task_trace, "a2_task_cpu", first("run_ns"), TASK_COLS),
    ("p4", "tasks by switches", ad.task_trace, "a2_task_cpu", first("switches"), TASK_COLS),
    ("p4", "tasks by run-queue time", ad.task_trace, "a2_task_cpu", first("runq_ns"), TASK_COLS),
    ("p4", "wait functions by task", ad.task_trace, "a11_sleep_funcs", first("sleep_ns", "hostname, pid, frame"), WAIT_COLS),
    ("p4", "run-queue statistics", ad.task_trace, runq_sql("hostname"), "", None),
    ("p4", "devices", ad.block_trace, REQS + DISKS, "WHERE rw IS NULL " + first("ios", "hostname, dev"), None),
    ("p4", "global I/O", ad.block_trace, HOST_IO, "", HOST_IO_COLS),
    ("p4", "futexes", ad.futex_trace, "a22_futex_stats", first("cnt", "hostname, space, addr"), FUTEX_COLS),
    ("p4", "files", ad.task_trace, "a18_file_stats", first("syscalls", "hostname, dev, node"), FILE_COLS),
]


def section_name(report, part):
    """The query of a section: its report, its number if it has one, and its words."""
    return f"{report}_{part.lower().replace('.', '_').replace(' ', '_').replace('-', '_').replace('/', '')}"


for _report, _part, _trace, _base, _tail, _cols in SECTIONS:
    _of = _base if " " in _base else sql_of(_base)
    query(section_name(_report, _part), f"SELECT {', '.join(_cols) if _cols else '*'} FROM ({_of}) t {_tail}")(section(_report, _part, _trace, _cols))


@query("p5_io_scatter", REQS + "SELECT hostname, issue_ts AS time, dev AS device, rw, sector, nr_sectors AS length, insert_pid AS qpid, issue_pid AS spid, qtm AS qtime, svtm AS svctime FROM rq ORDER BY time, hostname, device, sector, length, spid LIMIT 20000")
def p5(spark, sf):
    return reports.io_scatter(io_of(spark, sf))


@query("p5_futex_scatter", FUT + "SELECT hostname, exit AS time, cpu, pid, CAST(ret AS BIGINT) AS retval, elapsed AS sctime, addr, op, 1 AS val FROM c ORDER BY time, cpu, pid LIMIT 20000")
def p5b(spark, sf):
    return reports.futex_scatter(futex_of(spark, sf))


@query("p5_task_switches", f"WITH {EV} SELECT hostname, hrtime, cpu, CASE event_type WHEN 'click' THEN 'out' WHEN 'view' THEN 'in' ELSE 'wake' END AS kind FROM ev WHERE usr = 20 AND event_type IN ('click', 'view', 'purchase')")
def p5c(spark, sf):
    return reports.task_switches(ad.task_trace(spark, sf), 20).select("hostname", "hrtime", "cpu", "kind")


@query("s13_report_csv", REQS + "SELECT hostname, dev, ios, sectors FROM st WHERE rw IS NULL")
def s13(spark, sf):
    from .sources.sinks import write_report_csv
    from .streaming.drive import folder

    path = folder(spark, "report")
    write_report_csv(blockio.io_stats(io_of(spark, sf)).where("rw is null").select("hostname", "dev", "ios", "sectors"), path)
    return spark.read.option("header", True).schema("hostname string, dev bigint, ios bigint, sectors bigint").csv(path)


@query("s14_pid_json")
def s14(spark, sf):
    from .sources.sinks import pid_tree

    return pid_tree(graph.wakeup_edges(woken_of(spark, sf))).select("hostname", "pid", "cnt", "sleep_ns", F.to_json("syscalls").alias("tree"))


@query("s14_pid_json_read", POINTS + """SELECT hostname, pid, scall AS s_scall, k * 16 AS slpfunc, pid + 1 AS waker, count(*) AS cnt, CAST(sum(ns) AS BIGINT) AS sleep_ns
FROM ivn WHERE ended_by = 'wake' AND state = 'SWTCH' GROUP BY ALL""")
def s14b(spark, sf):
    """The trees written as JSON, read again and taken apart."""
    from .sources.sinks import write_pid_json
    from .streaming.drive import folder

    path = folder(spark, "trees")
    write_pid_json(graph.wakeup_edges(woken_of(spark, sf).where("known")), path)
    tree = "array<struct<s_scall: int, functions: array<struct<slpfunc: bigint, wakers: array<struct<waker: bigint, cnt: bigint, sleep_ns: bigint>>>>>>"
    t = spark.read.schema(f"hostname string, pid bigint, syscalls {tree}").json(path)
    t = t.select("hostname", "pid", F.explode("syscalls").alias("s")).select("hostname", "pid", "s.s_scall", F.explode("s.functions").alias("f"))
    return t.select("hostname", "pid", "s_scall", "f.slpfunc", F.explode("f.wakers").alias("w")).select("hostname", "pid", "s_scall", "slpfunc", "w.waker", "w.cnt", "w.sleep_ns")


AIO = f"""WITH {IO},
e AS (SELECT hostname, dev * 1000000 + sector + cpu_seqno * 100000000000 AS iocb, hrtime AS t, CASE event WHEN 'block_rq_insert' THEN 0 ELSE 1 END AS done, pid, rw, q FROM bt WHERE event <> 'block_rq_issue'),
o AS (SELECT *, lag(done) OVER w AS again, last_value(CASE done WHEN 0 THEN {{'t': t, 'pid': pid, 'rw': rw, 'q': q}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e WINDOW w AS (PARTITION BY hostname, iocb ORDER BY t, done)),
m AS (SELECT hostname, s.pid AS pid, s.rw AS rw, q * 512 AS bytes, t - s.t AS ns FROM o WHERE done = 1 AND again = 0 AND s IS NOT NULL AND s.q = q),
g AS (SELECT hostname, pid, count(*) FILTER (WHERE rw = 0) AS rd_cnt, CAST(coalesce(sum(bytes) FILTER (WHERE rw = 0), 0) AS BIGINT) AS rd_bytes, CAST(coalesce(sum(ns) FILTER (WHERE rw = 0), 0) AS BIGINT) AS rd_ns, coalesce(max(ns) FILTER (WHERE rw = 0), 0) AS rd_max,
      count(*) FILTER (WHERE rw = 1) AS wr_cnt, CAST(coalesce(sum(bytes) FILTER (WHERE rw = 1), 0) AS BIGINT) AS wr_bytes, CAST(coalesce(sum(ns) FILTER (WHERE rw = 1), 0) AS BIGINT) AS wr_ns, coalesce(max(ns) FILTER (WHERE rw = 1), 0) AS wr_max FROM m GROUP BY 1, 2)
"""


@query("a20_aio_stats", AIO + "SELECT * FROM g")
def a20(spark, sf):
    """Each request of the block trace as an asynchronous operation: submitted when inserted, complete when done."""
    t = ad.block_trace(spark, sf)
    iocb = F.expr("blk.dev * 1000000 + blk.sector + cpu_seqno * 100000000000")
    sub = t.where("event = 'block_rq_insert'").select("hostname", "pid", F.lit(syscalls.IO_SUBMIT).alias("syscallno"), F.array(F.lit(1).cast("long")).alias("args"), F.col("hrtime").alias("enter"), F.col("hrtime").alias("exit"), F.array(F.struct(iocb.alias("iocb"), F.col("blk.cmd_flags").cast("int").alias("op"), F.lit(3).alias("fd"), F.col("blk.sector").alias("offset"), F.col("blk.bytes").alias("nbytes"))).alias("iocbs"))
    got = t.where("event = 'block_rq_complete'").select("hostname", "pid", F.lit(syscalls.IO_GETEVENTS).alias("syscallno"), F.array(F.lit(1).cast("long")).alias("args"), F.col("hrtime").alias("enter"), F.col("hrtime").alias("exit"), F.array(F.struct(iocb.alias("obj"), F.col("blk.bytes").alias("res"))).alias("io_events"))
    return syscalls.aio_stats(syscalls.pair_aio(sub.unionByName(got, allowMissingColumns=True)))


@query("j6_pair_aio", AIO + "SELECT hostname, pid, rd_cnt, wr_cnt FROM g")
def j6(spark, sf):
    return a20(spark, sf).select("hostname", "pid", "rd_cnt", "wr_cnt")


@query("j12_lineage", f"WITH {EV} SELECT DISTINCT hostname, usr + 100000 AS pid, usr AS ppid FROM ev WHERE event_type = 'signup'")
def j12(spark, sf):
    e = ad.flat_events(spark, sf).where("event_type = 'signup'")
    calls = e.select("hostname", F.col("usr").alias("pid"), F.col("usr").alias("tgid"), F.lit(syscalls.FORK).alias("syscallno"), F.array(F.lit(0).cast("long")).alias("args"), F.expr("usr + 100000").alias("ret"), F.col("hrtime").alias("exit"), F.lit(None).cast("string").alias("filename"))
    return syscalls.lineage(calls).select("hostname", "pid", "ppid").distinct()


def customers_as_tasks(spark, sf):
    c = ad.table(spark, sf, "customer")
    return c.select(F.expr("concat('h', c_custkey % 2)").alias("hostname"), F.col("c_custkey").alias("pid"), F.expr("c_custkey - c_custkey % 4").alias("tgid"), F.expr("bigint(floor(abs(c_acctbal)))").alias("run_ns"), F.lit(1).cast("long").alias("runq_ns"), F.lit(2).cast("long").alias("sys_ns"), F.lit(3).cast("long").alias("sleep_ns"), F.expr("bigint(c_nationkey)").alias("rss"), "c_mktsegment")


CONT = "WITH t AS (SELECT 'h' || (c_custkey % 2) AS hostname, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'system' END AS container, CAST(floor(abs(c_acctbal)) AS BIGINT) AS r, c_nationkey AS m FROM customer), g AS (SELECT hostname, container, count(*) AS tasks, CAST(sum(r) AS BIGINT) AS run_ns, CAST(sum(m) AS BIGINT) AS rss FROM t GROUP BY 1, 2)\n"


def containers_of(spark, sf):
    t = customers_as_tasks(spark, sf)
    return dims.container_stats(t.withColumn("tgid", F.col("pid")), t.where("pid % 5 = 0").select("hostname", "pid", F.col("c_mktsegment").alias("name")))


@query("a32_container_stats", CONT + "SELECT * FROM g")
def a32(spark, sf):
    return containers_of(spark, sf).select("hostname", "container", "tasks", "run_ns", "rss")


@query("t9_top_containers", CONT + "SELECT * FROM g ORDER BY run_ns DESC, hostname, container LIMIT 5")
def t9(spark, sf):
    return topn.top_containers(containers_of(spark, sf), "run_ns", 5).select("hostname", "container", "tasks", "run_ns", "rss")


@query("a34_ora_roles", "SELECT 'h' || (c_custkey % 2) AS hostname, 'db' || (c_custkey % 3) AS sid, CASE c_custkey % 4 WHEN 0 THEN 'lgwr' ELSE 'dbw' END AS role, count(*) AS tasks, CAST(sum(CAST(floor(abs(c_acctbal)) AS BIGINT)) AS BIGINT) AS run_ns FROM customer WHERE c_custkey % 4 < 2 GROUP BY 1, 2, 3")
def a34(spark, sf):
    t = customers_as_tasks(spark, sf)
    p = t.select("hostname", "pid", F.expr("concat(case pid % 4 when 0 then 'ora_lgwr_db' when 1 then 'ora_dbw0_db' else 'bash_x_db' end, pid % 3)").alias("cmd"))
    return stacks.ora_roles(t, p).select("hostname", "sid", "role", "tasks", "run_ns")


def closing(trace, at):
    """A closing event of each host at a late time, which moves the watermark past all windows before; its own window stays open."""
    last = trace.where("event = 'sys_enter'").groupBy("hostname").agg(F.min("pid").alias("pid"))  # of these two columns alone
    return as_trace(last.select("hostname", F.lit("c0").alias("capture_id"), F.lit(at).cast("long").alias("hrtime"), F.lit("sys_enter").alias("event"), F.lit(0).alias("cpu"), F.lit(0).alias("cpu_seqno"), "pid", F.col("pid").alias("tgid")))


#: Families that events of each adapter have.
TASK_FAMILIES, CPU_FAMILIES = ("sw", "wk", "sys"), ("irq", "pwr")


def having(trace, *families):
    """Header and some families of a trace; the others, which no event has, are not written and read as null."""
    return trace.select(*[x.split()[0] for x in HEADER.split(", ")], *families)


def stream_of(spark, sf, *parts):
    """Parts of a trace written as files, each with its own families, and read as one stream."""
    from .streaming import live
    from .streaming.drive import folder

    path = folder(spark, "stream-in")
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/p{k}")
    return live.stream_trace(spark, f"{path}/p*", "60 days")


def task_stream(spark, sf, at=None):
    """The trace of tasks as a stream, with closing events at a time if one is given."""
    trace = ad.task_trace(spark, sf)
    return stream_of(spark, sf, having(trace, *TASK_FAMILIES), *([] if at is None else [closing(trace, at)]))


@query("z2_live_stats", f"WITH {EV}, t AS (SELECT hostname, hrtime // {24 * HOUR} AS d, CASE event_type WHEN 'signup' THEN 'sys_enter' WHEN 'error' THEN 'sys_exit' WHEN 'purchase' THEN 'sched_wakeup' ELSE 'sched_switch' END AS event FROM ev) SELECT hostname, d AS day, event, count(*) AS n FROM t GROUP BY 1, 2, 3")
def z2(spark, sf):
    from .streaming import drive, live

    trace = ad.task_trace(spark, sf)
    end = trace.agg(F.max("hrtime")).first()[0] or 0
    out = drive.drained(live.live_stats(task_stream(spark, sf, end + 62 * 24 * HOUR), "1 day"), "append")  # the watermark's 60 days, and two windows
    return out.select("hostname", F.expr("datediff(start, date '1970-01-01')").cast("long").alias("day"), "event", "n")


@query("z3_stream_syscalls", CALLS + "SELECT hostname, pid, syscallno, enter, exit, elapsed, ret FROM calls")
def z3(spark, sf):
    from .streaming import drive, live

    return drive.drained(live.stream_pair_syscalls(task_stream(spark, sf), 1 << 40)).select("hostname", "pid", "syscallno", "enter", "exit", "elapsed", "ret")


@query("z3_stream_block", REQS + "SELECT hostname, dev, sector, insert_ts, issue_ts, complete_ts, qtm, svtm FROM rq")
def z3b(spark, sf):
    from .streaming import drive, live

    return drive.drained(live.stream_pair_block(stream_of(spark, sf, having(ad.block_trace(spark, sf), "blk")), 1 << 40)).drop("sectors", "complete_time")


def stretches_of(spark, sf):
    """Stretches of all days that are over when the watermark is two days behind the last event."""
    from .streaming import drive, live

    return drive.drained(live.stream_task_states(task_stream(spark, sf, last_of(spark, sf) + 62 * DAY), DAY))


def z4(spark, sf):
    return stretches_of(spark, sf).groupBy("hostname", F.col("id").alias("pid"), "state").agg(F.sum("ns").alias("ns"))


@query("z5_live_top", f"WITH {EV} SELECT hostname, k % 8 AS syscallno, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY count(*) DESC, k % 8) <= 3")
def z5(spark, sf):
    from .streaming import drive, live

    days = 36_500  # one window from 1970 on
    path = drive.folder(spark, "live-top")
    spark.createDataFrame([], "hostname string, syscallno int, n bigint").write.parquet(f"{path}/batch=-1")
    # A folder for each batch, so that one that runs again replaces its rows.
    q = live.live_top(task_stream(spark, sf, (days + 62) * 24 * HOUR), "syscall", 3, lambda df, k: df.select("hostname", F.col("syscallno").cast("int").alias("syscallno"), "n").write.mode("overwrite").parquet(f"{path}/batch={k}"), f"{days} days")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("hostname string, syscallno int, n bigint").parquet(f"{path}/batch=*")


# Streams that arrive in an order of their own.

DAY = 24 * HOUR


def arriving(spark, sf, parts, delay):
    """Parts of a trace as a stream in which each is one batch, in this order; the file source goes by the time of files."""
    from .schema import TRACE
    from .streaming import live
    from .streaming.drive import folder

    path = folder(spark, "stream-arriving")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k, part in enumerate(parts):
        part.repartition(files).write.parquet(f"{path}/p{k}")  # the same number of files each
    stream = spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files).parquet(f"{path}/p*")
    return live.with_event_time(stream, delay)


def last_of(spark, sf):
    return ad.flat_events(spark, sf).agg(F.max("hrtime")).first()[0] or 0


def sync_records(spark, trace):
    """A sync record of each CPU at each end of a day of the trace; SQL sees none of them."""
    days = trace.select(F.expr(f"(hrtime div {DAY} + 1) * {DAY}").alias("t")).distinct()
    from .schema import as_trace

    marks = days.join(F.broadcast(ad.topology(spark)), F.lit(True)).select("hostname", F.col("t").alias("hrtime"), F.lit("sync").alias("event"), "cpu", F.lit(0).cast("long").alias("cpu_seqno"), F.lit(0).cast("long").alias("pid"))
    return as_trace(marks)


TASK_EVENT = "CASE event_type WHEN 'signup' THEN 'sys_enter' WHEN 'error' THEN 'sys_exit' WHEN 'purchase' THEN 'sched_wakeup' ELSE 'sched_switch' END"


@query("z1_ordered_stream", f"WITH {EV} SELECT hostname, hrtime // {DAY} AS slice, row_number() OVER (PARTITION BY hostname, hrtime // {DAY} ORDER BY hrtime, cpu, cpu_seqno) - 1 AS place, hrtime, cpu, cpu_seqno, {TASK_EVENT} AS event, true AS complete, false AS late FROM ev")
def z1(spark, sf):
    """CPUs 0 and 1 of each host arrive first, then the others: nothing leaves before all of them are in sync."""
    from .streaming import drive, ordered

    trace = ad.task_trace(spark, sf)
    syncs = sync_records(spark, trace)
    parts = [trace.where("cpu < 2"), syncs.where("cpu < 2"), trace.where("cpu >= 2"), syncs.where("cpu >= 2")]
    out = drive.drained(ordered.ordered(arriving(spark, sf, parts, "4000 days"), ad.topology(spark), DAY, 1))
    return out.select("hostname", "slice", "place", "hrtime", "cpu", "cpu_seqno", "event", "complete", "late")


@query("z2_live_calls", CALLS + f"SELECT hostname, exit // {DAY} AS day, syscallno, count(*) AS n, CAST(sum(elapsed) AS BIGINT) AS ns, max(elapsed) AS max_ns, CAST(sum(err) AS BIGINT) AS errs, CAST(sum(bytes) AS BIGINT) AS bytes FROM calls2 GROUP BY 1, 2, 3")
def z2_calls(spark, sf):
    from .streaming import drive, live

    out = drive.drained(live.live_calls(task_stream(spark, sf, last_of(spark, sf) + 62 * DAY), "1 day", 1 << 40))
    return out.select("hostname", day_of("start"), "syscallno", "n", "ns", "max_ns", "errs", "bytes")


def day_of(column, name="day"):
    return F.expr(f"datediff({column}, date '1970-01-01')").cast("long").alias(name)


def stretch_sql(days):
    """Stretches of tasks, cut at the ends of days, up to so many days after the start of the last day of the data."""
    return POINTS.rstrip() + f""",
last AS (SELECT max(hrtime) // {DAY} AS d FROM ev),
sw AS (SELECT hostname, pid, state, start, coalesce(lead(start) OVER (PARTITION BY hostname, pid ORDER BY start, cpu, cpu_seqno), (SELECT (d + {days}) * {DAY} FROM last)) AS e, CASE WHEN state = 'SWTCH' THEN CAST(k * 16 AS BIGINT) END AS label FROM iv),
cut AS (SELECT *, unnest(range(start // {DAY}, (e - 1) // {DAY} + 1)) AS day FROM sw WHERE e > start),
parts AS (SELECT hostname, pid, state, label, day, CAST(least(e, (day + 1) * {DAY}) - greatest(start, day * {DAY}) AS BIGINT) AS ns, 0 AS n FROM cut UNION ALL SELECT hostname, pid, state, label, start // {DAY}, 0, 1 FROM sw),
stretch AS (SELECT hostname, pid, state, label, day, CAST(sum(ns) AS BIGINT) AS ns, CAST(sum(n) AS BIGINT) AS n FROM parts WHERE day < (SELECT d + {days} FROM last) GROUP BY 1, 2, 3, 4, 5)
"""


STRETCH = stretch_sql(0)  # the last day of the data is not over


@query("z2_live_busy", STRETCH + "SELECT hostname, day, CAST(sum(CASE WHEN state = 'RUNNING' THEN ns ELSE 0 END) AS BIGINT) AS run_ns, CAST(sum(CASE WHEN state = 'RUNQ' THEN ns ELSE 0 END) AS BIGINT) AS runq_ns, CAST(sum(CASE WHEN state = 'SWTCH' THEN ns ELSE 0 END) AS BIGINT) AS sleep_ns, count(*) FILTER (WHERE state = 'RUNNING' AND ns > 0) AS ran FROM stretch GROUP BY 1, 2")
def z2_busy(spark, sf):
    from .streaming import drive, live

    last = last_of(spark, sf)
    out = drive.drained(live.live_busy(task_stream(spark, sf, last + 62 * DAY), DAY))
    return out.select("hostname", day_of("start"), "run_ns", "runq_ns", "sleep_ns", "ran").where(F.col("day") < last // DAY)


LATE_AT = "(SELECT t, max(hrtime) // 1000000 - 86400000 AS mark FROM ev, (SELECT (min(hrtime) + max(hrtime)) // 2 AS t FROM ev) WHERE hrtime > t AND cpu < 2 GROUP BY t)"


@query("z7_late_rows", f"WITH {EV} SELECT hostname, hrtime // {DAY} AS day, {TASK_EVENT} AS event, count(*) AS n, min(mark - hrtime // 1000000) AS least_behind_ms, max(mark - hrtime // 1000000) AS most_behind_ms FROM ev, {LATE_AT} WHERE hrtime <= t AND hrtime // 1000000 < mark GROUP BY 1, 2, 3")
def z7(spark, sf):
    """The later half of the events arrives first, in two batches: of the other half, what is more than a day behind the first is late, and kept aside."""
    from .streaming import late
    from .streaming.drive import folder

    trace = ad.task_trace(spark, sf)
    t0, t1 = trace.agg(F.min("hrtime"), F.max("hrtime")).first()
    half = ((t0 or 0) + (t1 or 0)) // 2
    later = trace.where(F.col("hrtime") > half)
    stream = arriving(spark, sf, [later.where("cpu < 2"), later.where("cpu >= 2"), trace.where(F.col("hrtime") <= half)], "1 day")
    out = folder(spark, "late")
    late.late_split(stream, folder(spark, "late-state"), out, once=True).awaitTermination()
    rows = spark.read.schema(late.LATE).parquet(f"{out}/batch=*")
    return rows.groupBy("hostname", F.expr(f"hrtime div {DAY}").alias("day"), "event").agg(F.count("*").alias("n"), F.min("behind_ms").alias("least_behind_ms"), F.max("behind_ms").alias("most_behind_ms"))


@query("z7_lost_events", f"""WITH {EV}, s AS (SELECT hostname, cpu, hrtime, cpu_seqno, row_number() OVER (PARTITION BY hostname, cpu ORDER BY cpu_seqno) AS seqno FROM ev),
k AS (SELECT *, lag(seqno) OVER w AS p, lag(hrtime) OVER w AS start FROM s WHERE cpu_seqno % 7 > 1 WINDOW w AS (PARTITION BY hostname, cpu ORDER BY seqno))
SELECT hostname, cpu, start, hrtime AS "end", hrtime - start AS gap_ns, seqno - p - 1 AS events_lost FROM k WHERE seqno > p + 1""")
def z7_lost(spark, sf):
    """Events are numbered for each CPU, and two of seven are lost."""
    from pyspark.sql.window import Window

    from .streaming import drive, late

    numbered = ad.task_trace(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("hostname", "cpu").orderBy("cpu_seqno")).cast("long"))
    trace = numbered.where("cpu_seqno % 7 > 1").withColumn("cpu_seqno", F.col("n")).drop("n")
    return drive.drained(late.stream_lost(stream_of(spark, sf, having(trace, *TASK_FAMILIES)))).select("hostname", "cpu", "start", "end", "gap_ns", "events_lost")


query("z4_stream_states", stretch_sql(2) + "SELECT hostname, pid, state, CAST(sum(ns) AS BIGINT) AS ns FROM stretch WHERE state IN ('RUNNING', 'RUNQ', 'SWTCH') GROUP BY 1, 2, 3")(z4)


@query("z4_states_by_day", STRETCH + "SELECT hostname, pid, day, state, coalesce(label, -1) AS label, n, ns FROM stretch WHERE state IN ('RUNNING', 'RUNQ', 'SWTCH')")
def z4_days(spark, sf):
    return stretches_of(spark, sf).select("hostname", F.col("id").alias("pid"), day_of("start"), "state", F.coalesce("label", F.lit(-1)).alias("label"), "n", "ns").where(F.col("day") < last_of(spark, sf) // DAY)


# All views of a window from one stream; SQL states each from the tables that the batch queries have.
MEASURED = {
    "task": (STRETCH, f"SELECT day, hostname, 'task' AS view, NULL AS entity, CAST(pid AS VARCHAR) AS key, n, ns, 0 AS bytes, 0 AS errs FROM stretch WHERE state = 'RUNNING'"),
    "container": (STRETCH, """SELECT day, s.hostname, 'container', NULL, coalesce(c_mktsegment, 'system'), sum(n), sum(ns), 0, 0 FROM stretch s
      LEFT JOIN customer ON c_custkey % 5 = 0 AND s.pid = c_custkey AND s.hostname = 'h' || (c_custkey % 2) WHERE state = 'RUNNING' GROUP BY 1, 2, 5"""),
    "wait": (STRETCH, "SELECT day, hostname, 'wait', NULL, CAST(label AS VARCHAR), sum(n), sum(ns), 0, 0 FROM stretch WHERE label IS NOT NULL GROUP BY 1, 2, 5"),
    "task.wait": (STRETCH, "SELECT day, hostname, 'task.wait', CAST(pid AS VARCHAR), CAST(label AS VARCHAR), n, ns, 0, 0 FROM stretch WHERE label IS NOT NULL"),
    "cpu": (STRETCH, f"""SELECT day, hostname, 'cpu', NULL, CAST(cpu AS VARCHAR), sum(n), sum(ns), 0, 0 FROM (
        SELECT hostname, cpu, day, least(e, (day + 1) * {DAY}) - greatest(hrtime, day * {DAY}) AS ns, 0 AS n
        FROM (SELECT *, unnest(range(hrtime // {DAY}, (e - 1) // {DAY} + 1)) AS day FROM (
          SELECT hostname, cpu, hrtime, event_type = 'view' AND usr <> 0 AS busy, coalesce(lead(hrtime) OVER (PARTITION BY hostname, cpu ORDER BY hrtime, cpu_seqno), (SELECT d * {DAY} FROM last)) AS e
          FROM ev WHERE event_type IN ('click', 'view')) WHERE busy AND e > hrtime)
        UNION ALL SELECT hostname, cpu, hrtime // {DAY}, 0, 1 FROM ev WHERE event_type = 'view' AND usr <> 0) GROUP BY 1, 2, 5"""),
    "syscall": (CALLS, f"SELECT exit // {DAY} AS day, hostname, 'syscall', NULL, CAST(syscallno AS VARCHAR), count(*), sum(elapsed), sum(bytes), sum(err) FROM calls2 GROUP BY 1, 2, 5"),
    "task.syscall": (CALLS, f"SELECT exit // {DAY} AS day, hostname, 'task.syscall', CAST(pid AS VARCHAR), CAST(syscallno AS VARCHAR), count(*), sum(elapsed), sum(bytes), sum(err) FROM calls2 GROUP BY 1, 2, 4, 5"),
    "file": (CALLS, f"SELECT exit // {DAY} AS day, hostname, 'file', NULL, (k % 3) || ':' || k, count(*), sum(elapsed), sum(bytes), sum(err) FROM calls2 GROUP BY 1, 2, 5"),
    "task.file": (CALLS, f"SELECT exit // {DAY} AS day, hostname, 'task.file', CAST(pid AS VARCHAR), (k % 3) || ':' || k, count(*), sum(elapsed), sum(bytes), sum(err) FROM calls2 GROUP BY 1, 2, 4, 5"),
    "net": (CALLS, f"SELECT exit // {DAY} AS day, hostname, 'net', NULL, '10.0.0.' || (pid % 3) || '>10.0.1.' || (k % 5), count(*), sum(elapsed), sum(bytes), sum(err) FROM calls2 GROUP BY 1, 2, 5"),
    "irq": (IRQ, f"""SELECT "end" // {DAY} AS day, hostname, 'irq', NULL, kind || ':' || irq, count(*), sum(time), 0, 0 FROM pairs GROUP BY 1, 2, 5"""),
    "profile": (f"WITH {EV} ", f"SELECT hrtime // {DAY} AS day, hostname, 'profile', NULL, CAST(k * 16 + 3 AS VARCHAR), count(*), 0, 0, 0 FROM ev WHERE event_type <> 'view' AND usr > 0 GROUP BY 1, 2, 5"),
    "disk": (REQS, f"SELECT complete_ts // {DAY} AS day, hostname, 'disk', NULL, CAST(dev AS VARCHAR), count(*), sum(svtm), sum(nr_sectors) * 512, 0 FROM rq GROUP BY 1, 2, 5"),
    "futex": (FUT, f"SELECT exit // {DAY} AS day, hostname, 'futex', NULL, CAST(addr AS VARCHAR), count(*), sum(elapsed), 0, count(*) FILTER (WHERE ret < 0) FROM c GROUP BY 1, 2, 5"),
}


def measured_sql(views):
    parts = " UNION ALL ".join(f"SELECT * FROM ({with_}\n{select})" for with_, select in (MEASURED[v] for v in views))
    return f"""WITH m(day, hostname, view, entity, key, n, ns, bytes, errs) AS ({parts})
SELECT day, hostname, view, entity, key, CAST(n AS BIGINT) AS n, CAST(ns AS BIGINT) AS ns, CAST(bytes AS BIGINT) AS bytes, CAST(errs AS BIGINT) AS errs
FROM m WHERE day < (SELECT epoch_us(max(ts)) * 1000 // {DAY} FROM events)
QUALIFY row_number() OVER (PARTITION BY day, hostname, view, entity ORDER BY ns DESC, n DESC, key) <= 3"""


def viewed(spark, sf, only, trace, *others):
    """The first three of each view in ``only``, host and day, through the sink; the last day is not over. The first trace has system calls of each host."""
    from .streaming import views
    from .streaming.drive import folder

    boxes = ad.table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.expr("concat('h', c_custkey % 2)").alias("hostname"), F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("name"))
    last, out = last_of(spark, sf), folder(spark, "views")
    views.start(views.measures(stream_of(spark, sf, trace, *others, closing(trace, last + 62 * DAY)), DAY, boxes, 1 << 40, only), out, folder(spark, "views-state"), 3, DAY, once=True).awaitTermination()
    return views.written(spark, out).select(day_of("start"), "hostname", "view", "entity", "key", "n", "ns", "bytes", "errs").where(F.col("day") < last // DAY)


LIVE_VIEWS = [v for v in MEASURED if v not in ("disk", "futex")]


@query("z5_live_views", measured_sql(LIVE_VIEWS))
def z5_views(spark, sf):
    return viewed(spark, sf, LIVE_VIEWS, having(ad.task_trace(spark, sf), *TASK_FAMILIES), having(ad.profile_trace(spark, sf), "hc"), having(ad.cpu_trace(spark, sf), *CPU_FAMILIES))


@query("z5_live_disks", measured_sql(["disk"]))
def z5_disks(spark, sf):
    return viewed(spark, sf, ["disk"], having(ad.task_trace(spark, sf).where("event = 'sys_enter'"), "sys"), having(ad.block_trace(spark, sf), "blk"))


@query("z5_live_futexes", measured_sql(["futex"]))
def z5_futexes(spark, sf):
    return viewed(spark, sf, ["futex"], having(ad.futex_trace(spark, sf), "sys"))


# Stacks of addresses with their symbols, and the rules for database waits and hot stacks over them.


def frame_sql(names, a, b, tail=""):
    listed = ", ".join(f"'{x}{tail}'" for x in names)
    return f"([{listed}])[1 + (1 + (cpu_seqno * {a} + pid * {b}) % {ad.FRAMES}) % {len(names)}]"


RULES_SQL = ", ".join(f"({k}, '{w}', '{p}', {f"'{e}'" if e else 'NULL'}, {u})" for k, (w, p, e, u) in enumerate([*[(*r, True) for r in stacks.DB_WAITS], *[(*r, False) for r in stacks.DB_KERNEL_WAITS]]))
FRAMED = SLEPT + f""", rls(k, wait, prefix, earlier, usr) AS (VALUES {RULES_SQL}),
f AS (SELECT hostname, pid, ns, cpu_seqno, [{frame_sql(ad.KERNEL_FRAMES, 3, 1)}, {frame_sql(ad.KERNEL_FRAMES, 11, 5)}] AS kernel,
             [{frame_sql(ad.USER_FRAMES, 7, 3, '+')}, {frame_sql(ad.USER_FRAMES, 13, 0, '+')}, {frame_sql(ad.USER_FRAMES, 29, 11, '+')}] AS usr FROM sl)
"""


def framed_of(spark, sf):
    slept = stacks.sleeps(states.task_state_intervals(ad.database_trace(spark, sf)))
    return stacks.symbolize_stacks(slept, ad.frame_symbols(spark, sf))


@query("a12_symbolized_stacks", FRAMED + "SELECT hostname, array_to_string(kernel || ['<user>'] || usr, ';') AS frames, count(*) AS cnt, CAST(sum(ns) AS BIGINT) AS sleep_ns FROM f GROUP BY 1, 2")
def a12_symbols(spark, sf):
    return framed_of(spark, sf).groupBy("hostname", F.array_join("frames", ";").alias("frames")).agg(F.count("*").alias("cnt"), F.sum("ns").alias("sleep_ns"))


@query("a33_ora_waits_traced", FRAMED + """, p AS (
  SELECT hostname, pid, ns, cpu_seqno, kernel, usr, true AS side, unnest([1, 2, 3]) AS i FROM f UNION ALL SELECT hostname, pid, ns, cpu_seqno, kernel, usr, false, unnest([1, 2]) FROM f),
m AS (SELECT hostname, pid, ns, cpu_seqno, wait FROM p JOIN rls ON rls.usr = p.side AND starts_with(CASE WHEN side THEN p.usr[i] ELSE kernel[i] END, prefix)
      AND (earlier IS NULL OR len(list_filter(CASE WHEN side THEN list_slice(p.usr, 1, i - 1) ELSE list_slice(kernel, 1, i - 1) END, lambda x: starts_with(x, earlier))) > 0)
      QUALIFY row_number() OVER (PARTITION BY hostname, pid, cpu_seqno ORDER BY side, i, k) = 1)
SELECT hostname, pid, wait, count(*) AS cnt, max(ns) AS max_ns, CAST(sum(ns) AS BIGINT) AS sleep_ns FROM m GROUP BY 1, 2, 3""")
def a33_traced(spark, sf):
    waits = stacks.ora_waits(framed_of(spark, sf), ("hostname", "pid"), "frames", kernel_rules=stacks.DB_KERNEL_WAITS, user_mark=stacks.USER)
    return waits.select("hostname", "pid", "wait", "cnt", "max_ns", "sleep_ns")


HOT_SQL = " UNION ALL ".join(f"SELECT hostname, '{code}' AS code, '{markers[0]}' AS evidence FROM g WHERE len(list_intersect(frames, [{', '.join(f"'{m}'" for m in markers)}])) >= 2 AND hits >= {least}" for markers, least, code in rules.HOT_STACKS)


@query("d6_rules_stack_traced", FRAMED + f", g AS (SELECT hostname, kernel || ['<user>'] || usr AS frames, count(*) AS hits FROM f GROUP BY 1, 2) SELECT hostname, code, evidence, count(*) AS stacks FROM ({HOT_SQL}) GROUP BY 1, 2, 3")
def d6_traced(spark, sf):
    counts = framed_of(spark, sf).groupBy("hostname", F.col("frames").alias("stack")).agg(F.count("*").alias("hits"))
    return rules.rules_stack(counts).groupBy("hostname", "code", "evidence").agg(F.count("*").alias("stacks"))


# The same over long intervals and short slots, with times as they are.
SHORT = 600_000_000_000


@query("w5_timeline_short_slots", POINTS + f""", p AS (SELECT ivn.hostname, state, start, "end", t0, unnest(range((start - t0) // {SHORT}, ("end" - 1 - t0) // {SHORT} + 1)) AS slot FROM ivn JOIN b ON ivn.hostname = b.hostname WHERE ns > 0),
c AS (SELECT hostname, slot, state, least("end", t0 + (slot + 1) * {SHORT}) - greatest(start, t0 + slot * {SHORT}) AS ns FROM p)
SELECT hostname, slot, CAST(sum(CASE WHEN state = 'RUNNING' THEN ns ELSE 0 END) AS BIGINT) AS run_ns, CAST(sum(CASE WHEN state = 'RUNQ' THEN ns ELSE 0 END) AS BIGINT) AS runq_ns, CAST(sum(CASE WHEN state = 'SWTCH' THEN ns ELSE 0 END) AS BIGINT) AS sleep_ns FROM c GROUP BY hostname, slot""")
def w5_short(spark, sf):
    t = ad.task_trace(spark, sf)
    return windows.timeline(t, states.task_state_intervals(t), SHORT // 1_000_000).select("hostname", "slot", "run_ns", "runq_ns", "sleep_ns")


F8_SQL = sql_of("f8_mask_gaps").replace(f" // {UNIT}", "")


@query("f8_mask_gaps_unscaled", F8_SQL)
def f8_plain(spark, sf):
    t = ad.task_trace(spark, sf)
    iv = states.task_state_intervals(t).select("hostname", "pid", "cpu", "state", "start", "end", "ns")
    return filters.mask_gaps(iv, filters.capture_gaps(t)).groupBy("hostname", "pid", "state").agg(F.sum("ns").alias("ns"))


@query("a6_ht_dbdi_unscaled", sql_of("a6_ht_dbdi").replace(" // 1000000 AS", " AS"))
def a6_plain(spark, sf):
    return states.ht_dbdi(ad.task_trace(spark, sf), ad.topology(spark))


# Waits of customers for suppliers as a graph, searched from every 50th customer at once.
DEPTH = 4
ORDERED = """WITH RECURSIVE ed AS (SELECT 'h' || (l_suppkey % 2) AS hostname, CAST(o_custkey AS BIGINT) AS waker, CAST(l_suppkey + 1000000 AS BIGINT) AS sleeper, count(*) AS cnt, CAST(sum(CAST(l_quantity AS BIGINT) * 1000000) AS BIGINT) AS sleep_ns
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
tot AS (SELECT hostname, sleeper, sum(sleep_ns) AS total FROM ed GROUP BY 1, 2),
e AS (SELECT ed.* FROM ed JOIN tot USING (hostname, sleeper) WHERE 100.0 * sleep_ns >= 0.1 * total AND waker <> 0),
bo AS (SELECT hostname, here, "to", max(sleep_ns) AS ns FROM (SELECT hostname, sleeper AS here, waker AS "to", sleep_ns FROM e UNION ALL SELECT hostname, waker, sleeper, sleep_ns FROM e) GROUP BY 1, 2, 3),
best AS (SELECT hostname, here, "to" FROM bo QUALIFY row_number() OVER (PARTITION BY hostname, here ORDER BY ns DESC, "to") <= 8),
walk(hostname, root, pid, depth) AS (
  SELECT DISTINCT hostname, here, here, 0 FROM best WHERE here < 1000000 AND here % 50 = 0
  UNION SELECT walk.hostname, root, "to", depth + 1 FROM walk JOIN best ON best.hostname = walk.hostname AND here = pid WHERE depth < 4),
n AS (SELECT hostname, root, pid, min(depth) AS depth FROM walk GROUP BY 1, 2, 3)
"""


def graphs_of(spark, sf):
    io = ad.table(spark, sf, "orders").join(ad.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = io.select(F.expr("concat('h', l_suppkey % 2)").alias("hostname"), F.col("o_custkey").cast("long").alias("waker"), F.expr("bigint(l_suppkey + 1000000)").alias("sleeper"), F.lit(1).cast("long").alias("cnt"), F.expr("bigint(l_quantity) * 1000000").alias("sleep_ns"))
    edges = written(edges, "waits")  # read for totals, roots and edges, which are summed there
    totals = edges.groupBy("hostname", F.col("sleeper").alias("pid")).agg(F.sum("sleep_ns").alias("sleep_total"))
    roots = edges.where("waker % 50 = 0").select("hostname", F.col("waker").alias("pid"))
    return graph.wait_graphs(edges, totals, roots, DEPTH, 0.1, 8)


@query("a38_wait_graphs_nodes", ORDERED + "SELECT hostname, root, pid, depth FROM n")
def a38_nodes(spark, sf):
    return graphs_of(spark, sf)[0]


@query("a38_wait_graphs_links", ORDERED + "SELECT e.hostname, w.root, waker, sleeper, cnt, sleep_ns FROM e JOIN n w ON w.hostname = e.hostname AND w.pid = waker JOIN n s ON s.hostname = e.hostname AND s.root = w.root AND s.pid = sleeper")
def a38_links(spark, sf):
    return graphs_of(spark, sf)[1]
