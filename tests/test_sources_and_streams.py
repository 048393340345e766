"""Readers of listings and logs, sinks, streams against batch, rules and the registry."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelake import adapters as ad
from tracelake import registry
from tracelake.functions import scalars as sc
from tracelake.operators import states
from tracelake.plans import reports, rules
from tracelake.sources import readers, sinks
from tracelake.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def put(tmp_path, name, text):
    d = tmp_path / "hostname=h1"
    d.mkdir(exist_ok=True)
    (d / name).write_text(text)
    return f"{tmp_path}/hostname=*/{name}"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_listings(spark, tmp_path):
    ps = put(tmp_path, "ps", "UID PID PPID LWP C NLWP STIME TTY TIME CMD\nroot 10 1 11 0 2 09:00 ? 00:00:01 /bin/x -a b\n")
    assert rows(readers.read_processes(spark, ps), "host", "pid", "tgid", "ppid", "nlwp", "cmd") == [("h1", 11, 10, 1, 2, "/bin/x -a b")]
    of = put(tmp_path, "lsof", "COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME\nx 10 root 3r REG 8,1 100 77 /etc/f\nx 10 root 4u IPv4 123 0t0 TCP 10.0.0.1:80->10.0.0.2:99\n")
    assert rows(readers.read_open_files(spark, of), "fd", "dev", "node", "laddr", "lport", "raddr", "rport") == [(3, (8 << 20) + 1, 77, None, None, None, None), (4, None, None, "10.0.0.1", 80, "10.0.0.2", 99)]
    to = put(tmp_path, "topo", "node 0 cpus: 0-1,4\nnode 1 cpus: 2\nsiblings: 0,4\n")
    assert sorted(rows(readers.read_topology(spark, to), "cpu", "ldom", "lcpu_sibling")) == [(0, 0, 4), (1, 0, None), (2, 1, None), (4, 0, 0)]
    de = put(tmp_path, "dev", "dev=0x00800010 name=sda path=0x10002 mapper=m1 policy=round-robin\n")
    assert rows(readers.read_devices(spark, de), "dev", "devname", "devpath", "mapname", "wwn") == [(0x800010, "sda", 0x10002, "m1", None)]
    sy = put(tmp_path, "sym", "ffffffff81000000 T start\nffffffff81000010 d data\n0000000000000010 t low [mod]\n")
    assert rows(readers.read_symbols(spark, sy), "addr", "sym", "module") == [(0xFFFFFFFF81000000 - (1 << 64), "start", None), (16, "low", "mod")]
    co = put(tmp_path, "cont", "0123456789ab img:1 cmd up web\n55 /docker/0123456789abcdef\n")
    assert rows(readers.read_containers(spark, co), "pid", "container_id", "name") == [(55, "0123456789ab", "web")]
    th = put(tmp_path, "threads", '"main" #1 prio=5 nid=0x1f runnable\n42 db2agent\n')
    assert sorted(rows(readers.read_thread_names(spark, th), "pid", "thread_name", "kind")) == [(31, "main", "java"), (42, "db2agent", "db")]
    fa = put(tmp_path, "facts", "node_free_mb 0 = 50\nboot clocksource = hpet\n")
    f = readers.read_host_facts(spark, fa).withColumnRenamed("host", "hostname")
    assert {r.code for r in rules.findings(rules.rules_host(f)).collect()} == {"node_free", "clocksource"}


def test_text_log(spark, tmp_path):
    (tmp_path / "log").write_text("0.5 cpu=1 pid=7 tgid=7 sched_switch prev_state=1 next_pid=0 stack=1,2\n1.000000001 cpu=0 pid=7 tgid=7 sys_exit syscall=3 ret=-9\nbroken line\n")
    t = readers.read_trace_text(spark, str(tmp_path / "log"))
    assert rows(t.orderBy(F.col("hrtime").asc_nulls_last()), "hrtime", "event", "sw.next_pid", "sw.ips", "sys.ret", "_corrupt") == [(500_000_000, "sched_switch", 0, [1, 2], None, None), (1_000_000_001, "sys_exit", None, None, -9, None), (None, None, None, None, None, "broken line")]


def test_trace_files(spark, tmp_path):
    t = ad.block_trace(spark, SF)
    readers.write_trace(t, str(tmp_path / "t"))
    back = readers.read_trace(spark, str(tmp_path / "t"))
    assert back.count() == t.count() and back.select("hostname").distinct().count() == 2
    plan = back.where("event = 'block_rq_issue'").select("blk.dev")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event,block_rq_issue)" in plan and "sys:" not in plan.split("ReadSchema")[1]
    one = readers.read_cluster(spark, str(tmp_path / "t/hostname=h1*"))
    assert {r[0] for r in one.select("hostname").distinct().collect()} == {"h1"}


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("h", 2, 1, 5, None, 1, 9, 3, 30, 0)], "hostname string, waker long, sleeper long, w_scall int, w_arg0 long, s_scall int, slpfunc long, cnt long, sleep_ns long, unknown_ns long")
    sinks.write_pid_json(e, str(tmp_path / "j"))
    line = next(x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines())
    assert json.loads(line)["syscalls"][0]["functions"][0]["wakers"] == [{"waker": 2, "cnt": 3, "sleep_ns": 30}]
    sinks.write_report_csv(e, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["waker"] == "2"


def test_streams_equal_batch(spark):
    from tracelake import catalog

    t = ad.task_trace(spark, SF)
    key = lambda d: sorted(map(tuple, d.collect()))
    cols = ["hostname", "pid", "syscallno", "enter", "exit", "elapsed", "ret"]
    assert key(catalog.z3(spark, SF).select(cols)) == key(catalog.calls_of(spark, SF).select(cols))
    streamed = {(r.hostname, r.pid, r.state): r.ns for r in catalog.z4(spark, SF).collect()}
    iv = states.task_state_intervals(t).where("ended_by is not null and state <> 'N' and ns > 0")
    batch = {(r.hostname, r.pid, r.state): r.ns for r in iv.groupBy("hostname", "pid", "state").agg(F.sum("ns").alias("ns")).collect()}
    assert all(streamed.get(k, 0) >= v for k, v in batch.items()) and set(batch) <= set(streamed)


def test_live_views(spark, tmp_path):
    ad.task_trace(spark, SF).write.parquet(str(tmp_path / "in"))
    got = []
    q = live.live_top(live.stream_trace(spark, str(tmp_path / "in"), "1 second"), "syscall", 2, lambda df, k: got.extend(df.collect()), "1 day")
    q.processAllAvailable()
    q.stop()
    per = {}
    for r in got:
        per.setdefault((r.start, r.hostname), []).append(r.n)
    assert per and all(len(v) <= 2 for v in per.values())


def test_expressions(spark):
    d = spark.createDataFrame([(0x0A000001, "00000000000000000000ffff0a000001", "20010db8000000000000000000000001")], "a long, m string, v string")
    assert d.select(sc.ipv4_str(F.col("a")), sc.ipv6_str(F.col("m")), sc.ipv6_str(F.col("v"))).first()[:] == ("10.0.0.1", "10.0.0.1", "2001:db8::1")
    assert spark.range(1).select(sc.task_state_str(F.lit(3)), sc.task_state_str(F.lit(0)), sc.errno(F.lit(-9)), sc.errno(F.lit(5))).first()[:] == ("INTERRUPTIBLE|UNINTERRUPTIBLE", "RUN", 9, None)


def test_reports_have_their_sections(spark):
    from tracelake import catalog

    t, top = catalog.all_events(spark, SF), ad.topology(spark)
    s = reports.Shared(t, top)
    found = reports.host_report(t, top, ad.symbols(spark, SF), devices=catalog.devices(spark, SF), seconds=86400.0, shared=s)
    assert len(found) > 50 and found["4.1 global I/O"].count() > 0 and found["10 findings"].count() >= 1
    assert len(reports.task_report(t, top, 4, s)) == 17 and len(reports.cluster_report(t, top, shared=s)) >= 18
    s.release()


@pytest.mark.parametrize("name", ["flagship_top_devices", "a1_task_state_intervals", "j7_runq_latency", "a21_socket_stats", "a22_futex_stats", "w5_timeline", "j15_wakeup_edges"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    sql = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    norm = lambda x: round(x, 6) if isinstance(x, float) else x
    key = lambda rs: sorted(str(tuple(norm(v) for v in r)) for r in rs)
    assert sorted(names) == sorted(got.columns) and key(got.select(names).collect()) == key(sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


