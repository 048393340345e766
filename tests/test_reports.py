"""Reports: one reading of a trace, sections made on demand, and the names of numbers."""

from pyspark.sql import functions as F

from tracelake import adapters as ad
from tracelake.functions import scalars as sc
from tracelake.operators import blockio, dims, states
from tracelake.plans import reports
from tracelake.schema import empty_trace
from tracelake.sources import readers

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def both(spark):
    return ad.task_trace(spark, SF).unionByName(ad.block_trace(spark, SF))


def test_a_staged_trace_is_read_once_and_counted_on_the_way(spark):
    t, top = both(spark), ad.topology(spark)
    told, counts = reports.staged(t)
    assert rows(told.drop("part")) == rows(t)
    parts = {r.part: r.n for r in told.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert {k: n for k, n in counts.items() if n} == parts and counts["hc"] == 0
    s = reports.Shared(t, top, stage=True)
    assert s.df.inputFiles() and all("/trace-" in f for f in s.df.inputFiles())
    only = s.part("blk").inputFiles()
    found = reports.all_reports(t, top, shared=s, every_ms=86_400_000)
    text = found["disk"]._jdf.queryExecution().toString()
    assert only and "lineitem" not in text and "events.parquet" not in text
    assert rows(found["disk"]) == rows(blockio.io_stats(blockio.pair_block_io(ad.block_trace(spark, SF))))
    apart = states.task_state_intervals(t)
    assert rows(s.intervals) == rows(apart) and rows(found["task"]) == rows(states.task_cpu(t, apart))
    assert rows(s.latencies) == rows(states.runq_latency(t, top)) and rows(s.cpus) == rows(states.cpu_time(t, top))
    s.release()


def test_levels_of_one_aggregate_equal_separate_ones(spark):
    t, top = ad.task_trace(spark, SF), ad.topology(spark)
    lat = states.runq_latency(t, top)
    levels = states.runq_levels(lat)
    for by, keys in (("pid_cpu", ["hostname", "pid", "cpu"]), ("pid", ["hostname", "pid"]), ("cpu", ["hostname", "cpu"]), ("host", ["hostname"])):
        cols = [*keys, "cnt", "total_us", "avg_us", "max_us", "migrations"]
        assert rows(levels.where(F.col("level") == by).select(cols)) == rows(states.runq_stats(lat, by).select(cols))
    counts = states.count_levels(t)
    for by, keys in (("event", ["event"]), ("pid", ["pid"]), ("pid_event", ["pid", "event"])):
        cols = ["hostname", *keys, "n"]
        assert rows(counts.where(F.col("level") == by).select(cols)) == rows(states.trace_counts(t, by).select(cols))
    assert counts.where("level = 'host'").agg(F.sum("n")).first()[0] == t.count()


def test_sections_are_made_on_demand_and_vanish_without_input(spark):
    t, top = ad.block_trace(spark, SF), ad.topology(spark)
    s = reports.Shared(t, top, stage=True)
    assert not s.kept  # nothing is planned before a section is asked for
    found = reports.host_report(t, top, shared=s)
    names = list(found)
    assert "4.1 global I/O" in names and "10 findings" in names
    assert not [n for n in names if n.startswith(("1.4", "1.6", "2.1", "3.", "5 "))]
    assert found["4.1 global I/O"].count() > 0 and s.kept == [s.io]
    whole = reports.host_report(t, top)  # unstaged: nothing is known, all sections stay
    assert len(whole) > len(names)
    s.release()


def test_all_reports_of_an_empty_trace(spark):
    found = reports.all_reports(empty_trace(spark), ad.topology(spark))
    assert len(found) == 12 and all(found[n].count() == 0 for n in ("task", "disk", "runq", "event levels", "syscall"))


def test_counts_of_tasks_from_one_table_of_points(spark):
    t = ad.task_trace(spark, SF).withColumn("pid", F.when(F.col("event") == "sched_wakeup", F.col("wk.target_pid") + 2).otherwise(F.col("pid")))  # wakers of the same host
    got = {(r.hostname, r.pid): r for r in states.task_cpu(t).collect()}
    sw = t.where("event = 'sched_switch' and pid > 0").groupBy("hostname", "pid").agg(F.sum("sw.stealtime").alias("steal"), F.max("sw.prev_prio").alias("hi"), F.min("sw.prev_prio").alias("lo")).collect()
    assert sw and all((got[r.hostname, r.pid].steal_ns, got[r.hostname, r.pid].prio_hi, got[r.hostname, r.pid].prio_lo) == (r.steal or 0, r.hi, r.lo) for r in sw if (r.hostname, r.pid) in got)
    woken = t.where("event = 'sched_wakeup' and wk.success = 1").groupBy("hostname", "pid").count().collect()
    seen = [r for r in woken if (r.hostname, r.pid) in got]
    assert seen and all(got[r.hostname, r.pid].wakeups == r["count"] for r in seen)
    size = {(r.hostname, r.pid): r.rss for r in states.mem_top(t).collect()}
    assert size and all(got[k].rss == v for k, v in size.items() if k in got)


def test_names_of_numbers(spark):
    one = lambda n, t: spark.range(1).select(sc.decode_enum(F.lit(n), t)).first()[0]
    assert [one(n, sc.SIGNALS) for n in (7, 10, 31, 32)] == ["BUS", "USR1", "SYS", "32"]
    assert [one(n, sc.FCNTL) for n in (1030, 38, 1024, 99)] == ["F_DUPFD_CLOEXEC", "F_OFD_SETLKW", "F_SETLEASE", "99"]
    assert [one(n, sc.SEMCTL) for n in (16, 0)] == ["SETVAL", "IPC_RMID"] and one(4, sc.IPC_CALLS) == "SEMTIMEDOP" and one(13, sc.FUTEX_OPS) == "LOCK_PI2"


def test_call_names_by_architecture(spark, tmp_path):
    for arch, lines in {"x86_64": ["#define __NR_read 0", "#define __NR_openat2 437", "/* a comment */", "# define __NR3264_fcntl 25", "#define __NR_syscalls 3a", ""], "i386": ["# number abi name", "3\ti386\tread\tsys_read", "5 open", "5 again", "x"]}.items():
        (tmp_path / f"arch={arch}").mkdir()
        (tmp_path / f"arch={arch}" / "names.txt").write_text("\n".join(lines))
    names = readers.read_call_names(spark, str(tmp_path))
    assert sorted(map(tuple, names.collect())) == [("i386", 3, "read"), ("i386", 5, "again"), ("x86_64", 0, "read"), ("x86_64", 25, "fcntl"), ("x86_64", 437, "openat2")]
    calls = spark.createDataFrame([(1, 0, 0), (2, 3, 1), (3, 3, 0), (4, None, 0), (5, 0, None)], "k int, syscallno int, is32bit int")
    assert {r.k: r.call for r in dims.with_call_names(calls, names).collect()} == {1: "read", 2: "read", 3: "3", 4: None, 5: "read"}
