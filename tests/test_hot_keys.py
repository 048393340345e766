"""One task or device with a third of all rows: cut into slices, with the results of plain windows."""

import pytest
from pyspark.sql import functions as F

from tracelake import adapters as ad
from tracelake.operators import blockio, filters, hot, states, syscalls, windows
from tracelake.schema import TRACE

SF = "/root/testdata/sf0.001"
PLACE = ("hrtime", "cpu", "cpu_seqno")


def rows(df, *cols):
    return sorted(map(str, df.select(*(cols or df.columns)).collect()))


def spread(scan, df, total):
    """The largest share of rows of one key and slice."""
    return scan.sliced(df).groupBy(*scan.key, hot.SLICE).count().agg(F.max("count")).first()[0] / total


@pytest.fixture(scope="module")
def trace(spark):
    """All kinds of events of tasks; every third is of task 2, and some are lost."""
    at = lambda t, k: t.withColumns({"hrtime": F.col("hrtime") + k, "cpu_seqno": F.col("cpu_seqno") * 3 + k})
    t = at(ad.task_trace(spark, SF), 0).unionByName(at(ad.cpu_trace(spark, SF), 1)).unionByName(at(ad.profile_trace(spark, SF), 2))
    pid = lambda c: F.when(F.expr("cpu_seqno div 3 % 3 = 0"), F.lit(2)).otherwise(c)
    sw = F.when(F.col("sw").isNotNull(), F.col("sw").withField("next_pid", F.when((F.col("sw.next_pid") > 0), pid(F.col("sw.next_pid"))).otherwise(F.col("sw.next_pid"))))
    wk = F.when(F.col("wk").isNotNull(), F.col("wk").withField("target_pid", pid(F.col("wk.target_pid"))))
    t = t.withColumns({"pid": F.when(F.col("pid") > 0, pid(F.col("pid"))).otherwise(F.col("pid")), "sw": sw, "wk": wk, "hostname": F.lit("h0")})
    return t.select(*[f.name for f in TRACE.fields]).persist()


def test_a_hot_task_is_cut(spark, trace):
    cuts = states.hot_tasks(trace, 100)
    points = states.task_points(trace).persist()
    total = points.count()
    assert points.where("pid = 2").count() > total / 3
    assert 2 in [r.pid for r in cuts.collect()] and spread(hot.Scan(("hostname", "pid"), PLACE, cuts), points, total) < 1 / 50
    assert states.hot_tasks(trace.where("pid % 97 = 1"), 1) is None


def test_intervals_of_a_hot_task(spark, trace):
    cuts = states.hot_tasks(trace, 100)
    cols = ["hostname", "pid", "cpu", "state", "mode", "start", "end", "ns", "ended_by", "waker", "scall", "ips", "seqno"]
    for gaps in (None, filters.capture_gaps(trace).where("start % 5 = 0").persist()):
        want = states.task_state_intervals(trace, gaps)
        assert rows(states.task_state_intervals(trace, gaps, cuts), *cols) == rows(want, *cols)
        assert want.where("pid = 2 and state = 'RUNNING'").count() > 50


def test_latencies_calls_and_last_values_of_a_hot_task(spark, trace):
    cuts = states.hot_tasks(trace, 100)
    want = states.runq_latency(trace, ad.topology(spark))
    assert rows(states.runq_latency(trace, ad.topology(spark), cuts), *want.columns) == rows(want) and want.where("pid = 2").count() > 5
    calls = syscalls.pair_syscalls(trace)
    assert rows(syscalls.pair_syscalls(trace, cuts=cuts), *calls.columns) == rows(calls) and calls.where("pid = 2").count() > 2
    last = {"last_call": F.when(F.col("event") == "sys_enter", F.col("sys.syscallno")), "last_cpu": F.col("cpu")}
    seen = windows.with_prev(trace, last).select("hostname", "pid", *PLACE, "event", *last)
    assert rows(windows.with_prev(trace, last, cuts=cuts), *seen.columns) == rows(seen)


def test_slices_without_any_value_and_next_rows(spark):
    df = spark.createDataFrame([("a", t, 5 if t in (3, 90) else None) for t in range(100)] + [("b", t, t) for t in range(3)] + [(None, 1, 1), (None, 2, None)], "k string, t long, v int")
    cuts = spark.createDataFrame([("a", [10, 11, 50, 95])], "k string, points array<bigint>")
    plain, cut = hot.Scan(("k",), ("t",)), hot.Scan(("k",), ("t",), cuts, "t")

    def done(scan):
        out = scan.last(scan.sliced(df), {"before": F.col("v"), "seen": F.lit(True)})
        out = scan.last(out, {"upto": F.col("v")}, upto=True)
        out = scan.next(out, "then", F.struct("t", "v"))
        out = scan.running(scan.running(out, "s", F.coalesce("v", F.lit(-1))), "low", F.col("s"), "min")
        return rows(scan.bare(out))

    assert done(cut) == done(plain)


def test_a_hot_device(spark):
    t = ad.block_trace(spark, SF)
    dev = F.when(F.col("blk.sector") % 24 == 0, F.lit(1)).otherwise(F.col("blk.dev"))
    t = t.withColumns({"hostname": F.lit("h0"), "blk": F.col("blk").withField("dev", dev)}).persist()
    cuts = blockio.hot_devices(t, 100)
    ops = t.where("event <> 'block_rq_complete'").select("hostname", "blk.dev", "hrtime")
    assert spread(hot.Scan(("hostname", "dev"), ("hrtime",), cuts), ops, ops.count()) < 1 / 40 and ops.where("dev = 1").count() > ops.count() / 3
    assert rows(blockio.queue_len(t, cuts=cuts)) == rows(blockio.queue_len(t))
    io = blockio.pair_block_io(t).withColumn("sector", F.expr("sector % 64"))
    assert rows(blockio.seq_random(io, cuts=cuts)) == rows(blockio.seq_random(io))
    near = io.withColumns({"sector": F.expr("(insert_ts div 3600000000000) * 8"), "nr_sectors": F.lit(24 * 8).cast("long")})
    got = blockio.seq_random(near, cuts=cuts)
    assert got.where("sequential").count() > 0 and rows(got) == rows(blockio.seq_random(near))
    assert rows(blockio.io_stats(io, cuts=cuts)) == rows(blockio.io_stats(io))
