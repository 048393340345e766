"""Streams that arrive out of order, late, in parts or twice give what batch gives."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake import adapters as ad
from tracelake.operators import blockio, power, states, syscalls
from tracelake.schema import TRACE, as_trace
from tracelake.streaming import drive, late, live, ordered, views

SF = "/root/testdata/sf0.001"
DAY = 24 * ad.HOUR
COLS = [f.name for f in TRACE.fields]


def files(spark, path, parts, delay="1 second"):
    """Each part as one file, in this order of arrival."""
    for k, part in enumerate(parts):
        part.select(*COLS).coalesce(1).write.parquet(f"{path}/p{k}")
        for d, _, names in os.walk(f"{path}/p{k}"):
            for n in names:
                os.utime(f"{d}/{n}", (1_700_000_000 + 100 * k,) * 2)
    return live.with_event_time(spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).parquet(f"{path}/p*"), delay)


def marker(spark, at, host="h9"):
    """An event of a host of its own that moves the watermark."""
    return as_trace(spark.createDataFrame([(host, at, "mark", 0, 0, -1)], "hostname string, hrtime long, event string, cpu int, cpu_seqno long, pid long"))


def by_time(trace, n):
    """A trace in n parts by time, each in no order."""
    lo, hi = trace.agg(F.min("hrtime"), F.max("hrtime")).first()
    cut = F.least(F.lit(n - 1), F.floor((F.col("hrtime") - lo) * n / (hi - lo + 1)))
    return [trace.where(cut == k).orderBy(F.xxhash64("cpu_seqno")) for k in range(n)], hi


def syncs(spark, rows):
    return as_trace(spark.createDataFrame(rows, "hostname string, hrtime long, event string, cpu int, cpu_seqno long, pid long"))


def lagging(spark, trace, chunks=5, silent=()):
    """Arrival in which each CPU lags by a number of parts of its own; a sync record ends each part of a CPU."""
    parts, hi = by_time(trace, chunks)
    lo = trace.agg(F.min("hrtime")).first()[0]
    keys = [tuple(r) for r in trace.select("hostname", "cpu").distinct().collect()]
    r = random.Random(4)
    lag = {k: r.randrange(3) for k in keys}
    arrival = []
    for step in range(chunks + 3):
        got, sync = None, []
        for (host, cpu), by in lag.items():
            if 0 <= step - by < chunks:
                mine = parts[step - by].where((F.col("hostname") == host) & (F.col("cpu") == cpu))
                got = mine if got is None else got.unionByName(mine)
                end = lo + (step - by + 1) * (hi - lo + 1) // chunks
                sync += [(host, t, "sync", cpu, 0, 0) for t in range(end - DAY * 8, end, DAY * 2)] if step - by else []
                sync.append((host, end if step - by < chunks - 1 else hi + 2 * DAY, "sync", cpu, 0, 0))
        sync = [x for x in sync if (x[0], x[3]) not in silent]
        if got is not None:
            arrival.append(got.unionByName(syncs(spark, sync)).orderBy(F.xxhash64("cpu_seqno", "hrtime")))
    return arrival, hi


def merged(df):
    out = defaultdict(list)
    for r in df.orderBy("hostname", "slice", "place").collect():
        out[r.hostname].append((r.hrtime, r.cpu, r.cpu_seqno, r.event, str(r.sw), str(r.sys), str(r.wk)))
    return out


def batch_order(trace):
    out = defaultdict(list)
    for r in trace.collect():
        out[r.hostname].append((r.hrtime, r.cpu, r.cpu_seqno, r.event, str(r.sw), str(r.sys), str(r.wk)))
    return {h: sorted(v, key=lambda x: x[:3]) for h, v in out.items()}


@pytest.fixture(scope="module")
def trace(spark):
    return ad.task_trace(spark, SF).select(*COLS).persist()


def test_cpus_merge_in_order(spark, trace, tmp_path):
    arrival, _ = lagging(spark, trace, 3)
    stream = files(spark, str(tmp_path), arrival, "400 days")  # nothing is forced, the sync records alone decide
    got = drive.drained(ordered.ordered(stream, ad.topology(spark), 6 * ad.HOUR, 80))
    assert merged(got) == batch_order(trace)
    assert got.where("late or not complete").count() == 0


def test_a_silent_cpu_does_not_hold_its_host(spark, trace, tmp_path):
    arrival, hi = lagging(spark, trace, 3, {("h0", 2)})
    stream = files(spark, str(tmp_path), [*arrival, marker(spark, hi + 200 * DAY), marker(spark, hi + 300 * DAY)], "40 days")
    got = drive.drained(ordered.ordered(stream, ad.topology(spark), DAY)).where("hostname <> 'h9'")
    assert merged(got) == batch_order(trace)
    told = {(r.hostname, r.complete) for r in got.select("hostname", "complete").distinct().collect()}
    assert ("h0", True) not in told and ("h1", True) in told


def test_events_after_their_slice_has_left_are_late(spark, trace, tmp_path):
    t0 = 1_704_067_200_000_000_000
    row = lambda t, c, n: ("h0", t0 + t * DAY // 10, "sys_enter", c, n, 7)
    sync = lambda t, c: ("h0", t0 + t * DAY // 10, "sync", c, 0, 0)
    top = spark.createDataFrame([("h0", 0), ("h0", 1)], "hostname string, cpu int")
    parts = [syncs(spark, [row(3, 0, 1), row(1, 1, 2), sync(12, 0)]), syncs(spark, [row(2, 1, 3), sync(11, 1)]), syncs(spark, [row(4, 1, 4), row(1, 0, 5), row(12, 1, 6), sync(25, 0), sync(25, 1)])]
    stream = files(spark, str(tmp_path), parts, "40 days")
    got = drive.drained(ordered.ordered(stream, top, DAY, 4)).select("cpu_seqno", F.expr("slice - 19723").alias("slice"), "place", "complete", "late").orderBy("slice", "place").collect()
    assert [tuple(r) for r in got] == [(2, 0, 0, True, False), (3, 0, 1, True, False), (1, 0, 2, True, False), (5, 0, 3, False, True), (4, 0, 4, False, True), (6, 1, 0, True, False)]


def split(rows, every, end):
    """(start, end, key, value) intervals cut at the ends of windows."""
    out = defaultdict(int)
    for a, b, key in rows:
        b = min(end, end if b is None else b)
        while a < b:
            stop = min(b, (a // every + 1) * every)
            out[(a // every, *key)] += stop - a
            a = stop
    return dict(out)


def test_windows_of_states_are_those_of_batch(spark, trace, tmp_path):
    parts, hi = by_time(trace, 4)
    last = hi // DAY * DAY
    stream = files(spark, str(tmp_path), [*parts, marker(spark, hi + 3 * DAY), marker(spark, hi + 4 * DAY)])
    got = drive.drained(live.stream_task_states(stream, DAY)).collect()
    iv = states.task_state_intervals(trace).where("state in ('RUNNING', 'RUNQ', 'SWTCH')").select("start", F.when(F.col("ended_by").isNotNull(), F.col("end")).alias("end"), "hostname", "pid", "state").collect()
    want = split([(r.start, r.end, (r.hostname, r.pid, r.state)) for r in iv], DAY, last)
    days = defaultdict(int)
    for r in got:
        days[(int(r.start.timestamp() if r.start.tzinfo else (r.start - __import__("datetime").datetime(1970, 1, 1)).total_seconds()) // 86400, r.hostname, r.id, r.state)] += r.ns
    assert {k: v for k, v in days.items() if v and k[0] * DAY < last} == want
    assert len({(r.start, r.hostname, r.id, r.state, r.label) for r in got}) == len(got)  # a window leaves once
    busy = drive.drained(live.live_busy(files(spark, str(tmp_path / "again"), [*parts, marker(spark, hi + 3 * DAY), marker(spark, hi + 4 * DAY)]), DAY)).where(F.col("start") < F.timestamp_micros(F.lit(last // 1000))).collect()
    total = lambda s: sum(v for k, v in want.items() if k[-1] == s)
    assert (sum(r.run_ns for r in busy), sum(r.runq_ns for r in busy), sum(r.sleep_ns for r in busy)) == (total("RUNNING"), total("RUNQ"), total("SWTCH"))


def test_calls_stay_open_over_windows_and_batches(spark, trace, tmp_path):
    parts, hi = by_time(trace, 4)
    stream = files(spark, str(tmp_path), [*parts, marker(spark, hi + 3 * DAY), marker(spark, hi + 4 * DAY)])
    got = drive.drained(live.live_calls(stream, "1 day", 1 << 40))
    calls = syscalls.pair_syscalls(trace)
    want = calls.groupBy(F.window(F.timestamp_micros(F.expr("exit div 1000")), "1 day")["start"].alias("start"), "hostname", "syscallno").agg(
        F.count("*").alias("n"), F.sum("elapsed").alias("ns"), F.max("elapsed").alias("max_ns"), F.count_if(syscalls.is_err(F.col("ret"))).alias("errs"), F.sum(syscalls.moved_bytes()).alias("bytes"))
    key = lambda d: sorted(map(tuple, d.select(want.columns).collect()))
    assert key(got) == key(want) and calls.where(f"exit div {DAY} > enter div {DAY}").count() > 0


def test_requests_over_batches_equal_batch(spark, tmp_path):
    blocks = ad.block_trace(spark, SF).where("blk.dev % 3 = 0").select(*COLS)
    want = blockio.pair_block_io(blocks).select("hostname", "dev", "sector", "insert_ts", "issue_ts", "complete_ts", "qtm", "svtm", F.col("nr_sectors").alias("sectors")).persist()
    # The first batch ends while a request is open.
    held = want.where("insert_ts < issue_ts and issue_ts < complete_ts").orderBy(F.xxhash64("insert_ts", "sector"), "insert_ts").first()
    parts = [blocks.where(F.col("hrtime") <= held.issue_ts), blocks.where(F.col("hrtime") > held.issue_ts)]
    got = drive.drained(live.stream_pair_block(files(spark, str(tmp_path), parts), 1 << 40))
    key = lambda d: sorted(map(str, d.select(want.columns).collect()))
    assert key(got) == key(want) and want.count() > 300


def test_interrupts_equal_batch(spark, tmp_path):
    cpus = ad.cpu_trace(spark, SF)
    parts, _ = by_time(cpus, 3)
    got = drive.drained(live.stream_pair_irq(files(spark, str(tmp_path), parts)))
    want = power.pair_irq(cpus)
    key = lambda d: sorted(map(tuple, d.select(want.columns).collect()))
    assert key(got) == key(want) and want.count() > 20


def test_views_go_on_after_a_failure_without_doubles(spark, trace, tmp_path, monkeypatch):
    parts, hi = by_time(trace.unionByName(ad.cpu_trace(spark, SF)).unionByName(ad.profile_trace(spark, SF)), 4)
    arrival = [*parts, marker(spark, hi + 3 * DAY), marker(spark, hi + 4 * DAY)]
    files(spark, str(tmp_path / "in"), arrival)
    named = spark.createDataFrame([("h0", 2, "web"), ("h1", 3, "db")], "hostname string, pid long, name string")

    def run(out, state):
        stream = live.with_event_time(spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p*")), "1 second")
        q = views.start(views.measures(stream, DAY, named, 1 << 40), str(tmp_path / out), str(tmp_path / state), 100_000, DAY, once=True)
        q.awaitTermination()

    run("whole", "whole-state")
    good, seen = views.ranked, []

    def fails(df, n, every):
        seen.append(1)
        if len(seen) == 3:
            good(df, n, every).write.parquet(f"{tmp_path}/broken/batch=2")  # written, but never committed
            raise RuntimeError("lost")
        return good(df, n, every)

    monkeypatch.setattr(views, "ranked", fails)
    with pytest.raises(Exception, match="lost"):
        run("broken", "broken-state")
    run("broken", "broken-state")
    rows = lambda x: sorted(map(str, views.written(spark, str(tmp_path / x)).drop("batch").collect()))
    assert rows("whole") == rows("broken")
    told = views.written(spark, str(tmp_path / "whole"))
    assert {r.view for r in told.select("view").distinct().collect()} == set(views.VIEWS) - {"disk", "futex"}
    assert told.groupBy("start", "hostname", "view", "entity", "key").count().where("count > 1").count() == 0
    tasks = told.where("view = 'task'").groupBy("hostname").agg(F.sum("ns").alias("ns")).collect()
    boxes = {r.hostname: r.ns for r in told.where("view = 'container'").groupBy("hostname").agg(F.sum("ns").alias("ns")).collect()}
    assert boxes == {r.hostname: r.ns for r in tasks}
    assert {r.key for r in told.where("view = 'container'").select("key").distinct().collect()} == {"web", "db", "system"}
    one = told.where("view = 'task.syscall'").first()
    q = views.start(views.measures(live.with_event_time(spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p*")), "1 second"), DAY, named, 1 << 40), str(tmp_path / "drill"), str(tmp_path / "drill-state"), 100_000, DAY, {"view": "task.syscall", "entity": one.entity}, True)
    q.awaitTermination()
    assert sorted(map(str, views.written(spark, str(tmp_path / "drill")).drop("batch").collect())) == sorted(map(str, told.where(f"view = 'task.syscall' and entity = '{one.entity}'").drop("batch").collect()))


def test_late_rows_are_kept_and_counted(spark, trace, tmp_path):
    parts, hi = by_time(trace, 4)
    arrival = [parts[2], parts[1], parts[3], parts[0]]
    stream = files(spark, str(tmp_path / "in"), arrival)
    kept = []
    late.late_split(stream, str(tmp_path / "state"), str(tmp_path / "late"), lambda df, k: kept.append(df.count()), once=True).awaitTermination()
    ends = [p.agg(F.max("hrtime")).first()[0] for p in arrival]
    want, mark = [], None
    for k, p in enumerate(arrival):
        if k > 1:
            mark = max(ends[: k - 1]) // 1_000_000 - 1000  # milliseconds; the watermark of the batch before
            want += [r.cpu_seqno for r in p.where(F.expr("hrtime div 1000000") < mark).collect()]
    got = spark.read.schema(f"{late.LATE}, batch int").parquet(str(tmp_path / "late"))
    assert sorted(r.cpu_seqno for r in got.collect()) == sorted(want) and sum(kept) + len(want) == trace.count() and len(want) > 100
    assert got.where("behind_ms <= 0").count() == 0


def test_dropped_rows_are_recorded(spark, trace, tmp_path):
    parts, hi = by_time(trace, 3)
    drops = late.Drops(spark, str(tmp_path / "drops"))
    spark.streams.addListener(drops)
    try:
        drive.drained(live.live_stats(files(spark, str(tmp_path / "in"), [parts[2], parts[1].limit(1), parts[0], marker(spark, hi + 9 * DAY)]), "1 day"))
        for _ in range(100):
            if os.path.isdir(tmp_path / "drops") and drops.table().agg(F.max("batch")).first()[0] in (3, 4):
                break
            __import__("time").sleep(0.3)
    finally:
        spark.streams.removeListener(drops)
    rows = drops.table().collect()
    day = parts[2].agg(F.max("hrtime")).first()[0] // 1_000_000 - 1000
    groups = parts[0].where(F.expr(f"(hrtime div {DAY} + 1) * {DAY // 1_000_000}") <= day).select(F.expr(f"hrtime div {DAY}"), "hostname", "event").distinct().count()
    assert sum(r.dropped for r in rows) == groups > 0  # the aggregate drops groups of a window, summed in each task before


def test_lost_events_show_in_the_stream(spark, tmp_path):
    rows = [("h0", 1_000_000 * n, "sys_enter", n % 2, n // 2, 7) for n in range(40) if n // 2 not in (5, 6, 11)]
    parts = [syncs(spark, rows[:20]), syncs(spark, rows[20:])]
    got = drive.drained(late.stream_lost(files(spark, str(tmp_path), parts))).select("cpu", "start", "end", "events_lost").orderBy("cpu", "start").collect()
    assert [tuple(r) for r in got] == [(c, (8 + c) * 1_000_000, (14 + c) * 1_000_000, 2) if k == 0 else (c, (20 + c) * 1_000_000, (24 + c) * 1_000_000, 1) for c in (0, 1) for k in (0, 1)]
