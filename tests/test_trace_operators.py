"""Small traces with answers worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import blockio, dims, filters, graph, power, stacks, states, syscalls, topn, win, windows
from tracelake.schema import TRACE

HEAD = ["hostname", "capture_id", "hrtime", "event", "cpu", "cpu_seqno", "pid", "tgid"]


def trace(spark, events):
    """Events as (time, event, pid, family fields), or with a cpu as fifth entry."""
    rows = []
    for n, e in enumerate(events):
        t, event, pid, fields = e[:4]
        cpu = e[4] if len(e) > 4 else 0
        row = {"hostname": "h", "capture_id": "c", "hrtime": t, "event": event, "cpu": cpu, "cpu_seqno": n, "pid": pid, "tgid": pid}
        for f in TRACE.fields[8:]:
            names = [x.name for x in f.dataType.fields]
            row[f.name] = {x: fields.get(x) for x in names} if fields and fields.get("_") == f.name else None
        rows.append(tuple(row[f.name] if not isinstance(row[f.name], dict) else tuple(row[f.name].values()) for f in TRACE.fields))
    return spark.createDataFrame(rows, TRACE)


def sw(prev_state, nxt, **more):
    return {"_": "sw", "prev_state": prev_state, "next_pid": nxt, **more}


def sysc(no, **more):
    return {"_": "sys", "syscallno": no, **more}


def wake(pid, new=False):
    return {"_": "wk", "target_pid": pid, "success": 1, "is_new": new}


def blk(sector, n=8, flags=1, dev=8):
    return {"_": "blk", "dev": dev, "sector": sector, "nr_sectors": n, "cmd_flags": flags}


M1 = [(0, "sched_switch", 0, sw(0, 10)), (10, "sys_enter", 10, sysc(1)), (30, "sched_switch", 10, sw(1, 0)), (70, "sched_wakeup", 20, wake(10)), (75, "sched_switch", 0, sw(0, 10)), (90, "sys_exit", 10, sysc(1, ret=0)), (100, "sys_enter", 10, sysc(1))]


def test_state_times(spark):
    r = states.task_cpu(trace(spark, M1)).where("pid = 10").first()
    assert (r.sys_ns, r.user_ns, r.run_ns, r.sleep_ns, r.runq_ns, r.total_ns, r.switches, r.sleeps) == (45, 10, 55, 40, 5, 100, 1, 1)
    lat = states.runq_latency(trace(spark, [(t * 1000, *x) for t, *x in M1])).collect()
    assert [(x.pid, x.latency_us) for x in lat] == [(10, 5)]


def test_block_lifecycle_and_statistics(spark):
    t = trace(spark, [(0, "block_rq_insert", 1, blk(100)), (5, "block_rq_issue", 1, blk(100)), (25, "block_rq_complete", 0, blk(100)), (30, "block_rq_insert", 1, blk(108)), (31, "block_rq_issue", 1, blk(108)), (41, "block_rq_complete", 0, blk(108)), (50, "block_rq_issue", 1, blk(500)), (60, "block_rq_complete", 0, blk(500))])
    io = blockio.pair_block_io(t)
    assert [(r.svtm, r.qtm) for r in io.orderBy("complete_ts").collect()] == [(20, 5), (10, 1), (10, 0)]
    s = blockio.io_stats(io).where("rw is null").first()
    assert (s.ios, s.seq, s.rnd, s.kb) == (3, 1, 2, 12)
    both = {r.rw: r.ios for r in blockio.io_stats(io).collect()}
    assert both[None] == sum(v for k, v in both.items() if k is not None)


def test_merged_request(spark):
    t = trace(spark, [(0, "block_rq_insert", 7, blk(200)), (4, "block_rq_issue", 9, blk(192, 16)), (9, "block_rq_complete", 0, blk(192, 16))])
    r = blockio.pair_block_io(t, resolve=True).first()
    assert (r.qtm, r.svtm, r.insert_pid) == (4, 5, 7)


def test_syscall_pairs(spark):
    t = trace(spark, [(0, "sys_enter", 1, sysc(1)), (4, "sys_exit", 1, sysc(1, ret=512)), (5, "sys_enter", 1, sysc(0)), (6, "sys_exit", 1, sysc(3, ret=0)), (7, "sys_enter", 1, sysc(1)), (9, "sys_exit", 1, sysc(1, ret=-11))])
    rows = syscalls.syscall_stats(syscalls.pair_syscalls(t)).collect()
    assert [(r.syscallno, r.cnt, r.elapsed_ns, r.max_ns, r.errs, r.bytes) for r in rows] == [(1, 2, 6, 4, 1, 512)]


def test_futex(spark):
    e, t = [], 0
    for ret, d in ((0, 10), (-11, 1), (-110, 100)):
        e += [(t, "sys_enter", 1, sysc(202, args=[16, 0])), (t + d, "sys_exit", 1, sysc(202, ret=ret))]
        t += d + 1
    r = syscalls.futex_stats(syscalls.futex_calls(syscalls.pair_syscalls(trace(spark, e)))).first()
    assert (r.addr, r.space, r.cnt, r.eagain, r.etimedout, r.elapsed_ns, r.max_ns) == (16, 0, 3, 1, 1, 111, 100)


def test_herd(spark):
    e = [(k, "sched_wakeup", 5, wake(p)) for k, p in enumerate((6, 7, 7, 8))] + [(5, "sys_exit", 5, sysc(1)), (6, "sched_wakeup", 5, wake(9))]
    r = states.wakeup_streaks(trace(spark, e)).first()
    assert (r.pid, r.max_wakeups, r.hits) == (5, 3, 1)


def test_gap(spark):
    t = trace(spark, [(0, "sched_switch", 0, sw(0, 10)), (50, "sys_enter", 11, sysc(1)), (60, "sys_exit", 11, sysc(1))])
    gaps = filters.capture_gaps(t)
    assert [(g.start, g.end, g.gap_ns) for g in gaps.collect()] == [(0, 50, 50)]
    iv = states.task_state_intervals(t, gaps)
    assert iv.where("pid = 10").agg(F.sum("ns")).first()[0] == 0
    masked = filters.mask_gaps(states.task_state_intervals(t).select("hostname", "pid", "cpu", "state", "start", "end", "ns"), gaps)
    assert masked.where("pid = 10 and state = 'UNKNOWN'").count() == 1


def test_hyper_threads(spark):
    topo = spark.createDataFrame([("h", 0, 0, 1, 0), ("h", 1, 0, 0, 0)], "hostname string, cpu int, ldom int, lcpu_sibling int, pcpu_idx int")
    t = trace(spark, [(0, "sched_switch", 0, sw(0, 5), 0), (0, "sched_switch", 6, sw(1, 0), 1), (5, "sched_switch", 0, sw(0, 6), 1), (10, "sched_switch", 5, sw(1, 0), 0), (20, "sched_switch", 0, sw(0, 0), 0)])
    r = states.ht_usage(t, topo).first()
    assert (r.lcpu1_busy, r.double_busy, r.lcpu2_busy, r.double_idle) == (5, 5, 10, 0)


def test_wait_graph(spark):
    edges = spark.createDataFrame([("h", 2, 1, 1, 50), ("h", 3, 2, 1, 40), ("h", 1, 4, 1, 30), ("h", 3, 4, 1, 5)], "hostname string, waker long, sleeper long, cnt long, sleep_ns long")
    totals = spark.createDataFrame([("h", 1, 50), ("h", 2, 40), ("h", 4, 100)], "hostname string, pid long, sleep_total long")
    nodes, links = graph.wait_graph(edges, totals, 1, 2, 10.0)
    assert {(r.pid, r.depth) for r in nodes.collect()} == {(1, 0), (2, 1), (4, 1), (3, 2)} and links.count() == 3


def test_buckets(spark):
    lat = spark.createDataFrame([("h", 0, x) for x in (4, 5, 20000, 20001)], "hostname string, cpu int, latency_us long")
    assert {r.bucket: r.n for r in states.runq_hist(lat).collect()} == {0: 1, 1: 1, 10: 2}
    io = spark.createDataFrame([("h", 8, 0, int(ms * 1e6)) for ms in (1.9, 2, 199, 200)], "hostname string, dev long, rw int, svtm long")
    assert {r.bucket: r.n for r in blockio.io_hist(io).collect()} == {0: 1, 1: 1, 8: 1, 9: 1}
    with pytest.raises(ValueError, match="edges"):
        blockio.io_hist(io, [3, 2])


def test_snapshot_difference(spark):
    s = "k string, a long, b long"
    got = dims.snapshot_diff(spark.createDataFrame([("a", 10, 100), ("c", 1, 1)], s), spark.createDataFrame([("a", 15, 160), ("b", 1, 1), ("c", 1, 1)], s), ["k"], ["a", "b"])
    assert {(r.k, r.a, r.b, r.flag, r.ratio) for r in got.collect()} == {("a", 5, 60, "", 12.0), ("b", 1, 1, "***", 1.0)}


def sample(mode):
    return {"_": "hc", "preempt_count": 0, "ips": [-512 if mode == "USER" else -128, 1]}


def test_sample_labels_the_open_interval(spark):
    t = trace(spark, [(0, "sched_switch", 0, sw(0, 10)), (6, "hardclock", 10, sample("USER")), (10, "sched_switch", 10, sw(1, 0))])
    r = states.task_cpu(t).where("pid = 10").first()
    assert (r.user_ns, r.sys_ns) == (10, 0)


def fold(events, end):
    """A direct fold of the rules over one task: (run, sleep, runq, user, sys) charged."""
    base, mode, since, seen = "N", None, None, {"R": 0, "S": 0, "Q": 0, "USER": 0, "SYS": 0}
    pending = 0  # run time whose mode is not known yet, labelled by a later sample

    def charge(t):
        nonlocal pending
        if since is None or base == "N":
            return
        d = t - since
        if base in ("R", "S", "Q"):
            seen[base] += d
        if base == "R":
            seen[mode or "SYS"] += d

    for t, kind, arg in events:
        if kind == "wake" and base == "R":
            continue
        charge(t)
        since = t
        if kind == "in":
            base = "R"
        elif kind == "out":
            base = "S" if arg else "Q"
        elif kind == "wake":
            base = "Q"
        elif kind == "enter":
            base, mode = "R", "SYS"
        elif kind == "exit":
            base, mode = "R", "USER"
    charge(end)
    return tuple(seen[k] for k in ("R", "S", "Q", "USER", "SYS"))


@pytest.mark.parametrize("seed", range(3))
def test_states_against_a_fold(spark, seed):
    r = random.Random(seed)
    events, want, n = [], {}, 0
    for pid in range(10, 30):
        t, own = 0, []
        for _ in range(r.randrange(1, 25)):
            t += r.randrange(1, 20)
            kind = r.choice(["in", "out", "wake", "enter", "exit"])
            own.append((t, kind, r.randrange(2)))
        want[pid] = own
        for t, kind, arg in own:
            n += 1
            events.append({"in": (t, "sched_switch", 0, sw(0, pid)), "out": (t, "sched_switch", pid, sw(arg, 0)), "wake": (t, "sched_wakeup", 1, wake(pid)), "enter": (t, "sys_enter", pid, sysc(1)), "exit": (t, "sys_exit", pid, sysc(1))}[kind])
    end = 1000
    events.append((0, "sys_enter", 1, sysc(1)))
    events.append((end, "sys_exit", 1, sysc(1)))
    got = {x.pid: (x.run_ns, x.sleep_ns, x.runq_ns, x.user_ns, x.sys_ns) for x in states.task_cpu(trace(spark, events)).where("pid >= 10").collect()}
    assert got == {p: fold(o, end) for p, o in want.items()}


def test_shuffled_input_gives_the_same(spark):
    t = trace(spark, M1)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(states.task_state_intervals(t)) == key(states.task_state_intervals(t.orderBy(F.rand(3)).repartition(4)))


def test_interrupts(spark):
    irq = lambda k, n: {"_": "irq", "kind": k, "irq": n, "name": "x"}
    t = trace(spark, [(0, "softirq_entry", 1, irq("soft", 1)), (5, "irq_handler_entry", 1, irq("hard", 2)), (8, "irq_handler_exit", 1, irq("hard", 2)), (20, "softirq_exit", 1, irq("soft", 1)), (30, "irq_handler_exit", 1, irq("hard", 3))])
    assert {(r.kind, r.irq, r.time) for r in power.pair_irq(t).collect()} == {("hard", 2, 3), ("soft", 1, 17)}


def test_power(spark):
    p = lambda s: {"_": "pwr", "state": s, "tgt_cpu": 0}
    t = trace(spark, [(0, "sys_enter", 1, sysc(1)), (10, "power_start", 0, p(2)), (40, "power_end", 0, p(2)), (100, "sys_exit", 1, sysc(1))])
    assert {(r.cstate, r.ns) for r in power.power_stats(t).collect()} == {(0, 70), (2, 30)}


def test_symbols(spark):
    s = spark.createDataFrame([("a", 0x1000), ("b", 0x2000), ("k", -0x7FFF0000)], "sym string, addr long")
    d = spark.createDataFrame([(x,) for x in (0x1004, 0x2000, 0x1FFF, 0xFFF, 0x2000 + 0x10000, 0x11FFF, -0x7FFF0000 + 5, -512)], "pc long")
    got = {r.pc: (r.sym, r.offset) for r in stacks.symbolize(d, s, "pc").collect()}
    assert got == {0x1004: ("a", 4), 0x2000: ("b", 0), 0x1FFF: ("a", 0xFFF), 0xFFF: (None, None), 0x12000: (None, None), 0x11FFF: ("b", 0xFFFF), -0x7FFF0000 + 5: ("k", 5), -512: (None, None)}


def test_trim(spark):
    d = spark.createDataFrame([([-128, 1, 2, 9, 3, -512, 9, 4],), ([9, 9, 5],), ([5, 6],), ([],)], "ips array<bigint>")
    assert [r[0] for r in d.select(stacks.trim_stack(F.col("ips"), [9])).collect()] == [[3, -512, 9, 4], [5], [5, 6], []]


def test_async_io(spark):
    calls = spark.createDataFrame(
        [("h", 1, 209, [7], 0, 1, [(11, 0, 3, 0, 100), (12, 7, 3, 0, 50)], None), ("h", 1, 208, [7], 5, 9, None, [(11, 100), (12, 49), (13, 1)]), ("h", 1, 209, [7], 10, 11, [(11, 1, 3, 0, 8)], None), ("h", 1, 208, [7], 12, 15, None, [(11, 7)])],
        "hostname string, pid long, syscallno int, args array<long>, enter long, exit long, iocbs array<struct<iocb: long, op: int, fd: int, offset: long, nbytes: long>>, io_events array<struct<obj: long, res: long>>")
    assert {(r.iocb, r.op, r.bytes, r.elapsed) for r in syscalls.pair_aio(calls).collect()} == {(11, 0, 100, 9), (12, 7, 49, 9)}


def test_bindings(spark):
    t = trace(spark, [(0, "sys_enter", 1, sysc(2, args=[3])), (1, "sys_exit", 1, sysc(2, ret=3, dev=8, inode=77)), (2, "sys_enter", 1, sysc(0, args=[3])), (3, "sys_exit", 1, sysc(0, ret=10)), (4, "sys_enter", 1, sysc(0, args=[4])), (5, "sys_exit", 1, sysc(0, ret=5)), (6, "sys_enter", 1, sysc(0, args=[5])), (7, "sys_exit", 1, sysc(0, ret=-9))])
    snap = spark.createDataFrame([("h", 1, 1, 4, 9, 88, None, None, None, None, "f")], "hostname string, pid long, tgid long, fd long, dev long, node long, laddr string, lport int, raddr string, rport int, fname string")
    got = {(r.fd, r.exit): (r.dev, r.node) for r in syscalls.bind_fd(syscalls.pair_syscalls(t), snap).collect()}
    assert got == {(3, 1): (8, 77), (3, 3): (8, 77), (4, 5): (9, 88)}


def test_lineage(spark):
    calls = spark.createDataFrame([("h", 1, 1, 56, [0x10000], 50, 1, None), ("h", 1, 1, 57, [0], 60, 2, None), ("h", 60, 60, 59, [0], 0, 3, "/bin/x")], "hostname string, pid long, tgid long, syscallno int, args array<long>, ret long, exit long, filename string")
    procs = spark.createDataFrame([("h", 1, 0, "init")], "hostname string, pid long, ppid long, cmd string")
    assert {(r.pid, r.tgid, r.ppid, r.cmd) for r in syscalls.lineage(calls, procs).collect()} == {(50, 1, 0, "init"), (60, 60, 1, "/bin/x")}


def test_nested_calls(spark):
    d = spark.createDataFrame([("h", 1, t, t, e, a) for t, e, a in [(0, "sys_exit", 0), (1, "sys_enter", 5), (2, "sys_enter", 6), (3, "sys_exit", 0), (9, "sys_exit", 0)]], "hostname string, pid long, hrtime long, cpu_seqno long, event string, address long")
    assert {(r.address, r.elapsed, r.depth) for r in win.pair_syscalls_nested(d).collect()} == {(6, 1, 2), (5, 8, 1)}


def test_queue_never_below_zero(spark):
    t = trace(spark, [(0, "block_rq_issue", 1, blk(1)), (1, "block_rq_insert", 1, blk(2)), (2, "block_rq_insert", 1, blk(3)), (3, "block_rq_issue", 1, blk(2))])
    r = blockio.queue_len(t).first()
    assert (r.maxque, r.avque, r.queue_ops) == (2, 1.0, 4)


def test_barriers(spark):
    d = spark.createDataFrame([(0, 1 << 14), (5, 1 << 14), (-1, 0)], "sector long, flags long")
    assert [tuple(r) for r in d.select(filters.valid_sector(F.col("sector")), filters.is_barrier(F.col("sector"), F.col("flags"))).collect()] == [(False, True), (True, False), (False, False)]


def test_timeline_sums_to_the_whole(spark):
    t = trace(spark, [(x * 1_000_000, *rest) for x, *rest in M1])
    iv = states.task_state_intervals(t)
    got = windows.timeline(t, iv, 7)
    assert got.agg(F.sum("run_ns"), F.sum("sleep_ns")).first()[:] == (55_000_000, 40_000_000) and got.count() == 15


def test_pareto_and_pages(spark):
    d = spark.createDataFrame([("h", "a", 50), ("h", "b", 30), ("h", "c", 15), ("h", "d", 5)], "hostname string, k string, n long")
    assert [r.k for r in windows.pareto(d, "n", 80.0).orderBy("rank").collect()] == ["a", "b"]
    assert [r.k for r in topn.page(d, "n", 2, 1).collect()] == ["b", "c"] and [r.k for r in topn.page(d, "n", -3).collect()] == ["d"]


def test_wakeup_edges_and_trees(spark):
    t = trace(spark, [(0, "sched_switch", 10, sw(1, 0, ips=[5])), (1, "sys_enter", 20, sysc(1, args=[9])), (10, "sched_wakeup", 20, wake(10)), (11, "sched_wakeup", 10, wake(10)), (20, "sched_switch", 0, sw(0, 10))])
    e = graph.wakeup_edges(graph.wakeups(t)).collect()
    assert [(r.waker, r.sleeper, r.w_scall, r.w_arg0, r.slpfunc, r.cnt, r.sleep_ns) for r in e] == [(20, 10, 1, 9, 5, 1, 10)]
    tree = graph.coop_tree(graph.wakeup_edges(graph.wakeups(t)))
    assert sorted(r.level for r in tree.collect()) == [0, 1, 2, 3, 4, 5] and {r.sleep_ns for r in tree.collect()} == {10}
    assert [(r.pid, r.ns) for r in graph.waited_for(graph.wakeup_edges(graph.wakeups(t))).collect()] == [(20, 10)]


def test_slices_change_nothing(spark):
    from tracelake import adapters as ad

    t = ad.block_trace(spark, "/root/testdata/sf0.001")
    io = blockio.pair_block_io(t).cache()
    rows = lambda d: sorted(map(str, d.collect()))
    for slices in (40, 2000):
        cuts = blockio.hot_devices(t, slices)
        assert cuts is not None
        assert rows(blockio.queue_len(t, cuts=cuts)) == rows(blockio.queue_len(t))
        assert rows(blockio.seq_random(io, cuts=cuts)) == rows(blockio.seq_random(io))
    near = io.withColumn("sector", F.expr("(seqno % 3) * nr_sectors")).cache()  # many that follow each other
    got = blockio.seq_random(near, cuts=cuts)
    assert got.where("sequential").count() > 0 and rows(got) == rows(blockio.seq_random(near))


def test_pareto_bands(spark):
    values = [0, -3, None, 1, 1, 1, 2, 3, 5, 8, 1000, 1000, 1023, 1024, 1025, 5000]
    d = spark.createDataFrame([("h", v, i) for i, v in enumerate(values)], "hostname string, n bigint, k int")
    order = sorted(enumerate(values), key=lambda x: (-x[1] if x[1] is not None else 1e9, x[0]))
    total, before, want = sum(v or 0 for v in values), 0, []
    for i, v in order:
        if 100.0 * before / total < 95.0:
            want.append(i)
        before += v or 0
    assert [r.k for r in windows.pareto(d, "n", 95.0, tie=("k",)).orderBy("rank").collect()] == want


def test_graphs_of_many_roots_are_those_of_each(spark):
    import random

    r = random.Random(5)
    data = [("h", r.randrange(1, 40), r.randrange(1, 40), 1, r.randrange(1, 100)) for _ in range(90)]
    e = spark.createDataFrame([x for x in data if x[1] != x[2]], "hostname string, waker long, sleeper long, cnt long, sleep_ns long")
    totals = e.groupBy("hostname", F.col("sleeper").alias("pid")).agg(F.sum("sleep_ns").alias("sleep_total"))
    roots = spark.createDataFrame([("h", 1), ("h", 2), ("h", 3), ("h", 3), ("h", 999)], "hostname string, pid long")
    nodes, links = graph.wait_graphs(e, totals, roots, 3, 20.0, 2)
    got, joined = nodes.collect(), links.collect()
    assert {x.root for x in got} <= {1, 2, 3} and len({(x.root, x.pid) for x in got}) == len(got)
    for root in {x.root for x in got}:
        n, ln = graph.wait_graph(e, totals, root, 3, 20.0, 2)
        assert sorted((x.pid, x.depth) for x in got if x.root == root) == sorted((x.pid, x.depth) for x in n.collect())
        assert sorted((x.waker, x.sleeper, x.sleep_ns) for x in joined if x.root == root) == sorted((x.waker, x.sleeper, x.sleep_ns) for x in ln.collect())
