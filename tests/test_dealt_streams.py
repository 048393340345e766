"""Calls and stretches of many tasks come from one key of a stream, as they came from a key for each task."""

import random
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd

from tracelake import adapters as ad
from tracelake.schema import TRACE
from tracelake.streaming import drive, live, views

TASKS, EVERY = 40, 1_000_000_000


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def held(processor):
    """A processor with a state of its own, and the timers that it asked for."""
    state, timers = Value(), []
    processor.init(SimpleNamespace(getValueState=lambda name, schema: state, registerTimer=timers.append))
    return processor, state, timers


def parted(rows, seed, n=4):
    """Rows in n parts by time, each in no order and in chunks."""
    rows = sorted(rows, key=lambda r: r["hrtime"])
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        random.Random(seed + k).shuffle(part)
        yield [pd.DataFrame(part[:7]), pd.DataFrame(part[7:])]


def test_calls_of_many_tasks_share_a_key():
    r = random.Random(1)
    rows = [dict(pid=r.randrange(TASKS), hrtime=t * 1_000_000, cpu=0, cpu_seqno=t, enter=r.random() < 0.5, syscallno=r.choice([1, 2, 2, -1]), arg0=(1 << 60) + t, ret=(1 << 60) - t, dev=0, inode=0, laddr=None, raddr="x", nulls=r.choice([0, 2, 4, 24, 1])) for t in range(2000)]
    want, open_ = [], {}
    for x in rows:
        number = None if x["nulls"] & 1 else x["syscallno"]
        if x["enter"]:
            open_[x["pid"]] = (number, x)
        elif number is not None and x["pid"] in open_ and number in (open_[x["pid"]][0], -1):
            first, e = open_.pop(x["pid"])
            want.append((x["pid"], first, e["hrtime"], x["hrtime"], None if e["nulls"] & 2 else e["arg0"], None if x["nulls"] & 4 else x["ret"]))
    p, state, timers = held(live.PairSyscalls(5))
    got = [o for part in parted(rows, 5) for o in p.handleInputRows(("h0", 0), iter(part), None)]
    tell = lambda x: None if pd.isna(x) else int(x)
    told = [(x.pid, tell(x.syscallno), x.enter, x.exit, tell(x.arg0), tell(x.ret)) for df in got for x in df.astype({"arg0": object, "ret": object}).itertuples()]
    assert sorted(map(str, told)) == sorted(map(str, want)) and len(want) > 200
    assert len(live.unpacked(state.value[0], 5)) == len(open_) > 5
    # What is 5 ms of event time behind the watermark is given up, what is younger stays.
    mark = sorted(e["hrtime"] // 1_000_000 for _, e in open_.values())[len(open_) // 2] + 5
    young = sum(e["hrtime"] // 1_000_000 + 5 > mark for _, e in open_.values())
    list(p.handleExpiredTimer(("h0", 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None))
    assert 0 < young < len(open_) and len(live.unpacked(state.value[0], 5)) == young and timers


def test_stretches_of_many_tasks_share_a_key():
    r = random.Random(2)
    rows, want, now = [], defaultdict(lambda: [0, 0]), {}

    def charge(x, end):
        t = x["hrtime"]
        while x["state"] >= 0 and t < end:
            stop = min(end, (t // EVERY + 1) * EVERY)
            want[t // EVERY * EVERY, x["id"], x["state"], x["label"] if x["labelled"] else None][1] += stop - t
            t = stop

    for t in range(2000):
        wake = r.random() < 0.3
        state = 1 if wake else r.choice([0, 2, 3, -1])
        x = dict(id=r.randrange(TASKS), hrtime=t * 7_000_003, cpu=0, cpu_seqno=t, state=state, unless=0 if wake else -1, label=0, labelled=0)
        if state == 2 and t % 5:
            x |= dict(label=t % 3, labelled=1)
        rows.append(x)
        was = now.get(x["id"])
        if wake and was and was["state"] == 0:
            continue
        if was:
            charge(was, x["hrtime"])
        now[x["id"]] = x
        if state >= 0:
            want[x["hrtime"] // EVERY * EVERY, x["id"], state, x["label"] if x["labelled"] else None][0] += 1
    end = 2000 * 7_000_003 // EVERY * EVERY + 3 * EVERY
    for x in now.values():
        charge(x, end)
    p, state, timers = held(live.Stretches(EVERY))
    got = []
    for k, part in enumerate(parted(rows, 9)):
        assert list(p.handleInputRows(("h0", 0), iter(part), None)) == []
        mark = end if k == 3 else max(x["hrtime"].max() for x in part)
        got += [o for _ in range(2) for o in p.handleExpiredTimer(("h0", 0), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m // 1_000_000), None)]
    told = [((x.start.value, x.id, live.TIMED.index(x.state), None if pd.isna(x.label) else x.label), [x.n, x.ns]) for df in got for x in df.itertuples()]
    assert len(dict(told)) == len(told)  # a window leaves once
    assert dict(told) == dict(want) and len(told) > 500
    assert min(t for t in timers if t * 1_000_000 > end) == (end + EVERY) // 1_000_000


def test_one_view_makes_one_source(spark, tmp_path):
    stream = live.with_event_time(spark.readStream.schema(TRACE).parquet(str(tmp_path)))
    sources = lambda *a: views.measures(stream, 24 * ad.HOUR, None, 1 << 40, *a)._jdf.queryExecution().analyzed().toString().count("TransformWithStateInPySpark")
    assert (sources(["futex"]), sources(["disk"]), sources(["profile"]), sources()) == (1, 1, 0, 5)


def test_interrupts_of_a_cpu_are_paired_in_parts():
    r = random.Random(2)
    rows = [dict(hrtime=t * 1000, cpu_seqno=t, hard=r.random() < 0.5, entry=r.random() < 0.6, irq=r.choice([1, 2, None]), name=r.choice(["a", None])) for t in range(1500)]
    want, last, spent, before = [], {}, 0, 0
    for x in rows:
        e = last.get(x["hard"])
        if e and e["entry"] and not x["entry"]:
            took = x["hrtime"] - e["hrtime"]
            spent += took if x["hard"] else 0
            want.append(("hard" if x["hard"] else "soft", e["irq"], e["name"], e["hrtime"], x["hrtime"], took - (0 if x["hard"] else spent - before)))
        before = before if x["hard"] else spent
        last[x["hard"]] = x
    p, state, _ = held(live.PairIrq())
    got = [o for part in [*parted(rows[:2], 6, 2), *parted(rows[2:], 6)] for o in p.handleInputRows(("h0", 1), (x for x in part if len(x)), None)]
    told = [(x.kind, None if pd.isna(x.irq) else int(x.irq), x.name, x.start, x.end, x.time) for df in got for x in df.itertuples(index=False)]
    assert sorted(map(str, told)) == sorted(map(str, want)) and len(want) > 300
    assert state.value[-2:] == (spent, before)


def test_state_has_partitions_by_cores(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        ad.task_trace(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "in"))
        q = live.live_top(live.stream_trace(spark, str(tmp_path / "in")), "syscall", 3, lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}"), checkpoint=str(tmp_path / "state"))
        try:
            q.processAllAvailable()
            used = [o["numShufflePartitions"] for o in q.lastProgress["stateOperators"]]
        finally:
            q.stop()
        assert used == [drive.PER_CORE * spark.sparkContext.defaultParallelism]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
