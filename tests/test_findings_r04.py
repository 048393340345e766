"""What the findings of round 4 asked for."""

import random
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake import adapters as ad
from tracelake.operators import blockio
from tracelake.schema import TRACE
from tracelake.streaming import live, views

EVERY = 1_000_000_000
DAY = 24 * ad.HOUR
SF = "/root/testdata/sf0.001"


class Map(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop


def held(processor):
    state, timers = Map(), []
    processor.init(SimpleNamespace(getMapState=lambda *schema: state, registerTimer=timers.append))
    return processor, state, timers


def at(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def block_events(n=3000):
    """Random events of few blocks, with aborts, requests without insert or issue, repeated steps and sizes that are not told."""
    r = random.Random(4)
    steps = [*live.PairBlock.STEPS, live.PairBlock.STEPS[2], "block_rq_abort"]
    return [dict(dev=r.randrange(3), sector=8 * r.randrange(5), hrtime=1_000_000 + t * 7_000_003, cpu_seqno=t, event=r.choice(steps), sectors=r.choice([live.NONE, 8, 16])) for t in range(n)]


def walked(rows):
    want, open_ = [], {}
    for x in rows:
        block = x["dev"], x["sector"]
        size = None if x["sectors"] == live.NONE else x["sectors"]
        if x["event"] in live.PairBlock.STEPS[:2]:
            open_.setdefault(block, {})[x["event"]] = (x["hrtime"], size)
            continue
        was = open_.pop(block, {})
        ins, iss = (was.get(k) for k in live.PairBlock.STEPS[:2])
        if x["event"] == "block_rq_complete" and was:
            i, t = (ins or iss)[0], x["hrtime"]
            want.append((*block, i, iss and iss[0], t, iss[0] - i if iss and i <= iss[0] else None, t - (iss or ins)[0], next((s for s in (iss and iss[1], size, ins and ins[1]) if s is not None), None)))
    return want, open_


def packs(rows, share=3):
    """Rows as the tasks that read them hand them on."""
    df = pd.DataFrame(rows)
    df["step"] = df["event"].map({e: k for k, e in enumerate(live.PairBlock.STEPS)}).fillna(3).astype("int64")
    batch = pa.RecordBatch.from_pandas(df.drop(columns="event").assign(hostname="h0", share=share), preserve_index=False)
    return [b.to_pandas() for b in live._packs(iter([batch.slice(0, 100), batch.slice(100)]))]


def test_requests_of_packs_and_of_events():
    rows = block_events()
    want, open_ = walked(rows)
    tell = lambda x: None if pd.isna(x) else int(x)
    for form in (packs, lambda part: [pd.DataFrame(part[:50]), pd.DataFrame(part[50:])]):
        p, state, timers = held(live.PairBlock(5))
        got = []
        for k in range(4):
            part = rows[k * 750 : (k + 1) * 750]
            random.Random(k).shuffle(part)
            got += [o for o in p.handleInputRows(("h0", 3), iter(form(part)), at(0))]
        told = [tuple(map(tell, x[1:-1])) for df in got for x in df.itertuples(index=False)]
        assert sorted(map(str, told)) == sorted(map(str, want)) and len(want) > 400
        kept = live.unpacked(state[("open",)][0], live.PairBlock.HELD)
        assert sorted(kept[:, 2].tolist()) == sorted(t for x in open_.values() for t, _ in x.values()) and timers
        # An open request is given up 5 ms of event time after its last event, the younger ones stay.
        last = sorted(max(t for t, _ in x.values()) // 1_000_000 for x in open_.values())
        list(p.handleExpiredTimer(("h0", 3), at(0), SimpleNamespace(getExpiryTimeInMs=lambda: last[len(last) // 2] + 5)))
        kept = live.unpacked(state[("open",)][0], live.PairBlock.HELD)
        young = [x for x in open_.values() if max(t for t, _ in x.values()) // 1_000_000 > last[len(last) // 2]]
        assert 0 < len(young) < len(open_) and sorted(kept[:, 2].tolist()) == sorted(t for x in young for t, _ in x.values())


def test_packs_are_few_and_bounded():
    rows = block_events()
    got = pd.concat(packs(rows))
    n = got["events"].map(len) // (8 * len(live.PairBlock.EVENT))
    assert n.sum() == len(rows) and n.max() == live.PACKED and len(got) <= len(rows) // live.PACKED + 2
    assert got["last"].max() == rows[-1]["hrtime"] // 1000


def test_events_of_a_pack_behind_the_watermark_are_late():
    rows = [dict(dev=1, sector=8, hrtime=t, cpu_seqno=t, event=e, sectors=8) for t, e in ((4_000_000, "block_rq_insert"), (5_000_001, "block_rq_issue"), (9_000_000, "block_rq_complete"))]
    p, _, _ = held(live.PairBlock(1 << 40))
    (late,) = p.handleInputRows(("h0", 3), iter(packs(rows)), at(4))
    assert late["insert_ts"].tolist() == [5_000_001]


def test_sums_of_requests_leave_once():
    rows = block_events()
    want = defaultdict(lambda: [0, 0, 0, None])
    for dev, _, _, _, t, _, svtm, size in walked(rows)[0]:
        x = want[dev, t // EVERY * EVERY]
        x[0], x[1], x[2] = x[0] + 1, x[1] + svtm, max(x[2], svtm)
        x[3] = x[3] if size is None else (x[3] or 0) + size
    p, state, timers = held(live.BlockSums(1 << 40, EVERY))
    got = []
    for k in range(4):
        part = rows[k * 750 : (k + 1) * 750]
        random.Random(k).shuffle(part)
        assert list(p.handleInputRows(("h0", 3), iter(packs(part)), at(0))) == []
        # A window that ends just at the watermark stays, then leaves.
        mark = max(x["hrtime"] for x in part) // EVERY * EVERY // 1_000_000
        for w in (mark, mark, mark + 1):
            got.append([o for o in p.handleExpiredTimer(("h0", 3), at(w), SimpleNamespace(getExpiryTimeInMs=lambda m=w: m))])
            assert all(x["start"].max().value + EVERY < w * 1_000_000 for x in got[-1])
    end = (rows[-1]["hrtime"] // EVERY + 2) * 1000
    got.append(list(p.handleExpiredTimer(("h0", 3), at(end), SimpleNamespace(getExpiryTimeInMs=lambda: end))))
    told = [((x.dev, x.start.value), [x.n, x.svtm, x.max_svtm, None if pd.isna(x.sectors) else x.sectors]) for dfs in got for df in dfs for x in df.itertuples()]
    assert len(told) == len(dict(told)) and dict(told) == dict(want) and len(told) > 50
    assert ("sums",) not in state and timers


def test_disks_of_batches_equal_batch(spark, tmp_path):
    """Requests that are open over the end of a batch; what is paired is summed where it is, without an aggregate that holds each window of each device."""
    blocks = ad.block_trace(spark, SF)
    hi = blocks.agg(F.max("hrtime")).first()[0]
    cut = hi - 700 * DAY
    after = lambda t: blocks.limit(1).withColumn("hrtime", F.lit(t)).withColumn("event", F.lit("mark"))
    for k, part in enumerate([blocks.where(F.col("hrtime") <= cut), blocks.where(F.col("hrtime") > cut).unionByName(after(hi + 3 * DAY))]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = live.with_event_time(spark.readStream.schema(TRACE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/p*"), "1 day")
    measured = views.measures(stream, DAY, None, 1 << 40, ["disk"])
    assert "Aggregate" not in measured._jdf.queryExecution().analyzed().toString()
    q = views.start(measured, f"{tmp_path}/out", f"{tmp_path}/state", 1_000_000, DAY, once=True)
    q.awaitTermination()
    io = blockio.pair_block_io(blocks)
    assert io.where((F.col("insert_ts") <= cut) & (F.col("complete_ts") > cut)).count() > 0
    want = io.groupBy((F.expr(f"complete_ts div {DAY}") * DAY).alias("at"), "hostname", F.col("dev").cast("string").alias("key")).agg(
        F.count("*").alias("n"), F.sum("svtm").alias("ns"), F.max("svtm").alias("max_ns"), F.sum(F.col("nr_sectors") * 512).alias("bytes"))
    got = views.written(spark, f"{tmp_path}/out").select((F.unix_micros("start") * 1000).alias("at"), *want.columns[1:])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and len(q.recentProgress) > 2


def test_lists_of_roots_move_once(spark, monkeypatch):
    """Searches of many roots over several parts and hosts, with few and with enough places, against a walk for each root."""
    from tracelake.operators import graph

    r = random.Random(8)
    ids = [k * graph.ROOTS // 3 + r.randrange(5) for k in range(-4, 12)]
    cost = {(h, a, b): r.randrange(1, 10_000) for h in ("a", "b") for a in ids for b in r.sample(ids, 4) if a != b}
    edges = spark.createDataFrame([(*k, 1, v) for k, v in cost.items()] * 2, "hostname string, waker long, sleeper long, cnt long, sleep_ns long")
    totals = spark.createDataFrame([(h, i, 1) for h in ("a", "b") for i in ids], "hostname string, pid long, sleep_total long")
    roots = spark.createDataFrame([(h, i) for h in ("a", "b") for i in ids[::2]], "hostname string, pid long")
    best = defaultdict(dict)
    for (h, a, b), v in cost.items():
        for at, to in ((a, b), (b, a)):
            best[h, at][to] = max(v, best[h, at].get(to, 0))
    first = {k: [to for _, to in sorted((-v, to) for to, v in tos.items())[:2]] for k, tos in best.items()}
    nodes, links = set(), set()
    for h, root in ((h, i) for h in ("a", "b") for i in ids[::2] if (h, i) in first):
        depth = front = {root: 0}
        for level in (1, 2, 3):
            front = {to: level for at in front for to in first[h, at] if to not in depth}
            depth = depth | front
        nodes |= {(h, root, pid, d) for pid, d in depth.items()}
        links |= {(h, root, a, b, 2, 2 * v) for (g, a, b), v in cost.items() if g == h and a in depth and b in depth}
    for places in (4, 1):
        monkeypatch.setattr(graph, "PLACES", places)
        n, ln = graph.wait_graphs(edges, totals, roots, 3, 0.1, 2)
        assert sorted(map(tuple, n.collect())) == sorted(nodes) and sorted(map(tuple, ln.collect())) == sorted(links) and len(links) > 200
        # All rows meet by one exchange, above which nothing is moved or joined; below it edges find the parts of their wakers.
        plan = ln._jdf.queryExecution().sparkPlan().toString()
        above = plan.split("hashpartitioning(")[0] if "hashpartitioning(" in plan else plan.split("REPARTITION")[0]
        assert "Join" not in above and plan.count("Join") == 1 and above.count("Window ") == 2
    stored = [f for f in n.inputFiles() if "graph-nodes" in f]
    rows = spark.read.parquet(*stored)
    assert rows.count() == rows.select("hostname", "pid", "part").distinct().count() < len(nodes)
