"""Long intervals over short slots, gaps and moments, against cutting and comparing one by one; stacks of addresses as names."""

import random

from pyspark.sql import functions as F

from tracelake import adapters as ad
from tracelake.operators import filters, stacks, states, windows

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_slots_of_long_intervals(spark):
    r = random.Random(1)
    data = []
    for host in ("a", "b"):
        for _ in range(150):
            start = r.randrange(100, 20_000)
            end = start + r.choice([0, 1, 3, 7, 10, 19, 20, 21, 300, 5000])
            data.append((host, start, end, r.choice(["RUNNING", "RUNQ", "SWTCH"]), r.choice(["SYS", "USER", "HARDIRQ", None])))
    iv = spark.createDataFrame(data, "hostname string, start long, end long, state string, mode string")
    t0 = spark.createDataFrame([("a", 100), ("b", 93)], "hostname string, t0 long")
    tests = {"run": "state = 'RUNNING'", "sys": "state = 'RUNNING' and coalesce(mode, 'SYS') = 'SYS'", "queue": "state = 'RUNQ'"}
    for every in (10, 1000, 1 << 40):
        cut = windows.split_at(iv, every, t0).groupBy("hostname", "slot").agg(*[F.sum(F.when(F.expr(t), F.col("part_ns")).otherwise(0)).alias(n) for n, t in tests.items()])
        assert rows(windows.covered(iv, every, t0, ("hostname",), tests)) == rows(cut)


def test_rows_do_not_grow_with_the_length(spark):
    """A task asleep for a month, in slots of 5 s: the rows before the last step are four."""
    month, slot = 30 * 24 * ad.HOUR, 5_000_000_000
    iv = spark.createDataFrame([("a", 0, month, "SWTCH", None)], "hostname string, start long, end long, state string, mode string")
    t0 = spark.createDataFrame([("a", 0)], "hostname string, t0 long")
    out = windows.covered(iv, slot, t0, ("hostname",), {"sleep": "state = 'SWTCH'"})
    assert out.agg(F.count("*"), F.sum("sleep"), F.min("sleep"), F.max("sleep")).first()[:] == (month // slot, month, slot, slot)


def test_gaps_that_cross_intervals(spark):
    r = random.Random(2)
    iv = [("h", r.randrange(6), r.randrange(3), s, s + r.randrange(0, 4000), r.choice(["RUNNING", "RUNQ", "SWTCH"]), 1) for s in (r.randrange(10_000) for _ in range(300))]
    gaps = [("h", r.randrange(3), s, s + r.randrange(0, 300)) for s in (r.randrange(10_000) for _ in range(40))]
    hit = {(h, p, s) for h, p, c, s, e, _, _ in iv if any(gc == c and s < ge and e > gs for _, gc, gs, ge in gaps)}
    want = sorted(str((*x[:5], *(("UNKNOWN", 0) if (x[0], x[1], x[3]) in hit and x[5] != "SWTCH" else x[5:]))) for x in iv)
    d = spark.createDataFrame(iv, "hostname string, pid long, cpu int, start long, end long, state string, ns long")
    g = spark.createDataFrame(gaps, "hostname string, cpu int, start long, end long")
    got = filters.mask_gaps(d, g).select("hostname", "pid", "cpu", "start", "end", "state", "ns")
    assert sorted(str(tuple(x)) for x in got.collect()) == want and any("UNKNOWN" in x for x in want)
    cuts = spark.createDataFrame([("h", 1, [500, 4000, 9000])], "hostname string, cpu int, points array<bigint>")
    assert rows(filters.mask_gaps(d, g, cuts).select(*got.columns)) == rows(got)
    assert rows(filters.mask_gaps(d, g.limit(0)).select(*d.columns)) == rows(d)


def test_moments_and_intervals_meet_in_one_bin(spark):
    r = random.Random(3)
    data = [(i, s, s + r.choice([1, 2, 900, 1024, 1025, 10**6, 10**10, 10**15, 3 * 10**16])) for i, s in enumerate(r.randrange(0, 4 * 10**16) for _ in range(200))]
    times = [r.randrange(0, 5 * 10**16) for _ in range(100)] + [s for _, s, _ in data[:50]] + [e - 1 for _, _, e in data[:50]] + [e for _, _, e in data[:50]]
    iv = spark.createDataFrame(data, "i long, start long, end long").withColumn("bin", F.explode(states.interval_bins(F.col("start"), F.col("end"))))
    at = spark.createDataFrame([(t,) for t in sorted(set(times))], "t long").withColumn("bin", F.explode(states.moment_bins(F.col("t"))))
    met = at.join(iv, "bin").where("start <= t and t < end").select("t", "i").collect()
    assert sorted(map(tuple, met)) == sorted((t, i) for t in set(times) for i, s, e in data if s <= t < e)
    assert iv.where("end - start < 1000000000000000").groupBy("i").count().agg(F.max("count")).first()[0] <= 2


def test_stacks_of_names(spark):
    rows_ = [(1, [-128, 17, 33, -512, 17, 40, 70_000_000]), (2, [17, -512, 17]), (3, [-512, 17, -128, 17]), (4, []), (5, None), (6, [-512]), (7, [17, -512, 17]), (None, [-5])]
    df = spark.createDataFrame(rows_, "id long, stack array<bigint>")
    sym = spark.createDataFrame([("kernel", 16, "k16"), ("kernel", 32, "k32"), ("user", 16, "u16"), ("user", 36, "u36")], "space string, addr long, sym string")
    got = {r.id: r.frames for r in stacks.symbolize_stacks(df, sym).collect()}
    assert got == {1: ["k16", "k32", "<user>", "u16", "u36", "0x42c1d80"], 2: ["k16", "<user>", "u16"], 3: ["<user>", "u16", "k16"], 4: [], 5: None, 6: ["<user>"], 7: ["k16", "<user>", "u16"], None: ["0xfffffffffffffffb"]}


def test_every_database_rule_is_reached(spark):
    from tracelake import catalog

    told = {r.wait for r in catalog.a33_traced(spark, "/root/testdata/sf0.01").select("wait").distinct().collect()}
    assert told >= {w for w, _, earlier in stacks.DB_WAITS + stacks.DB_KERNEL_WAITS if not earlier} and len(told) >= 8
    # Rules that need another frame, one by one.
    need = [(k, [stacks.USER, earlier + "+1", prefix + "+2"] if earlier else [stacks.USER, prefix]) for k, (_, prefix, earlier) in enumerate(stacks.DB_WAITS)]
    s = spark.createDataFrame(need, "pid long, stack array<string>").withColumns({"hostname": F.lit("h"), "ns": F.lit(1).cast("long")})
    got = {r.pid: r.wait for r in stacks.ora_waits(s, user_mark=stacks.USER).collect()}
    assert got == {k: w for k, (w, _, _) in enumerate(stacks.DB_WAITS)}
