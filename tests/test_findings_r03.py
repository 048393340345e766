"""Small tables on which queries differed from their SQL or failed before; each query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql.functions import col as spark_col

from tracelake import registry

DAY0 = 1_700_000_000_000_000  # microseconds


@pytest.fixture
def held(spark, tmp_path):
    """Write tables from their SQL, then compare queries with their SQL over them."""

    class Held:
        path = str(tmp_path)

        def table(self, name, select):
            duckdb.sql(f"COPY ({select}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")

        def events(self, *rows):
            """Rows of microseconds, user, type, k, with event_id by place."""
            values = ", ".join(f"({i}, make_timestamp({DAY0 + t}), {user}, '{kind}', 1.5, '{{\"k\": {k}}}')" for i, (t, user, kind, k) in enumerate(rows))
            self.table("events", f"SELECT CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type, CAST(e AS DOUBLE) AS value, f AS props FROM (VALUES {values}) t(a, b, c, d, e, f)")

        def requests(self, *rows):
            """A line item of each (device, part, quantity), of one order of the first day of 2024."""
            self.table("supplier", "FROM '/root/testdata/sf0.001/supplier.parquet'")
            self.table("orders", "SELECT CAST(1 AS BIGINT) AS o_orderkey, CAST(5 AS BIGINT) AS o_custkey, TIMESTAMP '2024-01-01' AS o_orderdate")
            values = ", ".join(f"({i}, {dev}, {part}, {q})" for i, (dev, part, q) in enumerate(rows, 1))
            self.table("lineitem", f"SELECT CAST(1 AS BIGINT) AS l_orderkey, CAST(a AS INTEGER) AS l_linenumber, CAST(b AS BIGINT) AS l_suppkey, CAST(c AS BIGINT) AS l_partkey, CAST(d AS DOUBLE) AS l_quantity, 'N' AS l_returnflag FROM (VALUES {values}) t(a, b, c, d)")

        def want(self, name):
            c = duckdb.connect()
            for f in os.listdir(tmp_path):
                if f.endswith(".parquet"):
                    c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tmp_path}/{f}'")
            r = c.execute(registry.oracle_sql()[name])
            return [x[0] for x in r.description], r.fetchall()

        def rows(self, name):
            return registry.queries()[name](spark, self.path)

        def same(self, name):
            cols, want = self.want(name)
            got = self.rows(name).select(*cols).collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), name
            return want

    return Held()


@pytest.mark.parametrize("name", ["j15_wakeup_edges", "a37_waited_for", "s14_pid_json_read"])
def test_a_wakeup_at_the_first_moment_ends_no_sleep(held, name):
    held.events((0, 6, "purchase", 1), (5, 6, "view", 1), (9, 6, "click", 1), (12, 6, "purchase", 1), (20, 6, "view", 2), (0, 8, "purchase", 1), (30, 8, "view", 1))
    assert len(held.same(name)) == 1


def test_states_within_one_unit_keep_their_order(held):
    """CPUs of user u: (u / 2) % 4. CPUs 2 and 3 are idle; within one millisecond CPU 1 turns idle first, then CPU 0 busy, so both are busy only later."""
    held.events((0, 4, "click", 0), (1, 6, "click", 0), (2_000, 8, "click", 0), (2_001, 2, "view", 0), (4_100, 2, "click", 0), (4_200, 8, "view", 0), (6_000, 2, "view", 0), (9_000, 6, "click", 0))
    assert held.same("a6_ht_dbdi") == [("h0", 0, 0, 1)]


@pytest.mark.parametrize("name", ["p1_4_1_global_io", "p4_global_io"])
def test_service_times_of_a_host_beyond_bigint_are_summed(held, name):
    held.requests((2, 1, 2_000_000), (4, 2, 2_000_000), (6, 3, 1), (1, 4, 1))
    with pytest.raises(duckdb.ConversionException):
        held.want(name)
    hour = 3_600_000_000_000
    got = {(r.hostname, r.rw): int(r.serv_ns) for r in held.rows(name).collect()}
    assert got == {("h0", 0): 4_000_004 * hour, ("h0", None): 4_000_004 * hour, ("h1", 0): 2 * hour, ("h1", None): 2 * hour}


def test_state_times_of_a_host_beyond_bigint_are_summed(held):
    years = 90 * 365 * 86_400_000_000
    held.events(*[(u, 2 * u, "click", 1) for u in range(1, 9)], (years, 40, "purchase", 1))
    with pytest.raises(duckdb.ConversionException):
        held.want("x1_win_states")
    got = {r.state: int(r.ns) for r in held.rows("x1_win_states").where("hostname = 'h0'").collect()}
    assert got["SWTCH"] == sum(years - u for u in range(1, 9)) * 1000


def test_sums_that_fit_stay_bigint(held):
    held.requests((2, 1, 7), (4, 2, 3))
    held.same("p4_global_io")
    assert dict(held.rows("p4_global_io").dtypes)["serv_ns"] == "bigint"


def test_a_capture_is_written_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracelake.sources import readers

    rows = spark.range(20_000).select(F.lit("h").alias("hostname"), F.lit("c").alias("capture_id"), (F.col("id") * 7919 % 20_000).alias("hrtime"), F.lit("sched_switch").alias("event"), F.lit(0).alias("cpu"), F.col("id").alias("cpu_seqno"), F.lit(1).cast("long").alias("pid"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # they are small here
    try:
        readers.write_trace(rows, f"{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    files = readers.read_trace(spark, f"{tmp_path}/t").groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("hrtime").alias("a"), F.max("hrtime").alias("b")).orderBy("a").collect()
    assert sum(f.n for f in files) == 20_000 and max(f.n for f in files) < 10_000
    assert all(x.b < y.a for x, y in zip(files, files[1:]))


def test_one_section_is_read_without_a_copy_of_the_trace(held, monkeypatch):
    from tracelake.plans import reports

    def never(df):
        raise AssertionError("staged for one section")

    monkeypatch.setattr(reports, "staged", never)
    held.events((0, 6, "purchase", 1), (5, 6, "view", 1))
    held.requests((2, 1, 7), (4, 2, 3))
    held.same("p2_disk")
    held.same("p2_event_levels")


def test_one_key_pairs_blocks_of_many_devices():
    """Two devices with a request each at the same sector, in one call and over two calls."""
    import pandas as pd

    from tracelake.streaming import live

    class State(dict):
        exists, containsKey, getValue, updateValue, removeKey = dict.__len__, dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop

    class Handle:
        def getMapState(self, *of):
            return State()

        def registerTimer(self, at):
            pass

    steps = [(dev, 8, t * 1000 + dev, k, f"block_rq_{e}", 8) for dev in (1, 2) for k, (t, e) in enumerate([(1, "insert"), (2, "issue"), (5, "complete")])]
    pdf = pd.DataFrame(steps, columns=["dev", "sector", "hrtime", "cpu_seqno", "event", "sectors"])
    done = pdf["event"] == "block_rq_complete"
    for calls in ([pdf], [pdf[~done], pdf[done]]):
        p = live.PairBlock(1 << 40)
        p.init(Handle())
        out = pd.concat([x for part in calls for x in p.handleInputRows(("h", 3), iter([part.copy()]), None)])
        assert out[["dev", "sector", "insert_ts", "issue_ts", "complete_ts"]].values.tolist() == [[1, 8, 1001, 2001, 5001], [2, 8, 1002, 2002, 5002]]


def test_links_of_many_searches_are_not_shuffled(spark):
    """One task that 200 searches meet at, with roots below and above a full list of roots: a row for each list, not for each search, meets the edges."""
    from tracelake.operators import graph

    ids = [*range(1, 101), *range(graph.ROOTS * 3 + 5, graph.ROOTS * 3 + 105)]
    edges = spark.createDataFrame([("h", i, -7, 1, 10) for i in ids], "hostname string, waker long, sleeper long, cnt long, sleep_ns long")
    totals = spark.createDataFrame([("h", -7, 2000)], "hostname string, pid long, sleep_total long")
    roots = edges.select("hostname", spark_col("waker").alias("pid"))
    nodes, links = graph.wait_graphs(edges, totals, roots, depth=2, min_pct=0.1, top_n=3)
    reached = {}
    for r in nodes.collect():
        reached.setdefault(r.root, set()).add(r.pid)
    got = sorted((r.root, r.waker, r.sleeper) for r in links.collect())
    assert got == sorted((root, i, -7) for root in ids for i in ids if {i, -7} <= reached[root]) and len(got) > 400
    counts = links._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in counts and "LeftSemi" not in counts


def test_first_edges_of_both_directions_are_different_tasks(spark):
    """Task 1 has rows of both directions with 2 and 3; the first three others are 2, 3 and 4."""
    from tracelake.operators import graph

    e = spark.createDataFrame([("h", 1, 2, 1, 90), ("h", 2, 1, 1, 80), ("h", 1, 3, 1, 70), ("h", 3, 1, 1, 60), ("h", 1, 4, 1, 50), ("h", 5, 1, 1, 50)], "hostname string, waker long, sleeper long, cnt long, sleep_ns long")
    got = sorted((r.to, r.sleep_ns) for r in graph.best_edges(e, 3).where("at = 1").collect())
    assert got == [(2, 90), (3, 70), (4, 50)]


def test_requests_are_told_by_one_sort(spark):
    """Random events of few blocks, with requeues, aborts, requests without insert or issue and open ones, against a walk over them."""
    import random

    from tracelake.operators import blockio
    from tracelake.schema import as_trace, family

    rnd, rows = random.Random(3), []
    for k in range(600):
        rows.append(("h", rnd.randrange(200), rnd.randrange(2), k, rnd.randrange(9), rnd.choice(blockio.EVENTS), rnd.randrange(2), rnd.randrange(4) * 8, rnd.choice([None, 8, 16]), rnd.randrange(2)))
    flat = spark.createDataFrame(rows, "hostname string, hrtime long, cpu int, cpu_seqno long, pid long, event string, dev long, sector long, n long, f long")
    trace = as_trace(flat.select("hostname", spark_col("hostname").alias("capture_id"), "hrtime", "event", "cpu", "cpu_seqno", "pid", family("blk", dev=spark_col("dev"), sector=spark_col("sector"), nr_sectors=spark_col("n"), cmd_flags=spark_col("f")).alias("blk")))
    got = blockio.pair_block_io(trace)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan

    want, at = [], {}
    for _, t, cpu, seq, pid, event, dev, sector, n, f in sorted(rows, key=lambda r: (r[1], r[3])):
        block = at.setdefault((dev, sector), {"req": 0, "again": 0})
        if event in blockio.EVENTS[:2]:
            block[event] = (t, pid, n, f)
        elif event == "block_rq_requeue":
            block["again"] += 1
        else:
            ins, iss = block.get("block_rq_insert"), block.get("block_rq_issue")
            if event == "block_rq_complete" and (ins or iss):
                size = next((x for x in (iss and iss[2], n, ins and ins[2]) if x is not None), None)
                want.append((dev, sector, block["req"], f, size, (ins or iss)[0], iss and iss[0], t, (ins or iss)[1], iss and iss[1], block["again"], cpu))
            at[dev, sector] = {"req": block["req"] + 1, "again": 0}
    cols = ["dev", "sector", "req", "flags", "nr_sectors", "insert_ts", "issue_ts", "complete_ts", "insert_pid", "issue_pid", "requeues", "cpu"]
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want)) and len(want) > 30
    whole = blockio.pair_block_io(trace, resolve=True)
    assert whole.columns == got.columns and whole.count() == len(want)


def test_intervals_come_from_one_pass(spark, held):
    """The time before the first row of a task comes with its other intervals: one chain of windows over two sorts."""
    from tracelake import adapters
    from tracelake.operators import states

    held.events((0, 6, "purchase", 1), (5, 6, "view", 1), (9, 6, "click", 1), (12, 6, "purchase", 1), (20, 6, "view", 2), (3, 8, "signup", 1), (30, 8, "click", 3), (31, 8, "error", 3))
    plan = states.task_state_intervals(adapters.task_trace(spark, held.path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and "Union" not in plan
    held.same("a1_task_state_intervals")
