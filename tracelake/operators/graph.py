"""Who wakes whom, and the graph of waits around a task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hot import written
from .states import task_state_intervals
from .topn import top_n_per

INTERRUPT = -1
#: Numbers of roots that one list can hold: a power of two, and each fits into 15 bits.
ROOTS = 1 << 15
#: Places for each core in which lists of roots and edges meet.
PLACES = 4


def open_calls(df: DataFrame) -> DataFrame:
    """Wakeup events with the call that the waker is in (number and first argument), or -1."""
    w = Window.partitionBy("hostname", "pid").orderBy("hrtime", "cpu", "cpu_seqno").rowsBetween(Window.unboundedPreceding, -1)
    call = F.when(F.col("event") == "sys_enter", F.struct(F.col("sys.syscallno").alias("no"), F.get("sys.args", F.lit(0)).alias("arg"))).when(F.col("event") == "sys_exit", F.struct(F.lit(-1).alias("no"), F.lit(None).cast("long").alias("arg")))
    e = df.where("event in ('sys_enter', 'sys_exit', 'sched_wakeup', 'sched_wakeup_new')").withColumn("call", F.last(call, True).over(w))
    return e.where("wk.success = 1").select("hostname", F.col("hrtime").alias("end"), F.col("wk.target_pid").alias("sleeper"), F.col("pid").alias("waker"), F.coalesce("call.no", F.lit(-1)).alias("w_scall"), F.col("call.arg").alias("w_arg0"))


def wakeups(df: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """Sleep intervals with the wakeup that ended each; wakeups of oneself are left out. ``known`` tells sleeps from the time before a state was known (``unknown_ns``, which may be 0)."""
    iv = task_state_intervals(df) if intervals is None else intervals
    slept = iv.where("ended_by = 'wake' and state in ('SWTCH', 'N')").select("hostname", F.col("pid").alias("sleeper"), "waker", "end", F.when(F.col("state") == "SWTCH", F.col("ns")).otherwise(0).alias("sleep_ns"),
                                                                            F.when(F.col("state") == "N", F.col("end") - F.col("start")).otherwise(0).alias("unknown_ns"), F.col("scall").alias("s_scall"), F.get("ips", F.lit(0)).alias("slpfunc"), (F.col("state") == "SWTCH").alias("known"))
    j = slept.join(open_calls(df), ["hostname", "sleeper", "waker", "end"], "left")
    return j.where("waker <> sleeper").withColumn("w_scall", F.coalesce("w_scall", F.lit(-1)))


def wakeup_edges(woken: DataFrame) -> DataFrame:
    """Edges waker -> sleeper by the calls of both sides and the sleep function."""
    return woken.groupBy("hostname", "waker", "sleeper", "w_scall", "w_arg0", "s_scall", "slpfunc").agg(F.count("*").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"), F.sum("unknown_ns").alias("unknown_ns"))


def coop_tree(edges: DataFrame, side: str = "sleeper") -> DataFrame:
    """Counts and sleep time at each level from the other task down to the sleep function (or the mirrored order for wakers); deeper columns are null."""
    other = "waker" if side == "sleeper" else "sleeper"
    levels = ["w_scall", "w_arg0", "s_scall", "slpfunc"] if side == "sleeper" else ["s_scall", "w_scall", "w_arg0", "slpfunc"]
    out = edges.rollup("hostname", side, other, *levels).agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"), F.grouping_id().alias("gid"))
    depth = len(levels) + 1  # host, task, other and all or some of the levels
    return out.where(F.col("gid") < (1 << depth)).withColumn("level", F.lit(depth) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))).drop("gid")


def waited_for(edges: DataFrame, tracer: tuple[int, ...] = ()) -> DataFrame:
    """Sleep that each task ended for others."""
    e = edges.where(~F.col("waker").isin(list(tracer))) if tracer else edges
    return e.groupBy("hostname", F.col("waker").alias("pid")).agg(F.sum("sleep_ns").alias("ns"), F.sum("cnt").alias("cnt"))


def counted_edges(edges: DataFrame, totals: DataFrame, min_pct: float, skip: tuple[int, ...]) -> DataFrame:
    """Edges by waker and sleeper whose sleep is at least ``min_pct`` of the sleeper's total."""
    e = edges.where(~F.col("waker").isin(list(skip)) & ~F.col("sleeper").isin(list(skip))).groupBy("hostname", "waker", "sleeper").agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"))
    e = e.join(totals.select("hostname", F.col("pid").alias("sleeper"), "sleep_total"), ["hostname", "sleeper"]).where(100.0 * F.col("sleep_ns") >= min_pct * F.col("sleep_total"))
    return e.select("hostname", "waker", "sleeper", "cnt", "sleep_ns")


def best_edges(e: DataFrame, top_n: int) -> DataFrame:
    """hostname, at, to, sleep_ns: the first edges of each task in both directions, dealt by task.

    A task has no more than two rows for each other one, so its first ``2 * top_n`` rows hold its first ``top_n`` others, and all but those stay where they are.
    """
    both = e.select("hostname", F.col("sleeper").alias("at"), F.col("waker").alias("to"), "sleep_ns").union(e.select("hostname", F.col("waker").alias("at"), F.col("sleeper").alias("to"), "sleep_ns"))
    first = top_n_per(both, ["hostname", "at"], "sleep_ns", 2 * top_n, tie=["to"])
    return top_n_per(first.groupBy("hostname", "at", "to").agg(F.max("sleep_ns").alias("sleep_ns")), ["hostname", "at"], "sleep_ns", top_n, tie=["to"])


def wait_graph(edges: DataFrame, totals: DataFrame, root: int, depth: int = 2, min_pct: float = 10.0, top_n: int = 10, skip: tuple[int, ...] = (0, INTERRUPT)) -> tuple[DataFrame, DataFrame]:
    """Nodes (hostname, pid, depth) and links (hostname, waker, sleeper, cnt, sleep_ns) around a task, level by level over both directions.

    An edge counts if its sleep is at least ``min_pct`` of the sleeper's total sleep; each task adds its ``top_n`` edges by sleep. Depth is the
    least. Links are all counted edges between nodes. The loop runs over levels, not rows; a cluster cuts its lineage with checkpoint().
    """
    cuts = bool(edges.sparkSession.conf.get("spark.checkpoint.dir", None))
    e = counted_edges(edges, totals, min_pct, skip)
    best = best_edges(e, top_n)
    nodes = e.select("hostname").distinct().select("hostname", F.lit(root).cast("long").alias("pid"), F.lit(0).alias("depth"))
    front = nodes
    for level in range(1, depth + 1):
        front = front.select("hostname", F.col("pid").alias("at")).join(best, ["hostname", "at"]).select("hostname", F.col("to").alias("pid")).distinct().join(nodes, ["hostname", "pid"], "left_anti").withColumn("depth", F.lit(level))
        nodes = nodes.unionByName(front)
        if cuts:
            nodes = nodes.checkpoint()
            front = nodes.where(F.col("depth") == level)
    ends = nodes.select("hostname", "pid")
    links = e.join(ends.withColumnRenamed("pid", "waker"), ["hostname", "waker"], "left_semi").join(ends.withColumnRenamed("pid", "sleeper"), ["hostname", "sleeper"], "left_semi")
    return nodes, links.select("hostname", "waker", "sleeper", "cnt", "sleep_ns")


def wait_graphs(edges: DataFrame, totals: DataFrame, roots: DataFrame, depth: int = 2, min_pct: float = 10.0, top_n: int = 10, skip: tuple[int, ...] = (0, INTERRUPT)) -> tuple[DataFrame, DataFrame]:
    """``wait_graph`` of every task of ``roots`` (hostname, pid) at once: nodes and links with their ``root``.

    All searches go level by level together: one join and one aggregate a level, whatever the number of roots. A task has one row for each ``ROOTS`` numbers of roots, with a list for
    each depth of those that reach it there, and lists move from task to task: no search has a row of its own before the result. Links are what the lists of both ends of an edge have in common (``_common_links``).
    """
    e = written(counted_edges(edges, totals, min_pct, skip), "graph-edges")
    best = best_edges(e, top_n).persist(StorageLevel.MEMORY_AND_DISK)
    key = ["hostname", "pid", "part"]
    number = F.col("pid").bitwiseAND(F.lit(ROOTS - 1)).cast("smallint")
    begin = roots.select("hostname", F.col("pid").cast("long").alias("pid")).distinct().join(best.select("hostname", F.col("at").alias("pid")).distinct(), ["hostname", "pid"], "left_semi")
    found = written(begin.select("hostname", "pid", F.shiftright("pid", ROOTS.bit_length() - 1).alias("part"), F.array(F.array(number)).alias("found")), "graph-nodes")
    for level in range(1, depth + 1):
        front = found.select("hostname", F.col("pid").alias("at"), "part", F.element_at("found", -1).alias("roots")).where(F.size("roots") > 0)
        near = front.join(best, ["hostname", "at"]).select("hostname", F.col("to").alias("pid"), "part", "roots")
        met = found.unionByName(near, allowMissingColumns=True).groupBy(*key).agg(F.first("found", True).alias("known"), F.flatten(F.collect_list("roots")).alias("roots"))
        known = F.coalesce("known", F.array_repeat(F.array().cast("array<smallint>"), level))
        found = written(met.select(*key, F.concat(known, F.array(F.array_except("roots", F.flatten(known)))).alias("found")), "graph-nodes")
    best.unpersist()
    nodes = found.select("hostname", "part", "pid", F.posexplode("found").alias("depth", "roots")).select("hostname", "part", F.explode("roots").alias("low"), "pid", "depth")
    return nodes.select("hostname", _root(), "pid", "depth"), _common_links(e, found)


def _root():
    return (F.col("part") * ROOTS + F.col("low")).alias("root")


def _common_links(e: DataFrame, found: DataFrame) -> DataFrame:
    """Counted edges with each root that reaches both of their ends.

    Edges and lists of the same host and ``part`` of the roots meet in one place: an edge is moved once for each part that reaches its waker, without a list, and a list once. There rows are sorted by waker and then by
    sleeper, and an edge takes the list that comes first; windows stay in the place, where joins on more keys than those of the place would move all rows again. If there are too few places for the
    cores, the sleepers of each are dealt into ``shares``, and the lists of wakers go to all of them.
    """
    spark = e.sparkSession
    reach = found.select("hostname", "part", "pid", F.flatten("found").alias("roots"))
    parts = found.select("hostname", "part").distinct().count()
    shares = -(-PLACES * spark.sparkContext.defaultParallelism // max(1, parts))
    place = ["hostname", "part", "share"]
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(shares)).cast("int")
    edges = e.join(reach.select("hostname", "part", F.col("pid").alias("waker")), ["hostname", "waker"]).withColumn("share", share("sleeper"))
    lists = reach.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    met = edges.unionByName(lists, allowMissingColumns=True).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place)
    # A list is that of a waker, and in one share that of a sleeper; the other end is null.
    none = F.lit(None).cast("long")
    row = lambda waker, sleeper: F.struct(waker.alias("waker"), sleeper.alias("sleeper"), "cnt", "sleep_ns", "roots")
    pid, edge = F.col("pid"), row(F.col("waker"), F.col("sleeper"))
    rows = F.when(pid.isNull(), F.array(edge)).when(F.col("share") == share("pid"), F.array(row(pid, none), row(none, pid))).otherwise(F.array(row(pid, none)))
    met = met.select(*place, F.explode(rows).alias("row")).select(*place, "row.*")
    listed = lambda other, *by: F.first(F.when(F.col(other).isNull(), F.col("roots")), True).over(Window.partitionBy(*place, *by).orderBy(F.asc_nulls_first(other)).rowsBetween(Window.unboundedPreceding, 0))
    single = F.when(F.col("waker").isNull(), F.col("sleeper"))  # lists of sleepers have no waker in common
    met = met.withColumn("roots", F.coalesce("roots", listed("sleeper", "waker", single))).where("sleeper is not null")
    met = met.withColumn("of", listed("waker", "sleeper")).where("waker is not null and of is not null")
    j = met.select("hostname", "part", "waker", "sleeper", "cnt", "sleep_ns", F.explode(F.array_intersect("roots", "of")).alias("low"))
    return j.select("hostname", _root(), "waker", "sleeper", "cnt", "sleep_ns")


def with_interrupt_node(nodes: DataFrame, links: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add the one node of interrupt context, with its wakeups of the tasks in the graph."""
    ends = nodes.select("hostname", F.col("pid").alias("sleeper"))
    more = edges.where(F.col("waker") == INTERRUPT).join(ends, ["hostname", "sleeper"], "left_semi").groupBy("hostname", "waker", "sleeper").agg(F.sum("cnt").alias("cnt"), F.sum("sleep_ns").alias("sleep_ns"))
    node = more.select("hostname", F.col("waker").alias("pid")).distinct().join(nodes.groupBy("hostname").agg((F.max("depth") + 1).alias("depth")), "hostname")
    return nodes.unionByName(node), links.unionByName(more)
