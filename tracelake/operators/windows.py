"""Timelines, shares and last-event columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import bounds
from .hot import Scan, parted


def split_at(intervals: DataFrame, every_ns: int, t0: DataFrame) -> DataFrame:
    """Intervals cut at fixed boundaries counted from each host's first event; ``slot`` numbers them, ``part_ns`` is the time within."""
    i = intervals.join(F.broadcast(t0.select("hostname", "t0")), "hostname").where("end > start")
    i = i.withColumn("slot", F.explode(F.expr(f"sequence((start - t0) div {every_ns}, (end - 1 - t0) div {every_ns})")))
    lo, hi = F.col("t0") + F.col("slot") * every_ns, F.col("t0") + (F.col("slot") + 1) * every_ns
    return i.withColumn("part_ns", F.least("end", hi) - F.greatest("start", lo))


#: Slots that are filled in at a time.
FILL = 4096


def covered(intervals: DataFrame, every_ns: int, t0: DataFrame, by: tuple[str, ...], measures: dict[str, str]) -> DataFrame:
    """Time of the intervals in each slot that one of them touches, by measure (name to test).

    An interval tells its part of the first and of the last slot, and where the slots that it covers whole begin and end: four rows at most, however long it is. Sums of those by
    slot are the only rows that a running sum goes over, and slots between two of them are filled in from it.
    """
    i = intervals.join(F.broadcast(t0.select("hostname", "t0")), "hostname").where("end > start")  # a row a host
    a, b = F.col("start") - F.col("t0"), F.col("end") - F.col("t0")
    i = i.withColumns({"_a": a, "_b": b, "_first": F.expr(f"(start - t0) div {every_ns}"), "_last": F.expr(f"(end - 1 - t0) div {every_ns}")})
    row = lambda slot, part, whole: F.struct(slot.cast("long").alias("slot"), part.cast("long").alias("part"), F.lit(whole).cast("long").alias("whole"))
    none = F.lit(0)
    one = F.array(row(F.col("_first"), F.col("_b") - F.col("_a"), 0))
    two = F.array(row(F.col("_first"), (F.col("_first") + 1) * every_ns - F.col("_a"), 0), row(F.col("_last"), F.col("_b") - F.col("_last") * every_ns, 0))
    more = F.concat(two, F.array(row(F.col("_first") + 1, none, 1), row(F.col("_last"), none, -1)))
    tests = {n: F.expr(t) for n, t in measures.items()}
    told = F.when(F.col("_first") == F.col("_last"), one).when(F.col("_first") + 1 == F.col("_last"), two).otherwise(more)
    e = i.select(*by, *[t.alias(f"_{n}") for n, t in tests.items()], F.explode(told).alias("e")).select(*by, *[f"_{n}" for n in tests], "e.*")
    add = lambda what, n: F.sum(F.when(F.col(f"_{n}"), F.col(what)).otherwise(0))
    sums = e.groupBy(*by, "slot").agg(F.sum("whole").alias("_d"), *[add("part", n).alias(n) for n in tests], *[add("whole", n).alias(f"_d_{n}") for n in tests])
    w = Window.partitionBy(*by).orderBy("slot")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"_open": F.sum("_d").over(upto), "_next": F.lead("slot").over(w), **{f"_w_{n}": F.sum(f"_d_{n}").over(upto) * every_ns for n in tests}})
    last = F.when((F.col("_open") > 0) & (F.col("_next") > F.col("slot")), F.col("_next") - 1).otherwise(F.col("slot"))
    # In two steps, so that no array holds more than ``FILL`` slots (or so many starts of them).
    sums = sums.withColumn("_upto", last).withColumn("_from", F.explode(F.sequence("slot", "_upto", F.lit(FILL))))
    sums = sums.withColumn("_slot", F.explode(F.sequence("_from", F.least(F.col("_upto"), F.col("_from") + FILL - 1))))
    return sums.select(*by, F.col("_slot").alias("slot"), *[(F.when(F.col("_slot") == F.col("slot"), F.col(n)).otherwise(0) + F.col(f"_w_{n}")).alias(n) for n in tests])


def timeline(df: DataFrame, intervals: DataFrame, every_ms: int = 100, by: tuple[str, ...] = ("hostname",), latencies: DataFrame | None = None, span: DataFrame | None = None) -> DataFrame:
    """State times of each slot: run, sys, user, irq, runq, sleep; with latencies also count and longest of each slot."""
    every = every_ms * 1_000_000
    t0 = bounds(df) if span is None else span
    states = {"run_ns": "state = 'RUNNING'", "sys_ns": "state = 'RUNNING' and coalesce(mode, 'SYS') = 'SYS'", "user_ns": "state = 'RUNNING' and mode = 'USER'",
              "irq_ns": "state = 'RUNNING' and mode in ('HARDIRQ', 'SOFTIRQ')", "runq_ns": "state = 'RUNQ'", "sleep_ns": "state = 'SWTCH'"}
    out = covered(intervals.where("ns > 0"), every, t0, by, states)
    if latencies is not None:
        l = latencies.join(F.broadcast(t0.select("hostname", "t0")), "hostname").withColumn("slot", F.expr(f"(run_ts - t0) div {every}"))  # noqa: E741
        out = out.join(l.groupBy(*by, "slot").agg(F.count("*").alias("runq_cnt"), F.max("latency_us").alias("max_us")), [*by, "slot"], "left").fillna(0, ["runq_cnt", "max_us"])
    return out


def with_pct(df: DataFrame, col: str, group: tuple[str, ...] = ("hostname",), name: str | None = None) -> DataFrame:
    """The share of a column in its group's total."""
    total = F.sum(col).over(Window.partitionBy(*group))
    return df.withColumn(name or f"{col}_pct", F.when(total != 0, 100.0 * F.col(col) / total))


def pareto(df: DataFrame, value: str, pct: float = 95.0, group: tuple[str, ...] = ("hostname",), tie: tuple[str, ...] = ()) -> DataFrame:
    """Rows by falling value until the share of those before reaches ``pct``, with the running share.

    Rows are ranked within bands of alike values (eight to a doubling); sums of whole bands carry over, and bands past the cut are never sorted.
    """
    v = F.col(value)
    banded = df.withColumn("_band", F.when(v > 0, F.floor(F.log2(v) * 8)).otherwise(F.lit(-(1 << 20))))
    above = Window.partitionBy(*group).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy(*group, "_band").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    bands = bands.withColumns({"_total": F.sum("_sum").over(Window.partitionBy(*group)), "_sum0": F.coalesce(F.sum("_sum").over(above), F.lit(0)), "_n0": F.coalesce(F.sum("_n").over(above), F.lit(0))})
    bands = bands.where(100.0 * F.col("_sum0") / F.col("_total") < pct).drop("_sum", "_n")
    w = Window.partitionBy(*group, "_band").orderBy(F.desc(value), *tie)
    out = banded.join(bands, [*group, "_band"])
    before = F.col("_sum0") + F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumns({"rank": (F.col("_n0") + F.row_number().over(w)).cast("int"), "_before": 100.0 * before / F.col("_total"), "running_pct": 100.0 * (before + v) / F.col("_total")})
    return out.where(F.col("_before") < pct).select(*df.columns, "rank", "running_pct")


def with_prev(df: DataFrame, cols: dict[str, "F.Column"], key: tuple[str, ...] = ("hostname", "pid"), cuts: DataFrame | None = None) -> DataFrame:
    """The last value that is not null of each expression over the events of a task before this one. ``cuts`` are those of hot keys (``hot.hot_cuts``)."""

    def work(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
        scan = Scan(key, ("hrtime", "cpu", "cpu_seqno"), cuts)
        return scan.bare(scan.last(scan.sliced(rows), cols))

    return parted(df, cuts, work)


def replay(df: DataFrame, step_ns: int) -> DataFrame:
    """All steps of a walk through a capture in one pass: events of each kind in each step."""
    out = df.join(F.broadcast(bounds(df).select("hostname", "t0")), "hostname").withColumn("step", F.expr(f"(hrtime - t0) div {step_ns}"))
    return out.groupBy("hostname", "step", "event").agg(F.count("*").alias("n"))
