"""Interrupts and CPU power states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import bounds

ENTRY, EXIT = ["irq_handler_entry", "softirq_entry"], ["irq_handler_exit", "softirq_exit"]


def pair_irq(df: DataFrame) -> DataFrame:
    """hostname, cpu, kind, irq, name, start, end, time: an exit closes the entry before it of the same kind on its CPU, or is ignored.

    The time of a soft interrupt does not include hard interrupts within it.
    """
    w = Window.partitionBy("hostname", "cpu").orderBy("hrtime", "cpu_seqno")
    kind = F.when(F.col("event").isin("irq_handler_entry", "irq_handler_exit"), "hard").otherwise("soft")
    e = df.where(F.col("event").isin(ENTRY + EXIT)).select("hostname", "cpu", "hrtime", "cpu_seqno", kind.alias("kind"), F.col("event").isin(ENTRY).alias("entry"), "irq.irq", "irq.name")
    own = Window.partitionBy("hostname", "cpu", "kind").orderBy("hrtime", "cpu_seqno")
    e = e.withColumn("prev", F.lag(F.struct("entry", "hrtime", "irq", "name")).over(own))
    pairs = e.withColumn("closes", ~F.col("entry") & F.coalesce(F.col("prev.entry"), F.lit(False)))
    pairs = pairs.withColumn("hard_ns", F.coalesce(F.sum(F.when(F.col("closes") & (F.col("kind") == "hard"), F.col("hrtime") - F.col("prev.hrtime"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    pairs = pairs.withColumn("hard_before", F.lag("hard_ns").over(own))
    within = F.when(F.col("kind") == "soft", F.col("hard_ns") - F.coalesce("hard_before", F.lit(0))).otherwise(0)
    return pairs.where("closes").select("hostname", "cpu", "kind", F.col("prev.irq").alias("irq"), F.col("prev.name").alias("name"), F.col("prev.hrtime").alias("start"), F.col("hrtime").alias("end"), (F.col("hrtime") - F.col("prev.hrtime") - within).alias("time"))


_BY = {"irq": ["hostname", "kind", "irq", "name"], "cpu_irq": ["hostname", "cpu", "kind", "irq", "name"], "kind": ["hostname", "kind"]}


def irq_stats(pairs: DataFrame, by: str = "irq") -> DataFrame:
    return pairs.groupBy(*_BY[by]).agg(F.count("*").alias("cnt"), F.sum("time").alias("time_ns"), F.expr("sum(time) div count(*)").alias("avg_ns"))


def power_intervals(df: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """hostname, cpu, cstate, ns: residency of each CPU's idle states; the time before the first event is of state 0, the last lasts to the end."""
    w = Window.partitionBy("hostname", "cpu").orderBy("hrtime", "cpu_seqno")
    e = df.where("event in ('power_start', 'power_end')").join(F.broadcast(bounds(df) if span is None else span), "hostname")
    e = e.select("hostname", F.coalesce("pwr.tgt_cpu", "cpu").alias("cpu"), "hrtime", "cpu_seqno", F.when(F.col("event") == "power_start", F.col("pwr.state")).otherwise(0).alias("cstate"), "t0", "t1")
    e = e.withColumns({"next": F.coalesce(F.lead("hrtime").over(w), "t1"), "k": F.row_number().over(w)})
    first = e.where("k = 1").select("hostname", "cpu", F.lit(0).cast("long").alias("cstate"), (F.col("hrtime") - F.col("t0")).alias("ns"))
    return first.unionByName(e.select("hostname", "cpu", F.col("cstate").cast("long").alias("cstate"), (F.col("next") - F.col("hrtime")).alias("ns")))


def power_stats(df: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """Per CPU and state: time and share; and per CPU the number of events, changes of frequency and its bounds, repeated on each of its rows."""
    r = power_intervals(df, span).groupBy("hostname", "cpu", "cstate").agg(F.sum("ns").alias("ns"))
    r = r.withColumn("pct", 100.0 * F.col("ns") / F.sum("ns").over(Window.partitionBy("hostname", "cpu")))
    f = df.where("event in ('power_start', 'power_end', 'power_freq')").groupBy("hostname", F.coalesce("pwr.tgt_cpu", "cpu").alias("cpu")).agg(
        F.count_if(F.col("event") != "power_freq").alias("events"), F.count_if(F.col("event") == "power_freq").alias("freq_changes"), F.max(F.when(F.col("event") == "power_freq", F.col("pwr.freq"))).alias("freq_hi"), F.min(F.when(F.col("event") == "power_freq", F.col("pwr.freq"))).alias("freq_lo"))
    return r.join(f, ["hostname", "cpu"])
