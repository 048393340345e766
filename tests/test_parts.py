"""A trace of many sources that tells the parts of its events: whoever needs some of them reads no other source."""

from pyspark.sql import functions as F

from tracelake import adapters as ad
from tracelake import catalog
from tracelake.operators import power, states
from tracelake.plans import reports

SF = "/root/testdata/sf0.001"


def sources(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_only_the_sources_of_a_part_are_read(spark):
    t, top = catalog.all_events(spark, SF), ad.topology(spark)
    s = reports.Shared(t, top, once=True)
    s.span.count()
    tasks = states.task_points(s._of_tasks, measures=True)
    for df in (tasks, s.calls, s.irqs, power.power_stats(s.part("pwr"), s.span), states.cpu_intervals(s.part("sched"), s.span), states.wakeup_streaks(s.part("sched", "sys"))):
        assert "events.parquet" in sources(df) and not sources(df) & {"orders.parquet", "lineitem.parquet"}
    assert {"orders.parquet", "lineitem.parquet"} <= sources(s.io)
    s.release()


def test_parts_lose_no_event(spark):
    t, top = catalog.all_events(spark, SF), ad.topology(spark)
    assert t.where(~t["part"].eqNullSafe(reports.part_of(t["event"]))).count() == 0
    plain, told = reports.Shared(t.drop("part"), top), reports.Shared(t, top, once=True)
    rows = lambda df: sorted(map(str, df.collect()))
    assert plain.part("blk") is plain.df  # a trace without parts is read whole
    for section in ("1.1.3 power", "1.5 thundering herd", "6.2 resident size", "10 findings"):
        a, b = (reports.host_report(s.df, top, shared=s)[section] for s in (plain, told))
        assert rows(a) == rows(b) != []
    assert rows(plain.edges) == rows(told.edges)
    plain.release()
    told.release()


def test_edges_tell_the_calls_that_wakers_are_in(spark):
    t = ad.task_trace(spark, SF).withColumn("pid", F.expr("if(event = 'sched_wakeup', pid + 1, pid)"))  # a task of the same host wakes
    plain, told = reports.Shared(t, ad.topology(spark)), reports.Shared(t.withColumn("part", reports.part_of(F.col("event"))), ad.topology(spark))
    edges = [sorted(map(str, s.edges.collect())) for s in (plain, told)]
    assert edges[0] == edges[1] and told.edges.where("w_scall >= 0").count() > 0
    plain.release()
    told.release()
