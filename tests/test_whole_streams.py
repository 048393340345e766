"""Registered queries whose results come from the stream, and from whole texts."""

from pyspark.sql import functions as F

from tracelake import adapters as ad
from tracelake import catalog
from tracelake.operators import topn
from tracelake.streaming import drive, live

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_windows_come_from_the_stream(spark, monkeypatch):
    trace = live.with_event_time(ad.task_trace(spark, SF))
    want = live.live_stats(trace, "1 day").select("hostname", F.expr("datediff(start, date '1970-01-01')").cast("long").alias("day"), "event", "n")
    assert rows(catalog.z2(spark, SF)) == rows(want)
    drained = drive.drained
    monkeypatch.setattr(drive, "drained", lambda *a: drained(*a).limit(0))
    assert catalog.z2(spark, SF).count() == 0


def test_top_comes_from_the_stream(spark, monkeypatch):
    calls, start = [], live.live_top
    monkeypatch.setattr(live, "live_top", lambda *a, **k: calls.append(1) or start(*a, **k))
    got = catalog.z5(spark, SF)
    counts = live.view_rows(ad.task_trace(spark, SF), "syscall").groupBy("hostname", "syscallno").agg(F.count("*").alias("n"))
    want = topn.top_n_per(counts, ["hostname"], "n", 3, ["syscallno"])
    assert calls and rows(got) == rows(want.select(got.columns))


def test_markers_after_the_eighth_word(spark, monkeypatch):
    path = drive.folder(spark, "words")
    spark.createDataFrame([(1, "a b c d e f g h i the of")], "conv_id bigint, text string").write.parquet(f"{path}/conversations.parquet")
    assert catalog.d6(spark, path).count() == 1
