"""The live stream in order: events of all CPUs of a host, merged as soon as nothing earlier can follow.

Each CPU sends its events with delays of its own, and from time to time a sync record (event ``sync``): nothing before its time is still to come from that CPU.
Time is cut into slices; a slice of a host is done when every CPU of the host has sent a sync from its end on. Its events are held in list state until then, and leave sorted,
numbered by their place. Slices are the keys, so neither a host nor the merge is one task: (slice, place) is the order of a host's events.

A CPU that falls silent does not hold its host for ever: an event-time timer lets a slice go, marked as not complete, when the watermark passes its end. What comes for a slice that has
left is passed on at once, marked as late, with a place behind all others; so no event is lost between the two, and only what Spark's watermark drops is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import TRACE

SYNC = "sync"
#: Slices before a sync record that it closes for its CPU; longer silences wait for the watermark.
LOOKBACK = 16
OUT = "hostname string, slice long, place long, complete boolean, late boolean, payload string"


class Merge(StatefulProcessor):
    """State of a slice of a host: its events, the CPUs that are done with it, and whether it has left."""

    def __init__(self, slice_ns: int):
        self.slice_ns = slice_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "hrtime long, cpu int, cpu_seqno long, payload string")
        self.done = handle.getMapState("done", "cpu int", "at long")
        self.left = handle.getValueState("left", "places long")

    def _end_ms(self, key) -> int:
        return (int(key[1]) + 1) * self.slice_ns // 1_000_000

    def _rows(self, key, rows: list, first: int, complete: bool, late: bool) -> Iterator[pd.DataFrame]:
        if rows:
            rows = sorted(rows, key=lambda r: r[:3])
            yield pd.DataFrame([(key[0], int(key[1]), first + k, complete, late, r[3]) for k, r in enumerate(rows)], columns=[x.split()[0] for x in OUT.split(", ")])

    def _leave(self, key, rows: list, complete: bool) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.left.update((len(rows),))
        yield from self._rows(key, rows, 0, complete, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        syncs = pdf["payload"].isna()
        new = [(int(t), int(c), int(s), p) for t, c, s, p in pdf.loc[~syncs, ["hrtime", "cpu", "cpu_seqno", "payload"]].itertuples(index=False)]
        if self.left.exists():
            places = self.left.get()[0]
            self.left.update((places + len(new),))
            yield from self._rows(key, new, places, False, True)
            return
        if not self.held.exists() and not self.done.exists():
            self.handle.registerTimer(self._end_ms(key))
        for cpu in pdf.loc[syncs, "cpu"].unique():
            self.done.updateValue((int(cpu),), (1,))
        if len(list(self.done.keys())) >= int(pdf["cpus"].iloc[0]):
            yield from self._leave(key, [*(tuple(r) for r in self.held.get()), *new] if self.held.exists() else new, True)
        elif new:
            self.held.appendList(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is past the slice: no more rows of it reach this operator, so its state ends."""
        if not self.left.exists() and self.held.exists():
            yield from self._leave(key, [tuple(r) for r in self.held.get()], False)
        self.held.clear()
        self.done.clear()
        self.left.clear()

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, topology: DataFrame, slice_ns: int = 1_000_000_000, lookback: int = LOOKBACK) -> DataFrame:
    """Events of ``stream`` (without its sync records) with slice, place, complete and late. ``topology`` has a row for each CPU of each host; hosts that it lacks wait for the watermark.

    ``stream`` is a trace with a watermark; its sync records have event ``sync``, hrtime and cpu.
    """
    if slice_ns % 1_000_000:
        raise ValueError("slices are whole milliseconds")
    cpus = topology.groupBy("hostname").agg(F.countDistinct("cpu").alias("cpus"))  # a row a host
    rows = stream.join(F.broadcast(cpus), "hostname", "left").withColumn("cpus", F.coalesce("cpus", F.lit(1 << 30)))
    own = F.expr(f"hrtime div {slice_ns}")
    closes = F.sequence(own - lookback, own - 1)
    slices = F.when(F.col("event") == SYNC, closes).otherwise(F.array(own))
    payload = F.when(F.col("event") != SYNC, F.to_json(F.struct(*[f.name for f in TRACE.fields])))
    rows = rows.select("hostname", F.explode(slices).alias("slice"), "hrtime", "cpu", "cpu_seqno", "cpus", payload.alias("payload"), "event_time")
    out = rows.groupBy("hostname", "slice").transformWithStateInPandas(Merge(slice_ns), OUT, "Append", "EventTime")
    return out.select("slice", "place", "complete", "late", F.from_json("payload", TRACE).alias("e")).select("e.*", "slice", "place", "complete", "late")
