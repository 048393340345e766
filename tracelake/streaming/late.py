"""Late and lost data of streams, counted and kept.

Late rows are behind the watermark that the batch before theirs ran with; those are what stateful operators drop. ``late_split`` keeps them in a side table and passes the others on, and ``Drops`` records what
Spark's operators dropped, batch by batch. Lost events are those that a CPU's sequence numbers say are missing: ``stream_lost`` finds them in the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DROPPED = "query string, batch long, watermark timestamp, operator int, input_rows long, dropped long"
LATE = "hostname string, event string, cpu int, cpu_seqno long, pid long, hrtime long, event_time timestamp, behind_ms long"


class Drops(StreamingQueryListener):
    """A row for each batch and stateful operator of the queries of a session, in a table of Parquet files in a shared folder. A few rows a batch pass through the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        mark = p.get("eventTime", {}).get("watermark")
        rows = [(p["name"] or p["id"], p["batchId"], mark, k, p["numInputRows"], op.get("numRowsDroppedByWatermark", 0)) for k, op in enumerate(p["stateOperators"])]
        if rows:
            df = self.spark.createDataFrame(rows, DROPPED.replace("watermark timestamp", "watermark string"))
            # The folder's name makes a batch that reports again replace its rows.
            df.withColumn("watermark", F.to_timestamp("watermark")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={p['id']}/batch={p['batchId']}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        return self.spark.read.schema(DROPPED).option("recursiveFileLookup", "true").parquet(self.path)


def watermark_of(spark: SparkSession, checkpoint: str, batch: int):
    """The watermark (milliseconds) that a batch runs with; Spark writes it to the checkpoint before the batch begins, so a replay has the same."""
    lines = [r[0] for r in spark.read.text(f"{checkpoint}/offsets/{batch}").collect()]  # a few lines
    return max((json.loads(x).get("batchWatermarkMs", 0) for x in lines if x.startswith("{") and "batchWatermarkMs" in x), default=0)


def late_split(stream: DataFrame, checkpoint: str, late: str, keep: Callable[[DataFrame, int], None] | None = None, once: bool = False, name: str | None = None):
    """Start a query that writes the late rows of each batch to a folder of its number under ``late``, with how far behind the watermark they are, and hands the others to ``keep``.

    A batch that runs again replaces what it wrote.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        mark = watermark_of(spark, checkpoint, batch - 1) if batch else 0
        behind = F.lit(mark) - F.unix_millis("event_time")
        df.where(behind > 0).withColumn("behind_ms", behind).select(*[x.split()[0] for x in LATE.split(", ")]).write.mode("overwrite").parquet(f"{late}/batch={batch}")
        if keep:
            keep(df.where(behind <= 0), batch)

    # An aggregate without output rows of its own would hold state; without one, only the offsets log carries the watermark, which is all that is needed.
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


LOST = "hostname string, cpu int, start long, end long, gap_ns long, events_lost long, end_time timestamp"


class Sequence(StatefulProcessor):
    """State of a CPU: number and time of its last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seqno long, hrtime long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("cpu_seqno")
        seqno, time = pdf["cpu_seqno"].to_numpy("int64"), pdf["hrtime"].to_numpy("int64")
        if self.last.exists():
            n, t = self.last.get()
            later = seqno > n  # one that comes after its successors was counted as lost, and is late
            seqno, time = [n, *seqno[later].tolist()], [t, *time[later].tolist()]
        else:
            seqno, time = seqno.tolist(), time.tolist()
        out = [(key[0], int(key[1]), a, b, b - a, m - n - 1, pd.Timestamp(b // 1000, unit="us")) for n, m, a, b in zip(seqno, seqno[1:], time, time[1:], strict=False) if m > n + 1]
        self.last.update((int(seqno[-1]), int(time[-1])))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in LOST.split(", ")])

    def close(self) -> None:
        pass


def stream_lost(stream: DataFrame) -> DataFrame:
    """Gaps in the sequence numbers of each CPU, as they show: from the last event before to the first after, and how many are missing."""
    rows = stream.select("hostname", "cpu", "cpu_seqno", "hrtime", "event_time")
    return rows.groupBy("hostname", "cpu").transformWithStateInPandas(Sequence(), LOST, "Append", "EventTime", eventTimeColumnName="end_time")
