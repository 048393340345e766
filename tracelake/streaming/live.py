"""Live analysis in Structured Streaming. Event time is hrtime as a timestamp; each host's CPUs may lag by the watermark's delay.

Pairing and state accounting keep state per share of a host's tasks or blocks with ``transformWithStateInPandas``; event-time timers evict what is never
completed, as a gap does in batch. On complete input the results equal those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import topn
from ..operators.power import ENTRY, EXIT
from ..operators.syscalls import is_err, moved_bytes
from ..schema import TRACE
from .drive import folder, stateful

EVERY = "5 seconds"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def stream_trace(spark: SparkSession, path: str, delay: str = "2 seconds", files_per_trigger: int | None = None) -> DataFrame:
    """A directory of trace files as a stream with a watermark; late rows are dropped and counted by Spark (numRowsDroppedByWatermark)."""
    reader = spark.readStream.schema(TRACE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_event_time(reader.parquet(path), delay)


def with_event_time(df: DataFrame, delay: str = "2 seconds") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros(F.expr("hrtime div 1000"))).withWatermark("event_time", delay)


def chosen(stream: DataFrame, test) -> DataFrame:
    """Rows of a stream for which ``test`` holds. The test stays above the watermark, so that all events move it and not only those that are chosen."""
    test = F.expr(test) if isinstance(test, str) else test
    return stream.where(F.when(F.col("event_time").isNotNull(), test))


def live_stats(stream: DataFrame, every: str = EVERY, by: tuple[str, ...] = ("hostname", "event")) -> DataFrame:
    """Events of each kind in each window; every window starts from nothing."""
    return stream.groupBy(F.window("event_time", every), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


CALLS = "hostname string, pid long, syscallno int, enter long, exit long, elapsed long, ret long, arg0 long, dev long, inode long, laddr string, raddr string, exit_time timestamp"


#: Blocks, tasks and CPUs of a host are dealt into so many keys: no device is a single task, and the number of keys, each of which costs a call of Python and
#: looks into the state, grows with none of them.
DEALT = 256


def dealt(*columns: str) -> Column:
    """The share of its host into which a block, task or CPU falls."""
    return F.pmod(F.xxhash64(*columns), F.lit(DEALT)).cast("int").alias("share")


def packed(table: np.ndarray) -> bytes:
    """Rows of longs as one value of a state: one look gives all of a share."""
    return np.ascontiguousarray(table, "int64").tobytes()


def unpacked(value: bytes | None, width: int) -> np.ndarray:
    return np.frombuffer(value or b"", "int64").reshape(-1, width)


#: Stands for null among longs; in an order it comes last.
NONE = (1 << 63) - 1


def ordered_rows(*columns: str) -> list[Column]:
    """Columns of the order as longs that are never null; null comes last."""
    return [F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c.split(".")[-1]) for c in columns]


def nullable(values: np.ndarray) -> pd.arrays.IntegerArray:
    """Longs with null for ``NONE``."""
    return pd.arrays.IntegerArray(values, values == NONE)


#: What may be null of a call, each with a bit in ``nulls``: a column of longs with nulls would reach Python as doubles.
MAYBE = ["syscallno", "arg0", "ret", "dev", "inode"]


class PairSyscalls(StatefulProcessor):
    """State of a share of a host's tasks: their open calls. Rows of one batch are put in order of task and time first."""

    HELD = ["pid", "hrtime", "syscallno", "arg0", "nulls"]

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "calls binary")

    def _load(self) -> pd.DataFrame:
        held = self.open.get()
        return pd.DataFrame(unpacked(held and held[0], len(self.HELD)), columns=self.HELD)

    def _save(self, held: pd.DataFrame) -> None:
        if held.empty:
            self.open.clear()
        else:
            self.open.update((packed(held[self.HELD].to_numpy()),))
            self.handle.registerTimer(int(held["hrtime"].min()) // 1_000_000 + self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, held = pd.concat(list(rows), ignore_index=True), self._load()
        touched = held["pid"].isin(new["pid"])
        # The open call of a task comes before all of its rows. Columns of longs stay longs if they have no gap.
        rows = pd.concat([held[touched].assign(enter=True, cpu=0, cpu_seqno=0, ret=0, dev=0, inode=0, later=0), new.assign(later=1)], ignore_index=True)
        rows = rows.iloc[np.lexsort([rows[c].to_numpy() for c in ("cpu_seqno", "cpu", "hrtime", "later", "pid")])]
        pid, t, number, nulls, enter = (rows[c].to_numpy() for c in ("pid", "hrtime", "syscallno", "nulls", "enter"))
        enter = enter.astype(bool)
        place = np.arange(len(rows))
        opened = np.maximum.accumulate(np.where(enter, place, -1))
        mine = (opened >= 0) & (pid[opened] == pid)
        unknown = (nulls & 1) > 0
        ends = place[~enter & mine & ~unknown & ((number == -1) | ((number == number[opened]) & ~unknown[opened]))]
        begins, first = np.unique(opened[ends], return_index=True)  # an exit that finds its call ended is dropped
        ends = ends[first]
        last = place[np.append(pid[1:] != pid[:-1], True)]
        still = np.setdiff1d(opened[last[mine[last]]], begins)
        self._save(pd.concat([held[~touched], rows.iloc[still]], ignore_index=True))
        if len(ends):
            a, b = rows.iloc[begins], rows.iloc[ends]
            whole = lambda df, c: pd.arrays.IntegerArray(df[c].to_numpy().astype("int64"), (df["nulls"].to_numpy() & 1 << MAYBE.index(c)) > 0)
            yield pd.DataFrame({
                "hostname": key[0], "pid": pid[ends], "syscallno": whole(a, "syscallno"), "enter": t[begins], "exit": t[ends], "elapsed": t[ends] - t[begins], "ret": whole(b, "ret"), "arg0": whole(a, "arg0"),
                "dev": whole(b, "dev"), "inode": whole(b, "inode"), "laddr": b["laddr"].to_numpy(), "raddr": b["raddr"].to_numpy(), "exit_time": pd.to_datetime(t[ends] // 1000, unit="us"),
            })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load()
        if not held.empty:
            self._save(held[held["hrtime"] // 1_000_000 + self.keep_ms > timerValues.getCurrentWatermarkInMs()])
        return iter([])

    def close(self) -> None:
        pass


def stream_pair_syscalls(stream: DataFrame, keep_ms: int = 600_000) -> DataFrame:
    """Paired calls as they complete; a call that stays open for ``keep_ms`` of event time is given up."""
    told = chosen(stream, "event in ('sys_enter', 'sys_exit')").select(
        "hostname", "pid", "hrtime", *ordered_rows("cpu", "cpu_seqno"), (F.col("event") == "sys_enter").alias("enter"), "event_time", F.col("sys.syscallno").cast("long").alias("syscallno"), F.get("sys.args", F.lit(0)).alias("arg0"),
        "sys.ret", F.col("sys.dev").cast("long").alias("dev"), F.col("sys.inode").cast("long").alias("inode"), "sys.laddr", "sys.raddr",
    )
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(MAYBE)]).cast("long")
    rows = told.withColumns({"share": dealt("pid"), "nulls": nulls}).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in MAYBE})
    return rows.groupBy("hostname", "share").transformWithStateInPandas(PairSyscalls(keep_ms), CALLS, "Append", "EventTime", eventTimeColumnName="exit_time")


REQUESTS = "hostname string, dev long, sector long, insert_ts long, issue_ts long, complete_ts long, qtm long, svtm long, sectors long, complete_time timestamp"


class PairBlock(StatefulProcessor):
    """State of a share of a host's blocks: the last insert and the last issue of the open request of each, in the order in which they came.

    Rows of one batch are put in order of block and time first, after what is held of their blocks. They are events, or packs of events (``_packed_blocks``), of which
    those that are behind the watermark are dropped here.
    """

    #: Columns of an event, the last of which is not held; its step is a place in STEPS, or what follows: anything else ends a request without completing it.
    EVENT = ["dev", "sector", "hrtime", "step", "sectors", "cpu_seqno"]
    HELD = len(EVENT) - 1
    STEPS = ["block_rq_insert", "block_rq_issue", "block_rq_complete"]

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tables = handle.getMapState("tables", "name string", "rows binary")

    def _load(self, name: str, width: int) -> np.ndarray:
        return unpacked(self.tables.getValue((name,))[0] if self.tables.containsKey((name,)) else None, width)

    def _save(self, name: str, table: np.ndarray) -> None:
        if len(table):
            self.tables.updateValue((name,), (packed(table),))
        elif self.tables.containsKey((name,)):
            self.tables.removeKey((name,))

    def _events(self, rows: Iterator[pd.DataFrame], timers) -> np.ndarray:
        tables = []
        for df in rows:
            if "events" in df:
                table = np.concatenate([unpacked(x, len(self.EVENT)) for x in df["events"]])
                tables.append(table[table[:, 2] // 1000 > timers.getCurrentWatermarkInMs() * 1000])
            else:
                step = pd.Categorical(df["event"], self.STEPS).codes % (len(self.STEPS) + 1)
                tables.append(df.assign(step=step)[self.EVENT].to_numpy("int64"))
        return np.concatenate(tables)

    def _paired(self, rows: Iterator[pd.DataFrame], timers) -> dict[str, np.ndarray]:
        """Columns of the requests that end, as longs; the open ones are held."""
        new, held = self._events(rows, timers), self._load("open", self.HELD)
        came = np.concatenate([np.arange(-len(held), 0), np.zeros(len(new), "int64")])
        seqno = np.concatenate([np.zeros(len(held), "int64"), new[:, self.HELD]])
        columns = [np.concatenate([held[:, k], new[:, k]]) for k in range(self.HELD)]
        dev, sector, t, step, size = columns
        order = np.lexsort([size, np.minimum(step, 2), seqno, t, came, sector, dev])
        dev, sector, t, step, size = columns = [c[order] for c in columns]
        place, ended = np.arange(len(t)), step >= 2
        first = np.ones(len(t), bool)
        first[1:] = ended[:-1] | (dev[1:] != dev[:-1]) | (sector[1:] != sector[:-1])
        begin = np.maximum.accumulate(np.where(first, place, 0))
        ins, iss = (np.maximum.accumulate(np.where(step == k, place, -1)) for k in (0, 1))  # of the request, if not before its beginning
        last = place[np.append(first[1:], True)]
        still = last[~ended[last]]
        kept = np.concatenate([x[still][x[still] >= begin[still]] for x in (ins, iss)])
        self._save("open", np.column_stack([c[np.sort(kept)] for c in columns]))
        if len(still):
            self.handle.registerTimer(int(t[still].min()) // 1_000_000 + self.keep_ms)
        ends = place[(step == 2) & ((ins >= begin) | (iss >= begin))]
        inserted, issued = ins[ends] >= begin[ends], iss[ends] >= begin[ends]
        ins, iss = ins[ends], iss[ends]
        issue = np.where(issued, t[iss], NONE)
        insert = np.where(inserted, t[ins], issue)
        sizes = np.where(inserted, size[ins], NONE)
        for told in (size[ends], np.where(issued, size[iss], NONE)):
            sizes = np.where(told == NONE, sizes, told)
        return {
            "dev": dev[ends], "sector": sector[ends], "insert_ts": insert, "issue_ts": issue, "complete_ts": t[ends], "qtm": np.where(issued & (insert <= issue), issue - insert, NONE),
            "svtm": t[ends] - np.where(issued, issue, insert), "sectors": sizes,
        }

    def _give_up(self, now: int) -> None:
        """Open requests whose last event is ``keep_ms`` old are held no longer."""
        held = self._load("open", self.HELD)
        if len(held):
            last = np.append((held[1:, :2] != held[:-1, :2]).any(axis=1), True)
            request = np.cumsum(last) - last
            times = held[last, 2]
            young = times // 1_000_000 + self.keep_ms > now
            self._save("open", held[young[request]])
            if young.any():
                self.handle.registerTimer(int(times[young].min()) // 1_000_000 + self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self._paired(rows, timerValues)
        if len(done["dev"]):
            yield pd.DataFrame({"hostname": key[0], **{c: nullable(v) for c, v in done.items()}, "complete_time": pd.to_datetime(done["complete_ts"] // 1000, unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._give_up(expiredTimerInfo.getExpiryTimeInMs())
        return iter([])

    def close(self) -> None:
        pass


#: Events that a task which reads them packs at once, and those that one pack can hold: 6 KB, so that 10,000 packs, a batch of Arrow, have some 60 MB whatever the skew.
PACK, PACKED = 1 << 16, 128


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for each host and share of every ``PACK`` rows, with at most ``PACKED`` of their events as one table of longs and the time of the last one."""

    def packs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        host = rows["hostname"].combine_chunks().dictionary_encode()
        hosts, code = host.dictionary, host.indices.fill_null(len(host.dictionary)).to_numpy(zero_copy_only=False).astype("int64")
        key = code * DEALT + rows["share"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, table = key[order], np.column_stack([rows[c].to_numpy() for c in PairBlock.EVENT])[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(begin, append=len(key))
        n = -(-size // PACKED)
        begin = np.repeat(begin, n) + PACKED * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        names = pa.concat_arrays([hosts, pa.nulls(1, hosts.type)]).take(pa.array(key[begin] // DEALT))
        events = pa.array([packed(x) for x in np.split(table, begin[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([names, pa.array((key[begin] % DEALT).astype("int32")), events, pa.array(np.maximum.reduceat(table[:, 2], begin) // 1000)], ["hostname", "share", "events", "last"])

    parts, n = [], 0
    for x in batches:
        parts.append(x)
        n += x.num_rows
        if n >= PACK:
            yield packs(parts)
            parts, n = [], 0
    if n:
        yield packs(parts)


def _packed_blocks(stream: DataFrame) -> DataFrame:
    """Events of requests, dealt by block and packed by the tasks that read them: PySpark makes a tuple of each row that a stateful processor is given, so that rows of single events cost more than their pairing.

    The time of a pack is that of its last event, with the stream's watermark.
    """
    step = F.coalesce(*[F.when(F.col("event") == x, k) for k, x in enumerate(PairBlock.STEPS)], F.lit(len(PairBlock.STEPS))).cast("long")
    rows = chosen(stream, "event in ('block_rq_insert', 'block_rq_issue', 'block_rq_complete', 'block_rq_abort')").select(
        "hostname", dealt("blk.dev", "blk.sector"), *ordered_rows("blk.dev", "blk.sector", "cpu_seqno"), "hrtime", step.alias("step"), F.coalesce("blk.nr_sectors", F.lit(NONE)).alias("sectors"),
    )
    packs = rows.mapInArrow(_packs, "hostname string, share int, events binary, last long")
    return packs.select("hostname", "share", "events", F.timestamp_micros("last").alias("event_time", metadata=stream.schema["event_time"].metadata))


def stream_pair_block(stream: DataFrame, keep_ms: int = 600_000) -> DataFrame:
    """Requests as they complete; one that stays open for ``keep_ms`` of event time after its last event is given up."""
    return _packed_blocks(stream).groupBy("hostname", "share").transformWithStateInPandas(PairBlock(keep_ms), REQUESTS, "Append", "EventTime", eventTimeColumnName="complete_time")


BLOCK_SUMS = "hostname string, dev long, start timestamp, n long, svtm long, max_svtm long, sectors long, closed timestamp"


class BlockSums(PairBlock):
    """PairBlock that holds the requests that ended as sums of each device and window. A window leaves once, when the watermark passes its end, in the same batch for all shares of a host."""

    #: Start of the window, device, requests, service time, the longest one, sectors, requests that told their sectors.
    SUMS = 7

    def __init__(self, keep_ms: int, every_ns: int):
        super().__init__(keep_ms)
        self.every = every_ns

    def _wait(self, sums: np.ndarray) -> None:
        if len(sums):
            self.handle.registerTimer((int(sums[:, 0].min()) + self.every) // 1_000_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self._paired(rows, timerValues)
        sized = done["sectors"] != NONE
        new = np.column_stack([done["complete_ts"] // self.every * self.every, done["dev"], np.ones(len(sized), "int64"), done["svtm"], done["svtm"], np.where(sized, done["sectors"], 0), sized])
        sums = np.concatenate([self._load("sums", self.SUMS), new])
        if len(new):
            sums = sums[np.lexsort([sums[:, 1], sums[:, 0]])]
            begin = np.flatnonzero(np.append(True, (sums[1:, :2] != sums[:-1, :2]).any(axis=1)))
            total, most = np.add.reduceat(sums, begin), np.maximum.reduceat(sums[:, 4], begin)
            sums = np.column_stack([sums[begin, :2], total[:, 2:4], most, total[:, 5:]])
            self._save("sums", sums)
            self._wait(sums)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._give_up(expiredTimerInfo.getExpiryTimeInMs())
        sums = self._load("sums", self.SUMS)
        # Of a window that ends just at the watermark not all shares may be asked, so it stays.
        over = (sums[:, 0] + self.every) // 1_000_000 < timerValues.getCurrentWatermarkInMs()
        if over.any():
            self._save("sums", sums[~over])
        self._wait(sums[~over])
        start, dev, n, svtm, most, sectors, sized = sums[over].T
        if len(start):
            yield pd.DataFrame({
                "hostname": key[0], "dev": nullable(dev), "start": pd.to_datetime(start, unit="ns"), "n": n, "svtm": svtm, "max_svtm": most, "sectors": nullable(np.where(sized > 0, sectors, NONE)),
                "closed": pd.to_datetime((start + self.every) // 1_000_000 - 1, unit="ms"),
            })


def stream_block_sums(stream: DataFrame, every_ns: int, keep_ms: int = 600_000) -> DataFrame:
    """Requests, service time and sectors of a host's devices in each window in which requests complete. A device has a row for each share of its blocks, all in one batch."""
    if every_ns % 1_000_000:
        raise ValueError("windows are whole milliseconds")
    return _packed_blocks(stream).groupBy("hostname", "share").transformWithStateInPandas(BlockSums(keep_ms, every_ns), BLOCK_SUMS, "Append", "EventTime", eventTimeColumnName="closed")


IRQS = "hostname string, cpu int, kind string, irq int, name string, start long, end long, time long, end_time timestamp"


class PairIrq(StatefulProcessor):
    """State of a CPU: of each kind of interrupt the last event, and the time of hard interrupts so far and at the last soft one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = "{0}_entry boolean, {0}_t long, {0}_irq int, {0}_name string"
        self.seen = handle.getValueState("seen", f"{kind.format('hard')}, {kind.format('soft')}, hard_ns long, hard_before long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["hrtime", "cpu_seqno"]).astype({"irq": "Int32"})
        held = list(self.seen.get() or [None] * 8 + [0, 0])
        # The last event of each kind comes before all rows; its time is counted already.
        was = [(hard, *last) for hard, last in ((True, held[:4]), (False, held[4:8])) if last[0] is not None]
        columns = ["hard", "entry", "hrtime", "irq", "name"]
        pdf = pd.concat([pd.DataFrame(was, columns=columns).astype({"irq": "Int32"}), new[columns]], ignore_index=True) if was else new[columns].reset_index(drop=True)
        hard, entry, t = pdf["hard"].to_numpy(bool), pdf["entry"].to_numpy(bool), pdf["hrtime"].to_numpy("int64")
        place = np.arange(len(pdf))
        hards, softs = place[hard], place[~hard]
        before = np.full(len(pdf), -1)  # the last event of the same kind
        before[hards[1:]], before[softs[1:]] = hards[:-1], softs[:-1]
        ends = place[~entry & (before >= 0) & entry[before]]
        begins = before[ends]
        spent = np.zeros(len(pdf), "int64")
        spent[ends] = t[ends] - t[begins]
        so_far = held[8] + np.cumsum(np.where(hard, spent, 0))  # of hard interrupts
        fresh = softs[softs >= len(was)]
        taken = np.zeros(len(pdf), "int64")
        taken[fresh] = np.diff(so_far[fresh], prepend=held[9])
        last = [[bool(entry[k]), int(t[k]), None if pd.isna(pdf["irq"][k]) else int(pdf["irq"][k]), pdf["name"][k]] if k >= 0 else [None] * 4 for k in (int(max(x, default=-1)) for x in (hards[-1:], softs[-1:]))]
        self.seen.update((*last[0], *last[1], int(so_far[-1]), int(so_far[fresh[-1]]) if len(fresh) else held[9]))
        if len(ends):
            told = pdf.iloc[begins]
            yield pd.DataFrame({
                "hostname": key[0], "cpu": int(key[1]), "kind": np.where(hard[ends], "hard", "soft"), "irq": told["irq"].array, "name": told["name"].to_numpy(), "start": t[begins], "end": t[ends],
                "time": spent[ends] - taken[ends], "end_time": pd.to_datetime(t[ends] // 1000, unit="us"),
            })

    def close(self) -> None:
        pass


def stream_pair_irq(stream: DataFrame) -> DataFrame:
    """Paired interrupts as they end, with the rules of the batch operator."""
    rows = chosen(stream, F.col("event").isin(ENTRY + EXIT)).select("hostname", "cpu", "hrtime", "cpu_seqno", "event_time", F.col("event").isin("irq_handler_entry", "irq_handler_exit").alias("hard"), F.col("event").isin(ENTRY).alias("entry"), "irq.irq", F.col("irq.name").alias("name"))
    return rows.groupBy("hostname", "cpu").transformWithStateInPandas(PairIrq(), IRQS, "Append", "EventTime", eventTimeColumnName="end_time")


STRETCHES = "hostname string, id long, start timestamp, state string, label long, n long, ns long, closed timestamp"
#: States whose time counts.
TIMED = ("RUNNING", "RUNQ", "SWTCH", "IDLE")


class Stretches(StatefulProcessor):
    """State of a share of a host's tasks (or CPUs): what each does, since when, and the times of its windows that are still open.

    An open stretch is split at the end of every window; when the watermark passes that end, the sums of the window are final and leave, so a window
    is emitted once. The stretch itself lives on. A state is its place in TIMED, or -1.
    """

    #: Columns of what is held: id, state, label, whether it has a label, since; and of sums: start of the window, id, state, label, whether it has one, n, ns.
    HELD, SUMS = 5, 7

    def __init__(self, every_ns: int):
        self.every = every_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "held binary, sums binary")

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        held, sums = self.now.get() or (None, None)
        return unpacked(held, self.HELD), unpacked(sums, self.SUMS)

    def _save(self, held: np.ndarray, sums: np.ndarray) -> None:
        self.now.update((packed(held), packed(sums)))
        ends = [x.min() for x in (sums[:, 0] + self.every, (held[held[:, 1] >= 0, 4] // self.every + 1) * self.every) if len(x)]
        if ends:
            self.handle.registerTimer(int(min(ends)) // 1_000_000)

    def _pieces(self, what: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of sums for stretches (id, state, label, whether it has one), cut at the ends of windows."""
        some = (what[:, 1] >= 0) & (end > start)
        what, start, end = what[some], start[some], end[some]
        first = start // self.every
        n = (end - 1) // self.every - first + 1
        k = np.repeat(np.arange(len(n)), n)
        window = (first[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)) * self.every
        ns = np.minimum(end[k], window + self.every) - np.maximum(start[k], window)
        return np.column_stack([window, what[k], np.zeros(len(k), "int64"), ns])

    @staticmethod
    def _summed(*tables: np.ndarray) -> np.ndarray:
        by = [0, 1, 2, 3, 4]
        return pd.DataFrame(np.concatenate(tables)).groupby(by, sort=False).sum().reset_index().to_numpy()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([x[["id", "state", "label", "labelled", "hrtime", "unless", "cpu", "cpu_seqno"]].to_numpy("int64") for x in rows])
        held, sums = self._load()
        touched = np.isin(held[:, 0], new[:, 0])
        was = held[touched]
        # What a task does now comes before all of its rows; it is counted already.
        table = np.concatenate([np.column_stack([was, np.full(len(was), -1), np.zeros((len(was), 2), "int64")]), new])
        fresh = np.arange(len(table)) >= len(was)
        order = np.lexsort([table[:, 7], table[:, 6], table[:, 4], fresh, table[:, 0]])
        table, fresh = table[order], fresh[order]
        sets = table[:, 5] < 0
        base = np.maximum.accumulate(np.where(sets, np.arange(len(table)), -1))
        same = (base >= 0) & (table[base, 0] == table[:, 0]) & (table[base, 1] == table[:, 5])
        some = sets | ~same
        table, fresh = table[some], fresh[some]
        what, t = table[:, :4], table[:, 4]
        more = np.append(what[1:, 0] == what[:-1, 0], False)[: len(t)]
        begun = what[fresh & (what[:, 1] >= 0)]
        at = t[fresh & (what[:, 1] >= 0)] // self.every * self.every
        counts = np.column_stack([at, begun, np.ones(len(at), "int64"), np.zeros(len(at), "int64")])
        nexts = np.append(t[1:], 0)[: len(t)]
        sums = self._summed(sums, counts, self._pieces(what[more], t[more], nexts[more]))
        self._save(np.concatenate([held[~touched], table[~more, : self.HELD]]), sums)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, sums = self._load()
        passed = timerValues.getCurrentWatermarkInMs() * 1_000_000 // self.every * self.every
        late = (held[:, 1] >= 0) & (held[:, 4] < passed)
        if late.any():
            sums = self._summed(sums, self._pieces(held[late, :4], held[late, 4], np.full(late.sum(), passed)))
            held = held.copy()
            held[late, 4] = passed
        done = sums[:, 0] + self.every <= passed
        self._save(held, sums[~done])
        window, ids, state, label, labelled, n, ns = sums[done].T
        if len(window):
            yield pd.DataFrame({
                "hostname": key[0], "id": ids, "start": pd.to_datetime(window, unit="ns"), "state": np.array(TIMED, object)[state], "label": pd.arrays.IntegerArray(label.copy(), labelled == 0),
                "n": n, "ns": ns, "closed": pd.to_datetime((window + self.every) // 1_000_000 - 1, unit="ms"),
            })

    def close(self) -> None:
        pass


def stretches(points: DataFrame, every_ns: int) -> DataFrame:
    """hostname, id, start, state, label, n, ns: how often and how long an id is in each state, window by window.

    ``points`` set a state, unless what was set last without a condition is ``unless``, a state of TIMED; a point with a condition sets no state that another one's condition names.
    """
    if every_ns % 1_000_000:
        raise ValueError("windows are whole milliseconds")
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in TIMED]), F.col(c)).cast("long") - 1
    rows = points.select(
        "hostname", dealt("id"), "id", "hrtime", *ordered_rows("cpu", "cpu_seqno"), F.coalesce(place("state"), F.lit(-1).cast("long")).alias("state"), F.coalesce(place("unless"), F.lit(-1).cast("long")).alias("unless"),
        F.coalesce("label", F.lit(0).cast("long")).alias("label"), F.col("label").isNotNull().cast("long").alias("labelled"), "event_time",
    )
    return rows.groupBy("hostname", "share").transformWithStateInPandas(Stretches(every_ns), STRETCHES, "Append", "EventTime", eventTimeColumnName="closed")


def stream_task_states(stream: DataFrame, every_ns: int = 5_000_000_000) -> DataFrame:
    """Stretches of tasks, as in batch: id is the pid, label the function that a sleeping task waits in. A window leaves once, when the watermark passes its end."""
    from ..operators.states import task_points

    points = chosen(task_points(stream), "kind in ('in', 'out', 'wake', 'enter', 'exit')")
    state = F.when(F.col("kind") == "wake", "RUNQ").when(F.col("kind") != "out", "RUNNING").when(F.col("asleep") == "Q", "RUNQ").when(F.col("asleep") == "Z", "ZOMBIE").otherwise("SWTCH")
    return stretches(points.select(
        "hostname", F.col("pid").alias("id"), "hrtime", "cpu", "cpu_seqno", state.alias("state"), F.when(F.col("kind") == "wake", "RUNNING").alias("unless"),
        F.when(state == "SWTCH", F.get("ips", F.lit(0))).alias("label"), "event_time",
    ), every_ns)


def stream_cpu_states(stream: DataFrame, every_ns: int = 5_000_000_000) -> DataFrame:
    """Stretches of CPUs: id is the CPU, RUNNING while it has a task, IDLE while it has none."""
    state = F.when(F.col("sw.next_pid") == 0, "IDLE").otherwise("RUNNING")
    rows = chosen(stream, "event = 'sched_switch'").select("hostname", F.col("cpu").cast("long").alias("id"), "hrtime", "cpu", "cpu_seqno", state.alias("state"), F.lit(None).cast("string").alias("unless"), F.lit(None).cast("long").alias("label"), "event_time")
    return stretches(rows, every_ns)


def live_calls(stream: DataFrame, every: str = EVERY, keep_ms: int = 600_000) -> DataFrame:
    """Calls of each window in which they end: count, time, longest, errors and bytes. Pairing comes first and keeps its open calls when a window is done."""
    calls = stream_pair_syscalls(stream, keep_ms).withColumnRenamed("exit_time", "event_time")
    out = calls.groupBy(F.window("event_time", every), "hostname", "syscallno").agg(
        F.count("*").alias("n"), F.sum("elapsed").alias("ns"), F.max("elapsed").alias("max_ns"), F.count_if(is_err(F.col("ret"))).alias("errs"), F.sum(moved_bytes()).alias("bytes"),
    )
    return out.select(F.col("window.start").alias("start"), "hostname", "syscallno", "n", "ns", "max_ns", "errs", "bytes")


def live_busy(stream: DataFrame, every_ns: int = 5_000_000_000) -> DataFrame:
    """Run, queue and sleep time of each host's tasks in each window, and how many ran. Stretches come first and live on when a window is done."""
    every = f"{every_ns // 1_000_000} milliseconds"
    tasks = stream_task_states(stream, every_ns).withColumnRenamed("closed", "event_time")
    ns = lambda x: F.sum(F.when(F.col("state") == x, F.col("ns")).otherwise(0)).alias({"RUNNING": "run_ns", "RUNQ": "runq_ns", "SWTCH": "sleep_ns"}[x])
    out = tasks.groupBy(F.window("event_time", every), "hostname").agg(ns("RUNNING"), ns("RUNQ"), ns("SWTCH"), F.count_if((F.col("state") == "RUNNING") & (F.col("ns") > 0)).alias("ran"))
    return out.select(F.col("window.start").alias("start"), "hostname", "run_ns", "runq_ns", "sleep_ns", "ran")


#: What each live view counts: rows of which events, by which key.
VIEWS = {
    "task": ("pid >= 0", {"pid": "pid"}), "cpu": ("true", {"cpu": "cpu"}), "disk": ("blk is not null", {"dev": "blk.dev"}), "file": ("sys.inode is not null", {"dev": "sys.dev", "node": "sys.inode"}), "net": ("sys.laddr is not null", {"lip": "sys.laddr", "rip": "sys.raddr"}),
    "futex": ("event = 'sys_enter' and sys.syscallno = 202", {"addr": "sys.args[0]"}), "irq": ("irq is not null", {"kind": "irq.kind", "irq": "irq.irq"}), "wait": ("event = 'sched_switch' and sw.prev_state > 0", {"frame": "sw.ips[0]"}), "profile": ("event = 'hardclock'", {"pc": "hc.ips[1]"}), "syscall": ("event = 'sys_enter'", {"syscallno": "sys.syscallno"}),
}


def view_rows(df: DataFrame, view: str, entity: dict | None = None) -> DataFrame:
    """Rows of a view with its key columns; ``entity`` drills down to one."""
    test, keys = VIEWS[view]
    out = df.where(test).select("hostname", *([F.col("event_time")] if "event_time" in df.columns else []), *[F.expr(e).alias(k) for k, e in keys.items()])
    for k, v in (entity or {}).items():
        out = out.where(F.col(k) == v)
    return out


def live_top(stream: DataFrame, view: str, n: int, sink: Callable[[DataFrame, int], None], every: str = EVERY, entity: dict | None = None, checkpoint: str | None = None):
    """Start a query that hands ``sink`` the first n rows of each window of a view, batch by batch, with the batch's number: a batch that runs again must replace what it wrote.

    ``checkpoint`` is where a restart goes on from; by default a new folder in the shared one.
    """
    checkpoint = checkpoint or folder(stream.sparkSession, "live-top-state")
    keys = list(VIEWS[view][1])
    counts = view_rows(stream, view, entity).groupBy(F.window("event_time", every), "hostname", *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "hostname", *keys, "n")
    with stateful(stream.sparkSession):
        return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: sink(topn.top_n_per(df, ["start", "hostname"], "n", n, keys), k)).start()
