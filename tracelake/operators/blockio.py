"""Block I/O: request lifecycles, device statistics, queues and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import is_barrier
from .hot import SLICES, Scan, hot_cuts, parted, written
from .states import bucket, wide_sum

#: Upper edges of histogram buckets of service times in milliseconds (fixed values).
SERVICE_EDGES_MS = [2, 5, 10, 15, 30, 50, 100, 150, 200]
EVENTS = ["block_rq_insert", "block_rq_issue", "block_rq_complete", "block_rq_requeue", "block_rq_abort"]
INSERT, ISSUE, COMPLETE, REQUEUE, ABORT = range(5)  # places in EVENTS
KEY = ["hostname", "dev", "sector"]
#: Bits of the request flags that tell the operation (fixed value); operations above write are not counted.
OPERATION = 0xFF


def _requests(df: DataFrame, completed: bool) -> DataFrame:
    """A row for each request, or each completed one, with its last insert and issue: ``req`` is how many were completed or aborted before on the same device and sector.

    All is told by the last event of a request, the one that completes or aborts it if there is one, from one sort: what came last before it counts if it came after the end of the
    request before. Sectors lead the sort, as the first column is what a sort compares cheaply and hosts are few; rows are dealt and sorted before values are put together.
    """
    kind = F.coalesce(*[F.when(F.col("event") == x, k) for k, x in enumerate(EVENTS)]).cast("byte")
    e = df.where(F.col("event").isin(EVENTS)).select("hostname", "hrtime", "cpu", "cpu_seqno", "pid", kind.alias("kind"), F.least(kind, F.lit(COMPLETE).cast("byte")).alias("step"), "blk.dev", "blk.sector", "blk.nr_sectors", F.col("blk.cmd_flags").alias("flags"))
    kind, key, order = F.col("kind"), KEY[::-1], ["hrtime", "cpu_seqno", "step", "nr_sectors", "pid"]
    e = e.repartition(*key).sortWithinPartitions(*key, *order)
    ends = kind.isin(COMPLETE, ABORT)
    w = Window.partitionBy(*key).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("hrtime", "cpu_seqno", "step")
    told = F.struct(place.alias("place"), "hrtime", "cpu_seqno", "pid", "nr_sectors", "flags")
    r = e.withColumns({
        "req": F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)), "_end": F.last(F.when(ends, place), True).over(before), "_ins": F.last(F.when(kind == INSERT, told), True).over(upto), "_iss": F.last(F.when(kind == ISSUE, told), True).over(upto),
        "_again": F.sum((kind == REQUEUE).cast("int")).over(upto), **({} if completed else {"_more": F.lead("kind").over(w)}),
    })
    r = r.where(ends if completed else ends | F.col("_more").isNull())
    r = r.withColumn("requeues", (F.col("_again") - F.lag("_again", 1, 0).over(w)).cast("long"))
    r = r.where(kind == COMPLETE) if completed else r
    own = lambda c: F.when(F.col("_end").isNull() | (F.col(f"{c}.place") > F.col("_end")), F.col(c))
    done = lambda c: F.when(kind == COMPLETE, F.col(c))
    r = r.withColumns({"_ins": own("_ins"), "_iss": own("_iss")})
    return r.select(
        *KEY, "req", F.col("_ins.hrtime").alias("ins"), F.col("_iss.hrtime").alias("iss"), done("hrtime").alias("complete_ts"), F.col("_ins.pid").alias("ins_pid"), F.col("_iss.pid").alias("iss_pid"),
        F.coalesce("_iss.nr_sectors", done("nr_sectors"), "_ins.nr_sectors").alias("nr_sectors"), F.coalesce(done("flags"), "_iss.flags", "_ins.flags").alias("flags"), "requeues", F.col("_iss.cpu_seqno").alias("seqno"), done("cpu").alias("cpu"),
    )


def pair_block_io(df: DataFrame, resolve: bool = False) -> DataFrame:
    """One row for each completed request: hostname, dev, sector, rw, nr_sectors, insert_ts, issue_ts, complete_ts, qtm, svtm, insert_pid, issue_pid, requeues.

    Without an insert the issue stands for it. qtm is issue less insert where that is not negative; svtm is completion less issue,
    or less insert where there was no issue. With ``resolve`` an issue without an insert of its sector takes one that lies inside of it.
    """
    r = _requests(df, not resolve)
    if resolve:
        r = resolve_merged(written(r, "requests"))
    r = r.where("complete_ts is not null and (ins is not null or iss is not null)")
    return r.select(
        *KEY, "req", F.expr(f"cast(flags & {OPERATION} as int)").alias("rw"), "nr_sectors", F.coalesce("ins", "iss").alias("insert_ts"), F.col("iss").alias("issue_ts"), "complete_ts",
        F.expr("case when iss is null then null when coalesce(ins, iss) <= iss then iss - coalesce(ins, iss) end").alias("qtm"), F.expr("complete_ts - coalesce(iss, ins)").alias("svtm"),
        F.coalesce("ins_pid", "iss_pid").alias("insert_pid"), F.col("iss_pid").alias("issue_pid"), "requeues", "seqno", "cpu", "flags",
    )


def resolve_merged(requests: DataFrame, span: int = 4096) -> DataFrame:
    """Requests that have an issue but no insert take the latest insert, still without an issue, that lies inside of their sectors.

    Sectors are cut into ranges of ``span``, so the containment test runs within equal ranges of one device only.
    """
    issued = requests.where("iss is not null and ins is null").select(*KEY, "req", "iss", "nr_sectors", F.explode(F.expr(f"sequence(sector div {span}, (sector + nr_sectors) div {span})")).alias("range"))
    inserted = requests.where("ins is not null and iss is null").select("hostname", "dev", F.col("sector").alias("s2"), F.col("nr_sectors").alias("n2"), F.col("ins").alias("ins2"), F.col("ins_pid").alias("pid2"), F.expr(f"sector div {span}").alias("range"))
    met = issued.join(inserted, ["hostname", "dev", "range"]).where("s2 >= sector and s2 + n2 <= sector + nr_sectors and ins2 <= iss")
    best = met.groupBy(*KEY, "req").agg(F.max(F.struct("ins2", "s2", "pid2")).alias("m"))
    out = requests.join(best, [*KEY, "req"], "left")
    return out.withColumn("ins", F.coalesce("ins", "m.ins2")).withColumn("ins_pid", F.coalesce("ins_pid", "m.pid2")).drop("m")


def requeue_abort(df: DataFrame) -> DataFrame:
    """Requeues and aborts of each device."""
    return df.where("event in ('block_rq_requeue', 'block_rq_abort')").groupBy("hostname", F.col("blk.dev").alias("dev")).agg(F.count_if(F.col("event") == "block_rq_requeue").alias("requeues"), F.count_if(F.col("event") == "block_rq_abort").alias("aborts"))


def hot_devices(df: DataFrame, slices: int = SLICES) -> DataFrame | None:
    """Cuts of the devices of a trace that are hot (see ``hot``), for the operators below."""
    return hot_cuts(df.where("event = 'block_rq_complete'").select("hostname", F.col("blk.dev").alias("dev"), "hrtime"), ("hostname", "dev"), "hrtime", slices)


def seq_random(io: DataFrame, key: tuple[str, ...] = ("hostname", "dev"), cuts: DataFrame | None = None) -> DataFrame:
    """``sequential``: whether a request begins where the one before it, of the same key and direction, ended; in order of insert."""

    def work(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
        scan = Scan((*key, "rw"), ("insert_ts", "seqno", "sector"), cuts, "insert_ts")
        out = scan.last(scan.sliced(rows), {"_before": F.struct((F.col("sector") + F.col("nr_sectors")).alias("end"))})
        return out.select(*io.columns, F.coalesce(F.col("sector") == F.col("_before.end"), F.lit(False)).alias("sequential"))

    return parted(io, cuts, work)


def queue_len(df: DataFrame, key: tuple[str, ...] = ("hostname", "dev"), cuts: DataFrame | None = None) -> DataFrame:
    """Mean and largest queue length: one more on insert, one less on issue but never below 0, as the running sum less its running minimum."""
    step = F.when(F.col("event") == "block_rq_insert", 1).otherwise(-1)
    e = df.where("event in ('block_rq_insert', 'block_rq_issue')").select("hostname", "hrtime", "cpu_seqno", "blk.dev", "pid", "cpu", step.alias("step"), (-step).alias("turn"))

    def work(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
        scan = Scan(key, ("hrtime", "cpu_seqno", "turn"), cuts)
        out = scan.running(scan.running(scan.sliced(rows), "s", F.col("step")), "low", F.col("s"), "min")
        return out.select(*key, (F.col("s") - F.least(F.lit(0), F.col("low"))).alias("len"))

    e = parted(e, cuts, work)
    return e.groupBy(*key).agg(F.avg("len").alias("avque"), F.max("len").alias("maxque"), F.count("*").alias("queue_ops"))


#: What ``io_stats`` and ``hot_blocks`` read of a request.
STATED = [*KEY, "rw", "nr_sectors", "insert_ts", "seqno", "qtm", "svtm", "requeues", "flags"]
_IO_SUMS = ["ios", "sectors", "wait_ns", "serv_ns", "waits", "seq", "requeues", "barriers"]


def io_stats(io: DataFrame, by: tuple[str, ...] = ("hostname", "dev"), seconds: float | None = None, cuts: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """Statistics of each key for reads (rw 0), writes (rw 1) and both (rw null): counts, KB, mean and longest wait and service in ms, sequential and random.

    The service time must be above 0 to count. ``seconds`` adds rates; ``cuts`` are those of ``hot_devices``. ``wide`` gives sums of times as decimal(38,0), for keys as
    large as a host: 2^63 ns are 292 years of service, which many requests at once can take.
    """
    total = wide_sum if wide else F.sum
    io = io if "sequential" in io.columns else seq_random(io, cuts=cuts)
    use = io.where("rw <= 1 and svtm > 0")
    g = use.rollup(*by, "rw") if len(by) == 0 else use.withColumn("rws", F.array(F.col("rw"), F.lit(None).cast("int"))).withColumn("rw", F.explode("rws")).groupBy(*by, "rw")
    out = g.agg(
        F.count("*").alias("ios"), F.sum("nr_sectors").alias("sectors"), F.coalesce(total("qtm"), F.lit(0)).alias("wait_ns"), total("svtm").alias("serv_ns"), F.count("qtm").alias("waits"), F.count_if("sequential").alias("seq"),
        F.sum("requeues").alias("requeues"), F.count_if(is_barrier(F.col("sector"), F.col("flags"))).alias("barriers"), F.coalesce(F.max("qtm"), F.lit(0)).alias("max_wait_ns"), F.max("svtm").alias("max_serv_ns"),
    )
    return _rates(out, seconds)


def _rates(out: DataFrame, seconds: float | None) -> DataFrame:
    out = out.withColumns({
        "kb": F.col("sectors") / 2, "rnd": F.col("ios") - F.col("seq"), "avserv_ms": F.col("serv_ns").cast("double") / F.col("ios") / 1e6, "avwait_ms": F.when(F.col("waits") > 0, F.col("wait_ns").cast("double") / F.col("waits") / 1e6).otherwise(0.0), "avsz_kb": F.expr("sectors div 2 div ios"),
    })
    return out.withColumns({"io_s": F.col("ios") / seconds, "kb_s": F.col("kb") / seconds}) if seconds else out


def io_rollup(stats: DataFrame, devices: DataFrame, level: str, seconds: float | None = None) -> DataFrame:
    """Device rows summed by HBA, target (wwn) or mapper device; the largest of waits and of services each for itself."""
    keys = {"hba": "hba", "wwn": "wwn", "mapper": "mapname"}
    j = with_device_paths(stats, devices).where(F.col(keys[level]).isNotNull())
    out = j.groupBy("hostname", keys[level], "rw").agg(*[F.sum(c).alias(c) for c in _IO_SUMS], F.max("max_wait_ns").alias("max_wait_ns"), F.max("max_serv_ns").alias("max_serv_ns"))
    return _rates(out, seconds)


def with_device_paths(io: DataFrame, devices: DataFrame) -> DataFrame:
    """Device rows with name, HBA (the hardware path without its low 16 bits), target, mapper and policy; a device table is a dimension, small by nature, and Spark picks the join."""
    hba = F.expr("shiftleft(shiftright(devpath, 16), 16)")
    return io.join(devices.withColumn("hba", hba), ["hostname", "dev"], "left")


def io_hist(io: DataFrame, edges_ms: list[float] = SERVICE_EDGES_MS, by: tuple[str, ...] = ("hostname", "dev")) -> DataFrame:
    """Service times of reads and writes in buckets of milliseconds; at most 9 rising edges."""
    if len(edges_ms) > 9 or list(edges_ms) != sorted(set(edges_ms)):
        raise ValueError("at most 9 rising edges")
    return io.where("rw <= 1 and svtm > 0").withColumn("bucket", bucket(F.col("svtm") / 1e6, list(edges_ms))).groupBy(*by, "rw", "bucket").agg(F.count("*").alias("n"))


def hot_blocks(io: DataFrame, least: int = 3) -> DataFrame:
    """Blocks read or written again, at least ``least`` times."""
    return io.where("rw <= 1").groupBy("hostname", "dev", "sector", "rw").agg(F.count("*").alias("n")).where(F.col("n") >= least)
