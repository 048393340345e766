"""Sources: trace tables, text logs, and the listings that describe a host."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ORDER, TRACE, as_trace, family


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A trace table in Parquet, partitioned by hostname and capture_id; only the families that a query names are read."""
    return spark.read.schema(TRACE).parquet(path)


def read_cluster(spark: SparkSession, glob: str) -> DataFrame:
    """Captures of several hosts, each in a directory hostname=...; the host is a key like any other."""
    base = glob.split("*")[0].rsplit("/hostname=", 1)[0]
    return spark.read.schema(TRACE).option("basePath", base).parquet(glob)


def write_trace(df: DataFrame, path: str) -> None:
    """Each capture in files of ranges of time, each of them in order: a capture may be larger than a task can hold."""
    as_trace(df).repartitionByRange("hostname", "capture_id", *ORDER).sortWithinPartitions("hostname", "capture_id", *ORDER).write.partitionBy("hostname", "capture_id").parquet(path)


def read_trace_text(spark: SparkSession, path: str, hostname: str = "localhost") -> DataFrame:
    """A text log, one event a line: ``<secs> cpu=N pid=N tgid=N <event> k=v k=v ...``. Lines of another form keep their text in ``_corrupt``."""
    line = spark.read.text(path)
    head = r"^\s*(\d+)\.(\d{1,9})\s+cpu=(\d+)\s+pid=(-?\d+)\s+tgid=(-?\d+)\s+(\S+)\s*(.*)$"
    part = lambda k: F.regexp_extract("value", head, k)
    e = line.withColumns({"ok": F.col("value").rlike(head), "tail": F.str_to_map(part(7), F.lit(r"\s+"), F.lit("="))})
    v = lambda name, kind="bigint": F.expr(f"try_cast(tail['{name}'] as {kind})")
    list_ = lambda name: F.expr(f"transform(split(tail['{name}'], ','), x -> try_cast(x as bigint))")
    event = part(6)
    fam = lambda test, _fam, **values: F.when(test, family(_fam, **values)).alias(_fam)
    out = e.select(
        F.lit(hostname).alias("hostname"), F.lit("text").alias("capture_id"), F.when(F.col("ok"), part(1).cast("bigint") * 1_000_000_000 + F.rpad(part(2), 9, "0").cast("bigint")).alias("hrtime"),
        F.when(F.col("ok"), event).alias("event"), F.when(F.col("ok"), part(3).cast("int")).alias("cpu"), F.when(F.col("ok"), F.coalesce(v("seqno"), F.monotonically_increasing_id())).alias("cpu_seqno"),
        F.when(F.col("ok"), part(4).cast("bigint")).alias("pid"), F.when(F.col("ok"), part(5).cast("bigint")).alias("tgid"),
        fam(event == "sched_switch", "sw", syscallno=v("syscall"), prev_state=v("prev_state"), next_pid=v("next_pid"), next_tgid=v("next_tgid"), next_prio=v("next_prio"), prev_prio=v("prev_prio"), total_rss=v("rss"), total_vm=v("vss"), stealtime=v("steal"), ips=list_("stack")),
        fam(event.isin("sched_wakeup", "sched_wakeup_new"), "wk", target_pid=v("target_pid"), target_pri=v("prio"), target_cpu=v("target_cpu"), success=v("success"), is_new=event == "sched_wakeup_new"),
        fam(event.startswith("block_rq_"), "blk", dev=v("dev"), sector=v("sector"), cmd_flags=v("flags"), nr_sectors=v("nr_sectors"), bytes=v("bytes")),
        fam(event.isin("sys_enter", "sys_exit"), "sys", syscallno=v("syscall"), is32bit=v("is32bit"), args=list_("args"), ret=v("ret"), filename=v("filename", "string")),
        fam(event == "hardclock", "hc", preempt_count=v("preempt_count"), ips=list_("stack")),
        fam(event.startswith("irq_") | event.startswith("softirq_"), "irq", kind=F.when(event.startswith("soft"), "soft").otherwise("hard"), irq=v("irq"), name=v("name", "string")),
        fam(event.startswith("power_"), "pwr", state=v("state"), freq=v("freq"), tgt_cpu=v("tgt_cpu")),
        F.when(~F.col("ok"), F.col("value")).alias("_corrupt"),
    )
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in TRACE.fields if f.name not in out.columns]
    return out.select(*out.columns, *rest).select(*TRACE.fieldNames(), "_corrupt")


def merge_captures(*dfs: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Captures as one, clustered by ranges of time and sorted within each; ties by CPU and its sequence. ``orderBy`` is for reports only."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return both.repartitionByRange(*order).sortWithinPartitions(*order)


def _host(path_col: str = "_path"):
    """The host of a file: its directory hostname=..., else the directory it lies in."""
    return F.coalesce(F.nullif(F.regexp_extract(path_col, r"hostname=([^/]+)/", 1), F.lit("")), F.regexp_extract(path_col, r"([^/]+)/[^/]+$", 1)).alias("host")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"))


def _fields(lines: DataFrame, pattern: str, names: dict[str, str]) -> DataFrame:
    """Groups of a pattern as typed columns, for the lines that fit it."""
    cols = [F.expr(f"try_cast(nullif(g[{k}], '') as {kind})").alias(name) for k, (name, kind) in enumerate(names.items())]
    groups = F.array(*[F.regexp_extract("value", pattern, k + 1) for k in range(len(names))])
    return lines.where(F.col("value").rlike(pattern)).select(_host(), groups.alias("g")).select("host", *cols)


def read_processes(spark: SparkSession, path: str) -> DataFrame:
    """A ``ps -eLf`` listing: UID PID PPID LWP C NLWP STIME TTY TIME CMD; a thread's pid is its LWP, its tgid the PID."""
    p = _fields(_lines(spark, path), r"^\s*\S+\s+(\d+)\s+(\d+)\s+(\d+)\s+\d+\s+(\d+)\s+\S+\s+\S+\s+\S+\s+(.*)$", {"tgid": "bigint", "ppid": "bigint", "pid": "bigint", "nlwp": "int", "cmd": "string"})
    return p.select("host", "pid", "tgid", "ppid", "nlwp", "cmd")


def read_open_files(spark: SparkSession, path: str) -> DataFrame:
    """An lsof listing: COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME; addresses of sockets are split."""
    f = _fields(_lines(spark, path), r"^(\S+)\s+(\d+)\s+\S+\s+(\d+)[a-zA-Z]*\s+(\S+)\s+(\S+)\s+\S+\s+(\S+)\s+(.*)$", {"cmd": "string", "pid": "bigint", "fd": "int", "ftype": "string", "device": "string", "node": "string", "fname": "string"})
    ends = r"^\[?([0-9a-fA-F.:*]+?)\]?:(\d+|\*)(?:->\[?([0-9a-fA-F.:]+?)\]?:(\d+))?"
    sock = F.col("ftype").isin("IPv4", "IPv6")
    a = lambda k: F.when(sock, F.nullif(F.regexp_extract("fname", ends, k), F.lit("")))
    major, minor = (F.expr(f"try_cast(get(split(device, ','), {k}) as bigint)") for k in (0, 1))
    return f.select("host", "pid", "fd", "ftype", (F.shiftleft(major, 20) + minor).alias("dev"), F.expr("try_cast(node as bigint)").alias("node"), "fname", a(1).alias("laddr"), a(2).try_cast("int").alias("lport"), a(3).alias("raddr"), a(4).try_cast("int").alias("rport"))


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``node N cpus: 0-3,8`` give the node of each CPU, lines ``siblings: 0,4`` the hyper-thread pairs; a pair is one physical CPU, numbered by its smaller CPU."""
    lines = _lines(spark, path)
    cpus = lambda c: F.flatten(F.transform(F.split(c, ","), lambda r: F.sequence(F.split(r, "-")[0].cast("int"), F.element_at(F.split(r, "-"), -1).cast("int"))))
    node = _fields(lines, r"^node (\d+) cpus:\s*([0-9,-]+)", {"ldom": "int", "list": "string"}).select("host", "ldom", F.explode(cpus(F.col("list"))).alias("cpu"))
    pairs = _fields(lines, r"^siblings:\s*(\d+)[,-](\d+)", {"a": "int", "b": "int"})
    both = pairs.select("host", F.col("a").alias("cpu"), F.col("b").alias("lcpu_sibling")).union(pairs.select("host", F.col("b"), F.col("a")))
    return node.join(both, ["host", "cpu"], "left").select("host", "cpu", "ldom", "lcpu_sibling", F.least("cpu", "lcpu_sibling").alias("pcpu_idx"))


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``dev=0x00800010 name=sda path=0x... mapper=mpatha wwn=0x... policy=round-robin``; what is missing is null."""
    kv = _lines(spark, path).where("value like '%dev=%'").select(_host(), F.str_to_map("value", F.lit(r"\s+"), F.lit("=")).alias("m"))
    num = lambda k: F.conv(F.regexp_replace(F.col("m")[k], "^0x", ""), 16, 10).cast("bigint")
    return kv.select("host", num("dev").alias("dev"), F.col("m")["name"].alias("devname"), num("path").alias("devpath"), F.col("m")["mapper"].alias("mapname"), F.col("m")["wwn"].alias("wwn"), F.col("m")["policy"].alias("mp_policy"))


def read_symbols(spark: SparkSession, path: str, space: str = "kernel") -> DataFrame:
    """A symbol listing (address, type, name, [module]); text symbols only. Addresses keep their 64 bits in a long."""
    s = _fields(_lines(spark, path), r"^([0-9a-fA-F]{1,16})\s+[tT]\s+(\S+)(?:\s+\[(\S+)\])?", {"hex": "string", "sym": "string", "module": "string"})
    high, low = (F.conv(part, 16, 10).cast("bigint") for part in (F.expr("substr(lpad(hex, 16, '0'), 1, 8)"), F.expr("substr(lpad(hex, 16, '0'), 9, 8)")))
    return s.select("host", F.lit(space).alias("space"), F.shiftleft(high, 32).bitwiseOR(low).alias("addr"), "sym", "module")


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Container listings ``<id> <image> <name>`` with cgroup lines ``<pid> .../<id>``, joined by the first 12 digits of the id."""
    lines = _lines(spark, path)
    ps = _fields(lines, r"^([0-9a-f]{12})\s+(\S+)\s+.*?(\S+)\s*$", {"id": "string", "image": "string", "name": "string"})
    cg = _fields(lines, r"^(\d+)\s+\S*/(?:docker[-/]|cri-containerd-|crio-)?([0-9a-f]{12})[0-9a-f]*", {"pid": "bigint", "id": "string"})
    return cg.join(ps, ["host", "id"], "left").select("host", F.col("id").alias("container_id"), "name", "image", "pid")


def read_thread_names(spark: SparkSession, path: str) -> DataFrame:
    """Names that override a thread's command: ``pid name`` lines of a database (kind db), ``"name" ... nid=0x..`` lines of a Java stack dump (kind java)."""
    lines = _lines(spark, path)
    java = _fields(lines, r'^"([^"]+)".*\bnid=0x([0-9a-fA-F]+)', {"thread_name": "string", "nid": "string"}).select("host", F.conv("nid", 16, 10).cast("bigint").alias("pid"), "thread_name", F.lit("java").alias("kind"))
    db = _fields(lines, r"^\s*(\d+)\s+(\S.*?)\s*$", {"pid": "bigint", "thread_name": "string"}).select("host", "pid", "thread_name", F.lit("db").alias("kind"))
    return java.unionByName(db)


def read_host_facts(spark: SparkSession, path: str) -> DataFrame:
    """Small facts of a host as (host, kind, key, value): lines ``kind key = value``."""
    return _fields(_lines(spark, path), r"^(\w+)\s+(\S+)\s*=\s*(.*?)\s*$", {"kind": "string", "key": "string", "value": "string"})


def read_call_names(spark: SparkSession, path: str) -> DataFrame:
    """arch, syscallno, name of system calls, from a directory ``arch=...`` for each architecture.

    Lines are those of a header ("#define __NR_read 0", "#define __NR3264_fcntl 25"), of a kernel table ("0 common read sys_read") or of
    a plain listing ("0 read"); others are passed over. Of several names of a number the first by letters stays.
    """
    line = F.trim(F.col("value"))
    header, listed = r"^#\s*define\s+__NR(?:3264)?_(\w+)\s+(\d+)\b", r"^(\d+)\s+(?:(?:common|64|x32|i386)\s+)?([A-Za-z_]\w*)"
    take = lambda at, number: F.nullif(F.regexp_extract(line, *at), F.lit("")).cast("int" if number else "string")
    t = spark.read.text(path).select("arch", F.coalesce(take((header, 2), True), take((listed, 1), True)).alias("syscallno"), F.coalesce(take((header, 1), False), take((listed, 2), False)).alias("name"))
    return t.where("syscallno is not null and name is not null").groupBy("arch", "syscallno").agg(F.min("name").alias("name"))
