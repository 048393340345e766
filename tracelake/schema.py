"""The trace table: one header for all events, and one nullable struct for each event family."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

FAMILIES = {
    "sw": "syscallno int, prev_comm string, prev_state bigint, prev_prio int, next_pid bigint, next_tgid bigint, next_policy int, next_prio int, "
    "total_vm bigint, total_rss bigint, stealtime bigint, ips array<bigint>, msr array<bigint>",
    "wk": "target_pid bigint, target_pri int, target_cpu int, success int, is_new boolean",
    "mig": "target_pid bigint, orig_cpu int, dest_cpu int",
    "blk": "dev bigint, sector bigint, cmd_flags bigint, nr_sectors bigint, bytes bigint, async_in_flight int, sync_in_flight int",
    "sys": "syscallno int, is32bit int, args array<bigint>, ret bigint, filename string, "
    "iocbs array<iocb>, io_events array<io_event>, "
    "laddr string, lport int, raddr string, rport int, dev bigint, inode bigint",
    "hc": "preempt_count int, ips array<bigint>",
    "irq": "kind string, irq int, name string",
    "pwr": "type bigint, state bigint, freq bigint, tgt_cpu int",
    "pgc": "dev bigint, i_ino bigint, index bigint",
    "mm": "address bigint, page bigint, order int, flags bigint",
}
HEADER = "hostname string, capture_id string, hrtime bigint, event string, cpu int, cpu_seqno bigint, pid bigint, tgid bigint"

_TYPES = {"int": IntegerType(), "bigint": LongType(), "string": StringType(), "boolean": BooleanType(), "array<bigint>": ArrayType(LongType())}
_NESTED = {
    "array<iocb>": "iocb bigint, op int, fd int, offset bigint, nbytes bigint",
    "array<io_event>": "obj bigint, res bigint",
}


def _fields(text: str) -> StructType:
    """A struct from "name type, ..."; made without a session."""
    out = StructType()
    for part in text.split(", "):
        name, kind = part.split()
        out.add(name, ArrayType(_fields(_NESTED[kind])) if kind in _NESTED else _TYPES[kind])
    return out


TRACE = _fields(HEADER)
for _name, _text in FAMILIES.items():
    TRACE.add(_name, _fields(_text))

#: Order of events; equal times go by CPU, then by its own sequence.
ORDER = ("hrtime", "cpu", "cpu_seqno")
#: Events that can name an entity on their other side.
CAUSAL = ["sched_switch", "sched_wakeup", "sched_wakeup_new", "sched_migrate_task", "block_rq_issue", "block_rq_complete", "block_rq_requeue", "block_rq_abort"]


def family(_name: str, /, **values) -> "F.Column":
    """A struct of a family with the given fields and null for the others."""
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRACE[_name].dataType.fields])


def as_trace(df: DataFrame) -> DataFrame:
    """Bring a table with some of the columns of ``TRACE`` to its full shape."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRACE.fields])


def empty_trace(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRACE)
