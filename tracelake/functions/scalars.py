"""Column expressions: decoding of flags and enumerations, addresses, device numbers, units, stacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kernel names of states, flags and operations.
TASK_STATES = [(1, "INTERRUPTIBLE"), (2, "UNINTERRUPTIBLE"), (4, "STOPPED"), (8, "TRACED"), (16, "DEAD"), (32, "ZOMBIE"), (64, "PARKED")]
OPEN_FLAGS = [(1, "O_WRONLY"), (2, "O_RDWR"), (0x40, "O_CREAT"), (0x80, "O_EXCL"), (0x200, "O_TRUNC"), (0x400, "O_APPEND"), (0x800, "O_NONBLOCK"), (0x4000, "O_DIRECT")]
FUTEX_OPS = {0: "WAIT", 1: "WAKE", 2: "FD", 3: "REQUEUE", 4: "CMP_REQUEUE", 5: "WAKE_OP", 6: "LOCK_PI", 7: "UNLOCK_PI", 8: "TRYLOCK_PI", 9: "WAIT_BITSET", 10: "WAKE_BITSET", 11: "WAIT_REQUEUE_PI", 12: "CMP_REQUEUE_PI", 13: "LOCK_PI2"}
WHENCE = {0: "SEEK_SET", 1: "SEEK_CUR", 2: "SEEK_END"}
FCNTL = {
    0: "F_DUPFD", 1: "F_GETFD", 2: "F_SETFD", 3: "F_GETFL", 4: "F_SETFL", 5: "F_GETLK", 6: "F_SETLK", 7: "F_SETLKW", 8: "F_SETOWN", 9: "F_GETOWN", 10: "F_SETSIG", 11: "F_GETSIG", 12: "F_GETLK64", 13: "F_SETLK64", 14: "F_SETLKW64",
    15: "F_SETOWN_EX", 16: "F_GETOWN_EX", 17: "F_GETOWNER_UIDS", 36: "F_OFD_GETLK", 37: "F_OFD_SETLK", 38: "F_OFD_SETLKW",
    1024: "F_SETLEASE", 1025: "F_GETLEASE", 1026: "F_NOTIFY", 1029: "F_CANCELLK", 1030: "F_DUPFD_CLOEXEC", 1031: "F_SETPIPE_SZ", 1032: "F_GETPIPE_SZ", 1033: "F_ADD_SEALS", 1034: "F_GET_SEALS", 1035: "F_GET_RW_HINT", 1036: "F_SET_RW_HINT", 1037: "F_GET_FILE_RW_HINT", 1038: "F_SET_FILE_RW_HINT",
}
SEMCTL = {0: "IPC_RMID", 1: "IPC_SET", 2: "IPC_STAT", 3: "IPC_INFO", 11: "GETPID", 12: "GETVAL", 13: "GETALL", 14: "GETNCNT", 15: "GETZCNT", 16: "SETVAL", 17: "SETALL", 18: "SEM_STAT", 19: "SEM_INFO", 20: "SEM_STAT_ANY"}
IPC_CALLS = {1: "SEMOP", 2: "SEMGET", 3: "SEMCTL", 4: "SEMTIMEDOP", 11: "MSGSND", 12: "MSGRCV", 13: "MSGGET", 14: "MSGCTL", 21: "SHMAT", 22: "SHMDT", 23: "SHMGET", 24: "SHMCTL"}
SOCKET_DOMAINS = {0: "AF_UNSPEC", 1: "AF_UNIX", 2: "AF_INET", 3: "AF_AX25", 4: "AF_IPX", 5: "AF_APPLETALK", 10: "AF_INET6", 15: "AF_KEY", 16: "AF_NETLINK", 17: "AF_PACKET", 40: "AF_VSOCK"}
SOCKET_TYPES = {1: "STREAM", 2: "DGRAM", 3: "RAW", 4: "RDM", 5: "SEQPACKET", 6: "DCCP", 10: "PACKET"}
SIGNALS = {
    1: "HUP", 2: "INT", 3: "QUIT", 4: "ILL", 5: "TRAP", 6: "ABRT", 7: "BUS", 8: "FPE", 9: "KILL", 10: "USR1", 11: "SEGV", 12: "USR2", 13: "PIPE", 14: "ALRM", 15: "TERM", 16: "STKFLT", 17: "CHLD", 18: "CONT", 19: "STOP", 20: "TSTP", 21: "TTIN", 22: "TTOU",
    23: "URG", 24: "XCPU", 25: "XFSZ", 26: "VTALRM", 27: "PROF", 28: "WINCH", 29: "IO", 30: "PWR", 31: "SYS",
}
REQUEST_OPS = {0: "R", 1: "W", 2: "FLUSH", 3: "DISCARD"}


def decode_flags(col: Column, table: list[tuple[int, str]], none: str = "0") -> Column:
    """Names of the bits that are set, joined by |."""
    names = F.array_compact(F.array(*[F.when(col.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in table]))
    return F.when(col.isNull(), F.lit(None).cast("string")).when(F.size(names) == 0, none).otherwise(F.array_join(names, "|"))


def task_state_str(col: Column) -> Column:
    return decode_flags(col, TASK_STATES, "RUN")


def decode_enum(col: Column, names: dict[int, str]) -> Column:
    """The name of a number, or the number itself."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, col.cast("int")), col.cast("string"))


def ipv4_str(addr: Column) -> Column:
    """Dotted form of an address of 32 bits, highest byte first."""
    return F.concat_ws(".", *[F.shiftright(addr, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def ipv6_str(hex_addr: Column) -> Column:
    """An address of 32 hex digits: dotted if it is a mapped v4 one, else groups without leading zeros and the first longest run of zero groups as ::."""
    h = F.lower(hex_addr)
    v4 = F.concat_ws(".", *[F.conv(F.substring(h, 25 + 2 * k, 2), 16, 10) for k in range(4)])
    groups = F.concat_ws(":", *[F.coalesce(F.nullif(F.regexp_replace(F.substring(h, 1 + 4 * k, 4), "^0+", ""), F.lit("")), F.lit("0")) for k in range(8)])
    out = groups
    packed = F.lit(None).cast("string")
    for n in range(2, 9):
        run = ":".join(["0"] * n)
        hit = groups.rlike(f"(^|:){run}(:|$)")
        first = F.concat(F.regexp_extract(groups, f"^(.*?)(^|:){run}(:|$)(.*)$", 1), F.lit("::"), F.regexp_extract(groups, f"^(.*?)(^|:){run}(:|$)(.*)$", 4))
        packed = F.when(hit, first).otherwise(packed)
    return F.when(h.startswith("00000000000000000000ffff"), v4).otherwise(F.coalesce(packed, out))


def ip_port_str(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), port.cast("string"))


def dev_major(dev: Column) -> Column:
    return F.shiftright(dev, 20)


def dev_minor(dev: Column) -> Column:
    return dev.bitwiseAND(F.lit((1 << 20) - 1))


def fmt_dev(dev: Column) -> Column:
    """A device number in eight hex digits with its prefix."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(dev), 8, "0")))


def secs(ns: Column) -> Column:
    return ns / 1e9


def msecs(ns: Column) -> Column:
    return ns / 1e6


def usecs(ns: Column, whole: bool = True) -> Column:
    return F.floor(ns / 1000) if whole else ns / 1e3


def kbytes(sectors: Column) -> Column:
    return sectors / 2


def mbytes(sectors: Column) -> Column:
    return sectors / 2048


def stack_str(stack: Column, sep: str = " ") -> Column:
    """Frames of a stack in one string; addresses in hex."""
    return F.array_join(F.transform(stack, lambda x: x.cast("string")), sep)


def is_err(ret: Column) -> Column:
    return ret.between(-4095, -1)


def errno(ret: Column) -> Column:
    return F.when(is_err(ret), -ret)


def futex_key(tgid: Column, addr: Column, op: Column) -> Column:
    """Process and whole address of a private futex, 0 and address of a shared one."""
    return F.struct(F.when(op.bitwiseAND(F.lit(128)) != 0, tgid).otherwise(0).alias("space"), addr.alias("addr"))


def syscall_key(is32bit: Column, number: Column) -> Column:
    return F.struct(is32bit.alias("is32bit"), number.alias("syscallno"))


def block_key(dev: Column, sector: Column) -> Column:
    return F.struct(dev.alias("dev"), sector.alias("sector"))


def trace_key(event: Column, number: Column) -> Column:
    """Type of event, and for system calls the number too."""
    return F.struct(event.alias("event"), F.when(event.isin("sys_enter", "sys_exit"), number).alias("syscallno"))
