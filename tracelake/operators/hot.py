"""Windows over keys of which one may hold a third of all rows.

A window has one task for each key. For a hot key, one of more than 1/``slices`` of all rows, that is too much: its rows are cut by time into slices of about
that size (``hot_cuts``, from counts and approximate quantiles), windows run within slices, and what a slice leaves to the later ones (its last value, its sum, its first row) is
one small row: those rows are scanned in order, and the result is joined to the rows of the slice. All other keys stay whole, and without hot keys the plan is that of plain windows.
Rows at the same time are never parted, so only keys with a great share of rows at one moment stay uncut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.drive import folder

SLICES = 200
SLICE, HOT = "_slice", "_hot"


def hot_cuts(df: DataFrame, key: tuple[str, ...], at: str = "hrtime", slices: int = SLICES) -> DataFrame | None:
    """For each hot key the times at which its rows are cut; None if no key is hot. At most ``slices`` keys and as many cuts of each come to the driver."""
    seen = Observation()
    counts = df.groupBy(*key).agg(F.count("*").alias("_n")).observe(seen, F.sum("_n").alias("total"))
    top = counts.orderBy(F.desc("_n")).limit(slices).collect()
    total = seen.get["total"] or 0
    hot = {tuple(r[: len(key)]): -(-r["_n"] * slices // total) for r in top if r["_n"] * slices > total}
    if not hot:
        return None
    spark = df.sparkSession
    schema = df.select(*key).schema
    keys = spark.createDataFrame(list(hot), schema).toDF(*[f"_k{i}" for i in range(len(key))])
    rows = df.join(F.broadcast(keys), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "left_semi")
    points = rows.groupBy(*key).agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 100 * slices).alias("_points")).collect()
    cuts = []
    for r in points:
        name, p = tuple(r[: len(key)]), r["_points"] or []
        n = hot[name]
        cuts.append((*name, sorted({p[min(len(p), k * slices // n) - 1] for k in range(1, n)} if p else [])))
    out = spark.createDataFrame(cuts, schema.add("_points", df.select(F.array(at)).schema[0].dataType))
    return out


def settled(df: DataFrame) -> DataFrame:
    """The table computed once, its lineage cut where the cluster has a checkpoint folder."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table computed once, as files in the cluster's shared folder where it has one: only the columns that are read again are, and packed."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, cuts: DataFrame | None, work: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """``work`` over the rows of hot keys with their cuts, and over all others without."""
    if cuts is None:
        return work(df, None)
    names = cuts.columns[:-1]
    keys = F.broadcast(cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)]))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    return work(df.join(keys, on, "left_anti"), None).unionByName(work(df.join(keys, on, "left_semi"), cuts))


class Scan:
    """A table whose rows are looked at in order within each key, hot keys slice by slice. Columns are added by the methods; each gives a new table.

    With cuts each step reads its table twice, for what slices leave and for the rows, so the table is written first; ``parted`` keeps that to the rows of hot keys.
    """

    def __init__(self, key: tuple[str, ...], order: tuple, cuts: DataFrame | None = None, at: str = "hrtime"):
        self.key, self.order, self.cuts, self.at = list(key), list(order), cuts, at

    def sliced(self, df: DataFrame) -> DataFrame:
        """The table with the slice of each row, and whether its key is hot."""
        if self.cuts is None:
            return df
        names = self.cuts.columns[:-1]  # the key, or a part of it
        cuts = self.cuts.toDF(*[f"_k{i}" for i in range(len(names))], "_points")
        out = df.join(F.broadcast(cuts), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)], "left")
        slice_ = F.coalesce(F.size(F.filter("_points", lambda p: p <= F.col(self.at))), F.lit(0))
        return out.select(*df.columns, F.when(F.col("_points").isNull(), 0).otherwise(slice_).alias(SLICE), F.col("_points").isNotNull().alias(HOT))

    def bare(self, df: DataFrame) -> DataFrame:
        return df.drop(SLICE, HOT)

    def window(self):
        # Hosts are few, so they come last: a sort compares its first column cheaply.
        return Window.partitionBy(*self.key[1:], self.key[0], *([SLICE] if self.cuts is not None else [])).orderBy(*self.order)

    def _place(self):
        return F.struct(*[c if isinstance(c, str) else c for c in self.order])

    def _carried(self, df: DataFrame, summary: dict[str, Column], scans: dict[str, Column]) -> DataFrame:
        """The table with what other slices leave to each: ``summary`` of each slice of hot keys, then ``scans`` over those rows. At most some ``slices`` rows, so it is sent to all."""
        df = settled(df)
        small = df.where(HOT).groupBy(*self.key, SLICE).agg(*[c.alias(n) for n, c in summary.items()]).select(*self.key, SLICE, *[c.alias(n) for n, c in scans.items()])
        names = [f"_k{i}" for i in range(len(self.key))]
        small = small.toDF(*names, "_s", *scans)
        on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(self.key, names, strict=True)]
        return df.join(F.broadcast(small), [*on, F.col(SLICE) == F.col("_s")], "left").drop(*names, "_s")

    def _slices(self, rows: tuple[int, int]):
        return Window.partitionBy(*self.key).orderBy(SLICE).rowsBetween(*rows)

    def last(self, df: DataFrame, cols: dict[str, Column], upto: bool = False) -> DataFrame:
        """The last value that is not null of each expression, among the rows before (with ``upto`` also in the row itself)."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
        if self.cuts is None:
            return df.withColumns({n: F.last(c, True).over(w) for n, c in cols.items()})
        out = self._carried(
            df, {f"_v{i}": F.max_by(c, F.when(c.isNotNull(), self._place())) for i, c in enumerate(cols.values())},
            {f"_c{i}": F.last(f"_v{i}", True).over(self._slices((Window.unboundedPreceding, -1))) for i in range(len(cols))},
        )
        return out.withColumns({n: F.coalesce(F.last(c, True).over(w), F.col(f"_c{i}")) for i, (n, c) in enumerate(cols.items())}).drop(*[f"_c{i}" for i in range(len(cols))])

    def next(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """A value (never null, as structs are) of the next row."""
        w = self.window()
        if self.cuts is None:
            return df.withColumn(name, F.lead(value).over(w))
        out = self._carried(df, {"_v": F.min_by(value, self._place())}, {"_c": F.first("_v", True).over(self._slices((1, Window.unboundedFollowing)))})
        return out.withColumn(name, F.coalesce(F.lead(value).over(w), F.col("_c"))).drop("_c")

    def running(self, df: DataFrame, name: str, value: Column, what: str = "sum") -> DataFrame:
        """The sum (or ``min``, ``max``) of a number up to each row."""
        f, w = {"sum": F.sum, "min": F.min, "max": F.max}[what], self.window().rowsBetween(Window.unboundedPreceding, 0)
        if self.cuts is None:
            return df.withColumn(name, f(value).over(w))
        out = self._carried(df, {"_v": f(value)}, {"_c": f("_v").over(self._slices((Window.unboundedPreceding, -1)))})
        own = f(value).over(w)
        both = {"sum": own + F.coalesce("_c", F.lit(0)), "min": F.least(own, "_c"), "max": F.greatest(own, "_c")}[what]
        return out.withColumn(name, both).drop("_c")
