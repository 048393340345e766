"""Hard negatives by a vertical scan: columns of the vectors are read one group after another, and candidates drop out on bounds.

Rows are dealt by a hash into blocks of bounded size, each stored by columns: one array for each dimension, the rows of a label side by side.
An anchor reads the dimensions of a block in the order of its own descending magnitudes, ``STEP`` at a time. What is still unread can add no less than the
sum of its least contributions (anchor's component times the block's least or greatest value of that dimension) and no more than the sum of its greatest;
a candidate whose upper bound is below the k-th best lower bound drops out of the bitmap.

1. Positives: the bounds of a label's rows alone; the best of each block, then the best of all blocks.
2. Negatives: each positive opens a window of scores, from ``low`` to ``high`` hundredths of its own. Rows of other labels stay while their bounds
   meet a window that is not yet filled by surer rows; what is left has exact scores and is put into the windows.

Anchors are packed into blocks as well and sent to every block of vectors, so that a task holds one block of each; a label, or one vector that stands
for a third of the rows, is spread over all blocks. Every pair of an anchor and a vector is met, since bounds of one block say nothing of another.

Defined cases: rows with a null vec_id, null label, null vector or any null or non-finite component take no part; components are floor(scale * x), held
within +-2**27 so that scores fit a long; shorter vectors count as ending in zeros; an empty vector scores 0; equal scores go to the smaller vec_id, then to either
of the rows that share it; rows that share a vec_id are rows of their own, and so each other's candidates; a negative positive_score has an empty window;
anchors without positives, and positives without negatives, give no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, grouped, scan, staged

#: Components of a block of vectors, and of one of anchors.
BLOCK, ANCHORS = 1 << 20, 1 << 18
#: Blocks that a table is cut into at least, as far as they have ``LEAST`` rows.
BLOCKS, LEAST = 24, 1024
#: Dimensions read between two looks at the bounds.
STEP = 8
HELD = 1 << 27
PACKED = "ids binary, keys binary, labels binary, dims binary"


def usable(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """key, vec_id, label, v (whole numbers) and anchor of the rows that take part, written once."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(HELD)), F.lit(-HELD)).cast("int")
    rows = vectors.where("vec_id is not null and label is not null").where(x.isNotNull() & ~F.exists(x, bad))
    out = rows.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, whole).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    return staged(out, "whole-vectors")


def dealt(rows: DataFrame, block: str, blocks: int, dim: int, *also: str) -> DataFrame:
    """The rows with the number of their block, and vectors of ``dim`` components."""
    v = F.concat("v", F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias(block), "key", "vec_id", "label", v.alias("v"), *also)


def packed(rows: DataFrame, block: str, dim: int, extra: str = "") -> DataFrame:
    """One row for each block, by columns; rows in order of label. ``extra``: a column of arrays of longs, flattened with a count for each row."""

    def work(key, table):
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        held = lambda name: np.asarray(table.column(name).to_numpy(), "<i8")[order].tobytes()
        flat = np.asarray(table.column("v").combine_chunks().flatten(), "<i4").reshape(-1, dim) if dim else np.zeros((len(label), 0), "<i4")
        out = {block: pa.array([key[0].as_py()], pa.int32()), "ids": [held("vec_id")], "keys": [held("key")], "labels": [held("label")], "dims": [np.ascontiguousarray(flat[order].T).tobytes()]}
        if extra:
            lists = table.column(extra).to_pylist()
            out["counts"] = [np.array([len(lists[i]) for i in order], "<i8").tobytes()]
            out["values"] = [np.array([x for i in order for x in lists[i]], "<i8").tobytes()]
        return pa.table(out)

    return grouped(rows.groupBy(block), work, f"{block} int, {PACKED}" + (", counts binary, values binary" if extra else ""))


class Block:
    """A packed row: ids, keys, labels, the matrix by dimensions, and the slice of each label."""

    def __init__(self, row: dict, dim: int, kind: type):
        self.ids, self.keys, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "keys", "labels"))
        self.dims = np.frombuffer(row["dims"], "<i4").reshape(dim, -1).astype(kind)
        self.names, self.start = np.unique(self.labels, return_index=True)
        self.stop = np.append(self.start[1:], len(self.labels))

    def bounds(self) -> None:
        """Least and greatest value of each dimension, of each label's rows and of all."""
        self.low, self.high = (f.reduceat(self.dims, self.start, axis=1) for f in (np.minimum, np.maximum))
        self.least, self.most = self.low.min(1), self.high.max(1)

    def slice(self, label: int) -> int:
        """Number of a label's slice, -1 if it has none."""
        k = int(np.searchsorted(self.names, label))
        return k if k < len(self.names) and self.names[k] == label else -1


def unread(c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the dimensions from each place on can add at least and at most."""
    a, b = c * low, c * high
    sums = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
    return sums(np.minimum(a, b)), sums(np.maximum(a, b))


def scanned(dims: np.ndarray, at: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Of the columns ``at`` of ``dims`` those that stay, with their exact scores. ``keep`` tells from lower and upper bounds which stay."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    c = anchor[order]
    least, most = unread(c, low[order], high[order])
    score = np.zeros(len(at), dims.dtype)
    for lo in range(0, len(order) if len(at) else 0, STEP):
        hi = min(lo + STEP, len(order))
        score = score + c[lo:hi] @ dims[np.ix_(order[lo:hi], at)]
        stay = keep(score + least[hi], score + most[hi])
        if not stay.all():
            at, score = at[stay], score[stay]
            if not len(at):
                break
    return at, score


def kth(x: np.ndarray, k: int):
    """The k-th largest, or less than all if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def near_of(anchor: np.ndarray, key: int, label: int, block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block, scores) of its k best rows of the anchor's label, without the anchor."""
    s = block.slice(label)
    if s < 0:
        return np.zeros(0, int), np.zeros(0, block.dims.dtype)
    at = np.arange(block.start[s], block.stop[s])
    at, score = scanned(block.dims, at[block.keys[at] != key], anchor, block.low[:, s], block.high[:, s], lambda least, most: most >= kth(least, k))
    best = first(score, block.ids[at], k)
    return at[best], score[best]


def windows_of(anchor: np.ndarray, label: int, floors: np.ndarray, tops: np.ndarray, block: Block, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores (floors to tops) the (places, scores) of the block's k best rows of other labels."""

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(least), bool)
        for floor, top in set(zip(floors.tolist(), tops.tolist(), strict=True)):
            sure = least[(least >= floor) & (most <= top)]
            out |= (most >= max(floor, kth(sure, k))) & (least <= top)
        return out

    at, score = scanned(block.dims, np.flatnonzero(block.labels != label), anchor, block.least, block.most, keep)
    out = []
    for floor, top in zip(floors, tops, strict=True):
        inside = np.flatnonzero((score >= floor) & (score <= top))
        best = inside[first(score[inside], block.ids[at][inside], k)]
        out.append((at[best], score[best]))
    return out


def paired(blocks: DataFrame, n: int, anchors: DataFrame) -> DataFrame:
    """Each block of vectors with each block of anchors; a task for each block of vectors."""
    sent = anchors.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sent = sent.select("b", *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    return blocks.repartition(2 * n, "b").join(sent.repartition(2 * n, "b").hint("merge"), "b")


def rows_of(batches, dim: int, kind: type):
    """(block of vectors, block of anchors, the anchors' row) of each pair; a block that follows itself is unpacked once."""
    held, block = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column(batch, name)[i].as_py() for name in batch.schema.names}
            if held != row["b"]:
                held, block = row["b"], Block(row, dim, kind)
                block.bounds()
            mine = {c[2:]: v for c, v in row.items() if c.startswith("a_")}
            yield block, Block(mine, dim, kind), mine


def best_first(df: DataFrame, k: int, by: list[str], score: str, *ties: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each positive of each row for which ``is_anchor``
    (over vec_id) holds, the best rows of other labels whose scores are from ``low`` to ``high`` hundredths of the positive's."""
    rows = usable(vectors, is_anchor, scale)
    facts = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    n, dim, largest = facts["n"], max(1, facts["dim"] or 0), facts["largest"] or 0
    # Doubles hold all sums exactly while they stay under 2**53.
    kind = np.float64 if dim * largest * largest < 1 << 52 else np.int64
    size = max(1, min(BLOCK // dim, max(LEAST, -(-n // BLOCKS))))
    count, parts = max(1, -(-n // size)), max(1, -(-facts["anchors"] // max(1, ANCHORS // dim)))
    blocks = staged(packed(dealt(rows, "b", count, dim), "b", dim), "vector-blocks", "lz4")
    anchors = rows.where("anchor")

    def near(batches):
        for block, mine, _ in rows_of(batches, dim, kind):
            out = {"key": [], "anchor_id": [], "at": [], "positive_id": [], "positive_score": []}
            for i in range(len(mine.ids)):
                at, score = near_of(mine.dims[:, i], mine.keys[i], mine.labels[i], block, positives)
                out["key"].append(np.full(len(at), mine.keys[i]))
                out["anchor_id"].append(np.full(len(at), mine.ids[i]))
                out["at"].append(block.keys[at])
                out["positive_id"].append(block.ids[at])
                out["positive_score"].append(score.astype(np.int64))
            yield {c: pa.array(np.concatenate(x)) if x else [] for c, x in out.items()}

    found = scan(paired(blocks, count, packed(dealt(anchors, "a", parts, dim), "a", dim)), near, "key long, anchor_id long, at long, positive_id long, positive_score long")
    found = staged(best_first(found, positives, ["key"], "positive_score", "positive_id", "at").select("key", "positive_id", "positive_score", F.col("rank").alias("place")), "positives")

    lists = found.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))), lambda x: F.array(x["place"].cast("long"), x["positive_id"], x["positive_score"]))).alias("near"))
    asking = dealt(anchors.join(lists, "key"), "a", parts, dim, "near")

    def hard(batches):
        for block, mine, row in rows_of(batches, dim, kind):
            ends = np.cumsum(np.frombuffer(row["counts"], "<i8")) // 3
            triples = np.frombuffer(row["values"], "<i8").reshape(-1, 3)
            out = {"key": [], "anchor_id": [], "place": [], "positive_id": [], "positive_score": [], "at": [], "negative_id": [], "negative_score": []}
            for i in range(len(mine.ids)):
                own = triples[ends[i - 1] if i else 0 : ends[i]]
                tops, floors = own[:, 2] * high // 100, -(-own[:, 2] * low // 100)
                for (place, pid, ps), (at, score) in zip(own, windows_of(mine.dims[:, i], mine.labels[i], floors, tops, block, negatives), strict=True):
                    for c, x in (("key", mine.keys[i]), ("anchor_id", mine.ids[i]), ("place", place), ("positive_id", pid), ("positive_score", ps)):
                        out[c].append(np.full(len(at), x))
                    out["at"].append(block.keys[at])
                    out["negative_id"].append(block.ids[at])
                    out["negative_score"].append(score.astype(np.int64))
            yield {c: pa.array(np.concatenate(x)) if x else [] for c, x in out.items()}

    schema = "key long, anchor_id long, place long, positive_id long, positive_score long, at long, negative_id long, negative_score long"
    found = scan(paired(blocks, count, packed(asking, "a", dim, "near")), hard, schema)
    return best_first(found, negatives, ["key", "place"], "negative_score", "negative_id", "at").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mined(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
