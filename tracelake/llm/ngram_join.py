"""Exact Jaccard join of documents in the metric space of their shingle sets.

With d = 1 - Jaccard, two documents link when d <= 1 - threshold =: e.

1. Equal sets are one class; only its smallest doc_id goes on.
2. A set must share one of its ``n - ceil(t n) + 1`` first shingles with every set
   that it links to, in any order that all sets share. The order here is by a count
   sketch over all documents, then by hash, so shingles of common passages come last.
3. Of the documents that hold a shingle among those, the smallest doc_id is a pivot; the
   region of a pivot is the pivot with all documents that name it. Every linked pair
   thus lies in one region. Regions are stars, so their total size is linear.
4. The exact distance of each member from its pivot is computed, unless set sizes and the
   count of necessary shingles in common rule a link out. Members with d <= e are linked to the pivot: two such members are in one component and need no
   comparison. Every other pair (x, y) of a region can link only within the triangle
   window |d(x) - d(y)| <= e, so core members are replicated to the remaining join only
   if they lie within e of an outer member.
5. Those remaining members are joined in cells of alike set sizes and in blocks of bounded
   size: a large cell is split into blocks and each pair of blocks is one task group. Pairs
   with enough necessary shingles in common are verified on the whole sets, unless links to
   pivots connect them already.
6. Components are found over the links of class representatives and given to all copies.

Defined cases: null or empty text, or text without words, has an empty set, n_shingles
0 and links with nothing; fewer words than ``n`` make one shingle; repeated rows give
repeated result rows, and a doc_id that repeats stands for all of its rows; a null
doc_id gives a null component_id; an empty table gives an empty result; other columns
are ignored. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import column, components, grouped, scan, sized, staged, texts_of

SKETCH_BITS = 20
SKETCH_BLOCKS = 64
#: Members of a block of the remaining join; a task group holds two blocks.
BLOCK = 256
#: Members that are compared with their pivot in one task group.
MEMBERS = 512


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    w = tx.Words(texts, tx.NOT_SPACE)
    grams = tx.gram_hash(w.hash, n)
    out = []
    for d in range(len(texts)):
        lo, hi = w.offset[d], w.offset[d + 1]
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        else:
            out.append(tx.gram_hash(w.hash[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out


def count_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold a shingle with each hash prefix; of fixed size, summed in two steps."""
    width = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, texts in tx.chunks(texts_of(batch)):
                sets = shingle_sets(texts, n)
                if sets:
                    total += np.bincount(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), minlength=len(total)).astype(np.uint32)
        if total.any():
            salt = int(total.sum()) % 64
            yield {"b": np.arange(SKETCH_BLOCKS), "salt": np.full(SKETCH_BLOCKS, salt), "counts": [x.tobytes() for x in total.reshape(-1, width)]}

    def add(key, table):
        import pyarrow as pa

        total = np.zeros(width, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = grouped(scan(docs.select("text"), count, "b long, salt long, counts binary").groupBy("b", "salt"), add, "b long, counts binary")
    out = np.zeros((SKETCH_BLOCKS, width), np.uint32)
    for b, counts in grouped(parts.groupBy("b"), add, "b long, counts binary").collect():
        out[b] = np.frombuffer(counts, np.uint32)
    return out.ravel()


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the necessary shingles."""
    held = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, n))

    def sign(batches):
        sketch = held.value
        for batch in batches:
            ids = column(batch, "doc_id")
            for first, texts in tx.chunks(texts_of(batch)):
                sets = shingle_sets(texts, n)
                size = [len(s) for s in sets]
                one, two, need = [], [], []
                for s in sets:
                    if not len(s):
                        one.append(None), two.append(None), need.append([])
                        continue
                    k = len(s) - -(-len(s) * percent // 100) + 1
                    order = np.argsort(sketch[s >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:k]
                    need.append(tx.to_signed(s[order]))
                    with np.errstate(over="ignore"):
                        one.append(int(tx.to_signed(tx.mix(s + np.uint64(1)).sum(keepdims=True))[0]))
                        two.append(int(tx.to_signed(tx.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True))[0]))
                yield {"doc_id": ids.slice(first, len(texts)), "n_shingles": size, "h1": one, "h2": two, "need": need}

    out = staged(scan(docs.select("doc_id", "text"), sign, "doc_id long, n_shingles long, h1 long, h2 long, need array<long>"), "signatures")
    held.unpersist()
    return out


def with_overlap(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Pairs (pivot, doc_id) with the size of the intersection (both) and of the union (either) of their sets.

    The sets are made where the texts are read and go to their pivots once: members of a pivot are dealt over cells of about ``MEMBERS``, and each cell gets the
    pivot's set too.
    """
    pairs = pairs.select("pivot", "doc_id").distinct()
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("k"))
    members = pairs.join(sized(staged(sizes, "pivots"), 40), "pivot").select("doc_id", "pivot", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int").alias("part"))
    pivots = sizes.select(F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    goals = staged(members.union(pivots).groupBy("doc_id").agg(F.collect_list(F.struct("pivot", "part")).alias("goals")), "goals")

    def work(batches):
        for batch in batches:
            ids, lists = column(batch, "doc_id").to_pylist(), column(batch, "goals")
            for first, texts in tx.chunks(texts_of(batch)):
                out = {"pivot": [], "part": [], "doc_id": [], "shingles": []}
                for i, s in enumerate(shingle_sets(texts, n), first):
                    data = s.tobytes()
                    for goal in lists[i].as_py():
                        for name, value in zip(out, (goal["pivot"], goal["part"], ids[i], data), strict=True):
                            out[name].append(value)
                yield out

    sent = scan(docs.select("doc_id", "text").join(sized(goals, 64, items="goals", item_bytes=24), "doc_id"), work, "pivot long, part int, doc_id long, shingles binary")

    def overlap(key, table):
        import pyarrow as pa

        pivot = key[0].as_py()
        ids = table.column("doc_id").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        out = {"doc_id": [], "both": [], "either": []}
        for a in (s for i, s in zip(ids, sets, strict=True) if i == pivot):
            for i, b in zip(ids, sets, strict=True):
                if i != pivot:
                    small, large = (a, b) if len(a) < len(b) else (b, a)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    k = int((large[at] == small).sum())
                    for name, value in zip(out, (i, k, len(a) + len(b) - k), strict=True):
                        out[name].append(value)
        return pa.table({"pivot": pa.array([pivot] * len(out["both"]), pa.int64()), **{c: pa.array(v, pa.int64()) for c, v in out.items()}})

    return grouped(sent.groupBy("pivot", "part"), overlap, "pivot long, doc_id long, both long, either long")


def joined_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Candidates (pivot, doc_id) among the members (pivot, cell, doc_id, n, label, blocks, need) of each cell with different labels, block pair by block pair."""
    placed = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("pivot", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "n", "label", "need")

    def pairs(key, table):
        import pyarrow as pa

        ids, n, label = (np.array(table.column(c).to_pylist()) for c in ("doc_id", "n", "label"))
        need = table.column("need").combine_chunks()
        row = np.repeat(np.arange(len(ids)), np.diff(need.offsets.to_numpy()))
        _, at, count = np.unique(need.flatten().to_numpy(), return_inverse=True, return_counts=True)
        more = count[at] > 1
        row, at = row[more], np.unique(at[more], return_inverse=True)[1]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            a, b = np.searchsorted(at, (lo, lo + 4096))
            m = np.zeros((len(ids), 4096), np.float32)
            m[row[a:b], at[a:b] - lo] = 1
            both += m @ m.T
        rest = -(-n * percent // 100) - 1
        can = (both > 0) & ((both + np.maximum(rest[:, None], rest[None, :])) * (100 + percent) >= percent * (n[:, None] + n[None, :]))
        x, y = np.nonzero(can & (label[:, None] != label[None, :]))
        keep = ids[x] < ids[y]
        return pa.table({"pivot": pa.array(ids[x[keep]], pa.int64()), "doc_id": pa.array(ids[y[keep]], pa.int64())})

    return grouped(placed.groupBy("pivot", "cell", "i", "j"), pairs, "pivot long, doc_id long")


def shared_need(signed: DataFrame) -> DataFrame:
    """(doc_id, n, s) of the class representatives: their necessary shingles that another one has too."""
    whole = signed.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
    reps = staged(whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "reps")
    need = whole.join(sized(reps, 16), "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), F.explode("need").alias("s"))
    often = staged(need.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s"), "shared-shingles")
    return need.join(sized(often, 16), "s", "left_semi").select("doc_id", "n", "s")


def regions(held: DataFrame) -> DataFrame:
    """(pivot, doc_id, m, n): the members of each region but its pivot, with the set sizes of pivot and member."""
    first = held.groupBy("s").agg(F.min(F.struct("doc_id", "n")).alias("p"))
    return held.join(first, "s").where("p.doc_id <> doc_id").select(F.col("p.doc_id").alias("pivot"), "doc_id", F.col("p.n").alias("m"), "n").distinct()


def enough(percent: int, both: str, m: str, n: str) -> str:
    """Whether sets of m and n shingles that have ``both`` necessary shingles in common can still link.

    One of the two sets shows all its necessary shingles up to where the other's end, so no
    more can be in common beyond those than it has others.
    """
    rest = f"greatest(ceil({m} * {percent} / 100), ceil({n} * {percent} / 100)) - 1"
    return f"({both} + {rest}) * (100 + {percent}) >= {percent} * ({m} + {n})"


def cells(rest: DataFrame, percent: int) -> DataFrame:
    """The members of each region that have another member to be compared with: (pivot, cell, doc_id, n, label, blocks).

    Linked sets differ in size by a factor of at most 100 / percent. With sizes on a
    logarithmic scale of that step, a member goes to the cell of its size and to the next.
    """
    step = F.log(F.lit(100.0 / percent)) if percent < 100 else F.lit(1.0)
    level = F.floor(F.log("n") / step + 1e-9)
    placed = rest.withColumn("level", level).withColumn("cell", F.explode(F.array(F.col("level"), F.col("level") + 1))).withColumn("own", F.col("level") == F.col("cell"))
    sizes = placed.groupBy("pivot", "cell").agg(
        F.count("*").alias("k"), F.max("own").alias("own"), (F.min("label") != F.max("label")).alias("some"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks")
    )
    sizes = sizes.where("k > 1 AND own AND some").select("pivot", "cell", "blocks")
    return placed.join(sized(staged(sizes, "cells"), 40), ["pivot", "cell"]).select("pivot", "cell", "doc_id", "n", "label", "blocks")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links of at least ``percent`` reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = signatures(docs, n, percent)
    held = staged(shared_need(signed), "shared-need")
    lists = staged(held.groupBy("doc_id", "n").agg(F.collect_list("s").alias("need")), "lists")
    near = F.expr(f"100 * both >= {percent} * either")

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        return staged(with_overlap(docs, staged(pairs, f"{name}-pairs"), n), f"{name}-measured")

    region = staged(regions(held), "regions")
    mine, theirs = lists.select("doc_id", F.col("need").alias("a")), lists.select(F.col("doc_id").alias("pivot"), F.col("need").alias("b"))
    alike = region.where(f"100 * n >= {percent} * m AND 100 * m >= {percent} * n").join(mine, "doc_id").join(theirs, "pivot")
    star = measured(alike.withColumn("c", F.size(F.array_intersect("a", "b"))).where(enough(percent, "c", "m", "n")).select("pivot", "doc_id").distinct(), "star")

    # A member whose distance was not needed is an outer one, at a distance of at least 1 - the ratio of sizes.
    e, slack = 1 - percent / 100, 1e-9
    far = star.groupBy("pivot", "doc_id").agg(F.min(1 - F.col("both") / F.col("either")).alias("far"), (~F.max(near)).alias("outer"))
    members = region.join(far, ["pivot", "doc_id"], "left").select(
        "pivot", "doc_id", "n", F.coalesce("outer", F.lit(True)).alias("outer"),
        F.coalesce("far", 1 - F.least("n", "m") / F.greatest("n", "m")).alias("far"),
    )
    members = staged(members, "members")
    outer = members.where("outer").groupBy("pivot").agg(F.min("far").alias("least"))
    rest = members.join(sized(staged(outer, "outer"), 32), "pivot").where(F.col("outer") | (F.col("far") + e + slack >= F.col("least")))
    # What the links to pivots connect already needs no comparison.
    one = components(star.where(near).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    labels = one.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    rest = rest.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    rest = cells(staged(rest, "rest"), percent).join(lists, ["doc_id", "n"])
    more = measured(joined_blocks(rest, percent).distinct().join(star, ["pivot", "doc_id"], "left_anti"), "rest").where(near)
    ends = more.join(labels.withColumnRenamed("label", "lb"), "doc_id", "left").join(labels.select(F.col("doc_id").alias("pivot"), F.col("label").alias("la")), "pivot", "left")
    two = components(ends.select(F.coalesce("la", "pivot").alias("a"), F.coalesce("lb", "doc_id").alias("b")).distinct())
    nodes = one.union(two.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("label"))
    found = nodes.join(two.select(F.col("node").alias("label"), "component"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))

    classes = signed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    labelled = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    # Written first, so that the join shuffles both sides by itself and a class of many copies can be split.
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(staged(labelled, "labelled"), ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for."""
    gone = jaccard_components(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(sized(staged(gone, "gone"), 16), "doc_id", "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))



ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, s, s + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN size sa ON sa.doc_id = a.doc_id JOIN size sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n HAVING 100 * count(*) >= 75 * (sa.n + sb.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(size.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.m, w.doc_id)) AS component_id
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
