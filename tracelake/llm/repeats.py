"""Removal of repeated strings by doubling the length that is ranked, over chosen positions.

A string is a run of ``length`` symbols of a text (bytes, or words); what is covered by a string that also starts
anywhere else is removed. Sorting a rank for every position at every offset would move the text many times over, so
ranks are kept only for positions that can still matter, in rounds of growing length:

0. Equal texts become one text with its number of rows; all strings of a text of several rows repeat. The texts are
   written once in hash buckets, so that no later round shuffles them: rows are sent to texts, never texts to rows.
1. Positions are chosen by their content: of each window of ``length - gram + 1`` neighbouring
   ``gram``-symbol strings the least hash is an anchor, so two equal ``length``-symbol strings hold the
   same anchor at the same place. Anchors are ranked by their string; unique ones are dropped.
2. An anchor stands for the starts up to ``length - gram`` symbols before it. If the string that joins all of
   them is repeated after the same anchor string, all are repeated and the anchor is past the threshold.
3. The others are split into blocks of ``steps`` starts (32, then 4), of those for which the anchor is the least. Rank pairs
   (anchor, string common to all starts of a block) that are unique are dropped; blocks whose joined string is repeated are done.
4. The remaining starts are ranked by their whole strings, one by one.

A block that is done takes part in the next round once for each different string, as
something that the undecided ones may be equal to, and only where one of those is left. Each
round groups hashes with map-side aggregates (counts, or least and greatest place), so strings found in
many documents cost no pairs. Nothing here is broadcast, so resources grow in proportion at every size.

This departs from plain prefix doubling: lengths grow by anchors and blocks, not by rank pairs at offsets of powers of
two. With a rank for every byte position, one round alone shuffles some 20 bytes for each byte of text.

Defined cases: null text is no bytes; texts shorter than ``length`` have no strings and lose nothing; a
repeated row is another occurrence of its strings; ids may be null or repeat; texts of any
length (below 4 GB) are taken whole; an empty table gives an empty result; other columns are ignored. Strings
are compared by pairs of 64-bit hashes (anchor string, string).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import bucketed, column, scan, staged, texts_of


@dataclass(frozen=True)
class Strings:
    """What counts as a repeated string: its length and unit, the length of anchor strings, and the starts in a block, round by round (each divides the one before)."""

    length: int
    gram: int
    steps: tuple[int, ...] = (32, 4)
    words: bool = False

    def __post_init__(self):
        if self.gram >= self.length:
            raise ValueError("gram is shorter than length")

    def units(self, batch):
        """(first text, texts, start of each text in the symbols of the chunk, prefix hash of the symbols) of each chunk."""
        for first, texts in tx.chunks(texts_of(batch)):
            if self.words:
                w = tx.Words(texts, tx.NOT_SPACE)
                yield first, texts, w.offset, tx.prefix_hash(w.hash)
            else:
                ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                yield first, texts, ends, tx.prefix_hash(np.frombuffer(b"".join(texts), np.uint8))


#: Strings of 400 bytes, and passages of 50 words.
BYTES = Strings(400, 100)
WORDS = Strings(50, 13, (8,), True)
PLACE_BITS = 32


def window_least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the least value of each window, the leftmost of equals by the top 32 bits; first and last window that each is the least of)."""
    n = len(h) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = np.uint64((1 << PLACE_BITS) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(v)] = v
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    place, first, count = np.unique(least & low, return_index=True, return_counts=True)
    return place.astype(np.int64), first, first + count - 1


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n, text) of the different texts of keyed rows, in buckets."""
    return bucketed(docs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("text").alias("text")), "texts", "h1", "h2")


def anchors(texts: DataFrame, s: Strings) -> DataFrame:
    """(h1, h2, a, g, near, far): the anchors of each text, the rank of the string there, and how far before it its own starts begin and end."""

    def work(batches):
        for batch in batches:
            h1, h2 = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            for first, texts, ends, prefix in s.units(batch):
                row, at, rank, near, far = [], [], [], [], []
                for d in range(len(texts)):
                    if ends[d + 1] - ends[d] < s.length:
                        continue
                    i = np.arange(ends[d], ends[d + 1] - s.gram + 1)
                    g = tx.range_hash(prefix, i, i + s.gram)
                    p, one, last = window_least(g, s.length - s.gram + 1)
                    row.append(np.full(len(p), first + d))
                    at.append(p)
                    rank.append(tx.to_signed(g[p]))
                    near.append(p - last)
                    far.append(p - one)
                if row:
                    i = np.concatenate(row)
                    yield {"h1": h1[i], "h2": h2[i], "a": np.concatenate(at), "g": np.concatenate(rank), "near": np.concatenate(near), "far": np.concatenate(far)}

    return scan(texts, work, "h1 long, h2 long, a int, g long, near int, far int")


def per_text(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows gathered for each text (bounded by its length), for one reading of it."""
    return rows.groupBy("h1", "h2").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def with_texts(texts: DataFrame, gathered: DataFrame, how: str = "inner") -> DataFrame:
    """Send gathered rows to the buckets of their texts."""
    return texts.join(gathered.hint("shuffle_hash"), ["h1", "h2"], how)


def ranked(texts: DataFrame, rows: DataFrame, s: Strings, step: int | None, span: int | None = None) -> DataFrame:
    """Ranks of the blocks of each row (g, a, near, far, b): ``whole`` of the string that joins all starts of the block, ``core`` of what they have in common.

    Without ``step`` there is one block of all starts that an anchor can have. Else the blocks of ``step`` starts that an anchor has of its own, with ``span`` only those
    within its block b of so many. Bytes outside of the text are like nothing else; blocks without any start in the text are left out.
    """
    length, reach = s.length, s.length - s.gram

    def work(batches):
        for batch in batches:
            h1, h2 = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            lists = column(batch, "rows")
            for first, texts, ends, prefix in s.units(batch):
                part = lists.slice(first, len(texts))
                inner = part.flatten()
                g, a, near, far, b = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "a", "near", "far", "b"))
                d = np.repeat(np.arange(len(texts)), np.diff(part.offsets.to_numpy()))
                if step is None:
                    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), reach)
                else:
                    each = (span or (reach // step + 1) * step) // step
                    base = b * span if span else np.zeros(len(b), np.int64)
                    lo = np.repeat(base, each) + np.tile(np.arange(each) * step, len(b))
                    g, a, d, near, far = (np.repeat(x, each) for x in (g, a, d, near, far))
                    keep = (lo <= far) & (lo + step > near)
                    g, a, d, lo, near, far = (x[keep] for x in (g, a, d, lo, near, far))
                    hi = np.minimum(lo + step - 1, reach)
                size = np.diff(ends)[d]
                own = tx.mix(h1[first + d].view(np.uint64) + (a - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) ^ h2[first + d].view(np.uint64)

                def rank(start, end):
                    inside = (start >= 0) & (end <= size)
                    h = tx.range_hash(prefix, ends[d] + np.clip(start, 0, size), ends[d] + np.clip(end, 0, size), 7)
                    return np.where(inside, h, own), inside

                whole, _ = rank(a - hi, a - lo + length)
                core, some = rank(a - lo, a - hi + length)  # some: where no start holds the common string there is none
                i = first + d[some]
                out = {"h1": h1[i], "h2": h2[i], "g": g[some], "a": a[some], "near": near[some], "far": far[some], "lo": lo[some], "hi": hi[some], "whole": tx.to_signed(whole[some])}
                yield out if step == 1 else out | {"core": tx.to_signed(core[some])}

    gathered = per_text(rows, "g", "a", "near", "far", "b")
    return scan(with_texts(texts, gathered), work, "h1 long, h2 long, g long, a int, near int, far int, lo int, hi int, whole long" + ("" if step == 1 else ", core long"))


def place():
    """A rank for the place of a block: equal strings at one place only are not repeated."""
    return F.xxhash64("h1", "h2", F.col("a") - F.col("lo"))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys found at two places or more, with the least place."""
    return rows.groupBy(*key).agg(F.min(place()).alias("least"), F.max(place()).alias("most")).where("least <> most").select(*key, "least")


def decided(rows: DataFrame, name: str) -> DataFrame:
    """Rows with ``done`` (their joined string is repeated) and ``one`` (done rows: the least place of their string)."""
    rows = staged(rows, name)
    # Written first, so that the join shuffles both sides by itself and a string of many places can be split.
    out = rows.join(staged(repeated(rows, "g", "whole"), f"{name}-repeated"), ["g", "whole"], "left")
    return staged(out.withColumn("done", F.col("least").isNotNull()).withColumn("one", F.coalesce(F.col("least") == place(), F.lit(False))).drop("least", "whole"), f"{name}-decided")


def repeated_spans(texts: DataFrame, s: Strings) -> DataFrame:
    """(h1, h2, start, end): spans of repeated symbols of texts that occur once each; those of others may be missing."""
    rows = staged(anchors(texts, s), "anchors")
    often = staged(rows.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "anchor-ranks")
    rows = rows.join(often, "g").withColumn("b", F.lit(0))

    one = decided(ranked(texts, rows, s, None), "all-starts")
    open_ = staged(one.where("NOT done").select("g").distinct(), "open-anchors")
    rows = one.where("NOT done OR one").join(open_, "g").withColumn("b", F.lit(0))

    cols = ["h1", "h2", "a", "lo", "hi"]
    done, span = one.where("done").select(cols), None
    for step in s.steps:
        part = decided(ranked(texts, rows, s, step, span), f"blocks-{step}")
        common = part.groupBy("g", "core").agg(F.min(place()).alias("least"), F.max(place()).alias("most"), F.max(~F.col("done")).alias("open")).where("least <> most AND open")
        common = staged(common.select("g", "core"), f"open-{step}")
        rows = part.where("NOT done OR one").join(common, ["g", "core"]).withColumn("b", F.floor(F.col("lo") / step).cast("int"))
        done, span = done.union(part.where("done").select(cols)), step

    last = staged(ranked(texts, rows, s, 1, span), "starts")
    again = staged(repeated(last, "g", "whole").select("g", "whole"), "repeated-starts")
    done = done.union(last.join(again, ["g", "whole"], "left_semi").select(cols))
    return done.select("h1", "h2", (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + s.length).alias("end"))


def covered(texts: DataFrame, s: Strings) -> DataFrame:
    """(h1, h2, size, spans, kept) of each different text: its symbols, flat starts and ends of the maximal repeated runs, and, of bytes, what is left."""
    gathered = repeated_spans(texts, s).groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def work(batches):
        for batch in batches:
            many, lists = column(batch, "n").to_numpy() > 1, column(batch, "spans")
            for first, texts, ends, _ in s.units(batch):
                out = {"size": np.diff(ends), "spans": [], "kept": []}
                for i, (t, size) in enumerate(zip(texts, out["size"].tolist(), strict=True), first):
                    edges = [0, size] if many[i] and size >= s.length else []
                    if not many[i] and lists[i].is_valid:
                        x = lists[i].values
                        cover = np.zeros(size + 2, np.int32)
                        np.add.at(cover, x.field("start").to_numpy(), 1)
                        np.add.at(cover, x.field("end").to_numpy(), -1)
                        inside = np.concatenate(([0], np.cumsum(cover[: size + 1]) > 0)).astype(np.int8)
                        edges = np.flatnonzero(np.diff(inside)).tolist()
                    out["spans"].append(edges)
                    out["kept"].append(None if s.words else b"".join(t[a:b] for a, b in zip([0, *edges[1::2]], [*edges[0::2], size], strict=True)))
                yield {c: column(batch, c).slice(first, len(texts)) for c in ("h1", "h2")} | out

    return scan(with_texts(texts, gathered, "left"), work, "h1 long, h2 long, size long, spans array<long>, kept binary")


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, the text (null as empty) and its two hashes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})


def of_rows(docs: DataFrame, by_text: DataFrame, name: str) -> DataFrame:
    """What was found for each text, for each row that has it; written first, so that the join can split a text of very many rows."""
    return docs.select("doc_id", "h1", "h2").join(staged(by_text, name), ["h1", "h2"]).drop("h1", "h2")


def remove_repeats(docs: DataFrame, length: int = BYTES.length, gram: int = BYTES.gram) -> DataFrame:
    """doc_id, n_bytes, spans (flat starts and ends of the maximal removed runs), kept (remaining bytes)."""
    docs = text_keys(docs)
    found = covered(distinct_texts(docs), Strings(length, gram))
    return of_rows(docs, found.withColumnRenamed("size", "n_bytes"), "kept").select("doc_id", "n_bytes", "spans", "kept")


def repeated_words(docs: DataFrame, length: int = WORDS.length, gram: int = WORDS.gram) -> DataFrame:
    """doc_id, n_words, spans (flat first words and ends of the maximal runs covered by a passage of ``length`` words that also starts elsewhere)."""
    docs = text_keys(docs)
    found = covered(distinct_texts(docs), Strings(length, gram, WORDS.steps, True))
    return of_rows(docs, found.withColumnRenamed("size", "n_words"), "words").select("doc_id", "n_words", "spans")


def runs(spans: str = "spans"):
    """(symbols covered, number of runs) of flat starts and ends."""
    x = F.col(spans)
    total = F.aggregate(F.transform(x, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v)), F.lit(0).cast("long"), lambda a, v: a + v)
    return total, (F.size(x) / 2).cast("long")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of ``remove_repeats`` at 400 bytes, and n_repeat_words, the words covered by passages of 50 words that also start elsewhere."""
    docs = text_keys(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = distinct_texts(docs)
    removed, n_spans = runs()
    found = covered(texts, BYTES).select("h1", "h2", F.col("size").alias("n_bytes"), removed.alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    words = covered(texts, WORDS).select("h1", "h2", removed.alias("n_repeat_words"))
    return of_rows(docs, staged(found, "digests").join(staged(words, "words"), ["h1", "h2"]), "by-text")
