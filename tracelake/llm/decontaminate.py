"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window). The shingles of a window (``SHINGLE`` words, or all of a shorter window) are ordered by rarity, counted over all
documents; as a window must be contained whole, its necessary prefix is the one
rarest shingle.

1. The shingles of all windows pass a bit filter of fixed size to the documents; what passes is counted and joined to
   the shingles, and each window takes its rarest one (ties by hash) as its key.
2. Documents are read a second time: each occurrence of what may be a key goes out with the words around it.
   Occurrences join the keys, each with the few different places that its windows have it at; position
   bounds discard windows that would start before or end after the document.
3. The words left are verified whole: 128 bits of the word sequence against those of the windows of that length.

Items, keys and windows are tables that Spark joins; nothing of the benchmark goes through the driver but the bits, and the documents are
read twice whatever its size. A full filter lets more occurrences through, never fewer.

Defined cases: null or empty text has no words (n_words 0, not contaminated); a
null item text has no windows; repeated item rows count once per item_id; a
repeated document row gives a repeated result row; null ids are kept as they are
(a null item_id takes no part); an empty table on either side gives results
without hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import ROW, column, scan, staged, texts_of

#: Words in a shingle, or all of a shorter window.
SHINGLE = 3
#: The filter has 2 to this power bits.
FILTER_BITS = 22
#: Candidates of a document that go out at once.
SLICE = 1 << 14


def sequence_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each words[start:start + size]."""
    one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for step in range(int(size.max()) if len(size) else 0):
        inside = size > step
        w = words[np.minimum(start + step, len(words) - 1)]
        one = np.where(inside, tx.mix(one * np.uint64(0x9E3779B97F4A7C15) + w), one)
        two = np.where(inside, tx.mix(two * np.uint64(0xC2B2AE3D27D4EB4F) + (w ^ np.uint64(0x165667B19E3779F9))), two)
    return tx.to_signed(one), tx.to_signed(two)


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, size, h1, h2, grams): the windows of each item, their hashes and those of their shingles in order."""

    def work(batches):
        for batch in batches:
            ids = column(batch, "item_id").to_numpy(zero_copy_only=False)
            for first, texts in tx.chunks(texts_of(batch)):
                w = tx.Words(texts, tx.ALNUM)
                n = np.diff(w.offset)
                size = np.minimum(n, window)
                each = np.where(n > 0, n - size + 1, 0)
                d = np.repeat(np.arange(len(texts)), each)
                if not len(d):
                    continue
                start = w.offset[:-1][d] + np.arange(len(d)) - np.repeat(np.cumsum(each) - each, each)
                one, two = sequence_hashes(w.hash, start, size[d])
                grams = {k: tx.to_signed(tx.gram_hash(w.hash, k)) for k in np.unique(np.minimum(size[d], SHINGLE))}
                lists = [grams[min(z, SHINGLE)][s : s + z - min(z, SHINGLE) + 1] for s, z in zip(start, size[d], strict=True)]
                yield {"item_id": ids[first + d], "size": size[d], "h1": one, "h2": two, "grams": lists}

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return scan(rows, work, "item_id long, size int, h1 long, h2 long, grams array<long>")


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit for each prefix of a column of hashes, gathered in blocks of 2**16 bits."""
    low = min(bits, 16)
    prefix = F.shiftrightunsigned(F.col("g"), 64 - bits)
    blocks = hashes.select(F.shiftright(prefix, low).alias("block"), prefix.bitwiseAND((1 << low) - 1).cast("int").alias("bit")).distinct()

    def pack(batches):
        for batch in batches:
            out = []
            for x in column(batch, "set"):
                held = np.zeros(1 << low, np.uint8)
                held[x.values.to_numpy()] = 1
                out.append(np.packbits(held).tobytes())
            yield {"block": column(batch, "block"), "bits": out}

    found = scan(blocks.groupBy("block").agg(F.collect_list("bit").alias("set")), pack, "block long, bits binary").collect()
    out = np.zeros(((1 << bits) >> low, 1 << low), bool)
    for block, data in found:
        out[block] = np.unpackbits(np.frombuffer(data, np.uint8), count=1 << low)
    return np.packbits(out.ravel())


def passes(bits: np.ndarray, width: int, h: np.ndarray) -> np.ndarray:
    """The places of the hashes that pass a filter."""
    p = (h >> np.uint64(64 - width)).astype(np.int64)
    return np.flatnonzero((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1)


def rarity(docs: DataFrame, grams: DataFrame, kinds: list[int], width: int) -> DataFrame:
    """(g, n): how often each shingle of ``grams`` occurs in all documents, for those that do."""
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(grams, width))

    def count(batches):
        bits = held.value
        for batch in batches:
            for _, texts in tx.chunks(texts_of(batch)):
                w = tx.Words(texts, tx.ALNUM)
                for k in kinds:
                    g = tx.gram_hash(w.hash, k)
                    at = passes(bits, width, g)
                    key, n = np.unique(g[at[w.doc[at] == w.doc[at + k - 1]]], return_counts=True)
                    if len(key):
                        yield {"g": tx.to_signed(key), "n": n}

    return scan(docs.select("text"), count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).join(grams, "g", "left_semi")


def keyed_windows(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, shift, size, h1, h2): each different window with its rarest shingle and the place of that."""
    each = wins.groupBy("h1", "h2", "size").agg(F.first("grams").alias("grams")).select("h1", "h2", "size", F.posexplode("grams").alias("shift", "g"))
    rare = each.join(counts, "g", "left").groupBy("h1", "h2", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g", "shift")).alias("m"))
    return rare.select(F.col("m.g").alias("key"), F.col("m.shift").alias("shift"), "size", "h1", "h2")


def candidates(docs: DataFrame, row: str, keys: DataFrame, kinds: list[int], window: int, width: int) -> DataFrame:
    """A row for each document (n_words not null), and one for each occurrence of what may be a key: its place and the words around it."""
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(keys, width))

    def find(batches):
        bits = held.value
        for batch in batches:
            ids, rows = column(batch, "doc_id"), column(batch, row)
            for first, texts in tx.chunks(texts_of(batch)):
                w = tx.Words(texts, tx.ALNUM)
                n = len(texts)
                none = [None] * n
                yield {"row": rows.slice(first, n), "doc_id": ids.slice(first, n), "n_words": np.diff(w.offset), "key": none, "at": none, "before": none, "words": none}
                for k in kinds:
                    g = tx.gram_hash(w.hash, k)
                    at = passes(bits, width, g)
                    at = at[w.doc[at] == w.doc[at + k - 1]]
                    for lo in range(0, len(at), SLICE):
                        p = at[lo : lo + SLICE]
                        d = w.doc[p]
                        a, b = np.maximum(p - window + 1, w.offset[d]), np.minimum(p + window, w.offset[d + 1])
                        yield {
                            "row": rows.take(first + d), "doc_id": [None] * len(p), "n_words": [None] * len(p), "key": tx.to_signed(g[p]), "at": p - w.offset[d], "before": p - a,
                            "words": [w.hash[x:y].tobytes() for x, y in zip(a, b, strict=True)],
                        }

    return scan(docs, find, "row long, doc_id long, n_words long, key long, at long, before int, words binary")


def verified(found: DataFrame, index: DataFrame) -> DataFrame:
    """(row, start, size, h1, h2) of the occurrences of windows among candidates."""

    def work(batches):
        for batch in batches:
            words = [np.frombuffer(x.as_buffer(), np.uint64) for x in column(batch, "words")]
            count = np.array([len(x) for x in words], np.int64)
            base = np.cumsum(count) - count
            before, shift, size, at = (column(batch, c).to_numpy().astype(np.int64) for c in ("before", "shift", "size", "at"))
            ok = np.flatnonzero((shift <= before) & (before - shift + size <= count))
            one, two = sequence_hashes(np.concatenate(words) if words else np.zeros(1, np.uint64), (base + before - shift)[ok], size[ok])
            yield {"row": column(batch, "row").take(ok), "start": (at - shift)[ok], "size": size[ok], "h1": one, "h2": two}

    placed = found.where("key IS NOT NULL").join(staged(index.select("key", "shift", "size").distinct(), "places"), "key")
    occurs = scan(placed.select("row", "at", "before", "words", "shift", "size"), work, "row long, start long, size int, h1 long, h2 long")
    return occurs.join(index.select("h1", "h2", "size"), ["h1", "h2", "size"], "left_semi").distinct()


def united(occurs: DataFrame) -> DataFrame:
    """(row, n_hit, runs): the hit words of each document as flat starts and ends of its maximal runs."""

    def work(batches):
        for batch in batches:
            hits, runs = [], []
            for x in column(batch, "spans"):
                a = x.values.field("start").to_numpy()
                b = a + x.values.field("size").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                edges = np.stack((a[new], b[np.append(new[1:] - 1, len(a) - 1)]), 1)
                hits.append(int((edges[:, 1] - edges[:, 0]).sum()))
                runs.append(edges.ravel())
            yield {"row": column(batch, "row"), "n_hit": hits, "runs": runs}

    gathered = occurs.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    return scan(gathered, work, "row long, n_hit long, runs array<long>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, row: str | None = None) -> DataFrame:
    """Each document with its hits: doc_id, n_words, n_hit, items (item ids, sorted as strings), runs (first word, end) of hit words, contaminated.

    ``row`` names a key of the rows of the documents, if there is one; it is handed through.
    """
    docs = docs.select("doc_id", "text", (F.col(row) if row else F.monotonically_increasing_id()).alias(ROW))
    wins = staged(windows(benchmark, window), "windows")
    kinds = sorted({min(r[0], SHINGLE) for r in wins.select("size").distinct().collect()})
    grams = staged(wins.select(F.explode("grams").alias("g")).distinct(), "shingles")
    index = staged(keyed_windows(wins, staged(rarity(docs, grams, kinds, FILTER_BITS), "rarity")), "keys")
    found = staged(candidates(docs, ROW, index.select(F.col("key").alias("g")), kinds, window, FILTER_BITS), "candidates")
    occurs = staged(verified(found, index), "occurrences")
    met = occurs.select("row", "h1", "h2", "size").distinct().join(wins.select("h1", "h2", "size", "item_id").distinct(), ["h1", "h2", "size"])
    items = met.groupBy("row").agg(F.collect_set("item_id").alias("items"))
    by_name = F.transform(F.array_sort(F.transform("items", lambda x: F.struct(x.cast("string").alias("name"), x.alias("id")))), lambda x: x["id"])
    hits = united(occurs).join(items, "row").select("row", "n_hit", by_name.alias("items"), "runs")
    out = found.where("n_words IS NOT NULL").select("row", "doc_id", "n_words").join(hits, "row", "left")
    none = F.array().cast("array<long>")
    out = out.select(
        *([F.col("row").alias(row)] if row else []), "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("runs", none).alias("runs"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (
  SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw, sizes WHERE len(w) >= size)),
occ AS (SELECT doc_id, item_id, s, d.size FROM dwin d JOIN win USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
