"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is nothing but token ids of fixed width (little endian), each document ended
by one end-of-document id. The files are cut into blocks of equal size without looking
inside. Each block is searched for the separator with one vector comparison; all but the
first separator of a block have their predecessor in the block. What the first one needs,
the last separator of all earlier blocks, comes from a prefix scan over one summary row
per block, in two levels (runs of ``RUN`` blocks, then the runs of a file), so no window
holds more than ``RUN`` rows or the runs of one file.

``write_token_files`` makes such files from documents with Spark's own text writer: a row
is the bytes of its ids, and the line separator is the end-of-document id. It can end each
document with ``TRAILER`` marker values above all token ids that spell its doc_id, as a
flat file has no other place for it; a block is read with a halo of so many ids to its left.

Defined cases: null or empty text is a document of no tokens; a null doc_id is kept as null;
repeated rows are repeated documents; ids after the last separator of a file are a document
that is not ended (``ended`` false); empty files and empty tables give no documents; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops as tx
from .common import column, scan, stage_path, staged

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Ids of 16 bits, of which the tokenizer uses those under 32000; </s> ends a document.
WIDTH, END = 2, 2
#: 13 bits of doc_id in each of five markers from 0x8000; the 65th bit says that it is null.
TRAILER, MARK = 5, 0x8000
BLOCK_TOKENS = 1 << 21
RUN = 1024


def marker(doc_id: int | None) -> np.ndarray:
    bits = (1 << 64) if doc_id is None else doc_id & ((1 << 64) - 1)
    return np.array([MARK | (bits >> (13 * k)) & 0x1FFF for k in range(TRAILER)], "<u2")


def marked(ids: np.ndarray) -> list[int | None]:
    """The doc_ids that rows of five markers spell."""
    out = []
    for row in ids.astype(np.int64) & 0x1FFF:
        bits = sum(int(x) << (13 * k) for k, x in enumerate(row))
        out.append(None if bits >> 64 else (bits - (1 << 64) if bits >> 63 else bits))
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """One flat file for each partition of the documents."""

    def work(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for first, texts in tx.chunks(column(batch, "text").to_pylist()):
                tokens = model.encode([t.decode("utf-8", "surrogatepass") for t in texts], num_threads=1)
                yield {"b": [np.array(t, "<u2").tobytes() + marker(d).tobytes() for t, d in zip(tokens, ids[first : first + len(texts)], strict=True)]}

    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "b binary")
    end = np.array([END], "<u2").tobytes().decode()
    rows.select(F.col("b").cast("string")).write.option("lineSep", end).option("compression", "none").text(path)


def open_uri(path: str):
    """A file of any store that Arrow knows (local, HDFS, S3, ...), for reading at an offset."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(name)


def separators(spark: SparkSession, path: str, width: int, end: int, trailer: int, block_tokens: int) -> DataFrame:
    """One row for each block: path, block, at (places of its separators, counted in ids from the start of the file), markers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").where("length > 0")
    blocks = files.select("path", F.floor(F.col("length") / width).alias("n")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_tokens)))
    )
    blocks = blocks.repartition("path", "block")

    def work(batches):
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            for name, n, block in zip(*(column(batch, c).to_pylist() for c in ("path", "n", "block")), strict=True):
                start, stop = block * block_tokens, min(n, (block + 1) * block_tokens)
                halo = min(trailer, start)
                with open_uri(name) as f:
                    f.seek((start - halo) * width)
                    ids = np.frombuffer(f.read((stop - start + halo) * width), kind)
                at = np.flatnonzero(ids[halo:] == end)
                ended = marked(ids[at[:, None] + halo - trailer + np.arange(trailer)]) if trailer else [None] * len(at)
                yield {"path": [name], "block": [block], "n": [n], "at": [at + start], "doc_ids": [ended]}

    return scan(blocks, work, "path string, block long, n long, at array<long>, doc_ids array<long>")


def count_tokens(spark: SparkSession, path: str, width: int = WIDTH, end: int = END, trailer: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Each document of the files below ``path``: path, start (first id), n_tokens, ended, and doc_id if the files carry it."""
    found = staged(separators(spark, path, width, end, trailer, block_tokens), "separators")
    last = found.select("path", "block", "n", F.floor(F.col("block") / RUN).alias("run"), F.array_max("at").alias("last"))
    before = lambda *keys: Window.partitionBy("path", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = last.groupBy("path", "run").agg(F.max("last").alias("run_last")).withColumn("run_carry", F.max("run_last").over(before("run")))
    carry = last.withColumn("carry", F.max("last").over(before("run", "block"))).join(runs, ["path", "run"])
    carry = carry.select("path", "block", F.coalesce("carry", "run_carry", F.lit(-1)).alias("carry"))
    each = found.join(carry, ["path", "block"]).select("path", "carry", "at", F.posexplode("at").alias("i", "here"), "doc_ids")
    each = each.withColumn("start", F.when(F.col("i") == 0, F.col("carry")).otherwise(F.col("at")[F.col("i") - 1]) + 1)
    docs = each.select("path", "start", (F.col("here") - F.col("start") - trailer).alias("n_tokens"), F.lit(True).alias("ended"), F.col("doc_ids")[F.col("i")].alias("doc_id"))
    tails = last.groupBy("path").agg(F.max("n").alias("n"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start")).where("n > start")
    return docs.union(tails.select("path", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False), F.lit(None).cast("long")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return count_tokens(spark, path, trailer=TRAILER).select("doc_id", "n_tokens")
