"""From raw documents to token ids, in five stages that each work on all that the one before kept.

language ID -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> SentencePiece encoding
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, language_id, line_dedup, merge_dropout, ngram_join
from tracelake.llm.common import keyed_rows, sized, staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; lang is the language found, the others go."""
    return language_id.keep_identified(docs)


#: Shorter lines stand for too little to be held against a line that only resembles them; they go where they are equal.
NEAR_CHARS = 20


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, equal or (from ``NEAR_CHARS`` characters on) one edit away; those of which only blanks are left go.

    Null text stays as it is; a row that has lost nothing stays, blank or not; rows are ordered by doc_id, null first.
    """
    out = line_dedup.dedup_lines(docs, near_chars=NEAR_CHARS)
    out = out.where((F.col("n_removed") == 0) | (F.regexp_replace("text", r"\s+", "") != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of documents of a Jaccard similarity of 0.75 or more."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    columns = docs.columns
    docs, row = keyed_rows(docs, "rows")
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row=row)
    hit = staged(found.where("contaminated").select(row), "contaminated")
    return docs.join(sized(hit, 16), row, "left_anti").select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and lossless of each document."""
    return merge_dropout.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_alike),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: The fitted text model of the first stage and the merges of the last are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
