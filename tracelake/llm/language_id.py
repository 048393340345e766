"""Language identification by fusing independent pieces of evidence as a Bayesian posterior.

log P(lang | row) = weight * log P(text | lang) + log P(declared | lang) + log prior(lang | host) + constant

* Text: naive Bayes over hashed byte trigrams of the whole lower-cased text, fitted on at most
  ``fit_rows`` labelled rows (those with the smallest hashed ids). ``weight`` tempers it, as
  neighbouring trigrams overlap.
* Declared markup language and address suffix and host: expected counts under the text posterior, by
  grouped aggregation over all rows. P(declared | lang) is smoothed towards the share of the
  declared value. The prior is smoothed hierarchically: all rows -> address suffix -> host, each level
  with ``strength`` rows of its parent. A row does not count in its own prior or likelihood.

A row is accepted if it has letters and its best posterior is at least ``least``.

Defined cases: null or empty text, or text without letters, has text evidence of 0 for every
language, takes its language from the rest and is never accepted; a null declared language gives no
evidence, a null suffix or host falls back to the level above; ties go to the alphabetically
smallest language; repeated rows are rows of their own; without any labelled row the language is
null and nothing is accepted; an empty table gives an empty result; other columns are kept
by ``identify`` under the key that it is given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import column, free_name, grouped, keyed_rows, scan, sized, staged, texts_of

FIT_ROWS = 4000
BUCKETS = 1 << 16
WEIGHT = 0.3
STRENGTH = 20.0
LEAST = 0.35

_LETTER = tx._mask((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_FOLD = np.where(_LETTER, tx._LOWER, 0x20).astype(np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram that holds a letter, its document, letters of each document) of a chunk."""
    data = b"  ".join(texts) + b"  "
    raw = np.frombuffer(data, np.uint8)
    buf = _FOLD[raw]
    ends = np.cumsum([len(t) + 2 for t in texts])
    code = (buf[:-2].astype(np.uint32) << 16) | (buf[1:-1].astype(np.uint32) << 8) | buf[2:]
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([0], ends))))
    letters = np.bincount(doc, weights=buf != 0x20, minlength=len(texts)).astype(np.int64)
    keep = np.flatnonzero((code != 0x202020) & (doc[:-2] == doc[2:]))
    bucket = (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return bucket, doc[keep], letters


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32) if len(languages) else np.zeros((0, BUCKETS), np.float32)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each text under each language, letters of each text)."""
        bucket, doc, letters = trigrams(texts)
        out = np.stack([np.bincount(doc, weights=row[bucket], minlength=len(texts)) for row in self.log], 1) if len(self.log) else np.zeros((len(texts), 0))
        return out, letters


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> TextModel:
    """The text model from (id, text, lang): at most ``fit_rows`` rows with the smallest hashed ids."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").select("id", "lang", "text")
    chosen = staged(rows.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(fit_rows).select("id").distinct(), "fit-rows")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = column(batch, "lang").to_pylist()
            for first, texts in tx.chunks(texts_of(batch)):
                bucket, doc, _ = trigrams(texts)
                which = np.array([lang[first + i] for i in range(len(texts))], object)[doc] if len(doc) else np.zeros(0, object)
                for x in set(lang[first : first + len(texts)]):
                    total.setdefault(x, np.zeros(BUCKETS, np.int64))
                    total[x] += np.bincount(bucket[which == x], minlength=BUCKETS)
        for x, c in total.items():
            yield {"lang": [x], "counts": [c.tobytes()]}

    def add(key, table):
        c = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([c.tobytes()], pa.binary())})

    parts = scan(rows.join(F.broadcast(chosen), "id", "left_semi"), count, "lang string, counts binary")  # at most fit_rows ids
    found = sorted((r[0], np.frombuffer(r[1], np.int64)) for r in grouped(parts.groupBy("lang"), add, "lang string, counts binary").collect())
    return TextModel([x for x, _ in found], np.array([c for _, c in found], np.float64).reshape(-1, BUCKETS))


def text_evidence(rows: DataFrame, key: list[str], model: TextModel, weight: float) -> DataFrame:
    """The key, declared, suffix and host of each row with its letters, tempered log likelihoods and flat-prior posterior."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)

    def work(batches):
        m = held.value
        for batch in batches:
            for first, texts in tx.chunks(texts_of(batch)):
                ll, letters = m.score(texts)
                ll = weight * (ll - ll.max(1, keepdims=True)) if ll.shape[1] else ll
                p = np.exp(ll)
                p = p / p.sum(1, keepdims=True) if ll.shape[1] else p
                yield {c: column(batch, c).slice(first, len(texts)) for c in [*key, "declared", "suffix", "host"]} | {"letters": letters, "ll": list(ll), "p": list(p)}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", declared string, suffix string, host string, letters long, ll array<double>, p array<double>"
    out = staged(scan(rows.select(*key, "text", "declared", "suffix", "host"), work, schema), "evidence")
    held.unpersist()
    return out


def fuse(evidence: DataFrame, key: list[str], languages: list[str], strength: float = STRENGTH, least: float = LEAST) -> DataFrame:
    """The key with lang, confidence and accepted."""
    k = len(languages)
    if not k:
        return evidence.select(*key, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    told = F.col("letters") > 0  # only rows with text teach the rest
    sums = [F.sum(F.when(told, F.col("p")[i]).otherwise(0.0)) for i in range(k)]
    vector = lambda: F.array(*sums)
    whole = evidence.agg(vector().alias("all"), F.sum(F.when(told, 1).otherwise(0)).alias("n")).first()
    total = np.array([x or 0.0 for x in whole["all"]])
    base = (total + 1) / (total.sum() + k)
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])

    by = lambda *c: evidence.where(" AND ".join(f"{x} IS NOT NULL" for x in c)).groupBy(*c)
    suffix = staged(by("suffix").agg(vector().alias("suffix_n")), "suffix")
    host = staged(by("host").agg(vector().alias("host_n")), "host")
    declared = staged(by("declared").agg(vector().alias("declared_n")), "declared")
    row = F.when(told, F.col("p")).otherwise(arr([0.0] * k))
    out = evidence.withColumn("own", row)
    for name, table in (("suffix", suffix), ("host", host), ("declared", declared)):
        out = out.join(sized(table, 64 + 8 * k), name, "left")

    def level(counts: str, parent):
        """A level's distribution without the row itself, smoothed towards its parent's."""
        n = F.zip_with(counts, "own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.col(counts).isNull(), parent).otherwise(F.zip_with(n, parent, lambda a, q: (a + strength * q) / (size + strength)))

    out = out.withColumn("suffix_prior", level("suffix_n", arr(base))).withColumn("prior", level("host_n", F.col("suffix_prior")))
    declared_size = F.aggregate("declared_n", F.lit(0.0), lambda a, x: a + x)
    share = (declared_size + 1) / (F.lit(float(total.sum())) + 1)
    likely = F.when(F.col("declared_n").isNull(), arr([0.0] * k)).otherwise(
        F.transform(
            F.zip_with("declared_n", "own", lambda a, b: F.greatest(a - b, F.lit(0.0))),
            lambda a, i: F.log((a + strength * share) / (F.element_at(arr(total), i + 1) + strength)),
        )
    )
    out = out.withColumn("likely", likely).withColumn("score", F.transform("ll", lambda x, i: x + F.col("likely")[i] + F.log(F.col("prior")[i])))
    top = F.array_max("score")
    out = out.withColumn("confidence", 1 / F.aggregate(F.transform("score", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    lang = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("score", top).cast("int"))
    return out.select(*key, lang.alias("lang"), "confidence", (told & (F.col("confidence") >= least)).alias("accepted"))


def identify(rows: DataFrame, key: list[str], model: TextModel, weight: float = WEIGHT, strength: float = STRENGTH, least: float = LEAST) -> DataFrame:
    """Identify rows with columns ``key``, text, declared, suffix and host."""
    return fuse(text_evidence(rows, key, model, weight), key, model.languages, strength, least)


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, visible text, declared language, address suffix and host of raw pages."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z]+;", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), text.alias("text"), blank(declared).alias("declared"),
        blank(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"), blank(host).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents; their source stands for the host, and nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"))


def fit_documents(docs: DataFrame) -> TextModel:
    return fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are accepted, with lang set to the language found."""
    columns = docs.columns
    docs, row = keyed_rows(docs, "rows")
    rows = document_rows(docs.withColumn("doc_id", F.col(row)))
    lang = free_name(docs, "_lang")
    found = identify(rows, ["doc_id"], fit_documents(docs)).where("accepted").select(F.col("doc_id").alias(row), F.col("lang").alias(lang))
    out = docs.join(sized(staged(found, "accepted"), 24), row)
    return out.select(*[F.col(lang).alias("lang") if c == "lang" else F.col(c) for c in columns])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("long")
    rows = document_rows(docs).withColumn("page_id", none).unionByName(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("doc_id", none))
    return identify(rows, ["doc_id", "page_id"], fit_documents(docs)).withColumn("confidence", F.round("confidence", 4))
