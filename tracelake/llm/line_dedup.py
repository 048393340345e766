"""Near-duplicate line removal by a deletion-neighbourhood join, in built-in functions only.

Two lines are near when their edit distance (insertions, deletions, substitutions of
characters) is at most ``max_edits``. A line is removed where a near or equal line stands
strictly earlier; so of each such pair the earliest stays. Places are ordered by doc_id, then, among rows that share an id or
have none, by two hashes of the row's text (``ROW``), then by line number; a row loses the lines at its own places only.

A key is a deletion variant with the gaps between its characters where edits may have been, exactly as many as the
bound. A line emits it if no gap holds more of its deleted characters than the key names, so two lines with an
equal key are within the bound, and the earliest line of a key serves all others of it.

For a bound of one, all variants of every line would still write each text many times over.
Lines within one edit agree on all but one segment, so variants are emitted only where
the rest of the line is found again, and only of that segment:

1. Equal lines become one row (first place, number of places), aggregated before the shuffle.
2. Halves: for the lengths m that a pair can have in common (m is the shorter length),
   a line emits a hashed key of the half that the edit spares. Keys of one line only end here.
3. Segments: the other half is cut into about sqrt(length) segments, and the line emits a
   key of everything outside each segment. Keys of one line only end here.
4. Variants: of the one segment left, all deletion variants within the bound are emitted as
   hashed keys. Lines with an equal variant are near; the earliest of them is taken by an
   aggregate per key, so a key shared by many lines costs no pairs.
5. The edit distance to the earliest near line is verified on the texts.

For larger bounds every line emits all its keys, some (2 length)**max_edits of them.

Defined cases: null text has no lines and stays null; lines shorter than ``min_chars``
characters (by default empty ones only) are never removed and remove nothing, those shorter than ``near_chars`` are removed and remove only where they are
equal; rows with a null doc_id
come before all others; different texts under one doc_id, or under none, are rows of their own; a repeated row (same doc_id and text) is no earlier than
itself, so both stay or lose the same lines; very long lines cost length**1.5; an empty table gives an
empty result; other columns are kept by ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, sized, staged

MIN_CHARS = 1


def _hash(*parts) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


#: What tells rows apart: the id, which may be null or repeated, and 128 bits of the text.
ROW = ("doc_id", "t1", "t2")


def identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), _hash(5, F.col("text")).alias("t2"), "text")


def numbered_lines(docs: DataFrame) -> DataFrame:
    return docs.select(*ROW, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def own_place() -> Column:
    return F.struct(*ROW, "line_no")


def keyed(lines: DataFrame, min_chars: int) -> DataFrame:
    """The lines that take part, with 128 bits of identity."""
    return lines.where(F.length("line") >= min_chars).withColumns({"h1": F.xxhash64("line"), "h2": _hash(7, F.col("line"))})


def half_keys(line: Column) -> Column:
    """(m, side, key) of the halves that one edit can spare: for m the length itself (as the shorter line) and one less (as the longer)."""
    n = F.length(line)

    def of(m: Column, side: int) -> Column:
        cut = F.floor(m / 2).cast("int")
        spared = F.right(line, m - cut) if side == 0 else F.left(line, cut)
        return F.struct(m.alias("m"), F.lit(side).alias("side"), _hash(m, side, spared).alias("key"))

    return F.array(*[of(m, side) for m in (n, n - 1) for side in (0, 1)])


def shared(rows: DataFrame, name: str) -> DataFrame:
    """The keys of more than one row."""
    return staged(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), name)


def variant_keys(line: Column, edits: int) -> Column:
    """Hashed keys of a line for a bound of ``edits``: so many gaps in rising order, at each of which a character is deleted or none is."""
    states = F.array(F.struct(line.alias("v"), F.lit("").alias("gaps"), F.lit(0).alias("last")))

    def step(s: Column) -> Column:
        def at(g: Column, v: Column) -> Column:
            return F.struct(v.alias("v"), F.concat(s["gaps"], F.lit(","), g.cast("string")).alias("gaps"), g.alias("last"))

        n = F.length(s["v"])
        kept = F.transform(F.sequence(s["last"], n), lambda g: at(g, s["v"]))
        deleted = F.transform(F.sequence(s["last"], n - 1), lambda g: at(g, F.concat(F.substr(s["v"], F.lit(1), g), F.substr(s["v"], g + 2))))
        return F.when(n > s["last"], F.concat(kept, deleted)).otherwise(kept)

    for _ in range(edits):
        states = F.flatten(F.transform(states, step))
    return F.array_distinct(F.transform(states, lambda s: F.xxhash64(s["v"], s["gaps"])))


def near_by_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(h1, h2, e) as ``near_lines``, for any bound."""
    one = lines.groupBy("h1", "h2").agg(F.min(own_place()).alias("first"), F.first("line").alias("line"))
    emitted = staged(one.select("h1", "h2", "first", F.explode(variant_keys(F.col("line"), edits)).alias("key")), "variants")
    met = staged(emitted.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("first", "h1", "h2")).alias("o")).where("n > 1"), "variant-keys")
    found = emitted.join(met, "key").where("o.first < first").select("h1", "h2", F.col("o.first").alias("e"), F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2")).distinct()
    texts = staged(one.select("h1", "h2", "line"), "near-texts")
    theirs = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("theirs"))
    verified = found.join(texts, ["h1", "h2"]).join(theirs, ["o1", "o2"]).where(F.levenshtein("line", "theirs") <= edits)
    return verified.groupBy("h1", "h2").agg(F.min("e").alias("e"))


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2, e): the earliest place of a line within one edit that is not equal, for the lines that have one."""
    halves = distinct.select("h1", "h2", F.explode("keys").alias("k")).select("h1", "h2", "k.m", "k.side", "k.key")
    # Written first, here and below, so that the join shuffles both sides by itself and a key of many lines can be split.
    halves = staged(halves.join(shared(halves, "half-keys"), "key"), "halves")

    ids = staged(halves.select("h1", "h2").distinct(), "near-ids")
    texts = keyed(numbered_lines(docs), 0).join(sized(ids, 24), ["h1", "h2"], "left_semi")
    texts = staged(texts.groupBy("h1", "h2").agg(F.min(own_place()).alias("first"), F.first("line").alias("line")), "near-texts")

    # The half with the edit: s characters in the shorter line, s + 1 in the longer.
    part = halves.join(texts, ["h1", "h2"])
    cut = F.floor(F.col("m") / 2).cast("int")
    s = F.when(F.col("side") == 0, cut).otherwise(F.col("m") - cut)
    n = F.length("line")
    part = part.select(
        "h1", "h2", "first", "key", s.alias("s"), (n - F.col("m")).alias("longer"),
        F.when(F.col("side") == 0, F.left("line", n - (F.col("m") - cut))).otherwise(F.right("line", n - cut)).alias("part"),
    )
    count = F.ceil(F.sqrt("s")).cast("int")
    part = part.where("s > 0").withColumn("q", count).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    lo, hi = F.floor(F.col("t") * F.col("s") / F.col("q")).cast("int"), F.floor((F.col("t") + 1) * F.col("s") / F.col("q")).cast("int")
    part = part.withColumns({"lo": lo, "hi": hi}).select(
        "h1", "h2", "first", "longer",
        _hash(F.col("key"), F.col("t"), F.left("part", F.col("lo")), F.right("part", F.col("s") - F.col("hi"))).alias("key"),
        F.substring("part", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("longer")).alias("seg"),
    )
    part = staged(part, "segments")
    part = part.join(shared(part, "segment-keys"), "key")

    # Variants. A substitution: both lines without the same character. An insertion: the longer line without one, the shorter as it is.
    size = F.length("seg")
    gone = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.left("seg", i - 1), F.right("seg", size - i)))
    variants = F.when(size == 0, F.array(F.struct(F.lit(0).alias("at"), F.col("seg").alias("v")))).when(
        F.col("longer") == 1, F.transform(gone, lambda v: F.struct(F.lit(0).alias("at"), v.alias("v")))
    ).otherwise(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("seg").alias("v"))), F.transform(gone, lambda v, i: F.struct((i + 1).alias("at"), v.alias("v")))))
    emitted = part.select("h1", "h2", "first", "longer", "key", F.explode(variants).alias("v"))
    emitted = emitted.select("h1", "h2", "first", "longer", _hash(F.col("key"), F.col("v.at"), F.col("v.v")).alias("key"), (F.col("v.at") == 0).alias("indel"))
    emitted = staged(emitted.distinct(), "variants")
    place = F.struct("first", "h1", "h2")
    met = emitted.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("longer") == 0, place)).alias("short"), F.min(F.when(F.col("longer") == 1, place)).alias("long"),
    ).where("n > 1")
    met = staged(met, "variant-keys")
    # Of an insertion key only a line of the other length is near; of a substitution key every line is.
    other = F.when(~F.col("indel"), F.col("short")).when(F.col("longer") == 1, F.col("short")).otherwise(F.col("long"))
    found = emitted.join(met, "key").withColumn("o", other).where("o IS NOT NULL AND o.first < first")
    best = found.select("h1", "h2", F.col("o.first").alias("e"), F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2")).distinct()
    mine = texts.select("h1", "h2", F.col("line").alias("mine"))
    theirs = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("theirs"))
    verified = best.join(mine, ["h1", "h2"]).join(theirs, ["o1", "o2"]).where(F.levenshtein("mine", "theirs", 1) == 1)
    return verified.groupBy("h1", "h2").agg(F.min("e").alias("e"))


def removed_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, near_chars: int = MIN_CHARS) -> DataFrame:
    """The place (``ROW`` and line_no) of every line with an equal or near line strictly before it."""
    if max_edits < 0:
        raise ValueError("max_edits is not negative")
    docs = identified(docs)
    lines = keyed(numbered_lines(docs), min_chars)
    grouped = {"first": F.min(own_place()), "n": F.count("*")}
    if max_edits == 1:
        grouped["keys"] = F.first("keys")
        lines = lines.withColumn("keys", F.when(F.length("line") >= near_chars, half_keys(F.col("line"))))
    distinct = staged(lines.groupBy("h1", "h2").agg(*[v.alias(k) for k, v in grouped.items()]), "distinct-lines")
    if max_edits:
        near = near_lines(docs, distinct) if max_edits == 1 else near_by_keys(lines.where(F.length("line") >= near_chars), max_edits)
        distinct = distinct.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left")
    else:
        distinct = distinct.withColumn("e", F.lit(None).cast(distinct.schema["first"].dataType))
    earliest = distinct.where("n > 1 OR e IS NOT NULL").select("h1", "h2", F.least("first", "e").alias("e"))
    places = lines.select("h1", "h2", *ROW, "line_no")
    return places.join(sized(staged(earliest, "earliest"), 64), ["h1", "h2"]).where(own_place() > F.col("e")).select(*ROW, "line_no").distinct()


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, near_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their text rebuilt from the lines kept, and n_lines and n_removed (which replace columns of those names)."""
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    split, gone, key, t1, t2 = (free_name(docs, x) for x in ("_lines", "_gone", "_gone_id", "_gone_t1", "_gone_t2"))
    removed = removed_lines(docs, max_edits, min_chars, near_chars).groupBy(F.col("doc_id").alias(key), F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(F.collect_list("line_no").alias(gone))
    removed = sized(staged(removed, "removed-lines"), 80, items=gone, item_bytes=4)
    # Lines are split below the join, so that each is fetched from an array that is made once.
    own = [free_name(docs, x) for x in ("_own_t1", "_own_t2")]
    out = docs.withColumns({split: F.split("text", "\n"), own[0]: F.xxhash64("text"), own[1]: _hash(5, F.col("text"))}).drop("text")
    out = out.join(removed, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own[0]) == F.col(t1)) & (F.col(own[1]) == F.col(t2)), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.array_size(split) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    text = F.array_join(F.when(F.col(gone).isNull(), F.col(split)).otherwise(F.transform(kept, lambda i: F.get(split, i))), "\n")
    return out.select(
        *[F.col(c) if c != "text" else text.alias("text") for c in columns],
        F.coalesce(F.array_size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
d AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS first FROM l WHERE length(line) >= 1 GROUP BY line),
v AS (SELECT line, first, i, left(line, i - 1) || substring(line, i + 1) AS v FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM d)),
pairs AS (
  SELECT a.line, b.first FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.line <> b.line
  UNION ALL SELECT a.line, b.first FROM v a JOIN d b ON a.v = b.line
  UNION ALL SELECT b.line, a.first FROM v a JOIN d b ON a.v = b.line),
e AS (SELECT line, min(first) AS e FROM (SELECT line, first FROM d UNION ALL SELECT line, first FROM pairs) GROUP BY line),
m AS (SELECT l.doc_id, l.line_no, l.line, coalesce({'d': l.doc_id, 'l': l.line_no} > e.e, false) AS gone FROM l LEFT JOIN e USING (line))
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(t) AS kept_sha256
FROM documents LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS t
  FROM m GROUP BY doc_id) USING (doc_id)
"""
