"""Stupid-backoff scores from n-gram counts that are partitioned by hash and joined to exploded n-grams.

With counts c over a corpus of N words, S(w2 | w1) = c(w1 w2) / c(w1) where the corpus holds
w1 w2, else ``alpha`` * S(w2); S(w) = max(c(w), 1) / N. A document's score is the sum of the natural
logarithms over its words (lower-cased runs of ASCII letters, digits and all else outside ASCII);
its first word is scored by S(w), and n-grams do not cross documents. Where no other corpus is given, each
document is scored by all the other rows: its own words and bigrams are left out of c and N, so what occurs
nowhere else backs off.

The counts are relations of hash and count, never whole in one place:

1. Hot n-grams would make hot keys. Candidates are those frequent in single runs of text (about
   ``RUN_WORDS`` words of one task); the ``hot`` most frequent of them are counted exactly over the
   corpus and go to every executor, a fixed number of pairs. Any choice gives the same scores.
2. All other bigrams are exploded, summed per document (for another corpus, per run) and shuffled by hash
   into groups of about ``GROUP`` entries. A group sums the counts of its bigrams and joins them to the
   documents' bigrams. Those found ask for the count of their first word, the others back off and ask for the count of
   their second; a bigram of two hot words travels as their two places in the hot table, and only words that are not hot are asked for in the
   round of the single words that follows.
3. The sums per document of each group come back to the run that the document was read in.

Longer n-grams are not built: a round of trigrams moves some 24 bytes for each word of text, above the disk that this work is held to.

Defined cases: null or empty text has no words and score 0; repeated rows (or a repeated or null
doc_id) are scored row by row, one result row each, and count for each other; an empty corpus has N = 1 for the purpose of
S(w); an empty table of documents gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import column, grouped, scan, staged, texts_of

HOT = 1 << 16
RUN_WORDS = 1 << 19
GROUP = 1 << 22
ALPHA = 0.4

#: Entries of one run and group, packed. n = 2: place of the document in the run (as differences), both words of the bigram (their places in the hot table,
#: 16 bits each, in g), occurrences x, and how often the document has each of them (o1, o2). n = 3, bigrams with a word that is not hot: the same, with the hash
#: in g and both words in w1 and w2 (places in the hot table, or beyond it in ``cold``). n = 1, with runs (comma-joined names, w1 says which): document, word asked for, weight in
#: the score, occurrences in the document (o1). Without a run: hash (or both words) and count. n = 0: one row for each run (ids in g, words in x, score in w1,
#: backed off in w2). n = -1: sums for documents (doc, w1, w2 likewise).
BODY = ("doc", "g", "x", "w1", "w2", "o1", "o2", "cold")
ENTRIES = "n int, part int, run string, " + ", ".join(f"{c} binary" for c in BODY)
PAIRS, ODD = 2, 3


def _bigrams(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of the second word, hash) of each bigram of a chunk."""
    at = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(w.hash) > 1 else np.zeros(0, np.int64)
    return at + 1, tx.gram_hash(w.hash, 2)[at]


def _runs(batches):
    """Runs of chunks: lists of (doc_ids or None, Words)."""
    held, words = [], 0
    for batch in batches:
        ids = column(batch, "doc_id").to_pylist() if "doc_id" in batch.schema.names else None
        for first, texts in tx.chunks(texts_of(batch)):
            w = tx.Words(texts, tx.ALNUM)
            w.data = w.buf = w.start = w.end = None  # a run needs the hashes only
            held.append((ids and ids[first : first + len(texts)], w))
            words += len(w.hash)
            if words >= RUN_WORDS:
                yield held
                held, words = [], 0
    if held:
        yield held


def _grams(run) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([w.hash for _, w in run]), np.concatenate([_bigrams(w)[1] for _, w in run])


def place(keys: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The place of each hash among sorted keys; their number where it is none of them."""
    if not len(keys):
        return np.zeros(len(g), np.int64)
    i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    return np.where(keys[i] == g, i, len(keys))


class Hot:
    """Exact counts of frequent n-grams of a corpus, its number of words, and the entries to expect of each order."""

    def __init__(self, corpus: DataFrame, hot: int):
        if hot > 1 << 16:
            raise ValueError("places in the hot table are 16 bits")
        texts = corpus.select("text")

        def frequent(batches):
            for run in _runs(batches):
                for n, g in enumerate(_grams(run), 1):
                    key, count = np.unique(g, return_counts=True)
                    top = np.flatnonzero((count > 1) & (count * hot > len(g)))  # as frequent as a hot one is at least
                    yield {"n": np.full(len(top) + 1, n), "g": np.append(tx.to_signed(key[top]), 0), "c": np.append(count[top], len(g)), "total": np.arange(len(top) + 1) == len(top)}

        local = staged(scan(texts, frequent, "n int, g long, c long, total boolean"), "frequent")
        total = dict(local.where("total").groupBy("n").agg(F.sum("c")).collect())
        self.words = total.get(1, 0)
        self.entries = [total.get(1, 0), total.get(2, 0)]
        self.keys, self.counts = [], []
        for n in (1, 2):
            top = local.where(f"n = {n} AND NOT total").groupBy("g").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "g").limit(hot).select("g").collect()
            self.keys.append(np.unique(np.array([r[0] for r in top], np.int64).view(np.uint64)))
            self.counts.append(np.zeros(len(self.keys[-1]), np.int64))
        keys = corpus.sparkSession.sparkContext.broadcast(self.keys)

        def exact(batches):
            sums = [np.zeros(len(k) + 1, np.int64) for k in keys.value]
            for run in _runs(batches):
                for key, s, g in zip(keys.value, sums, _grams(run), strict=True):
                    s += np.bincount(place(key, g), minlength=len(s))
            for n, s in enumerate(sums, 1):
                (i,) = np.nonzero(s[:-1])
                yield {"n": np.full(len(i), n), "i": i, "c": s[i]}

        for n, i, c in scan(texts, exact, "n int, i long, c long").groupBy("n", "i").agg(F.sum("c")).collect():
            self.counts[n - 1][i] = c


def fit(x: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed from as few bytes each as hold the largest, after that number of bytes."""
    top = int(x.max()) if len(x) else 0
    k = next(k for k in (1, 2, 4) if top < 1 << (8 * k))
    return bytes([k]) + pa.compress(x.astype(f"<u{k}").tobytes(), codec="zstd", asbytes=True)


def unfit(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], n * data[0], codec="zstd", asbytes=True), f"<u{data[0]}").astype(np.int64) if n else np.zeros(0, np.int64)


def entry(n: int, part: int, run: str, **body: bytes) -> dict:
    return {"n": n, "part": part, "run": run} | {c: body.get(c, b"") for c in BODY}


def _rows(entries: list[dict]) -> dict:
    return {c: [e[c] for e in entries] for c in ("n", "part", "run", *BODY)}


def _parts(g: np.ndarray, parts: int):
    """(group, places) of the entries that go to each group, in their order."""
    part = (tx.mix(g.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i in np.split(order, cut[1:]) if len(order) else []:
        yield int(part[i[0]]), i


def _pairs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one of each different (document, hash), pair of each place, number of each pair), pairs in order of documents."""
    order = np.lexsort((h, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back, np.bincount(back, minlength=int(new.sum()))


def _asks(runs: list[str], parts: int, run: np.ndarray, doc: np.ndarray, word: np.ndarray, weight: np.ndarray, own: np.ndarray) -> list[dict]:
    """Words asked for, summed for each document of each run."""
    place = run << 32 | doc
    first, back, _ = _pairs(place, word)
    run, doc, word, own, weight = run[first], doc[first], word[first], own[first], np.bincount(back, weights=weight, minlength=len(first))
    return [
        entry(1, part, ",".join(runs), doc=fit(doc[i]), g=word[i].tobytes(), x=weight[i].astype("<i4").tobytes(), w1=fit(run[i]), o1=fit(own[i]))
        for part, i in _parts(word, parts)
    ]


def _counts(n: int, parts: int, g: np.ndarray, weight: np.ndarray | None = None) -> list[dict]:
    key, back = np.unique(g, return_inverse=True)
    count = np.bincount(back, weights=weight, minlength=len(key)).astype(np.int64)
    return [entry(n, part, "", g=key[i].tobytes(), x=fit(count[i])) for part, i in _parts(key, parts)]


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two hot words as one number."""
    return (a << 16 | b).astype("<u4")


def counted(corpus: DataFrame, hot, parts: list[int]) -> DataFrame:
    """The corpus as entries that are only counted, a run's n-grams summed."""

    def work(batches):
        h = hot.value
        size = [len(k) for k in h.keys]
        for run in _runs(batches):
            words = np.concatenate([w.hash for _, w in run])
            out = _counts(1, parts[0], words[place(h.keys[0], words) == size[0]])
            at, g = (np.concatenate(x) for x in zip(*[(p + b, g) for b, (p, g) in zip(_bases(run), (_bigrams(w) for _, w in run), strict=True)], strict=True))
            cold = place(h.keys[1], g) == size[1]
            j1, j2 = place(h.keys[0], words[at - 1]), place(h.keys[0], words[at])
            warm = (j1 < size[0]) & (j2 < size[0])
            out += _counts(PAIRS, parts[1], _both(j1, j2)[cold & warm]) + _counts(ODD, parts[1], g[cold & ~warm])
            yield _rows(out)

    return scan(corpus.select("text"), work, ENTRIES)


def _bases(run) -> np.ndarray:
    """The number of words before each chunk of a run."""
    count = [len(w.hash) for _, w in run]
    return np.cumsum(count) - count


def exploded(docs: DataFrame, hot, parts: list[int], alpha: float, own: bool) -> DataFrame:
    """The documents as entries, and as one row of sums for each run. ``own``: they are the corpus too."""

    def work(batches):
        h = hot.value
        size = [len(k) for k in h.keys]
        for k, run in enumerate(_runs(batches)):
            name = f"{TaskContext.get().partitionId()}-{k}"
            ids, words, score, lost, base, asks, two = [], [], [], [], 0, [], []
            for keys, w in run:
                n = np.diff(w.offset)
                mine, off = np.zeros(len(n)), np.zeros(len(n), np.int64)
                _, pair, times = _pairs(w.doc, w.hash)
                has = times[pair]  # how often its document has each word
                j = place(h.keys[0], w.hash)
                at, g = _bigrams(w)
                one, _, x = _pairs(w.doc[at], g)
                at, g = at[one], g[one]
                doc = w.doc[at]
                i = place(h.keys[1], g)
                warm = i < size[1]
                c = np.append(h.counts[1], 0)[i] - (x if own else 0)
                found, gone = warm & (c > 0), warm & (c <= 0)
                mine += np.bincount(doc, weights=np.where(found, x * np.log(np.maximum(c, 1)), gone * x * np.log(alpha)), minlength=len(n))
                start = w.offset[:-1][n > 0]  # a first word is scored as if it had backed off, but without alpha
                off += np.bincount(doc, weights=gone * x, minlength=len(n)).astype(np.int64)
                ask = np.concatenate((start, at[found] - 1, at[gone]))
                weight = np.concatenate((np.ones(len(start), np.int64), -x[found], x[gone]))
                known = j[ask] < size[0]
                c = np.append(h.counts[0], 0)[j[ask]] - (has[ask] if own else 0)
                mine += np.bincount(w.doc[ask], weights=known * weight * np.log(np.maximum(c, 1)), minlength=len(n))
                ask, weight = ask[~known], weight[~known]
                asks.append((w.doc[ask] + base, w.hash[ask], weight, has[ask]))
                cold = ~warm
                two.append((doc[cold] + base, g[cold], x[cold], j[at[cold] - 1], j[at[cold]], w.hash[at[cold] - 1], w.hash[at[cold]], has[at[cold] - 1], has[at[cold]]))
                ids += keys
                words.append(n)
                score.append(mine)
                lost.append(off)
                base += len(n)
            out = [entry(0, TaskContext.get().partitionId(), name, g=_ids(ids), x=np.concatenate(words).astype("<i8").tobytes(), w1=np.concatenate(score).tobytes(), w2=np.concatenate(lost).astype("<i8").tobytes())]
            d, word, weight, has = (np.concatenate(x) for x in zip(*asks, strict=True))
            out += _asks([name], parts[0], np.zeros(len(d), np.int64), d, word, weight, has)
            if own:
                g = np.concatenate([w.hash for _, w in run])
                out += _counts(1, parts[0], g[place(h.keys[0], g) == size[0]])
            yield _rows(out)
            doc, g, x, j1, j2, w1, w2, o1, o2 = (np.concatenate(x) for x in zip(*two, strict=True))
            out = []
            warm = (j1 < size[0]) & (j2 < size[0])
            common = lambda i: {"doc": fit(np.diff(doc[i], prepend=0)), "x": fit(x[i]), "o1": fit(o1[i]), "o2": fit(o2[i])}
            at = np.flatnonzero(warm)
            both = _both(j1[at], j2[at])
            for part, i in _parts(both, parts[1]):
                out.append(entry(PAIRS, part, name, g=both[i].tobytes(), **common(at[i])))
            at = np.flatnonzero(~warm)
            for part, i in _parts(g[at], parts[1]):
                i = at[i]
                cold = np.unique(np.concatenate((w1[i][j1[i] == size[0]], w2[i][j2[i] == size[0]])))
                a, b = (np.where(j[i] < size[0], j[i], size[0] + place(cold, v[i])) for j, v in ((j1, w1), (j2, w2)))
                out.append(entry(ODD, part, name, g=g[i].tobytes(), w1=fit(a), w2=fit(b), cold=cold.tobytes(), **common(i)))
            yield _rows(out)

    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, ENTRIES)


def _ids(ids: list) -> bytes:
    """doc_ids with a byte each that says whether it is null."""
    return np.array([x is None for x in ids], bool).tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes()


def joined(entries: DataFrame, bigrams: bool, parts: list[int], alpha: float, hot, own: bool) -> DataFrame:
    """Sum the counts of each group and join them to its documents' n-grams.

    Gives sums for the documents of runs (n = -1) and, for bigrams, the words to ask for (n = 1), unless they are hot. In the round of the bigrams rows for
    runs go through as they are, and the counts of single words are summed.
    """

    def sums(run: str, doc: np.ndarray, value: np.ndarray, off: np.ndarray) -> dict:
        local, at = np.unique(doc, return_inverse=True)
        value, off = (np.bincount(at, weights=v, minlength=len(local)) for v in (value, off))
        return entry(-1, 0, run, doc=fit(np.diff(local, prepend=0)), w1=value.tobytes(), w2=fit(off.astype(np.int64)))

    def of_bigrams(rows: list[dict], kind: int, h) -> list[dict]:
        width = 4 if kind == PAIRS else 8
        g = np.frombuffer(b"".join(r["g"] for r in rows), f"<u{width}")
        size = [len(r["g"]) // width for r in rows]
        ends = np.cumsum(size)
        x = np.concatenate([unfit(r["x"], n) for r, n in zip(rows, size, strict=True)])
        counts = np.repeat([own or not r["run"] for r in rows], size)
        unique, back = np.unique(g, return_inverse=True)
        total = np.bincount(back, weights=x * counts, minlength=len(unique)).astype(np.int64)[back]
        del unique, back, counts
        words, logs, out, asks, names = len(h.keys[0]), np.append(h.counts[0], 0), [], [], []
        for r, n, e in zip(rows, size, ends, strict=True):
            if not r["run"]:
                continue
            doc, k = np.cumsum(unfit(r["doc"], n)), x[e - n : e]
            c = total[e - n : e] - (k if own else 0)
            found = c > 0
            value, off = np.where(found, k * np.log(np.maximum(c, 1)), k * np.log(alpha)), np.where(found, 0, k)
            if kind == PAIRS:
                both = g[e - n : e].astype(np.int64)
                w1, w2 = both >> 16, both & 0xFFFF
            else:
                w1, w2 = unfit(r["w1"], n), unfit(r["w2"], n)
            word, weight, has = (np.where(found, a, b) for a, b in ((w1, w2), (-k, k), (unfit(r["o1"], n), unfit(r["o2"], n))))
            known = word < words
            value = value + known * weight * np.log(np.maximum(logs[np.minimum(word, words)] - (has if own else 0), 1))
            rest = np.flatnonzero(~known)
            if len(rest):
                asks.append((np.full(len(rest), len(names)), doc[rest], np.frombuffer(r["cold"], "<u8")[word[rest] - words], weight[rest], has[rest]))
                names.append(r["run"])
            out.append(sums(r["run"], doc, value, off))
        if asks:
            out += _asks(names, parts[0], *(np.concatenate(v) for v in zip(*asks, strict=True)))
        return out

    def of_words(rows: list[dict]) -> list[dict]:
        size = [len(r["g"]) // 8 for r in rows]
        total = [(np.frombuffer(r["g"], "<u8"), unfit(r["x"], n)) for r, n in zip(rows, size, strict=True) if not r["run"]]
        key, back = np.unique(np.concatenate([g for g, _ in total]) if total else np.zeros(0, np.uint64), return_inverse=True)
        count = np.append(np.bincount(back, weights=np.concatenate([c for _, c in total]), minlength=len(key)).astype(np.int64) if total else np.zeros(0, np.int64), 0)
        ids: dict[str, int] = {}
        run, doc, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for r, n in zip(rows, size, strict=True):
            if r["run"]:
                mine = np.array([ids.setdefault(name, len(ids)) for name in r["run"].split(",")])
                c = count[place(key, np.frombuffer(r["g"], "<u8"))] - (unfit(r["o1"], n) if own else 0)
                run.append(mine[unfit(r["w1"], n)])
                doc.append(unfit(r["doc"], n))
                value.append(np.frombuffer(r["x"], "<i4") * np.log(np.maximum(c, 1)))
        run, doc, value = (np.concatenate(v) for v in (run, doc, value))
        order = np.argsort(run, kind="stable")
        cut = np.searchsorted(run[order], np.arange(len(ids) + 1))
        return [sums(name, doc[i], value[i], np.zeros(len(i))) for name, k in ids.items() if len(i := order[cut[k] : cut[k + 1]])]

    def work(key, table):
        n = key[0].as_py()
        if n == 0:
            return table
        rows = table.to_pylist()
        if n > 1:
            out = of_bigrams(rows, n, hot.value)
        elif not bigrams:
            out = of_words(rows)
        else:
            alone = [r for r in rows if not r["run"]]
            out = [r for r in rows if r["run"]]
            if alone:
                g = np.concatenate([np.frombuffer(r["g"], "<u8") for r in alone])
                out += _counts(1, parts[0], g, np.concatenate([unfit(r["x"], len(r["g"]) // 8) for r in alone]))
        kinds = {"n": pa.int32(), "part": pa.int32(), "run": pa.string()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in _rows(out).items()})

    return grouped(entries.groupBy("n", "part"), work, ENTRIES)


def summed(sums: DataFrame, hot, own: bool) -> DataFrame:
    """doc_id, n_words, n_backed_off and log_score from the rows of sums of each run."""

    def work(key, table):
        rows = table.select(["n", "g", "x", "doc", "w1", "w2"]).to_pylist()
        base = next(r for r in rows if r["n"] == 0)
        score, lost = np.frombuffer(base["w1"], np.float64).copy(), np.frombuffer(base["w2"], "<i8").copy()
        words = np.frombuffer(base["x"], "<i8")
        null = np.frombuffer(base["g"][: len(score)], bool)
        ids = np.frombuffer(base["g"][len(score) :], "<i8")
        for r in rows:
            if r["n"] < 0:
                n = len(r["w1"]) // 8
                d = np.cumsum(unfit(r["doc"], n))
                score[d] += np.frombuffer(r["w1"], np.float64)
                lost[d] += unfit(r["w2"], n)
        score -= (lost + (words > 0)) * np.log(np.maximum(hot.value.words - (words if own else 0), 1))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "n_words": words, "n_backed_off": lost, "log_score": score})

    return grouped(sums.groupBy("run"), work, "doc_id long, n_words long, n_backed_off long, log_score double")


def backoff_scores(docs: DataFrame, corpus: DataFrame | None = None, alpha: float = ALPHA, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_backed_off (bigrams that the corpus lacks) and log_score of documents under the counts of a corpus; without one, of the other documents."""
    spark, own = docs.sparkSession, corpus is None
    known = Hot(docs if own else corpus, hot)
    parts = [max(1, -(-n // GROUP)) for n in known.entries]
    held = spark.sparkContext.broadcast(known)
    entries = exploded(docs, held, parts, alpha, own)
    if not own:
        entries = entries.unionByName(counted(corpus, held, parts))
    two = staged(joined(entries, True, parts, alpha, held, own), "bigrams")
    one = joined(two.where("n = 1"), False, parts, alpha, held, own)
    return summed(two.where("n < 1").unionByName(one), held, own)


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under the counts of all others, and the mean of its logarithms by word."""
    found = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 4))
    return found.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 3).alias("log_score"), mean.alias("mean_log_score"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w2, unnest(list_concat([NULL], w[:-2])) AS w1 FROM d WHERE len(w) > 0),
o1 AS (SELECT doc_id, w2 AS w, count(*) AS c FROM u GROUP BY ALL),
o2 AS (SELECT doc_id, w1, w2, count(*) AS c FROM u WHERE w1 IS NOT NULL GROUP BY ALL),
c1 AS (SELECT w, sum(c) AS c FROM o1 GROUP BY w),
c2 AS (SELECT w1, w2, sum(c) AS c FROM o2 GROUP BY w1, w2),
x1 AS (SELECT o1.doc_id, w, c1.c - o1.c AS c FROM o1 JOIN c1 USING (w)),
x2 AS (SELECT o2.doc_id, w1, w2, c2.c - o2.c AS c FROM o2 JOIN c2 USING (w1, w2)),
n AS (SELECT d.doc_id, greatest((SELECT count(*) FROM u) - len(w), 1) AS n FROM d),
s AS (
  SELECT u.doc_id, count(*) FILTER (WHERE u.w1 IS NOT NULL AND x2.c = 0) AS backed_off,
         sum(CASE WHEN x2.c > 0 THEN ln(x2.c) - ln(b.c)
                  ELSE CASE WHEN u.w1 IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(a.c, 1)) - ln(n.n) END) AS s
  FROM u JOIN n USING (doc_id) JOIN x1 a ON a.doc_id = u.doc_id AND a.w = u.w2
  LEFT JOIN x1 b ON b.doc_id = u.doc_id AND b.w = u.w1 LEFT JOIN x2 ON x2.doc_id = u.doc_id AND x2.w1 = u.w1 AND x2.w2 = u.w2 GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.backed_off, 0) AS BIGINT) AS n_backed_off, round(coalesce(s.s, 0), 3) AS log_score,
       round(s.s / len(d.w), 4) AS mean_log_score
FROM d LEFT JOIN s USING (doc_id)
"""
