"""Runs of periodic words: an index for longest common extensions over a difference cover, asked at the points of a harmonic grid.

A run is a stretch of words with a smallest period q (words q apart are equal) of at least ``least`` words and ``times`` periods that no neighbouring word extends.

Index: positions whose number modulo ``V`` is in a difference cover are sampled. Only their suffixes are sorted, by the first ``V`` words and then by pairs of ranks
at offsets that double (the sample so many words on is a sample again), until all ranks differ. Neighbours in that order have a longest common prefix; the
least of a range of them, from a sparse table, is that of any two samples. Any two positions reach samples together within ``V`` words, which are compared one by one.

Grid: a run of period q is a stretch of at least max(least, times * q) - q places that equal the one q words on. So points in steps of about 1.5 q meet
every run where at least ``ahead(q)`` equal words follow; all periods together have n log n points. Most points fail within a few words, and documents with no point left need no index.
A point that stays is extended forwards by the index, and backwards by bisection with it. A run is met by multiples of its period too, at the same ends; the least period stays.

Documents are worked on in chunks of about ``CHUNK_WORDS`` words in Spark tasks, each on its own, so no key is hot; memory grows with the longest document alone.

Defined cases: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text; words are whole, in any script, and differ by case; repeated rows and
null doc_id are worked on like any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, scan, texts_of

#: A difference cover (fixed values): modulo V, every number is a difference of two of COVER.
V, COVER = 13, (0, 1, 3, 9)
CHUNK_WORDS = 1 << 17
POINTS = 1 << 19

_SLOT = np.full(V, -1)
_SLOT[list(COVER)] = range(len(COVER))
#: Words until a position (by its remainder) and one a distance on (by its remainder) are samples both.
_UNTIL = np.array([[next(x for x in range(V) if (a + x) % V in COVER and (a + d + x) % V in COVER) for d in range(V)] for a in range(V)])


def dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks from an order and whether each place differs from the one before."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class Extensions:
    """Longest common extensions of the positions of ``ids``, in which some number occurs once between any two documents and at the end."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.concatenate((ids, np.full(2 * V, -1, ids.dtype)))
        at = np.arange(len(ids))
        at = at[_SLOT[at % V] >= 0]
        m, step = len(at), len(COVER)
        bits = max(1, int(ids.max(initial=0)).bit_length())
        keys = []
        for lo in range(0, V, max(1, 62 // bits)):
            key = np.zeros(m, np.int64)
            for k in range(lo, min(V, lo + max(1, 62 // bits))):
                key = (key << bits) + np.maximum(self.ids[at + k], 0)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(m, bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0) if m > 1 else new[1:]
        self.rank, levels = dense(order, new), []
        while m and self.rank.max() < m - 1:
            levels.append(self.rank)
            far = np.zeros(m, np.int64)  # 0: past the end
            ahead = step << (len(levels) - 1)
            far[: max(0, m - ahead)] = self.rank[ahead:] + 1
            key = self.rank * (m + 1) + far
            order = np.argsort(key, kind="stable")
            new[1:] = key[order[1:]] != key[order[:-1]]
            new[:1] = True
            self.rank = dense(order, new)
        lcp = np.zeros(m, np.int64)
        if m > 1:
            a, b = order[:-1].copy(), order[1:].copy()
            far = np.zeros(m - 1, np.int64)
            for k in range(len(levels) - 1, -1, -1):
                ok = (np.maximum(a, b) < m) & (levels[k][np.minimum(a, m - 1)] == levels[k][np.minimum(b, m - 1)])
                a, b, far = a + ok * (step << k), b + ok * (step << k), far + ok * (V << k)
            i, j = at[order[:-1]] + far, at[order[1:]] + far
            alive = np.arange(m - 1)
            while len(alive):  # fewer than V words
                alive = alive[self.ids[i[alive]] == self.ids[j[alive]]]
                i[alive] += 1
                j[alive] += 1
            lcp[1:] = i - at[order[:-1]]
        self.table = [lcp.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= m:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        self.sizes = np.array([len(x) for x in self.table])

    def _samples(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The extension of different samples: the least prefix between their ranks."""
        number = lambda x: x // V * len(COVER) + _SLOT[x % V]
        a, b = self.rank[number(i)], self.rank[number(j)]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for level in np.unique(k):
            x = np.flatnonzero(k == level)
            out[x] = np.minimum(self.table[level][lo[x]], self.table[level][hi[x] - (1 << level) + 1])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i and j differ."""
        until = _UNTIL[i % V, (j - i) % V]
        out, alive = np.zeros(len(i), np.int64), np.arange(len(i))
        for d in range(V):
            met = until[alive] == d
            x = alive[met]
            out[x] = d + self._samples(i[x] + d, j[x] + d)
            alive = alive[~met]
            alive = alive[self.ids[i[alive] + d] == self.ids[j[alive] + d]]
            out[alive] = d + 1
            if not len(alive):
                break
        return out


class Shape:
    """Least length of a run of a period, the equal words that follow a grid point in it, and the grid's step."""

    def __init__(self, least: int, times: int):
        if least < 1 or times < 2:
            raise ValueError("least is 1 or more, times is 2 or more")
        self.least, self.times = least, times

    def length(self, q):
        return np.maximum(self.least, self.times * q)

    def ahead(self, q):
        return np.maximum(1, np.minimum(self.length(q) - q, np.maximum(self.least // 3, q // 2)))

    def step(self, q):
        return self.length(q) - q - self.ahead(q) + 1


def grid_points(ids: np.ndarray, start: np.ndarray, size: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, period, position) of the grid points at which the first words equal those a period on."""
    most = np.where(size >= shape.least, size // shape.times, 0)
    doc = np.repeat(np.arange(len(size)), most)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    ahead, step = shape.ahead(q), shape.step(q)
    counts = np.maximum(0, (size[doc] - q - ahead) // step + 1)
    ends = np.cumsum(counts)
    found, lo = [], 0
    while lo < len(doc):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + POINTS, side="right")))
        n = counts[lo:hi]
        pair = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        at = start[doc[pair]] + k * step[pair]
        for d in range(max(1, shape.least // 3)):
            same = (ids[at + d] == ids[at + q[pair] + d]) | (d >= ahead[pair])
            at, pair = at[same], pair[same]
            if not len(at):
                break
        found.append((doc[pair], q[pair], at))
        lo = hi
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def runs_of(words: np.ndarray, size: np.ndarray, shape: Shape) -> dict[int, np.ndarray]:
    """Runs of each document that has any, as rows (start, length, period) by start, then period. ``words``: numbers of the words of all documents, one after another."""
    start = np.cumsum(size) - size
    doc, q, at = grid_points(np.concatenate((words, np.full(shape.least + 1, -1))), start, size, shape)
    if not len(doc):
        return {}
    # Only documents with points left are indexed, each followed by a number of its own.
    docs, own = np.unique(doc, return_inverse=True)
    ends = int(words.max()) + 1
    ids = np.concatenate([np.append(words[start[d] : start[d] + size[d]], ends + k) for k, d in enumerate(docs)])
    first = np.cumsum(size[docs] + 1) - size[docs] - 1
    extend = Extensions(ids)
    i = at - start[doc] + first[own]
    on = extend(i, i + q)
    stay = on >= shape.ahead(q)
    own, q, i, stop = own[stay], q[stay], i[stay], (i + q + on)[stay]
    order = np.lexsort((i, stop, q, own))
    own, q, i, stop = own[order], q[order], i[order], stop[order]
    one = np.ones(len(q), bool)
    one[1:] = (own[1:] != own[:-1]) | (q[1:] != q[:-1]) | (stop[1:] != stop[:-1])
    own, q, i, stop = own[one], q[one], i[one], stop[one]
    back, over = np.zeros(len(i), np.int64), i - first[own] + 1
    while (open_ := np.flatnonzero(over - back > 1)).size:  # back fits, over does not
        middle = (back[open_] + over[open_]) // 2
        fits = extend(i[open_] - middle, i[open_] - middle + q[open_]) >= middle
        back[open_] = np.where(fits, middle, back[open_])
        over[open_] = np.where(fits, over[open_], middle)
    begin = i - back
    stay = stop - begin >= shape.length(q)
    own, q, begin, stop = own[stay], q[stay], begin[stay], stop[stay]
    order = np.lexsort((q, stop, begin, own))
    own, q, begin, stop = own[order], q[order], begin[order], stop[order]
    one = np.ones(len(q), bool)
    one[1:] = (own[1:] != own[:-1]) | (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    own, q, begin, stop = own[one], q[one], begin[one], stop[one]
    out = {}
    for k in np.unique(own):
        x = own == k
        rows = np.stack((begin[x] - first[k], stop[x] - begin[x], q[x]), axis=1)
        out[int(docs[k])] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, one space apart, without those after the first period of a run."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, the runs by start, then period, and the collapsed text of each row."""
    shape = Shape(least, times)

    def found(ids: list, split: list[list[bytes]]) -> dict:
        number = defaultdict(count().__next__)
        size = np.array([len(x) for x in split])
        words = np.fromiter((number[w] for x in split for w in x), np.int64, int(size.sum()))
        runs = runs_of(words, size, shape) if len(words) else {}
        return {
            "doc_id": pa.array(ids, pa.int64()), "n_words": size,
            "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs[k].tolist()] if k in runs else [] for k in range(len(split))],
            "collapsed": pa.array([collapsed(x, runs[k]) if k in runs else b" ".join(x) for k, x in enumerate(split)], pa.binary()),
        }

    def work(batches):
        for batch in batches:
            ids, split, total = [], [], 0
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                ids.append(doc_id)
                split.append((text or b"").split())  # at the six white space bytes of ASCII
                total += len(split[-1])
                if total >= CHUNK_WORDS:
                    yield found(ids, split)
                    ids, split, total = [], [], 0
            if ids:
                yield found(ids, split)

    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth document by the checksum of its id repeats itself from some word on."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    out = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.array_size("w").cast("long"), "g": g})
    out = out.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return out.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    exceeds = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  the order of the array settles ties
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(exceeds(y, x), y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumns({"best": best, "lines": lines})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
