"""SentencePiece (merge-type) encoding with seeded merge dropout, and lossless decoding.

A text becomes symbols, one per character, with white space as U+2581 and one such mark
in front. Candidates are neighbouring symbols whose concatenation is a piece; they are
processed best score first, ties leftmost first. Each candidate is skipped for good if a
hash of (seed, doc_id, unit, its place in the document, place in the unit, length), read as a
number in [0, 1), is under ``dropout``; so a segmentation depends on the key alone, not on the
order of processing, and can be reproduced on any executor. Every occurrence of a word is
skipped by itself: within a document, across documents, and by seed. With dropout 0 the result is that of the public library.

No piece holds the mark after another character, so a text falls apart into units that
begin with a mark. The result of a unit depends on which of its stretches that are pieces are
skipped, so occurrences of a chunk of documents with the same text and the same of these skipped are
encoded once. The different ones are encoded together, vectorised: each round merges the best candidate of every unit, which is the agenda order
within a unit. Units longer than ``LONG`` characters use an agenda (a heap) each.
Characters that no piece covers, and the mark itself where a text holds it, become the
byte pieces of their UTF-8 bytes.

Defined cases: null text gives null ids, empty text gives none; repeated rows give repeated
result rows; null doc_ids count as one id; texts of any length are encoded whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .common import column, scan

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
LONG = 64
NONE = np.iinfo(np.int32).max


class Model:
    """The pieces of a merge-type model and the table of its merges."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)
        self.byte = np.full(256, -1, np.int32)
        text: list[bytes] = [b""] * size
        normal = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                text[i] = bytes([int(piece[3:5], 16)])
            elif not special(i):
                normal[piece] = i
                text[i] = piece.replace("▁", " ").encode()
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces; decoding could lose characters")
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("a piece holds a mark after another character; units cannot be encoded apart")
        self.length = np.array([len(x) for x in text])
        self.offset = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        # Symbols are piece ids; single characters that are only parts of pieces get ids from size on.
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(symbol) + size)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        rank = {i: r for r, i in enumerate(sorted(normal.values(), key=lambda i: (-sp.get_score(i), i)))}
        merges = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    merges[a << 20 | b] = (rank[i], i)
        keys = np.array(sorted(merges), np.int64)
        self.key = keys
        self.rank = np.array([merges[int(k)][0] for k in keys], np.int32)
        self.made = np.array([merges[int(k)][1] for k in keys], np.int32)
        # Slot -> place of a key; a slot of several keys leads to the sorted keys.
        slot = self._slot(keys)
        self.at = np.full(1 << 20, -1, np.int32)
        self.at[slot] = np.arange(len(keys))
        self.at[np.flatnonzero(np.bincount(slot, minlength=1 << 20) > 1)] = -2
        self.size = size
        made = [np.array([ord(c) for c in p.replace("▁", " ")], np.uint32) for p in normal if len(p) > 1]
        self.longest = max(map(len, made), default=0)
        ends = np.cumsum([len(x) for x in made])
        self.piece = np.unique(tx.range_hash(tx.prefix_hash(np.concatenate(made)), np.concatenate(([0], ends[:-1])), ends)) if made else np.zeros(0, np.uint64)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.piece >> np.uint64(44)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair, rank NONE where they make no piece."""
        rank, made = np.full(len(a), NONE, np.int32), np.zeros(len(a), np.int32)
        pairs = a.astype(np.int64) << 20 | b
        i = self.at[self._slot(pairs)]
        at = np.flatnonzero((i != -1) & (a >= 0) & (b >= 0))
        i, pairs = i[at], pairs[at]
        several = np.flatnonzero(i < 0)
        i[several] = np.minimum(np.searchsorted(self.key, pairs[several]), len(self.key) - 1)
        ok = self.key[i] == pairs
        rank[at[ok]], made[at[ok]] = self.rank[i[ok]], self.made[i[ok]]
        return rank, made


@lru_cache(2)
def model_of(path: str) -> Model:
    return Model(path)


def skipped(key: np.ndarray, place: np.ndarray, length: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate at a place, of so many characters, is skipped in the unit with this key."""
    if dropout <= 0:
        return np.zeros(len(key), bool)
    h = tx.mix(key + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + length.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def encode_long(m: Model, chars: np.ndarray, key: np.uint64, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first character of each) of one unit, by an agenda."""
    n = len(chars)
    sym, start, size = chars.tolist(), list(range(n)), [1] * n
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    version = [0] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def propose(firsts: np.ndarray) -> None:
        seconds = np.array([right[i] for i in firsts], np.int64)
        firsts = firsts[seconds >= 0]
        seconds = seconds[seconds >= 0]
        a, b = (np.array([sym[i] for i in x], np.int32) for x in (firsts, seconds))
        rank, made = m.lookup(a, b)
        length = np.array([size[i] + size[j] for i, j in zip(firsts, seconds, strict=True)], np.int64)
        skip = skipped(np.full(len(firsts), key, np.uint64), firsts, length, dropout)
        for i, j, r, x, s in zip(firsts, seconds, rank, made, skip, strict=True):
            if r != NONE and not s:
                heapq.heappush(agenda, (int(r), int(i), version[i], version[j], int(x)))

    propose(np.arange(n))
    while agenda:
        _, i, vi, vj, made = heapq.heappop(agenda)
        j = right[i]
        if size[i] == 0 or j < 0 or version[i] != vi or version[j] != vj:
            continue
        sym[i], size[i] = made, size[i] + size[j]
        size[j], right[i] = 0, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        version[i] += 1
        version[j] += 1
        propose(np.array([x for x in (left[i], i) if x >= 0]))
    at = [i for i in range(n) if size[i]]
    return np.array([sym[i] for i in at], np.int32), np.array(at, np.int64)


def encode_units(m: Model, sym: np.ndarray, unit: np.ndarray, place: np.ndarray, key: np.ndarray, dropout: float):
    """Symbols of many units, given as their characters in a row; (symbols, unit, first character)."""
    done = []
    length = np.ones(len(sym), np.int64)

    def candidates(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = m.lookup(sym[i], sym[i + 1])
        rank[unit[i] != unit[i + 1]] = NONE
        at = np.flatnonzero(rank != NONE)
        rank[at[skipped(key[unit[i[at]]], place[i[at]], length[i[at]] + length[i[at] + 1], dropout)]] = NONE
        return rank, made

    rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        rank[:-1], made[:-1] = candidates(np.arange(len(sym) - 1))
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.minimum.reduceat(rank, first)
        count = np.diff(np.concatenate((first, [len(sym)])))
        each = np.repeat(best, count)
        over = each == NONE
        if 5 * np.count_nonzero(over) >= len(sym):  # a fifth at least, so that few rounds copy everything
            done.append((sym[over], unit[over], place[over]))
            stay = ~over
            sym, unit, place, length, rank, made, each = (x[stay] for x in (sym, unit, place, length, rank, made, each))
            continue
        hit = np.flatnonzero((rank == each) & ~over)
        hit = hit[np.concatenate(([True], unit[hit][1:] != unit[hit][:-1]))]  # the leftmost of each unit
        sym[hit], length[hit] = made[hit], length[hit] + length[hit + 1]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        at = (np.cumsum(keep) - 1)[hit]
        sym, unit, place, length, rank, made = (x[keep] for x in (sym, unit, place, length, rank, made))
        rank[at] = NONE
        mark = np.zeros(len(sym) + 1, bool)
        mark[at] = mark[at - 1] = True
        again = np.flatnonzero(mark[: len(sym) - 1])
        rank[again], made[again] = candidates(again)
        if len(sym):
            rank[-1] = NONE
    if not done:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, u, p = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(u, kind="stable")
    return s[order], u[order], p[order]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def stretches(m: Model, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, place, length) of all that may become a candidate in units of up to LONG characters, in order of units."""
    unit = np.flatnonzero(end - start <= LONG)
    at = ranges(start[unit], (end - start)[unit])
    unit = np.repeat(unit, (end - start)[unit])
    out = []
    for n in range(2, min(m.longest, LONG) + 1):
        room = at + n <= end[unit]
        at, unit = at[room], unit[room]
        if not len(at):
            break
        h = tx.range_hash(prefix, at, at + n)
        (i,) = np.nonzero(m.likely[h >> np.uint64(44)])
        i = i[m.piece[np.minimum(np.searchsorted(m.piece, h[i]), len(m.piece) - 1)] == h[i]]
        out.append((unit[i], at[i] - start[unit[i]], np.full(len(i), n)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    u, p, n = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(u, kind="stable")
    return u[order], p[order], n[order]


def alike(m: Model, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
    """A hash that is equal for units of the same text in which the same stretches are skipped; long units keep their key."""
    if dropout <= 0:
        return text
    _, first, back = np.unique(text, return_index=True, return_inverse=True)
    u, place, length = stretches(m, prefix, start[first], end[first])
    per = np.bincount(u, minlength=len(first))
    count = per[back]
    which = ranges((np.cumsum(per) - per)[back], count)
    skip = skipped(np.repeat(key, count), place[which], length[which], dropout)
    marks = np.zeros(len(which) + 1, np.uint64)
    np.cumsum(np.where(skip, tx.mix(which.astype(np.uint64) + np.uint64(1)), np.uint64(0)), out=marks[1:])
    ends = np.cumsum(count)
    return np.where(end - start <= LONG, tx.mix(text + tx.mix(marks[ends] - marks[ends - count])), key)


def encode_chunk(m: Model, texts: list[bytes], keys: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text)."""
    whole = [t.decode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer("".join(" " + t if t else "" for t in whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 if t else 0 for t in whole], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    space = raw == 0x20
    sym = m.char[raw]
    sym[raw == MARK] = -1
    sym[space] = m.char[MARK]
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    begin = np.concatenate(([True], (space[1:] & ~space[:-1]) | (doc[1:] != doc[:-1])))
    start = np.flatnonzero(begin)
    end = np.concatenate((start[1:], [len(raw)]))
    prefix = tx.prefix_hash(raw)
    text = tx.range_hash(prefix, start, end)
    inside = start - (np.cumsum(size) - size)[doc[start]]
    key = tx.mix(tx.mix(keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))[doc[start]] + inside.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    key = tx.mix(key + text)
    unique, at, back = np.unique(alike(m, prefix, start, end, text, key, dropout), return_index=True, return_inverse=True)
    key = key[at]
    count = (end - start)[at]
    parts = []
    short = np.flatnonzero(count <= LONG)
    if len(short):
        i = ranges(start[at[short]], count[short])
        unit = np.repeat(short, count[short])
        parts.append(encode_units(m, sym[i], unit, i - start[at[unit]], key, dropout))
    for u in np.flatnonzero(count > LONG):
        s, p = encode_long(m, sym[start[at[u]] : end[at[u]]], key[u], dropout)
        parts.append((s, np.full(len(s), u), p))
    s, u, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(u, kind="stable")
    s, u, p = s[order], u[order], p[order]
    # Symbols that are no pieces become bytes: those without an id, and parts of pieces.
    odd = np.flatnonzero((s < 0) | (s >= m.size))
    if len(odd):
        out = [chr(c).encode("utf-8", "surrogatepass") for c in raw[start[at[u[odd]]] + p[odd]]]
        out = [b if b != b" " else "▁".encode() for b in out]
        n = np.ones(len(s), np.int64)
        n[odd] = [len(b) for b in out]
        where = np.cumsum(n) - n
        s, u = np.repeat(s, n), np.repeat(u, n)
        s[ranges(where[odd], n[odd])] = m.byte[np.frombuffer(b"".join(out), np.uint8)]
    per = np.bincount(u, minlength=len(unique))
    first = np.cumsum(per) - per
    ids = s[ranges(first[back], per[back])].astype(np.int32)
    return ids, np.bincount(doc[start], weights=per[back], minlength=len(texts)).astype(np.int64)


def decode_chunk(m: Model, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of ids of several documents in a row."""
    size = m.length[ids]
    data = m.bytes[ranges(m.offset[ids], size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
    return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids (little-endian 32-bit piece ids), n_pieces, lossless (the ids decode to the very text)."""

    def work(batches):
        m = model_of(tokenizer)
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            keys = column(batch, "key").to_numpy(zero_copy_only=False)
            for first, some in tx.chunks(texts.to_pylist(), 2 * tx.CHUNK):
                found, counts = encode_chunk(m, some, keys[first : first + len(some)], seed, dropout)
                back = decode_chunk(m, found, counts)
                ends = np.cumsum(counts)
                null = texts.slice(first, len(some)).is_null().to_pylist()
                yield {
                    "doc_id": ids.slice(first, len(some)),
                    "ids": [None if z else found[e - c : e].astype("<i4").tobytes() for e, c, z in zip(ends, counts, null, strict=True)],
                    "n_pieces": counts, "lossless": [a == b for a, b in zip(some, back, strict=True)],
                }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("key"))
    return scan(rows, work, "doc_id long, ids binary, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and text of encoded documents."""

    def work(batches):
        m = model_of(tokenizer)
        for batch in batches:
            texts = []
            for x in column(batch, "ids").to_pylist():
                if x is None:
                    texts.append(None)
                else:
                    ids = np.frombuffer(x, "<i4")
                    texts.append(decode_chunk(m, ids, np.array([len(ids)]))[0].decode("utf-8", "surrogatepass"))
            yield {"doc_id": column(batch, "doc_id"), "text": texts}

    return scan(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "lossless")
