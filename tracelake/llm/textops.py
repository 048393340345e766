"""Vectorised byte-level text helpers that run inside Spark tasks.

Everything works on chunks of documents (about ``CHUNK`` bytes at a time), so the
memory of a worker is bounded by a chunk or by the longest single text, never by
a batch. Hashes are 64-bit; wherever a hash decides equality of different texts
the caller either verifies the text itself or uses two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 18

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POW[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _POW[k] = out
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a hash are usable."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of buf[i:j], scaled by base**i."""
    power, _ = _powers(len(buf) + 1)
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each buf[start:end]; equal strings of a chunk or of two chunks get equal hashes."""
    _, inverse = _powers(len(prefix))
    x = (prefix[end] - prefix[start]) * inverse[start]
    return mix(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def _mask(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: Word bytes: all but ASCII white space, or ASCII letters, digits and everything outside ASCII.
NOT_SPACE = ~_mask((0x20, 0x20), (0x09, 0x0D))
ALNUM = _mask((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def as_bytes(text) -> bytes:
    """UTF-8 bytes of a text; null gives none."""
    if text is None:
        return b""
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def chunks(texts: Iterable, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as (index of the first, bytes of each), about ``size`` bytes together."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(as_bytes(text))
        total += len(held[-1])
        if total >= size:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


class Words:
    """The words of a chunk: hash, position of each word, and the document of each word.

    ``offset[d]:offset[d + 1]`` are the words of document ``d`` of the chunk. Each
    document is followed by one separator byte, so that no word spans two.
    """

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, lower: bool = True):
        self.data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        inside = word_bytes[self.buf]
        lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            change = np.concatenate(([0], change))
        self.start, self.end = change[0::2], change[1::2]
        self.hash = range_hash(prefix_hash(self.buf), self.start, self.end)
        self.offset = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offset))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


_GRAM = [np.uint64(pow(0xA0761D6478BD642F | 1, k + 1, 1 << 64)) for k in range(64)]


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; ``len(words) - n + 1`` of them, runs across documents included."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m] * _GRAM[0]
    for k in range(1, n):
        out = out + words[k : k + m] * _GRAM[k]
    return mix(out + np.uint64(n))


def to_signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed long, the type that Spark has."""
    return x.view(np.int64)
