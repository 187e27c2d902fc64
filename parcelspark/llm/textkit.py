"""Batch text helpers in numpy, shared by the operators that run inside Arrow tasks.

A batch of texts is laid out as one UTF-8 byte buffer. Word bounds and 64-bit word hashes come
from whole-buffer array operations, so no Python code runs per word. Words are maximal runs of
bytes other than space and 0x09-0x0D, which on UTF-8 equals the same rule on code points.

The hash of a byte range is a polynomial hash mod 2**64 over random byte codes, read from prefix
sums and finalised by a multiply-xorshift mixer. Equal ranges get equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
BATCH_BYTES = 1 << 20     # texts are processed in buffers of about this size (one long text: its own)


def mix64(x: np.ndarray) -> np.ndarray:
    """Multiply-xorshift finaliser (bijective on 64 bits)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers of ``seed``."""
    return mix64(mix64(np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(0x100000001)) + U64(seed))


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_CODE = constants(11, 256)
BYTE_CODE_FOLDED = BYTE_CODE.copy()
BYTE_CODE_FOLDED[65:91] = BYTE_CODE[97:123]          # A-Z hash as a-z
BASE = U64(0xA24BAED4963EE407)                       # odd, so it has an inverse mod 2**64
BASE_INV = U64(pow(0xA24BAED4963EE407, -1, 1 << 64))

_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (kept per process, grown by doubling)."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, BASE_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Tokens:
    """Words of a batch of texts: byte ranges in ``buf`` and the range of words of each text."""

    buf: np.ndarray
    doc_start: np.ndarray      # byte range of each text
    doc_end: np.ndarray
    start: np.ndarray          # byte range of each word
    end: np.ndarray
    first: np.ndarray          # words first[i]:first[i + 1] belong to text i

    @property
    def n_docs(self) -> int:
        return len(self.doc_start)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


def tokenize(texts: list[bytes], between: np.ndarray = IS_SPACE) -> Tokens:
    """Words of the texts: maximal runs of bytes outside the table ``between`` (newline must be in it)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    doc_end = np.cumsum(lengths + 1) - 1
    doc_start = doc_end - lengths
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = between[buf]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    first = np.append(np.searchsorted(start, doc_start), len(start))
    return Tokens(buf, doc_start, doc_end, start, end, first)


class RangeHash:
    """64-bit hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray, folded: bool = False):
        codes = (BYTE_CODE_FOLDED if folded else BYTE_CODE)[buf]
        up, self.down = powers(len(buf) + 1)
        codes *= up[: len(buf)]
        self.prefix = np.empty(len(buf) + 1, dtype=U64)
        self.prefix[0] = 0
        np.cumsum(codes, out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.down[start]
        return mix64(raw + (end - start).astype(U64))


def ngram_hashes(words: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``n`` words (length len(words) - n + 1, at least 0)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, dtype=U64)
    factors = constants(seed, n) | U64(1)
    total = words[:size] * factors[0]
    for j in range(1, n):
        total = total + words[j:j + size] * factors[j]
    return mix64(total + U64(n))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text: runs of ``n`` words; the whole sequence as one
    shingle when there are fewer words; empty without words."""
    if len(words) == 0:
        return np.empty(0, dtype=U64)
    grams = np.sort(ngram_hashes(words, min(n, len(words))))
    keep = np.empty(len(grams), dtype=bool)
    keep[0] = True
    np.not_equal(grams[1:], grams[:-1], out=keep[1:])
    return grams[keep]


def byte_batches(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` bytes each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def arrow_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null reads as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    binary = pc.fill_null(column, "").cast(pa.large_binary())
    return binary.to_pylist()
