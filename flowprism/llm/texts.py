"""Whole texts as numpy arrays: words, exact codes of words, word hashes and hashes of word spans.

Tasks get Arrow batches from Spark; texts are worked on in chunks of a few MB of UTF-8, never cut
inside a document. Words are ``[^\\x20\\x09-\\x0D]+``. Equality inside a chunk is decided on bytes (``codes`` and
``paired``). Across tasks a word is its 64-bit SipHash-2-4, the same on every machine, and a span of words is named
by mixing the names of the two blocks of 2^k words that cover it: no sums, so no order of words cancels out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
_WORD_KEY = "flowprism-words0"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


@dataclass
class Chunk:
    """Documents ``at``..``at + n`` of a batch: their bytes, and where each begins."""

    at: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A text column in runs of whole documents of about ``limit`` bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a chunk: byte spans, and for each document the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(chunk: Chunk) -> Words:
    data, n = chunk.data, len(chunk.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(chunk.n + 1, np.int64))
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    edge[0] = edge[n] = True
    begins = edge[:n].copy()
    begins[1:] |= ~solid[:-1]
    stops = edge[1:].copy()
    stops[:-1] |= ~solid[1:]
    starts = np.flatnonzero(solid & begins)
    ends = np.flatnonzero(solid & stops) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets))


def codes(chunk: Chunk, words: Words, data: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """For each word (or other byte span, none of which overlap) the index of its bytes among the distinct ones."""
    data = chunk.data if data is None else data
    if not len(words):
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    edges = np.zeros(len(data) + 1, np.int8)
    edges[words.starts] += 1
    edges[words.ends] -= 1
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    body = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def hash_bytes(distinct: pa.Array) -> np.ndarray:
    """SipHash-2-4 of each byte string."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), hash_key=_WORD_KEY, categorize=False).astype(np.uint64, copy=False)


def word_hashes(chunk: Chunk, words: Words, data: np.ndarray | None = None) -> np.ndarray:
    """A hash for each word, computed once for each distinct word of the chunk."""
    at, distinct = codes(chunk, words, data)
    return hash_bytes(distinct)[at]


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Codes of the pairs of two code columns: equal exactly where both are (codes are below 2^32)."""
    return pd.factorize((left.astype(np.uint64) << U(32)) | right.astype(np.uint64))[0]


class Spans:
    """Hashes of any spans ``[i, j)`` of a sequence of hashes.

    Level k names every block of 2^k places by its two halves. A span is named by its length and the two
    blocks of the largest level that cover it, from its start and to its end.
    """

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        self.levels = [mix(hashes + mix(np.array([salt + 1], np.uint64)))]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mix(mix(below[: max(0, len(below) - half)]) + below[half:]))
        return self.levels[k]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        length = j - i
        out = mix(length.astype(np.uint64))
        size = np.frexp(length.astype(np.float64))[1] - 1
        for k in np.unique(size[length > 0]).tolist():
            own, block = size == k, self.level(k)
            out[own] = mix(mix(block[i[own]] + out[own]) + block[j[own] - (1 << k)])
        return out


def inside(words: Words, length: int) -> np.ndarray:
    """Start indices of the windows of ``length`` words that lie in one document."""
    last = np.repeat(words.first[1:], words.counts)
    at = np.arange(len(words))
    return at[at + length <= last]
