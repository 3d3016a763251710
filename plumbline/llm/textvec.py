"""Vectorised text primitives over Arrow string columns (numpy on the UTF-8 bytes, no per-word Python).

A word is a maximal run of ASCII letters and digits and of bytes from 0x80, with A-Z lower-cased. Every function takes
the bytes of many documents at once and document offsets into them; no word crosses a document boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    base = int(offs[0]) if len(offs) else 0
    end = int(offs[-1]) if len(offs) else 0
    raw = np.frombuffer(data, np.uint8)[base:end] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - base


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each has about `limit` bytes (a single longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffer(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of data[s:e] for every pair."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * power[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


class Words:
    """Words of a chunk: hash, byte range and per-document offsets (`first[i]:first[i + 1]` are those of document i)."""

    __slots__ = ("ends", "first", "hashes", "starts")

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = LOWER[data]
        inside = IS_WORD[low]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            cut = offs[offs < len(data)]
            before[cut] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
            cut = offs[offs > 0] - 1
            after[cut] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.hashes = range_hashes(low, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offs)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of n consecutive words inside one document, and offsets of each document's run."""
    h, first = words.hashes, words.first
    counts = np.maximum(np.diff(first) - n + 1, 0)
    out_first = np.concatenate([[0], np.cumsum(counts)])
    if len(h) < n:
        return np.zeros(0, np.uint64), out_first
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = g * np.uint64(0x100000001B3) + h[k : len(h) - n + 1 + k]
    g = mix(g)
    at = ragged(first[:-1], counts)
    return g[at], out_first


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + shift


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], zero for an empty range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]
