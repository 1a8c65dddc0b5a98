"""Vectorised scans of Arrow string columns: words, lines and 64-bit hashes of them.

A word is ``[^\\x20\\x09-\\x0D]+``. Those separators are single bytes in UTF-8 and never part of
another character, so words are found on bytes. Hashes are multilinear: each element times
a fixed odd random factor of its place, summed modulo 2**64 and mixed, so they do not depend on the
process, the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # arrays of eight bytes for each of these are made, a dozen or so at a time
HASHED_BYTES = 1 << 20
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def factors(n: int, seed: int) -> np.ndarray:
    """The first n odd factors of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTES = mix(np.arange(256, dtype=_U) + _U(0x51ED270B0B1F39C7))
_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = factors(1 << 16, 1)


def places(n: int) -> np.ndarray:
    """Factors of the places in a word or line; as many as the longest of them needs."""
    global _PLACES
    if n > len(_PLACES):
        _PLACES = factors(1 << int(n - 1).bit_length(), 1)
    return _PLACES


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in even pieces of about ``limit`` bytes of text, never splitting a row."""
    for batch in batches:
        offsets = _offsets(text_of(batch, column))
        total = int(offsets[-1] - offsets[0])
        step = -(-total // max(1, round(total / limit)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    x = batch.column(batch.schema.get_field_index(column))
    x = x.cast(pa.string()) if not pa.types.is_string(x.type) else x
    return x.fill_null("") if x.null_count else x


def _offsets(x: pa.Array) -> np.ndarray:
    if not len(x):
        return np.zeros(1, np.int64)
    return np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each non-empty segment of bytes, for about ``HASHED_BYTES`` of them at a time."""
    out = np.empty(len(starts), _U)
    total = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HASHED_BYTES, "right")))
        out[at:to] = _segment_hash(data, starts[at:to], ends[at:to])
        at = to
    return out


def _segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    before = np.cumsum(size) - size
    j = np.arange(int(size.sum())) - np.repeat(before, size)
    with np.errstate(over="ignore"):
        v = _BYTES[data[j + np.repeat(starts, size)]] * places(int(size.max()))[j]
        return mix(np.add.reduceat(v, before) + size.astype(_U) * _U(0xD6E8FEB86659FD93))


class Scan:
    """Bytes, document bounds and words of the texts of one batch."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        off = _offsets(texts)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:n]))
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        #: words of document i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.off)
        self.is_word = word[1:-1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hash(self) -> np.ndarray:
        return segment_hash(self.data, self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.n_words)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sum over the words of each document."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and document of each window of ``width`` words."""
        n = np.maximum(self.n_words - width + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return np.repeat(self.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), doc


def window_hash(words: np.ndarray, at: np.ndarray, width: int, seed: int = 2) -> np.ndarray:
    """Hash of ``width`` word hashes from each of the places ``at``."""
    f = factors(width, seed)
    out = np.zeros(len(at), _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += words[at + k] * f[k]
    return mix(out)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key whether it occurs twice or more, and whether this is its first occurrence."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    last = np.ones(len(k), bool)
    last[:-1] = new[1:]
    many, first = np.empty(len(k), bool), np.empty(len(k), bool)
    many[order] = ~(new & last)
    first[order] = new
    return many, first
