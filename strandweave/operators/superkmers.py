"""Meeting of equal k-mers without a row for each.

Neighbouring windows mostly share the least of their m-mers by a hash (a minimizer, taken on either strand). A run of such windows
travels as one stretch of bases, two bits each, to the bucket of its minimizer: about a byte for a window. A k-mer and
its reverse complement have the same minimizer, so all places of both meet in one bucket.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "part int, bucket int, blob binary"
_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
PIECES = 8  # buckets of a partition, opened one after the other
CHUNK = 4 << 20
_UPPER = np.full(256, 4, np.uint8)
_UPPER[list(b"ACGT")] = range(4)
_CODE = _UPPER.copy()
_CODE[list(b"acgt")] = range(4)
_U = np.uint64


def rolled(codes: np.ndarray, k: int, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Each window of k codes as a number, forward and as its reverse complement, built from windows of half the width."""
    one, width = codes.astype(kind), 1
    other = kind(3) - one
    first, last_other = one, other
    for bit in bin(k)[3:]:
        n, s = len(one) - width, kind(2 * width)
        one, other = (one[:n] << s) | one[width:], other[:n] | (other[width:] << s)
        width *= 2
        if bit == "1":
            n, s = len(one) - 1, kind(2 * width)
            one, other = (one[:n] << kind(2)) | first[width : width + n], other[:n] | (last_other[width : width + n] << s)
            width += 1
    return one, other


def reversed_complement(v: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the reverse complements of k-mers."""
    x = (~v).byteswap()
    a, b = _U(0x0F0F0F0F0F0F0F0F), _U(0x3333333333333333)
    x = ((x & a) << _U(4)) | ((x >> _U(4)) & a)
    x = ((x & b) << _U(2)) | ((x >> _U(2)) & b)
    return x >> _U(64 - 2 * k)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (w - width)], h[w - width :]) if width < w else h


def cut_up(data: np.ndarray, bounds: np.ndarray, k: int, buckets: int, table: np.ndarray = _CODE, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, start, n, bucket) of the runs of windows within each of the strings that ``bounds`` begin; windows with letters other than bases are left out, and those that are not ``allowed``."""
    codes = table[data]
    none = np.zeros(0, np.int64)
    if len(codes) < k:
        return codes, none, none, none
    m = min(k, 13 if k > 24 else 11)
    run = np.zeros(len(codes), np.int32)  # a window must not go over a bound
    np.add.at(run, bounds[bounds < len(codes)], 1)
    run = np.cumsum(run, dtype=np.int32)
    good = run[: len(codes) - k + 1] == run[k - 1 :]
    if codes.max() > 3:
        bad = np.concatenate(([0], np.cumsum(codes > 3, dtype=np.int32)))
        good &= bad[k:] == bad[:-k]
        codes = codes & 3
    if allowed is not None:
        good &= allowed
    one, other = rolled(codes, m, np.uint32)
    least = _least(np.minimum(one, other) * np.uint32(0x9E3779B1), k - m + 1)
    new = np.empty(len(good), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= good[1:] != good[:-1]
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(good)))
    kept = good[start]
    start, n = start[kept], n[kept]
    mixed = least[start].astype(_U) * _U(0xD6E8FEB86659FD93)
    bucket = ((mixed >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    return codes, start, n, bucket


def places(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def packed(codes: np.ndarray, start: np.ndarray, n: np.ndarray, bucket: np.ndarray, k: int, parts: int, columns: list[np.ndarray] = []) -> Iterator[pa.RecordBatch]:  # noqa: B006
    """A blob for each bucket: how many windows its runs have, further columns of theirs, and the bases."""
    if not len(start):
        return
    order = np.argsort(bucket, kind="stable")
    start, n, bucket = start[order], n[order], bucket[order]
    columns = [c[order] for c in columns]
    wide = np.concatenate((codes, np.zeros(4, np.uint8)))
    four = (wide[:-4] << 6) | (wide[1:-3] << 4) | (wide[2:-2] << 2) | wide[3:-1]
    size = (n + k + 2) // 4
    at = np.repeat(start, size) + 4 * places(size)
    bases, ends = four[at], np.concatenate(([0], np.cumsum(size)))
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    kinds = "".join(c.dtype.char for c in columns).encode()
    for lo in range(0, len(edges) - 1, 64):
        some = edges[lo : lo + 65]
        blobs = [struct.pack("<ib", b - a, len(columns)) + kinds + b"".join(_planes(c[a:b]) for c in (n.astype(np.int32), *columns)) + bases[ends[a] : ends[b]].tobytes() for a, b in zip(some[:-1], some[1:], strict=True)]
        own = bucket[some[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(own % parts, pa.int32()), pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], schema=_ARROW)


def opened(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(numbers, n, columns) of the blobs of a bucket: its windows as numbers, one run after the other, how many each run has, and the columns of the runs."""
    counts, held, bases = [], [], []
    for blob in blobs:
        rows, c = struct.unpack_from("<ib", blob)
        kinds, at, found = blob[5 : 5 + c].decode(), 5 + c, []
        for kind in "i" + kinds:
            size = np.dtype(kind).itemsize
            raw = np.frombuffer(blob, np.uint8, rows * size, at).reshape(size, rows)
            found.append(np.ascontiguousarray(raw.T).view(kind).reshape(rows))
            at += rows * size
        counts.append(found[0])
        held.append(found[1:])
        bases.append(np.frombuffer(blob, np.uint8, len(blob) - at, at))
    n = np.concatenate(counts).astype(np.int64)
    size = (n + k + 2) // 4
    raw = np.concatenate([*bases, np.zeros(16, np.uint8)])
    words = np.ndarray((len(raw) - 8,), ">u8", raw.tobytes(), strides=(1,)).astype(_U)
    j = places(n)
    at = np.repeat(np.cumsum(size) - size, n) + (j >> 2)
    shift = ((j & 3) * 2).astype(_U)
    numbers = ((words[at] << shift) | (raw[at + 8].astype(_U) >> (_U(8) - shift))) >> _U(64 - 2 * k)
    return numbers, n, [np.concatenate(c) for c in zip(*held, strict=True)]


def chunks(batches, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(bytes, bounds, rows) of the strings in the last column, about ``limit`` bytes at a time; a longer string comes alone."""
    for batch in batches:
        x = batch.column(batch.num_columns - 1).cast(pa.string()).fill_null("")
        off = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) if len(x) else np.zeros(1, np.int64)
        raw, at = x.buffers()[2], 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield (np.frombuffer(raw, np.uint8)[off[at] : off[to]] if raw is not None else np.zeros(0, np.uint8)), off[at : to + 1] - off[at], batch.slice(at, to - at)
            at = to


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving memory back when a task ends."""

    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sent(rows: DataFrame, k: int, tagged: Callable | None = None) -> DataFrame:
    """The windows of the last column of ``rows`` on their way; ``tagged(rows, owner, at)`` gives columns of the runs from the row that each is in and its place there, and then only upper-case letters are bases."""
    parts = partitions(rows)

    def run(batches):
        for data, bounds, batch in chunks(batches):
            codes, start, n, bucket = cut_up(data, bounds[:-1], k, parts * PIECES, _UPPER if tagged else _CODE)
            owner = np.searchsorted(bounds[:-1], start, "right") - 1
            yield from packed(codes, start, n, bucket, k, parts, tagged(batch, owner, start - bounds[owner]) if tagged else [])

    return rows.mapInArrow(lean(run), SENT)


def meet(going: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str, named: bool = False) -> DataFrame:
    """``work`` on the blobs of each bucket, and on its number if ``named``."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            for b, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != at and held:
                    yield from work(held, at) if named else work(held)
                    held = []
                at = b
                held.append(blob)
        if held:
            yield from work(held, at) if named else work(held)

    return going.repartitionById(partitions(going), "part").sortWithinPartitions("bucket").mapInArrow(lean(run), schema)
