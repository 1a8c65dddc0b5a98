"""Meeting of equal 64-bit keys from many tasks.

Each task sorts the keys of a stretch of its rows, keeps one of those that are equal within the stretch, and ships the
rest as packed columns, a blob per range of keys. A task that owns some ranges then sees, range by
range, all keys in them. As equal keys of a stretch travel once, a key that a third of all rows hold is no more
than one row per stretch.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.frames import lean

BLOBS = "bucket int, blob binary"
PIECE = 250_000
_U = np.uint64
_ARROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def buckets_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that those that vary little compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(raw.T).view(kind).reshape(n), at + n * size


def pack(columns: list[np.ndarray]) -> bytes:
    kinds = "".join({8: "q", 4: "i", 2: "h", 1: "b"}[c.itemsize] for c in columns).encode()
    return struct.pack("<iB", len(columns[0]) if columns else 0, len(columns)) + kinds + b"".join(map(_planes, columns))


def unpack(blob: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<iB", blob)
    at, out = 5 + k, []
    for c in blob[5 : 5 + k]:
        x, at = _unplanes(blob, at, n, {113: "<i8", 105: "<i4", 104: "<i2", 98: "<i1"}[c])
        out.append(x)
    return out


def blobs(key: np.ndarray, columns: list[np.ndarray], buckets: int, owner: np.ndarray | None = None, table: tuple = ()) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and cut into ranges; the key is a uniformly spread unsigned 64-bit number.

    ``table`` holds further columns, which rows share: row i has those at ``owner[i]``; a blob holds each only once.
    """
    order = np.argsort(key)
    key = key[order]
    bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(bounds))
    sorted_columns = [key.view(np.int64), *(c[order] for c in columns)]
    owner = owner[order] if owner is not None else None
    step = 16
    for a in range(0, len(full), step):
        some, packed = full[a : a + step], []
        for b in some:
            part = slice(bounds[b], bounds[b + 1])
            own = [c[part] for c in sorted_columns]
            if owner is not None:
                used, at = np.unique(owner[part], return_inverse=True)
                own.append(at.astype(np.int16 if len(used) < 2**15 else np.int32))
                shared = pack([t[used] for t in table])
            else:
                shared = b""
            rows = pack(own)
            packed.append(struct.pack("<i", len(rows)) + rows + shared)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], schema=_ARROW)


def parts(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of a blob (the last one of places in its table, if it has one), and its table."""
    n = struct.unpack_from("<i", blob)[0]
    return unpack(blob[4 : 4 + n]), unpack(blob[4 + n :]) if len(blob) > 4 + n else []


def opened(blob: bytes) -> list[np.ndarray]:
    """Columns of a blob, those of its table last."""
    columns, table = parts(blob)
    if table:
        at = columns.pop()
        columns += [t[at] for t in table]
    return columns


def pieces(blobs: list[bytes], limit: int = PIECE, tags: list[int] | None = None) -> Iterator[list[np.ndarray]]:
    """The columns of the blobs of a range together, those of tables last, in pieces of about ``limit`` rows; equal keys are in one piece.

    With ``tags``, a number for each blob, a last column has that of each row. The blobs are taken out of their list as they are opened, and rows wait as they
    are in there, so beyond these only a piece takes memory.
    """
    held = []
    for i in range(len(blobs)):
        held.append(parts(blobs[i]))
        blobs[i] = None
    keys = [c[0].view(_U) for c, _ in held]
    k = -(-sum(map(len, keys)) // limit)
    some = np.sort(np.concatenate([x[::64] for x in keys]))
    cuts = np.unique(some[np.arange(1, k) * len(some) // k]) if k > 1 else some[:0]
    edges = [np.concatenate(([0], np.searchsorted(x, cuts), [len(x)])) for x in keys]
    for i in range(len(cuts) + 1):
        found = []
        for k, ((columns, table), e) in enumerate(zip(held, edges, strict=True)):
            part = slice(e[i], e[i + 1])
            if part.start == part.stop:
                continue
            own = columns[:-1] if table else columns
            tag = [np.full(part.stop - part.start, tags[k])] if tags is not None else []
            found.append([c[part] for c in own] + [t[columns[-1][part]] for t in table] + tag)
        if found:
            yield [np.concatenate(c) for c in zip(*found, strict=True)]


def dealt(sent: DataFrame, *order: str) -> DataFrame:
    """Range b in partition b."""
    return sent.repartitionById(buckets_of(sent), "bucket").sortWithinPartitions("bucket", *order)


def meet(sent: DataFrame, work: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``work`` on the columns of each range of keys, a piece of it at a time; all rows of a key come together."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at and held:
                    for columns in pieces(held):
                        yield from work(columns)
                    held = []
                at = b
                held.append(blob)
        for columns in pieces(held) if held else ():
            yield from work(columns)

    return dealt(sent).mapInArrow(lean(run), schema)


class Membership:
    """A bitmap of ids that are hashes themselves: never misses one, and may let others through.

    Its size is at most ``MAX_BITS``, however many ids there are; beyond that it lets more through.
    """

    MAX_BITS = 1 << 26

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def shifts() -> tuple[int, int, int]:
        return 0, 19, 38

    @classmethod
    def of(cls, ids: DataFrame, column: str) -> "Membership":
        n = ids.count()
        bits = 1 << min(cls.MAX_BITS.bit_length() - 1, max(12, int(12 * n + 1).bit_length()))
        places = F.array(*[F.shiftrightunsigned(F.col(column), k).bitwiseAND(F.lit(bits - 1)) for k in cls.shifts()])
        one = ids.select(F.explode(places).alias("p"))
        found = one.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()  # at most MAX_BITS / 64 rows of 16 bytes
        words = np.zeros(bits // 64, np.int64)
        words[np.asarray(found.column(0))] = np.asarray(found.column(1))
        return cls(words.view(_U))

    def has(self, ids: np.ndarray) -> np.ndarray:
        x = np.asarray(ids).view(_U) if np.asarray(ids).dtype != _U else ids
        out = np.ones(len(x), bool)
        mask = _U(64 * len(self.words) - 1)
        for k in self.shifts():
            p = (x >> _U(k)) & mask
            out &= (self.words[(p >> _U(6)).astype(np.int64)] >> (p & _U(63)) & _U(1)).astype(bool)
        return out
