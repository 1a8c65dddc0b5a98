"""Best-fit packing of tokenized documents into sequences.

Whole documents are tokenized once. Only documents longer than the capacity are cut, into pieces of the
capacity; the last piece may be shorter. The plan depends on nothing but how many pieces
have each length, so the driver sees at most ``capacity`` counts however many rows there are, and
solves the packing on runs of equal bins:

1. Pieces over half of the capacity open a sequence each. Pieces over a third and up to a half are matched to
   them greedily, fullest sequence first, each with the largest piece that fits; those left over are paired with
   each other. No sequence holds more than two pieces over a third.
2. Smaller pieces, longest first, go to the fullest sequence that still has room; a new one is opened only if
   there is none.

Rows are then numbered within their length (by hashed buckets, so that a length that many rows share is
spread over tasks) and look up their place in the plan.

A null text is an empty document: one end token. Repeated rows and ids are documents of their own; of pieces of one length, the order of their keys and places decides who
goes where. Very long texts are encoded whole and cut. Other columns are not read, so their names may be any. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.frames import lean, load, small_batches
from strandweave.llm.textscan import slices, text_of
from strandweave.plans.staging import cut

CAPACITY = 4096
END_ID = 1
CACHE_PARTS = 300_000
CACHE_WHOLE = 50_000
SLICE = 2 << 20
JOINED = 64
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
_LATER = re.compile("[^\0-\u024f]")
_BOUND = np.uint32(0xFFFFFFFF)


class WordEncoder:
    """Ids of texts, each distinct word of a batch once.

    The tokenizer's normalizer and splitter never look across white space, so the ids of a text are those of its
    words in turn. Words in plain letters are split by the tokenizer's own pattern, and parts seen before are looked
    up; new ones are encoded many at a time, as each ends with an id of an end piece. Other words are encoded whole.
    Both tables are emptied when full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.whole: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, ``JOINED`` of them in one text."""
        found = self.tokenizer.encode_batch_fast([" ".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)], add_special_tokens=False)
        ids = np.array([i for x in found for i in x.ids], "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(ends) != len(parts):  # a part that is several, or none, to the tokenizer
            return self._each(parts)
        body, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [body[a:b] for a, b in zip(at, at[1:])]

    def _look_up(self, parts: list[str]) -> bytes:
        known = self.parts
        wanted = set(parts)
        wanted.discard("\n")
        new = list(wanted.difference(known))
        if len(known) + len(new) > CACHE_PARTS:
            known.clear()
            new = list(wanted)
        known["\n"] = _BOUND.tobytes()
        known.update(zip(new, self._encode(new), strict=True))
        return b"".join(map(known.__getitem__, parts))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and the bounds of each."""
        letters, split, whole = [], [], []
        for i, w in enumerate(words):
            if w.isalpha():  # ASCII letters only
                letters.append(i)
            elif w.isascii():
                (whole if b"<|" in w else split).append(i)
            else:
                t = w.decode("utf-8", "replace")
                (whole if _LATER.search(t) or "<|" in t or not unicodedata.is_normalized("NFC", t) else split).append(i)
        listed: list[str] = []
        if letters:
            for p in b"\n".join([words[i] for i in letters]).decode().lower().split("\n"):
                listed += (p, "\n")
        if split:
            listed += _PART.findall(b"\n".join([words[i] for i in split]).decode("utf-8", "replace").lower() + "\n")
        others = [words[i] for i in whole]
        new = list(set(others).difference(self.whole))
        if len(self.whole) + len(new) > CACHE_WHOLE:
            self.whole.clear()
            new = list(set(others))
        self.whole.update(zip(new, self._each([w.decode("utf-8", "replace") for w in new]), strict=True))
        end = _BOUND.tobytes()
        ids = np.frombuffer(self._look_up(listed) + b"".join([self.whole[w] + end for w in others]), "<u4")
        bound = np.flatnonzero(ids == _BOUND)
        size = np.diff(bound, prepend=-1) - 1
        order = np.array(letters + split + whole, np.int64)
        starts, ends = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[order], ends[order] = bound - size, bound
        return ids, np.stack((starts, ends))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``END_ID``, and the first place of each text and the end of the last."""
        split = pc.ascii_split_whitespace(texts)
        named = split.flatten().dictionary_encode()
        ids, (starts, ends) = self._words(named.dictionary.cast(pa.binary()).to_pylist())
        codes = np.asarray(named.indices)
        size = (ends - starts)[codes]
        to = np.cumsum(size)
        out = ids[np.arange(int(size.sum())) + np.repeat(starts[codes] - (to - size), size)]
        words = np.asarray(split.offsets, np.int64)[1:]
        words = words - int(split.offsets[0].as_py())
        closed = np.concatenate(([0], to))[words]
        return np.insert(out, closed, END_ID).astype("<u4"), np.concatenate(([0], closed + np.arange(1, len(closed) + 1)))


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32; ``tokenizer`` is a path that every executor has."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        for batch in slices(batches, text, SLICE):
            row, piece, start, length, crc = (array("q") for _ in range(5))
            ids, at = encoder.encode(text_of(batch, text))
            body, at = memoryview(ids).cast("B"), at.tolist()
            for i, (first, last) in enumerate(zip(at, at[1:])):
                for k, a in enumerate(range(first, last, capacity)):
                    b = min(a + capacity, last)
                    for column, v in zip((row, piece, start, length, crc), (i, k, a - first, b - a, zlib.crc32(body[4 * a : 4 * b])), strict=True):
                        column.append(v)
            rows = pa.array(np.frombuffer(row, np.int64) if len(row) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    kinds = docs.select(key).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        kinds = kinds.add(name, kind)
    return docs.select(key, text).mapInArrow(lean(run), kinds)


class _Bins:
    """Runs of equal bins by the room they have left."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.runs:
                self.runs[room] = []
                bisect.insort(self.rooms, room)
            self.runs[room].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run of the fullest bins with room for ``least``."""
        at = bisect.bisect_left(self.rooms, least)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            del self.rooms[at]
        return room, first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` items of each length.

    Rows (length, first rank, end rank, first bin, items per bin, offset): item r of that length is in bin
    first + (r - first rank) // per bin, at offset + (r - first rank) % per bin * length.
    """
    places, bins, made = [], _Bins(), 0
    half, third = capacity // 2, capacity // 3
    medium = sorted((x for x in counts if third < x <= half), reverse=True)
    left = {x: counts[x] for x in medium}
    used = dict.fromkeys(medium, 0)

    def put(length: int, first: int, n: int, per: int, offset: int) -> None:
        places.append((length, used[length], used[length] + n, first, per, offset))
        used[length] += n

    for length in sorted((x for x in counts if x > half), reverse=True):
        n, room = counts[length], capacity - length
        places.append((length, 0, n, made, 1, 0))
        at, made = made, made + n
        for x in medium:
            if x <= room and left[x] and n:
                t = min(n, left[x])
                put(x, at, t, 1, length)
                bins.add(room - x, at, t)
                at, n, left[x] = at + t, n - t, left[x] - t
        bins.add(room, at, n)
    open_at = 0  # length of the single piece in a bin that waits for its pair
    for x in medium:
        n = left[x]
        if open_at and n:
            put(x, made, 1, 1, open_at)
            bins.add(capacity - open_at - x, made, 1)
            made, n, open_at = made + 1, n - 1, 0
        if n >= 2:
            put(x, made, n // 2 * 2, 2, 0)
            bins.add(capacity - 2 * x, made, n // 2)
            made += n // 2
        if n % 2:
            put(x, made, 1, 1, 0)
            open_at = x
    if open_at:
        bins.add(capacity - open_at, made, 1)
        made += 1

    for length in sorted((x for x in counts if x <= third), reverse=True):
        n = counts[length]
        used[length] = 0
        while n:
            found = bins.take(length)
            if found is None:
                per = capacity // length
                whole = n // per
                found = (capacity, made, whole) if whole else (capacity, made, 1)
                made += found[2]
            room, first, m = found
            per = min(room // length, n)
            full = min(m, n // per)
            put(length, first, full * per, per, capacity - room)
            bins.add(room - per * length, first, full)
            bins.add(room, first + full, m - full)
            n -= full * per
    return places


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """``sequence_id`` and ``offset`` for each piece. ``cut_pieces`` is read three times."""
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # at most one row per length up to the capacity
    table = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    at = spark.sparkContext.broadcast(table)

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_pieces.withColumn("__b", F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), F.lit(buckets)))
    sums = rows.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("__l"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__b").orderBy(key, "piece", "ids_crc32")
    rows = rows.withColumn("__rank", F.row_number().over(within) - 1)
    rows = rows.join(sums, (F.col("length") == F.col("__l")) & (F.col("__b") == F.col("__c"))).withColumn("__rank", F.col("__rank") + F.col("__before"))
    names = [key, "piece", "start", "length", "ids_crc32"]

    def place(batches):
        t = at.value
        scale = int(t[:, 2].max()) + 1 if len(t) else 1
        wide = scale * (capacity + 1) >= 2**62
        keys = None if wide else t[:, 0] * scale + t[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            if wide:  # counts too great for one sort key
                k = np.empty(len(rank), np.int64)
                for x in np.unique(length):
                    lo, hi = np.searchsorted(t[:, 0], (x, x + 1))
                    own = length == x
                    k[own] = lo + np.searchsorted(t[lo:hi, 1], rank[own], "right") - 1
            else:
                k = np.searchsorted(keys, length * scale + rank, "right") - 1
            r = rank - t[k, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(t[k, 3] + r // t[k, 4]), pa.array(t[k, 5] + r % t[k, 4] * length)], names=[*names, "sequence_id", "offset"])

    kinds = cut_pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return rows.select(*names, F.col("__rank").cast("long")).mapInArrow(lean(place), kinds)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer or public_tokenizer("word_bpe_49k.json"), capacity)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
