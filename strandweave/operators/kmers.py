"""k-mer counting, quality thresholds and filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.seq import reverse_complement, windows
from strandweave.operators.superkmers import PIECES, SENT, chunks, cut_up, lean, meet, opened, packed, partitions, reversed_complement, sent

SOLID = 4
PACKED_K = 31
ROWS = 1 << 18
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = _CODE[list(b"acgt")] = range(4)
_BASE = np.frombuffer(b"ACGT", np.uint8)
_FOUR = np.ascontiguousarray(_BASE[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]).view(np.uint32).ravel()


def both_strands(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Each read and its reverse complement; no second scan of the input."""
    return reads.withColumn(seq, F.explode(F.array(F.col(seq), reverse_complement(seq))))


def kmer_rows(reads: DataFrame, k: int, seq: str = "seq", strands: bool = True, ambiguous: str = "drop") -> DataFrame:
    """A row per window. ``ambiguous``: 'drop' windows with letters other than bases, or 'keep' them."""
    rows = reads.where(F.length(seq) >= k).select(F.upper(seq).alias("seq"))
    rows = both_strands(rows) if strands else rows
    return rows.select(F.explode(windows("seq", k, "[ACGT]" if ambiguous == "drop" else ".")).alias("kmer"))


def letters_of(numbers: np.ndarray, k: int) -> np.ndarray:
    """A row of k letters for each number, looked up four at a time."""
    whole = (numbers.view(np.uint64) << np.uint64(64 - 2 * k)).astype(">u8").view(np.uint8).reshape(len(numbers), 8)
    return _FOUR[whole].view(np.uint8).reshape(len(numbers), 32)[:, :k]


def strings(letters: np.ndarray) -> pa.Array:
    """A string for each row of letters."""
    offsets = np.arange(len(letters) + 1, dtype=np.int32) * letters.shape[1]
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def unpacked(numbers: np.ndarray, k: int) -> pa.Array:
    """Strings of numbers."""
    return strings(letters_of(numbers, k))


def _count_packed(reads: DataFrame, k: int, seq: str, strands: bool, least: int = 1) -> DataFrame:
    """A k-mer and its reverse complement are counted as one number, in the bucket of their minimizer."""
    return spelled(packed_counts(reads, k, seq, strands, least), k, strands)


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each is there. Sorts in place."""
    numbers.sort()
    at = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else np.zeros(0, np.int64)
    return numbers[at], np.diff(np.append(at, len(numbers)))


def packed_counts(reads: DataFrame, k: int, seq: str = "seq", strands: bool = True, least: int = 1) -> DataFrame:
    """(p, n): how often each k-mer is there, as a number; with ``strands`` the lesser one of a k-mer and its reverse complement. Those below ``least`` are left out."""

    return counts_of(sent(reads.select(seq), k), k, strands, least)


def counts_of(going: DataFrame, k: int, strands: bool = True, least: int = 1) -> DataFrame:
    """As ``packed_counts``, of windows on their way."""

    def work(blobs):
        numbers, _, _ = opened(blobs, k)
        p, n = counted(np.minimum(numbers, reversed_complement(numbers, k)) if strands else numbers)
        if strands and k % 2 == 0:  # a k-mer that is its own reverse complement is on either strand
            kept = n * np.where(p == reversed_complement(p, k), 2, 1) >= least
        else:
            kept = n >= least
        p, n = p[kept].view(np.int64), n[kept]
        for at in range(0, len(p), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(p[at : at + ROWS]), pa.array(n[at : at + ROWS])], names=["p", "n"])

    return meet(going, work, "p long, n long")


def spelled(counts: DataFrame, k: int, strands: bool = True) -> DataFrame:
    """(kmer, cnt) of (p, n), of both strands if they were counted as one."""

    def spell(batches):
        for batch in batches:
            p, n = (np.asarray(c) for c in batch.columns)
            if not strands:
                yield pa.RecordBatch.from_arrays([unpacked(p, k), pa.array(n)], names=["kmer", "cnt"])
                continue
            back = reversed_complement(p.view(np.uint64), k).view(np.int64)
            same = back == p  # its own reverse complement, on either strand
            yield pa.RecordBatch.from_arrays([unpacked(p, k), pa.array(np.where(same, 2 * n, n))], names=["kmer", "cnt"])
            yield pa.RecordBatch.from_arrays([unpacked(back[~same], k), pa.array(n[~same])], names=["kmer", "cnt"])

    return counts.mapInArrow(spell, "kmer string, cnt long")


def count_kmers(reads: DataFrame, k: int, seq: str = "seq", strands: bool = True, ambiguous: str = "drop", least: int = 1) -> DataFrame:
    """(kmer, cnt) of the k-mers with a count of at least ``least``.

    Up to ``PACKED_K`` bases travel in runs of windows, two bits a base; longer k-mers, or such with other letters, as strings, partly summed before
    the shuffle. Lower case counts as upper case.
    """
    if k <= PACKED_K and ambiguous == "drop":
        return _count_packed(reads, k, seq, strands, least)
    return kmer_rows(reads, k, seq, strands, ambiguous).groupBy("kmer").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def kmer_stats(counts: DataFrame, least: int = SOLID) -> DataFrame:
    """Mean and population deviation of the counts of at least ``least``; null if there are none."""
    solid = F.when(F.col("cnt") >= least, F.col("cnt").cast("double"))
    return counts.agg(F.avg(solid).alias("mean"), F.stddev_pop(solid).alias("stddev"))


def frequent(counts: DataFrame, threshold: int = 1) -> DataFrame:
    return counts.where(F.col("cnt") > threshold)


def quality_thresholds(reads: DataFrame, qual: str = "qual") -> DataFrame:
    """Thresholds of a window's mean and least quality: 0.9 and 0.8 times the whole-number mean over all letters."""

    def sums(batches):
        for data, bounds, rows in chunks(batches):
            ends = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))[bounds]
            yield pa.RecordBatch.from_arrays([pa.array([int(ends[-1] - ends[0])]), pa.array([len(data)])], names=["total", "n"])

    mean = F.floor(F.sum("total") / F.sum("n"))
    reads = reads.select(qual).mapInArrow(sums, "total long, n long")
    return reads.agg((mean * F.lit(0.9)).alias("avg_threshold"), (mean * F.lit(0.8)).alias("min_threshold"))


def quality_windows(reads: DataFrame, k: int, avg_threshold: Column, min_threshold: Column, seq: str = "seq", qual: str = "qual", keep: tuple = ()) -> DataFrame:
    """Windows (kmer, at) whose whole-number mean and least quality reach the thresholds and that have bases only; ``at`` counts from 1.

    Thresholds are literals or columns of the reads. Sums and least values of windows come from one pass over a batch of reads.
    """
    rows = reads.where(F.length(seq) >= k).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(seq).alias("s"), F.col(qual).alias("q"), avg_threshold.cast("double").alias("a"), min_threshold.cast("double").alias("m"))
    kinds = ", ".join([*(f"k{i} {reads.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "at long, kmer string"])
    names = [*(f"k{i}" for i in range(len(keep))), "at", "kmer"]

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i, (s, q, a, m) in enumerate(zip(*(columns[c].to_pylist() for c in "sqam"), strict=True)):
                codes, v = _CODE[np.frombuffer(s.upper().encode(), np.uint8)], np.frombuffer(q.encode(), np.uint8)
                if len(codes) != len(s) or len(v) < len(s):  # letters beyond ASCII, or no quality for each
                    continue
                total = np.concatenate(([0], np.cumsum(v[: len(s)], dtype=np.int64)))
                bad = np.concatenate(([0], np.cumsum((codes > 3) | (v[: len(s)] < m))))
                at = np.flatnonzero(((total[k:] - total[:-k]) // k >= a) & (bad[k:] == bad[:-k]))
                if len(at):
                    letters = _BASE[codes[at[:, None] + np.arange(k)]]
                    offsets = np.arange(len(at) + 1, dtype=np.int32) * k
                    held = [pa.array([columns[f"k{j}"][i].as_py()] * len(at), columns[f"k{j}"].type) for j in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(at + 1), pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters))], names=names)

    return rows.mapInArrow(run, kinds).toDF(*keep, "at", "kmer")


def _sent_good(reads: DataFrame, k: int, avg_threshold: Column, min_threshold: Column) -> DataFrame:
    """The windows that pass on their way, in runs. Sums of qualities come from one pass over a stretch of reads."""
    parts = partitions(reads)
    plain = (F.octet_length("seq") == F.length("seq")) & (F.octet_length("q") == F.length("seq"))  # else a read has letters beyond ASCII, or no quality for each
    rows = reads.where(F.length("seq") >= k).select(avg_threshold.cast("double").alias("a"), min_threshold.cast("double").alias("m"), F.substring("qual", F.lit(1), F.length("seq")).alias("q"), "seq").where(plain)

    def run(batches):
        for data, bounds, rows in chunks(batches):
            v = np.frombuffer("".join(rows.column(2).to_pylist()).encode(), np.uint8)
            each = np.diff(bounds)
            a, m = (np.repeat(np.asarray(rows.column(i).fill_null(np.nan)), each) for i in (0, 1))
            total = np.concatenate(([0], np.cumsum(v, dtype=np.int64)))
            low = np.concatenate(([0], np.cumsum(v < m, dtype=np.int32)))
            allowed = ((total[k:] - total[:-k]) // k >= a[: len(v) - k + 1]) & (low[k:] == low[:-k])
            codes, start, n, bucket = cut_up(data, bounds[:-1], k, parts * PIECES, allowed=allowed)
            yield from packed(codes, start, n, bucket, k, parts)

    return rows.mapInArrow(lean(run), SENT)


def count_good_kmers(reads: DataFrame, k: int, avg_threshold: Column, min_threshold: Column, strands: bool = True) -> DataFrame:
    """(kmer, cnt) of the windows of (seq, qual) that pass both thresholds; a window and its reverse complement have the same qualities."""
    if k <= PACKED_K:
        return spelled(counts_of(_sent_good(reads, k, avg_threshold, min_threshold), k, strands), k, strands)
    rows = quality_windows(reads, k, avg_threshold, min_threshold).select("kmer")
    rows = rows.select(F.explode(F.array(F.col("kmer"), reverse_complement("kmer"))).alias("kmer")) if strands else rows
    return rows.groupBy("kmer").agg(F.count("*").alias("cnt"))
