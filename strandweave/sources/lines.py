"""Text files as numbered lines, and FASTQ records from them; both split large files over tasks.

A first scan counts the lines of each block of a file that Spark deals to a task; running sums of these say with which line of its
file a block begins. The sums are one row per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions.seq import trim

MOST_BLOCKS = 1_000_000  # of 24 bytes each, so at most 24 MB are broadcast; with more, lines are shuffled by block
READS = "path string, read_id long, name string, seq string, qual string"


def path_list(paths: str | list[str]) -> list[str]:
    """Several paths may be joined by colons."""
    if isinstance(paths, str):
        return [paths] if "://" in paths or paths.startswith("file:") else paths.split(":")
    return list(paths)


def _blocks(spark: SparkSession, paths: str | list[str], blank: bool) -> DataFrame:
    """(path, block, value) in the order of each block; gzip by suffix, such a file is one block."""
    lines = spark.read.text(path_list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    return lines if blank else lines.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")


def _bases(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(p, b, base, heads): lines, and lines that begin with >, before each block of a file, or, as a whole, of all files in order of their paths."""
    sizes = lines.groupBy("path", F.xxhash64("path").alias("p"), F.col("block").alias("b")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("value").startswith(">"), 1).otherwise(0)).alias("h"))
    order = Window.orderBy("path", "b") if whole else Window.partitionBy("path").orderBy("b")  # a row per block
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return sizes.select("p", "b", F.coalesce(F.sum("n").over(before), zero).alias("base"), F.coalesce(F.sum("h").over(before), zero).alias("heads"))


def _runs(path: pa.Array, block: pa.Array) -> list[tuple[int, int]]:
    """Bounds of the rows of one block each."""
    if not len(path):
        return []
    new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1]))
    edges = [0, *(np.flatnonzero(np.asarray(new)) + 1).tolist(), len(path)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def numbered_lines(spark: SparkSession, paths: str | list[str], blank: bool = False, whole: bool = False) -> DataFrame:
    """(path, line, head, value): trimmed lines with their place in the file from 0, and how many lines that begin with > there are up to it.

    With ``whole`` all files count as one, in order of their paths, as the parts of a folder that was written here do.
    """
    lines = _blocks(spark, paths, blank)

    def number(batches):
        last, line, head = None, 0, 0
        for batch in batches:
            path, block, value = batch.columns
            value = pc.utf8_trim_whitespace(value)
            marks = np.asarray(pc.starts_with(value, ">")).astype(np.int64)
            numbers, heads = np.zeros(len(path), np.int64), np.zeros(len(path), np.int64)
            for i, j in _runs(path, block):
                key = path[i].as_py(), block[i].as_py()
                if key != last:
                    last, line, head = key, 0, 0
                numbers[i:j], heads[i:j] = line + np.arange(j - i), head + np.cumsum(marks[i:j])
                line, head = line + j - i, int(heads[j - 1])
            yield pa.RecordBatch.from_arrays([path, block, pa.array(numbers), pa.array(heads), value], names=["path", "block", "line", "head", "value"])

    found = lines.mapInArrow(number, "path string, block long, line long, head long, value string")
    joined = found.join(_bases(lines, whole), (F.xxhash64("path") == F.col("p")) & (F.col("block") == F.col("b")))
    return joined.select("path", (F.col("line") + F.col("base")).alias("line"), (F.col("head") + F.col("heads")).alias("head"), "value")


def read_fastq(spark: SparkSession, paths: str | list[str], mode: str = "STOP", percent: float = 1.0, cutoff: int | None = None) -> DataFrame:
    """Reads of four lines each, blank lines skipped, lines trimmed: (path, read_id, name, seq, qual).

    Several paths as a list or joined by colons, gzip by suffix. ``read_id`` is the place in the file. A quality longer than the sequence is cut; a record without header,
    plus line or enough quality is damaged: STOP ends its file there, FAIL raises. ``percent`` and ``cutoff`` trim reads as ``trim`` does.
    Records within a block are put together by its task; only those that go over the end of a block are shuffled.
    """
    if mode not in ("STOP", "FAIL"):
        raise ValueError("mode is STOP or FAIL; sources.files.read_fastq_dropping goes on after damaged records")
    lines = _blocks(spark, paths, blank=False)
    bases = _bases(lines).drop("heads")
    here = (F.xxhash64("path") == F.col("p")) & (F.col("block") == F.col("b"))
    if bases.count() <= MOST_BLOCKS:
        placed = lines.join(F.broadcast(bases), here).select("path", "block", "base", "value")  # keeps the order of the lines
    else:
        order = lines.withColumn("at", F.monotonically_increasing_id())
        placed = order.join(bases, here).repartition("path", "block").sortWithinPartitions("path", "block", "at").select("path", "block", "base", "value")
    names = ["path", "read_id", "field", "a", "b", "c", "d"]

    def assemble(batches):
        def out(path, first, lines):
            """Whole records as rows of four texts, others as a row for each line."""
            lo = min(-first % 4, len(lines))
            hi = lo + (len(lines) - lo) // 4 * 4
            n = (hi - lo) // 4
            whole = lines.slice(lo, hi - lo)
            four = [whole.take(pa.array(np.arange(i, hi - lo, 4))) for i in range(4)]
            number = (first + lo) // 4
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(number + np.arange(n)), pa.nulls(n, pa.int32()), *four], names=names)
            rest = [*range(lo), *range(hi, len(lines))]
            if rest:
                at = first + np.array(rest)
                k = len(rest)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array(at // 4), pa.array(at % 4, pa.int32()), lines.take(pa.array(rest)), *(pa.nulls(k, pa.string()) for _ in range(3))], names=names)

        last, done = None, 0
        for batch in batches:
            path, block, base, value = batch.columns
            value = pc.utf8_trim_whitespace(value)
            for i, j in _runs(path, block):
                key = path[i].as_py(), block[i].as_py()
                if key != last:
                    last, done = key, 0
                yield from out(key[0], base[i].as_py() + done, value.slice(i, j - i))
                done += j - i

    found = placed.mapInArrow(assemble, "path string, read_id long, field int, a string, b string, c string, d string")
    parts = found.where("field is not null").groupBy("path", "read_id").agg(*[F.max(F.when(F.col("field") == i, F.col("a"))).alias(n) for i, n in enumerate("hspq")])
    records = found.where("field is null").select("path", "read_id", *[F.col(x).alias(n) for x, n in zip("abcd", "hspq", strict=True)]).unionByName(parts)
    good = F.col("h").startswith("@") & F.col("p").startswith("+") & ((F.col("p") == "+") | F.expr("endswith(p, substring(h, 2))")) & (F.length("q") >= F.length("s"))
    records = records.withColumn("good", F.coalesce(good, F.lit(False)))
    if mode == "FAIL":
        records = records.where(F.col("good") | F.raise_error(F.concat(F.lit("damaged record "), F.col("read_id"), F.lit(" of "), F.col("path"))).cast("boolean"))
    else:
        stop = records.where("not good").groupBy(F.col("path").alias("stopped")).agg(F.min("read_id").alias("end"))  # a row per damaged file
        records = records.join(stop, F.col("path") == F.col("stopped"), "left").where("end is null or read_id < end")
    kept = trim("s", percent, cutoff)
    return records.select("path", "read_id", F.expr("substring(h, 2)").alias("name"), kept.alias("seq"), F.left("q", F.length(kept)).alias("qual"))


def read_pairs(spark: SparkSession, firsts: str | list[str], seconds: str | list[str], mode: str = "STOP", percent: float = 1.0, cutoff: int | None = None) -> DataFrame:
    """(pair_id, seq1, seq2): file i of the first list side by side with file i of the second, up to the end of the shorter one.

    ``pair_id`` counts by file, then place: file * 2**40 + read_id.
    """
    a, b = path_list(firsts), path_list(seconds)
    if len(a) != len(b):
        raise ValueError("each file needs its mate")
    out = None
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        one = read_fastq(spark, [x], mode, percent, cutoff).select("read_id", F.col("seq").alias("seq1"))
        two = read_fastq(spark, [y], mode, percent, cutoff).select("read_id", F.col("seq").alias("seq2"))
        rows = one.join(two, "read_id").select((F.lit(i << 40).cast("long") + F.col("read_id")).alias("pair_id"), "seq1", "seq2")
        out = rows if out is None else out.unionByName(rows)
    return out
