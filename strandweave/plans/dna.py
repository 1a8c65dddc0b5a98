"""Reads, contigs and pairs from the ``documents`` table, for trying operators where there is no DNA at hand."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.functions.seq import reverse_complement
from strandweave.operators.superkmers import lean

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CODES = ("ACGT" * 7)[:26] * 2
READ, FRAGMENT, STEP, CONTIG = 100, 300, 50, 500
ROWS = 256  # texts that are translated at a time
_TABLE = bytes.maketrans(LETTERS.encode(), CODES.encode())
_OTHERS = bytes(set(range(256)) - set(LETTERS.encode()))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq): the letters of each whole text as bases, other characters left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.regexp_replace(F.translate("text", LETTERS, CODES), "[^ACGT]", "").alias("seq"))


def _by_bytes(spark: SparkSession, sf_dir: str, column: str, kind: T.DataType, made) -> DataFrame:
    """doc_id, and ``made`` of the letters of each text as bases (bytes, null for null): a table of bytes takes a fraction of the time of SQL functions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = some.column(1).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([some.column(0), made([t if t is None else t.translate(_TABLE, _OTHERS) for t in texts])], names=["doc_id", column])

    return docs.mapInArrow(lean(run), T.StructType([docs.schema["doc_id"], T.StructField(column, kind)]))


def dna_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``dna``, for queries that go on in Python tasks."""
    return _by_bytes(spark, sf_dir, "seq", T.StringType(), lambda seqs: pa.array(seqs, pa.binary()).cast(pa.string()))


def contig_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig_id, len) of ``contigs``, without their letters."""
    rows = _by_bytes(spark, sf_dir, "n", T.LongType(), lambda seqs: pa.array([s if s is None else len(s) for s in seqs], pa.int64()))
    each = rows.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CONTIG))).alias("i"))
    return each.select((F.col("doc_id") * 10_000 + F.col("i")).alias("contig_id"), F.least(F.lit(CONTIG), F.col("n") - F.col("i") * CONTIG).cast("long").alias("len"))


def with_quality(rows: DataFrame) -> DataFrame:
    """A quality for each base: 33 + (31 doc_id + 7 place) % 40."""
    quality = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.char(F.lit(33) + (F.col("doc_id") * 31 + i * 7) % 40))
    return rows.where("length(seq) > 0").withColumn("qual", F.array_join(quality, ""))


def pairs(rows: DataFrame) -> DataFrame:
    """Fragments of 300 bases every 50, read 100 bases from both ends: (pair_id, seq1, seq2)."""
    long = rows.where(F.length("seq") >= FRAGMENT)
    each = long.select("doc_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - (FRAGMENT - 1), F.lit(STEP))).alias("p"))
    return each.select((F.col("doc_id") * 1_000_000 + F.col("p")).alias("pair_id"), F.substring("seq", F.col("p"), F.lit(READ)).alias("seq1"), reverse_complement(F.substring("seq", F.col("p") + (FRAGMENT - READ), F.lit(READ))).alias("seq2"))


def contigs(rows: DataFrame) -> DataFrame:
    """Each sequence in stretches of 500: (contig_id, seq, len, coverage)."""
    some = rows.where("length(seq) > 0")
    each = some.select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / CONTIG))).alias("i"))
    return each.select((F.col("doc_id") * 10_000 + F.col("i")).alias("contig_id"), F.substring("seq", (F.col("i") * CONTIG + 1).cast("int"), F.lit(CONTIG)).alias("seq"), F.least(F.lit(CONTIG), F.length("seq") - F.col("i") * CONTIG).cast("long").alias("len"), (1 + (F.col("doc_id") * 7 + F.col("i") * 3) % 11).cast("double").alias("coverage"))
