"""From raw documents to packed sequences: five stages, each over all that the stage before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
``run`` writes each result as Parquet to the shared folder and rereads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import jaccard, language, packing, quality, substrings
from strandweave.llm.frames import crc_remainder, free_name, load
from strandweave.plans.staging import cut, stage

SHINGLE, PERCENT = 5, 80  # near copies of the stage; those of op2 are its own


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts that are null or without a letter go."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text, lang = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "lang"))
    held = F.coalesce(crc_remainder(key, 4) == 2, F.lit(False))
    model = language.fit_table(plain.where(~held), key, text, lang)
    told = language.predict(plain, model, plain.columns, text).where("lang_pred <> 'und'")
    return told.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules for documents and for hosts."""
    return quality.keep_good(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest id; documents without words stay."""
    uid = free_name(docs, "uid")
    hashed = docs.withColumn(uid, F.xxhash64(*docs.columns))
    named = cut(jaccard.classes_and_components(hashed, ["doc_id", uid], "doc_id", shingle=SHINGLE, percent=PERCENT))
    grouped = named.where("cls is not null").groupBy("comp")
    first = grouped.agg(F.min(F.struct("doc_id", uid)).alias("m")).select(F.col(f"m.{uid}").alias("kept_uid"))
    empty = named.where("cls is null").select(F.col(uid).alias("kept_uid"))
    joined = hashed.join(first.unionByName(empty).distinct(), F.col(uid) == F.col("kept_uid"), "left_semi")
    return joined.dropDuplicates([uid]).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated passages; ``n_chars`` follows the text."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    rest = [c for c in plain.columns if c != text]
    left = substrings.cut_repeats(plain.withColumn("absent", F.col(text).isNull()), [*rest, "absent"], text, with_text=True)
    now = {f"c{i}": F.col(f"c{i}") for i in range(len(docs.columns)) if f"c{i}" != text}
    now[text] = F.when(~F.col("absent"), F.col("kept_text"))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        now[n] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n))
    return left.select(*[now[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_near),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
