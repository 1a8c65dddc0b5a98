"""Quality rules with host verdicts.

Document rules are judged on each text. Failures are then summed by host, each host's failure rate is
shrunk toward an empirical beta prior fitted to the rates of all hosts by moments, and
hosts whose shrunk rate is over a limit reject all of their documents.

Null or empty texts have no words and fail. A document with a null host is judged alone. Repeated
ids are separate rows. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.frames import lean, load, small_batches
from strandweave.llm.textscan import Scan, mix, repeated, segment_hash, slices, text_of, window_hash
from strandweave.plans.staging import cut

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.6
BROADCAST_HOSTS = 10_000
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def text_stats(texts: pa.Array) -> list[np.ndarray]:
    """The five counts of each text."""
    s = Scan(texts)
    docs = len(s.off) - 1
    chars = s.per_doc(s.is_word & ((s.data & 0xC0) != 0x80))
    symbols = s.per_doc(_SYMBOL[s.data])

    newline = np.flatnonzero(s.data == 10)
    begins = np.unique(np.concatenate((s.off[:-1], newline + 1)))
    begins = begins[begins < len(s.data)]
    closing = np.append(newline, len(s.data))
    ends = np.minimum(closing[np.searchsorted(newline, begins, "left")], s.off[np.minimum(np.searchsorted(s.off, begins, "right"), docs)])
    worded = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, begins)
    begins, ends = begins[worded], ends[worded]
    line_doc = np.searchsorted(s.off, begins, "right") - 1
    with np.errstate(over="ignore"):
        own = mix(np.arange(1, docs + 1, dtype=np.uint64))
        many, first = repeated(mix(segment_hash(s.data, begins, ends) + own[line_doc]))
        dup_lines = np.bincount(line_doc[many & ~first], minlength=docs)
        at, doc = s.windows(3)
        many, _ = repeated(mix(window_hash(s.word_hash(), at, 3) + own[doc]))
    covered = np.zeros(len(s.starts) + 3, bool)
    for k in range(3):
        covered[at[many] + k] = True
    return [s.n_words, chars, symbols, dup_lines, s.per_doc_words(covered[: len(s.starts)])]


def document_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of each document; whole texts, one pass, no shuffle."""

    def run(batches):
        for batch in slices(batches, text):
            stats = [pa.array(x.astype(np.int64)) for x in text_stats(text_of(batch, text))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in held] + stats, names=names)

    source = docs.select(*keep, *([] if text in keep else [text]))
    held = [source.columns.index(c) for c in keep]
    counts = [c.split()[0] for c in STATS.split(", ")]
    names = [*keep, *counts]
    kinds = docs.select(*keep).schema
    for c in counts:
        kinds = kinds.add(c, "long")
    return source.mapInArrow(lean(run), kinds)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """Per host: documents, failures and the shrunk failure rate. ``judged`` has ``base_failed``; it is read twice."""
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = cut(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    seen = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).first()
    mean = min(max(seen["m"] if seen["m"] is not None else 0.0, 1e-6), 1 - 1e-6)
    spread = seen["v"] if seen["v"] is not None and seen["v"] > 0 else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1000.0) if spread else 1000.0
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_failed", shrunk > HOST_LIMIT)


def failed_hosts(judged: DataFrame, host: str) -> DataFrame:
    """Names of rejected hosts, broadcast only if they are counted to be few."""
    bad = cut(host_rates(judged, host).where("host_failed").select(F.col(host).alias("__host")))
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts and verdict of each document: key, the five counts, base_failed, kept."""
    stats = cut(document_stats(docs, [key, host], text).withColumn("base_failed", base_failed()))
    bad = failed_hosts(stats, host).withColumn("__bad", F.lit(True))
    joined = stats.join(bad, F.col(host) == F.col("__host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad", host)


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns; the texts are not shuffled while rejected hosts are few."""
    small_batches(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # clear of clashing names
    own_host, own_text = (f"c{docs.columns.index(c)}" for c in (host, text))
    bad = failed_hosts(document_stats(plain, [own_host], own_text).withColumn("base_failed", base_failed()), own_host)
    good = document_stats(plain, plain.columns, own_text).where(~base_failed())
    good = good.join(bad, F.col(own_host) == F.col("__host"), "left_anti")
    return good.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))
