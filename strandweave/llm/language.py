"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit, a binary classifier on hashed byte n-grams (naive Bayes odds of the
languages whose bit is one against the others) predicts its sign. A document gets the language whose codeword has
the least loss, each bit weighted by how well it separates the training rows; when the runner-up is as close as
``AMBIGUOUS``, the row is flagged.

The classifiers are fitted on the ``fit_rows`` labelled rows with the smallest key hashes, or all if there are fewer, and on no more of these, in order of the hash, than
``FIT_BYTES`` of text hold. The model is
languages x features numbers, whatever the size of the table, so it is sent to every executor.

``und`` with score 0 where the text is null or has no letter, or nothing was learned. A null key is not
held out. Rows with a null lang teach nothing. Repeated rows are rows of their own; ties between languages go to the first in order of their names. Texts are counted whole,
however long. An empty table gives no rows. Kept columns may have any names.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.frames import crc_remainder, lean, load, small_batches
from strandweave.llm.textscan import Scan, mix, slices, text_of

FIT_ROWS = 4_000
FIT_BYTES = 128 << 20
ROWS = 256  # counted at a time, of 32 KB each
SLICE = 1 << 17
FEATURES = 1 << 13
LENGTHS = (1, 2, 3, 4)
SMOOTH = 0.5
AMBIGUOUS = 0.02
SEED = 11
_LETTER = regex.compile(r"\p{L}")


def ngram_counts(s: Scan, features: int = FEATURES) -> np.ndarray:
    """Per document, counts of hashed byte n-grams of its lower-cased words, each word with a space on either side."""
    docs = len(s.off) - 1
    keep = np.where(s.is_word, s.data, 32).astype(np.uint64)
    out = np.zeros((docs, features), np.float32)
    hashed = []
    code = np.zeros(len(keep), np.uint64)
    for k in LENGTHS:
        shifted = np.zeros(len(keep), np.uint64)
        n = len(keep) - k + 1
        if n <= 0:
            break
        shifted[:n] = keep[k - 1 :]
        code = code << np.uint64(8) | shifted
        hashed.append((k, (mix(code + np.uint64(k << 40)) >> np.uint64(40)) % np.uint64(features)))
    for i in range(docs):
        a, b = int(s.off[i]), int(s.off[i + 1])
        for k, h in hashed:
            if b - a >= k:
                out[i] += np.bincount(h[a : b - k + 1].astype(np.int64), minlength=features)
    return out


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: all splits for few, the best spread of seeded draws for many."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(8 * np.log2(n)))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (abs(m.sum(0)) == n).any():
            continue
        gram = m.astype(int) @ m.T
        np.fill_diagonal(gram, -bits)
        least = (bits - gram.max()) // 2
        if least > apart:
            best, apart = m, least
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits: log odds
    scale: np.ndarray  # bits: margins are divided by it
    trust: np.ndarray  # bits: weight of the bit in decoding

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language, score from 0 to 1, ambiguity."""
        if not self.languages:
            n = len(counts)
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        margin = self._margin(counts) / self.scale
        loss = np.logaddexp(0, -self.codes[None] * margin[:, None]) @ self.trust
        order = np.argsort(loss, 1, kind="stable")
        near = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        score = 1 / near.sum(1)
        if len(self.languages) == 1:
            return order[:, 0], score, np.zeros(len(counts), bool)
        two = np.take_along_axis(loss, order[:, :2], 1)
        return order[:, 0], score, two[:, 1] - two[:, 0] < AMBIGUOUS

    def _margin(self, counts: np.ndarray) -> np.ndarray:
        return (counts @ self.weights) / np.maximum(counts.sum(1, keepdims=True), 1)


def fit(texts: list[str], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    place = {x: i for i, x in enumerate(languages)}
    y = np.array([place[x] for x in langs], int)
    totals = np.zeros((len(languages), FEATURES))
    step = 64
    for at in range(0, len(texts), step):
        counts = ngram_counts(Scan(pa.array(texts[at : at + step], pa.string()), lower=True))
        np.add.at(totals, y[at : at + step], np.sqrt(counts))
    if not languages:
        return Model([], codes, np.zeros((FEATURES, 1)), np.ones(1), np.ones(1))
    share = (totals + SMOOTH) / (totals + SMOOTH).sum(1, keepdims=True)
    bits = []
    for c in codes.T:
        one = share[c > 0].mean(0)
        bits.append(np.log(one) - np.log(share[c < 0].mean(0)) if (c < 0).any() else np.zeros(FEATURES))
    model = Model(languages, codes, np.array(bits, np.float32).T, np.ones(codes.shape[1]), np.ones(codes.shape[1]))
    margins = np.concatenate([model._margin(ngram_counts(Scan(pa.array(texts[at : at + step], pa.string()), lower=True))) for at in range(0, len(texts), step)])
    truth = codes[y]
    model.scale = np.maximum(np.median(abs(margins), 0) / 2, 1e-9)
    right = ((margins * truth) > 0).mean(0)
    trust = np.clip(np.log((right + 1e-3) / (1 - right + 1e-3)), 1e-3, None)
    model.trust = trust / trust.sum()
    return model


def fit_table(docs: DataFrame, key: str, text: str, lang: str, fit_rows: int = FIT_ROWS) -> Model:
    """The model of at most ``fit_rows`` rows that have text and lang; counts and margins of the rest are not looked at."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, F.length(text)).alias("h")).where("text is not null and lang is not null")
    size = F.octet_length("text").cast("long").alias("size")
    chosen, room = [], FIT_BYTES
    for r in rows.select("h", size).orderBy("h", "size").limit(fit_rows).collect():
        room -= r["size"]
        if room < 0 and chosen:
            break
        chosen.append(r["h"])
    if not chosen:
        return fit([], [])
    wanted = spark.createDataFrame([(h,) for h in sorted(set(chosen))], "w long")  # fit_rows rows at most
    held = rows.join(F.broadcast(wanted), F.col("h") == F.col("w"), "left_semi").select("text", "lang").limit(2 * fit_rows)
    texts, langs = [], []
    for r in held.toLocalIterator():
        texts.append(r[0])
        langs.append(r[1])
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    return fit([texts[i] for i in order], [langs[i] for i in order])


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score and ambiguous. Only the text is looked at."""
    small_batches(docs.sparkSession)
    at = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, own, strict=True)], F.col(text).alias("__text"))
    kinds = source.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches):
        m = at.value
        names = np.array([*m.languages, "und"], object)
        for batch in (b.slice(i, ROWS) for b in slices(batches, "__text", SLICE) for i in range(0, b.num_rows, ROWS)):
            texts = text_of(batch, "__text")
            place, score, unsure = m.predict(ngram_counts(Scan(texts, lower=True)))
            none = np.array([not _LETTER.search(x) for x in texts.to_pylist()], bool)
            place = np.where(none | (place < 0), len(m.languages), place)
            score = np.where(place == len(m.languages), 0.0, score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[place], pa.string()), pa.array(score), pa.array(unsure | none)], names=kinds.names)

    return source.mapInArrow(lean(run), kinds).toDF(*keep, "lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows whose crc32(key) modulo 4 is 2 are held out of training."""
    held = F.coalesce(crc_remainder(key, 4) == 2, F.lit(False))
    model = fit_table(docs.where(~held), key, text, lang, fit_rows)
    return predict(docs, model, [key], text).withColumn("held_out", held)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
