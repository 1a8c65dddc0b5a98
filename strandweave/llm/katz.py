"""Katz backoff language model over words, trained and evaluated in exchanges.

Tokens are lower-cased words and one end per document. The model is a bigram over words with a unigram below
it; one further type stands for every word never seen in training. Every word has its own bigrams, as token and as
context: words are known by 64-bit hashes, and their pairs meet in partitions. The most frequent words (at most
``VOCABULARY``, a parameter, so tables of them may be broadcast) only travel in another way, as classes: the
scores do not depend on how many they are.

* Counts up to ``CUT`` are discounted by Good-Turing (absolute discounting where the counts of counts don't
  admit it), greater ones by ``LARGE`` tokens, so every context keeps some mass for backing off.
* P(word | context) is the discounted count over the context's count where the pair was seen, else
  the context's weight times P(word); the weight is the mass left over divided by the unigram mass of the words
  not seen there, so that each context sums to one. After a word never seen in training it is P(word).

Passes: word counts; then, per document, distinct pairs meet over all documents, which gives counts, the sums of
each frequent context and each document's share of the score at once; then pairs seen in rare contexts meet what
documents ask of these contexts; then shares are summed. Pairs of two frequent words are spread over ranges in
proportion to the context's count, pairs with a rare word are with that word, so its count is their sum.

The model stays as tables in the shared folder: counts of words, of pairs, and of contexts with their weights, each dealt by ranges of hashes.
``Model.evaluate`` scores any documents from them, a token at a time: by its pair, else by its context's weight and its word. ``fit_and_score``
gives the same scores for the documents the model is fitted on, as the pairs they ask for meet the counts where these are summed.

The key is an integer. Null texts are empty: one end token. A null key trains. Repeated rows are documents of their own.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import exchange as X
from strandweave.llm.frames import crc_remainder, lean, load
from strandweave.llm.textscan import Scan, mix, slices, text_of
from strandweave.plans.staging import stage

VOCABULARY = 60_000
CUT = 5
LARGE = 0.05
STRETCH = 1_000_000
PIECE = 250_000
SHARED = 400_000  # tokens of a stretch of documents whose pairs are dealt together
END, RARE, START, WORDS = 0, 1, 2, 3
END_HASH = 0x2545F4914F6CDD1D
PARTS = "kind int, stretch long, context int, sums array<double>, blob binary"
_U = np.uint64
_BITS = 20


def discounts(n: list[float], cut_at: int = CUT) -> np.ndarray:
    """Factors of counts 0 to ``cut_at`` from the numbers n[r] of types counted r times, r up to cut_at + 1."""
    d = np.ones(cut_at + 1)
    if n[1] > 0 and all(n[r] > 0 for r in range(1, cut_at + 2)):
        whole = (cut_at + 1) * n[cut_at + 1] / n[1]
        for r in range(1, cut_at + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - whole) / (1 - whole) if whole != 1 else -1
    if not (n[1] > 0 and ((d[1:] > 0) & (d[1:] < 1)).all()):
        back = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        for r in range(1, cut_at + 1):
            d[r] = (r - back) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    small = np.minimum(c, len(d) - 1)
    return np.where(c < len(d), d[small] * c, c - LARGE)


@dataclass
class Unigrams:
    """Frequent words, and what is needed of all words."""

    hashes: np.ndarray  # of the words that are classes, sorted
    counts: np.ndarray  # of each class as a token, by class; none of RARE, which stands for words of their own
    context: np.ndarray  # of each class as a context
    p: np.ndarray  # P(word) of each class
    d: np.ndarray  # discounts of word counts
    total: int
    types: int

    def classes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), RARE)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at + WORDS, RARE)

    def p_word(self, c: np.ndarray) -> np.ndarray:
        """P(word) of words counted c times; 0 stands for the type never seen."""
        return np.where(c > 0, discounted(np.maximum(c, 1), self.d) / max(1, self.total), self.unseen)

    unseen: float = 1.0

    @property
    def ids(self) -> np.ndarray:
        """What stands for each class in the tables of the model: its hash, ``END_HASH``, or START itself."""
        return np.concatenate((np.array([END_HASH, 0, START], _U), self.hashes))


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): hash and count of each token of (key, text, held) rows that are not held out."""
    buckets = X.buckets_of(docs)

    def run(batches):
        held, n = [], 0

        def flush():
            w, c = np.unique(np.concatenate(held), return_counts=True)
            yield from X.blobs(w, [c.astype(np.int32)], buckets)

        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(~np.asarray(batch.column(2).to_numpy(zero_copy_only=False))))
            s = Scan(text_of(batch, "text"), lower=True)
            held += [s.word_hash(), np.full(batch.num_rows, END_HASH, _U)]
            n += len(s.starts) + batch.num_rows
            if n >= STRETCH:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def add(columns):
        w, at = np.unique(columns[0].view(_U), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.bincount(at, columns[1]).astype(np.int64))], names=["w", "c"])

    return X.meet(docs.mapInArrow(lean(run), X.BLOBS), add, "w long, c long")


def unigrams(counts: DataFrame, vocabulary: int = VOCABULARY) -> Unigrams:
    """From the table of word counts, which is read three times; at most ``vocabulary`` of its rows come to the driver."""
    end = int(np.array(END_HASH, _U).view(np.int64))
    sums = [F.sum(F.when(F.col("c") == r, 1).otherwise(0)).alias(f"n{r}") for r in range(1, CUT + 2)]
    spent = F.sum(F.when(F.col("c") > CUT, F.col("c")).otherwise(0)).alias("large")
    seen = counts.agg(F.count("*").alias("types"), F.sum("c").alias("total"), F.sum(F.when(F.col("c") > CUT, 1).otherwise(0)).alias("n_large"), spent, F.max(F.when(F.col("w") == end, F.col("c"))).alias("ends"), *sums).first()
    types, total = seen["types"], seen["total"] or 0
    if not total:
        p = np.array([0.5, 0.0, 0.0])
        return Unigrams(np.zeros(0, _U), np.zeros(3, np.int64), np.zeros(3, np.int64), p, discounts([0] * (CUT + 2)), 0, 0, 0.5)
    n = [0, *(seen[f"n{r}"] or 0 for r in range(1, CUT + 2))]
    d = discounts(n)
    unseen = 1 - (sum(r * d[r] * n[r] for r in range(1, CUT + 1)) + (seen["large"] or 0) - LARGE * (seen["n_large"] or 0)) / total
    steps = counts.groupBy(F.floor(16 * F.log2("c")).alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # at most 1,024 rows
    room, least = vocabulary, None
    for r in steps:
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    top = [] if least is None else counts.where((F.floor(16 * F.log2("c")) >= least) & (F.col("w") != end)).select("w", "c").collect()
    w = np.array([r["w"] for r in top], np.int64).view(_U)
    c = np.array([r["c"] for r in top], np.int64)
    order = np.argsort(w)
    ends = seen["ends"] or 0
    counted = np.concatenate(([ends, 0, 0], c[order]))
    context = counted.copy()
    context[END], context[START] = 0, ends
    p = discounted(counted, d) / total
    p[RARE] = p[START] = 0
    return Unigrams(w[order], counted, context, p, d, total, types, unseen)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def added(stretch, doc, columns):
    """Sums of the columns, of which each is made as it is needed, over the rows of a document."""
    order = np.lexsort((doc, stretch))
    stretch, doc = stretch[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (stretch[1:] != stretch[:-1]) | (doc[1:] != doc[:-1]))))
    return stretch[new], doc[new], *(np.add.reduceat(c[order], new) for c in columns)


def _shares(docs: DataFrame, model: Unigrams) -> DataFrame:
    """What documents and pairs add up to, as PARTS.

    Kind 0, a stretch's documents; 1, shares of them; 2, a frequent context (RARE: all others); 3, what documents ask of
    frequent contexts. Of rare contexts, with the range of hashes as ``context``: 4, pairs seen there; 5, what documents ask. The model's
    pairs: 7, of classes (context, word, count); 8, others by the hashes of both.
    """
    spark = docs.sparkSession
    at = spark.sparkContext.broadcast(model)
    buckets = X.buckets_of(docs)
    sent_kind = "bucket int, kind int, stretch long, blob binary"
    arrow = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("stretch", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        m = at.value
        task, stretches = TaskContext.get().partitionId(), 0
        spread_over = np.maximum(1, (4 * buckets * m.context / max(1, m.total)).astype(np.int64))
        log_context = np.where(m.context > 0, _log(m.context), 0)
        log_more = np.log10(m.counts + 1)
        held: list[tuple] = []
        n = docs_held = 0

        def flush(stretch: int):
            keys, nulls, out, tokens, known, more, ctx, *found = (np.concatenate(c) for c in zip(*held, strict=True))
            roster = [keys, nulls.astype(np.int8), out.astype(np.int8), tokens, known, more.view(np.int64), ctx.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([stretch % buckets], pa.int32()), pa.array([0], pa.int32()), pa.array([stretch]), pa.array([X.pack(roster)], pa.binary())], schema=arrow)
            for kind, doc, key, *other in ((1, *found[:2]), (2, *found[2:5]), (3, *found[5:])):
                if not len(key):
                    continue
                whole = mix(other[0].astype(_U)) ^ key if other else key
                order = np.lexsort((whole, doc))
                doc, whole = doc[order], whole[order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1]))))
                times = np.diff(np.concatenate((first, [len(doc)])))
                doc, key, other = doc[first], key[order[first]], [c[order[first]] for c in other]
                if kind == 1:
                    v, w = (key >> _U(_BITS)).astype(np.int64), (key & _U(2**_BITS - 1)).astype(np.int64)
                    salt = (mix(w.astype(_U)) >> _U(33)).astype(np.int64) % spread_over[v]
                    key = mix(v.astype(_U) << _U(24) | salt.astype(_U)) >> _U(40) << _U(40) | key
                signed = np.where(out[doc], -times, times).astype(np.int32)
                for b in X.blobs(key, [*other, doc.astype(np.int32), signed], buckets):
                    k = b.num_rows
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind] * k, pa.int32()), pa.array([stretch] * k), b.column(1)], schema=arrow)

        for batch in slices(batches, "text"):
            s = Scan(text_of(batch, "text"), lower=True)
            docs_here = batch.num_rows
            words = s.word_hash()
            cls = m.classes(words)
            doc = s.doc_of_word()
            ends = s.first[1:] + np.arange(docs_here)  # places of the ends among all tokens
            tokens = np.full(len(words) + docs_here, END)
            tokens[np.arange(len(words)) + doc] = cls
            token_doc = np.zeros(len(tokens), np.int64)
            token_doc[np.arange(len(words)) + doc] = doc
            token_doc[ends] = np.arange(docs_here)
            before = np.full(len(tokens), START)
            before[1:] = np.where(token_doc[1:] == token_doc[:-1], tokens[:-1], START)
            plain = tokens != RARE
            counted = np.where(plain, m.counts[tokens], 0)
            known = np.bincount(token_doc, counted > 0, docs_here)
            more = np.bincount(token_doc, np.where(plain, log_more[tokens], 0), docs_here)
            ctx = -np.bincount(token_doc, log_context[before], docs_here)
            keys = batch.column(0)
            out = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            hashed = np.zeros(len(tokens), _U)
            hashed[np.arange(len(words)) + doc] = words
            hashed_before = np.concatenate((np.zeros(1, _U), hashed[:-1]))
            rare, rare_before = tokens == RARE, before == RARE
            both, late = ~rare & ~rare_before, ~rare & rare_before
            token_doc += docs_held
            found = [token_doc[both], (before.astype(_U) << _U(_BITS) | tokens.astype(_U))[both]]
            found += [token_doc[rare], hashed[rare], np.where(rare_before, hashed_before, before.astype(_U))[rare].view(np.int64)]
            found += [token_doc[late], hashed_before[late], tokens[late].astype(np.int32)]
            held.append((np.asarray(keys.fill_null(0)).astype(np.int64), np.asarray(keys.is_null().to_numpy(zero_copy_only=False)), out, s.n_words + 1, known.astype(np.int64), more, ctx, *found))
            n += len(tokens)
            docs_held += docs_here
            if n >= SHARED:
                yield from flush(task << 24 | stretches)
                held, n, docs_held, stretches = [], 0, 0, stretches + 1
        if n:
            yield from flush(task << 24 | stretches)

    def shares(sums):
        """One row per stretch with the sums of its documents: counts by r, known, score, more."""
        stretch, doc, *columns = (np.concatenate(c) for c in zip(*sums, strict=True))
        stretch, doc, *columns = added(stretch, doc, columns)
        edges = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            packed = [doc[a:b], *(x[a:b].astype(np.int32) if x.dtype.kind == "i" else x[a:b].view(np.int64) for x in columns)]
            yield row(1, int(stretch[a]), None, None, X.pack(packed))

    def row(kind, stretch, context, sums, blob):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([stretch], pa.int64()), pa.array([context], pa.int32()), pa.array([sums], pa.list_(pa.float64())), pa.array([blob], pa.binary())], names=["kind", "stretch", "context", "sums", "blob"])

    def outward(kind, key, columns):
        for b in X.blobs(key, columns, buckets):
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.nulls(k, pa.int64()), b.column(0), pa.nulls(k, pa.list_(pa.float64())), b.column(1)], names=["kind", "stretch", "context", "sums", "blob"])

    def pairs(kind, key, other, doc, times, stretch, m, sums, contexts):
        """Rows in order of key and other: pairs of classes (1), a rare word and what comes before it (2), a rare context and the class after it (3)."""
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])))
        group = np.cumsum(new) - 1
        trained = np.maximum(times, 0)
        c = np.add.reduceat(trained, np.flatnonzero(new)).astype(np.int64)
        each, size = c[group].astype(np.int32), abs(times)
        known = more = None
        if kind == 1:
            v, w = (key >> _U(_BITS) & _U(2**_BITS - 1)).astype(np.int32), (key & _U(2**_BITS - 1)).astype(np.int32)
            p, hashed = m.p[w], key
        elif kind == 2:
            word = np.concatenate(([True], key[1:] != key[:-1]))
            cw = np.add.reduceat(trained, np.flatnonzero(word)).astype(np.int64)[np.cumsum(word) - 1]
            hashed = other.view(_U)
            v = np.where(hashed < _U(2**_BITS), hashed, _U(RARE)).astype(np.int32)
            p = m.p_word(cw)
            known, more = np.where(cw > 0, size, 0), size * np.log10(cw + 1)
        else:
            v, hashed = np.full(len(key), RARE, np.int32), key
            p, cw = m.p[other], m.counts[other]
        unseen = each == 0
        score = np.where(each > CUT, size * np.log10(np.maximum(each - LARGE, 0.5)), 0.0)
        score[unseen] += (size * (_log(p) + np.where(m.context[v] > 0, _log(m.context[v]), 0)))[unseen]
        if kind == 2:  # each such word is the context of one token
            score -= size * _log(np.maximum(cw, 1))
        counted = (np.where(each == r, size, 0).astype(np.int32) for r in range(1, CUT + 1))
        last = (np.zeros(len(size), np.int32) if known is None else known, score, np.zeros(len(size)) if more is None else more)
        sums.append(added(stretch, doc, itertools.chain(counted, last)))
        back = unseen & (m.context[v] > 0)
        for s in np.unique(stretch[back]):
            own = back & (stretch == s)
            yield row(3, int(s), None, None, X.pack([doc[own].astype(np.int32), v[own], size[own].astype(np.int32)]))
        asked = unseen & (v == RARE)
        if asked.any():
            yield from outward(5, hashed[asked], [doc[asked].astype(np.int32), size[asked].astype(np.int32), stretch[asked]])
        seen = np.flatnonzero(new)[c > 0]
        c = c[c > 0]
        if kind == 1 and len(seen):
            yield row(7, None, None, None, X.pack([v[seen], w[seen], c.astype(np.int32)]))
        elif len(seen):
            context = np.where(v[seen] == RARE, hashed[seen], m.ids[v[seen]]).view(np.int64)
            word = key[seen].view(np.int64) if kind == 2 else m.ids[other[seen]].view(np.int64)
            yield row(8, None, None, None, X.pack([context, word, c.astype(np.int32)]))
        rare = v[seen] == RARE
        if rare.any():
            yield from outward(4, hashed[seen[rare]], [c[rare], cw[seen[rare]].astype(np.int64)])
        names, place = np.unique(v[seen], return_inverse=True)
        table = [*(np.bincount(place, c == r, len(names)) for r in range(1, CUT + 2)), np.bincount(place, np.where(c > CUT, c - LARGE, 0), len(names)), np.bincount(place, p[seen], len(names))]
        contexts.append((names, *table))

    def by_name(contexts):
        names, *table = (np.concatenate(c) for c in zip(*contexts, strict=True))
        names, place = np.unique(names, return_inverse=True)
        return names, *(np.bincount(place, c, len(names)) for c in table)

    def summed(contexts):
        names, *table = by_name(contexts)
        values = np.array(table).T.ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * len(table), pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), 2), pa.int32()), pa.nulls(len(names), pa.int64()), pa.array(names, pa.int32()), lists, pa.nulls(len(names), pa.binary())], names=["kind", "stretch", "context", "sums", "blob"])

    def work(batches):
        m = at.value
        held: dict[int, list] = {1: [], 2: [], 3: []}
        last = None

        def flush():
            sums, contexts = [], []
            for kind in (1, 2, 3):
                if not held[kind]:
                    continue
                blobs, stretches = map(list, zip(*held[kind], strict=True))
                held[kind] = []
                for key, *columns in X.pieces(blobs, PIECE, stretches):
                    key = key.view(_U)
                    order = np.argsort(key) if kind == 1 else np.lexsort((columns[0], key))
                    columns = [c[order] for c in columns]
                    if kind == 1:
                        columns.insert(0, np.zeros(len(key), np.int8))
                    yield from pairs(kind, key[order], *columns, m, sums, contexts)
                    if sum(len(x[0]) for x in sums) > PIECE:
                        stretch, doc, *rest = (np.concatenate(c) for c in zip(*sums, strict=True))
                        sums[:] = [added(stretch, doc, rest)]
                    if len(contexts) > 4:
                        contexts[:] = [by_name(contexts)]
            if sums:
                yield from shares(sums)
            if contexts:
                yield from summed(contexts)

        for batch in batches:
            for b, kind, stretch, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last:
                    yield from flush()
                    last = b
                if kind == 0:
                    yield row(0, stretch, None, None, blob)
                else:
                    held[kind].append((blob, stretch))
        yield from flush()

    sent = docs.mapInArrow(lean(run), sent_kind)
    return X.dealt(sent).mapInArrow(lean(work), PARTS)


def backoff(parts: DataFrame, model: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Discounts of pair counts, and log10 of the weight of each frequent context; a row for each comes to the driver."""
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(CUT + 3)]
    rows = parts.where("kind = 2").groupBy("context").agg(*sums).collect()
    table = np.zeros((len(model.counts), CUT + 3))
    for r in rows:
        table[r["context"]] += r[1:]
    by_count = table[:, : CUT + 1]
    d = discounts([0, *by_count.sum(0)])
    used = (by_count[:, :CUT] * (np.arange(1, CUT + 1) * d[1:])).sum(1) + table[:, CUT + 1]
    count = np.maximum(model.context, 1)
    weight = (1 - used / count) / np.maximum(1 - table[:, CUT + 2], 1e-12)
    return d, np.where(model.context > 0, _log(weight), 0)


def rare_backoff(parts: DataFrame, model: Unigrams, d: np.ndarray) -> DataFrame:
    """Shares of documents (kind 6) in the score for what they ask of rare contexts, log10 of count and weight; and these contexts themselves (kind 9: hash, count, log10 of the weight)."""
    of_words = Unigrams(model.hashes[:0], model.counts[:0], model.context[:0], model.p[:0], model.d, model.total, model.types, model.unseen)

    def work(batches):
        held: dict[int, list] = {4: [], 5: []}
        last = None

        def flush():
            if held[4]:
                names = np.unique(np.concatenate([v for v, _, _ in held[4]]))
                count, used, mass = np.zeros((3, len(names)))
                for v, c, cw in held[4]:
                    at = np.searchsorted(names, v)
                    for total, x in ((count, c), (used, discounted(c, d)), (mass, of_words.p_word(cw))):
                        total += np.bincount(at, x, len(names))
                weight = _log((1 - used / np.maximum(count, 1)) / np.maximum(1 - mass, 1e-12))
                kept = X.pack([names, count.astype(np.int64), weight.view(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array([9], pa.int32()), pa.nulls(1, pa.int64()), pa.array([kept], pa.binary())], names=["kind", "stretch", "blob"])
            if held[4] and held[5]:
                asked, doc, n, stretch = (np.concatenate(c) for c in zip(*held[5], strict=True))
                at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
                each = np.where(names[at] == asked, _log(count[at]) + weight[at], 0)  # a context never seen has weight 1
                stretch, doc, total = added(stretch, doc, [n * each])
                edges = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1], [True])))
                blobs = [X.pack([doc[a:b], total[a:b].view(np.int64)]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                k = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array([6] * k, pa.int32()), pa.array(stretch[edges[:-1]]), pa.array(blobs, pa.binary())], names=["kind", "stretch", "blob"])
            held[4], held[5] = [], []

        for batch in batches:
            for b, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last:
                    yield from flush()
                    last = b
                held[kind].append(X.opened(blob))
        yield from flush()

    sent = parts.where("kind in (4, 5)").select(F.col("context").alias("bucket"), "kind", "blob")
    return X.dealt(sent).mapInArrow(lean(work), "kind int, stretch long, blob binary")


@dataclass
class Model:
    """A fitted model: tables in the shared folder, and the numbers that hold for all of it."""

    words: DataFrame  # (w, c)
    parts: DataFrame  # pairs, as kinds 7 and 8
    rare: DataFrame  # rare contexts, as kind 9
    unigrams: Unigrams
    d: np.ndarray  # discounts of pair counts
    weight: np.ndarray  # log10 of the weight of each class as a context

    def pairs(self) -> DataFrame:
        """(context, word, c, log10_p) of each pair seen but for the context's count: log10 of the discounted count."""
        ids, d = self.unigrams.ids.view(np.int64), self.d

        def run(batches):
            for batch in batches:
                for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    v, w, c = X.unpack(blob)
                    v, w = (ids[v], ids[w]) if kind == 7 else (v, w)
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(c.astype(np.int64)), pa.array(np.log10(discounted(c.astype(np.int64), d)))], names=["context", "word", "c", "log10_c"])

        return self.parts.where("kind in (7, 8)").select("kind", "blob").mapInArrow(lean(run), "context long, word long, c long, log10_c double")

    def contexts(self) -> DataFrame:
        """(context, n, log10_weight): how often words come after it, and its weight for those never seen there."""

        def run(batches):
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    v, n, weight = X.unpack(blob)
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n), pa.array(weight.view(np.float64))], names=["context", "n", "log10_weight"])

        kinds = "context long, n long, log10_weight double"
        u = self.unigrams
        some = np.flatnonzero(u.context > 0)
        frequent = pa.table([pa.array(u.ids[some].view(np.int64)), pa.array(u.context[some]), pa.array(self.weight[some])], names=["context", "n", "log10_weight"])
        rare = self.rare.where("kind = 9").select("blob").mapInArrow(lean(run), kinds)
        return rare.unionByName(self.rare.sparkSession.createDataFrame(frequent).select("context", "n", "log10_weight"))

    def evaluate(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, n_tokens, score) of any documents; rows of one key count as one document. Pairs of a document are asked for once, with their number."""

        def ask(batches):
            for batch in slices(batches, "text"):
                s = Scan(text_of(batch, "text"), lower=True)
                n = batch.num_rows
                doc, words = s.doc_of_word(), s.word_hash()
                token = np.full(len(words) + n, END_HASH, _U)
                token[np.arange(len(words)) + doc] = words
                ends = s.first[1:] + np.arange(n)
                of = np.repeat(np.arange(n), s.n_words + 1)
                before = np.concatenate((np.array([START], _U), token[:-1]))[: len(token)]
                before[np.concatenate(([0], ends[:-1] + 1))] = START
                order = np.lexsort((token, before, of))
                of, v, w = of[order], before[order], token[order]
                first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
                times = np.diff(np.concatenate((first, [len(of)])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[first])), pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(times)], names=["key", "v", "w", "times"])

        kind = docs.schema[key].dataType.simpleString()
        asked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(ask), f"key {kind}, v long, w long, times long")
        u = self.unigrams
        c = F.col("cw")
        d_word = F.create_map(*[x for r in range(1, CUT + 1) for x in (F.lit(r).cast("long"), F.lit(float(u.d[r] * r)))])
        p_word = F.when(c.isNull(), F.lit(float(u.unseen))).otherwise(F.when(c <= CUT, F.try_element_at(d_word, c)).otherwise(c - F.lit(LARGE)) / F.lit(float(max(1, u.total))))
        rows = asked.join(self.pairs().select("context", "word", "log10_c"), (F.col("v") == F.col("context")) & (F.col("w") == F.col("word")), "left").drop("context", "word")
        rows = rows.join(self.contexts(), F.col("v") == F.col("context"), "left").drop("context")
        rows = rows.join(self.words.select(F.col("w").alias("word"), F.col("c").alias("cw")), F.col("w") == F.col("word"), "left")
        log10_p = F.when(F.col("log10_c").isNotNull(), F.col("log10_c") - F.log10("n")).otherwise(F.log10(p_word) + F.coalesce("log10_weight", F.lit(0.0)))
        sums = rows.groupBy("key").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * log10_p).alias("score"))
        return sums.withColumnRenamed("key", key)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """Rows whose crc32(key) modulo 7 is 2 are held out of training."""
    return fit_and_score(docs, key, text, vocabulary)[1]


def fit_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model of the rows that are not held out, and the scores of all rows."""
    spark = docs.sparkSession
    held = F.coalesce(crc_remainder(key, 7) == 2, F.lit(False))
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), held.alias("held"))
    words = stage(word_counts(plain), "unigrams")
    model = unigrams(words, vocabulary)
    parts = stage(_shares(plain, model), "shares")
    d, weight = backoff(parts, model)
    factor = np.log10(np.arange(1, CUT + 1) * d[1:])
    at = spark.sparkContext.broadcast((factor, weight))
    norm, total = np.log10(model.total + model.types + 1), model.total
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(batches):
        factor, weight = at.value
        last, roster, held = None, None, []

        def flush():
            keys, nulls, out, tokens, known, more, ctx = roster
            known, more, total_score = known.copy(), more.view(np.float64).copy(), ctx.view(np.float64).copy()
            for kind, blob in held:
                if kind == 3:
                    doc, v, n = X.unpack(blob)
                    np.add.at(total_score, doc, n * weight[v])
                    continue
                if kind == 6:
                    doc, s = X.unpack(blob)
                    total_score[doc] += s.view(np.float64)
                    continue
                doc, *r, k, s, m = X.unpack(blob)
                known[doc] += k
                total_score[doc] += s.view(np.float64) + np.array(r).T @ factor
                more[doc] += m.view(np.float64)
            columns = [pa.array(keys, mask=nulls.astype(bool)), pa.array(out.astype(bool)), pa.array(tokens), pa.array(known), pa.array(np.full(len(keys), total)), pa.array(more - tokens * norm), pa.array(total_score)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for kind, stretch, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stretch != last:
                    if roster is not None:
                        yield from flush()
                    last, roster, held = stretch, None, []
                if kind == 0:
                    roster = X.unpack(blob)
                else:
                    held.append((kind, blob))
        if roster is not None:
            yield from flush()

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rare = stage(rare_backoff(parts, model, d), "contexts")
    shares = parts.where("kind in (0, 1, 3)").select("kind", "stretch", "blob").unionByName(rare.where("kind = 6"))
    rows = shares.repartition("stretch").sortWithinPartitions("stretch", "kind")
    return Model(words, parts, rare, model, d, weight), rows.mapInArrow(lean(finish), kinds)


def op3_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
