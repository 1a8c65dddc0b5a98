"""Removal of repeated passages, anchored by a difference cover.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that covers it occurs anywhere else, in
the same document or another. Places modulo 21 in {0, 1, 6, 8, 18} form a difference cover: whatever the places of
two equal windows, some shift below 21 brings both to cover places. So it is enough to hash the 15 words at
cover places (a quarter of all):

1. Anchors that occur once are dropped; documents learn the places of those that occur again.
2. Each such anchor extends to the windows that hold it, up to 20 words before; their 96-bit hashes meet,
   and documents learn which windows occur again.
3. Words under those windows are cut. Windows are judged on the input, not on what is left.

Texts move once, and only those of documents with repeated anchors as far as a bitmap of fixed size can tell.

Null or empty texts have no words. Texts under 35 words have no windows and stay. Repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import exchange as X
from strandweave.llm.frames import lean, load, small_batches
from strandweave.llm.textscan import Scan, mix, slices, text_of, window_hash
from strandweave.plans.staging import cut

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 6, 8, 18)
ANCHOR = WINDOW - PERIOD + 1
STRETCH = 1_000_000
_U = np.uint64
_IS_COVER = np.zeros(PERIOD, bool)
_IS_COVER[list(COVER)] = True
HITS = "uid long, at binary"


def _group(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, and in that order: first of its group, and alone in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    last = np.ones(len(order), bool)
    last[:-1] = new[1:]
    return order, new, new & last


def _ask(keys: list[np.ndarray], uid: np.ndarray, at: np.ndarray, buckets: int):
    """Blobs of a stretch: keys that are alone in it with their place, one witness of each of the others, and the
    places already known to be repeated, which travel by document instead."""
    order, new, alone = _group(keys)
    witness = new & ~alone
    send = order[alone | witness]
    place = np.where(alone, at[order], -1)[alone | witness]
    owner = np.where(alone, uid[order], 0)[alone | witness]
    known = order[~alone]
    pairs = np.unique(np.stack((uid[known], at[known])), axis=1) if len(known) else np.zeros((2, 0), np.int64)
    spare = [np.concatenate((k[send], np.zeros(pairs.shape[1], k.dtype))) for k in keys[1:]]
    key = np.concatenate((keys[0][send], mix(pairs[0].astype(np.int64).view(_U))))
    uids = np.concatenate((owner, pairs[0])).astype(np.int64)
    places = np.concatenate((place, -2 - pairs[1])).astype(np.int32)
    table, at = np.unique(uids, return_inverse=True)
    yield from X.blobs(key, [*spare, places], buckets, at, (table,))


def _answer(columns: list[np.ndarray], buckets: int):
    """Of a range of keys, the places of those that occur again, as blobs by document."""
    *keys, at, uid = columns
    told = at <= -2
    hit_uid, hit_at = [uid[told]], [-2 - at[told]]
    keys = [k[~told] for k in keys]
    uid, at = uid[~told], at[~told]
    if len(uid):
        order, _, alone = _group(keys)
        # a witness stands for two or more, even if no other stretch has its key
        again = order[~alone]
        again = again[at[again] >= 0]
        hit_uid.append(uid[again])
        hit_at.append(at[again])
    uids, places = np.concatenate(hit_uid), np.concatenate(hit_at).astype(np.int32)
    if len(uids):
        yield from X.blobs(mix(uids.view(_U)), [uids, places], buckets)


def _merge(columns: list[np.ndarray]):
    """A row per document of a range, with its places."""
    _, uids, places = columns
    order = np.lexsort((places, uids))
    uids, places = uids[order], places[order]
    keep = np.ones(len(uids), bool)
    keep[1:] = (uids[1:] != uids[:-1]) | (places[1:] != places[:-1])
    uids, places = uids[keep], places[keep]
    first = np.flatnonzero(np.concatenate(([True], uids[1:] != uids[:-1])))
    offsets = np.concatenate((first, [len(uids)])).astype(np.int32) * 4
    at_array = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(places))])
    yield pa.RecordBatch.from_arrays([pa.array(uids[first]), at_array], names=["uid", "at"])


def _hits(asked: DataFrame) -> DataFrame:
    """(uid, at): for each document with keys that occur again, all of their places."""
    buckets = X.buckets_of(asked)
    return cut(X.meet(X.meet(asked, lambda c: _answer(c, buckets), X.BLOBS), _merge, HITS))


def _anchors(docs: DataFrame) -> DataFrame:
    """Blobs of the anchors of (uid, text) rows."""
    buckets = X.buckets_of(docs)

    def run(batches):
        held, n = [], 0
        for batch in slices(batches, "text"):
            s = Scan(text_of(batch, "text"))
            at, doc = s.windows(ANCHOR)
            place = at - s.first[doc]
            good = _IS_COVER[place % PERIOD] & (s.n_words[doc] >= WINDOW)
            at, doc, place = at[good], doc[good], place[good]
            uid = np.asarray(batch.column(0))
            held.append((window_hash(s.word_hash(), at, ANCHOR), uid[doc], place.astype(np.int64)))
            n += len(at)
            if n >= STRETCH:
                key, u, p = (np.concatenate(c) for c in zip(*held, strict=True))
                yield from _ask([key], u, p, buckets)
                held, n = [], 0
        if n:
            key, u, p = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from _ask([key], u, p, buckets)

    return docs.select("uid", "text").mapInArrow(lean(run), X.BLOBS)


def _windows(docs: DataFrame) -> DataFrame:
    """Blobs of the windows that hold a repeated anchor, of (uid, text, at) rows."""
    buckets = X.buckets_of(docs)
    text_at, ats_at, uid_at = (docs.columns.index(c) for c in ("text", "at", "uid"))

    def run(batches):
        held, n = [], 0

        def flush():
            a, b, u, p = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from _ask([a, b], u, p, buckets)

        for batch in slices(batches, "text"):
            s = Scan(text_of(batch, "text"))
            words, uid = s.word_hash(), np.asarray(batch.column(uid_at))
            wanted = np.zeros(len(words) + 1, np.int64)
            last = np.maximum(s.first[1:] - WINDOW, s.first[:-1] - 1)  # last window of each document
            for i, places in enumerate(batch.column(ats_at).to_pylist()):
                if last[i] < s.first[i]:
                    continue
                hit = np.frombuffer(places, "<i4") + int(s.first[i])
                lo = np.maximum(hit - (PERIOD - 1), s.first[i])
                hi = np.minimum(hit, last[i])
                ok = hi >= lo
                np.add.at(wanted, lo[ok], 1)
                np.add.at(wanted, hi[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            doc = np.searchsorted(s.first, at, "right") - 1
            check = (window_hash(words, at, WINDOW, 9) >> _U(32)).astype(np.uint32).view(np.int32)
            held.append((window_hash(words, at, WINDOW, 8), check, uid[doc], (at - s.first[doc]).astype(np.int64)))
            n += len(at)
            if n >= STRETCH:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return docs.mapInArrow(lean(run), X.BLOBS)


def _covered(n: int, places: bytes) -> np.ndarray:
    """Which of n words lie under a window at one of the places."""
    change = np.zeros(n + 1, np.int64)
    at = np.frombuffer(places, "<i4")
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def cut_repeats(docs: DataFrame, keep: list[str], text: str = "text", with_text: bool = False) -> DataFrame:
    """The columns ``keep`` with n_words, n_removed and kept_sha256 (of the kept words joined by single spaces).

    With ``with_text``, kept_text too: the text itself where nothing goes, else the kept words with the white
    space that followed each of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.xxhash64(*[f.name for f in docs.schema if "map" not in f.dataType.simpleString()]).alias("uid"), F.col(text).alias("text"), F.struct(*keep).alias("row"))
    hits = _hits(_anchors(plain))
    first = spark.sparkContext.broadcast(X.Membership.of(hits.select("uid"), "uid"))

    row_type = docs.select(F.struct(*keep).alias("row")).schema[0]
    moving_type = T.StructType([T.StructField("uid", T.LongType()), T.StructField("text", T.StringType()), row_type])

    def moving(batches):
        for batch in batches:
            yield batch.filter(pa.array(first.value.has(np.asarray(batch.column(0)))))

    moved = plain.mapInArrow(lean(moving), moving_type)
    asked = moved.join(hits.withColumnRenamed("uid", "hit"), F.col("uid") == F.col("hit")).select("uid", "text", "row", "at")
    marked = _hits(_windows(asked)).withColumnRenamed("uid", "hit")

    kinds = T.StructType([row_type, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        kinds.add("kept_text", "string")

    def finish(batches, rest: bool):
        for batch in slices(batches, "text"):
            if rest:
                batch = batch.filter(pa.array(~first.value.has(np.asarray(batch.column(0)))))
                if not batch.num_rows:
                    continue
            texts = text_of(batch, "text").cast(pa.binary()).to_pylist()
            all_ats = [None] * len(texts) if rest else batch.column(3).to_pylist()
            n, gone, sha, kept = [], [], [], []
            for t, ats in zip(texts, all_ats, strict=True):
                words = t.split()
                n.append(len(words))
                if not ats:
                    gone.append(0)
                    kept.append(t.decode())
                else:
                    bad = _covered(len(words), ats)
                    gone.append(int(bad.sum()))
                    if with_text:
                        kept.append(_without(t, bad))
                    words = [w for w, b in zip(words, bad.tolist(), strict=True) if not b]
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            columns = [batch.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if with_text else []), names=kinds.names)

    untouched = plain.mapInArrow(lean(lambda b: finish(b, True)), kinds)
    touched = moved.join(marked, F.col("uid") == F.col("hit"), "left").select("uid", "text", "row", "at").mapInArrow(lean(lambda b: finish(b, False)), kinds)
    out = untouched.unionByName(touched)
    return out.select("row.*", *kinds.names[1:])


def _without(text: bytes, bad: np.ndarray) -> str:
    s = Scan(pa.array([text.decode()], pa.string()))
    gone = np.zeros(len(text) + 1, np.int64)
    until = np.concatenate((s.starts[1:], [len(text)]))
    gone[s.starts[bad]] += 1
    np.add.at(gone, until[bad], -1)
    return np.frombuffer(text, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes().decode()


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(load(spark, sf_dir, "documents"), ["doc_id"])
