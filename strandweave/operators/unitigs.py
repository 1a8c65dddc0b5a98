"""Chains of a de Bruijn graph, joined within buckets of nodes first.

All edges at a node come to the bucket of its minimizer, with their full counts. There a chain is joined as far as the nodes of the bucket reach, and only
the pieces, about one for ten edges, are joined by tables. An edge between nodes of two buckets is in both; it counts where its first node is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.kmers import unpacked
from strandweave.operators.superkmers import _CODE, PIECES, chunks, cut_up, lean, meet, opened, packed, partitions, places, reversed_complement
from strandweave.operators.superkmers import SENT
from strandweave.plans.staging import Rounds

_U = np.uint64


def _sent(rows: DataFrame, k: int) -> DataFrame:
    """Runs of nodes of one bucket with the letter before and after them, as runs of edges."""
    parts = partitions(rows)

    def run(batches):
        for data, bounds, _ in chunks(batches):
            codes, start, n, bucket = cut_up(data, bounds[:-1], k - 1, parts * PIECES)
            if not len(start):
                continue
            joined = (start[1:] == start[:-1] + n[:-1]) & (bucket[1:] == bucket[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~joined)))
            start, n, bucket = start[first], np.add.reduceat(n, first), bucket[first]
            # an edge goes over to the next run where that begins at the next window
            on = np.concatenate((start[1:] == start[:-1] + n[:-1], [False]))
            before = np.concatenate(([False], on[:-1]))
            edges = n - 1 + before + on
            kept = edges > 0
            yield from packed(codes, (start - before)[kept], edges[kept], bucket[kept], k, parts, [before[kept].astype(np.int8), on[kept].astype(np.int8)])

    return rows.mapInArrow(lean(run), SENT)


def bucket_edges(blobs: list[bytes], k: int, least: int = 1) -> tuple[np.ndarray, ...]:
    """(edge, weight, src_here, dst_here) of both strands, in order of the edges, of those with a weight of at least ``least``: whether the nodes belong to this bucket."""
    numbers, n, (before, after) = opened(blobs, k)
    j, many = places(n), np.repeat(n, n)
    src, dst = (j > 0) | (np.repeat(before, n) == 0), (j < many - 1) | (np.repeat(after, n) == 0)
    rc = reversed_complement(numbers, k)
    turned = rc < numbers
    # of the other strand, the nodes change places; equal edges of a bucket have the same two bits
    keys = (np.where(turned, rc, numbers) << _U(2)) | (np.where(turned, dst, src).astype(_U) << _U(1)) | np.where(turned, src, dst).astype(_U)
    del numbers, j, many, src, dst, rc, turned
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, weight = keys[first], np.diff(np.append(first, len(keys)))
    canon = keys >> _U(2)
    twice = reversed_complement(canon, k) != canon
    weight = weight * np.where(twice, 1, 2)
    kept = weight >= least
    keys, canon, weight, twice = keys[kept], canon[kept], weight[kept], twice[kept]
    a, b = (keys & _U(2)) > 0, (keys & _U(1)) > 0
    edge = np.concatenate((canon, reversed_complement(canon[twice], k)))
    order = np.argsort(edge)
    return edge[order], np.concatenate((weight, weight[twice]))[order], np.concatenate((a, b[twice]))[order], np.concatenate((b, a[twice]))[order]


def _alone(nodes: np.ndarray) -> np.ndarray:
    """Of nodes in order, whether each is there once."""
    new = np.concatenate(([True], nodes[1:] != nodes[:-1], [True]))
    return new[:-1][: len(nodes)] & new[1:][: len(nodes)]


def bucket_chains(edge: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, rank, last) of the edges of a bucket: the place of the edge with which each one's piece of a chain begins, or -1 on a cycle, how far it is from there, and whether the piece ends with it."""
    src, dst = edge >> _U(2), edge & _U((1 << 2 * (k - 1)) - 1)
    out, in_ = np.flatnonzero(a), np.flatnonzero(b)  # src is in order, as edges are
    in_ = in_[np.argsort(dst[in_])]
    out, in_ = out[_alone(src[out])], in_[_alone(dst[in_])]
    up, last = np.full(len(edge), -1, np.int64), np.ones(len(edge), bool)
    if len(out):
        to = np.minimum(np.searchsorted(src[out], dst[in_]), len(out) - 1)
        met = src[out[to]] == dst[in_]
        up[out[to[met]]] = in_[met]
        last[in_[met]] = False
    head, rank = np.where(up < 0, np.arange(len(edge)), -1), (up >= 0).astype(np.int64)
    open_ = np.flatnonzero(up >= 0)
    while len(open_):
        j = up[open_]
        found, step_rank, step = head[j], rank[j], up[j]
        head[open_] = found
        rank[open_] += step_rank
        up[open_] = np.where(found >= 0, -1, step)
        left = found < 0
        if left.all() and (rank[open_] > 2 * len(edge)).any():
            break  # what is left are cycles
        open_ = open_[left]
    return head, rank, last


def bucket_pieces(edge: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(last, up, n, w, seq, src): pieces of chains in the bucket. ``up`` is the edge of another bucket with which a piece goes on, null where a chain starts; seq has the last letters of its own edges."""
    src, dst = edge >> _U(2), edge & _U((1 << 2 * (k - 1)) - 1)
    head, rank, _ = bucket_chains(edge, a, b, k)
    kept = np.flatnonzero(head >= 0)
    kept = kept[np.lexsort((rank[kept], head[kept]))]
    own = a[kept]
    first = np.flatnonzero(np.concatenate(([True], head[kept][1:] != head[kept][:-1])))
    n = np.add.reduceat(own.astype(np.int64), first) if len(kept) else np.zeros(0, np.int64)
    if not len(kept):
        return
    w = np.add.reduceat(np.where(own, weight[kept], 0), first)
    last = kept[np.append(first[1:], len(kept)) - 1]
    begin = kept[first]
    some = n > 0
    letters = np.frombuffer(b"ACGT", np.uint8)[(edge[kept][own] & _U(3)).astype(np.int64)]
    offsets = np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32)
    begin, last = begin[some], last[some]
    yield pa.RecordBatch.from_arrays([
        pa.array(edge[last].view(np.int64)), pa.array(edge[begin].view(np.int64), mask=a[begin]), pa.array(n[some]), pa.array(w[some]),
        pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(letters)), pa.array(src[begin].view(np.int64)), pa.array(dst[last].view(np.int64)),
    ], names=["last", "up", "n", "w", "seq", "src", "dst"])


def chains(reads: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(head, src_node, dst_node, seq, coverage, n_edges), as from ``debruijn.contract``, of the graph of the k-mers of (seq) on both strands with a count of at least ``least``. k is odd, and 31 at most."""

    def work(blobs):
        yield from bucket_pieces(*bucket_edges(blobs, k, least), k)

    rounds = Rounds(reads.sparkSession, "pieces")
    pieces = Rounds(reads.sparkSession, "units").put(meet(_sent(reads.select("seq"), k), work, "last long, up long, n long, w long, seq string, src long, dst long"))
    state = rounds.put(pieces.select("last", "up", F.when(F.col("up").isNull(), F.col("last")).alias("head"), F.col("n").alias("to")))
    waiting = state.where("head is null").count()
    while waiting:
        ahead = state.select(F.col("last").alias("l2"), F.col("up").alias("u2"), F.col("head").alias("h2"), F.col("to").alias("t2"))
        moving = state.where("head is null").join(ahead, F.col("up") == F.col("l2")).select("last", F.col("u2").alias("up"), F.col("h2").alias("head"), (F.col("to") + F.col("t2")).alias("to"))
        state = rounds.put(state.where("head is not null").unionByName(moving))
        before, waiting = waiting, state.where("head is null").count()
        if waiting == before:  # cycles
            break
    placed = state.where("head is not null").select(F.col("last").alias("l"), "head", "to")
    rows = pieces.join(placed, F.col("last") == F.col("l")).groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("to", "seq"))).alias("c"), F.sum("w").alias("w"), F.sum("n").alias("n_edges"), F.min_by("src", "to").alias("src"), F.max_by("dst", "to").alias("dst"),
    )
    rows = rows.select("src", "dst", F.array_join(F.transform("c", lambda x: x["seq"]), "").alias("seq"), "w", "n_edges")

    def spell(batches):
        for x in batches:
            a, b = (unpacked(np.asarray(x.column(i)), k - 1) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b, *x.columns[2:]], names=["src_node", "dst_node", "rest", "w", "n_edges"])

    named = rows.mapInArrow(spell, "src_node string, dst_node string, rest string, w long, n_edges long")
    head = F.concat("src_node", F.substring("rest", 1, 1))
    return named.select(head.alias("head"), "src_node", "dst_node", F.concat("src_node", "rest").alias("seq"), (F.col("w") / F.col("n_edges")).alias("coverage"), "n_edges")
