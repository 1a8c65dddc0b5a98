"""Tips and weak chains removed in rounds, without a table of edges.

Chains are joined in buckets of nodes first, as for unitigs, and their pieces by tables. A chain that a round leaves stays whole in all later ones, so rounds go by
chains: ends, numbers of edges, weights. In the end the pieces that are left go back to their buckets, where a second pass over the reads has the edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.kmers import SOLID
from strandweave.operators.rescue import EDGES, spelled_edges
from strandweave.operators.superkmers import SENT, lean, meet, partitions
from strandweave.operators.unitigs import _sent, bucket_chains, bucket_edges
from strandweave.plans.staging import Rounds

_U = np.uint64
_LEFT = b"\xff\xff\xff\xff"  # begins blobs of pieces; those of runs begin with how many there are


def _pieces(reads: DataFrame, k: int, least: int) -> DataFrame:
    """(last, begin, starts, n, w, bucket): pieces of chains by their last edge, and the edge each begins with, which belongs to another piece unless the chain starts there.
    Without a last edge: how many edges of a bucket are solid, and their weight."""

    def work(blobs, bucket):
        edge, weight, a, b = bucket_edges(blobs, k, least)
        solid = a & (weight >= SOLID)
        head, _, last = bucket_chains(edge, a, b, k)
        own = a & (head >= 0)
        n, w = np.bincount(head[own], minlength=len(edge)), np.bincount(head[own], weights=weight[own], minlength=len(edge)).astype(np.int64)
        end = np.flatnonzero(last & own)
        at = head[end]
        columns = edge[end].view(np.int64), edge[at].view(np.int64), a[at], n[at], w[at]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(end), bucket, np.int32))], names=names)
        one = [None], [None], [None], [int(solid.sum())], [int(weight[solid].sum())], [bucket]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=names)

    names = ["last", "begin", "starts", "n", "w", "bucket"]
    return meet(_sent(reads, k), work, "last long, begin long, starts boolean, n long, w long, bucket int", named=True)


def _settled(state: DataFrame, name: str) -> tuple[DataFrame, Rounds]:
    """(id, up, head, n, w, tag) with the head of each chain of links from ``up`` to ``id``, and n and w summed from there; cycles are left out. Also the files that hold it."""
    rounds = Rounds(state.sparkSession, name)
    state = rounds.put(state)
    waiting = state.where("head is null").count()
    while waiting:
        ahead = state.select(F.col("id").alias("i2"), F.col("up").alias("u2"), F.col("head").alias("h2"), F.col("n").alias("n2"), F.col("w").alias("w2"))
        moving = state.where("head is null").join(ahead, F.col("up") == F.col("i2")).select("id", F.col("u2").alias("up"), F.col("h2").alias("head"), (F.col("n") + F.col("n2")).alias("n"), (F.col("w") + F.col("w2")).alias("w"), "tag")
        state = rounds.put(state.where("head is not null").unionByName(moving))
        before, waiting = waiting, state.where("head is null").count()
        if waiting == before:  # cycles
            break
    rounds.drop(1)
    return state.where("head is not null"), rounds


def _left(chains: DataFrame, k: int, average: float, loops: int) -> DataFrame:
    """Of chains (id, n, w, tag), by their first edge and with their last node as tag, those left after the rounds of ``debruijn.trim``."""
    spark = chains.sparkSession
    rounds, ends = Rounds(spark, "left"), Rounds(spark, "ends")
    chains = rounds.put(chains)
    first = F.shiftright("id", 2)
    for _ in range(loops):
        sides = F.array(
            F.struct(first.alias("node"), F.lit(None).cast("long").alias("into"), F.col("id").alias("out")), F.struct(F.col("tag").alias("node"), F.col("id").alias("into"), F.lit(None).cast("long").alias("out"))
        )
        nodes = ends.put(chains.select(F.explode(sides).alias("e")).select("e.*").groupBy("node").agg(F.count("into").alias("indeg"), F.count("out").alias("outdeg"), F.max("into").alias("into"), F.max("out").alias("out")))
        ups = nodes.where("indeg = 1 and outdeg = 1").select(F.col("out").alias("i"), F.col("into").alias("up"))
        joined, steps = _settled(chains.join(ups, F.col("id") == F.col("i"), "left").select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("head"), "n", "w", "tag"), "steps")
        whole = joined.groupBy(F.col("head").alias("id")).agg(F.max(F.struct("n", "w", "tag")).alias("m")).select("id", "m.*")
        front = nodes.select(F.col("node").alias("f"), F.col("indeg").alias("fi"), F.col("outdeg").alias("fo"))
        back = nodes.select(F.col("node").alias("b"), F.col("indeg").alias("bi"), F.col("outdeg").alias("bo"))
        whole = whole.join(front, first == F.col("f")).join(back, F.col("tag") == F.col("b")).withColumn("c", F.col("w") / F.col("n"))
        short, weak = F.col("n") < k, F.col("c") < average / 5
        tip = ((F.col("fi") == 0) & (F.col("fo") == 1)) | ((F.col("bi") == 1) & (F.col("bo") == 0))
        bad = F.when(tip, short | weak).otherwise((short & weak) | (F.col("c") <= 3) | (F.col("c") < average / 10))
        stay = joined.select(F.col("id").alias("i"), "head").join(whole.where(bad).select(F.col("id").alias("g")), F.col("head") == F.col("g"), "left_anti").select("i")
        chains = rounds.put(chains.join(stay, F.col("id") == F.col("i"), "left_semi"))
        steps.drop()
    return chains


def trimmed_edges(reads: DataFrame, k: int, least: int = 2, loops: int = 2) -> DataFrame:
    """(src, dst, base, weight), as from ``debruijn.trim``, of the graph of the k-mers of (seq) on both strands with a count of at least ``least``, which is ``SOLID`` at most.
    The average is that of the solid counts. k is odd, and from 3 to 31; there is one round at least."""
    spark, reads, parts = reads.sparkSession, reads.select("seq"), partitions(reads)
    found = Rounds(spark, "pieces")
    pieces = found.put(_pieces(reads, k, least))
    solid = pieces.where("last is null").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    average = solid["w"] / solid["n"] if solid["n"] else 1.0
    begin = F.col("begin")
    state = pieces.where("last is not null").select(F.col("last").alias("id"), F.when(~F.col("starts"), begin).alias("up"), F.when(F.col("starts"), begin).alias("head"), "n", "w", F.col("bucket").alias("tag"))
    placed, _ = _settled(state, "placed")
    found.drop()
    chains = placed.groupBy(F.col("head").alias("id")).agg(F.max(F.struct("n", "w", "id")).alias("m"))
    chains = chains.select("id", "m.n", "m.w", F.col("m.id").bitwiseAND((1 << 2 * (k - 1)) - 1).alias("tag"))
    left = _left(chains, k, average, loops).select(F.col("id").alias("l"))
    stay = placed.join(left, F.col("head") == F.col("l"), "left_semi").select("tag", "id")

    def back(batches):
        for batch in batches:
            bucket, last = (np.asarray(c) for c in batch.columns)
            order = np.argsort(bucket, kind="stable")
            bucket, last = bucket[order], last[order]
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
            own = bucket[edges[:-1]]
            blobs = [_LEFT + last[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own % parts, pa.int32()), pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "bucket", "blob"])

    def work(blobs):
        stay = [np.frombuffer(x, np.int64, offset=4) for x in blobs if x[:4] == _LEFT]
        if not stay:
            return
        edge, weight, a, b = bucket_edges([x for x in blobs if x[:4] != _LEFT], k, least)
        head, _, last = bucket_chains(edge, a, b, k)
        end = np.flatnonzero(last & a & (head >= 0))
        good = np.zeros(len(edge), bool)
        good[head[end]] = np.isin(edge[end].view(np.int64), np.concatenate(stay))
        kept = a & (head >= 0)
        kept[kept] = good[head[kept]]
        yield from spelled_edges(edge[kept], weight[kept], k)

    return meet(_sent(reads, k).unionByName(stay.mapInArrow(lean(back), SENT)), work, EDGES)
