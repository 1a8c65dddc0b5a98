"""Edges of count over 1 and the rescued ones of count 1, decided within buckets of middles.

The middle of an edge is its k-mer without the first and the last letter. Edges that can keep each other out share their middle, and the edges at the ends
of an edge hold its middle as their first, inner or last letters. So all that decides on an edge comes to the bucket of its middle's minimizer,
with full counts, and it is decided there without a table of edges. An edge may be in up to three buckets; it counts where its middle is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandweave.operators.kmers import ROWS, letters_of, strings
from strandweave.operators.superkmers import PIECES, SENT, chunks, cut_up, lean, meet, opened, packed, partitions, places, reversed_complement

_U = np.uint64
EDGES = "src string, dst string, base string, weight long"


def spelled_edges(edge: np.ndarray, weight: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(src, dst, base, weight) of edges as numbers."""
    for at in range(0, len(edge), ROWS):
        x = letters_of(edge[at : at + ROWS], k)
        yield pa.RecordBatch.from_arrays([strings(x[:, :-1]), strings(x[:, 1:]), strings(x[:, -1:]), pa.array(weight[at : at + ROWS])], names=["src", "dst", "base", "weight"])


def _sent(rows: DataFrame, k: int) -> DataFrame:
    """Runs of middles of one bucket with up to two letters before and after them, as runs of edges; of these letters, how many there are."""
    parts = partitions(rows)

    def run(batches):
        for data, bounds, _ in chunks(batches):
            codes, start, n, bucket = cut_up(data, bounds[:-1], k - 2, parts * PIECES)
            if not len(start):
                continue
            joined = (start[1:] == start[:-1] + n[:-1]) & (bucket[1:] == bucket[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~joined)))
            start, n, bucket = start[first], np.add.reduceat(n, first), bucket[first]
            # on: the next run begins at the next window. Past a run of one window is the run after that, or nothing
            on = np.concatenate((start[1:] == start[:-1] + n[:-1], [False]))
            next_n, next_on, before_n, before_on = np.append(n[1:], 0), np.append(on[1:], False), np.append(0, n[:-1]), np.append(False, on[:-1])
            after = np.where(on, 1 + ((next_n > 1) | next_on), 0)
            before = np.where(before_on, 1 + ((before_n > 1) | np.append(False, before_on[:-1])), 0)
            # an edge that goes over one window back into its bucket comes with the later run only
            after -= on & (next_n == 1) & next_on & (np.append(bucket[2:], [-1, -1])[: len(n)] == bucket)
            edges = n + before + after - 2
            kept = edges > 0
            yield from packed(codes, (start - before)[kept], edges[kept], bucket[kept], k, parts, [before[kept].astype(np.int8), after[kept].astype(np.int8)])

    return rows.mapInArrow(lean(run), SENT)


def _either(nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The lesser one of each node and its reverse complement, and whether that is the node itself."""
    other = reversed_complement(nodes, k - 1)
    return np.minimum(nodes, other), nodes <= other


def _taken(edge: np.ndarray, k: int) -> np.ndarray:
    """Those that are taken of candidates, in order of the k-mer, when each keeps later ones from its ends."""
    middle = (edge >> _U(2)) & _U((1 << 2 * (k - 2)) - 1)
    order = np.lexsort((edge, middle))
    edge, middle = edge[order], middle[order]
    x, y = _U(1) << (edge >> _U(2 * (k - 1))), _U(1) << (edge & _U(3))
    new = np.concatenate(([True], middle[1:] != middle[:-1])) if len(edge) else np.zeros(0, bool)
    block = np.cumsum(new) - 1
    rank = places(np.diff(np.append(np.flatnonzero(new), len(edge))))
    used_x, used_y, taken = np.zeros(len(edge), _U), np.zeros(len(edge), _U), np.zeros(len(edge), bool)
    for r in range(int(rank.max()) + 1 if len(edge) else 0):  # 16 at most
        at = np.flatnonzero(rank == r)
        at = at[((used_x[block[at]] & x[at]) | (used_y[block[at]] & y[at])) == 0]
        taken[at] = True
        used_x[block[at]] |= x[at]
        used_y[block[at]] |= y[at]
    return edge[taken]


def _rescued(edge: np.ndarray, single: np.ndarray, k: int) -> np.ndarray:
    """Edges to rescue of the candidates ``single``, given the graph's edges; all of them the lesser of both strands. The result has both."""
    low = _U((1 << 2 * (k - 1)) - 1)
    # the sides of nodes that edges are at: 1 is where a node, as the lesser strand, goes on
    (a, own_a), (b, own_b) = _either(edge >> _U(2), k), _either(edge & low, k)
    sides = np.concatenate(((a << _U(1)) | own_a.astype(_U), (b << _U(1)) | (~own_b).astype(_U)))
    sides.sort()
    sides = sides[np.concatenate(([True], sides[1:] != sides[:-1]))] if len(sides) else sides
    node = sides >> _U(1)
    double = np.concatenate((node[1:] == node[:-1], [False])) if len(node) else np.zeros(0, bool)
    dead = sides[~(double | np.concatenate(([False], double))[: len(node)])]
    node = dead >> _U(1)
    dead = dead[reversed_complement(node, k - 1) != node]  # a node that is its own reverse complement goes on both ways

    def among(keys):
        at = np.searchsorted(dead, keys)
        return dead[np.minimum(at, len(dead) - 1)] == keys

    if not len(dead):
        return single[:0]
    a, own = _either(single >> _U(2), k)
    single = single[among((a << _U(1)) | (~own).astype(_U))]
    b, own = _either(single & low, k)
    single = single[among((b << _U(1)) | own.astype(_U))]
    return _taken(np.concatenate((single, reversed_complement(single, k))), k)


def rescued_edges(reads: DataFrame, k: int) -> DataFrame:
    """(src, dst, base, weight), as from ``debruijn.rescue_singletons``, of the k-mers of (seq) on both strands. k is from 4 to 31."""

    def work(blobs):
        numbers, n, (before, after) = opened(blobs, k)
        j, many = places(n), np.repeat(n, n)
        here = (j + 1 >= np.repeat(before, n)) & (j + 1 < many + 2 - np.repeat(after, n))
        keys = (np.minimum(numbers, reversed_complement(numbers, k)) << _U(1)) | here.astype(_U)
        del numbers, j, many, here
        keys.sort()
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        weight, keys = np.diff(np.append(at, len(keys))), keys[at]
        edge, here = keys >> _U(1), (keys & _U(1)).astype(bool)
        if k % 2 == 0:  # a k-mer that is its own reverse complement is on either strand
            weight = np.where(reversed_complement(edge, k) == edge, 2 * weight, weight)
        main = weight > 1
        some = _rescued(edge[main], edge[~main & here], k)
        edge, weight = edge[main & here], weight[main & here]
        back = reversed_complement(edge, k)
        twice = back != edge
        yield from spelled_edges(edge, weight, k)
        yield from spelled_edges(back[twice], weight[twice], k)
        yield from spelled_edges(some, np.ones(len(some), np.int64), k)

    return meet(_sent(reads.select("seq"), k), work, EDGES)
