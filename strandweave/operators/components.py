"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.plans.staging import Rounds


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "w"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))


ONE_TASK = 1 << 20  # edges of 16 bytes, so 16 MB, and a few times that while they are solved


def solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[label]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if held:
            nodes, least = solve(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node. Self-loops count as nodes.

    Every round is a constant number of equi-joins with aggregated sides, cut to the shared folder; edges only ever
    point to smaller nodes, so the number of rounds is logarithmic in practice. Edges between whole numbers that are counted to be at most
    ``ONE_TASK`` are solved by one task instead, with the same result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    alone = pairs.where("u = v").select("u").distinct()
    rounds = Rounds(edges.sparkSession, "components")
    now, seen = rounds.put(_canonical(pairs)), None
    if all(isinstance(f.dataType, T.LongType) for f in now.schema) and now.count() <= ONE_TASK:
        found = rounds.put(_in_one_task(now))
        return found.unionByName(_apart(alone, found))
    while True:
        now = rounds.put(_canonical(_small_star(_canonical(_large_star(now)))))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = members.unionByName(roots)
    return found.unionByName(_apart(alone, found))


def _apart(alone: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with an edge to themselves only."""
    return alone.join(found, F.col("u") == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
