"""De Bruijn graph as an edge list: build, rescue, contract, trim.

An edge is a k-mer from its first k - 1 letters to its last, weighted by its count. Nodes exist only through edges.
Loops cut their lineage in the shared folder each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.plans.staging import Rounds, cut, stage


def edges(counts: DataFrame) -> DataFrame:
    """(src, dst, base, weight) of (kmer, cnt)."""
    k = F.length("kmer")
    return counts.select(F.substring("kmer", F.lit(1), k - 1).alias("src"), F.substring("kmer", F.lit(2), k - 1).alias("dst"), F.right("kmer", F.lit(1)).alias("base"), F.col("cnt").alias("weight"))


def degrees(graph: DataFrame) -> DataFrame:
    """(node, indeg, outdeg) from one pass over the edges."""
    ends = graph.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.select("e.*").groupBy("node").agg(F.sum("i").cast("long").alias("indeg"), F.sum("o").cast("long").alias("outdeg"))


def rescue_singletons(counts: DataFrame) -> DataFrame:
    """Edges of count over 1, and those of count 1 that join a dead end to a start.

    Both ends must exist, with no edge out of the first and none into the second. Edges are taken in order of the k-mer, so one that
    was taken keeps later ones from its ends. Each round takes those that come first at both of their ends and drops what they
    block, until nothing is left; that gives what one pass in order gives.
    """
    all_edges = edges(counts)
    main = all_edges.where("weight <> 1")
    deg = degrees(main)
    open_out = deg.where("outdeg = 0").select(F.col("node").alias("a"))
    open_in = deg.where("indeg = 0").select(F.col("node").alias("b"))
    rounds = Rounds(counts.sparkSession, "rescue")
    left = rounds.put(all_edges.where("weight = 1").join(open_out, F.col("src") == F.col("a")).join(open_in, F.col("dst") == F.col("b")).select("src", "dst", "base", "weight"))
    by_src, by_dst = Window.partitionBy("src").orderBy("dst"), Window.partitionBy("dst").orderBy("src")
    while not left.isEmpty():
        ranked = left.withColumn("r", F.row_number().over(by_src)).withColumn("q", F.row_number().over(by_dst))
        taken = cut(ranked.where("r = 1 and q = 1").drop("r", "q"))
        main = main.unionByName(taken)
        rest = left.join(taken.select(F.col("src").alias("a")), F.col("src") == F.col("a"), "left_anti").join(taken.select(F.col("dst").alias("b")), F.col("dst") == F.col("b"), "left_anti")
        left = rounds.put(rest)
    return main


def _chains(graph: DataFrame) -> DataFrame:
    """(src, dst, base, weight, head, rank): each edge with the edge its chain starts with and its place from it.

    Pointers double each round; only chains that start at a node which is not one-in-one-out have an end, so pure cycles never settle and
    are left out.
    """
    deg = degrees(graph)
    through = deg.where("indeg = 1 and outdeg = 1").select(F.col("node").alias("t"))
    before = graph.select(F.col("dst").alias("at"), F.concat("src", "base").alias("up"))
    own = F.concat("src", "base")
    start = graph.join(through, F.col("src") == F.col("t"), "left").join(before, (F.col("src") == F.col("at")) & F.col("t").isNotNull(), "left")
    # up is null at the first edge of a chain; only what moves goes through the rounds
    rounds = Rounds(graph.sparkSession, "chains")
    state = rounds.put(start.select(own.alias("edge"), "up", F.when(F.col("up").isNull(), own).alias("head"), F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("rank")))
    waiting = state.where("head is null").count()
    while waiting:
        ahead = state.select(F.col("edge").alias("e2"), F.col("up").alias("u2"), F.col("head").alias("h2"), F.col("rank").alias("r2"))
        step = state.join(ahead, (F.col("up") == F.col("e2")) & F.col("head").isNull(), "left")
        moved = F.col("head").isNull()
        state = rounds.put(step.select("edge", F.when(moved, F.col("u2")).otherwise(F.col("up")).alias("up"), F.coalesce("head", "h2").alias("head"), (F.col("rank") + F.when(moved, F.col("r2")).otherwise(0)).alias("rank")))
        before_round, waiting = waiting, state.where("head is null").count()
        if waiting == before_round:  # every round settles some edge of a chain, so what waits now is cycles
            break
    placed = state.where("head is not null").select("edge", "head", "rank")
    return graph.withColumn("edge", own).join(placed, "edge").drop("edge")


STRETCH = 4096


def contract(graph: DataFrame) -> DataFrame:
    """Unitigs (head, src_node, dst_node, seq, coverage, n_edges); coverage is the mean weight of the edges.

    The bases of a unitig are joined in stretches of ``STRETCH`` edges, and these in turn, so no row ever holds more than a stretch of
    edges, or the sequence itself.
    """
    chains = _chains(graph).withColumn("part", F.floor(F.col("rank") / STRETCH))
    pieces = chains.groupBy("head", "part").agg(
        F.array_sort(F.collect_list(F.struct("rank", "base"))).alias("c"), F.sum("weight").alias("w"), F.count("*").alias("n"),
        F.min(F.struct("rank", "src"))["src"].alias("src"), F.max(F.struct("rank", "dst"))["dst"].alias("dst"),
    )
    pieces = pieces.select("head", "part", F.array_join(F.transform("c", lambda x: x["base"]), "").alias("s"), "w", "n", "src", "dst")
    rows = pieces.groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("part", "s"))).alias("c"), F.sum("w").alias("w"), F.sum("n").alias("n_edges"),
        F.min(F.struct("part", "src"))["src"].alias("src_node"), F.max(F.struct("part", "dst"))["dst"].alias("dst_node"),
    )
    seq = F.concat("src_node", F.array_join(F.transform("c", lambda x: x["s"]), ""))
    return rows.select("head", "src_node", "dst_node", seq.alias("seq"), (F.col("w") / F.col("n_edges")).alias("coverage"), "n_edges")


def condensed(graph: DataFrame) -> DataFrame:
    """Unitigs with numbered nodes and edges: (edge_id, src_id, dst_id, seq, coverage), ids in order of the strings.

    Numbers run over the unitigs, which are a small part of the k-mers.
    """
    return named_units(contract(graph))


def named_units(units: DataFrame) -> DataFrame:
    """As ``condensed``, of unitigs."""
    units = stage(units, "unitigs")
    names = units.select(F.explode(F.array("src_node", "dst_node")).alias("node")).distinct()
    ids = numbered(names, ["node"], "id")
    a, b = ids.select(F.col("node").alias("na"), F.col("id").alias("src_id")), ids.select(F.col("node").alias("nb"), F.col("id").alias("dst_id"))
    joined = units.join(a, F.col("src_node") == F.col("na")).join(b, F.col("dst_node") == F.col("nb"))
    return numbered(joined, ["seq", "head"], "edge_id").select("edge_id", "src_id", "dst_id", "seq", "coverage")


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Dense numbers in order, from range partitions whose sizes are summed, so no task sees all rows."""
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - (F.spark_partition_id().cast("long") * F.lit(1 << 33))))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    return parts.join(F.broadcast(base), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + F.col("__i") + first).drop("__p", "__q", "__i", "__b")


def adjacency(units: DataFrame, k: int, key: str = "edge_id") -> DataFrame:
    """(key, begin, next, end, prev) of condensed edges: their first and last k - 1 letters, the letter that follows the first and the one before the last. By these they are looked up."""
    whole = units.where(F.length("seq") >= k)
    return whole.select(key, F.substring("seq", F.lit(1), F.lit(k - 1)).alias("begin"), F.substring("seq", F.lit(k), F.lit(1)).alias("next"), F.right("seq", F.lit(k - 1)).alias("end"), F.substring("seq", F.length("seq") - (k - 1), F.lit(1)).alias("prev"))


def remove_edges(graph: DataFrame, gone: DataFrame | Column) -> DataFrame:
    """The graph without the edges (src, base), or without those of which a condition on their columns holds; nodes left without any vanish with them.

    A condition is looked at edge by edge, without a shuffle.
    """
    if isinstance(gone, Column):
        return graph.where(~F.coalesce(gone, F.lit(False)))
    g = gone.select(F.col("src").alias("gs"), F.col("base").alias("gb")).distinct()
    return graph.join(g, (F.col("src") == F.col("gs")) & (F.col("base") == F.col("gb")), "left_anti")


def remove_nodes(graph: DataFrame, gone: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """The graph without the edges at the nodes (node), or at those of which a condition holds."""
    if callable(gone):
        return remove_edges(graph, gone(F.col("src")) | gone(F.col("dst")))
    g = gone.select(F.col("node").alias("g")).distinct()
    return graph.join(g, F.col("src") == F.col("g"), "left_anti").join(g, F.col("dst") == F.col("g"), "left_anti")


def compress(links: DataFrame) -> DataFrame:
    """(src, dst, distance): chains of links over nodes that are one-in-one-out, each as one link as long as all of them. Pure cycles have no start and are left out."""
    text = links.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.concat(F.lit(">"), F.col("dst").cast("string")).alias("base"), F.col("distance").alias("weight"))
    ends = _chains(text).groupBy("head").agg(F.min_by("src", "rank").alias("src"), F.max_by("dst", "rank").alias("dst"), F.sum("weight").alias("distance"))
    return ends.select(F.col("src").cast("long"), F.col("dst").cast("long"), "distance")


def trim(graph: DataFrame, average: float, loops: int = 2) -> DataFrame:
    """Edges left after ``loops`` rounds of removing tips and weak chains, each judged on the graph at its start.

    With n nodes in a chain, its mean weight c and L letters in a node: a tip (a dead end, with one edge, at either
    end) goes if n < L + 2 or c < average / 5; any other chain if n < L + 2 and c < average / 5, or c <= 3, or c < average / 10.
    """
    rounds = Rounds(graph.sparkSession, "trim")
    for _ in range(loops):
        chains = _chains(graph)
        deg = degrees(graph)
        front = deg.select(F.col("node").alias("f"), F.col("indeg").alias("fi"), F.col("outdeg").alias("fo"))
        back = deg.select(F.col("node").alias("b"), F.col("indeg").alias("bi"), F.col("outdeg").alias("bo"))
        ends = chains.groupBy("head").agg(F.min_by("src", "rank").alias("first"), F.max_by("dst", "rank").alias("last"), F.count("*").alias("n"), F.avg("weight").alias("c"), F.max(F.length("src")).alias("len"))
        ends = ends.join(front, F.col("first") == F.col("f")).join(back, F.col("last") == F.col("b"))
        short, weak = F.col("n") + 1 < F.col("len") + 2, F.col("c") < average / 5
        tip = ((F.col("fi") == 0) & (F.col("fo") == 1)) | ((F.col("bi") == 1) & (F.col("bo") == 0))
        bad = F.when(tip, short | weak).otherwise((short & weak) | (F.col("c") <= 3) | (F.col("c") < average / 10))
        gone = ends.where(bad).select(F.col("head").alias("g"))
        graph = rounds.put(chains.join(gone, F.col("head") == F.col("g"), "left_anti").select("src", "dst", "base", "weight"))
    return graph
