"""Gaps of scaffolds: classes, bounded path search, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.seq import overlap
from strandweave.operators.groups import per_group
from strandweave.plans.staging import stage


def ends(contigs: DataFrame, k: int) -> DataFrame:
    """(contig_id, first, last, letters): the first and the last k letters and the length, all that searches and classes need. Such a table stays as it is."""
    if "first" in contigs.columns:
        return contigs
    return contigs.select("contig_id", F.substring("seq", F.lit(1), F.lit(k)).alias("first"), F.right("seq", F.lit(k)).alias("last"), F.length("seq").cast("long").alias("letters"))


def adjacent(members: DataFrame, contigs: DataFrame, k: int | None = None) -> DataFrame:
    """(scaffold_id, ord, left, right, gap, left_seq, right_seq): neighbours in each scaffold. With k, the last k letters of the left one and the first k of the right one only."""
    w = Window.partitionBy("component_id").orderBy("ord")
    rows = members.select(F.col("component_id").alias("scaffold_id"), "ord", F.lag("contig_id").over(w).alias("left"), F.col("contig_id").alias("right"), F.lag("gap_after").over(w).alias("gap")).where("left is not null")
    sides = contigs.select("contig_id", F.col("seq").alias("first"), F.col("seq").alias("last")) if k is None else ends(contigs, k)
    a = sides.select(F.col("contig_id").alias("ca"), F.col("last").alias("left_seq"))
    b = sides.select(F.col("contig_id").alias("cb"), F.col("first").alias("right_seq"))
    return rows.join(a, F.col("left") == F.col("ca")).join(b, F.col("right") == F.col("cb")).drop("ca", "cb")


def classify(pairs: DataFrame, k: int, least_overlap: int, insert: int, delta: float) -> DataFrame:
    """``kind``: overlap (gap becomes minus the overlap), touching (gap of 0 or less), failed (beyond the insert size) or search."""
    o = overlap(F.right("left_seq", F.lit(k - 1)), F.substring("right_seq", F.lit(1), F.lit(k - 1)), k - 1)
    rows = pairs.withColumn("o", o)
    kind = F.when(F.col("o") >= least_overlap, "overlap").when(F.col("gap") <= 0, "touching").when(F.col("gap") > insert + 3 * delta, "failed").otherwise("search")
    return rows.withColumn("kind", kind).withColumn("gap", F.when(F.col("o") >= least_overlap, -F.col("o")).otherwise(F.col("gap")).cast("long")).drop("o")


def joints(contigs: DataFrame, k: int) -> DataFrame:
    """(contig_id, begin, end, more): the first and the last k - 1 letters, and how many letters follow the first ones. Contigs shorter than k join nothing."""
    whole = ends(contigs, k).where(F.col("letters") >= k)
    return whole.select("contig_id", F.substring("first", F.lit(1), F.lit(k - 1)).alias("begin"), F.right("last", F.lit(k - 1)).alias("end"), (F.col("letters") - (k - 1)).cast("long").alias("more"))


def search_paths(gaps: DataFrame, contigs: DataFrame, k: int, insert: int, delta: float) -> DataFrame:
    """(scaffold_id, ord, path, length): for each gap the path from left to right whose length is nearest to the gap.

    All gaps advance one contig per round, at most insert + 3 delta rounds. A path is given up when it is longer than the gap allows. Paths of a gap
    that end in the same letters with one length have the same future, so only the first in order of the ids goes on: a gap has at most as many
    open paths as ends times lengths, copies included, and none has to be left out. Of equal errors the path of fewer contigs wins, then the smaller ids. The
    length counts letters between the two contigs.
    """
    allowed = (k - 1) + 3 * delta + 30
    joined = stage(joints(contigs, k), "joints")
    steps = stage(joined.groupBy("begin", "end", "more").agg(F.min("contig_id").alias("b")).withColumnRenamed("end", "next"), "steps")  # copies have the same future, and the smallest id wins
    left, right = joined.select(F.col("contig_id").alias("a"), "end"), joined.select(F.col("contig_id").alias("z"), F.col("begin").alias("goal"))
    state = ("scaffold_id", "ord", "from", "right", "gap", "goal", "end", "length")
    open_paths = gaps.select("scaffold_id", "ord", F.col("left").alias("from"), "right", "gap", F.array("left").alias("path"), F.lit(-(k - 1)).cast("long").alias("length"))
    open_paths = stage(open_paths.join(left, F.col("from") == F.col("a")).join(right, F.col("right") == F.col("z")).select(*state, "path"), "paths")
    none = gaps.select("scaffold_id", "ord", F.array("left").alias("path"), F.lit(0).cast("long").alias("length")).limit(0)
    found = None
    for _ in range(int(insert + 3 * delta)):
        hit = open_paths.where("end = goal").select("scaffold_id", "ord", F.concat("path", F.array("right")).alias("path"), "length", F.abs(F.col("length") - F.col("gap")).alias("error"))
        found = hit if found is None else found.unionByName(hit)
        step = open_paths.join(steps, F.col("end") == F.col("begin")).select(*state[:6], F.col("next").alias("end"), (F.col("length") + F.col("more")).alias("length"), F.concat("path", F.array("b")).alias("path"))
        step = step.where(F.col("length") <= F.col("gap") + allowed - (k - 1))
        open_paths = stage(step.groupBy(*state).agg(F.min("path").alias("path")), "paths")
        if open_paths.isEmpty():
            break
    if found is None:
        return none
    best = found.groupBy("scaffold_id", "ord").agg(F.min(F.struct("error", F.size("path").alias("n"), "path", "length")).alias("m"))
    return best.select("scaffold_id", "ord", "m.path", "m.length")


def search_wider(gaps: DataFrame, contigs: DataFrame, wider: DataFrame, k: int, insert: int, delta: float) -> DataFrame:
    """Paths as from ``search_paths``, among the sequences of another graph (contig_id, seq), such as the one before trimming.

    A path starts with a sequence that ends in the last k letters of the contig before the gap and leads to one that begins with the first
    k letters of the contig after it.
    """
    sides = ends(contigs, k).where(F.col("letters") >= k)
    wider = ends(wider, k)
    whole = wider.where(F.col("letters") >= k)
    # those that end or begin alike are reached alike, and the smallest id wins
    starts = whole.groupBy(F.col("last").alias("m_end")).agg(F.min("contig_id").alias("m"))
    goals = whole.groupBy(F.col("first").alias("g_begin")).agg(F.min("contig_id").alias("g"))
    rows = gaps.join(sides.select(F.col("contig_id").alias("l"), "last"), F.col("left") == F.col("l")).join(sides.select(F.col("contig_id").alias("r"), "first"), F.col("right") == F.col("r"))
    rows = rows.join(starts, F.col("last") == F.col("m_end")).join(goals, F.col("first") == F.col("g_begin"))
    return search_paths(rows.select("scaffold_id", "ord", F.col("m").alias("left"), F.col("g").alias("right"), "gap"), wider, k, insert, delta)


def fill(gaps: DataFrame, contigs: DataFrame, k: int, insert: int, delta: float, wider: DataFrame | None = None) -> DataFrame:
    """(scaffold_id, ord, graph, path, length): paths among the contigs (graph 0) and, for gaps without one, in the wider graph (1)."""
    asked = gaps.where("kind = 'search'").select("scaffold_id", "ord", "left", "right", "gap")
    near = stage(search_paths(asked, contigs, k, insert, delta), "found").withColumn("graph", F.lit(0))
    if wider is not None:
        rest = stage(asked.join(near.select("scaffold_id", "ord"), ["scaffold_id", "ord"], "left_anti"), "unfilled")
        if not rest.isEmpty():
            near = near.unionByName(search_wider(rest, contigs, wider, k, insert, delta).withColumn("graph", F.lit(1)))
    return near.select("scaffold_id", "ord", "graph", "path", "length")


def gap_counts(gaps: DataFrame, paths: DataFrame) -> DataFrame:
    """(outcome, n): how many gaps are of which kind; those searched count as filled, filled_wider or unfilled."""
    rows = gaps.select("scaffold_id", "ord", "kind").join(paths.select("scaffold_id", "ord", "graph"), ["scaffold_id", "ord"], "left")
    outcome = F.when(F.col("kind") != "search", F.col("kind")).when(F.col("graph") == 0, "filled").when(F.col("graph") == 1, "filled_wider").otherwise("unfilled")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def fold(parts: list[tuple], k: int, insert: int, delta: float) -> list[str]:
    """Sequences of one scaffold from (seq, gap, filling) of its contigs in order; the first has no gap.

    ``filling`` is the sequence of a found path with k - 1 letters of the contig before it; without one, a gap up to 0 is an overlap
    (a contig that lies further back than the insert size is left out, and its offset carried on), a gap beyond the
    insert size splits the scaffold, any other becomes N.
    """
    most = int(insert + 3 * delta)
    out, seq, carried = [], parts[0][0], 0
    for contig, gap, filling in parts[1:]:
        gap, carried = gap + carried, 0
        if filling is not None:
            seq = seq[: len(seq) - (k - 1)] + filling
        elif gap <= 0:
            if -gap > insert + 3 * delta:
                carried = gap + len(contig)
                continue
            if len(seq) >= -gap:
                seq = seq[: len(seq) + gap]
        elif gap > insert + 3 * delta:
            out.append(seq)
            seq = ""
        else:
            seq += "N" * min(most, gap)
        seq += contig
    return [*out, seq]


def scaffold_sequences(members: DataFrame, contigs: DataFrame, gaps: DataFrame, paths: DataFrame, k: int, insert: int, delta: float, wider: DataFrame | None = None) -> DataFrame:
    """(scaffold_id, part, len, seq). A scaffold is folded by one task; it is as long as a chromosome at most.

    ``paths`` as from ``fill``; without its column ``graph`` all paths run among the contigs.
    """
    known = contigs.select(F.lit(0).alias("g"), F.col("contig_id").alias("x"), F.col("seq").alias("s"))
    known = known if wider is None else known.unionByName(wider.select(F.lit(1).alias("g"), F.col("contig_id").alias("x"), F.col("seq").alias("s")))
    graph = F.col("graph") if "graph" in paths.columns else F.lit(0).alias("graph")
    steps = paths.select("scaffold_id", "ord", graph, F.posexplode("path").alias("i", "c")).join(known, (F.col("c") == F.col("x")) & (F.col("graph") == F.col("g")))
    inner = steps.groupBy("scaffold_id", "ord").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"))
    # contigs strictly between, each without what it shares with the one before, and the k - 1 letters that begin them
    from strandweave.functions.seq import chain

    strings = F.transform(F.slice("p", F.lit(2), F.size("p") - 2), lambda x: x["s"])
    shared = F.substring(F.element_at("p", -1)["s"], F.lit(1), F.lit(k - 1))
    filling = F.when(F.size("p") > 2, F.substring(chain(strings, k), F.lit(1), F.aggregate(strings, F.lit(0), lambda a, s: a + F.length(s) - (k - 1)))).otherwise(F.lit(""))
    filled = inner.select(F.col("scaffold_id").alias("fs"), F.col("ord").alias("fo"), filling.alias("filling"), shared.alias("shared"))
    rows = members.select(F.col("component_id").alias("scaffold_id"), "ord", "contig_id").join(contigs.select(F.col("contig_id").alias("c"), "seq"), F.col("contig_id") == F.col("c"))
    rows = rows.join(gaps.select(F.col("scaffold_id").alias("gs"), F.col("ord").alias("go"), "gap"), (F.col("scaffold_id") == F.col("gs")) & (F.col("ord") == F.col("go")), "left")
    rows = rows.join(filled, (F.col("scaffold_id") == F.col("fs")) & (F.col("ord") == F.col("fo")), "left").select("scaffold_id", "ord", "seq", "gap", "filling")

    def run(found: list[tuple]) -> list[tuple]:
        found = sorted(found, key=lambda r: r[1])
        seqs = fold([(s, gap or 0, filling) for _, _, s, gap, filling in found], k, insert, delta)
        return [(found[0][0], i, len(s), s) for i, s in enumerate(seqs)]

    rows = rows.select(F.col("scaffold_id").alias("key"), "scaffold_id", "ord", "seq", F.col("gap").cast("long"), "filling")
    return per_group(rows, "key", run, "scaffold_id long, part long, len long, seq string")
