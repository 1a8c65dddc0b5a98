"""Contigs and components: copy numbers, lengths, N50, recall, reverse duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.seq import reverse_complement_strict
from strandweave.operators.components import connected_components


def copy_numbers(contigs: DataFrame, average: Column | float) -> DataFrame:
    """``copy_num``: coverage over the average, rounded half away from zero."""
    return contigs.withColumn("copy_num", F.round(F.col("coverage") / average).cast("long"))


def unique_components(contigs: DataFrame) -> DataFrame:
    """Members (component_id, ord, contig_id, gap_after): one component for each contig of copy number at most 1, none included."""
    one = contigs.where("copy_num <= 1")
    return one.select(F.col("contig_id").alias("component_id"), F.lit(0).cast("long").alias("ord"), "contig_id", F.lit(0).cast("long").alias("gap_after"))


def genome_length(contigs: DataFrame, k: int) -> DataFrame:
    return contigs.agg(F.sum((F.col("len") - (k - 1)).cast("long")).alias("genome_length"))


def component_lengths(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """(component_id, length): contig lengths and the gaps between them; the gap after the last contig does not count."""
    joined = members.join(contigs.select(F.col("contig_id").alias("c"), "len"), F.col("contig_id") == F.col("c"))
    sums = joined.groupBy("component_id").agg(F.sum(F.col("len") + F.col("gap_after")).alias("all"), F.max_by("gap_after", "ord").alias("last"))
    return sums.select("component_id", (F.col("all") - F.col("last")).cast("long").alias("length"))


def n_statistics(rows: DataFrame, length: str = "len", shares: tuple = (50, 90)) -> DataFrame:
    """One row: count, total, longest, and N50 and the like.

    The sums run over distinct lengths, counted first, not over rows.
    """
    by_length = rows.groupBy(F.col(length).cast("long").alias("len")).agg(F.count("*").alias("n"))
    so_far = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = by_length.select("len", "n", F.sum(F.col("len") * F.col("n")).over(so_far).alias("run"), F.sum(F.col("len") * F.col("n")).over(whole).alias("total"))
    least = [F.max(F.when(F.col("run") >= F.floor(F.col("total") * F.lit(s) / 100), F.col("len"))).alias(f"n{s}") for s in shares]
    return held.agg(F.sum("n").alias("n_seq"), F.max("total").alias("total"), F.max("len").alias("longest"), *least)


def longest(rows: DataFrame, key: str, length: str = "len", n: int = 20) -> DataFrame:
    return rows.select(key, length).orderBy(F.desc(length), key).limit(n)


def recall_repeats(contigs: DataFrame, unique: DataFrame, most_copies: int = 10) -> DataFrame:
    """Contigs that are not unique but long enough to be placed: over 100 letters with few copies, or over 200."""
    rest = contigs.join(unique.select(F.col("contig_id").alias("u")), F.col("contig_id") == F.col("u"), "left_anti")
    return rest.where((F.col("len") > 200) | ((F.col("len") > 100) & (F.col("copy_num") <= most_copies)))


def reverse_pairs(contigs: DataFrame, least: int = 100) -> DataFrame:
    """(contig_id, rc_id): contigs whose reverse complement is a contig too, the last one of equal sequences."""
    named = contigs.where(F.length("seq") >= least).groupBy("seq").agg(F.max("contig_id").alias("contig_id"))
    other = named.select(reverse_complement_strict("seq").alias("rc"), F.col("contig_id").alias("rc_id"))
    return named.join(other, F.col("seq") == F.col("rc")).select("contig_id", "rc_id")


def shared_reverse(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n): how many contigs of scaffold a have their reverse complement in scaffold b. The last scaffold of a contig counts."""
    where = members.groupBy("contig_id").agg(F.max("component_id").alias("scaf"))
    a = where.select(F.col("contig_id").alias("c1"), F.col("scaf").alias("a"))
    b = where.select(F.col("contig_id").alias("c2"), F.col("scaf").alias("b"))
    return pairs.join(a, F.col("contig_id") == F.col("c1")).join(b, F.col("rc_id") == F.col("c2")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def drop_reverse_duplicates(lengths: DataFrame, shares: DataFrame, least: int = 2) -> DataFrame:
    """Scaffolds kept: longest first, each kept one drops those that share ``least`` contigs or more with it.

    Scaffolds that share nothing are kept at once; the rest is decided component by component of the sharing, which
    are small.
    """
    links = shares.where(F.col("n") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comps = connected_components(links)
    alone = lengths.join(comps.select(F.col("node").alias("x")), F.col("component_id") == F.col("x"), "left_anti").select("component_id", "length")
    nodes = comps.join(lengths, F.col("node") == F.col("component_id")).select("component", F.col("node").alias("a"), "length", F.lit(None).cast("long").alias("b"))
    arcs = links.join(comps, F.col("src") == F.col("node")).select("component", F.col("src").alias("a"), F.lit(None).cast("long").alias("length"), F.col("dst").alias("b"))

    def greedy(pdf):
        size = pdf[pdf.b.isna()].sort_values(["length", "a"], ascending=[False, True])
        near: dict = {}
        for x, y in pdf[pdf.b.notna()][["a", "b"]].itertuples(index=False):
            near.setdefault(int(x), []).append(int(y))
        flagged: set = set()
        keep = []
        for x in size.a:
            if int(x) not in flagged:
                keep.append(x)
                flagged.update(near.get(int(x), ()))
        return size[size.a.isin(keep)][["a", "length"]].rename(columns={"a": "component_id"}).astype("int64")

    kept = nodes.unionByName(arcs).groupBy("component").applyInPandas(greedy, "component_id long, length long")
    return alone.select(F.col("component_id").cast("long"), F.col("length").cast("long")).unionByName(kept)
