"""The stages of an assembly, and all of them in turn."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.seq import trim
from strandweave.operators import contigs as C
from strandweave.operators import debruijn as G
from strandweave.operators import gapfill as E
from strandweave.operators import kmers as K
from strandweave.operators import links as L
from strandweave.operators import mixture as M
from strandweave.operators import scaffolds as S
from strandweave.plans.staging import cut
from strandweave.sources.files import read_config, read_fastq, read_pairs

FILTERED_K = 33
FILTERED_SHARE = 0.95


@dataclass(frozen=True)
class Library:
    """One set of read pairs, and the files it is in (colons between several)."""

    insert_size: int = 180
    pair_reads_cutoff: int = 0
    edge_cutoff: int | None = None
    q1: str | None = None
    q2: str | None = None


@dataclass(frozen=True)
class Parameters:
    k: int = 27
    threshold: int = 1
    loops: int = 2
    most_overlap: int = 200
    gap_overlap: int = 10
    most_copies: int = 10
    read_cutoff: int | None = None
    kmer_filter: bool = False

    def __post_init__(self):
        if not 2 <= self.k <= 196:
            raise ValueError("k must be from 2 to 196")

    @property
    def filters(self) -> bool:
        """Whether k-mers are filtered by quality; only short ones are."""
        return self.kmer_filter and self.k < FILTERED_K


def preprocess(reads: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """k-mers over the threshold, and the statistics of all, of (seq) or, for the filter, (seq, qual).

    Reads are cut to the read cutoff. The filter takes its thresholds from the whole reads, cuts these to ``FILTERED_SHARE``, and keeps windows that
    reach them.
    """
    share = FILTERED_SHARE if p.filters else 1.0
    kept = trim("seq", share, p.read_cutoff)
    if p.filters:
        t = K.quality_thresholds(reads).first()
        cut_reads = reads.select(kept.alias("seq"), F.left("qual", F.length(kept)).alias("qual"))
        counts = cut(K.count_good_kmers(cut_reads, p.k, F.lit(t["avg_threshold"] or 0.0), F.lit(t["min_threshold"] or 0.0)))
    else:
        counts = cut(K.count_kmers(reads.select(kept.alias("seq")), p.k))
    return K.frequent(counts, p.threshold), K.kmer_stats(counts)


def assemble(kmers: DataFrame, average: float, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """Condensed graph before and after trimming."""
    graph = cut(G.edges(kmers))
    return G.condensed(graph), G.condensed(G.trim(graph, average, p.loops))


def estimate_copy_number(condensed: DataFrame, average: float) -> tuple[DataFrame, DataFrame]:
    """Contigs, and components of the unique ones."""
    rows = condensed.select(F.col("edge_id").alias("contig_id"), "seq", F.length("seq").cast("long").alias("len"), "coverage")
    named = cut(C.copy_numbers(rows, average))
    return named, C.unique_components(named)


def build_links(pairs: DataFrame, members: DataFrame, contigs: DataFrame, library: Library, p: Parameters) -> tuple[DataFrame, DataFrame, int, float]:
    """Links of components that have support (src, dst, distance, kmer_cov, score), repeats, insert size and deviation."""
    k, expected = p.k, library.insert_size
    inner = L.paired_hits(pairs, L.kmer_index(members, contigs, k, least_len=2 * expected), k)
    size = L.insert_size(L.insert_samples(inner, expected), expected).first()
    insert, delta = int(size["insert_size"]), float(size["delta"])
    some = pairs.orderBy("pair_id").select(F.length("seq1")).first()
    read_len = int(some[0]) if some else k
    index = L.kmer_index(members, contigs, k, least_len=library.edge_cutoff if library.edge_cutoff is not None else k, end_zone=insert)
    rows = cut(L.links(L.distances(L.paired_hits(pairs, index, k), insert, k), k))
    mean = L.mean_samples(rows, read_len, library.pair_reads_cutoff).first()[0] or 0
    kept = cut(L.supported(rows, read_len, k, library.pair_reads_cutoff))
    repeated = cut(L.repeats(M.multi_peak(kept, delta, mean), C.component_lengths(members, contigs), read_len))
    pruned = S.prune(kept, library.pair_reads_cutoff)
    final = kept.join(pruned, ["src", "dst"]).select("src", "dst", L.trimmed_mean().alias("distance"), "kmer_cov", F.col("read_cov").alias("score")).where("distance > 0")
    return cut(L.without_repeats(final, repeated)), repeated, insert, delta


def linearize(links: DataFrame, members: DataFrame, contigs: DataFrame, p: Parameters) -> DataFrame:
    """Members of the scaffolds."""
    placed = C.component_lengths(members, contigs).join(S.positions(links), "component_id", "left")
    placed = placed.select(F.col("component_id").alias("id"), F.coalesce("position", F.lit(0)).alias("position"), "length")
    return cut(S.expand(S.linearize(links, placed, p.most_overlap), members))


def fill_gaps(members: DataFrame, contigs: DataFrame, insert: int, delta: float, p: Parameters, wider: DataFrame | None = None) -> DataFrame:
    """Sequences of the scaffolds; gaps without a path among the contigs are searched among the sequences of ``wider`` (edge_id, seq), the graph before trimming, and become N without one there."""
    gaps = cut(E.classify(E.adjacent(members, contigs), p.k, p.gap_overlap, insert, delta))
    other = wider.select(F.col("edge_id").alias("contig_id"), "seq") if wider is not None else None
    return E.scaffold_sequences(members, contigs, gaps, E.fill(gaps, contigs, p.k, insert, delta, other), p.k, insert, delta, other)


def assemble_pipeline(reads: DataFrame, libraries: list[tuple[DataFrame, Library]], p: Parameters) -> DataFrame:
    """Scaffold sequences (scaffold_id, part, len, seq) from reads and read pairs."""
    kmers, stats = preprocess(reads, p)
    average = stats.first()["mean"] or 1.0
    before, trimmed = assemble(kmers, average, p)
    contigs, members = estimate_copy_number(trimmed, average)
    unique, insert, delta = members, libraries[0][1].insert_size if libraries else 180, L.LEAST_DELTA
    first = None
    for pairs, library in libraries:
        links, _, insert, delta = build_links(pairs, members, contigs, library, p)
        first = first or (insert, delta)
        members = linearize(links, members, contigs, p)
    if libraries:
        recalled = C.recall_repeats(contigs, unique, p.most_copies)
        last = members.agg(F.max("component_id")).first()[0]
        extra = G.numbered(recalled.select("contig_id"), ["contig_id"], "component_id", first=0 if last is None else last + 1)
        extra = extra.select(F.col("component_id").cast("long"), F.lit(0).cast("long").alias("ord"), "contig_id", F.lit(0).cast("long").alias("gap_after"))
        members = cut(members.unionByName(extra))
        links, _, _, _ = build_links(libraries[-1][0], members, contigs, libraries[-1][1], p)
        members = linearize(links, members, contigs, p)
    lengths = C.component_lengths(members, contigs)
    kept = C.drop_reverse_duplicates(lengths, C.shared_reverse(members, C.reverse_pairs(contigs)))
    members = cut(members.join(kept.select(F.col("component_id").alias("k")), F.col("component_id") == F.col("k"), "left_semi"))
    return fill_gaps(members, contigs, *(first or (insert, delta)), p, before)


def libraries_of(text: str) -> tuple[list[Library], int | None]:
    """Libraries of a config, and the read cutoff that holds for all."""
    found, cutoff = [], None
    for row in read_config(text):
        cutoff = int(row["READ_LENGTH_CUTOFF"]) if "READ_LENGTH_CUTOFF" in row else cutoff
        if "q1" in row:
            edge = int(row["EDGE_LENGTH_CUTOFF"]) if "EDGE_LENGTH_CUTOFF" in row else None
            found.append(Library(int(row["INSERT_SIZE"]), int(row.get("PAIR_READS_CUTOFF", 0)), edge, row["q1"], row.get("q2")))
    return found, cutoff


def assemble_config(spark: SparkSession, text: str, p: Parameters) -> DataFrame:
    """Scaffold sequences from the files that a config names. Only the first library's reads give k-mers; all libraries give links."""
    libraries, cutoff = libraries_of(text)
    if not libraries:
        raise ValueError("the config names no library")
    one = libraries[0]
    reads = read_fastq(spark, one.q1).unionByName(read_fastq(spark, one.q2)) if one.q2 else read_fastq(spark, one.q1)
    pairs = [(read_pairs(spark, x.q1, x.q2), x) for x in libraries if x.q2]
    return assemble_pipeline(reads, pairs, replace(p, read_cutoff=p.read_cutoff or cutoff))


STAGES = {
    "preprocess": preprocess, "assemble": assemble, "copy_num_estimate": estimate_copy_number, "scaffold": build_links,
    "solveLP": S.positions, "remove_repeats": linearize, "gapfill": fill_gaps,
}
