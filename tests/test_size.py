"""What queries write to disk and how they fold, at sizes that a test can run."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave import file_queries, queries
from strandweave.operators import debruijn as G
from strandweave.operators import gapfill as E
from strandweave.operators import kmers as K
from strandweave.operators import links as L
from strandweave.operators import rescue as R
from strandweave.operators import scaffolds
from strandweave.operators import superkmers as S
from strandweave.operators import tiles as X
from strandweave.operators import trimming as Y
from strandweave.operators import unitigs as U
from strandweave.plans import dna as D


def shuffled(spark, run) -> int:
    """Bytes that ``run`` writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        rows = sc.statusStore().executorList(True)
        return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.size()))

    before = total()
    run()
    return total() - before


@pytest.fixture(scope="session")
def letters(spark, tmp_path_factory):
    """500 documents of 2,000 letters, a tenth of them copies."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("acgt", k=2000)) for _ in range(450)]
    path = str(tmp_path_factory.mktemp("size"))
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


BASES = 1_000_000


def test_edges_are_removed_without_a_table_of_them(spark, letters):
    out = file_queries.g03_remove(spark, letters)
    assert shuffled(spark, lambda: out.write.format("noop").mode("overwrite").save()) < 3 * BASES
    graph = G.edges(spark.createDataFrame([("ACG", 2), ("CGT", 2), ("GTC", 3)], ["kmer", "cnt"]))
    gone = graph.where(F.col("src").startswith("A"))
    nodes = spark.createDataFrame([("TC",)], ["node"])
    by_table = G.remove_nodes(G.remove_edges(graph, gone), nodes)
    by_condition = G.remove_nodes(G.remove_edges(graph, F.col("src").startswith("A")), lambda n: n == "TC")
    assert sorted(by_table.collect()) == sorted(by_condition.collect()) and by_table.count() == 1


def test_index_travels_in_runs_of_windows(spark, letters):
    out = queries.w01_kmer_index(spark, letters)
    assert shuffled(spark, lambda: out.write.format("noop").mode("overwrite").save()) < 5 * BASES


@pytest.mark.parametrize("duplicates", ["drop", "first"])
def test_index_is_the_same_by_runs_and_by_strings(spark, duplicates):
    rng = random.Random(2)
    seqs = ["".join(rng.choices("ACGT", weights=(4, 1, 1, 1), k=rng.randint(0, 90))) for _ in range(60)] + ["ACGNACGTTacgtACGT", "A" * 80]
    contigs = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(seqs)], "contig_id long, seq string, len long")
    members = contigs.select(F.floor(F.col("contig_id") / 3).alias("component_id"), (F.col("contig_id") % 3).alias("ord"), "contig_id", F.lit(4).cast("long").alias("gap_after"))
    for k in (4, 9):
        want = sorted(r for r in L.kmer_index(members, contigs, k, 20, 15, duplicates, "keep").collect() if not set(r.kmer) - set("ACGT"))
        assert want and sorted(L.kmer_index(members, contigs, k, 20, 15, duplicates).collect()) == want


def test_runs_of_windows_give_all_windows():
    rng = np.random.default_rng(3)
    for k in (1, 4, 13, 14, 25, 31):
        data = np.frombuffer(bytes(rng.choice(list(b"ACGTACGTACGTN"), 5000).tolist()) + b"A" * 400, np.uint8)
        bounds = np.concatenate(([0, 0], np.sort(rng.integers(0, len(data), 30))))
        codes, start, n, bucket = S.cut_up(data, bounds, k, 7)
        blobs = {}
        for batch in S.packed(codes, start, n, bucket, k, 7):
            for b, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                blobs.setdefault(b, []).append(blob)
        got = sorted(x for held in blobs.values() for x in K.unpacked(S.opened(held, k)[0].view(np.int64), k).to_pylist())
        ends = [*bounds[1:], len(data)]
        strings = [data[a:b].tobytes().decode() for a, b in zip(bounds, ends, strict=True)]
        assert got == sorted(w for s in strings for i in range(len(s) - k + 1) if "N" not in (w := s[i : i + k]))


@pytest.fixture(scope="session")
def woven(spark, tmp_path_factory):
    """Documents that share stretches, some of them on the other strand, so that pairs lead from one to another."""
    rng = random.Random(4)
    genome = "".join(rng.choices("ACGT", k=30_000))
    texts = []
    for _ in range(34):
        at = rng.randrange(len(genome) - 1500)
        s = genome[at : at + rng.randint(200, 1500)]
        texts.append(s if rng.random() < 0.6 else s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    codes = dict(zip("ACGT", "abcd", strict=True))
    path = str(tmp_path_factory.mktemp("woven"))
    rows = [(i, "".join(codes[c] for c in t)) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (90, ""), (91, None), (92, "abc" * 9), (93, "b" * 700)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def _paired(spark, sf):
    contigs = D.contigs(D.dna(spark, sf))
    members = contigs.select(F.col("contig_id").alias("component_id"), F.lit(0).cast("long").alias("ord"), "contig_id", F.lit(0).cast("long").alias("gap_after"))
    return L.paired_hits(D.pairs(D.dna(spark, sf)), L.kmer_index(members, contigs, 31), 31)


def test_pairs_cut_from_sequences_are_found_as_pairs_of_reads(spark, woven):
    hits = _paired(spark, woven).cache()
    want = L.links(L.distances(hits, 200, 31), 31)
    got = queries._links(spark, woven)
    assert want.count() > 20 and sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    samples = L.insert_samples(hits, 300)
    assert sorted(queries.j01_insert_samples(spark, woven).collect()) == sorted(samples.groupBy("d").agg(F.count("*").alias("n")).collect())
    assert queries.a06_insert_size(spark, woven).first()[0] == L.insert_size(samples, 300).first()[0]
    assert sorted(file_queries.a15_same_component_reads(spark, woven).collect()) == sorted(L.same_component_reads(hits).collect())
    hits.unpersist()


@pytest.mark.parametrize("k", [4, 5])
def test_windows_of_small_alphabets_are_found_where_they_are_alone(k):
    rng = random.Random(k)
    seq = "".join(rng.choices("ACGT", k=120))
    words = [seq[i : i + k] for i in range(len(seq) - k + 1)]
    numbers = np.array([int("".join(str("ACGT".index(c)) for c in w), 4) for w in words], np.uint64)
    inside = np.array([rng.random() < 0.7 for _ in words])
    own, forward, back = X._unique_places(numbers, k, inside)
    places = {}
    for i, w in enumerate(words):
        if inside[i]:
            places.setdefault(w, []).append(i)
    for i, w in enumerate(words):
        one, other = (p[0] if len(p := places.get(x, [])) == 1 else -1 for x in (w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))))
        assert (i if own[i] else forward[i]) == one and back[i] == other


@pytest.mark.parametrize("query", [queries.j02_links, queries.a10_trimmed_mean, queries.p10_supported_links, queries.a08_mean_samples, queries.j01_insert_samples, queries.a06_insert_size, queries.g12_prune, queries.l01_positions, queries.c01_linearize, file_queries.a11_repeat_votes, file_queries.j07_without_repeats, file_queries.a15_same_component_reads])
def test_links_are_found_without_a_row_for_each_window(spark, letters, query):
    assert shuffled(spark, lambda: query(spark, letters).write.format("noop").mode("overwrite").save()) < 6 * BASES


def test_bases_by_bytes_are_those_of_sql_functions(spark, tmp_path):
    """Odd texts; links take the way by bytes, as SQL functions took a fifth of the time of the query."""
    texts = ["", None, " \n", "Grüße, 東京! ACGTNacgtn 12 \x00 z", "é" * 700, "ab c\n" * 400, "Q" * 1000, "x" * 1001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    assert sorted(D.dna_by_bytes(spark, sf).collect()) == sorted(D.dna(spark, sf).collect())
    assert sorted(D.contig_lengths(spark, sf).collect()) == sorted(D.contigs(D.dna(spark, sf)).select("contig_id", "len").collect())
    assert "regexp_replace" not in queries._links(spark, sf)._jdf.queryExecution().toString()


def test_components_without_links_are_not_grouped(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(scaffolds, "per_group", lambda rows, *a, f=scaffolds.per_group: asked.append(rows.count()) or f(rows, *a))
    links = spark.createDataFrame([(1, 2, 600, 3), (2, 3, 600, 3)], "src long, dst long, distance long, score long")
    placed = spark.range(1, 1001).select("id", ((F.col("id") - 1) * F.when(F.col("id") < 4, 600).otherwise(0)).alias("position"), F.lit(500).cast("long").alias("length"))
    got = sorted(map(tuple, scaffolds.linearize(links, placed.unionByName(placed.where("id = 9"))).collect()))
    assert got == [(1, 0, 1, 100), (1, 1, 2, 100), (1, 2, 3, 0), *((i, 0, i, 0) for i in range(4, 1001))] and asked == [5]


def test_copies_do_not_multiply_paths(spark):
    """60 copies of two contigs with a gap between them: as many paths as gaps, and the smallest ids among equal ones."""
    rng = random.Random(5)
    a, b = ("".join(rng.choices("ACGT", k=60)) for _ in range(2))
    bridge = a[-20:] + b[:20]
    contigs = spark.createDataFrame([(2 * i + j, s, 60) for i in range(60) for j, s in enumerate((a, b))], "contig_id long, seq string, len long")
    wider = contigs.select("contig_id", "seq").unionByName(spark.createDataFrame([(-i - 1, bridge) for i in range(60)], "contig_id long, seq string"))
    gaps = spark.createDataFrame([(i, 1, 2 * i, 2 * i + 1, 5, "search") for i in range(60)], "scaffold_id long, ord long, left long, right long, gap long, kind string")
    out = []
    assert shuffled(spark, lambda: out.extend(E.fill(gaps, contigs, 21, 200, 10.0, wider).collect())) < 300_000
    assert len(out) == 60 and {(r.graph, tuple(r.path), r.length) for r in out} == {(1, (0, -60, 1), 0)}


def test_short_contigs_of_periodic_text_are_no_way_over_a_gap(spark, tmp_path):
    """Last contigs of one letter that begin and end like the contig before a gap, also where the contig after the gap is as short, or too short to be joined: a path over one and a bridge would be nearer to the gap than 0."""
    rng = random.Random(7)

    def some(n, x):
        return "".join(rng.choices([c for c in "abcd" if c != x], k=n))

    texts = [some(700, "")]
    for x, n in (("a", 29), ("c", 30)):
        texts += [some(480, x) + x * 20 + some(300, x), some(1000, x) + x * n]
    texts += [some(480, "a") + "a" * 20 + "d" * 29, some(480, "d") + "d" * 20 + some(300, "d"), some(480, "d") + "d" * 28]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, file_queries.e03_wider_paths(spark, str(tmp_path)).collect()))
    assert len(got) == 7 and {r[2:] for r in got} == {(3, 0)}
    with duckdb.connect(config={"temp_directory": str(tmp_path / "spill"), "max_temp_directory_size": "1GB"}) as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == sorted(db.execute(file_queries.SQL["e03_wider_paths"]).fetchall())


def test_small_groups_are_folded_without_a_frame_each(spark):
    members = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("component_id"), (F.col("id") % 2).alias("ord"), F.col("id").alias("contig_id"), F.lit(5).cast("long").alias("gap_after"))
    contigs = spark.range(20_000).select(F.col("id").alias("contig_id"), F.concat(F.lit("ACGT"), F.lpad(F.translate(F.col("id").cast("string"), "0123456789", "ACGTACGTAC"), 26, "T")).alias("seq"))
    gaps = members.where("ord = 1").select(F.col("component_id").alias("scaffold_id"), "ord", F.lit(3).cast("long").alias("gap"))
    paths = spark.createDataFrame([], "scaffold_id long, ord long, graph int, path array<long>, length long")
    out = E.scaffold_sequences(members, contigs, gaps, paths, 21, 200, 10.0)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert out.count() == 10_000 and out.where("len <> 63 or substr(seq, 31, 3) <> 'NNN'").count() == 0


@pytest.mark.parametrize("k", [5, 7, 15, 31])
def test_unitigs_of_buckets_are_those_of_the_whole_graph(spark, k):
    rng = random.Random(k)
    genome = "".join(rng.choices("ACGT", k={5: 60, 7: 400}.get(k, 3000)))
    seqs = [genome[i : i + 3 * k + rng.randint(0, 40)] for i in range(0, len(genome) - k, k)] + ["A" * 90, "ACGTTGCAGG" * 12, "", "N" * 50, None]
    reads = spark.createDataFrame([(s,) for s in seqs], "seq string")
    want = G.contract(G.edges(K.count_kmers(reads, k, least=2)))
    rows = [sorted((r.head, r.src_node, r.dst_node, r.seq, round(r.coverage, 9), r.n_edges) for r in x.collect()) for x in (want, U.chains(reads, k))]
    assert rows[0] == rows[1] and rows[0]


def test_unitigs_leave_no_table_of_edges(spark, letters):
    assert shuffled(spark, lambda: queries.g06_condensed(spark, letters).write.format("noop").mode("overwrite").save()) < 5 * BASES


@pytest.mark.parametrize("k", [4, 5, 6, 7, 15, 30, 31])
def test_singletons_rescued_in_buckets_are_those_of_the_whole_graph(spark, k):
    rng = random.Random(k)
    genome = "".join(rng.choices("ACGT", k={4: 40, 5: 80, 6: 200, 7: 400}.get(k, 6000)))
    # stretches read twice, some with other letters before the middle, and single reads from the end of one to the start of the next
    seqs = []
    for i in range(0, len(genome) - 3 * k, k + 2):
        middle, more = genome[i + k + 2 : i + 2 * k], genome[i + 2 * k]
        others = [rng.choice("ACGT") for _ in range(rng.randint(0, 3))]
        seqs += [genome[i : i + 2 * k], *("".join(rng.choices("ACGT", k=k)) + x + middle for x in others)] * 2
        seqs += [genome[i + k + 1] + middle + more] * (rng.random() < 0.7) + [x + middle + more for x in others] + [x + middle + rng.choice("ACGT") for x in others]
    reads = spark.createDataFrame([(s,) for s in [*seqs, "A" * 90, "ACGTTGCAGG" * 12, "", "N" * 50, None, "ACGTN" * 9]], "seq string")
    want, got = (sorted(map(tuple, x.select("src", "dst", "base", "weight").collect())) for x in (G.rescue_singletons(K.count_kmers(reads, k)), R.rescued_edges(reads, k)))
    assert got == want and (k < 7 or any(w == 1 for *_, w in got))


def test_rescue_leaves_no_table_of_edges(spark, letters):
    assert shuffled(spark, lambda: queries.g02_singleton_rescue(spark, letters).write.format("noop").mode("overwrite").save()) < 4 * BASES


@pytest.mark.parametrize(("k", "loops"), [(5, 1), (5, 2), (7, 2), (15, 3), (31, 1), (31, 2)])
def test_chains_trimmed_in_buckets_are_those_of_the_whole_graph(spark, k, loops):
    rng = random.Random(k)
    genome = "".join(rng.choices("ACGT", k={5: 60, 7: 300}.get(k, 4000)))
    seqs = [genome[i : i + 3 * k + rng.randint(0, 40)] for i in range(0, len(genome) - k, max(1, k // 4))]
    # reads with another letter near an end or inside: tips and weak chains beside strong ones, which join when these go
    for i in range(0, len(genome) - 4 * k, 3 * k):
        at = rng.randint(1, 3 * k)
        seqs += [genome[i : i + at] + "ACGT"["ACGT".index(genome[i + at]) - 1] + genome[i + at + 1 : i + 4 * k]] * rng.randint(2, 9)
    reads = spark.createDataFrame([(s,) for s in [*seqs, "A" * 90, "ACGTTGCAGG" * 12, "", "N" * 50, None]], "seq string")
    counts = K.count_kmers(reads, k)
    graph = G.edges(K.frequent(counts))
    want, got = (sorted(map(tuple, x.select("src", "dst", "base", "weight").collect())) for x in (G.trim(graph, K.kmer_stats(counts).first()["mean"], loops), Y.trimmed_edges(reads, k, loops=loops)))
    assert got == want and (k < 15 or 0 < len(got) < graph.count())


def test_trimming_leaves_no_table_of_edges(spark, letters):
    assert shuffled(spark, lambda: queries.g04_trim(spark, letters).write.format("noop").mode("overwrite").save()) < 8 * BASES


def test_good_windows_are_counted_as_they_are_listed(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choices("ACGTNa", weights=(9, 9, 9, 9, 1, 1), k=n)), "".join(chr(rng.randint(40, 73)) for _ in range(n + extra))) for n, extra in ((0, 0), (4, 0), (80, 0), (80, 3), (80, -1), (200, 0))]
    reads = spark.createDataFrame([*rows, rows[-1], (None, None)], "seq string, qual string")
    for k in (5, 9):
        listed = K.quality_windows(reads, k, F.lit(55), F.lit(44)).select("kmer")
        want = listed.select(F.explode(F.array("kmer", F.reverse(F.translate("kmer", "ACGT", "TGCA")))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))
        got = K.count_good_kmers(reads, k, F.lit(55), F.lit(44))
        assert sorted(got.collect()) == sorted(want.collect()) and got.count()
        assert shuffled(spark, lambda: got.collect()) < 6_000
