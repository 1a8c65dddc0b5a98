import random

from pyspark.sql import functions as F

from strandweave import queries
from strandweave.functions import seq as Q
from strandweave.operators import contigs as C
from strandweave.operators import debruijn as G
from strandweave.operators import gapfill as E
from strandweave.operators import kmers as K
from strandweave.operators import links as L
from strandweave.operators import mixture as M
from strandweave.operators import scaffolds as S
from strandweave.operators.components import connected_components
from strandweave.plans.assembly import Library, Parameters, assemble_pipeline
from strandweave.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_scalars(spark):
    assert one(spark, Q.reverse_complement("s"), s="AACGN") == "NCGTT"
    assert one(spark, Q.reverse_complement_strict("s"), s="AACGN") == "ACGTT"
    assert len(one(spark, Q.trim("s", 0.95, 100), s="A" * 101)) == 95
    assert one(spark, Q.overlap("a", "b", 4), a="GATTA", b="TTACC") == 3
    assert one(spark, Q.pack_kmer("s"), s="ACGT") == 27
    assert one(spark, Q.windows("s", 3), s="AC") == []
    geometry = [(50, 20, 200, 330), (50, 250, 200, 200), (0, 500, 200, None)]
    for a, b, n, want in geometry:
        assert one(spark, Q.link_distance(F.lit(300), F.col("a"), F.col("b"), F.col("n"), 27), a=a, b=b, n=n) == want


def test_counts_and_stats(spark):
    counts = K.count_kmers(spark.createDataFrame([("ACGTA",)], ["seq"]), 3)
    assert {r.kmer: r.cnt for r in counts.collect()} == {"ACG": 2, "CGT": 2, "GTA": 1, "TAC": 1}
    assert sorted(r.kmer for r in K.frequent(counts).collect()) == ["ACG", "CGT"]
    s = K.kmer_stats(spark.createDataFrame([(1,), (2,), (4,), (6,)], ["cnt"])).first()
    assert (s.mean, s.stddev) == (5.0, 1.0)
    assert K.kmer_stats(spark.createDataFrame([(1,)], ["cnt"])).first().mean is None


def test_unitigs_trim_and_cycles(spark):
    edges = G.edges(spark.createDataFrame([("ACG", 2), ("CGT", 2)], ["kmer", "cnt"]))
    unit = G.contract(edges).first()
    assert (unit.seq, unit.coverage) == ("ACGT", 2.0)
    assert G.trim(edges, 10.0, 1).count() == 0
    cycle = G.edges(spark.createDataFrame([("ACG", 2), ("CGA", 2), ("GAC", 2)], ["kmer", "cnt"]))
    assert G.contract(cycle).count() == 0


def test_copy_numbers_and_n50(spark):
    rows = C.copy_numbers(spark.createDataFrame([(0, 2.5), (1, 0.2)], ["contig_id", "coverage"]), 1.0)
    assert [r.copy_num for r in rows.orderBy("contig_id").collect()] == [3, 0]
    r = C.n_statistics(spark.createDataFrame([(10,), (8,), (5,), (3,), (2,)], ["len"])).first()
    assert (r.n50, r.n90, r.total, r.n_seq) == (8, 3, 28, 5)
    kept = C.drop_reverse_duplicates(spark.createDataFrame([(0, 300), (1, 200), (2, 100)], ["component_id", "length"]), spark.createDataFrame([(0, 1, 2), (1, 0, 2), (0, 2, 1)], ["a", "b", "n"]))
    assert sorted(r.component_id for r in kept.collect()) == [0, 2]


def test_insert_size_and_trimmed_mean(spark):
    s = spark.createDataFrame([(0, 0, 0, 100), (0, 0, 1, 101), (1, 0, 0, 103)], ["pair_id", "strand", "off", "d"])
    r = L.insert_size(s, 300).first()
    assert r.insert_size == 101 and abs(r.delta - 1.290994) < 1e-6
    assert L.insert_size(s.limit(0), 300).first().insert_size == 300
    times = lambda rows: spark.createDataFrame([(rows,)], "v array<struct<distance: long, n: long>>").select(L.trimmed_mean("v")).first()[0]
    assert times([(i, 1) for i in range(1, 11)]) == 5
    assert times([(1, 10), (5, 80), (100, 10)]) == 5 and times([(7, 1)]) == 7 and times([(0, 19), (10, 1)]) == 0


def test_positions_are_optimal():
    assert S.least_deviation([(0, 1, 10), (1, 2, 10), (0, 2, 20)]) == {0: 0, 1: 10, 2: 20}
    rng = random.Random(3)
    for _ in range(30):
        rows = [(a, b, rng.randint(0, 5)) for a in range(3) for b in range(a + 1, 3)]
        cost = lambda x: sum(abs(x[b] - x[a] - d) for a, b, d in rows)  # noqa: E731, B023
        best = min(cost((0, i, j)) for i in range(-10, 16) for j in range(-10, 16))
        assert cost(S.least_deviation(rows)) == best


def test_positions_by_blocks_are_as_good():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(2, 9)
        rows = [(a, b, rng.randint(-6, 9)) for _ in range(rng.randint(1, 12)) for a, b in [rng.sample(range(n), 2)]]
        cost = lambda x: sum(abs(x[b] - x[a] - d) for a, b, d in rows)  # noqa: E731, B023
        x = S.least_deviation(rows)
        assert x.keys() == {v for a, b, _ in rows for v in (a, b)} and min(x.values()) == 0
        assert cost(x) == cost(S._least_deviation(rows))
        assert sorted(k for own in S.blocks([r[:2] for r in rows]) for k in own) == list(range(len(rows)))
    long = [(i, i + 1, i % 7) for i in range(20_000)]
    assert S.least_deviation(long)[20_000] == sum(d for _, _, d in long)


def test_conflicts_and_components(spark):
    place = {0: (0, 100), 1: (50, 100), 2: (60, 10)}
    assert S.Graph([], place).conflicts(40) == [(0, 1)]
    assert S.Graph([(0, 1, 50, 1)], place).conflicts(40) == []
    got = connected_components(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], ["src", "dst"]))
    assert {r.node: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}


def test_mixture_finds_two_peaks():
    rng = random.Random(1)
    x = [rng.gauss(100, 5) for _ in range(100)] + [rng.gauss(300, 5) for _ in range(60)]
    found = M.peaks(x, [1] * len(x), 5.0)
    assert len(found) == 2 and abs(found[0][0] - 100) < 3 and abs(found[1][0] - 300) < 3


def test_fold():
    assert E.fold([("AACCGGTT", 0, None), ("GGTTACGT", -4, None)], 5, 200, 1.0) == ["AACCGGTTACGT"]
    assert E.fold([("AAAA", 0, None), ("CCCC", 3, None)], 5, 200, 1.0) == ["AAAANNNCCCC"]
    assert E.fold([("AAAA", 0, None), ("CCCC", 900, None)], 5, 200, 1.0) == ["AAAA", "CCCC"]


def test_formats(spark, tmp_path):
    lines = ["@r1", "ACGT", "+", "IIIII", "", "@r2", "AC", "+r2", "II", "bad", "@r3", "A", "+", "I"]
    assert list(files.parse_fastq(lines)) == [("r1", "ACGT", "IIII"), ("r2", "AC", "II")]
    assert [x[0] for x in files.parse_fastq(lines, "DROP")] == ["r1", "r2", "r3"]
    assert len(files.read_config("INSERT_SIZE=1\nq1=a # x\nq2=b\nINSERT_SIZE=2\nq1=c\nq2=d")) == 2
    (tmp_path / "a.fq").write_text("\n".join(lines))
    assert files.read_fastq(spark, str(tmp_path / "a.fq")).count() == 2


def test_reassembles_a_random_genome(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(1500))
    reads = spark.createDataFrame([(genome[i : i + 100],) for i in range(0, 1401, 4)], ["seq"])
    out = assemble_pipeline(reads, [], Parameters(k=21)).collect()
    longest = max((r.seq for r in out), key=len)
    assert len(longest) > 1200 and (longest in genome or rc(longest) in genome)
    assert Library().insert_size == 180


def test_query_of_scaffolds_follows_long_chains(spark, monkeypatch):
    k, rng = queries.K_SIZE, random.Random(21)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    inner = 6
    genome = letters(100) + letters(5 * inner - (k - 1)) + letters(100)
    # contigs of k + 4 letters, each 5 further on, from the end of the left one to the begin of the right one
    seqs = {0: genome[:100], 1: genome[100 + 5 * inner - (k - 1) :]}
    seqs |= {2 + i: genome[100 - (k - 1) + 5 * i :][: k + 4] for i in range(inner)}
    seqs |= {20: genome[100 - (k - 1) : 100] + letters(5)}  # a dead end
    gap = 5 * inner - (k - 1)
    found, todo = [], [([0], -(k - 1))]
    while todo:  # all paths, by brute force
        path, n = todo.pop()
        for b, s in seqs.items():
            if seqs[path[-1]][-(k - 1) :] == s[: k - 1]:
                if b == 1:
                    found.append((abs(n - gap), len(path) + 1, [*path, b]))
                elif n <= 300:
                    todo.append(([*path, b], n + len(s) - (k - 1)))
    assert min(found)[2] == [0, *range(2, 2 + inner), 1]
    members = spark.createDataFrame([(0, 0, 0, gap), (0, 1, 1, 0)], "component_id long, ord long, contig_id long, gap_after long")
    contigs = spark.createDataFrame(list(seqs.items()), "contig_id long, seq string")
    monkeypatch.setattr(queries, "_members", lambda spark, sf: (members, contigs))
    assert [r.seq for r in queries.e06_scaffold_sequences(spark, "").collect()] == [genome]


def test_components_run_until_labels_settle(spark, monkeypatch):
    rng = random.Random(3)
    for limit in (0, 1 << 20):
        monkeypatch.setattr("strandweave.operators.components.ONE_TASK", limit)
        ids = list(range(40))
        rng.shuffle(ids)
        edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
        assert sorted((r.node, r.component) for r in connected_components(edges).collect()) == [(i, 0) for i in range(40)]
        pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(None, 3), (70, 70)]
        near = {v: {v} for p in pairs if None not in p for v in p}
        for _ in pairs:
            for a, b in pairs:
                if a is not None:
                    near[a] = near[b] = near[a] | near[b]
        for v in near:
            near[v] = set().union(*(near[w] for w in near[v]))
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        assert got == {v: min(x) for v, x in near.items()}
    assert connected_components(edges.limit(0)).count() == 0


def test_rescue_takes_what_a_refused_one_leaves_free(spark):
    # of (a, x), (b, x) and (b, y) the second is refused, so the third finds b free
    counts = spark.createDataFrame([("TAC", 2), ("TGC", 2), ("CAT", 2), ("CTT", 2), ("ACA", 1), ("GCA", 1), ("GCT", 1)], ["kmer", "cnt"])
    got = {r.src + r.base for r in G.rescue_singletons(counts).where("weight = 1").collect()}
    assert got == {"ACA", "GCT"}


def pruned_by_hand(edges, cutoff):
    """Lists in order of the source; each step looks at what the steps before it have left."""
    left = sorted(edges)

    def tips(left, forward):
        for e in list(left):
            a, b, c = e
            outs = [x for x in left if x[0] == a]
            ins = [x for x in left if x[1] == b]
            if forward:
                dead = not any(x[0] == b for x in left) and any(y[0] == x[1] for x in outs for y in left)
                rivals = outs
            else:
                dead = not any(x[1] == a for x in left) and any(y[1] == x[0] for x in ins for y in left)
                rivals = ins
            if dead or (c < 3 * cutoff and sum(x[2] > c for x in rivals) >= 2):
                left.remove(e)

    def both():
        tips(left, True)
        tips(left, False)

    both()
    for n in sorted({v for a, b, _ in edges for v in (a, b)}):
        if sum(a == n for a, _, _ in left) + sum(b == n for _, b, _ in left) >= S.DEGREE:
            left[:] = [e for e in left if n not in e[:2]]
    both()
    return [(a, b) for a, b, _ in left]


def test_pruning_follows_the_source(spark):
    rng = random.Random(12)
    for trial in range(60):
        n = rng.choice((6, 9, 14))
        edges = {(a, b): rng.randint(1, 9) for _ in range(rng.randint(4, 45)) for a, b in [rng.sample(range(n), 2)]}
        rows = [(a, b, c) for (a, b), c in edges.items()]
        assert S.prune_kernel(rows, 2) == pruned_by_hand(rows, 2), trial
    rows = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 9, 1), (11, 12, 4)], "src long, dst long, read_cov long")
    assert sorted(tuple(r) for r in S.prune(rows, 1).collect()) == [(1, 2), (2, 3), (11, 12)]


def test_a_light_peak_takes_what_merges_into_it():
    assert M.LEAST_WEIGHT == 0.1
    fits = {"x": None}

    def fake(x, n, k, delta):
        return M.np.array([100.0, 110.0, 500.0]), M.np.full(3, 5.0), M.np.array([0.5, 0.05, 0.45]), 0.0

    keep, M.fit = M.fit, fake
    try:
        found = M.peaks([1.0, 2.0, 3.0], [1, 1, 1], 5.0)
    finally:
        M.fit = keep
    assert [(p[0], round(p[2], 9)) for p in found] == [(110.0, 0.55), (500.0, 0.45)] and fits


def test_windows_take_linear_time(spark):
    import time

    took = []
    for n in (100_000, 800_000):
        df = spark.createDataFrame([("ACGTTGCA" * (n // 8),)], ["s"])
        df.select(F.size(Q.windows("s", 21))).first()
        began = time.time()
        assert df.select(F.size(Q.windows("s", 21))).first()[0] == n - 20
        took.append(time.time() - began)
    assert took[1] < 30 * max(took[0], 0.2)


def test_packed_and_spelled_counts_agree(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choice("ACGTacgtNx-") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(rng.randint(0, 120))) for _ in range(50)] + ["", None, "ACGTACGTAC" * 30]
    reads = spark.createDataFrame([(r,) for r in rows], "seq string")
    for k in (1, 2, 5, 8, 21, 31):
        for strands in (True, False):
            packed = {r.kmer: r.cnt for r in K.count_kmers(reads, k, strands=strands).collect()}
            spelled = {r.kmer: r.n for r in K.kmer_rows(reads.where("seq is not null"), k, strands=strands).groupBy("kmer").agg(F.count("*").alias("n")).collect()}
            assert packed == spelled, (k, strands)


def test_repeats_on_a_path_do_not_lose_it(spark):
    """A loop of short contigs gives a path for every number of turns; only one per place and length goes on."""
    k = 5
    contigs = spark.createDataFrame([(0, "AAAACCCGT"), (1, "CCGTACGT"), (2, "ACGTACGT"), (3, "ACGTTTTTT"), (4, "CGTACGTA"), (5, "GTACGTAC")], "contig_id long, seq string")
    gaps = spark.createDataFrame([(0, 1, 0, 3, 40)], "scaffold_id long, ord long, left long, right long, gap long")
    found = E.search_paths(gaps, contigs, k, 200, 10.0).collect()
    assert len(found) == 1 and found[0].length == 40


def test_recalled_components_get_dense_ids(spark):
    rows = spark.createDataFrame([(5,), (9,), (11,)], "contig_id long")
    assert sorted((r.contig_id, r.n) for r in G.numbered(rows, ["contig_id"], "n", first=4).collect()) == [(5, 4), (9, 5), (11, 6)]
