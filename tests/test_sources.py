import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import seq as Q
from strandweave.plans.assembly import Library, Parameters, assemble_config, assemble_pipeline, libraries_of, preprocess
from strandweave.sources import files


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture
def small_blocks(spark):
    """Files of a few KB are split over many tasks."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def records(rng, n):
    """Qualities begin with the marks of the other lines, to mislead a reader that guesses."""
    return [(f"r{i}", "".join(rng.choice("ACGTN") for _ in range(m)), rng.choice("@+>") + "I" * (m - 1)) for i in range(n) for m in [rng.randint(1, 90)]]


def text_of(rows, rng):
    return "".join(f"@{n}\n{s}\n+{n if i % 2 else ''}\n{q}\n" + "\n" * (rng.random() < 0.1) for i, (n, s, q) in enumerate(rows))


def test_fastq_is_split_and_keeps_order(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    rows = records(rng, 200)
    text = text_of(rows, rng)
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write(text)
    assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 10
    for name in ("a.fq", "a.fq.gz"):
        got = files.read_fastq(spark, str(tmp_path / name), mode="FAIL").orderBy("read_id").collect()
        assert [(r.name, r.seq, r.qual) for r in got] == rows
    cut = files.read_fastq(spark, str(tmp_path / "a.fq"), percent=0.95, cutoff=40).orderBy("read_id").collect()
    n = [min(int(len(s) * 0.95), 40) for _, s, _ in rows]
    assert [(r.seq, r.qual) for r in cut] == [(s[:k], q[:k]) for (_, s, q), k in zip(rows, n, strict=True)]


def test_damage_ends_only_its_own_file(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    rows = records(rng, 120)
    text = text_of(rows, rng)
    at = text.index("@r70\n")
    (tmp_path / "good.fq").write_text(text)
    (tmp_path / "bad.fq").write_text(text[:at] + "oops\n" + text[at:])
    (tmp_path / "short.fq").write_text(text[: text.index("@r119\n") + 8])
    paths = ":".join(str(tmp_path / f"{n}.fq") for n in ("bad", "good", "short"))
    got = {r.path[-8:-3].strip("/"): r["count"] for r in files.read_fastq(spark, paths).groupBy("path").count().collect()}
    assert sorted(got.values()) == [70, 119, 120]
    with pytest.raises(Exception, match="damaged record"):
        files.read_fastq(spark, str(tmp_path / "bad.fq"), mode="FAIL").collect()
    assert files.read_fastq_dropping(spark, str(tmp_path / "bad.fq")).count() == 120
    (tmp_path / "none.fq").write_text("")
    assert files.read_fastq(spark, str(tmp_path / "none.fq")).count() == 0


def test_mates_are_found_by_file_and_place(spark, tmp_path):
    for name, bases in (("a1", "AC"), ("a2", "CA"), ("b1", "GT"), ("b2", "TG")):
        (tmp_path / f"{name}.fq").write_text("".join(f"@x\n{bases * (i + 1)}\n+\n{'II' * (i + 1)}\n" for i in range(3 if name != "b2" else 2)))
    p = lambda *n: [str(tmp_path / f"{x}.fq") for x in n]
    got = files.read_pairs(spark, p("a1", "b1"), p("a2", "b2")).orderBy("pair_id").collect()
    assert [(r.seq1, r.seq2) for r in got] == [("AC" * i, "CA" * i) for i in (1, 2, 3)] + [("GT" * i, "TG" * i) for i in (1, 2)]
    with pytest.raises(ValueError):
        files.read_pairs(spark, p("a1", "b1"), p("a2"))


def test_models_are_read_as_they_are_written(spark, tmp_path):
    lines = ["var x_1;", "s.t. con1 : x_7 - x_1 + e_1_7 = +5;", " s.t. con2: x_9-x_1 + e_1_9 = -3; ", "s.t. con3 : x_7 - x_1 + e_1_7 = 8;", "s.t. con4 : E_1_7 + e_1_7 >= 0;", "x_3 - x_1 + e = 4"]
    (tmp_path / "m").write_text("\n".join(lines))
    assert {tuple(r) for r in files.read_lp(spark, str(tmp_path / "m")).collect()} == {(1, 7, 8), (1, 9, -3)}


def test_components_and_attributes(spark, tmp_path):
    (tmp_path / "c").write_text(">component 0\n5\n\n>component 1\n1 2,3\t\n10, -4\n")
    got = [tuple(r) for r in files.read_components(spark, str(tmp_path / "c")).orderBy("component_id", "ord").collect()]
    assert got == [(0, 0, 5, 0), (1, 0, 1, 10), (1, 1, 2, -4), (1, 2, 3, 0)]
    (tmp_path / "k").write_text("@attribute mean 2.5\n@attribute none x\n@data\nACG\t3\tz\nbad\n")
    attributes, rows = files.read_arff(spark, str(tmp_path / "k"), fields=3)
    assert {(r.name, r.value) for r in attributes.collect()} == {("mean", 2.5), ("none", None)}
    assert [tuple(r) for r in rows.collect()] == [("ACG", "3", "z")]


def test_normal_and_poisson(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(-50, 60, 7)], ["x"])
    for r in rows.select("x", Q.gaussian_cdf(F.col("x"), F.lit(3.0), F.lit(11.0)).alias("p")).collect():
        assert abs(r.p - (1 + math.erf((r.x - 3) / (11 * math.sqrt(2)))) / 2) < 2e-7
    one = spark.createDataFrame([(0.0, 2), (2.5, 0), (2.5, 4)], ["l", "c"]).select(Q.log_poisson(F.col("l"), F.col("c").cast("long")).alias("s")).collect()
    assert one[0].s < -1e308 and abs(one[1].s + 2.5) < 1e-12 and abs(one[2].s - (4 * math.log(2.5) - math.log(24) - 2.5)) < 1e-12
    cdf = lambda x: (1 + math.erf((x - 180) / (20 * math.sqrt(2)))) / 2
    a, b, gap, k, n = 300, 500, 40, 27, 100
    want = sum(cdf(n + a + gap + 360 - 2 * k - i) - cdf(a + gap - i) for i in range(a + n - 2 * k))
    got = spark.createDataFrame([(a, b, gap)], ["a", "b", "g"]).select(Q.expected_pairs(F.col("a").cast("long"), F.col("b").cast("long"), F.col("g").cast("long"), 180, 20.0, k, n)).first()[0]
    assert abs(got - want) < 1e-3


def test_preprocess_trims_and_filters(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        s = "".join(rng.choice("ACGT") for _ in range(60))
        rows.append((s, "".join(chr(rng.choice((35, 60, 70, 72))) for _ in s)))
    reads = spark.createDataFrame(rows, ["seq", "qual"])
    k, mean = 8, sum(ord(c) for _, q in rows for c in q) // sum(len(q) for _, q in rows)
    want: dict = {}
    for s, q in rows:
        n = int(len(s) * 0.95)
        for i in range(n - k + 1):
            v = [ord(c) for c in q[i : i + k]]
            if sum(v) // k >= mean * 0.9 and min(v) >= mean * 0.8:
                for w in (s[i : i + k], rc(s[i : i + k])):
                    want[w] = want.get(w, 0) + 1
    got, _ = preprocess(reads, Parameters(k=k, threshold=0, kmer_filter=True))
    assert {r.kmer: r.cnt for r in got.collect()} == want
    plain, _ = preprocess(reads, Parameters(k=k, threshold=0, read_cutoff=20))
    assert sum(r.cnt for r in plain.collect()) == 2 * 40 * 13


def simulated(rng, genome, folder, name, insert, reads=100):
    """Read pairs of both strands, error-free."""
    out = []
    for at in range(0, len(genome) - insert - reads, 7):
        piece = genome[at : at + insert + reads]
        out.append((piece[:reads], rc(piece[-reads:])) if rng.random() < 0.5 else (rc(piece[-reads:]), piece[:reads]))
    for side in (0, 1):
        (folder / f"{name}_{side + 1}.fq").write_text("".join(f"@p{i}\n{x[side]}\n+\n{'I' * reads}\n" for i, x in enumerate(out)))


def test_config_assembles_with_a_library(spark, tmp_path):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genome = letters(2500)
    simulated(rng, genome, tmp_path, "lib", 300)
    text = f"READ_LENGTH_CUTOFF = 100\nq1 = {tmp_path}/lib_1.fq\nq2 = {tmp_path}/lib_2.fq\nINSERT_SIZE = 300\nPAIR_READS_CUTOFF = 2\n"
    libraries, cutoff = libraries_of(text)
    assert (len(libraries), libraries[0].insert_size, libraries[0].pair_reads_cutoff, cutoff) == (1, 300, 2, 100)
    out = assemble_config(spark, text, Parameters(k=21)).collect()
    longest = max((r.seq for r in out), key=len)
    assert len(longest) > 2000 and (longest in genome or rc(longest) in genome)
    with pytest.raises(ValueError):
        assemble_config(spark, "# nothing\n", Parameters(k=21))


def test_pairs_join_what_a_gap_keeps_apart(spark):
    """Reads leave a stretch out; pairs lead over it, so its place is filled with N."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    left, hole, right = letters(1500), letters(60), letters(1500)
    genome = left + hole + right
    reads = [s[i : i + 100] for s in (left, right) for i in range(0, 1401, 4)]
    pairs = [(genome[at : at + 100], rc(genome[at + 300 : at + 400])) for at in range(0, len(genome) - 400, 3)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id long, seq1 string, seq2 string")
    out = assemble_pipeline(spark.createDataFrame([(r,) for r in reads], ["seq"]), [(frame, Library(insert_size=300, pair_reads_cutoff=2))], Parameters(k=21)).collect()
    longest = max((r.seq for r in out), key=len)
    a, _, b = longest.partition("N")
    b = b.lstrip("N")
    assert "N" in longest and len(a) > 1400 and len(b) > 1400
    assert any(a in g and b in g for g in (genome, rc(genome)))
    assert abs(longest.count("N") - 60) <= 40
