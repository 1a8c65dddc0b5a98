"""Readers and writers of the text formats.

Lines are read by Spark, so large files are split; records of several lines are put together by the place of their lines.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.seq import wrap
from strandweave.operators.debruijn import numbered
from strandweave.sources.lines import READS, numbered_lines, path_list, read_fastq, read_pairs  # noqa: F401

def parse_fastq(lines: list[str], mode: str = "STOP") -> Iterator[tuple[str, str, str]]:
    """(name, seq, qual) of four-line records, blank lines skipped, lines trimmed.

    A quality longer than the sequence is cut. At a damaged record, STOP ends the file, DROP goes on with the next header, FAIL raises.
    """
    rows = [x.strip() for x in lines if x.strip()]
    at = 0
    while at < len(rows):
        four = rows[at : at + 4]
        good = len(four) == 4 and four[0].startswith("@") and four[2].startswith("+") and (four[2] == "+" or four[2].endswith(four[0][1:])) and len(four[3]) >= len(four[1])
        if good:
            yield four[0][1:], four[1], four[3][: len(four[1])]
            at += 4
        elif mode == "STOP":
            return
        elif mode == "FAIL":
            raise ValueError(f"damaged record at line {at + 1}")
        else:
            at += 1
            while at < len(rows) and not rows[at].startswith("@"):
                at += 1


def _frame(rows, names):
    import pandas as pd

    return pd.DataFrame(rows, columns=names)


def read_fastq_dropping(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """As ``read_fastq``, but a damaged record is left out and reading goes on with the next header. What is a header depends on all lines before, so
    one task reads a file, of 2 GB at most."""

    def run(batches):
        for pdf in batches:
            for path, body in pdf.itertuples(index=False):
                lines = (gzip.decompress(body) if path.endswith(".gz") else body).decode("utf-8", "replace").splitlines()
                yield _frame([(path, i, *r) for i, r in enumerate(parse_fastq(lines, "DROP"))], ["path", "read_id", "name", "seq", "qual"])

    return spark.read.format("binaryFile").load(path_list(paths)).select("path", "content").mapInPandas(run, READS)


def read_fasta(spark: SparkSession, paths: str | list[str], whole: bool = False) -> DataFrame:
    """(path, seq_id, name, seq); lines before the first header are left out. ``seq_id`` counts by file, or over all files as a whole."""
    rows = numbered_lines(spark, paths, whole=whole).where("head > 0")
    body = F.when(F.col("value").startswith(">"), "").otherwise(F.col("value"))
    parts = rows.groupBy("path", "head").agg(F.min(F.struct("line", "value"))["value"].alias("name"), F.array_sort(F.collect_list(F.struct("line", body.alias("s")))).alias("c"))
    return parts.select("path", (F.col("head") - 1).alias("seq_id"), F.expr("substring(name, 2)").alias("name"), F.array_join(F.transform("c", lambda x: x["s"]), "").alias("seq"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, seq, len, copy_num): ids are places in the file, the copy number follows a tab in the header."""
    rows = read_fasta(spark, path, whole=True)
    return rows.select(F.col("seq_id").alias("contig_id"), "seq", F.length("seq").cast("long").alias("len"), F.expr("try_cast(split(name, '\\t')[1] as long)").alias("copy_num"))


def read_arff(spark: SparkSession, path: str, fields: int = 2) -> tuple[DataFrame, DataFrame]:
    """Attributes (name, value) and rows: (kmer, cnt) of two fields, else (f0, f1, ...). Rows with fewer fields are left out."""
    lines = spark.read.text(path_list(path))
    attrs = lines.where("value like '@attribute%'").select(F.split("value", r"\s+")[1].alias("name"), F.expr("try_cast(split(value, '\\\\s+')[2] as double)").alias("value"))
    cells = F.split(F.trim("value"), "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.size(cells) >= fields))
    if fields == 2:
        return attrs, rows.select(cells[0].alias("kmer"), cells[1].cast("long").alias("cnt"))
    return attrs, rows.select(*[cells[i].alias(f"f{i}") for i in range(fields)])


def read_condensed(spark: SparkSession, path: str) -> DataFrame:
    """(edge_id, src_id, dst_id, seq, coverage) from records of two lines; edge_id is the place in the file."""
    rows = numbered_lines(spark, path, whole=True).withColumn("edge_id", F.floor(F.col("line") / 2))
    two = rows.groupBy("edge_id").agg(F.max(F.when(F.col("line") % 2 == 0, F.col("value"))).alias("h"), F.max(F.when(F.col("line") % 2 == 1, F.col("value"))).alias("c"))
    cells = F.split("h", "\t")
    return two.where("c is not null").select("edge_id", cells[0].cast("long").alias("src_id"), cells[1].cast("long").alias("dst_id"), cells[2].alias("seq"), F.col("c").cast("double").alias("coverage"))


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """Members (component_id, ord, contig_id, gap_after) from records of three lines; numbers are split by blanks, commas or tabs, the last contig has gap 0."""
    rows = numbered_lines(spark, path, blank=True, whole=True).where("head > 0")
    first = F.min("line")
    lines = rows.groupBy("head").agg(first.alias("at"), F.map_from_entries(F.collect_list(F.struct("line", "value"))).alias("m"))  # three lines a record
    numbers = lambda c: F.transform(F.filter(F.split(c, r"[ ,\t]+"), lambda x: x != ""), lambda x: x.cast("long"))
    at = lambda d: F.coalesce(F.try_element_at("m", F.col("at") + d), F.lit(""))
    lists = lines.select((F.col("head") - 1).alias("component_id"), numbers(at(1)).alias("ids"), numbers(at(2)).alias("gaps"))
    member = lists.select("component_id", "gaps", F.posexplode("ids").alias("ord", "contig_id"))
    return member.select("component_id", F.col("ord").cast("long").alias("ord"), "contig_id", F.coalesce(F.try_element_at("gaps", F.col("ord") + 1), F.lit(0).cast("long")).alias("gap_after"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="src long, dst long, distance long, kmer_cov long, score double")


def read_values(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """(component_id, name) from one whole number per line, as positions and lengths are kept; ids are places in the file."""
    return numbered_lines(spark, path, whole=True).select(F.col("line").alias("component_id"), F.col("value").cast("long").alias(name))


LP_ROW = r"^\s*s\.t\. con(\d+)\s*:\s*x_(\d+)\s*-\s*x_(\d+)\s*\+\s*e_(\d+)_(\d+)\s*=\s*([+-]?\d+)\s*;\s*$"


def read_lp(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, distance) of the equality rows of a model, ``x_dst - x_src + e = distance``; of rows for the same two the last one holds."""
    rows = numbered_lines(spark, path, whole=True).where(F.col("value").rlike(LP_ROW))
    cells = [F.regexp_extract("value", LP_ROW, g) for g in (3, 2, 6)]
    rows = rows.select("line", cells[0].cast("long").alias("src"), cells[1].cast("long").alias("dst"), cells[2].cast("long").alias("distance"))
    return rows.groupBy("src", "dst").agg(F.max_by("distance", "line").alias("distance"))


def read_config(text: str) -> list[dict[str, str]]:
    """Libraries of ``key = value`` lines; # begins a comment and a repeated key a new library."""
    out: list[dict[str, str]] = [{}]
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if key in out[-1]:
                out.append({})
            out[-1][key] = value
    return out


def read_parameters(text: str, given: dict | None = None) -> dict[str, str]:
    """``key=value`` lines, # begins a comment, a section header in brackets counts for nothing; values that are given win, unless they are None."""
    lines = (x.split("#")[0] for x in text.splitlines())
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x)} | {k: str(v) for k, v in (given or {}).items() if v is not None}


def write_lines(rows: DataFrame, order: list[str], line, path: str, compression: str = "none") -> None:
    """One line per row, in order; range partitions keep the order over files."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.option("compression", compression).text(path)


def write_fastq(reads: DataFrame, order: list[str], path: str, compression: str = "none") -> None:
    """(name, seq, qual) as records of four lines."""
    write_lines(reads, order, fastq_record(), path, compression)


def fastq_record():
    return F.concat(F.lit("@"), F.col("name").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")


def write_kmers(counts: DataFrame, stats: DataFrame, path: str, threshold: int = 1) -> None:
    """Attributes, then rows over the threshold in order of the k-mer, in one folder whose files follow each other."""
    head = stats.select(F.posexplode(F.array(F.concat(F.lit("@attribute mean "), F.col("mean").cast("string")), F.concat(F.lit("@attribute variance "), F.col("stddev").cast("string")), F.lit("@data"))).alias("i", "value"))
    rows = head.select(F.lit("").alias("kmer"), "i", "value").unionByName(counts.where(F.col("cnt") > threshold).select("kmer", F.lit(0).alias("i"), F.concat_ws("\t", "kmer", "cnt").alias("value")))
    write_lines(rows, ["kmer", "i"], F.col("value"), path)


def write_contigs(contigs: DataFrame, path: str) -> None:
    write_lines(contigs, ["contig_id"], F.concat(F.lit(">seq_"), "contig_id", F.lit("\t"), "copy_num", F.lit("\n"), "seq"), path)


def write_condensed(edges: DataFrame, path: str) -> None:
    write_lines(edges, ["edge_id"], F.concat(F.concat_ws("\t", "src_id", "dst_id", "seq"), F.lit("\n"), F.col("coverage").cast("string")), path)


def write_components(members: DataFrame, path: str) -> None:
    rows = members.groupBy("component_id").agg(F.array_sort(F.collect_list(F.struct("ord", "contig_id", "gap_after"))).alias("m"))
    ids = F.array_join(F.transform("m", lambda x: x["contig_id"].cast("string")), " ")
    gaps = F.array_join(F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: x["gap_after"].cast("string")), " ")
    write_lines(rows, ["component_id"], F.concat(F.lit(">component\t"), "component_id", F.lit("\n"), ids, F.lit("\n"), gaps), path)


def write_links(rows: DataFrame, path: str, repeated: DataFrame | None = None) -> None:
    """Links of positive distance that touch no repeat."""
    from strandweave.operators.links import without_repeats

    rows = rows if repeated is None else without_repeats(rows, repeated)
    write_lines(rows.where("distance > 0"), ["src", "dst"], F.concat_ws("\t", "src", "dst", "distance", "kmer_cov", F.format_string("%f", F.col("score").cast("double"))), path)


def write_values(rows: DataFrame, key: str, value: str, path: str) -> None:
    """One whole number per line in order of the key, as positions and lengths are kept."""
    write_lines(rows, [key], F.col(value).cast("long").cast("string"), path)


def write_lp(rows: DataFrame, path: str, nodes: DataFrame | None = None) -> None:
    """The position model of (src, dst, distance): variables, objective, equalities, then bounds of the errors; constraints are numbered from 1.

    ``nodes`` (component_id) may name more variables than the links do.
    """
    ends = rows.select(F.explode(F.array("src", "dst")).alias("component_id"))
    ends = (ends if nodes is None else ends.unionByName(nodes.select("component_id"))).distinct()
    n = rows.count()
    error = F.format_string("%d_%d", "src", "dst")
    eq = numbered(rows.select("src", "dst", "distance"), ["src", "dst"], "i")
    number, zero = F.col("i"), F.lit(0).cast("long")

    def line(section: int, a, b, i, text):
        return F.struct(F.lit(section).alias("section"), a.alias("a"), b.alias("b"), i.alias("i"), text.alias("value"))

    src, dst = F.col("src"), F.col("dst")
    of_link = F.array(
        line(0, src, dst, F.lit(1).cast("long"), F.concat(F.lit("var e_"), error, F.lit(";"))),
        line(0, src, dst, F.lit(2).cast("long"), F.concat(F.lit("var E_"), error, F.lit(";"))),
        line(2, src, dst, zero, F.concat(F.lit(" E_"), error, F.lit(" + "))),
        line(4, src, dst, zero, F.concat(F.format_string("s.t. con%d : x_%d - x_%d + e_", number, dst, src), error, F.format_string(" = %d;", F.col("distance")))),
        line(5, src, dst, zero, F.concat(F.format_string("s.t. con%d : E_", 2 * number - 1 + n), error, F.lit(" + e_"), error, F.lit(" >= 0;"))),
        line(5, src, dst, F.lit(1).cast("long"), F.concat(F.format_string("s.t. con%d : E_", 2 * number + n), error, F.lit(" - e_"), error, F.lit(" >= 0;"))),
    )
    of_node = ends.select(line(0, F.col("component_id"), F.lit(-1).cast("long"), zero, F.format_string("var x_%d;", "component_id")).alias("l"))
    fixed = rows.sparkSession.createDataFrame([(1, "minimize z:  "), (3, "0;"), (6, "end;")], "s int, v string")
    frame = fixed.select(F.struct(F.col("s").alias("section"), zero.alias("a"), zero.alias("b"), zero.alias("i"), F.col("v").alias("value")).alias("l"))
    lines = eq.select(F.explode(of_link).alias("l")).unionByName(of_node).unionByName(frame).select("l.*")
    write_lines(lines, ["section", "a", "b", "i"], F.col("value"), path)


def write_parameters(spark: SparkSession, values: dict, path: str) -> None:
    """``key=value`` lines in the order given."""
    rows = spark.createDataFrame([(i, f"{k}={v}") for i, (k, v) in enumerate(values.items())], "i int, value string")
    rows.coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def write_scaffolds(seqs: DataFrame, path: str) -> None:
    """FASTA of 60 columns; records are numbered in order of scaffold and part."""
    rows = numbered(seqs.select("scaffold_id", "part", "len", "seq"), ["scaffold_id", "part"], "i", first=0)
    head = F.concat(F.lit(">scaf_"), F.col("i").cast("string"), F.lit("_"), F.col("len").cast("string"), F.lit("\n"))
    write_lines(rows, ["i"], F.concat(head, wrap("seq")), path)


def write_unpaired(contigs: DataFrame, pairs: DataFrame, path: str) -> None:
    """Contigs without a reverse complement among the others, each with its own, as FASTA."""
    from strandweave.functions.seq import reverse_complement_strict

    rows = contigs.join(pairs.select(F.col("contig_id").alias("p")), F.col("contig_id") == F.col("p"), "left_anti")
    write_lines(rows, ["contig_id"], F.concat(F.lit(">ctg\n"), "seq", F.lit("\n"), reverse_complement_strict("seq")), path)


def write_lengths(lengths: DataFrame, path: str) -> None:
    """Lengths, the longest first."""
    rows = lengths.select((-F.col("length")).alias("o"), "component_id", "length")
    write_lines(rows, ["o", "component_id"], F.col("length").cast("string"), path)


def write_reports(contigs: DataFrame, pairs: DataFrame, lengths: DataFrame, kept: DataFrame, members: DataFrame, path: str) -> None:
    """What the duplicate filter leaves behind: contigs without a partner, lengths before and after, and the scaffolds kept, numbered by length."""
    write_unpaired(contigs, pairs, f"{path}/unpaired")
    write_lengths(lengths, f"{path}/lengths_before")
    write_lengths(kept, f"{path}/lengths_after")
    order = numbered(kept.select((-F.col("length")).alias("o"), F.col("component_id").alias("old")), ["o", "old"], "component_id", first=0)
    write_components(members.withColumnRenamed("component_id", "c").join(order, F.col("c") == F.col("old")).select("component_id", "ord", "contig_id", "gap_after"), f"{path}/components")


def graphviz(links: DataFrame, comps: DataFrame | None = None, node: int | None = None) -> DataFrame:
    """(o, value): lines of a directed graph, labelled with distances; with (node, component) of all nodes, only of the component that ``node`` is in."""
    if comps is not None:
        own = comps.where(F.col("node") == node).select(F.col("component").alias("c"))
        links = links.join(comps, F.col("src") == F.col("node")).join(own, F.col("component") == F.col("c"), "left_semi")
    ends = links.sparkSession.createDataFrame([(0, "digraph {"), (2, "}")], "o int, value string")
    rows = links.select(F.lit(1).alias("o"), F.format_string('%d->%d[label="%d"]', "src", "dst", "distance").alias("value"))
    return ends.unionByName(rows)


def debug_lines(rows: DataFrame, kind: str) -> DataFrame:
    """(value): rows as the text that is printed for them; ``kind`` is read, pair, contig, component or kmer."""
    text = {
        "read": fastq_record,
        "pair": lambda: F.concat_ws("\t", "seq1", "seq2"),
        "contig": lambda: F.concat_ws("\t", "contig_id", "seq", "copy_num", "len"),
        "kmer": lambda: F.concat_ws("\t", "kmer", "component_id", "pos"),
        "component": lambda: F.concat(F.lit("len:"), "length", F.lit("\n"), F.array_join("contigs", "\t"), F.lit("\n"), F.array_join("gaps", "\t")),
    }[kind]
    return rows.select(text().alias("value"))
