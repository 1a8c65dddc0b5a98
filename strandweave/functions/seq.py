"""Column functions on nucleotide strings. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: Column | str) -> Column:
    """A-T and C-G exchanged, N kept, read backwards; other letters are upper-cased first and kept as they are."""
    return F.reverse(F.translate(F.upper(_c(seq)), "ACGTN", "TGCAN"))


def reverse_read(seq: Column | str, qual: Column | str) -> Column:
    """(seq, qual) of the other strand: the reverse complement, and its qualities read backwards."""
    return F.struct(reverse_complement(seq).alias("seq"), F.reverse(_c(qual)).alias("qual"))


def fill_n(n: Column) -> Column:
    """A run of n letters N; none for n of 0 or less."""
    return F.repeat(F.lit("N"), F.greatest(n, F.lit(0)).cast("int"))


def reverse_complement_strict(seq: Column | str) -> Column:
    """As the duplicate filter has it: every letter that is no base counts as T, so its complement is A."""
    return F.reverse(F.translate(F.regexp_replace(_c(seq), "[^ACGT]", "T"), "ACGT", "TGCA"))


def trim(seq: Column | str, percent: float = 1.0, cutoff: int | None = None) -> Column:
    """The first ``percent`` of a read, if below one, and at most ``cutoff`` letters."""
    n = F.length(_c(seq))
    keep = F.floor(n * F.lit(percent)).cast("int") if percent < 1 else n
    return F.substring(_c(seq), F.lit(1), F.least(keep, F.lit(cutoff)) if cutoff is not None else keep)


def windows(seq: Column | str, k: int, letters: str = ".") -> Column:
    """Array of the k-letter windows in turn; empty for shorter strings. With ``letters`` (a character class), those made of them only.

    One pass of a look-ahead: the time is linear in the length, where a substring per place would walk from the start each time.
    """
    return F.regexp_extract_all(_c(seq), F.lit(f"(?s)(?=({letters}{{{k}}}))"), F.lit(1))


def codes(seq: Column | str) -> Column:
    """Bases as digits 0 to 3."""
    return F.translate(F.upper(_c(seq)), BASES, "0123")


def bases(digits: Column | str) -> Column:
    return F.translate(_c(digits), "0123", BASES)


def pack_kmer(kmer: Column | str) -> Column:
    """A k-mer of up to 31 bases as a number; its order is that of the strings."""
    return F.conv(codes(kmer), 4, 10).cast("long")


def shift(kmer: Column | str, base: Column) -> Column:
    """The k-mer that follows when ``base`` comes in on the right."""
    return F.concat(F.substring(_c(kmer), F.lit(2), F.length(_c(kmer)) - 1), base)


def unshift(kmer: Column | str, base: Column) -> Column:
    """The k-mer before, with ``base`` on the left."""
    return F.concat(base, F.substring(_c(kmer), F.lit(1), F.length(_c(kmer)) - 1))


def base_at(kmer: Column | str, i: Column | int) -> Column:
    """Base at place i, counted from 0."""
    return F.substring(_c(kmer), (F.lit(i) if isinstance(i, int) else i) + 1, F.lit(1))


def overlap(left: Column | str, right: Column | str, most: int) -> Column:
    """Length of the longest end of ``left`` that begins ``right``, up to ``most``."""
    a, b = _c(left), _c(right)
    found = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda m: (m <= F.length(a)) & (m <= F.length(b)) & (F.substring(a, F.length(a) - m + 1, m) == F.substring(b, F.lit(1), m)))
    return F.coalesce(F.array_max(found), F.lit(0))


def chain(parts: Column | str, k: int) -> Column:
    """Sequence of a path of strings that overlap in k - 1 letters each."""
    p = _c(parts)
    rest = F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.substring(x, F.lit(k), F.length(x)))
    return F.concat(F.element_at(p, 1), F.array_join(rest, ""))


def wrap(seq: Column | str, width: int = 60) -> Column:
    """Line feeds after every ``width`` letters, none at the end."""
    return F.rtrim(F.regexp_replace(_c(seq), f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def link_distance(insert: Column, pos_left: Column, pos_right: Column, len_left: Column, k: int) -> Column:
    """Distance from the start of the left component to that of the right one; null where the pair contradicts the insert size."""
    d = insert + pos_left - pos_right
    over = len_left - d
    return F.when((over > k) & (over > insert), F.lit(None)).when(over > k, len_left).otherwise(d)


def gaussian(x: Column, mean: Column, delta: Column) -> Column:
    """Density of the normal distribution."""
    return F.exp(-F.pow((x - mean) / delta, 2) / 2) / (delta * F.lit(2.5066282746310002))


def gaussian_cdf(x: Column, mean: Column, delta: Column) -> Column:
    """Share of the normal distribution up to x, to 1e-7: the rational approximation 7.1.26 of Abramowitz and Stegun of the error function."""
    z = (x - mean) / (delta * F.lit(1.4142135623730951))
    t = 1 / (1 + F.lit(0.3275911) * F.abs(z))
    rest = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        rest = (rest + F.lit(c)) * t
    erf = F.signum(z) * (1 - rest * F.exp(-z * z))
    return (1 + erf) / 2


def log_poisson(lam: Column, c: Column) -> Column:
    """log of the Poisson probability of c at the rate lam, without its sign; the least double for a rate of 0."""
    factorial = F.aggregate(F.when(c >= 1, F.sequence(F.lit(1).cast("long"), c.cast("long"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(lam <= 2.220446049250313e-16, F.lit(-1.7976931348623157e308)).otherwise(c * F.log(lam) - factorial - lam)


def expected_pairs(len_left: Column, len_right: Column, gap: Column, insert: int, delta: float, k: int, read_len: int) -> Column:
    """How many k-mer pairs a link of two components is expected to have: a sum of shares of the insert size over the places of the left one, of twice the insert size at most."""
    a, b = F.least(len_left, F.lit(2 * insert)), F.least(len_right, F.lit(2 * insert))
    share = lambda x: gaussian_cdf(x.cast("double"), F.lit(float(insert)), F.lit(float(delta)))
    places = a + read_len - 2 * k
    each = F.when(places >= 1, F.sequence(F.lit(0).cast("long"), (places - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(each, F.lit(0.0), lambda s, i: s + share(read_len + a + gap + b - 2 * k - i) - share(a + gap - i))


def register(spark: SparkSession) -> None:
    """SQL functions revcomp(seq) and kmers(seq, k), the latter an array."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(seq STRING) RETURNS STRING RETURN reverse(translate(upper(seq), 'ACGTN', 'TGCAN'))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT) RETURNS ARRAY<STRING> RETURN "
        "regexp_extract_all(seq, concat('(?s)(?=(.{', k, '}))'), 1)"
    )
