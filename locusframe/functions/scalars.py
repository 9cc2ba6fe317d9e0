"""Scalar functions on columns: qualities, logarithms, sequences, tests. All run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10)


def half_up(x: Column) -> Column:
    """Round half up, negative numbers too."""
    return F.floor(x + 0.5)


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def true_probability(q: Column) -> Column:
    return 1 - error_probability(q)


def phred(p: Column, most: int = 93) -> Column:
    """Quality of an error probability, from 1 to ``most``."""
    return F.greatest(F.lit(1), F.least(F.lit(most), half_up(-10 * F.log10(F.greatest(p, F.lit(1e-300)))))).cast("int")


def log_sum_exp(xs: Column) -> Column:
    """ln of the sum of e^x over an array, safe for large values."""
    return F.transform(F.array(F.array_max(xs)), lambda m: m + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - m))))[0]


def log10_sum(xs: Column) -> Column:
    return log_sum_exp(F.transform(xs, lambda x: x * LN10)) / LN10


def log1m_exp(x: Column) -> Column:
    """ln(1 - e^x) for x < 0, by the branch that keeps digits."""
    return F.when(x > -math.log(2), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def log10_one_minus(x: Column) -> Column:
    return log1m_exp(x * LN10) / LN10


def normalise_log10(xs: Column) -> Column:
    """An array of log10 weights as probabilities that sum to 1."""
    return F.transform(F.array(log10_sum(xs)), lambda s: F.transform(xs, lambda x: F.pow(F.lit(10.0), x - s)))[0]


def renormalise_pl(xs: Column) -> Column:
    return F.transform(F.array(F.array_min(xs)), lambda m: F.transform(xs, lambda x: x - m))[0]


#: From here on Stirling's series has all digits of a double; below, logarithms are summed.
STIRLING = 32


def log10_factorial(n: Column) -> Column:
    """log10 of n!: a sum of logarithms, or Stirling's series for large counts, whose sums would lose digits."""
    small = F.aggregate(F.when((n > 1) & (n < STIRLING), F.sequence(F.lit(2).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda a, i: a + F.log10(i))
    x = F.greatest(n, F.lit(STIRLING)).cast("double")
    large = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < STIRLING, small).otherwise(large / LN10)


def log10_binomial(n: Column, k: Column) -> Column:
    return log10_factorial(n) - log10_factorial(k) - log10_factorial(n - k)


def log10_binomial_pmf(n: Column, k: Column, p: float) -> Column:
    return log10_binomial(n, k) + k * math.log10(p) + (n - k) * math.log10(1 - p)


def binomial_pmf(n: Column, k: Column, p: float) -> Column:
    return F.pow(F.lit(10.0), log10_binomial_pmf(n, k, p))


def gaussian(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(xs)


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def share_of(s: Column, letters: str) -> Column:
    """Share of a text's characters that are among ``letters`` (GC content for "GCgc")."""
    return (F.length(s) - F.length(F.translate(s, letters, ""))) / F.greatest(F.length(s), F.lit(1))


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, in order, in one pass."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def canonical(s: Column) -> Column:
    """The smaller of a text and its reverse: one key for both directions."""
    return F.least(s, F.reverse(s))


def dust(s: Column) -> Column:
    """Low-complexity score of a text: sum of c(c - 1) / 2 over its triplets, by the number of triplets less one."""
    triplets = F.array_sort(kmers(s, 3))
    pairs = F.aggregate(triplets, F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.when(a["last"] == x, F.struct(x.alias("last"), (a["run"] + 1).alias("run"), (a["sum"] + a["run"] + 1).alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(0).cast("long").alias("run"), a["sum"].alias("sum"))))
    return F.when(F.length(s) > 3, pairs["sum"] / (F.length(s) - 3)).otherwise(0.0)


def strand_odds_ratio(ref_fwd: Column, ref_rev: Column, alt_fwd: Column, alt_rev: Column) -> Column:
    """Symmetric odds ratio with a pseudocount of 1 in each cell."""
    a, b, c, d = (x + 1.0 for x in (ref_fwd, ref_rev, alt_fwd, alt_rev))
    r = (a * d) / (b * c)
    return F.log(r + 1 / r) + F.log(F.least(a, b) / F.greatest(a, b)) - F.log(F.least(c, d) / F.greatest(c, d))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table: the sum of the probabilities that are no greater than the observed one's.

    Weights follow from one another, so the work grows with the range of the first cell.
    """
    row, col, n = (x.cast("long") for x in (a + b, a + c, a + b + c + d))
    low, high = F.greatest(F.lit(0).cast("long"), col - (n - row)), F.least(row, col)
    following = lambda lw, x: F.when(x < high, lw + F.log((row - x) * (col - x) / ((x + 1.0) * (n - row - col + x + 1)))).otherwise(0.0)
    own = F.aggregate(F.when(a > low, F.sequence(low, a.cast("long") - 1)).otherwise(F.array().cast("array<long>")), F.lit(0.0), following)

    def add(s: Column, x: Column) -> Column:
        w = F.exp(s["lw"] - F.greatest(s["top"], s["lw"]))
        scale = F.exp(s["top"] - F.greatest(s["top"], s["lw"]))
        part = F.when(s["lw"] <= s["own"] + 1e-7, w).otherwise(0.0)
        return F.struct(following(s["lw"], x).alias("lw"), F.greatest(s["top"], s["lw"]).alias("top"), (s["all"] * scale + w).alias("all"), (s["part"] * scale + part).alias("part"), s["own"].alias("own"))

    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("lw", "top", "all", "part")], own.alias("own"))
    return F.least(F.lit(1.0), F.aggregate(F.sequence(low, high), zero, add, lambda s: s["part"] / s["all"]))


#: Tables of more than twice so many reads are scaled down to so many; least p that is told apart.
TABLE_SIZE, LEAST_P = 200, 1e-320


def fisher_strand(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Phred value of the two-sided p; a large table is scaled down first, cells rounded down."""
    total = a + b + c + d
    scale = F.when(total > 2 * TABLE_SIZE, total / TABLE_SIZE).otherwise(1.0)
    p = fisher_two_sided(*[F.floor(x / scale) for x in (a, b, c, d)])
    return F.abs(-10 * F.log10(F.greatest(p, F.lit(LEAST_P))))


def inbreeding(hom_ref: Column, het: Column, hom_alt: Column, least: int = 10) -> Column:
    """1 - observed over expected heterozygotes; null below ``least`` samples. Counts should be of founders only."""
    n = hom_ref + het + hom_alt
    p = (2 * hom_ref + het) / (2 * n)
    return F.when(n >= least, 1 - het / F.nullif(2 * p * (1 - p) * n, F.lit(0.0)))


#: Residues of codons in the order T, C, A, G of each base, * for a stop; IUPAC codes and the bases that they stand for.
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def amino_acids(bases: Column) -> Column:
    """Residues of whole codons; X where a codon has other letters than A, C, G, T (or U)."""
    digits = F.translate(F.translate(F.upper(bases), "U", "T"), "TCAG", "0123")
    codons = F.regexp_extract_all(digits, F.lit("(?s)..."), F.lit(0))
    place = lambda c: F.conv(c, 4, 10).cast("int")
    return F.array_join(F.transform(codons, lambda c: F.when(c.rlike("^[0-3]{3}$"), F.substring(F.lit(RESIDUES), place(c) + 1, F.lit(1))).otherwise("X")), "")


def iupac_bases(code: Column) -> Column:
    """Bases that a nucleotide code stands for; null for other letters."""
    known = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    return F.try_element_at(known, F.upper(code))


def log10_multinomial(counts: Column) -> Column:
    """log10 of the number of orders of items of these counts."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return log10_factorial(total) - F.aggregate(F.transform(counts, log10_factorial), F.lit(0.0), lambda a, x: a + x)


def log10_dirichlet_multinomial(counts: Column, weights: Column) -> Column:
    """log10 probability of counts under a Dirichlet-multinomial with whole weights, by products of rising factors."""
    rising = lambda w, n: F.when(n > 0, log10_factorial(w + n - 1) - log10_factorial(w - 1)).otherwise(0.0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = F.aggregate(F.zip_with(weights, counts, rising), F.lit(0.0), lambda a, x: a + x)
    return log10_multinomial(counts) + parts - rising(total(weights), total(counts))


def log10_gaussian(x: Column, mean: float, sd: float) -> Column:
    return (-((x - mean) * (x - mean)) / (2 * sd * sd) - math.log(sd * math.sqrt(2 * math.pi))) / LN10


def cumulative(xs: Column) -> Column:
    """Running sums of an array."""
    return F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x))


def plus(a: Column, b: Column) -> Column:
    """Sums of two arrays, element by element."""
    return F.zip_with(a, b, lambda x, y: x + y)


def percent(part: Column, whole: Column) -> Column:
    """A share as text with two decimals, rounded as C's printf does: by the exact value, ties to even (format_string rounds shortest decimals half up); NA without a whole."""
    return F.when(whole > 0, F.concat(F.call_function("format_number", (100 * part / whole).cast("double"), F.lit("0.00")), F.lit("%"))).otherwise("NA")
