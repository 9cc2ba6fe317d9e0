"""Statistics of sites and genotypes: recalibrated qualities, likelihoods, allele counts, annotations.

Column functions run in the JVM; tables are aggregated by their keys with
partial sums before each shuffle.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe
from ..functions.scalars import error_probability, half_up
from .aggregates import exact_median, rank_sum

#: Peak and spread of the prior on a shift of quality; greatest quality on the grid and of a result.
PRIOR_PEAK, PRIOR_SD, GRID, MOST = 0.9, 0.5, 60, 93
#: The prior underflows from this shift on; such bins count as impossible.
FAR, IMPOSSIBLE = 20, -1e300


def log10_prior(shift: Column) -> Column:
    return F.when(shift >= FAR, IMPOSSIBLE).otherwise(math.log10(PRIOR_PEAK) - shift * shift * (math.log10(math.e) / (2 * PRIOR_SD**2)))


def empirical_quality(errors: Column, n: Column, reported: Column) -> Column:
    """Most probable quality, 0 to 60, of n observations with some errors, near the reported one; the lower of ties."""
    k, m = F.floor(errors + 0.5) + 1, n + 2

    def posterior(q: Column) -> Column:
        shift = F.abs((q - reported).cast("int"))
        fit = F.when(q == 0, IMPOSSIBLE).otherwise(-q / 10 * k + (m - k) * F.log10(1 - error_probability(q)))
        return log10_prior(shift) + fit

    grid = F.transform(F.sequence(F.lit(0), F.lit(GRID)), posterior)
    return F.transform(F.array(grid), lambda a: F.array_position(a, F.array_max(a)) - 1)[0].cast("double")


def recalibrated(df: DataFrame, group: str, reported: str, covariates: list[str], error: Column) -> DataFrame:
    """New quality for each combination of read group, reported quality and covariates.

    The rows are counted once by all keys; coarser tables are folded from that
    small table.  A quality shifts by group, then by reported quality, then by
    each covariate, each estimated with the shifts before it as its prior.
    Null is a value of its own for each key.
    """
    keys = [group, reported]
    sums = lambda by, rows: rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    counts = df.groupBy(*keys, *covariates).agg(F.count("*").alias("n"), F.sum(error.cast("long")).alias("errors"))
    expected = F.sum(F.col("n") * error_probability(F.col(reported)))
    by_group = counts.groupBy(group).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), (-10 * F.log10(expected / F.sum("n"))).alias("base"))
    by_group = by_group.select(group, empirical_quality(F.col("errors"), F.col("n"), F.col("base")).alias("q1"))
    by_quality = null_safe(sums(keys, counts), by_group, [group]).select(*keys, empirical_quality(F.col("errors"), F.col("n"), F.col("q1")).alias("q2"))
    out, shift = null_safe(counts, by_quality, keys), F.lit(0.0)
    for i, c in enumerate(covariates):
        own = null_safe(sums([*keys, c], counts), by_quality, keys)
        out = null_safe(out, own.select(*keys, c, (empirical_quality(F.col("errors"), F.col("n"), F.col("q2")) - F.col("q2")).alias(f"shift{i}")), [*keys, c])
        shift = shift + F.col(f"shift{i}")
    quality = F.greatest(F.lit(1), F.least(F.lit(MOST), half_up(F.col("q2") + shift)))
    return out.select(*keys, *covariates, "n", "errors", quality.cast("long").alias("recalibrated"))


def apply_recalibration(df: DataFrame, recal: DataFrame, keys: list[str], reported: str) -> DataFrame:
    """Rows with their new quality; one whose keys were never counted keeps the reported one."""
    return null_safe(df, recal.select(*keys, "recalibrated"), keys, "left").withColumn("recalibrated", F.coalesce("recalibrated", F.col(reported).cast("long")))


def diploid_likelihoods(df: DataFrame, keys: list[str], alt: Column, quality: Column) -> DataFrame:
    """Phred likelihoods of the genotypes ref/ref, ref/alt, alt/alt (least 0), genotype (alt alleles) and its quality (99 at most)."""
    e = F.least(F.lit(1 - 1e-15), F.greatest(error_probability(quality), F.lit(1e-300)))
    wrong, right = F.log10(e), F.log10(1 - e)
    sums = df.groupBy(*keys).agg(F.count("*").alias("depth"), F.sum(F.when(alt, wrong).otherwise(right)).alias("l0"), F.sum(F.when(alt, right).otherwise(wrong)).alias("l2"))
    each = [F.col("l0"), F.col("depth") * math.log10(0.5), F.col("l2")]
    out = sums.select(*keys, "depth", F.transform(F.array(*each), lambda x: half_up(-10 * (x - F.greatest(*each)))).alias("pl"))
    return out.select(*keys, "depth", *[F.get("pl", F.lit(i)).alias(f"pl{i}") for i in range(3)], (F.array_position("pl", F.array_min("pl")) - 1).alias("genotype"), F.least(F.lit(99).cast("long"), F.get(F.array_sort("pl"), F.lit(1))).alias("gq"))


def excess_het(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    """Phred p of as many heterozygotes or more under Hardy-Weinberg, half of the observed count's own probability counted.

    Online log-sum over the possible counts, in steps of two. With one rare
    copy or none p is 0.5; 160 stands for p below 1e-59.
    """
    n = hom_ref + het + hom_alt
    rare = F.least(2 * hom_ref + het, 2 * hom_alt + het)

    def step(a: Column, h: Column) -> Column:
        top = F.greatest(a["top"], a["lw"])
        w = F.exp(a["lw"] - top)
        scale = F.exp(a["top"] - top)
        tail = F.when(h > het, w).when(h == het, w / 2).otherwise(0.0)
        r = (rare - h) / 2
        lw = F.when(h < rare, a["lw"] + F.log(4 * r * (n - h - r) / ((h + 2) * (h + 1)))).otherwise(0.0)
        return F.struct(lw.alias("lw"), top.alias("top"), (a["all"] * scale + w).alias("all"), (a["tail"] * scale + tail).alias("tail"))

    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("lw", "top", "all", "tail")])
    p = F.aggregate(F.sequence(F.pmod(rare, F.lit(2)), rare, F.lit(2).cast("long")), zero, step, lambda a: a["tail"] / a["all"])
    return F.when(rare <= 1, -10 * math.log10(0.5)).otherwise(F.transform(F.array(p), lambda x: F.when(x < 1e-59, 160.0).otherwise(F.abs(-10 * F.log10(x))))[0])


def allele_numbers(df: DataFrame, site: list[str], alleles: list[str]) -> DataFrame:
    """Per site and alternate allele (index over 0): its count, all called alleles, its share. A null or negative index is no call."""
    called = df.select(*site, F.explode(F.array(*alleles)).alias("allele")).filter("allele >= 0").groupBy(*site, "allele").agg(F.count("*").alias("ac"))
    every = called.groupBy(*site).agg(F.sum("ac").alias("an"))
    return called.filter("allele > 0").join(every, site).select(*site, "allele", "ac", "an", (F.col("ac") / F.col("an")).alias("af"))


def allele_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Medians by site and allele of qualities, positions or lengths, from counts by value. Null keys are keys."""
    out = exact_median(df, keys, values[0], f"median_{values[0]}")
    for v in values[1:]:
        out = null_safe(out, exact_median(df, keys, v, f"median_{v}"), keys)
    return out


def strand_counts(df: DataFrame, keys: list[str], alt: Column, reverse: Column, first: Column) -> DataFrame:
    """2 x 2 counts by strand, alt reads by orientation of the pair, and the share of the oxidation artefact."""
    f1r2 = first != reverse
    out = df.groupBy(*keys).agg(F.count_if(~alt & ~reverse).alias("ref_fwd"), F.count_if(~alt & reverse).alias("ref_rev"), F.count_if(alt & ~reverse).alias("alt_fwd"), F.count_if(alt & reverse).alias("alt_rev"), F.count_if(alt & f1r2).alias("alt_f1r2"), F.count_if(alt & ~f1r2).alias("alt_f2r1"))
    return out.withColumn("share", F.col("alt_f1r2") / F.nullif(F.col("alt_f1r2") + F.col("alt_f2r1"), F.lit(0)))


def unique_alt_reads(df: DataFrame, keys: list[str], alt: Column, start: str, length: str) -> DataFrame:
    """Distinct (start, fragment length) of the reads that support the alternate allele."""
    return df.filter(alt).select(*keys, start, length).distinct().groupBy(*keys).agg(F.count("*").alias("unique_alt"))


def de_novo(child_het: Column, parents_ref: Column, child_gq: Column, mother_gq: Column, father_gq: Column) -> Column:
    """hi or lo confidence in a variant that neither parent has, or null."""
    hi = F.least(child_gq, mother_gq, father_gq) >= 20
    lo = (child_gq >= 10) & (mother_gq > 0) & (father_gq > 0)
    return F.when(child_het & parents_ref, F.when(hi, "hi").when(lo, "lo"))


def repeat_unit(bases: Column) -> Column:
    """(unit, times): the shortest text that gives the whole when repeated."""
    n = F.length(bases)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (n % k == 0) & (F.repeat(F.substring(bases, F.lit(1), k), (n / k).cast("int")) == bases))
    return F.when(n > 0, F.transform(F.array(fits[0]), lambda k: F.struct(F.substring(bases, F.lit(1), k).alias("unit"), (n / k).cast("long").alias("times")))[0])


def rank_sum_annotation(df: DataFrame, keys: list[str], alt: Column, value: str, usable: Column) -> DataFrame:
    """Rank-sum z of a value of alternate reads against reference reads, of usable reads only, to three decimals; absent where it is undefined."""
    out = rank_sum(df.filter(usable), keys, alt, value)
    return out.select(*keys, "n1", "n2", F.round("z", 3).alias("z")).filter(F.col("z").isNotNull() & ~F.isnan("z"))


def sample_depths(df: DataFrame, site: list[str], sample: str, alt: Column, *more: Column) -> DataFrame:
    """Reads and alternate reads of each sample at each site."""
    return df.groupBy(*site, sample).agg(F.count("*").alias("depth"), F.count_if(alt).alias("alt_depth"), *more)


def mendelian_violations(mother: int, father: int, child: int) -> int:
    """The fewest alleles of a child's genotype that its parents can't have given it: 0, 1 or 2."""
    gives = {0: (0,), 1: (0, 1), 2: (1,)}
    return min(abs(child - (m + f)) for m in gives[mother] for f in gives[father])


def family_posteriors(df: DataFrame, mother: str, father: str, child: str, prior: float = 1e-6) -> DataFrame:
    """df with the posterior probabilities of the three genotypes of each member of a trio (columns with _posterior), from log10 likelihoods.

    They are weighed by how rarely a child has an allele that its parents lack.
    """
    weight = {0: 1 - 10 * prior - prior * prior, 1: prior, 2: prior * prior}
    linear = lambda x: F.transform(x, lambda y: F.pow(F.lit(10.0), y - F.array_max(x)))
    held = df.withColumns({f"linear_{i}": linear(F.col(x)) for i, x in enumerate((mother, father, child))})
    places = list(itertools.product(range(3), repeat=3))
    cells = [F.get("linear_0", F.lit(i)) * F.get("linear_1", F.lit(j)) * F.get("linear_2", F.lit(k)) * weight[mendelian_violations(i, j, k)] for i, j, k in places]
    held = held.withColumn("cells", F.array(*cells))
    total = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x)
    side = lambda axis: F.array(*[sum((F.get("cells", F.lit(n)) for n, p in enumerate(places) if p[axis] == g), F.lit(0.0)) / total for g in range(3)])
    return held.withColumns({f"{x}_posterior": side(i) for i, x in enumerate((mother, father, child))}).drop("cells", "linear_0", "linear_1", "linear_2")


def covariate_tables(elements: DataFrame, known: DataFrame, group: str, error: Column, least_quality: int = 6) -> DataFrame:
    """Observations and errors by group and quality, by context (a base and the one before it) too, and by cycle too.

    elements: of a pileup, with read_bases.  Bases at known places (contig, at),
    of low quality, or unknown don't count.  level: 3 for group and quality, 1
    with context, 2 with cycle.  Cycles of second reads are negative, and count
    from the read's own start.
    """
    used = elements.join(known.select("contig", "at").distinct(), ["contig", "at"], "left_anti").filter((F.col("quality") >= least_quality) & F.col("base").isin(*"ACGT"))
    n = F.length("read_bases")
    reverse = F.col("flags").bitwiseAND(0x10) != 0
    place = F.when(reverse, n - F.col("offset")).otherwise(F.col("offset") + 1)
    cycle = F.when(F.col("flags").bitwiseAND(0x80) != 0, -place).otherwise(place)
    before = F.when(F.col("offset") > 0, F.substring("read_bases", F.col("offset"), F.lit(1)))
    context = F.when(before.isin(*"ACGT"), F.concat(before, F.col("base")))
    rows = used.select(F.col(group).alias("g"), F.col("quality").alias("q"), context.alias("context"), cycle.cast("long").alias("cycle"), error.cast("long").alias("error"))
    sets = rows.groupingSets([[F.col("g"), F.col("q")], [F.col("g"), F.col("q"), F.col("context")], [F.col("g"), F.col("q"), F.col("cycle")]], "g", "q", "context", "cycle")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("error").alias("errors"))
