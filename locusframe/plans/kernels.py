"""Queries of numeric kernels. SQL can't express them: tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copynumber as N
from ..operators import kernels as K
from .catalog import items, query, table
from .reads import reads as read_view


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("l_suppkey", "day").agg(F.count("*").cast("double").alias("v"))


@query()
def viterbi_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable path of a hidden Markov model along each supplier's daily counts."""
    return K.viterbi_segments(_series(spark, sf_dir), "l_suppkey", "day", "v", [1.0, 2.0, 4.0], 1.0, 0.9)


@query()
def state_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of each state along these series."""
    return K.state_posteriors(_series(spark, sf_dir), "l_suppkey", "day", "v", [1.0, 2.0, 4.0], 1.0, 0.9)


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read with a haplotype that holds it, changed in places and with other bases around it."""
    r = read_view(spark, sf_dir).filter("length(bases) = size(quals) and length(bases) > 0")
    other = F.translate(F.md5(F.col("k").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    changed = F.when(F.col("k") % 4 == 0, F.concat(F.left("bases", F.lit(9)), F.substr("bases", F.lit(12)))).when(F.col("k") % 4 == 1, F.concat(F.left("bases", F.lit(9)), F.lit("TT"), F.substr("bases", F.lit(10)))).when(F.col("k") % 4 == 2, F.translate("bases", "A", "G")).otherwise(F.col("bases"))
    return r.select("k", "bases", "quals", F.concat(F.left(other, F.lit(12)), changed, F.right(other, F.lit(12))).alias("haplotype"))


@query()
def pair_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of reads given haplotypes."""
    return K.likelihoods(haplotypes(spark, sf_dir), ["k"], "bases", "quals", "haplotype").withColumn("log10", F.round("log10", 6))


@query()
def local_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, offset and CIGAR of each read against a haplotype."""
    return K.align(haplotypes(spark, sf_dir), "haplotype", "bases", "k")


@query()
def allele_count_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable allele count and quality of each site of three samples."""
    k = F.col("o_orderkey")
    pl = lambda j: F.array(*[(-(F.abs((k + 3 * j) % 3 - g) * ((k + j) % 40)) / 10).cast("double") for g in range(3)])
    o = table(spark, sf_dir, "orders").select(k.alias("k"), F.array(*[pl(j) for j in range(3)]).alias("gl"))
    return K.allele_counts(o, "k", "gl").withColumn("qual", F.round("qual", 4))


@query()
def denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy ratios of odd line numbers less their projection on the first two directions of the even ones."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("s"), F.col("l_partkey").alias("i")).agg(F.sum("l_quantity").alias("v"))
    ratios = N.standardised(c, "s", "i", "v")
    return N.denoised(ratios.filter("s % 2 = 1"), "s", "i", "copy_ratio", ratios.filter("s % 2 = 0"), 2).withColumn("denoised", F.round("denoised", 6))


@query()
def quantised_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.quantised(read_view(spark, sf_dir).select(F.explode("quals").alias("q")), "q", 5)


@query()
def mixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more a line item resembles the returned ones than the others."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (F.col("l_returnflag") == "R").alias("good"))
    return K.mixture_scores(d, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"], "good").withColumn("lod", F.round("lod", 3))
