"""Duplicate marking of aligned reads: by both ends of a pair, or by the end of a fragment.

Winners come from aggregates, so the reads of one place, however many, are no
single task's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe
from .filters import flag
from .transforms import strip_mate_number

#: Bases of lower quality add nothing to a read's score.
LEAST_QUALITY = 15


def clipped_at(cigar: Column) -> Column:
    """Clipped bases (soft and hard) before the first other operation."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"))
    clip = lambda x: x["op"].isin("S", "H")
    return F.aggregate(cigar, zero, lambda a, x: F.struct((a["n"] + F.when(~a["done"] & clip(x), x["len"]).otherwise(0)).alias("n"), (a["done"] | ~clip(x)).alias("done")))["n"]


def five_prime() -> Column:
    """Where the read's first sequenced base would lie if nothing were clipped."""
    return F.when(flag(0x10), F.col("end") + clipped_at(F.reverse("cigar"))).otherwise(F.col("start") - clipped_at(F.col("cigar")))


def score() -> Column:
    return F.aggregate(F.filter("quals", lambda q: q >= LEAST_QUALITY), F.lit(0).cast("long"), lambda a, q: a + q)


def eligible() -> Column:
    """Mapped primary lines: only they can be duplicates."""
    return ~flag(4) & ~flag(0x100) & ~flag(0x800)


def mark_duplicates(reads: DataFrame, key: str) -> DataFrame:
    """reads with ``duplicate``. key: a column that tells reads apart.

    Pairs of a library with the same two ends (contig, unclipped 5' place,
    strand) are copies: the one with the greatest sum of scores stays, of ties
    the one with the smallest key.  A read without an eligible mate is a copy
    if a pair has the same end, else if a better fragment has.  Reads without a
    library are a library.  Unmapped, secondary and supplementary reads never
    are duplicates.
    """
    place = F.struct("contig", five_prime().cast("long").alias("at"), flag(0x10).alias("reverse"))
    ends = reads.filter(eligible()).select("library", strip_mate_number(F.col("name")).alias("template"), F.col(key).alias("read"), score().alias("score"), place.alias("place"), (flag(1) & flag(0x40)).alias("is_first"), (flag(1) & flag(0x80)).alias("is_second"))
    own = F.struct("read", "score", "place")
    both = ends.groupBy("library", "template").agg(F.min(F.when(F.col("is_first"), own)).alias("a"), F.min(F.when(F.col("is_second"), own)).alias("b"))
    pairs = both.filter("a is not null and b is not null").select("library", F.least("a.place", "b.place").alias("x"), F.greatest("a.place", "b.place").alias("y"), (F.col("a.score") + F.col("b.score")).alias("score"), F.least("a.read", "b.read").alias("tie"), F.array("a.read", "b.read").alias("reads"))
    rank = F.struct("score", (-F.col("tie")).alias("tie"))
    best = pairs.groupBy("library", "x", "y").agg(F.max(rank).alias("best"))
    worse = null_safe(pairs, best, ["library", "x", "y"]).filter(rank != F.col("best")).select(F.explode("reads").alias("read"))
    taken = pairs.select("library", F.explode(F.array("x", "y")).alias("place")).distinct()
    fragments = ends.join(pairs.select(F.explode("reads").alias("read")), "read", "left_anti")
    fragment_rank = F.struct("score", (-F.col("read")).alias("tie"))
    best_fragment = fragments.groupBy("library", "place").agg(F.max(fragment_rank).alias("best"))
    beaten = null_safe(null_safe(fragments, best_fragment, ["library", "place"]), taken.withColumn("by_pair", F.lit(True)), ["library", "place"], "left")
    beaten = beaten.filter(F.col("by_pair").isNotNull() | (fragment_rank != F.col("best"))).select("read")
    marked = worse.unionByName(beaten).select(F.col("read").alias(key), F.lit(True).alias("duplicate"))
    return reads.join(marked, key, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def duplication_metrics(marked: DataFrame) -> DataFrame:
    """Counts by library, and the share of duplicates among eligible reads."""
    ok, paired = eligible(), flag(1) & ~flag(8)
    out = marked.groupBy("library").agg(F.count_if(ok & paired).alias("paired_examined"), F.count_if(ok & ~paired).alias("unpaired_examined"), F.count_if(flag(4)).alias("unmapped"), F.count_if(flag(0x100) | flag(0x800)).alias("secondary_or_supplementary"), F.count_if(F.col("duplicate")).alias("duplicates"))
    return out.withColumn("share", F.round(F.col("duplicates") / F.greatest(F.col("paired_examined") + F.col("unpaired_examined"), F.lit(1)), 9))


def unmarked(reads: DataFrame) -> DataFrame:
    """Reads without the duplicate flag."""
    return reads.withColumn("flags", F.col("flags").bitwiseAND(F.lit(~0x400)))


def compare_duplicates(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how two markings of the same reads agree."""
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    both = left.select(key, F.col("duplicate").alias("a")).join(right.select(key, F.col("duplicate").alias("b")), key, "full")
    return both.agg(F.count_if(a & b & F.col("a") & F.col("b")).alias("both"), F.count_if(a & b & F.col("a") & ~F.col("b")).alias("only_left"), F.count_if(a & b & ~F.col("a") & F.col("b")).alias("only_right"), F.count_if(a & b & ~F.col("a") & ~F.col("b")).alias("neither"), F.count_if(a != b).alias("unmatched"))
