"""Blocks of consecutive sites: reference blocks by quality band, their merge over samples, and rows per locus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe
from .aggregates import exact_median
from .intervals import _edges, _steps, overlap_join
from .ordered import beside, ranged, running


def band_of(quality: Column, edges: list[int]) -> Column:
    """Number of the band [edge, next edge) that a quality lies in; qualities below the first edge are in band 0."""
    out = F.lit(0)
    for i, e in enumerate(edges):
        out = F.when(quality >= e, i + 1).otherwise(out)
    return out


def reference_blocks(df: DataFrame, contig: str, at: str, quality: str, depth: str, edges: list[int], cap: int = 99, is_variant: Column | None = None) -> DataFrame:
    """Blocks of neighbouring reference sites whose capped quality is in one band: start, end, band, n, least, median and greatest depth, least quality.

    A gap, a change of band, and a variant site end a block; variants are no
    part of one.  (contig, at) must be unique.
    """
    variant = F.coalesce(is_variant, F.lit(False)) if is_variant is not None else F.lit(False)
    rows = df.withColumns({"band": band_of(F.least(F.col(quality), F.lit(cap)), edges), "variant": variant})
    rows = beside(ranged(rows, [contig], [at]), [contig], [at], F.struct(F.col(at).alias("at"), "band", "variant"), "last", after=False)
    goes_on = (F.col("last.at") == F.col(at) - 1) & (F.col("last.band") == F.col("band")) & ~F.col("last.variant")
    rows = running(rows, [contig], [at], F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1), "sum", "block").filter("not variant")
    out = rows.groupBy(contig, "block", "band").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.min(depth).alias("min_depth"), F.max(depth).alias("max_depth"), F.min(quality).alias("min_quality"))
    middle = exact_median(rows, [contig, "block"], depth, "median_depth")
    return null_safe(out, middle, [contig, "block"]).drop("block")


def combined_blocks(df: DataFrame, contig: str, start: str, end: str, sample: str, value: str, every: int = 0, width: int = 1000) -> DataFrame:
    """Segments that are cut wherever a sample's block starts or ends (and at multiples of ``every``): start, end, how many samples cover it, and their least value."""
    edges = _edges(df, contig, start, end, "step")
    if every:
        inner = df.filter(F.floor(F.col(start) / every) < F.floor(F.col(end) / every)).select(contig, F.explode(F.sequence(F.floor(F.col(start) / every) + 1, F.floor(F.col(end) / every))).alias("m"))
        edges = edges.unionByName(inner.select(contig, (F.col("m") * every).alias("at"), F.lit(0).alias("step")))
    cut = _steps(edges, contig, {"step": "n_samples"}).filter("n_samples > 0")
    segments = cut.select(F.col(contig).alias("c"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "n_samples")
    own = df.select(F.col(contig).alias("own_contig"), F.col(start).alias("own_start"), F.col(end).alias("own_end"), F.col(value).alias("own_value"))
    pairs = overlap_join(segments, own, ("c", "seg_start", "seg_end"), ("own_contig", "own_start", "own_end"), width)
    return pairs.groupBy("c", "seg_start", "seg_end").agg(F.first("n_samples").alias("n_samples"), F.min("own_value").alias("least")).withColumnsRenamed({"c": contig, "seg_start": "start", "seg_end": "end"})


def pileup(reads: DataFrame, key: str) -> DataFrame:
    """A row for each aligned base of a read: contig, at, the read's key, name, base, quality, strand.

    Reads without a CIGAR have none.  Bases in insertions and clips have no
    position; deleted and skipped reference bases have no row.
    """
    ops = F.col("cigar")
    moves = lambda letters: F.transform(ops, lambda x: F.when(x["op"].isin(*letters), x["len"]).otherwise(0))
    before = lambda xs, i: F.aggregate(F.slice(xs, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    read_moves, ref_moves = moves("MIS=X"), moves("MDN=X")
    matched = F.filter(F.transform(ops, lambda x, i: F.struct(x["op"].alias("op"), x["len"].alias("len"), before(read_moves, i).alias("in_read"), before(ref_moves, i).alias("in_ref"))), lambda x: x["op"].isin("M", "=", "X"))
    rows = reads.filter(F.col("contig").isNotNull()).select(F.col(key).alias("read"), "name", "sample", "contig", "start", "bases", "quals", "flags", "mapq", F.explode(matched).alias("x"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("x.len") - 1)).alias("i"))
    place = F.col("x.in_read") + F.col("i")
    return rows.select("contig", (F.col("start") + F.col("x.in_ref") + F.col("i")).alias("at"), "read", "name", "sample", place.alias("offset"), F.substring("bases", place + 1, F.lit(1)).alias("base"), F.get("quals", place).alias("quality"), "flags", "mapq")


def loci(elements: DataFrame, least_quality: int = 0) -> DataFrame:
    """Per locus: depth, and reads with each base of at least a quality."""
    good = F.coalesce(F.col("quality") >= least_quality, F.lit(least_quality <= 0))
    return elements.groupBy("contig", "at").agg(F.count("*").alias("depth"), *[F.count_if(good & (F.col("base") == b)).alias(b.lower()) for b in "ACGT"])


def all_loci(found: DataFrame, intervals: DataFrame, counts: list[str]) -> DataFrame:
    """Every locus of the intervals (contig, start, end; not overlapping), those without a row too, with counts of 0."""
    every = intervals.select("contig", F.explode(F.sequence("start", "end")).alias("at"))
    return null_safe(every, found, ["contig", "at"], "left").fillna(0, counts)


def resolved_fragments(elements: DataFrame) -> DataFrame:
    """Where both reads of a name cover a locus: none is left if their bases differ, else the one with the better quality (ties: the smaller read)."""
    rank = F.struct(F.col("quality"), (-F.col("read")).alias("tie"))
    key = ["contig", "at", "sample", "name"]
    best = elements.groupBy(*key).agg(F.max(rank).alias("best"), F.min("base").alias("low"), F.max("base").alias("high"))
    return null_safe(elements, best.filter("low = high"), key).filter((F.col("quality") == F.col("best.quality")) & (-F.col("read") == F.col("best.tie"))).drop("best", "low", "high")


def evidence_density(df: DataFrame, contig: str, start: str, end: str, key: str, least: int, width: int = 1000) -> DataFrame:
    """Rows that at least so many others overlap."""
    other = df.select(F.col(contig).alias("o_contig"), F.col(start).alias("o_start"), F.col(end).alias("o_end"))
    counted = overlap_join(df, other, (contig, start, end), ("o_contig", "o_start", "o_end"), width, "count", key)
    return counted.filter(F.col("n_overlaps") - 1 >= least).drop("n_overlaps")
