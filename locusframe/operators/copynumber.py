"""Read counts of samples over intervals, as a long table (sample, interval, value): corrections, panels, calls.

Medians come from counts by value, so no sample or interval is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe
from .aggregates import exact_median

#: Bins of GC content, how fast their influence on each other falls, least copy ratio.
GC_BINS, DECAY, EPSILON = 101, 0.2, 1e-30


def gc_corrected(df: DataFrame, sample: str, value: str, gc_bin: str, decay: float = DECAY, bins: int = GC_BINS) -> DataFrame:
    """Values divided by what their GC bin is expected to have, each sample's total unchanged.

    A bin's expectation is the mean of all bins' medians, weighted by how many
    intervals they have and how near they are. gc_bin: 0 to bins - 1.
    """
    medians = exact_median(df, [sample, gc_bin], value).join(df.groupBy(sample, gc_bin).agg(F.count("*").alias("c")), [sample, gc_bin])
    near = medians.select(sample, F.col(gc_bin).alias("other"), "median", "c").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))  # bins x bins rows for each sample
    weight = F.col("c") * F.exp(-decay * F.abs(F.col("bin") - F.col("other")))
    factors = near.groupBy(sample, "bin").agg((F.sum(weight) / F.nullif(F.sum(weight * F.col("median")), F.lit(0.0))).alias("factor"))
    scaled = df.join(factors.withColumnRenamed("bin", gc_bin), [sample, gc_bin]).withColumn("scaled", F.col(value) * F.coalesce("factor", F.lit(1.0)))
    totals = scaled.groupBy(sample).agg((F.sum(value) / F.nullif(F.sum("scaled"), F.lit(0.0))).alias("back"))
    return scaled.join(totals, sample).withColumn("corrected", F.col("scaled") * F.coalesce("back", F.lit(1.0))).drop("factor", "scaled", "back")


def standardised(df: DataFrame, sample: str, interval: str, value: str, panel: DataFrame | None = None) -> DataFrame:
    """log2 copy ratios: share of the sample's total, by the panel's median of the interval (if given), by the sample's median, log2, less the sample's median."""
    total = df.groupBy(sample).agg(F.sum(value).alias("total"))
    share = df.join(total, sample).withColumn("share", F.col(value) / F.nullif(F.col("total"), F.lit(0.0)))
    if panel is not None:
        share = share.join(panel, interval).withColumn("share", F.col("share") / F.col("panel_median"))
    first = share.join(exact_median(share, [sample], "share", "middle"), sample)
    ratio = F.col("share") / F.nullif(F.col("middle"), F.lit(0.0))
    logs = first.withColumn("log2", F.log2(F.when(ratio < EPSILON, EPSILON).otherwise(ratio)))
    second = logs.join(exact_median(logs, [sample], "log2", "centre"), sample)
    return second.select(sample, interval, (F.col("log2") - F.col("centre")).alias("copy_ratio"))


def panel(df: DataFrame, sample: str, interval: str, value: str, least_percentile: float = 10.0, zero_intervals: float = 5.0, zero_samples: float = 5.0) -> DataFrame:
    """A panel of normals: sample, interval, value (share over the interval's median), in this order of steps:

    intervals whose median share is in the lowest per cents go; samples, then
    intervals, with more zeros than a share of the intervals (samples) go;
    zeros that are left get the interval's median of the others.
    """
    total = df.groupBy(sample).agg(F.sum(value).alias("total"))
    share = df.join(total, sample).select(sample, interval, (F.col(value) / F.col("total")).alias("share"))
    medians = exact_median(share, [interval], "share")
    from pyspark.sql import Window

    ranked = medians.groupBy("median").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("median").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each different median
    n = medians.agg(F.count("*").alias("n"))
    limit = ranked.crossJoin(F.broadcast(n)).filter(F.coalesce("upto", F.lit(0)) < F.ceil(F.col("n") * least_percentile / 100)).agg(F.max("median").alias("limit"))
    kept = medians.crossJoin(F.broadcast(limit)).filter((F.col("median") > F.coalesce("limit", F.lit(-1.0))) & (F.col("median") > 0)).select(interval, F.col("median").alias("interval_median"))
    rows = share.join(kept, interval)

    def without_zeros(rows: DataFrame, by: str, percent: float) -> DataFrame:
        counts = rows.groupBy(by).agg(F.count_if(F.col("share") == 0).alias("zeros"), F.count("*").alias("all"))
        return rows.join(counts.filter(F.col("zeros") <= F.ceil(F.col("all") * percent / 100)).select(by), by, "left_semi")

    rows = without_zeros(without_zeros(rows, sample, zero_samples), interval, zero_intervals)
    scaled = rows.withColumn("value", F.col("share") / F.col("interval_median"))
    others = exact_median(scaled.filter("value > 0"), [interval], "value", "filler")
    return scaled.join(others, interval, "left").select(sample, interval, F.when(F.col("value") > 0, F.col("value")).otherwise(F.coalesce("filler", F.lit(1.0))).alias("value"))


def called_segments(df: DataFrame, size: str, log2_mean: str, low: float = 0.9, high: float = 1.1, z: float = 2.0) -> DataFrame:
    """Segments with a call: +, - or 0.

    Neutral ones have a copy ratio within [low, high]; of their length-weighted
    log2 means the centre and deviation are taken, again without outliers of
    more than z deviations, and other segments are called by the same measure.
    """
    ratio = F.pow(F.lit(2.0), F.col(log2_mean))
    neutral = df.filter(ratio.between(low, high))
    w, x = F.col(size), F.col(log2_mean)

    def moments(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
        mean = F.sum(w * x) / F.sum(w)
        variance = (F.sum(w * x * x) / F.sum(w) - mean * mean) * F.count("*") / F.nullif(F.count("*") - 1, F.lit(0))
        return rows.agg(mean.alias(names[0]), F.sqrt(F.greatest(variance, F.lit(0.0))).alias(names[1]))  # one row

    first = moments(neutral, ("m1", "s1"))
    inner = neutral.crossJoin(F.broadcast(first)).filter(F.abs(x - F.col("m1")) <= z * F.coalesce("s1", F.lit(0.0)))
    second = moments(inner, ("mean", "sd"))
    call = F.when(ratio.between(low, high), "0").when(x > F.col("mean") + z * F.col("sd"), "+").when(x < F.col("mean") - z * F.col("sd"), "-").otherwise("0")
    return df.crossJoin(F.broadcast(second)).withColumn("call", F.coalesce(call, F.lit("0"))).drop("mean", "sd")


def quantised_levels(histogram: pd.DataFrame, levels: int, least: int = 6) -> pd.DataFrame:
    """quality, quantised: neighbouring qualities merged until ``levels`` groups are left, the pair with the least penalty first (ties: the lowest).

    histogram: quality and n, at most some 94 rows.  A group's quality is that
    of its mean error rate; its penalty is the sum over its qualities above
    ``least`` of n times the difference of log10 error rates.
    """
    rows = histogram.sort_values("quality")
    groups = [([int(q)], int(n), n * 10 ** (-q / 10)) for q, n in zip(rows["quality"], rows["n"], strict=True)]
    counts = dict(zip(rows["quality"].astype(int), rows["n"], strict=True))

    def quality(g: tuple) -> float:
        return -10 * np.log10(g[2] / g[1]) if g[1] and g[2] > 0 else float(np.mean(g[0]))

    def penalty(g: tuple) -> float:
        q = quality(g)
        return sum(counts[x] * abs(x / 10 - q / 10) for x in g[0] if x > least)

    while len(groups) > levels:
        joint = [(a[0] + b[0], a[1] + b[1], a[2] + b[2]) for a, b in zip(groups, groups[1:], strict=False)]
        i = int(np.argmin([penalty(g) for g in joint]))
        groups[i : i + 2] = [joint[i]]
    return pd.DataFrame([(q, int(round(quality(g)))) for g in groups for q in g[0]], columns=["quality", "quantised"])


def quantised(df: DataFrame, quality: str, levels: int) -> DataFrame:
    """The quantised value of each quality that occurs: counts by quality (at most some 94 rows) are solved in one task."""
    counts = df.groupBy(F.col(quality).cast("long").alias("quality")).agg(F.count("*").alias("n"))
    return counts.groupBy(F.lit(0).alias("all")).applyInPandas(lambda h: quantised_levels(h, levels), "quality long, quantised long")


def tagged_germline(df: DataFrame, contig: str, start: str, end: str, call: str, germline: str, padding: int) -> DataFrame:
    """Segments whose two ends lie within ``padding`` of a germline event of the same contig; ``germline`` is its call, if it has one.

    A segment is tagged by an event (a segment of the germline table with a
    call other than 0) with the same contig, found by its start's cell.
    """
    events = df.filter((F.col(germline).isNotNull()) & (F.col(germline) != "0")).select(F.col(contig).alias("e_contig"), F.col(start).alias("e_start"), F.col(end).alias("e_end"), F.col(germline).alias("tag"))
    width = max(2 * padding, 1)
    cells = events.withColumn("cell", F.explode(F.sequence(F.floor((F.col("e_start") - padding) / width), F.floor((F.col("e_start") + padding) / width))))
    some = df.withColumn("own_cell", F.floor(F.col(start) / width))
    near = (F.col(contig) == F.col("e_contig")) & (F.col("own_cell") == F.col("cell")) & (F.abs(F.col(start) - F.col("e_start")) <= padding) & (F.abs(F.col(end) - F.col("e_end")) <= padding)
    hits = some.join(cells, near).groupBy(contig, start, end).agg(F.min("tag").alias("tag"))
    return null_safe(df, hits, [contig, start, end], "left").withColumn("tag", F.coalesce("tag", F.lit("0")))


def mixing_fractions(df: DataFrame, sample: str, ref: str, alt: str) -> DataFrame:
    """Each sample's share of a mixture, from reads at sites where it alone is heterozygous: twice its mean alternate share, made to add up to 1."""
    each = df.groupBy(sample).agg((2 * F.sum(alt) / F.nullif(F.sum(F.col(alt) + F.col(ref)), F.lit(0))).alias("raw"))
    total = each.agg(F.sum("raw").alias("all"))  # one row
    return each.crossJoin(F.broadcast(total)).select(sample, (F.col("raw") / F.nullif(F.col("all"), F.lit(0.0))).alias("fraction"))


def denoised(df: DataFrame, sample: str, interval: str, value: str, normals: DataFrame, rank: int) -> DataFrame:
    """Values less their projection on the panel's first ``rank`` directions over intervals.

    The panel (few samples, many intervals) gives its directions from the
    samples' products with each other, a table of samples x samples: only that
    is solved on the driver, whatever the number of intervals.
    """
    spark = df.sparkSession
    n = normals.select(F.col(sample).alias("s"), F.col(interval).alias("i"), F.col(value).cast("double").alias("v"))
    other = n.select(F.col("s").alias("t"), "i", F.col("v").alias("u"))
    products = n.join(other, "i").groupBy("s", "t").agg(F.sum(F.col("v") * F.col("u")).alias("p")).toPandas()
    names = sorted(products["s"].unique().tolist())
    gram = products.pivot(index="s", columns="t", values="p").reindex(index=names, columns=names).fillna(0.0).to_numpy()
    sizes, vectors = np.linalg.eigh(gram)
    order = np.argsort(-sizes)[:rank]
    weights = [(x, int(k), float(vectors[j, c] / np.sqrt(sizes[c]))) for k, c in enumerate(order.tolist()) if sizes[c] > 1e-12 for j, x in enumerate(names)]
    kind = dict(normals.dtypes)[sample]
    if not weights:
        return df.select(sample, interval, F.col(value).cast("double").alias("denoised"))
    w = spark.createDataFrame(weights, f"s {kind}, k int, w double")
    directions = n.join(F.broadcast(w), "s").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("d"))  # rank rows for each interval
    own = df.select(sample, F.col(interval).alias("i"), F.col(value).cast("double").alias("x"))
    loads = own.join(directions, "i").groupBy(sample, "k").agg(F.sum(F.col("x") * F.col("d")).alias("load"))
    fitted = directions.join(loads, "k").groupBy(sample, "i").agg(F.sum(F.col("d") * F.col("load")).alias("fit"))
    out = own.join(fitted, [sample, "i"], "left")
    return out.select(sample, F.col("i").alias(interval), (F.col("x") - F.coalesce("fit", F.lit(0.0))).alias("denoised"))


def called_ploidy(counts: DataFrame, sample: str, contig: str, value: str, size: str, expected: int = 2) -> DataFrame:
    """Whole ploidy of each contig of a sample: its depth over the sample's median depth by contig, times the expected ploidy."""
    depth = counts.groupBy(sample, contig).agg((F.sum(value) / F.sum(size)).alias("depth"))
    middle = exact_median(depth, [sample], "depth", "middle")
    return depth.join(middle, sample).select(sample, contig, F.floor(expected * F.col("depth") / F.nullif(F.col("middle"), F.lit(0.0)) + 0.5).cast("long").alias("ploidy"))


def gc_bin(share: Column, bins: int = GC_BINS) -> Column:
    return F.floor(share * (bins - 1) + 0.5).cast("int")
