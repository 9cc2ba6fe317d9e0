"""Comparison, selection and union of callsets (rows with a key and alleles)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import if_small
from .intervals import overlap_join


def concordance(truth: DataFrame, evaluated: DataFrame, key: list[str], allele: str, filtered: str) -> DataFrame:
    """State of each key of two callsets with unique keys.

    A filtered evaluation row is settled before alleles are compared.
    """
    t = truth.select(*key, F.col(allele).alias("truth_allele"), F.lit(True).alias("in_truth"))
    e = evaluated.select(*key, F.col(allele).alias("eval_allele"), F.col(filtered).alias("is_filtered"), F.lit(True).alias("in_eval"))
    both = t.join(e, key, "full")
    state = (
        F.when(F.col("in_truth").isNull(), F.when(F.col("is_filtered"), "FTN").otherwise("FP"))
        .when(F.col("in_eval").isNull(), "FN")
        .when(F.col("is_filtered"), "FFN")
        .when(F.col("truth_allele").eqNullSafe(F.col("eval_allele")), "TP")
        .otherwise("FN")
    )
    return both.select(*key, state.alias("state"))


def concordance_summary(states: DataFrame, group: list[str]) -> DataFrame:
    n = {s: F.count_if(F.col("state") == s) for s in ("TP", "FP", "FN", "FFN")}
    missed = n["FN"] + n["FFN"]
    return states.groupBy(*group).agg(n["TP"].alias("true_positive"), n["FP"].alias("false_positive"), missed.alias("false_negative"), F.round(n["TP"] / F.nullif(n["TP"] + missed, F.lit(0)), 9).alias("sensitivity"), F.round(n["TP"] / F.nullif(n["TP"] + n["FP"], F.lit(0)), 9).alias("precision"))


def group_on_start(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows that start together, their values in order."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(value)).alias("values"))


def gather(parts: list[DataFrame], key: list[str], sums: list[str]) -> DataFrame:
    """Partial tables as one: equal keys are added up."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])


def molten(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """A row for each key and field."""
    return df.select(*key, F.expr(f"stack({len(values)}, " + ", ".join(f"'{v}', cast({v} as double)" for v in values) + ") as (field, value)"))


def select(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that meet all conditions; null doesn't."""
    return df.filter(reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions)))


def mates(df: DataFrame, name: str, order: str) -> DataFrame:
    """First and last row of each name, and how many there are (2: a pair)."""
    return df.groupBy(name).agg(F.min(order).alias("first"), F.max(order).alias("second"), F.count("*").alias("n"))


def side_input(df: DataFrame, track: DataFrame, on: tuple[str, str, str], track_on: tuple[str, str, str], key: str, before: int = 0, after: int = 0, width: int = 1000) -> DataFrame:
    """Rows with each of a track's intervals that overlap them, widened by windows before and after; a row without any appears once."""
    contig, start, end = on
    wide = df.select(key, F.col(contig).alias("side_contig"), (F.col(start) - before).alias("side_start"), (F.col(end) + after).alias("side_end"))
    found = overlap_join(wide, track, ("side_contig", "side_start", "side_end"), track_on, width).drop("side_contig", "side_start", "side_end")
    return df.join(found, key, "left")


def starting_at(df: DataFrame, track: DataFrame, on: tuple[str, str], track_on: tuple[str, str]) -> DataFrame:
    """Rows with a track's intervals that start where they do."""
    (c, s), (tc, ts) = on, track_on
    return df.join(if_small(track), (F.col(c) == F.col(tc)) & (F.col(s) == F.col(ts)))


def page(df: DataFrame, order: list[Column], n: int, skip: int, name: str) -> DataFrame:
    """n rows after the first ``skip`` of an order, numbered from 1: the top rows of each partition meet in one task, which holds n + skip of each."""
    top = df.orderBy(*order).limit(n + skip)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order))).filter(F.col(name) > skip)


def filter_analysis(df: DataFrame, filters: str, truth: Column) -> DataFrame:
    """For each filter, how many false (tn) and true (fn) rows it takes away, and how many only it does."""
    rows = df.select(F.explode(filters).alias("filter"), (F.size(filters) == 1).alias("alone"), F.coalesce(truth, F.lit(False)).alias("truth"))
    return rows.groupBy("filter").agg(F.count_if(~F.col("truth")).alias("tn"), F.count_if(F.col("truth")).alias("fn"), F.count_if(~F.col("truth") & F.col("alone")).alias("unique_tn"), F.count_if(F.col("truth") & F.col("alone")).alias("unique_fn"))


def kmer_antijoin(df: DataFrame, key: str, kmers: Column, bad: DataFrame, least: int) -> DataFrame:
    """Rows with fewer than ``least`` k-mers (repeats count) in a set. bad: kmer.

    A set that is small (a host's or a benchmark's k-mers, by the optimiser's
    estimate) is broadcast, so no row of df is shuffled to be looked up; else
    both sides meet by k-mer.  Hits are counted before they are shuffled.
    """
    hits = df.select(key, F.explode(kmers).alias("kmer")).join(if_small(bad.distinct()), "kmer", "left_semi").groupBy(key).agg(F.count("*").alias("hits"))
    return df.join(hits.filter(F.col("hits") >= least), key, "left_anti")
