"""Transforms of reads, row by row, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_low_quality(bases: Column, quals: Column, least: int) -> Column:
    """Bases whose quality is below the threshold become N."""
    letters = F.transform(F.sequence(F.lit(1), F.length(bases)), lambda i: F.when(F.get(quals, i - 1) < least, F.lit("N")).otherwise(F.substring(bases, i, F.lit(1))))
    return F.when(F.length(bases) > 0, F.array_join(letters, "")).otherwise(bases)


def cap_mapping_quality(mapq: Column) -> Column:
    return F.when(mapq == 255, 60).otherwise(mapq)


def shift_qualities(quals: Column, by: int = 31) -> Column:
    """Qualities of the old encoding; a negative result is an error."""
    return F.transform(quals, lambda q: F.when(q >= by, q - by).otherwise(F.raise_error(F.lit("quality below the offset"))))


def collapse_ndn(cigar: Column) -> Column:
    """N, D, N in a row become one N of their joint length; that N isn't merged again."""

    def add(a: Column, x: Column) -> Column:
        n = F.size(a)
        back = lambda i: F.get(a, n - i)
        triple = (x["op"] == "N") & (n >= 2) & (back(1)["op"] == "D") & (back(2)["op"] == "N") & ~back(2)["done"]
        new = lambda size, done: F.array(F.struct(size.alias("len"), x["op"].alias("op"), F.lit(done).alias("done")))
        joint = F.concat(F.slice(a, F.lit(1), F.greatest(n - 2, F.lit(0))), new(x["len"] + back(1)["len"] + back(2)["len"], True))
        return F.when(F.coalesce(triple, F.lit(False)), joint).otherwise(F.concat(a, new(x["len"], False)))

    merged = F.aggregate(cigar_ops(cigar), F.array().cast("array<struct<len:int,op:string,done:boolean>>"), add)
    return F.when(cigar.rlike(r"N\d+D\d+N"), F.array_join(F.transform(merged, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")).otherwise(cigar)


def strip_mate_number(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\s.*$", ""), r"/[12]$", "")


def clip_ends(quals: Column, threshold: int) -> Column:
    """Bounds (first, last, 1-based) after clipping the right end, then the left, each at the last place where the sum of (threshold - q) is greatest and not negative."""

    def best(xs: Column) -> Column:
        step = lambda a, q: F.transform(F.array(a["sum"] + threshold - q), lambda s: F.struct(s.alias("sum"), (a["n"] + 1).alias("n"), F.when(s >= a["top"], s).otherwise(a["top"]).alias("top"), F.when(s >= a["top"], a["n"] + 1).otherwise(a["cut"]).alias("cut")))[0]
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("top"), F.lit(0).alias("cut"))
        return F.aggregate(xs, zero, step)["cut"]

    right = best(F.reverse(quals))
    left = best(F.slice(quals, F.lit(1), F.greatest(F.size(quals) - right, F.lit(0))))
    return F.struct((left + 1).alias("first"), (F.size(quals) - right).alias("last"))


def mask_simple_repeats(bases: Column, window: int, least_at: int, least_gc: int) -> Column:
    """Bases in a window with enough A, T and N, or enough G, C and N, become N; a shorter text is one window."""
    kept = lambda part, letters: F.length(part) - F.length(F.translate(part, letters, ""))
    full = lambda i: F.substring(bases, i, F.lit(window))
    hit = lambda i: (kept(full(i), "ATNatn") >= least_at) | (kept(full(i), "GCNgcn") >= least_gc)
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.length(bases) - window + 1, F.lit(1))), hit)
    letters = lambda found: F.transform(F.sequence(F.lit(1), F.length(bases)), lambda i: F.when(F.exists(found, lambda s: (s <= i) & (i < s + window)), F.lit("N")).otherwise(F.substring(bases, i, F.lit(1))))
    return F.when(F.length(bases) > 0, F.transform(F.array(hits), lambda found: F.array_join(letters(found), ""))[0]).otherwise(bases)


def trim_adapter(bases: Column, adapters: list[str], most: int, least_length: int) -> Column:
    """Text before the place where an adapter starts, with the fewest differences (``most`` at most), the earliest of ties.

    The adapter may run past the end if ``least_length`` bases match; N in it matches all.
    """
    n = F.length(bases)

    def places(adapter: str) -> Column:
        differ = lambda s: sum((F.when((F.substring(bases, s + j, F.lit(1)) != c) & (s + j <= n), 1).otherwise(0) for j, c in enumerate(adapter) if c not in "Nn"), F.lit(0))
        return F.transform(F.sequence(F.lit(1), n - least_length + 1), lambda s: F.struct(differ(s).alias("differ"), s.alias("at")))

    best = F.array_min(F.filter(F.concat(*map(places, adapters)), lambda x: x["differ"] <= most))
    return F.when(n < least_length, bases).otherwise(F.coalesce(F.substring(bases, F.lit(1), best["at"] - 1), bases))


def cigar_ops(cigar: Column) -> Column:
    """Parse a CIGAR text into an array of (len, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_lengths(cigar: Column) -> Column:
    """(read, reference, clipped): bases of the read, of the reference, and clipped ones (soft and hard) that a CIGAR text covers."""
    total = lambda ops: F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin(list(ops))), F.lit(0), lambda a, x: a + x["len"])
    return F.struct(total("MIS=X").alias("read"), total("MDN=X").alias("reference"), total("SH").alias("clipped"))


def invert_cigar(cigar: Column) -> Column:
    """The elements in reverse order, as for the other strand."""
    return F.array_join(F.transform(F.reverse(cigar_ops(cigar)), lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def clip_to(bases: Column, quals: Column, first: Column, last: Column) -> Column:
    """(bases, quals) from the first to the last place, 1-based; empty if they cross."""
    n = F.greatest(last - first + 1, F.lit(0))
    return F.struct(F.substring(bases, first, n).alias("bases"), F.slice(quals, first, n).alias("quals"))
