"""Tables of aligned reads as wholes: flag statistics, order, pairs, quality and fragment metrics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import spread
from .filters import flag


def flag_statistics(reads: DataFrame) -> DataFrame:
    """One row of counts. A paired read counts as second before it counts as first; all counts of mates are of paired reads."""
    paired, mapped, mate = flag(1), ~flag(4), ~flag(8)
    elsewhere = paired & mapped & mate & (F.col("contig") != F.col("mate_contig"))
    counts = {
        "qc_failure": flag(0x200),
        "duplicates": flag(0x400),
        "mapped": mapped,
        "paired_in_sequencing": paired,
        "read2": paired & flag(0x80),
        "read1": paired & ~flag(0x80) & flag(0x40),
        "properly_paired": paired & flag(2),
        "with_itself_and_mate_mapped": paired & mapped & mate,
        "singletons": paired & mapped & ~mate,
        "with_mate_mapped_to_a_different_contig": elsewhere,
        "with_mate_mapped_to_a_different_contig_mapq5": elsewhere & (F.col("mapq") >= 5),
    }
    return reads.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def with_contig_index(df: DataFrame, contigs: list[str], contig: str = "contig") -> DataFrame:
    """contig_idx: the contig's place in the header; null for others, which sort last."""
    if not contigs:
        return df.withColumn("contig_idx", F.lit(None).cast("int"))
    place = F.create_map(*chain.from_iterable((F.lit(c), F.lit(i)) for i, c in enumerate(contigs)))
    return df.withColumn("contig_idx", F.when(F.col(contig).isNotNull(), F.try_element_at(place, F.col(contig))))


def coordinate_order(key: str) -> list[Column]:
    """Header order, then start, strand, name, and a key among what is left."""
    return [F.col("contig_idx").asc_nulls_last(), F.col("start"), F.col("flags").bitwiseAND(0x10), F.col("name"), F.col(key)]


def sort_by_coordinate(df: DataFrame, contigs: list[str], key: str) -> DataFrame:
    """All rows in header order: ranges of equal size, each sorted on its own."""
    return with_contig_index(df, contigs).orderBy(*coordinate_order(key)).drop("contig_idx")


def size_ordered(df: DataFrame, group: str, size: str, parts: int) -> DataFrame:
    """Rows of a group share a partition; groups are dealt by size, so that the large ones lie apart. Groups are few and their sizes are summed first."""
    from pyspark.sql import Window

    sizes = df.groupBy(group).agg(F.sum(size).alias("size")).withColumn("pid", ((F.row_number().over(Window.orderBy(F.desc("size"), group)) - 1) % parts).cast("int"))
    return df.join(F.broadcast(sizes.select(group, "pid")), group).repartitionById(parts, F.col("pid")).drop("pid")


def by_name(df: DataFrame, name: str = "name", parts: int | None = None) -> DataFrame:
    """Rows of one name lie in one partition, next to each other."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, name).sortWithinPartitions(name)


def pairs(reads: DataFrame, template: str, key: str) -> DataFrame:
    """For each template its reads, the first and second of pair, and whether it is just these two."""
    first, second = F.count_if(flag(0x40)), F.count_if(flag(0x80))
    rows = reads.groupBy(template).agg(F.count("*").alias("n"), F.min(F.when(flag(0x40), F.col(key))).alias("first"), F.min(F.when(flag(0x80), F.col(key))).alias("second"), first.alias("firsts"), second.alias("seconds"))
    return rows.withColumn("is_pair", (F.col("firsts") == 1) & (F.col("seconds") == 1) & (F.col("n") == 2)).drop("firsts", "seconds")


def split_pairs(reads: DataFrame, template: str) -> tuple[DataFrame, DataFrame]:
    """Reads whose template has exactly two, and the others."""
    counts = reads.groupBy(template).agg(F.count("*").alias("of_template"))
    marked = reads.join(counts, template)
    return marked.filter("of_template = 2").drop("of_template"), marked.filter("of_template <> 2").drop("of_template")


def quality_yield(reads: DataFrame, group: list[str]) -> DataFrame:
    """Bases, bases of quality 20 and 30, and what they are worth as bases of quality 20; of reads with bases."""
    q = reads.filter(F.length("bases") > 0).select(*group, "flags", F.posexplode("quals").alias("cycle", "q"))
    out = q.groupBy(*group).agg(F.countDistinct("cycle").alias("cycles"), F.count("*").alias("total_bases"), F.count_if(F.col("q") >= 20).alias("q20_bases"), F.count_if(F.col("q") >= 30).alias("q30_bases"), F.sum(F.col("q").cast("long")).alias("sum_q"), F.count_if(~flag(0x200)).alias("pf_bases"))
    return out.select(*group, "cycles", "total_bases", "q20_bases", "q30_bases", F.floor(F.col("sum_q") / 20).alias("q20_equivalent"), "pf_bases")


def base_distribution(reads: DataFrame) -> DataFrame:
    """Bases by read of the pair and cycle, in the order of sequencing."""
    own = F.when(flag(0x10), F.reverse("bases")).otherwise(F.col("bases"))
    rows = reads.filter(F.length("bases") > 0).select(F.when(flag(0x80), 2).otherwise(1).cast("long").alias("read_end"), F.posexplode(F.split(own, "")).alias("cycle", "base"))
    letter = {"a": "A", "c": "C", "g": "G", "t": "T", "n_unknown": "N"}
    return rows.groupBy("read_end", (F.col("cycle") + 1).cast("long").alias("cycle")).agg(F.count("*").alias("n"), *[F.count_if(F.col("base") == x).alias(n) for n, x in letter.items()])


def inserts(reads: DataFrame) -> DataFrame:
    """First reads of proper pairs with a fragment length: mapped, primary, no duplicates."""
    return reads.filter(flag(2) & flag(0x40) & (F.col("flags").bitwiseAND(0x4 | 0x100 | 0x400 | 0x800) == 0) & (F.col("tlen") != 0))


def insert_sizes(reads: DataFrame, group: list[str]) -> DataFrame:
    """Median and median absolute deviation, mean, least and greatest fragment length by group, from counts by value."""
    rows = inserts(reads).select(*group, F.abs("tlen").cast("long").alias("v"))
    return spread(rows, group, "v", [F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean")])


def reverted_qualities(reads: DataFrame) -> DataFrame:
    """Qualities as they were before recalibration, where the tag OQ tells them."""
    old = F.transform(F.split(F.col("tags")["OQ"], ""), lambda c: F.ascii(c) - 33)
    return reads.withColumn("quals", F.coalesce(old, "quals"))


def compare_qualities(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How often each quality of one table becomes each quality of the other, base by base."""
    both = left.select(key, F.col("quals").alias("a")).join(right.select(key, F.col("quals").alias("b")), key)
    pairs_ = both.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    return pairs_.groupBy("a", "b").agg(F.count("*").alias("n"))
