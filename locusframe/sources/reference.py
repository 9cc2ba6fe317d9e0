"""Reference sequences as tables of chunks (contig, chunk, bases), and the bases that intervals need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import if_small
from ..functions.scalars import share_of

#: Bases of a chunk.
CHUNK = 10_000


def chunks(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """contig and bases, cut into chunks of one size."""
    n = F.greatest(F.length("bases") - 1, F.lit(0))
    return sequences.select("contig", F.explode(F.sequence(F.lit(0), F.floor(n / size).cast("int"))).alias("chunk"), "bases").select("contig", F.col("chunk").cast("long").alias("chunk"), F.substring("bases", F.col("chunk") * size + 1, F.lit(size)).alias("bases"))


def read_fasta(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """Chunks of the sequences of a FASTA file; a record (one sequence) is read as a whole, and cut at once."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    bases = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return chunks(records.select(name.alias("contig"), bases.alias("bases")), size)


def write_fasta(reference: DataFrame, path: str, width: int = 60) -> None:
    """One record for each contig, with lines of ``width`` bases. A contig is put together in one task."""
    whole = reference.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bases"))), lambda x: x["bases"]), "").alias("bases"))
    lines = F.regexp_replace(F.regexp_replace("bases", f"(.{{{width}}})", "$1\n"), "\n$", "")
    whole.repartitionByRange("contig").sortWithinPartitions("contig").select(F.concat(F.lit(">"), "contig", F.lit("\n"), lines).alias("value")).write.text(path)


def contig_lengths(reference: DataFrame) -> DataFrame:
    """A sequence dictionary: contig, length, contig_idx in order of names."""
    from pyspark.sql import Window

    sizes = reference.groupBy("contig").agg(F.sum(F.length("bases")).cast("long").alias("length"))
    return sizes.withColumn("contig_idx", (F.row_number().over(Window.orderBy("contig")) - 1).cast("long"))  # a row for each contig


def reference_bases(df: DataFrame, reference: DataFrame, key: list[str], contig: str, start: str, end: str, before: int = 0, after: int = 0, size: int = CHUNK) -> DataFrame:
    """df with window_start and ``bases`` of each row's interval, widened by before and after and cut to the contig (null where it has none).

    key: columns that tell df's rows apart.  A row is listed once for each
    chunk that it touches; the reference is broadcast if it is small, else both
    sides are shuffled by chunk.
    """
    low, high = F.greatest(F.col(start) - before, F.lit(1)), F.col(end) + after
    named = reference.select(F.col("contig").alias("ref_contig"), F.col("chunk").alias("ref_chunk"), F.col("bases").alias("ref_bases"))
    wanted = df.select(*key, F.col(contig).alias("own_contig"), low.cast("long").alias("low"), high.cast("long").alias("high")).filter("high >= low")
    wanted = wanted.withColumn("own_chunk", F.explode(F.sequence(F.floor((F.col("low") - 1) / size), F.floor((F.col("high") - 1) / size))))
    from_ = F.greatest(F.col("low") - F.col("own_chunk") * size, F.lit(1))
    to = F.least(F.col("high") - F.col("own_chunk") * size, F.lit(size))
    found = wanted.join(if_small(named), (F.col("own_contig") == F.col("ref_contig")) & (F.col("own_chunk") == F.col("ref_chunk")))
    parts = found.select(*key, F.struct("own_chunk", F.substr("ref_bases", from_, to - from_ + 1).alias("bases")).alias("part"))
    whole = parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["bases"]), "").alias("bases"))  # a row's own chunks
    return df.join(whole, key, "left").withColumn("window_start", low)


def without_unknown(df: DataFrame, bases: Column) -> DataFrame:
    """Rows whose bases aren't all N."""
    return df.filter(F.length(F.translate(F.upper(bases), "N", "")) > 0)


def gc_share(bases: Column) -> Column:
    """Share of G and C among the known bases; null if none is known."""
    counted = F.regexp_replace(F.upper(bases), "[^ACGT]", "")
    return F.when(F.length(counted) > 0, share_of(counted, "GC"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, bases, quals of FASTQ files. Their records have no mark to split at, so a file is one task's: many files should hold them."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("l"))
    at = lambda i: F.get("l", i)
    record = lambda i: F.struct(F.substr(F.split_part(at(i), F.lit(" "), F.lit(1)), F.lit(2)).alias("name"), at(i + 1).alias("bases"), F.transform(F.split(at(i + 3), ""), lambda c: F.ascii(c) - 33).alias("quals"))
    return lines.filter(F.size("l") >= 4).select(F.inline(F.transform(F.sequence(F.lit(0), F.size("l") - 4, F.lit(4)), record)))


def write_fastq(reads: DataFrame, path: str) -> None:
    """name, bases and quals as four lines each."""
    quals = F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "bases", F.lit("+"), quals)).write.text(path)
