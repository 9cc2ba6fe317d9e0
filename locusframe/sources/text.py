"""Readers and writers of line formats, as DataFrames. Lines are parsed with JVM functions, so files split freely.

A path may be a file, a folder or a list of them.  Writers sort by range, so
the parts of a folder, one after another, are one file in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import if_small, null_safe
from ..operators.transforms import cigar_ops

Paths = str | list[str]


def _fields(spark: SparkSession, path: Paths, comment: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """f: the fields of each line; null for comments, so that a filter pushed below this one can't parse them."""
    real = ~F.col("value").startswith(comment) & (F.length("value") > 0)
    for word in skipped:
        real &= ~F.col("value").rlike(rf"^{word}(\s|$)")
    return spark.read.text(path).filter(real).select(F.when(real, F.split("value", "\t")).alias("f"))


def field(i: int) -> Column:
    return F.get(F.col("f"), F.lit(i))


def known(x: Column, unknown: str = ".") -> Column:
    return F.nullif(x, F.lit(unknown))


def first_of_each(entries: Column) -> Column:
    """A map of (key, value) entries; of repeated keys the first counts."""
    keys = F.transform(entries, lambda x: x["key"])
    return F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def header_lines(spark: SparkSession, path: Paths, mark: str) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").startswith(mark))


# Aligned reads


def read_sam(spark: SparkSession, path: Paths) -> DataFrame:
    """Aligned reads of text alignment files. Missing bases and qualities (*) are an empty text and null; of repeated tags the first counts."""
    f = F.col("f")
    tags = first_of_each(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substr(t, F.lit(6)).alias("value"))))
    mate = F.when(field(6) == "=", known(field(2), "*")).otherwise(known(field(6), "*"))
    quals = F.when(field(10) != "*", F.transform(F.split(field(10), ""), lambda c: F.ascii(c) - 33))
    rows = _fields(spark, path, "@").select(
        field(0).alias("name"),
        field(1).cast("int").alias("flags"),
        known(field(2), "*").alias("contig"),
        field(3).cast("int").alias("start"),
        field(4).cast("int").alias("mapq"),
        cigar_ops(field(5)).alias("cigar"),
        mate.alias("mate_contig"),
        field(7).cast("int").alias("mate_start"),
        field(8).cast("int").alias("tlen"),
        F.when(field(9) == "*", "").otherwise(field(9)).alias("bases"),
        quals.alias("quals"),
        tags.alias("tags"),
    )
    span = F.aggregate("cigar", F.lit(0), lambda a, c: a + F.when(c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(0))
    return rows.withColumn("end", F.col("start") + span - 1).withColumn("read_group", F.col("tags")["RG"])


def _header_map(value: Column) -> Column:
    return first_of_each(F.transform(F.slice(F.split(value, "\t"), 2, 1000), lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substr(x, F.lit(4)).alias("value"))))


def read_sequences(spark: SparkSession, path: Paths) -> DataFrame:
    """The sequence dictionary of text alignment or interval files: contig, length, in the order of contig_idx."""
    m = header_lines(spark, path, "@SQ").select(_header_map(F.col("value")).alias("m"), F.monotonically_increasing_id().alias("line"))
    return m.select(F.col("m")["SN"].alias("contig"), F.col("m")["LN"].cast("long").alias("length"), F.rank().over(_in_order("line")).alias("contig_idx"))


def _in_order(column: str):
    """A window over header lines, of which there are few."""
    from pyspark.sql import Window

    return Window.orderBy(column)


def read_read_groups(spark: SparkSession, path: Paths) -> DataFrame:
    """The read groups of text alignment files: read_group, sample, library, platform, platform_unit."""
    m = header_lines(spark, path, "@RG").select(_header_map(F.col("value")).alias("m"))
    return m.select(*[F.col("m")[tag].alias(name) for tag, name in (("ID", "read_group"), ("SM", "sample"), ("LB", "library"), ("PL", "platform"), ("PU", "platform_unit"))])


def with_read_groups(reads: DataFrame, read_groups: DataFrame) -> DataFrame:
    """Reads with their group's sample, library, platform and unit; null where the group is unknown."""
    return null_safe(reads, if_small(read_groups), ["read_group"], "left")


def sam_line(tags: Column) -> Column:
    """A read as a line; tags: a map whose values are written as text."""
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    star = lambda x: F.when(F.length(x) > 0, x).otherwise("*")
    quals = F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")
    mate = F.when(F.col("mate_contig").isNull(), "*").when(F.col("mate_contig").eqNullSafe(F.col("contig")), "=").otherwise(F.col("mate_contig"))
    plain = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit(":Z:"), e["value"]))
    columns = [F.col("name"), F.col("flags"), F.coalesce("contig", F.lit("*")), F.coalesce("start", F.lit(0)), F.col("mapq"), star(cigar), mate, F.coalesce("mate_start", F.lit(0)), F.col("tlen"), star(F.col("bases")), star(F.coalesce(quals, F.lit("")))]
    return F.concat_ws("\t", *[c.cast("string") for c in columns], F.array_join(plain, "\t")) if tags is not None else F.concat_ws("\t", *columns)


def write_sam(reads: DataFrame, path: str, sequences: DataFrame, read_groups: DataFrame | None = None, parts: int | None = None) -> None:
    """Text alignment files in header order: contigs as in sequences (contig, length, contig_idx), unmapped reads last.

    Header lines come first in the first part.  parts: how many files; one for a single file.
    """
    spark = reads.sparkSession
    place = if_small(sequences.select(F.col("contig"), F.col("contig_idx").cast("long")))
    body = null_safe(reads, place, ["contig"], "left").select(F.lit(1).alias("head"), "contig_idx", "start", "name", "flags", F.rtrim(sam_line(F.coalesce("tags", F.create_map().cast("map<string,string>"))), F.lit("\t")).alias("value"))
    lines = [spark.createDataFrame([("@HD\tVN:1.6\tSO:coordinate", 0)], "value string, line long").select("value", F.lit(-2).alias("head"), "line")]
    lines.append(sequences.select(F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"), F.lit(-1).alias("head"), F.col("contig_idx").cast("long").alias("line")))
    if read_groups is not None:
        tags = [F.concat(F.lit(f"{tag}:"), F.col(name)) for tag, name in (("ID", "read_group"), ("SM", "sample"), ("LB", "library"), ("PL", "platform"), ("PU", "platform_unit"))]
        lines.append(read_groups.select(F.concat_ws("\t", F.lit("@RG"), *tags).alias("value"), F.lit(0).alias("head"), F.lit(0).cast("long").alias("line")))
    for x in lines:
        body = body.unionByName(x.select("head", F.col("line").alias("contig_idx"), "value"), allowMissingColumns=True)
    order = ["head", F.col("contig_idx").asc_nulls_last(), "start", "name", "flags", "value"]
    whole = body.repartition(1) if parts == 1 else body.repartitionByRange(parts, *order) if parts else body.repartitionByRange(*order)
    whole.sortWithinPartitions(*order).select("value").write.text(path)


# Variants

GENOTYPE = "array<struct<sample:string,values:map<string,string>>>"


def vcf_samples(spark: SparkSession, path: Paths) -> list[str]:
    """Names of the samples, from the column header (of the first file that has one)."""
    head = header_lines(spark, path, "#CHROM").first()
    return head.value.split("\t")[9:] if head else []


def read_vcf_header(spark: SparkSession, path: Paths) -> DataFrame:
    """Declared fields: kind (INFO, FORMAT, FILTER, contig), id, number, type, description."""
    value = F.col("value")
    part = lambda name: F.nullif(F.regexp_extract(value, rf'[<,]{name}=(?:"([^"]*)"|([^,>]*))', 1), F.lit(""))
    bare = lambda name: F.nullif(F.regexp_extract(value, rf"[<,]{name}=([^\",>]*)", 1), F.lit(""))
    lines = header_lines(spark, path, "##").filter(value.contains("=<ID="))
    return lines.select(F.regexp_extract(value, "^##([^=]+)=", 1).alias("kind"), bare("ID").alias("id"), bare("Number").alias("number"), bare("Type").alias("type"), part("Description").alias("description")).distinct()


def allele_indices(gt: Column) -> Column:
    """Allele numbers of a genotype text, null for a no-call."""
    return F.transform(F.split(gt, r"[/|]"), lambda a: a.try_cast("int"))


def read_vcf(spark: SparkSession, path: Paths, samples: list[str] | None = None) -> DataFrame:
    """Sites of variant files with their genotypes.

    info: a map; a flag's value is null, what follows the first = is the value,
    and of repeated keys the first counts.  genotypes: for each sample its
    FORMAT fields as a map (trailing fields may be left out), null where the
    file says ".".  samples: their names, if the header isn't to be read.
    """
    names = vcf_samples(spark, path) if samples is None else samples
    eq = lambda x: F.instr(x, "=")
    entry = lambda x: F.struct(F.when(eq(x) > 0, F.substr(x, F.lit(1), eq(x) - 1)).otherwise(x).alias("key"), F.when(eq(x) > 0, F.substr(x, eq(x) + 1)).alias("value"))
    info = first_of_each(F.transform(F.filter(F.split(field(7), ";"), lambda x: (x != ".") & (x != "")), entry))
    keys = F.split(field(8), ":")
    sample_names = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")

    def values(x: Column) -> Column:
        own = F.split(x, ":")
        n = F.least(F.size(keys), F.size(own))
        return F.map_from_arrays(F.slice(keys, F.lit(1), n), F.transform(F.slice(own, F.lit(1), n), lambda v: known(v)))

    genotypes = F.transform(F.slice(F.col("f"), F.lit(10), F.lit(len(names))), lambda x, i: F.struct(F.get(sample_names, i).alias("sample"), values(x).alias("values"))) if names else F.array().cast(GENOTYPE)
    rows = _fields(spark, path, "#").select(
        field(0).alias("contig"),
        field(1).cast("int").alias("start"),
        known(field(2)).alias("id"),
        field(3).alias("ref"),
        F.filter(F.split(field(4), ","), lambda x: x != ".").alias("alts"),
        known(field(5)).cast("double").alias("qual"),
        F.when(field(6) != ".", F.filter(F.split(field(6), ";"), lambda x: x != "PASS")).alias("filters"),
        info.alias("info"),
        genotypes.alias("genotypes"),
    )
    end = F.coalesce(F.col("info")["END"].try_cast("int"), F.col("start") + F.length("ref") - 1)
    return rows.withColumn("end", end)


def read_variants(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sites of several variant files whose samples differ, as one table: genotypes by name, source the file's number."""
    parts = [read_vcf(spark, p).withColumn("source", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sample_text(name: str, keys: Column) -> Column:
    own = F.get(F.filter("genotypes", lambda g: g["sample"] == name), F.lit(0))["values"]
    return F.when(own.isNotNull(), F.array_join(F.transform(keys, lambda k: F.coalesce(F.try_element_at(own, k), F.lit("."))), ":"))


def vcf_line(samples: list[str]) -> Column:
    """A site as a line; INFO in order of keys, FORMAT with GT first."""
    dot = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("."))
    number = F.regexp_replace(F.col("qual").cast("string"), r"\.0$", "")
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    status = F.when(F.col("filters").isNull(), ".").when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";"))
    columns = [F.col("contig"), F.col("start").cast("string"), dot(F.col("id")), F.col("ref"), dot(F.array_join("alts", ",")), dot(number), status, dot(info)]
    if samples:
        used = F.array_sort(F.array_distinct(F.flatten(F.transform("genotypes", lambda g: F.map_keys(g["values"])))))
        keys = F.concat(F.filter(used, lambda k: k == "GT"), F.filter(used, lambda k: k != "GT"))
        columns.append(dot(F.array_join(keys, ":")))
        columns += [F.coalesce(_sample_text(name, keys), F.lit(".")) for name in samples]
    return F.concat_ws("\t", *columns)


def write_vcf(sites: DataFrame, path: str, sequences: DataFrame, samples: list[str] = (), declared: list[str] = (), parts: int | None = None) -> None:
    """Variant files in header order. declared: further header lines (without ##)."""
    spark = sites.sparkSession
    place = if_small(sequences.select("contig", F.col("contig_idx").cast("long")))
    body = null_safe(sites, place, ["contig"], "left").select(F.lit(1).alias("head"), "contig_idx", "start", vcf_line(list(samples)).alias("value"))
    first = ["##fileformat=VCFv4.2", *(f"##{x}" for x in declared)]
    head = spark.createDataFrame([(-2, i, x) for i, x in enumerate(first)], "head int, contig_idx long, value string")
    contigs = sequences.select(F.lit(-1).alias("head"), F.col("contig_idx").cast("long"), F.concat(F.lit("##contig=<ID="), "contig", F.lit(",length="), F.col("length").cast("string"), F.lit(">")).alias("value"))
    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    columns = spark.createDataFrame([(0, 0, "\t".join(names))], "head int, contig_idx long, value string")
    for x in (head, contigs, columns):
        body = body.unionByName(x, allowMissingColumns=True)
    order = ["head", F.col("contig_idx").asc_nulls_last(), "start", "value"]
    whole = body.repartition(1) if parts == 1 else body.repartitionByRange(parts, *order) if parts else body.repartitionByRange(*order)
    whole.sortWithinPartitions(*order).select("value").write.text(path)


# Intervals and tables


def read_bed(spark: SparkSession, path: Paths) -> DataFrame:
    """Half-open BED lines as closed intervals; track and browser lines are no rows."""
    return _fields(spark, path, "#", ("track", "browser")).select(field(0).alias("contig"), (field(1).cast("int") + 1).alias("start"), field(2).cast("int").alias("end"), field(3).alias("name"), known(field(4)).try_cast("double").alias("score"), known(field(5)).alias("strand"))


def read_interval_list(spark: SparkSession, path: Paths) -> DataFrame:
    return _fields(spark, path, "@").select(field(0).alias("contig"), field(1).cast("int").alias("start"), field(2).cast("int").alias("end"), field(3).alias("strand"), field(4).alias("name"))


def parse_interval(text: Column) -> Column:
    """(contig, start, end) of contig, contig:start, contig:start-end or contig:start+. Commas in numbers go; an open end is the greatest number; the contig may hold colons."""
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long")
    pattern = r"^(.+?)(?::([0-9,]+)(?:-([0-9,]+)|(\+))?)?$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    start, last, plus = part(2), part(3), part(4)
    open_end = F.lit(2**31 - 1).cast("long")
    return F.struct(part(1).alias("contig"), F.coalesce(number(start), F.lit(1).cast("long")).alias("start"), F.when(start.isNull() | plus.isNotNull(), open_end).otherwise(F.coalesce(number(last), number(start))).alias("end"))


def read_gtf(spark: SparkSession, path: Paths) -> DataFrame:
    """Features of a gene model; attributes as a map (of repeated ones, as tags, the first counts), with the ids of the parents as columns."""
    pairs = F.regexp_extract_all(field(8), F.lit(r'(\w+) (?:"[^"]*"|[^";]+)'), F.lit(0))
    attributes = first_of_each(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(" "), F.lit(1)).alias("key"), F.replace(F.substr(p, F.instr(p, " ") + 1), F.lit('"'), F.lit("")).alias("value"))))
    rows = _fields(spark, path, "#").select(field(0).alias("contig"), field(1).alias("source"), field(2).alias("feature"), field(3).cast("int").alias("start"), field(4).cast("int").alias("end"), known(field(5)).try_cast("double").alias("score"), field(6).alias("strand"), known(field(7)).try_cast("int").alias("frame"), attributes.alias("attributes"))
    return rows.withColumns({name: F.col("attributes")[name] for name in ("gene_id", "transcript_id")})


def read_pileup(spark: SparkSession, path: Paths) -> DataFrame:
    """Pileup lines: contig, start, ref, depth, bases (one for each read, as letters; . and , are the reference's) and quals.

    Read starts (with their mapping quality), read ends and the bases of indels
    are no bases at the position.
    """
    plain = F.regexp_replace(F.regexp_replace(field(4), r"\^.", ""), r"\$", "")
    pieces = F.split(plain, r"[+-](?=[0-9])")
    after = lambda x: F.substr(x, F.length(F.regexp_extract(x, "^([0-9]+)", 1)) + F.regexp_extract(x, "^([0-9]+)", 1).cast("int") + 1)
    bases = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(after(x))), "")
    letters = F.upper(F.regexp_replace(bases, "[.,]", F.upper(field(2))))
    quals = F.filter(F.transform(F.split(field(5), ""), lambda c: F.ascii(c) - 33), lambda q: q >= 0)
    return _fields(spark, path, "#").select(field(0).alias("contig"), field(1).cast("int").alias("start"), F.upper(field(2)).alias("ref"), field(3).cast("int").alias("depth"), letters.alias("bases"), quals.alias("quals"))


def read_table(spark: SparkSession, path: Paths, schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header row and # comments."""
    reader = spark.read.option("sep", "\t").option("header", True).option("comment", "#")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_locatable(spark: SparkSession, path: Paths, contig: str, start: str, end: str, sep: str = "\t") -> DataFrame:
    """A delimited table in which three columns are an interval; the other columns are text, as its header row names them."""
    rows = spark.read.option("sep", sep).option("header", True).option("comment", "#").csv(path)
    return rows.withColumnsRenamed({contig: "contig"}).withColumns({"start": F.col(start).cast("int"), "end": F.col(end).cast("int")})


def read_interval_table(spark: SparkSession, path: Paths) -> DataFrame:
    """A table whose first column, named in a row that begins with HEADER, is contig:start-end; values: the other columns, by name."""
    head = header_lines(spark, path, "HEADER").first()
    names = head.value.split()[1:] if head else []
    rows = _fields(spark, path, "HEADER").filter(~field(0).startswith("#"))
    f = F.col("f")
    values = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.get(f, i))) if names else F.create_map().cast("map<string,string>")
    return rows.select(parse_interval(field(0)).alias("i"), values.alias("values")).select("i.*", "values")


def read_pedigree(spark: SparkSession, path: Paths) -> DataFrame:
    return _fields(spark, path, "#").select(field(0).alias("family"), field(1).alias("sample"), *(known(field(i), "0").alias(n) for i, n in ((2, "father"), (3, "mother"))), field(4).alias("sex"), field(5).alias("phenotype"))


def trios(pedigree: DataFrame) -> DataFrame:
    """family, child, father, mother of samples both of whose parents are listed in their family."""
    own = pedigree.select("family", "sample")
    child = pedigree.filter("father is not null and mother is not null").select("family", F.col("sample").alias("child"), "father", "mother")
    for parent in ("father", "mother"):
        child = child.join(own.withColumnRenamed("sample", parent), ["family", parent], "left_semi")
    return child.select("family", "child", "father", "mother")


def write_bed(df: DataFrame, path: str, contig: str, start: str, end: str, name: str | None = None) -> None:
    """Closed intervals as BED lines, in order."""
    columns = [F.col(contig), (F.col(start) - 1).cast("string"), F.col(end).cast("string"), *([F.col(name)] if name else [])]
    df.repartitionByRange(contig, start, end).sortWithinPartitions(contig, start, end).select(F.concat_ws("\t", *columns)).write.text(path)


def write_interval_list(df: DataFrame, path: str, sequences: DataFrame) -> None:
    """Interval lines in header order, after the sequence dictionary. df: contig, start, end, strand, name."""
    place = if_small(sequences.select("contig", F.col("contig_idx").cast("long")))
    body = null_safe(df, place, ["contig"], "left").select(F.lit(1).alias("head"), "contig_idx", "start", "end", F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("strand", F.lit("+")), F.coalesce("name", F.lit("."))).alias("value"))
    head = sequences.select(F.lit(0).alias("head"), F.col("contig_idx").cast("long"), F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    order = ["head", F.col("contig_idx").asc_nulls_last(), "start", "end", "value"]
    body.unionByName(head, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


# Partitioned Parquet


def write_partitioned(df: DataFrame, path: str, contig: str, start: str, width: int) -> None:
    """Parquet by contig and bin of starts, so that interval queries prune folders."""
    df.withColumn("bin", F.floor(F.col(start) / width)).repartition(contig, "bin").write.partitionBy(contig, "bin").parquet(path)


def read_partitioned(spark: SparkSession, path: str, contig: str, start: str, end: str, width: int, wanted: list[tuple[str, int, int]], longest: int) -> DataFrame:
    """Rows that overlap one of the wanted intervals (a user's short list). Only folders that may hold some are listed. longest: the length of the longest row."""
    rows, keep, bins = spark.read.parquet(path), F.lit(False), F.lit(False)
    for c, s, e in wanted:
        bins |= (F.col(contig) == c) & F.col("bin").between((s - longest) // width, e // width)
        keep |= (F.col(contig) == c) & (F.col(start) <= e) & (F.col(end) >= s)
    return rows.filter(bins).filter(keep).drop("bin")
