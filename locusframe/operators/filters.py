"""Row filters over aligned reads, as named predicates that can be combined and counted.

A read has name, contig, start, end, mate_contig, mate_start, tlen, mapq, flags,
bases, quals (array), cigar (array of struct op, len), read_group, sample,
library, platform, platform_unit and tags (map).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def _mapped() -> Column:
    return ~flag(4)


def _consumed(ops: str) -> Column:
    return F.aggregate(F.col("cigar"), F.lit(0), lambda a, c: a + F.when(c["op"].isin(*ops), c["len"]).otherwise(0))


def _cigar_text() -> Column:
    return F.array_join(F.transform("cigar", lambda c: c["op"]), "")


#: Filters without parameters: a row stays where the predicate is true.
PLAIN: dict[str, Callable[[], Column]] = {
    "allow_all": lambda: F.lit(True),
    "no_n_operator": lambda: ~F.exists("cigar", lambda c: c["op"] == "N"),
    "first_of_pair": lambda: flag(0x40),
    "second_of_pair": lambda: flag(0x80),
    "good_cigar": lambda: ~_cigar_text().rlike("^[HS]*D|D[HS]*$|[ID][ID]|^[HS]*$"),
    "non_zero_fragment_length": lambda: F.col("tlen") != 0,
    "matching_bases_and_quals": lambda: F.length("bases") == F.size("quals"),
    "has_read_group": lambda: F.col("read_group").isNotNull(),
    "mapped": _mapped,
    "mapping_quality_available": lambda: F.col("mapq") != 255,
    "mapping_quality_not_zero": lambda: F.col("mapq") != 0,
    "mate_on_same_contig_or_unmapped": lambda: ~flag(1) | flag(8) | (_mapped() & F.col("contig").eqNullSafe(F.col("mate_contig"))),
    "mate_different_strand": lambda: flag(1) & _mapped() & ~flag(8) & (flag(0x10) != flag(0x20)),
    "non_zero_reference_length": lambda: _consumed("MDN=X") > 0,
    "not_duplicate": lambda: ~flag(0x400),
    "not_secondary": lambda: ~flag(0x100),
    "not_supplementary": lambda: ~flag(0x800),
    "paired": lambda: flag(1),
    "passes_vendor_check": lambda: ~flag(0x200),
    "properly_paired": lambda: flag(2),
    "primary_line": lambda: ~flag(0x100) & ~flag(0x800),
    "length_equals_cigar": lambda: flag(4) | (F.length("bases") == _consumed("MIS=X")),
    "sequence_stored": lambda: F.length("bases") > 0,
    "valid_start": lambda: flag(4) | (F.col("start") > 0),
    "valid_end": lambda: flag(4) | (F.col("end") - F.col("start") + 1 >= 0),
    "not_optical_duplicate": lambda: F.coalesce(F.col("tags")["OD"].cast("int"), F.lit(0)) == 0,
}


def wellformed() -> Column:
    names = ("valid_start", "valid_end", "has_read_group", "matching_bases_and_quals", "length_equals_cigar", "sequence_stored", "no_n_operator")
    out = F.lit(True)
    for name in names:
        out &= F.coalesce(PLAIN[name](), F.lit(False))
    return out


def ambiguous_bases(most: int | None = None, share: float = 0.05) -> Column:
    other = F.length(F.regexp_replace("bases", "[ACGTacgt]", ""))
    return other <= (F.lit(most) if most is not None else F.floor(F.length("bases") * share))


def fragment_length(most: int) -> Column:
    return ~flag(1) | (F.abs("tlen") <= most)


def among(column: str, values: list[str]) -> Column:
    """Library, sample, read group or name in a set; null fails."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def not_among(column: str, values: list[str]) -> Column:
    """Platform unit or read group not in a blacklist; null passes."""
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def platform(values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out |= F.coalesce(F.contains(F.lower("platform"), F.lit(v.lower())), F.lit(False))
    return out


def mapping_quality(least: int, most: int | None = None) -> Column:
    return (F.col("mapq") >= least) & (F.lit(True) if most is None else F.col("mapq") <= most)


def read_length(least: int, most: int) -> Column:
    return F.length("bases").between(least, most)


def strand(reverse: bool) -> Column:
    return flag(0x10) == F.lit(reverse)


def metrics(pf_only: bool, aligned_only: bool) -> Column:
    return (F.lit(not pf_only) | ~flag(0x200)) & (F.lit(not aligned_only) | _mapped()) & PLAIN["primary_line"]()


def overclipped(least: int, both_ends: bool = True) -> Column:
    """Dropped: soft-clipped (at both ends, or at either) and with fewer aligned bases."""
    first, last = (F.coalesce(F.get("cigar", i)["op"] == "S", F.lit(False)) for i in (F.lit(0), F.size("cigar") - 1))
    return ~(((first & last) if both_ends else (first | last)) & (_consumed("MIX=") < least))


def host_alignment(identity: int) -> Column:
    """Dropped: reads that match a host in at least so many bases (aligned ones less deletions and less differences, by the tag NM)."""
    differ = F.coalesce(F.col("tags")["NM"].cast("int"), F.lit(0))
    return ~((_consumed("M=X") - _consumed("D") - differ) >= identity)


def agrees_with_header(lengths: dict[str, int]) -> Column:
    """Unmapped, or on a contig of the header and not past its end. lengths: of the contigs, which are few."""
    known = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair]) if lengths else F.create_map().cast("map<string,int>")
    return flag(4) | F.coalesce(F.col("start") <= F.try_element_at(known, F.coalesce("contig", F.lit(""))), F.lit(False))


def evidence(least_quality: int, least_aligned: int) -> Column:
    """Reads that may tell of a rearrangement: primary, no duplicates, mapped well enough, enough aligned bases."""
    return PLAIN["primary_line"]() & ~flag(0x400) & ~flag(0x200) & _mapped() & F.col("mapq").between(least_quality, 254) & (_consumed("M=X") >= least_aligned)


def variant_ids(ids: list[str]) -> Column:
    return F.coalesce(F.col("id").isin(*ids), F.lit(False))


def variant_type(ref: Column, alts: Column) -> Column:
    """NO_VARIATION, SNP, MNP, INDEL, SYMBOLIC or MIXED, from the lengths of alleles."""
    one = lambda a: F.when(a.rlike(r"^<|\[|\]"), "SYMBOLIC").when(F.length(a) != F.length(ref), "INDEL").when(F.length(ref) == 1, "SNP").otherwise("MNP")
    kinds = F.array_distinct(F.transform(F.filter(alts, lambda a: a != "*"), one))
    return F.when(F.size(kinds) == 0, "NO_VARIATION").when(F.size(kinds) == 1, kinds[0]).otherwise("MIXED")


def variant_types(kinds: list[str]) -> Column:
    return variant_type(F.col("ref"), F.col("alts")).isin(*kinds)


def kept_by(df: DataFrame, conditions: dict[str, Column], key: str) -> DataFrame:
    """For each filter by itself, how many rows it keeps and the sum of their keys. One scan; null drops."""
    cells = []
    for name, c in conditions.items():
        keep = F.coalesce(c, F.lit(False))
        cells.append(F.struct(F.lit(name).alias("filter"), F.count_if(keep).alias("n"), F.coalesce(F.sum(F.when(keep, F.col(key))), F.lit(0)).cast("long").alias("keys")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def tag_genotypes(genotypes: Column, conditions: dict[str, Callable[[Column], Column]], missing: bool = False, invert: bool = False, to_no_call: bool = False) -> Column:
    """Genotypes whose FT field lists the filters that they match (PASS if none). conditions: of a genotype's map of fields.

    to_no_call: the alleles of a genotype that matches any become ".".
    """

    def one(g: Column) -> Column:
        values = g["values"]
        hit = lambda c: F.coalesce(c, F.lit(missing)) != F.lit(invert)
        found = F.array_compact(F.array(*[F.when(hit(f(values)), F.lit(name)) for name, f in conditions.items()]))
        old = F.filter(F.split(F.coalesce(F.try_element_at(values, F.lit("FT")), F.lit("")), ";"), lambda x: ~x.isin("", "PASS", "."))
        every = F.array_distinct(F.concat(old, found))
        told = F.when(F.size(every) == 0, "PASS").otherwise(F.array_join(every, ";"))
        calls = F.regexp_replace(values["GT"], "[0-9]+", ".")
        fields = F.map_from_entries(F.concat(F.filter(F.map_entries(values), lambda e: e["key"] != "FT"), F.array(F.struct(F.lit("FT").alias("key"), told.alias("value")))))
        if to_no_call:
            fields = F.transform_values(fields, lambda k, v: F.when((k == "GT") & (F.size(found) > 0), calls).otherwise(v))
        return F.struct(g["sample"].alias("sample"), fields.alias("values"))

    return F.transform(genotypes, one)


def tag(df: DataFrame, conditions: dict[str, Column], name: str = "filters", missing: bool = False, invert: bool = False) -> DataFrame:
    """Append the name of each matching condition to a set; PASS if none does. missing: what a null condition counts as."""
    hit = lambda c: F.coalesce(c, F.lit(missing)) != F.lit(invert)
    found = F.filter(F.array(*[F.when(hit(c), F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.when(F.size(found) == 0, F.array(F.lit("PASS"))).otherwise(found))


def counted(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row for each filter of a cascade: rows that reach it and rows that it drops. One scan."""
    before, cells = F.lit(True), []
    for i, (name, c) in enumerate(conditions.items()):
        c = F.coalesce(c, F.lit(False))
        cells.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("filter"), F.count_if(before).alias("n_in"), F.count_if(before & ~c).alias("n_dropped")))
        before &= c
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
