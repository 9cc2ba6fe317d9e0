"""Queries of variant tables, and of the text formats that hold reads, variants, intervals and references.

Orders stand in for sites: alleles, filters, INFO and the genotypes of three
samples come from arithmetic on their keys, with multi-allelic, symbolic and
non-variant sites, no-calls and phased calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import intervals as I  # noqa: E741
from ..operators import variants as V
from ..sources import bam as BAM
from ..sources import reference as REF
from ..sources import text as X
from ..sources.shared import scratch
from .catalog import SPANS, day, day_sql, query, spans, table
from .reads import READS, _list
from .reads import reads as read_view

ALLELES = (("A", "G"), ("C", "T"), ("AC", "A"), ("G", "GTT"), ("AT", "GC"), ("A", "C,T"), ("A", "<DEL>"), ("G", ""), ("CAGG", "CAG"))
GENOTYPES = ("0/0", "0/1", "1/1", "./.", "0|1", "1|0", "0/.")
SAMPLES = ("s0", "s1", "s2")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site view of orders; k is its key."""
    c, k, t = F.col("o_custkey"), F.col("o_orderkey"), F.floor("o_totalprice")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    kind = t % len(ALLELES)
    text = lambda x: x.cast("string")
    alt = pick([a for _, a in ALLELES], kind)

    def genotype(j: int):
        i = (k + 3 * j + c) % len(GENOTYPES)
        gt = F.when(alt == "", "0/0").when((alt == "C,T") & (i == 1), "1/2").otherwise(pick(GENOTYPES, i))
        values = F.create_map(F.lit("GT"), gt, F.lit("GQ"), text((t + 13 * j) % 100), F.lit("DP"), text((k * 3 + j) % 60))
        return F.struct(F.lit(SAMPLES[j]).alias("sample"), values.alias("values"))

    info = F.create_map(F.lit("DP"), text(t % 200), F.lit("ANN"), F.concat(F.lit("a="), text(k % 9)), F.lit("AF"), F.when(alt == "C,T", "0.25,0.5").otherwise("0.5"))
    info = F.when(t % 3 == 0, F.map_concat(info, F.create_map(F.lit("DB"), F.lit(None).cast("string")))).otherwise(info)
    filters = F.when(t % 5 == 0, F.array(F.lit("q10"))).when(t % 7 == 0, F.array(F.lit("q10"), F.lit("low"))).when(t % 11 == 0, None).otherwise(F.array().cast("array<string>"))
    o = table(spark, sf_dir, "orders")
    sites = o.select(k.alias("k"), F.concat(F.lit("chr"), text(c % 5 + 1)).alias("contig"), (day("o_orderdate") * 7 + k % 7 + 1).cast("int").alias("start"), F.when(k % 4 == 0, F.concat(F.lit("id"), text(k % 40))).alias("id"), pick([r for r, _ in ALLELES], kind).alias("ref"), F.filter(F.split(alt, ","), lambda a: a != "").alias("alts"), F.when(t % 13 != 0, (k % 100) * 1234.5 + 0.25).alias("qual"), filters.alias("filters"), info.alias("info"), F.array(*[genotype(j) for j in range(3)]).alias("genotypes"))
    return sites.withColumn("end", F.col("start") + F.length("ref") - 1)


def _gt(j: int) -> str:
    i = f"(k + {3 * j} + c) % {len(GENOTYPES)}"
    return f"case when alt = '' then '0/0' when alt = 'C,T' and {i} = 1 then '1/2' else ({_list(GENOTYPES)})[{i} + 1] end"


VARIANTS = f"""vo as (select o_orderkey k, o_custkey c, cast(floor(o_totalprice) as bigint) t, ({_list([a for _, a in ALLELES])})[cast(floor(o_totalprice) as bigint) % {len(ALLELES)} + 1] alt, ({_list([r for r, _ in ALLELES])})[cast(floor(o_totalprice) as bigint) % {len(ALLELES)} + 1] as ref, {day_sql('o_orderdate')} d from orders),
variants as (select k, 'chr' || (c % 5 + 1) contig, d * 7 + k % 7 + 1 as start, d * 7 + k % 7 + length(ref) as end, case when k % 4 = 0 then 'id' || (k % 40) end id, ref, alt, case when alt = '' then []::varchar[] else string_split(alt, ',') end alts, case when t % 13 <> 0 then (k % 100) * 1234.5::double + 0.25 end qual,
  case when t % 5 = 0 then ['q10'] when t % 7 = 0 then ['q10', 'low'] when t % 11 = 0 then null else []::varchar[] end filters, t % 200 dp, k % 9 ann, case when alt = 'C,T' then '0.25,0.5' else '0.5' end af, t % 3 = 0 db,
  [{', '.join(_gt(j) for j in range(3))}] gts, [{', '.join(f'(t + {13 * j}) % 100' for j in range(3))}] gqs, [{', '.join(f'(k * 3 + {j}) % 60' for j in range(3))}] dps from vo)"""
ONE = "case when a like '<%' then 'SYMBOLIC' when length(a) <> length(ref) then 'INDEL' when length(ref) = 1 then 'SNP' else 'MNP' end"
KINDS = f"list_distinct(list_transform(alts, lambda a: {ONE}))"
TYPE = f"case when len(alts) = 0 then 'NO_VARIATION' when len({KINDS}) = 1 then ({KINDS})[1] else 'MIXED' end"
CALLED = "not contains(g, '.')"
HAS_ALT = "regexp_matches(g, '[1-9]')"
CONTIGS = [(f"chr{i}", 40_000, i - 1) for i in range(1, 6)]


def sequences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTIGS, "contig string, length long, contig_idx long")


@query(f"with {VARIANTS} select k, {TYPE} as type, greatest(coalesce(list_max(list_transform(list_filter(alts, lambda a: a not like '<%'), lambda a: abs(length(a) - length(ref)))), 0), 0) indel_size from variants")
def variant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir)
    return v.select("k", FL.variant_type(F.col("ref"), F.col("alts")).alias("type"), V.indel_sizes().cast("long").alias("indel_size"))


@query(f"with {VARIANTS} select k, contig, start from variants where {TYPE} in ('SNP', 'INDEL') and coalesce(qual > 5000, false) and coalesce(id not in ('id4', 'id8'), true) and coalesce(len(filters) = 0, true) and len(list_filter(gts[1:2], lambda g: {HAS_ALT})) > 0 and len(list_filter(gts[1:2], lambda g: not ({CALLED}))) <= 0.5 * 2")
def select_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.select_variants(variants(spark, sf_dir), samples=["s0", "s1"], types=["SNP", "INDEL"], not_ids=["id4", "id8"], conditions=[F.col("qual") > 5000], exclude_filtered=True, exclude_non_variants=True, most_no_calls=0.5)
    return found.select("k", "contig", "start")


@query(f"with {VARIANTS} select k, {TYPE} as type from variants where coalesce(id in ('id0', 'id12'), false) and greatest(coalesce(list_max(list_transform(list_filter(alts, lambda a: a not like '<%'), lambda a: abs(length(a) - length(ref)))), 0), 0) between 1 and 2")
def select_ids_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.select_variants(variants(spark, sf_dir), ids=["id0", "id12"], sizes=(1, 2))
    return found.select("k", FL.variant_type(F.col("ref"), F.col("alts")).alias("type"))


_FT = "case when gqs[j] < 20 and dps[j] > 30 then 'lowGQ;deep' when gqs[j] < 20 then 'lowGQ' when dps[j] > 30 then 'deep' else 'PASS' end"


@query(f"with {VARIANTS} select k, array_to_string(list_transform([1, 2, 3], lambda j: {_FT}), ' ') told, array_to_string(list_transform([1, 2, 3], lambda j: case when {_FT} = 'PASS' then gts[j] else regexp_replace(gts[j], '[0-9]+', '.', 'g') end), ' ') calls from variants")
def genotype_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda name: lambda m: m[name].cast("int")
    tagged = FL.tag_genotypes(F.col("genotypes"), {"lowGQ": lambda m: number("GQ")(m) < 20, "deep": lambda m: number("DP")(m) > 30}, to_no_call=True)
    out = variants(spark, sf_dir).withColumn("genotypes", tagged)
    each = lambda name: F.array_join(F.transform("genotypes", lambda g: g["values"][name]), " ")
    return out.select("k", each("FT").alias("told"), each("GT").alias("calls"))


@query(f"with {VARIANTS}, m as (select 'chr' || (o_custkey % 5 + 1) contig, {day_sql('o_orderdate')} * 7 as s, {day_sql('o_orderdate')} * 7 + 3 e from orders where o_orderkey % 10 = 0), h as (select k, exists (select 1 from m where m.contig = v.contig and s - 5 <= v.\"end\" and v.start <= e + 5) hit, filters from variants v) select k, array_to_string(case when hit and not coalesce(list_contains(filters, 'low'), false) then list_append(coalesce(filters, []::varchar[]), 'low') else filters end, ';') inside, array_to_string(case when not hit and not coalesce(list_contains(filters, 'low'), false) then list_append(coalesce(filters, []::varchar[]), 'low') else filters end, ';') outside from h")
def mask_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).select("k", "contig", "start", "end", "filters")
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0")
    m = o.select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("contig"), (day("o_orderdate") * 7).alias("start"), (day("o_orderdate") * 7 + 3).alias("end"))
    inside = V.mask(v, m, "low", "k", extension=5, width=50)
    outside = V.mask(v, m, "low", "k", extension=5, not_in_mask=True, width=50).select("k", F.col("filters").alias("other"))
    return inside.join(outside, "k").select("k", F.array_join("filters", ";").alias("inside"), F.array_join("other", ";").alias("outside"))


@query(f"with {VARIANTS}, b as (select * from variants where k % 3 = 0) select k, exists (select 1 from b where b.contig = v.contig and b.start <= v.\"end\" and v.start <= b.\"end\") hit from variants v")
def concordant_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).select("k", "contig", "start", "end")
    b = v.filter("k % 3 = 0")
    hit = V.overlapping(v, b, "k", width=50).select("k", F.lit(True).alias("hit"))
    miss = V.overlapping(v, b, "k", concordant=False, width=50).select("k", F.lit(False).alias("hit"))
    return hit.unionByName(miss)


_BASES = "list_sort(list_transform(string_split(replace(gts[j], '|', '/'), '/'), lambda a: case when a = '.' then null when a = '0' then ref else alts[a::int] end))"


@query(f"with {VARIANTS}, a as (select k, contig, start, list_transform([1, 2], lambda j: {_BASES}) x, ref from variants), b as (select k + 1 k, list_transform([1, 2], lambda j: {_BASES}) y from variants) select a.k, coalesce(array_to_string(x[1], ',') = array_to_string(y[1], ',') and len(list_filter(x[1], lambda z: z is null)) = 0 and len(list_filter(y[1], lambda z: z is null)) = 0 and array_to_string(x[2], ',') = array_to_string(y[2], ',') and len(list_filter(x[2], lambda z: z is null)) = 0 and len(list_filter(y[2], lambda z: z is null)) = 0, false) same from a left join b using (k)")
def genotype_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site against the one with the next smaller key, moved to its place."""
    v = variants(spark, sf_dir).withColumns({"contig": F.lit("c"), "start": F.col("k")})
    moved = variants(spark, sf_dir).withColumns({"contig": F.lit("c"), "start": F.col("k") + 1})
    v, moved = (_without_no_calls(x) for x in (v, moved))
    same = V.genotype_concordance(v, moved, ["s0", "s1"]).select("k", F.lit(True).alias("same"))
    return v.select("k").join(same, "k", "left").select("k", F.coalesce("same", F.lit(False)).alias("same"))


def _without_no_calls(v: DataFrame) -> DataFrame:
    """A genotype with a no-call never matches: its field goes."""
    return v.withColumn("genotypes", F.transform("genotypes", lambda g: F.struct(g["sample"].alias("sample"), F.map_filter(g["values"], lambda k, x: (k != "GT") | ~x.contains(".")).alias("values"))))


@query(f"with {VARIANTS}, u as (select *, list_sort(list_distinct(list_filter(flatten(list_transform(gts[1:2], lambda g: list_transform(regexp_extract_all(g, '[0-9]+'), lambda a: a::int))), lambda a: a > 0 and a <= len(alts)))) used from variants) select k, array_to_string(list_transform(used, lambda i: alts[i]), ',') alts, array_to_string(list_transform(gts, lambda g: regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(g, '|', '/'), '/'), lambda a: case when a = '0' then '0' when a = '.' then '.' when list_contains(used, a::int) then list_position(used, a::int)::varchar else '.' end), '/'), '/', case when contains(g, '|') then '|' else '/' end), '^$', '')), ' ') calls from u")
def subset_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the alternates that the first two samples have."""
    v = variants(spark, sf_dir)
    used = V.select_variants(v, samples=["s0", "s1"]).select("k", V.used_alleles().alias("used"))
    out = V.subset_alleles(v.join(used, "k"), F.col("used"))
    return out.select("k", F.array_join("alts", ",").alias("alts"), F.array_join(F.transform("genotypes", lambda g: g["values"]["GT"]), " ").alias("calls"))


@query(f"with {VARIANTS}, s as (select *, unnest(case when len(alts) = 0 then [null] else range(1, len(alts) + 1) end) a from variants) select contig \"CHROM\", cast(start as varchar) \"POS\", coalesce(alts[a], 'NA') \"ALT\", coalesce(array_to_string(case when len(filters) = 0 then ['PASS'] else filters end, ','), 'NA') \"FILTER\", case when len(alts) > 1 then string_split(af, ',')[a] else af end \"AF\", 'AF=' || af || ';ANN=a=' || ann \"A*\", case when db then 'true' else 'NA' end \"DB\", {TYPE} as \"TYPE\", cast(len(list_filter(gts, lambda g: {CALLED})) as varchar) \"NCALLED\", gts[2] \"s1.GT\", cast(dps[2] as varchar) \"s1.DP\", gts[3] \"s2.GT\", cast(dps[3] as varchar) \"s2.DP\" from s")
def sites_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.to_table(variants(spark, sf_dir), ["CHROM", "POS", "ALT", "FILTER", "AF", "A*", "DB", "TYPE", "NCALLED"], ["GT", "DP"], ["s1", "s2"], split_alleles=True)


@query(f"with {VARIANTS}, m as (select k, [('site', 'POS', cast(start as varchar)), ('site', 'QUAL', coalesce(case when qual is not null then 'has' end, 'NA')), ('s0', 'GQ', cast(gqs[1] as varchar))] xs from variants), x as (select k, unnest(xs) x from m) select k, x[1] as sample, x[2] as field, x[3] as value from x")
def sites_molten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.to_table(variants(spark, sf_dir), ["POS", "QUAL"], ["GQ"], ["s0"], molten=True, key=["k"])
    return out.withColumn("value", F.when((F.col("field") == "QUAL") & (F.col("value") != "NA"), "has").otherwise(F.col("value")))


@query(f"with {VARIANTS}, x as (select *, list_transform(list_filter([1, 2, 3], lambda j: regexp_matches(gts[j], '[1-9]')), lambda j: j) vs, flatten(list_transform(gts, lambda g: regexp_extract_all(g, '[0-9]+'))) called from variants) select k, cast(list_sum(dps) as bigint) depth, round(qual / nullif(list_sum(list_transform(vs, lambda j: dps[j])), 0), 6) qual_by_depth, array_to_string(list_transform(vs, lambda j: 's' || (j - 1)), ',') samples, array_to_string(list_transform(range(1, len(alts) + 1), lambda i: len(list_filter(called, lambda a: a = i::varchar))), ',') ac, len(called) an, len(list_filter(gts, lambda g: contains(g, '.'))) ncc, round(list_avg(gqs), 6) gq_mean, round(list_stddev_samp(gqs), 6) gq_sd from x")
def site_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.site_annotations(variants(spark, sf_dir))
    long = lambda name: F.col(name).cast("long").alias(name)
    return out.select("k", "depth", F.round("qual_by_depth", 6).alias("qual_by_depth"), "samples", "ac", long("an"), long("ncc"), F.round("gq_mean", 6).alias("gq_mean"), F.round("gq_sd", 6).alias("gq_sd"))


@query(f"with {VARIANTS}, x as (select *, flatten(list_transform(gts, lambda g: list_transform(regexp_extract_all(g, '[0-9]+'), lambda a: a::int))) called from variants) select k, array_to_string(list_filter([case when len(called) > 0 and len(list_filter(range(1, len(alts) + 1), lambda i: not list_contains(called, i::int))) > 0 then 'alternates that no genotype has' end, case when len(list_filter(called, lambda a: a > len(alts))) > 0 then 'a genotype has no such allele' end], lambda p: p is not null), ';') wrong from x")
def validate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir)
    return v.select("k", F.array_join(V.problems(v), ";").alias("wrong"))


@query(f"with {VARIANTS} select k, case when ref = 'CAGG' then start + 1 else start end as start, case ref when 'CAGG' then 'AG' else ref end as ref, case when ref = 'CAGG' then 'A' else array_to_string(alts, ',') end alts from variants")
def trim_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.trimmed_alleles(variants(spark, sf_dir))
    return out.select("k", F.col("start").cast("long").alias("start"), "ref", F.array_join("alts", ",").alias("alts"))


@query("with o as (select o_orderkey k, o_orderkey % 4 + 1 i, o_orderkey % 3 = 0 del from orders), x as (select k, del, (['TTAAAA', 'GGCACA', 'ACCTGG', 'ACTTGTTG'])[i] r, (['A', 'CA', 'G', 'TTG'])[i] u, ([4, 4, 2, 6])[i] m, (['T', 'G', 'T', 'C'])[i] b from o) select k, cast(100 - m as bigint) as start, case when del then b || u else b end as ref, case when del then b else b || u end alt from x")
def left_align_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indels of a repeat's unit at its right end move to its left end."""
    i = (F.col("o_orderkey") % 4).cast("int")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), i)
    before, unit = pick("TTAAAA", "GGCACA", "ACCTGG", "ACTTGTTG"), pick("A", "CA", "G", "TTG")
    anchor, deletion = F.right(before, F.lit(1)), F.col("o_orderkey") % 3 == 0
    joint = F.concat(anchor, unit)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(100).cast("long").alias("start"), F.when(deletion, joint).otherwise(anchor).alias("ref"), F.array(F.when(deletion, anchor).otherwise(joint)).alias("alts"), before.alias("before"))
    return V.left_aligned(o, F.col("before")).select("k", "start", "ref", F.get("alts", F.lit(0)).alias("alt"))


# Formats: what is written and read again


@query(f"with {READS} select trim(name) as name, flags, contig, start, \"end\", mapq, len(ops) n_ops, mate_contig, mate_start, tlen, bases, cast(case when len(quals) > 0 then list_sum(quals) end as bigint) quals, read_group, cast(nm as varchar) nm, optical, read_group is null or sample is not null grouped from reads")
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as text alignments in header order and read again, with their read groups."""
    r = read_view(spark, sf_dir)
    groups = r.select("read_group", "sample", "library", "platform", "platform_unit").filter("read_group is not null").groupBy("read_group").agg(*[F.min(c).alias(c) for c in ("sample", "library", "platform", "platform_unit")])
    tags = F.when(F.col("read_group").isNotNull(), F.map_concat("tags", F.create_map(F.lit("RG"), F.col("read_group")))).otherwise(F.col("tags"))
    path = scratch(spark, "sam")
    X.write_sam(r.drop("sample", "library", "platform", "platform_unit").withColumn("tags", tags), path, sequences(spark), groups)
    back = X.with_read_groups(X.read_sam(spark, path), X.read_read_groups(spark, path))
    total = F.when(F.size("quals") > 0, F.aggregate("quals", F.lit(0).cast("long"), lambda a, q: a + q))
    long = lambda x, name: x.cast("long").alias(name)
    return back.select("name", long(F.col("flags"), "flags"), "contig", long(F.col("start"), "start"), long(F.col("end"), "end"), long(F.col("mapq"), "mapq"), long(F.size("cigar"), "n_ops"), "mate_contig", long(F.col("mate_start"), "mate_start"), long(F.col("tlen"), "tlen"), "bases", total.alias("quals"), "read_group", F.col("tags")["NM"].alias("nm"), F.col("tags")["OD"].alias("optical"), (F.col("read_group").isNull() | F.col("sample").isNotNull()).alias("grouped"))


@query(f"with {READS} select trim(name) as name, flags, contig, start, \"end\", mapq, len(ops) n_ops, mate_contig, mate_start, tlen, bases, cast(list_sum(quals) as bigint) quals, read_group, cast(nm as varchar) nm from reads where length(bases) = len(quals)")
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as binary alignment files in header order, in shards, and read again."""
    r = read_view(spark, sf_dir).filter("length(bases) = size(quals)")
    tags = F.when(F.col("read_group").isNotNull(), F.map_concat("tags", F.create_map(F.lit("RG"), F.col("read_group")))).otherwise(F.col("tags"))
    path = scratch(spark, "bam")
    BAM.write_bam(r.withColumn("tags", tags), path, [(c, n) for c, n, _ in CONTIGS], ["rg0", "rg1"])
    back = BAM.read_bam(spark, path)
    total = F.when(F.size("quals") > 0, F.aggregate("quals", F.lit(0).cast("long"), lambda a, q: a + q))
    long = lambda x, name: x.cast("long").alias(name)
    return back.select("name", long(F.col("flags"), "flags"), "contig", long(F.col("start"), "start"), long(F.col("end"), "end"), long(F.col("mapq"), "mapq"), long(F.size("cigar"), "n_ops"), "mate_contig", long(F.col("mate_start"), "mate_start"), long(F.col("tlen"), "tlen"), "bases", total.alias("quals"), "read_group", F.col("tags")["NM"].alias("nm"))


@query(f"with {VARIANTS} select contig, start, \"end\", id, ref, array_to_string(alts, ',') alts, qual, array_to_string(filters, ';') filters, cast(dp as varchar) dp, 'a=' || ann ann, af, db, gts[1] || ' ' || gts[2] || ' ' || gts[3] calls, cast(gqs[2] as varchar) gq, cast(dps[3] as varchar) depth from variants")
def vcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with genotypes written as variant files and read again."""
    path = scratch(spark, "vcf")
    X.write_vcf(variants(spark, sf_dir), path, sequences(spark), SAMPLES, ['INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">'])
    back = X.read_vcf(spark, path)
    info, calls = F.col("info"), F.array_join(F.transform("genotypes", lambda g: F.coalesce(g["values"]["GT"], F.lit("./."))), " ")
    long = lambda x, name: x.cast("long").alias(name)
    return back.select("contig", long(F.col("start"), "start"), long(F.col("end"), "end"), "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", F.array_join("filters", ";").alias("filters"), info["DP"].alias("dp"), info["ANN"].alias("ann"), info["AF"].alias("af"), F.map_contains_key("info", "DB").alias("db"), calls.alias("calls"), V.field_of(F.col("genotypes"), "s1", "GQ").alias("gq"), V.field_of(F.col("genotypes"), "s2", "DP").alias("depth"))


@query(f"with {VARIANTS} select 'INFO' kind, 'DP' id, '1' number, 'Integer' as type, 'Depth, whole' description, count(*) n, count(*) filter (k % 2 = 0) n_first, cast(count(*) * 2 + count(*) filter (k % 2 = 0) as bigint) n_genotypes from variants")
def multi_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variant files with different samples, read as one table; and their declared fields."""
    v = variants(spark, sf_dir)
    one, two = scratch(spark, "vcf"), scratch(spark, "vcf")
    X.write_vcf(v.filter("k % 2 = 0"), one, sequences(spark), SAMPLES, ['INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, whole">'])
    X.write_vcf(v.filter("k % 2 = 1"), two, sequences(spark), SAMPLES[:2])
    both = X.read_variants(spark, [one, two])
    counts = both.agg(F.count("*").alias("n"), F.count_if(F.col("source") == 0).alias("n_first"), F.sum(F.size("genotypes")).cast("long").alias("n_genotypes"))
    return X.read_vcf_header(spark, [one, two]).filter("kind = 'INFO'").crossJoin(F.broadcast(counts))


@query(f"select contig, s as start, e as end, o_orderkey as name from ({SPANS})".replace("contig, s", "cast(contig as varchar) contig, s").replace("o_orderkey as name", "cast(o_orderkey as varchar) as name"))
def bed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bed")
    a = spans(spark, sf_dir).select(F.col("contig").cast("string").alias("contig"), "s", "e", F.col("o_orderkey").cast("string").alias("name"))
    X.write_bed(a, path, "contig", "s", "e", "name")
    spark.createDataFrame([("track name=x",), ("#c",), ("browser position 1",)], "value string").coalesce(1).write.mode("append").text(path)
    return X.read_bed(spark, path).select("contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name")


CHUNKED = "ref as (select n_name contig, repeat(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGN'), 150) || 'NNNNNNNN' bases from nation)"


def reference(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """A sequence of 4,808 bases for each nation, written as FASTA and read again as chunks."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("contig"), F.concat(F.repeat(F.translate(F.md5("n_name"), "0123456789abcdef", "ACGTACGTACGTACGN"), 150), F.lit("NNNNNNNN")).alias("bases"))
    path = scratch(spark, "fasta")
    REF.write_fasta(REF.chunks(n, size), path)
    return REF.read_fasta(spark, path, size)


@query(f"with {CHUNKED}, a as (select o_orderkey k, n_name contig, {day_sql('o_orderdate')} s, {day_sql('o_orderdate')} + o_orderkey % 1500 e from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey), x as (select k, greatest(s - 7, 1) as window_start, substr(bases, greatest(s - 7, 1), e + 3 - greatest(s - 7, 1) + 1) b from a join ref using (contig)) select k, window_start, md5(b) bases, round((length(b) - length(translate(b, 'GC', ''))) / nullif(length(b) - length(translate(b, 'N', '')), 0), 9) gc from x".replace("nullif(length(b) - length(translate(b, 'N', '')), 0)", "nullif(length(translate(b, 'N', '')), 0)"))
def reference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases of each interval, widened, over the borders of chunks; and their share of G and C, unknown bases left out."""
    named = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("contig"))
    a = table(spark, sf_dir, "orders").join(named, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), "contig", day("o_orderdate").alias("s"), (day("o_orderdate") + F.col("o_orderkey") % 1500).alias("e"))
    out = REF.reference_bases(a, reference(spark, sf_dir), ["k"], "contig", "s", "e", 7, 3, 1000)
    return out.select("k", F.col("window_start").cast("long").alias("window_start"), F.md5("bases").alias("bases"), F.round(REF.gc_share(F.col("bases")), 9).alias("gc"))


@query(f"with {CHUNKED}, t as (select contig, b, least(b + 99, 4808) e, substr(bases, b, 100) x from (select *, unnest(range(1, 4809, 100)) b from ref)) select contig, cast(b as bigint) bin_start, cast(e as bigint) bin_end, round((length(x) - length(translate(x, 'GC', ''))) / nullif(length(translate(x, 'N', '')), 0), 9) gc from t where length(translate(x, 'N', '')) > 0")
def annotated_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all contigs with their share of G and C; those of unknown bases only go."""
    ref = reference(spark, sf_dir)
    whole = REF.contig_lengths(ref).select("contig", F.lit(1).cast("long").alias("s"), F.col("length").alias("e"))
    bins = I.tile(whole, "s", "e", 100).select("contig", "bin_start", "bin_end")
    out = REF.without_unknown(REF.reference_bases(bins, ref, ["contig", "bin_start"], "contig", "bin_start", "bin_end", size=1000), F.col("bases"))
    return out.select("contig", "bin_start", "bin_end", F.round(REF.gc_share(F.col("bases")), 9).alias("gc"))


@query(f"with {READS} select regexp_replace(name, ' .*', '') as name, bases, cast(list_sum(quals) as bigint) quals from reads where length(bases) = len(quals) and length(bases) > 0")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "fastq")
    REF.write_fastq(read_view(spark, sf_dir).filter("length(bases) = size(quals) and length(bases) > 0"), path)
    return REF.read_fastq(spark, path).select("name", "bases", F.aggregate("quals", F.lit(0).cast("long"), lambda a, q: a + q).alias("quals"))


@query(f"with {READS} select k from reads where contig = 'chr2' and start <= 900 and \"end\" >= 700 or contig = 'chr4' and start <= 2100 and \"end\" >= 2000")
def partitioned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written by contig and bin; an interval query lists only the folders that may hold some."""
    path = scratch(spark, "partitioned")
    X.write_partitioned(read_view(spark, sf_dir).filter("contig is not null").select("k", "contig", "start", "end"), path, "contig", "start", 500)
    return X.read_partitioned(spark, path, "contig", "start", "end", 500, [("chr2", 700, 900), ("chr4", 2000, 2100)], 60).select("k")


@query("with p as (select n_nationkey k, n_name contig, n_nationkey % 4 i from nation) select contig, cast(k + 1 as bigint) as start, 'A' as ref, (['AAC', 'ATA', 'GA', 'AC'])[i + 1] bases, cast(([120, 120, 80, 80])[i + 1] as bigint) quals from p")
def pileup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pileup lines with read starts and ends and indels of other lengths, parsed."""
    i = (F.col("n_nationkey") % 4).cast("int")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), i)
    line = F.concat_ws("\t", "n_name", (F.col("n_nationkey") + 1).cast("string"), F.lit("a"), pick("3", "3", "2", "2"), pick("^I.,$c", ".+2ACt-10AAAAAAAAAAa", "g-1t,", "^+.^$C"), pick("III", "III", "II", "II"))
    path = scratch(spark, "pileup")
    table(spark, sf_dir, "nation").select(line).write.text(path)
    return X.read_pileup(spark, path).select("contig", F.col("start").cast("long").alias("start"), "ref", "bases", F.aggregate("quals", F.lit(0).cast("long"), lambda a, q: a + q).alias("quals"))


@query("select n_name contig, cast(n_nationkey * 10 + 1 as bigint) as start, cast(n_nationkey * 10 + 5 as bigint) as end, 'gene ' || n_nationkey gene_id, 'basic' tag, case when n_nationkey % 2 = 0 then 0.5::double end score from nation")
def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene lines with a repeated attribute: the first counts."""
    c = F.col("n_nationkey")
    attributes = F.concat(F.lit('gene_id "gene '), c.cast("string"), F.lit('"; level 2; tag "basic"; tag "other";'))
    line = F.concat_ws("\t", "n_name", F.lit("x"), F.lit("gene"), (c * 10 + 1).cast("string"), (c * 10 + 5).cast("string"), F.when(c % 2 == 0, "0.5").otherwise("."), F.lit("+"), F.lit("."), attributes)
    path = scratch(spark, "gtf")
    table(spark, sf_dir, "nation").select(line).write.text(path)
    return X.read_gtf(spark, path).select("contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "gene_id", F.col("attributes")["tag"].alias("tag"), "score")


@query("with p as (select cast(c_nationkey as varchar) family, c_custkey k, case when c_custkey % 3 = 0 then c_custkey - 25 end f, case when c_custkey % 4 <> 3 then c_custkey - 50 end m, c_nationkey n from customer) select a.family, cast(a.k as varchar) child, cast(a.f as varchar) father, cast(a.m as varchar) mother from p a join p b on b.k = a.f and b.n = a.n join p c on c.k = a.m and c.n = a.n where a.f > 0 and a.m > 0")
def pedigree_trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedigree lines; trios are samples with both parents in the family."""
    k = F.col("c_custkey")
    parent = lambda keep, away: F.when(keep & (k - away > 0), (k - away).cast("string")).otherwise("0")
    line = F.concat_ws("\t", F.col("c_nationkey").cast("string"), k.cast("string"), parent(k % 3 == 0, 25), parent(k % 4 != 3, 50), F.lit("1"), F.lit("2"))
    path = scratch(spark, "ped")
    table(spark, sf_dir, "customer").select(line).write.text(path)
    return X.trios(X.read_pedigree(spark, path))


@query("with o as (select o_orderkey k, o_orderkey % 5 i, o_custkey c from orders) select k, case i when 4 then 'HLA:' || c else 'chr' || c end contig, cast(case i when 0 then 1 else 1000 + c end as bigint) as start, cast(case i when 0 then 2147483647 when 1 then 1000 + c when 2 then 2147483647 else 2000 + c end as bigint) as end from o")
def interval_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as users write them."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    text = lambda x: F.format_number(x, 0)
    chr_ = F.concat(F.lit("chr"), c.cast("string"))
    forms = [chr_, F.concat(chr_, F.lit(":"), text(1000 + c)), F.concat(chr_, F.lit(":"), text(1000 + c), F.lit("+")), F.concat(chr_, F.lit(":"), (1000 + c).cast("string"), F.lit("-"), text(2000 + c)), F.concat(F.lit("HLA:"), c.cast("string"), F.lit(":"), text(1000 + c), F.lit("-"), text(2000 + c))]
    return table(spark, sf_dir, "orders").select(k.alias("k"), X.parse_interval(F.get(F.array(*forms), (k % 5).cast("int"))).alias("i")).select("k", "i.*")


@query("select n_name contig, cast(n_nationkey + 1 as bigint) as start, cast(n_nationkey + 9 as bigint) as end, cast(n_regionkey as varchar) as a, 'x' || n_nationkey as b from nation")
def interval_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose header row names values after an interval column."""
    n = table(spark, sf_dir, "nation")
    line = F.concat_ws("\t", F.concat("n_name", F.lit(":"), (F.col("n_nationkey") + 1).cast("string"), F.lit("-"), (F.col("n_nationkey") + 9).cast("string")), F.col("n_regionkey").cast("string"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")))
    path = scratch(spark, "table")
    n.select(F.lit(1).alias("o"), line.alias("value")).unionByName(spark.createDataFrame([(0, "HEADER region label")], "o int, value string")).orderBy("o").select("value").write.text(path)
    return X.read_interval_table(spark, path).select("contig", "start", "end", F.col("values")["region"].alias("a"), F.col("values")["label"].alias("b"))


@query("with b as (select s_suppkey contig, unnest([5, 15, 25, 47]) s, unnest([14, 24, 27, 140]) e from supplier), p as (select l_suppkey contig, " + day_sql("l_shipdate") + " % 200 d from lineitem) select b.contig, cast(b.s as bigint) s, cast(b.e as bigint) e, count(p.d) n from b left join p on p.contig = b.contig and p.d between b.s and b.e group by all")
def count_in_uneven_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that begin anywhere and end early."""
    bins = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contig"), F.explode(F.arrays_zip(F.array(*map(F.lit, (5, 15, 25, 47))).alias("s"), F.array(*map(F.lit, (14, 24, 27, 140))).alias("e"))).alias("x")).select("contig", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), (day("l_shipdate") % 200).alias("d"))
    return I.count_starts(bins, points, "contig", "s", "e", "d", 30)


@query("with d as (select o_orderkey k, case when o_custkey % 3 <> 0 then o_custkey end g, case when o_orderkey % 10 <> 0 then floor(o_totalprice) end s from orders), r as (select *, row_number() over (partition by g order by s desc nulls last, k) r, max(s) over (partition by g) m from d) select k, r > 1 duplicate, coalesce(s >= 0.9::double * m, false) best from r")
def null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates and best hits where a third of all rows has no group, and a tenth no score."""
    from ..operators import aggregates as A
    from ..operators import windows as W

    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("g"), F.when(F.col("o_orderkey") % 10 != 0, F.floor("o_totalprice")).alias("s"))
    marked = W.mark_duplicates(d, [F.col("g")], F.col("s"), F.col("k"))
    best = A.best_hits(d, "g", "s", 0.1).select("k", F.lit(True).alias("best"))
    return marked.join(best, "k", "left").select("k", "duplicate", F.coalesce("best", F.lit(False)).alias("best"))
