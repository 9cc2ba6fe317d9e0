"""Queries of whole tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools as T
from ..functions import scalars as S
from ..operators import blocks as B
from ..sources.shared import scratch
from .analytics import PILED
from .catalog import query, table
from .reads import MARKED, READS
from .reads import reads as read_view
from .variants import CHUNKED, TYPE, VARIANTS, reference, variants


@query(f"{MARKED}, f as (select m.k, (m.flags & 1024) <> 0 old, coalesce(alld.dup, false) now from m left join alld using (k)) select count(*) filter (old and now) \"both\", count(*) filter (old and not now) only_left, count(*) filter (now and not old) only_right, count(*) filter (not old and not now) neither, 0::bigint unmatched from f")
def compare_duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of the reads against newly marked ones; unmarked first, so nothing old is left."""
    r = read_view(spark, sf_dir)
    return T.compare_duplicates(r, T.mark_duplicates(T.unmark_duplicates(r), "k"), "k")


@query(f"with {READS}, p as (select unnest(quals) a, unnest(list_transform(quals, lambda q: case when q > 30 then 30 else q end)) b from reads) select a, b, count(*) n from p group by all")
def compare_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_view(spark, sf_dir)
    capped = r.withColumn("quals", F.transform("quals", lambda q: F.least(q, F.lit(30))))
    return T.compare_base_qualities(r, capped, "k").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


@query(f"with {READS} select coalesce(sample, 'none') as sample, count(*) n, count(*) filter (sample is not null) > 0 listed from reads group by 1")
def split_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written to a folder for each sample and read again, and whether a sample is listed."""
    r = read_view(spark, sf_dir).drop("tags")
    path = scratch(spark, "split")
    T.split_reads(r, path, ["sample"])
    names = T.get_sample_name(r).withColumn("listed", F.lit(True))
    back = spark.read.parquet(path).groupBy("sample").agg(F.count("*").alias("n"))
    return back.join(names, "sample", "left").select(F.coalesce("sample", F.lit("none")).alias("sample"), "n", F.coalesce("listed", F.lit(False)).alias("listed"))


@query(f"with {READS}, p as (select k, start, cigar, unnest(case cigar when '5M10N15M' then [1, 2] when '3M10N2D20N17M' then [1, 2, 3] else [1] end) i from reads) select k, cast(i - 1 as bigint) piece, cast(start + case when cigar = '5M10N15M' and i = 2 then 15 when cigar = '3M10N2D20N17M' then ([0, 13, 35])[i] else 0 end as bigint) as start, case when cigar = '*' then '' when cigar = '5M10N15M' then (['5M15S', '5S15M'])[i] when cigar = '3M10N2D20N17M' then (['3M17S', '3S2D17S', '3S17M'])[i] else cigar end cigar from p")
def split_skipped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.split_n_cigar_reads(read_view(spark, sf_dir), "k")
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    return out.select("k", F.col("piece").cast("long").alias("piece"), F.col("start").cast("long").alias("start"), cigar.alias("cigar"))


@query(f"with {READS}, v as (select 'chr' || (o_custkey % 5 + 1) c, o_orderkey % 2400 + 1 s from orders where o_orderkey % 4 = 0) select k, count(v.s) n from reads left join v on contig = c and s between start and \"end\" group by k")
def reads_over_known_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0")
    known = o.select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("contig"), (F.col("o_orderkey") % 2400 + 1).alias("start"), (F.col("o_orderkey") % 2400 + 1).alias("end"))
    return T.reads_with_variants(read_view(spark, sf_dir), known, "k", 50).select("k", F.col("n_overlaps").alias("n"))


@query(f"with {READS}, t as (select *, k // 6 g, flags & 192 num, (flags & 2048) <> 0 extra, (flags & 260) = 0 ok, contig || ',' || start || ',' || case when (flags & 16) <> 0 then '-' else '+' end || ',' || cigar || ',' || mapq || ',' || nm e from reads) select a.k, case when a.ok then (select string_agg(b.e, ';' order by b.extra, b.k) || ';' from t b where b.g = a.g and b.num = a.num and b.ok and b.k <> a.k) end sa from t a")
def supplementary_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six reads in a row share a name here, so that reads have several alignments."""
    r = read_view(spark, sf_dir).withColumn("name", F.floor(F.col("k") / 6).cast("string"))
    return T.supplementary_tags(r, "name", "k").select("k", "sa")


@query(f"{PILED}, l as (select contig, place, count(*) filter (base = 'A') a, count(*) filter (base = 'C') c, count(*) filter (base = 'G') g, count(*) filter (base = 'T') t from pile where (flags & (4 + 256 + 512 + 1024 + 2048)) = 0 group by all), v as (select contig, start, min((ref, alt, af::double)) x from (select contig, d * 1 + k % 7 + 1 as start, ref, alt, case when alt in ('G', 'C') then (k % 30) / 100.0 else 0.5 end af, alts, k from (select *, (start - k % 7 - 1) // 7 d from variants)) where len(alts) = 1 and length(ref) = 1 and length(alt) = 1 and alt <> '' and af between 0.01 and 0.2 group by all), j as (select l.*, x[1] r, x[2] al, x[3] af from l join v on l.contig = v.contig and l.place = v.start), z as (select *, case r when 'A' then a when 'C' then c when 'G' then g else t end rc, case al when 'A' then a when 'C' then c when 'G' then g else t end ac from j) select contig, cast(place as bigint) as start, rc ref_count, ac alt_count, a + c + g + t - rc - ac other_alt_count, af allele_frequency from z".replace(f"with {READS}", f"with {READS}, {VARIANTS}", 1))
def pileup_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of filtered reads at known sites of a frequency."""
    v = variants(spark, sf_dir)
    d = F.floor((F.col("start") - F.col("k") % 7 - 1) / 7)
    share = F.when(F.get("alts", F.lit(0)).isin("G", "C"), (F.col("k") % 30) / 100.0).otherwise(0.5)
    known = v.withColumns({"start": (d + F.col("k") % 7 + 1).cast("int"), "info": F.create_map(F.lit("AF"), share.cast("string"))})
    loci = T.pileup(read_view(spark, sf_dir), "k")
    return T.get_pileup_summaries(loci, known).select("contig", F.col("start").cast("long").alias("start"), "ref_count", "alt_count", "other_alt_count", "allele_frequency")


@query(f"with {READS}, {VARIANTS} select v.k, count(r.k) bam_depth from variants v left join reads r on r.contig = v.contig and r.start <= v.\"end\" and v.start <= r.\"end\" group by v.k")
def sites_with_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.annotate_with_depth(variants(spark, sf_dir), read_view(spark, sf_dir), "k", 50).select("k", "bam_depth")


LOCI = f"{PILED}, l as (select 'chr' || (k % 2) contig0, contig, place, base from pile), m as (select n_name contig, place, count(*) depth, count(*) filter (base = 'A') a, count(*) filter (base = 'C') c, count(*) filter (base = 'G') g, count(*) filter (base = 'T') t from l join nation on n_nationkey = cast(substr(contig, 4) as int) group by all)"


@query(f"{LOCI}, {CHUNKED}, b as (select m.*, substr(bases, cast(place as bigint), 1) r from m join ref using (contig)), ob as (select *, case r when 'A' then a when 'C' then c when 'G' then g else t end nr, list_max(list_filter([{{'n': t, 'b': 'T'}}, {{'n': g, 'b': 'G'}}, {{'n': c, 'b': 'C'}}, {{'n': a, 'b': 'A'}}], lambda z: z.b <> r)) y from b where r in ('A', 'C', 'G', 'T')), s as (select *, y.n na, nr * log10(0.999::double) + y.n * log10(0.001::double) l0, (nr + y.n) * log10(0.5::double) l1, nr * log10(0.001::double) + y.n * log10(0.999::double) l2 from ob where y.n > 0) select contig, cast(place as bigint) as \"at\", r as ref, y.b alt, depth, cast(case when l2 = greatest(l0, l1, l2) then 2 when l1 = greatest(l0, l1, l2) then 1 else 0 end as bigint) genotype, round(10 * (greatest(l1, l2) - l0), 6) qual from s where 10 * (greatest(l1, l2) - l0) >= 10 and greatest(l1, l2) >= l0")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNP calls of pileups against a reference (contigs named after nations)."""
    elements = B.pileup(read_view(spark, sf_dir), "k")
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("contig"), F.col("n_name").alias("named"))
    loci = B.loci(elements.join(F.broadcast(names), "contig").drop("contig").withColumnRenamed("named", "contig"))
    out = T.call_sites(loci, reference(spark, sf_dir), size=1000)
    return out.select("contig", F.col("at").cast("long").alias("at"), "ref", "alt", "depth", F.col("genotype").cast("long").alias("genotype"), F.round("qual", 6).alias("qual"))


@query(f"with {VARIANTS}, c as (select contig, start, ref, unnest(list_filter([1, 2, 3], lambda j: regexp_matches(gts[j], '[1-9]'))) j, qual, dp from variants), p as (select contig, start, ref, count(distinct j) n_samples from c group by all having count(distinct j) >= 2) select v.k, array_to_string(case when len(f) = 0 then ['PASS'] else f end, ';') filters from (select v.k, list_filter([case when p.n_samples is not null then 'panel_of_normals' end, case when v.dp / 20.0 < 5.3 then 't_lod' end, case when (v.k % 50) / 100.0::double < 0.05 then 'contamination' end, case when v.k % 4 > 2 then 'clustered_events' end], lambda x: x is not null) f from variants v left join p on v.contig = p.contig and v.start = p.start and v.ref = p.ref) v")
def somatic_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of sites that two samples have, and the filters of calls."""
    from ..operators import variants as V

    v = variants(spark, sf_dir)
    calls = v.select("contig", "start", "ref", F.explode(F.filter("genotypes", lambda g: V.is_variant_call(g["values"]["GT"]))).alias("g")).select("contig", "start", "ref", F.col("g.sample").alias("sample"))
    panel = T.panel_of_normals(calls)
    own = v.select("k", "contig", "start", "ref", (F.col("info")["DP"].cast("int") / 20.0).alias("lod"), ((F.col("k") % 50) / 100.0).alias("af"), (F.col("k") % 4).alias("events"))
    return T.filter_somatic_calls(own, panel, 0.05).select("k", F.array_join("filters", ";").alias("filters"))


@query(f"with {VARIANTS}, x as (select k, ref, alt, t % 13 f1, k % 11 f2 from variants where length(ref) = 1 and length(alt) = 1), y as (select *, case when (ref = 'C' and alt = 'T') or (ref = 'G' and alt = 'T') then f2 / nullif(f1 + f2, 0) when (ref = 'G' and alt = 'A') or (ref = 'C' and alt = 'A') then f1 / nullif(f1 + f2, 0) end fob from x) select k, round(fob, 9) fob, coalesce(fob > 0.7, false) orientation_bias from y".replace("t % 13 f1", "dp % 13 f1"))
def orientation_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).filter("length(ref) = 1 and size(alts) = 1 and length(alts[0]) = 1")
    calls = v.select("k", "ref", F.get("alts", F.lit(0)).alias("alt"), (F.col("info")["DP"].cast("int") % 13).alias("alt_f1r2"), (F.col("k") % 11).alias("alt_f2r1"))
    out = T.filter_by_orientation_bias(calls, [("C", "T"), ("G", "T")], 0.7)
    return out.select("k", F.round("fob", 9).alias("fob"), "orientation_bias")


@query(f"with {VARIANTS}, k as (select {TYPE} as type from variants where coalesce(len(filters) = 0, true)), t as (select c_nationkey contig, c_custkey * 3 s, c_custkey * 3 + c_custkey % 40 e from customer), m as (select *, case when s <= max(e) over (partition by contig order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end o from t), i as (select *, sum(o) over (partition by contig order by s, e rows unbounded preceding) g from m), z as (select sum(e - s + 1) w from (select min(s) s, max(e) e from i group by contig, g)) select (select count(*) from k where type = 'SNP') snps, (select count(*) from k where type = 'INDEL') indels, cast(w as bigint) territory, round((select count(*) from k where type = 'SNP') * 1e6 / w, 6) snps_per_million, round((select count(*) from k where type = 'INDEL') * 1e6 / w, 6) indels_per_million from z")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    targets = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("contig"), (c * 3).alias("start"), (c * 3 + c % 40).alias("end"))
    out = T.count_false_positives(variants(spark, sf_dir), targets)
    return out.withColumns({x: F.round(x, 6) for x in ("snps_per_million", "indels_per_million")})


@query(f"with {VARIANTS}, g as (select 'chr' || (n_nationkey % 5 + 1) contig, n_name gene, n_nationkey * 900 + 100 s from nation), f as (select contig, gene, unnest(['gene', 'transcript', 'exon', 'CDS']) f, unnest([s, s, s + 50, s + 80]) s, unnest([s + 600, s + 600, s + 300, s + 200]) e from g), h as (select v.k, f.gene, case when v.start <= f.e and v.\"end\" >= f.s then case f.f when 'CDS' then 0 when 'exon' then 2 when 'transcript' then 3 else 4 end else 5 end r from variants v join f on v.contig = f.contig and v.start <= f.e + 30 and v.\"end\" >= f.s - 30), b as (select k, min((r, gene)) x from h group by 1) select v.k, x[2] gene, coalesce((['CODING', 'UTR', 'EXON', 'INTRON', 'GENE', 'FLANK'])[x[1] + 1], 'IGR') variant_class from variants v left join b using (k)")
def gene_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("n_nationkey") * 900 + 100
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), (s + a).alias("start"), (s + b).alias("end")) for f, a, b in (("gene", 0, 600), ("transcript", 0, 600), ("exon", 50, 300), ("CDS", 80, 200))])
    genes = table(spark, sf_dir, "nation").select(F.concat(F.lit("chr"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("contig"), F.col("n_name").alias("gene_id"), F.explode(parts).alias("x")).select("contig", "gene_id", "x.*")
    return T.annotate_genes(variants(spark, sf_dir), genes, "k", 30, 500).select("k", "gene", "variant_class")


@query("with recursive t as (select c_custkey n, c_custkey // 3 p from customer), r as (select n, n a, 0 d from t union all select r.n, t.p, d + 1 from r join t on r.a = t.n where t.p <> t.n) select n as node, a as ancestor, cast(d as bigint) depth from r")
def taxonomy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree: each one's parent is a third of its key; the root is 0."""
    tree = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.floor(F.col("c_custkey") / 3).alias("p"))
    return T.tree_paths(tree, "n", "p", 0).select("node", "ancestor", F.col("depth").cast("long").alias("depth"))


@query("with recursive t as (select c_custkey n, c_custkey // 3 p from customer), r as (select n, n a, 0 d from t union all select r.n, t.p, d + 1 from r join t on r.a = t.n where t.p <> t.n), h as (select distinct c_nationkey g, c_custkey n from customer where c_custkey % 97 = c_nationkey), c as (select g, count(*) c from h group by 1), u as (select g, a, count(*) b, min(d) d from h join r using (n) group by all) select g, min_by(a, d) lca from u join c using (g) where b = c group by g")
def common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    paths = T.tree_paths(c.select(F.col("c_custkey").alias("n"), F.floor(F.col("c_custkey") / 3).alias("p")), "n", "p", 0)
    hits = c.filter("c_custkey % 97 = c_nationkey").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("n"))
    return T.lowest_common_ancestor(hits, "g", "n", paths).select("g", "lca")


@query()
def host_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads left after all steps of host subtraction, the host's k-mers being those of a third of the reads. A test recounts it."""
    r = read_view(spark, sf_dir)
    host = r.filter("k % 3 = 0 and length(bases) > 0").select(F.explode(S.kmers(F.col("bases"), 9)).alias("kmer")).filter("kmer rlike '^A'")
    return T.subtract_host(r, host, 9, "k", shortest=8).select("k", "name", "bases")


@query(f"with {READS} select contig, start // 500 bin, count(*) n, min(start) least, max(\"end\") most from reads where contig is not null group by all")
def feature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.index_features(read_view(spark, sf_dir).filter("contig is not null"), "contig", "start", "end", 500)
    return out.select("contig", "bin", "n", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"))


@query("with s as (select o_custkey site, o_orderkey k, o_orderkey % 3 g from orders where o_custkey < 300) select site, 2 * count(*) an from s group by 1")
def joint_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of several samples by the exact model (its counts are tested against all genotypes); here how many alleles each has."""
    o = table(spark, sf_dir, "orders").filter("o_custkey < 300")
    gl = F.array(*[(-5.0 * F.abs(F.col("o_orderkey") % 3 - g)).cast("double") for g in range(3)])
    out = T.genotype_samples(o.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("sample"), gl.alias("gl")), ["site"], "sample")
    return out.select("site", F.col("an").cast("long").alias("an"))
