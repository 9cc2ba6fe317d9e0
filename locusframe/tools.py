"""Whole tasks, each a short composition of operators: from tables of reads, variants and intervals to a table or files.

``TOOLS`` lists them by name, so that a driver script can pick one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extensions import transformed
from .functions.joins import if_small, null_safe
from .operators import blocks, callsets, duplicates, filters, intervals, kernels, readsets, sites, transforms, variants
from .sources import reference as refs
from .sources import text
from .sources.shared import stored

TOOLS: dict[str, Callable[..., Any]] = {}


def tool(f: Callable[..., Any]) -> Callable[..., Any]:
    TOOLS[f.__name__] = f
    return f


# Reads


@tool
def print_reads(reads: DataFrame, names: list[str] = (), before: list[str] = (), after: list[str] = ()) -> DataFrame:
    """Reads that pass named filters, between named transforms."""
    return transformed(reads, list(before), list(names), list(after))


@tool
def sort_reads(reads: DataFrame, contigs: list[str], key: str) -> DataFrame:
    return readsets.sort_by_coordinate(reads, contigs, key)


@tool
def get_sample_name(reads: DataFrame) -> DataFrame:
    """The samples of a table of reads; a caller that needs one takes more than one row as an error."""
    return reads.select("sample").filter("sample is not null").distinct()


@tool
def split_reads(reads: DataFrame, path: str, by: list[str]) -> None:
    """Reads in folders by sample, library or read group; null is a folder too."""
    reads.write.partitionBy(*by).parquet(path)


@tool
def mark_duplicates(reads: DataFrame, key: str) -> DataFrame:
    """Reads with the duplicate flag set or cleared."""
    marked = duplicates.mark_duplicates(reads, key)
    return marked.withColumn("flags", F.when(F.col("duplicate"), F.col("flags").bitwiseOR(0x400)).otherwise(F.col("flags").bitwiseAND(F.lit(~0x400)))).drop("duplicate")


@tool
def unmark_duplicates(reads: DataFrame) -> DataFrame:
    return duplicates.unmarked(reads)


@tool
def compare_duplicates(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    told = lambda d: d.select(key, filters.flag(0x400).alias("duplicate"))
    return duplicates.compare_duplicates(told(left), told(right), key)


@tool
def compare_base_qualities(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return readsets.compare_qualities(left, right, key)


@tool
def revert_base_quality_scores(reads: DataFrame) -> DataFrame:
    return readsets.reverted_qualities(reads)


@tool
def clip_reads(reads: DataFrame, threshold: int | None = None, places: tuple[int, int] | None = None, adapters: list[str] = ()) -> DataFrame:
    """Hard-clipped bases and qualities: to a span of places, at adapters, then at ends of low quality."""
    out = reads
    if places is not None:
        both = transforms.clip_to(F.col("bases"), F.col("quals"), F.lit(places[0]), F.lit(places[1]))
        out = out.withColumn("clipped", both).withColumns({"bases": F.col("clipped.bases"), "quals": F.col("clipped.quals")}).drop("clipped")
    if adapters:
        out = out.withColumn("bases", transforms.trim_adapter(F.col("bases"), list(adapters), 1, 8)).withColumn("quals", F.slice("quals", F.lit(1), F.length("bases")))
    if threshold is not None:
        cut = transforms.clip_ends(F.col("quals"), threshold)
        out = out.withColumn("cut", cut).withColumn("clipped", transforms.clip_to(F.col("bases"), F.col("quals"), F.col("cut.first"), F.col("cut.last")))
        out = out.withColumns({"bases": F.col("clipped.bases"), "quals": F.col("clipped.quals")}).drop("cut", "clipped")
    return out


@tool
def split_n_cigar_reads(reads: DataFrame, key: str) -> DataFrame:
    """A row for each stretch of a read between skipped references (N): its number, start and CIGAR, the other bases soft-clipped. Reads without N stay whole."""
    ops = F.col("cigar")
    size = lambda x, letters: F.when(x["op"].isin(*letters), x["len"]).otherwise(0)
    total = lambda xs, letters: F.aggregate(xs, F.lit(0), lambda a, x: a + size(x, letters))
    gaps = F.filter(F.transform(ops, lambda x, i: F.when(x["op"] == "N", i + 1)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(0)), gaps, F.array(F.size("cigar") + 1))
    rows = reads.withColumn("edges", edges).withColumn("piece", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)))
    first, last = F.get("edges", F.col("piece")), F.get("edges", F.col("piece") + 1)
    before = F.when(first > 0, F.slice(ops, F.lit(1), first)).otherwise(F.slice(ops, F.lit(1), F.lit(0)))
    own = F.slice(ops, first + 1, F.greatest(last - first - 1, F.lit(0)))
    after = F.slice(ops, last, F.greatest(F.size("cigar") - last + 1, F.lit(0)))
    clip = lambda n: F.when(n > 0, F.array(F.struct(n.alias("len"), F.lit("S").alias("op")))).otherwise(F.array().cast("array<struct<len:int,op:string>>"))
    hidden = "MIS=X"
    out = rows.withColumns({"own": own, "left": F.when(F.col("piece") > 0, total(before, hidden)).otherwise(0), "right": F.when(last <= F.size("cigar"), total(after, hidden)).otherwise(0), "moved": total(before, "MDN=X")})
    cigar = F.concat(clip(F.col("left")), F.col("own"), clip(F.col("right")))
    return out.withColumns({"new_cigar": cigar, "new_start": F.col("start") + F.col("moved")}).drop("cigar", "start", "edges", "own", "left", "right", "moved").withColumnsRenamed({"new_cigar": "cigar", "new_start": "start"})


@tool
def reads_with_reference(reads: DataFrame, reference: DataFrame, key: str, before: int = 0, after: int = 0, size: int = refs.CHUNK) -> DataFrame:
    """Reads with the reference bases that they cover."""
    named = reads.withColumnRenamed("bases", "read_bases")
    return refs.reference_bases(named, reference, [key], "contig", "start", "end", before, after, size).withColumnsRenamed({"bases": "reference_bases", "read_bases": "bases"})


@tool
def reads_with_variants(reads: DataFrame, known: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Each read with how many known sites it covers."""
    side = known.select(F.col("contig").alias("site_contig"), F.col("start").alias("site_start"), F.col("end").alias("site_end"))
    return intervals.overlap_join(reads, side, ("contig", "start", "end"), ("site_contig", "site_start", "site_end"), width, "count", key)


@tool
def supplementary_tags(reads: DataFrame, name: str, key: str) -> DataFrame:
    """Mapped reads with the tag SA: for each other alignment of the same read (name and number of pair) contig, start, strand, CIGAR, quality and differences, the primary one first."""
    number = F.col("flags").bitwiseAND(0xC0)
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    entry = F.concat_ws(",", "contig", F.col("start").cast("string"), F.when(filters.flag(0x10), "-").otherwise("+"), cigar, F.col("mapq").cast("string"), F.coalesce(F.col("tags")["NM"], F.lit("0")))
    mapped = reads.filter(~filters.flag(4) & ~filters.flag(0x100))
    own = mapped.select(F.col(name).alias("own_name"), number.alias("number"), F.struct(filters.flag(0x800).alias("extra"), F.col(key).alias("key"), entry.alias("entry")).alias("e"))
    lists = own.groupBy("own_name", "number").agg(F.sort_array(F.collect_list("e")).alias("es")).filter("size(es) > 1")  # a read's own alignments
    joined = reads.withColumn("number", number).join(lists, (F.col(name) == F.col("own_name")) & (lists["number"] == number), "left").drop(lists["number"]).drop("own_name", "number")
    others = F.filter("es", lambda e: e["key"] != F.col(key))
    text_ = F.when(~filters.flag(4) & ~filters.flag(0x100) & (F.size(others) > 0), F.concat(F.array_join(F.transform(others, lambda e: e["entry"]), ";"), F.lit(";")))
    return joined.withColumn("sa", text_).drop("es")


# Loci and variants


@tool
def pileup(reads: DataFrame, key: str, names: list[str] = ("mapped", "not_duplicate", "not_secondary", "not_supplementary", "passes_vendor_check")) -> DataFrame:
    """Loci of filtered reads with their depth and bases."""
    return blocks.loci(blocks.pileup(transformed(reads, filters=list(names)), key))


@tool
def check_pileup(loci: DataFrame, lines: DataFrame) -> DataFrame:
    """Loci whose depth differs from that of pileup lines (contig, start, depth), or that only one of them has."""
    theirs = lines.select("contig", F.col("start").alias("at"), F.col("depth").alias("theirs"))
    both = loci.select("contig", "at", F.col("depth").alias("ours")).join(theirs, ["contig", "at"], "full")
    return both.filter(~F.col("ours").eqNullSafe(F.col("theirs")))


@tool
def get_pileup_summaries(loci: DataFrame, known: DataFrame, least: float = 0.01, most: float = 0.2) -> DataFrame:
    """contig, start, counts of the reference, alternate and other bases, and allele_frequency, at known biallelic SNPs whose frequency (info AF) lies in a range. Of sites that start together the first counts."""
    af = F.col("info")["AF"].try_cast("double")
    snps = known.filter((filters.variant_type(F.col("ref"), F.col("alts")) == "SNP") & (F.size("alts") == 1) & (af >= least) & (af <= most))
    one = snps.groupBy("contig", "start").agg(F.min(F.struct("ref", F.get("alts", F.lit(0)).alias("alt"), af.alias("allele_frequency"))).alias("s")).select("contig", "start", "s.*")
    of = lambda letter: reduce(lambda a, b: a + b, (F.when(letter == x.upper(), F.col(x)).otherwise(0) for x in "acgt"))
    found = loci.join(if_small(one), (loci["contig"] == one["contig"]) & (loci["at"] == one["start"])).drop(loci["contig"])
    ref, alt = of(F.col("ref")), of(F.col("alt"))
    return found.select("contig", "start", ref.cast("long").alias("ref_count"), alt.cast("long").alias("alt_count"), (F.col("a") + F.col("c") + F.col("g") + F.col("t") - ref - alt).cast("long").alias("other_alt_count"), "allele_frequency")


@tool
def annotate_with_depth(sites_: DataFrame, reads: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """Sites with how many reads cover them."""
    side = reads.filter("contig is not null").select(F.col("contig").alias("read_contig"), F.col("start").alias("read_start"), F.col("end").alias("read_end"))
    return intervals.overlap_join(sites_, side, ("contig", "start", "end"), ("read_contig", "read_start", "read_end"), width, "count", key).withColumnRenamed("n_overlaps", "bam_depth")


@tool
def call_sites(loci: DataFrame, reference: DataFrame, quality: int = 30, least: float = 10.0, size: int = refs.CHUNK) -> DataFrame:
    """Diploid SNP calls from loci: contig, at, ref, alt (the commonest other base), depth, genotype (alternate alleles), qual.

    All bases count with one quality.  Assembly of regions is not part of it.
    """
    named = refs.reference_bases(loci.withColumn("until", F.col("at")), reference, ["contig", "at"], "contig", "at", "until", size=size)
    ref = F.upper("bases")
    entries = F.array(*[F.struct(F.col(b.lower()).alias("n"), F.lit(b).alias("base")) for b in "TGCA"])
    other = F.array_max(F.filter(entries, lambda e: e["base"] != F.col("ref")))
    rows = named.withColumn("ref", ref).filter(F.col("ref").isin(*"ACGT")).withColumn("other", other).filter("other.n > 0")
    n_alt = F.col("other.n").cast("double")
    n_ref = reduce(lambda a, b: a + b, (F.when(F.col("ref") == x.upper(), F.col(x)).otherwise(0) for x in "acgt")).cast("double")
    e = 10 ** (-quality / 10)
    import math

    right, wrong, half = math.log10(1 - e), math.log10(e), math.log10(0.5)
    l0, l1, l2 = n_ref * right + n_alt * wrong, (n_ref + n_alt) * half, n_ref * wrong + n_alt * right
    top = F.greatest(l0, l1, l2)
    out = rows.select("contig", "at", "ref", F.col("other.base").alias("alt"), "depth", F.when(l2 == top, 2).when(l1 == top, 1).otherwise(0).alias("genotype"), (10 * (F.greatest(l1, l2) - l0)).alias("qual"))
    return out.filter((F.col("genotype") > 0) & (F.col("qual") >= least))


@tool
def genotype_samples(likelihoods: DataFrame, site: list[str], sample: str) -> DataFrame:
    """Joint genotyping of likelihoods (gl: log10 by genotype) of samples at the same sites: site, ac, an and qual by the exact model."""
    rows = likelihoods.groupBy(*site).agg(F.sort_array(F.collect_list(F.struct(sample, "gl"))).alias("s"))  # a site's samples
    keyed = rows.withColumn("site_key", F.to_json(F.struct(*site))).withColumn("gls", F.transform("s", lambda x: x["gl"]))
    found = kernels.allele_counts(keyed, "site_key", "gls")
    return keyed.select(*site, "site_key", (2 * F.size("gls")).alias("an")).join(found, "site_key").drop("site_key")


@tool
def panel_of_normals(callsets_: DataFrame, least: int = 2) -> DataFrame:
    """Sites that at least so many samples have: contig, start, ref, n_samples. callsets_: contig, start, ref, sample."""
    return callsets_.groupBy("contig", "start", "ref").agg(F.countDistinct("sample").alias("n_samples")).filter(F.col("n_samples") >= least)


@tool
def filter_somatic_calls(calls: DataFrame, panel: DataFrame, contamination: float = 0.0, least_lod: float = 5.3, most_events: int = 2) -> DataFrame:
    """Calls (contig, start, ref, lod, af, events) with their filters: in the panel, weak, explained by contamination, among too many events."""
    known = panel.select("contig", "start", "ref", F.lit(True).alias("in_panel"))
    both = calls.join(known, ["contig", "start", "ref"], "left")
    return filters.tag(both, {"panel_of_normals": F.col("in_panel"), "t_lod": F.col("lod") < least_lod, "contamination": F.col("af") < contamination, "clustered_events": F.col("events") > most_events}).drop("in_panel")


@tool
def filter_by_orientation_bias(calls: DataFrame, artefacts: list[tuple[str, str]], cutoff: float = 0.9) -> DataFrame:
    """Calls (ref, alt, alt_f1r2, alt_f2r1) with the share of alternate reads in the orientation that an artefact (or its complement) has, and whether they are cut."""
    flipped = str.maketrans("ACGT", "TGCA")
    plain = reduce(lambda a, b: a | b, ((F.col("ref") == r) & (F.col("alt") == a) for r, a in artefacts))
    other = reduce(lambda a, b: a | b, ((F.col("ref") == r.translate(flipped)) & (F.col("alt") == a.translate(flipped)) for r, a in artefacts))
    total = F.nullif(F.col("alt_f1r2") + F.col("alt_f2r1"), F.lit(0))
    share = F.when(plain, F.col("alt_f2r1") / total).when(other, F.col("alt_f1r2") / total)
    return calls.withColumn("fob", share).withColumn("orientation_bias", F.coalesce(F.col("fob") > cutoff, F.lit(False)))


@tool
def count_false_positives(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: unfiltered calls by kind, and per million bases of the targets (contig, start, end)."""
    kept = calls.filter(F.coalesce(F.size("filters") == 0, F.lit(True)))
    kind = filters.variant_type(F.col("ref"), F.col("alts"))
    size = intervals.merge(targets, "contig", "start", "end").agg(F.sum(F.col("end") - F.col("start") + 1).alias("territory"))
    counts = kept.agg(F.count_if(kind == "SNP").alias("snps"), F.count_if(kind == "INDEL").alias("indels"))
    out = counts.crossJoin(F.broadcast(size))
    return out.withColumns({f"{x}_per_million": F.col(x) * 1e6 / F.col("territory") for x in ("snps", "indels")})


@tool
def gather_tranches(parts: list[DataFrame], key: list[str], sums: list[str]) -> DataFrame:
    return callsets.gather(parts, key, sums)


@tool
def annotate_variants(sites_: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Sites with what their genotypes tell, and further columns."""
    return variants.site_annotations(sites_).withColumns(extra or {})


@tool
def validate_variants(sites_: DataFrame) -> DataFrame:
    """Sites with something wrong, and what."""
    return sites_.withColumn("problems", variants.problems(sites_)).filter(F.size("problems") > 0)


#: Classes of a variant by the features of a gene model that it touches, the first that applies.
CLASSES = (("CDS", "CODING"), ("UTR", "UTR"), ("exon", "EXON"), ("transcript", "INTRON"), ("gene", "GENE"))


@tool
def annotate_genes(sites_: DataFrame, genes: DataFrame, key: str, flank: int = 0, width: int = 10_000) -> DataFrame:
    """Sites with the class of the gene features (contig, feature, start, end, gene_id) that they touch and the gene; FLANK near one; IGR elsewhere. Of several genes the first by name."""
    side = genes.select(F.col("contig").alias("g_contig"), (F.col("start") - flank).alias("g_start"), (F.col("end") + flank).alias("g_end"), F.col("start").alias("inner_start"), F.col("end").alias("inner_end"), "feature", "gene_id")
    found = intervals.overlap_join(sites_.select(key, "contig", "start", "end"), side, ("contig", "start", "end"), ("g_contig", "g_start", "g_end"), width)
    inside = (F.col("start") <= F.col("inner_end")) & (F.col("end") >= F.col("inner_start"))
    rank = F.coalesce(*[F.when(inside & (F.col("feature") == f), F.lit(i)) for i, (f, _) in enumerate(CLASSES)], F.lit(len(CLASSES)))
    best = found.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), F.col("gene_id").alias("gene_id"))).alias("best"))
    names = F.array(*[F.lit(c) for _, c in CLASSES], F.lit("FLANK"))
    out = sites_.join(best, key, "left")
    return out.withColumns({"gene": F.col("best.gene_id"), "variant_class": F.coalesce(F.get(names, F.col("best.rank")), F.lit("IGR"))}).drop("best")


# Taxonomy and host subtraction


@tool
def tree_paths(tree: DataFrame, node: str, parent: str, root: str, deepest: int = 64) -> DataFrame:
    """node, ancestor and depth (0: itself) of every node below the root, by doubling: the paths of 2, 4, 8 steps come from joining paths to themselves. Nodes that don't reach the root are left out."""
    edges = tree.filter(F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    paths = edges
    step = 1
    while step < deepest:
        far = paths.filter(F.col("depth") == step).select(F.col("node"), F.col("ancestor").alias("middle"))
        more = far.join(paths.select(F.col("node").alias("middle"), "ancestor", (F.col("depth") + step).alias("depth")), "middle").select("node", "ancestor", "depth")
        paths = stored(paths.unionByName(more), "paths")
        step *= 2
        if paths.filter(F.col("depth") == step).isEmpty():
            break
    own = tree.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    every = paths.unionByName(own)
    reached = every.filter(F.col("ancestor") == F.lit(root)).select("node").distinct()
    return every.join(reached, "node", "left_semi")


@tool
def lowest_common_ancestor(hits: DataFrame, group: str, node: str, paths: DataFrame) -> DataFrame:
    """group and the deepest node that lies on the paths of all the group's nodes."""
    own = hits.select(group, F.col(node).alias("node")).distinct()
    n = own.groupBy(group).agg(F.count("*").alias("n"))
    up = own.join(paths, "node").groupBy(group, "ancestor").agg(F.count("*").alias("below"), F.min("depth").alias("near"))
    return null_safe(up, n, [group]).filter("below = n").groupBy(group).agg(F.min_by("ancestor", F.struct("near", "ancestor")).alias("lca"))


@tool
def subtract_host(reads: DataFrame, host_kmers: DataFrame, k: int, key: str, least_quality: int = 15, shortest: int = 10, most_unknown: int = 2, hits: int = 1) -> DataFrame:
    """Reads that are left after the steps of host subtraction, in this order: primary lines, names without mate numbers, repeats masked, ends of low quality clipped, length, low qualities masked, unknown bases, k-mers of the host, copies (a sequence or its reverse complement)."""
    from .functions.scalars import kmers, reverse_complement

    out = reads.filter(filters.PLAIN["primary_line"]()).withColumn("name", transforms.strip_mate_number(F.col("name")))
    # written, so that what is masked and clipped isn't computed again wherever a later step uses it
    out = stored(out.withColumn("bases", transforms.mask_simple_repeats(F.col("bases"), 15, 14, 14)), "masked")
    cut = stored(out.withColumn("cut", transforms.clip_ends(F.col("quals"), least_quality)), "cut")
    clipped = transforms.clip_to(F.col("bases"), F.col("quals"), F.col("cut.first"), F.col("cut.last"))
    out = cut.withColumn("clipped", clipped).withColumns({"bases": F.col("clipped.bases"), "quals": F.col("clipped.quals")}).drop("cut", "clipped").filter(F.length("bases") >= shortest)
    out = stored(out.withColumn("bases", transforms.mask_low_quality(F.col("bases"), F.col("quals"), least_quality)), "unknown").filter(filters.ambiguous_bases(most_unknown))
    out = callsets.kmer_antijoin(out, key, kmers(F.col("bases"), k), host_kmers, hits)
    canonical = F.least("bases", reverse_complement(F.col("bases")))
    first = out.groupBy(canonical.alias("canonical")).agg(F.min(key).alias(key))
    return out.join(first.select(key), key, "left_semi")


@tool
def index_features(features: DataFrame, contig: str, start: str, end: str, width: int) -> DataFrame:
    """contig, bin, how many features start there, and their least start and greatest end: what an interval query needs to choose bins."""
    return features.groupBy(contig, F.floor(F.col(start) / width).alias("bin")).agg(F.count("*").alias("n"), F.min(start).alias("least"), F.max(end).alias("most"))


@tool
def count_variants(sites_: DataFrame) -> DataFrame:
    return sites_.agg(F.count("*").alias("n"))


@tool
def read_and_count(spark: Any, path: str) -> DataFrame:
    """Reads of text alignment files, counted."""
    return text.read_sam(spark, path).agg(F.count("*").alias("n"), F.sum(F.length("bases")).alias("bases"))


@tool
def apply_recalibration(bases: DataFrame, table: DataFrame, keys: list[str], reported: str) -> DataFrame:
    return sites.apply_recalibration(bases, table, keys, reported)
