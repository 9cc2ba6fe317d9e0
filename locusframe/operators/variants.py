"""Operators on variant tables: contig, start, end, id, ref, alts, qual, filters, info (map), genotypes (sample, map of fields)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from .filters import variant_type
from .intervals import overlap_join

NO_CALL = r"\."


def gt_alleles(gt: Column) -> Column:
    """Allele numbers of a genotype text; null for no-calls."""
    return F.transform(F.split(gt, r"[/|]"), lambda a: a.try_cast("int"))


def is_called(gt: Column) -> Column:
    return gt.isNotNull() & ~gt.contains(".")


def is_hom_ref(gt: Column) -> Column:
    return is_called(gt) & F.forall(gt_alleles(gt), lambda a: a == 0)


def is_het(gt: Column) -> Column:
    return is_called(gt) & (F.size(F.array_distinct(gt_alleles(gt))) > 1)


def is_hom_var(gt: Column) -> Column:
    return is_called(gt) & (F.size(F.array_distinct(gt_alleles(gt))) == 1) & F.forall(gt_alleles(gt), lambda a: a > 0)


def is_variant_call(gt: Column) -> Column:
    return gt.isNotNull() & F.exists(gt_alleles(gt), lambda a: F.coalesce(a > 0, F.lit(False)))


def field_of(genotypes: Column, sample: str, name: str) -> Column:
    """One sample's field as text; null if it has none."""
    own = F.filter(genotypes, lambda g: g["sample"] == sample)
    return F.try_element_at(F.get(own, F.lit(0))["values"], F.lit(name))


def indel_sizes() -> Column:
    """Greatest difference of length between the reference allele and another, symbolic ones left out."""
    plain = F.filter("alts", lambda a: ~a.rlike(r"^<|\*"))
    return F.coalesce(F.array_max(F.transform(plain, lambda a: F.abs(F.length(a) - F.length("ref")))), F.lit(0))


def select_variants(df: DataFrame, samples: list[str] | None = None, types: list[str] | None = None, ids: list[str] | None = None, not_ids: list[str] | None = None, conditions: list[Column] = (), sizes: tuple[int, int] | None = None, exclude_non_variants: bool = False, exclude_filtered: bool = False, only_biallelic: bool | None = None, most_no_calls: float | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Sites that meet all given criteria, null meeting none; genotypes of the given samples only, unused alleles kept.

    fraction: this share of sites by a hash of their place, the same in every run.
    """
    out = df
    if samples is not None:
        out = out.withColumn("genotypes", F.filter("genotypes", lambda g: g["sample"].isin(*samples)))
    tests = list(conditions)
    if types is not None:
        tests.append(variant_type(F.col("ref"), F.col("alts")).isin(*types))
    if ids is not None:
        tests.append(F.col("id").isin(*ids))
    if not_ids:
        tests.append(~F.coalesce(F.col("id").isin(*not_ids), F.lit(False)))
    if sizes is not None:
        tests.append(indel_sizes().between(*sizes))
    if exclude_filtered:
        tests.append(F.coalesce(F.size("filters") == 0, F.lit(True)))
    if exclude_non_variants:
        tests.append(F.exists("genotypes", lambda g: is_variant_call(F.try_element_at(g["values"], F.lit("GT")))))
    if only_biallelic is not None:
        tests.append((F.size("alts") == 1) == F.lit(only_biallelic))
    if most_no_calls is not None:
        calls = F.filter("genotypes", lambda g: ~is_called(F.try_element_at(g["values"], F.lit("GT"))))
        tests.append(F.size(calls) <= F.lit(most_no_calls) * F.size("genotypes"))
    if fraction is not None:
        tests.append(F.pmod(F.xxhash64("contig", "start", "ref", F.lit(seed)), F.lit(1_000_000)) < fraction * 1_000_000)
    return out.filter(reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests))) if tests else out


def subset_alleles(df: DataFrame, keep: Column) -> DataFrame:
    """Sites with only the alternate alleles whose numbers (from 1) are in ``keep``.

    Genotypes are numbered anew, alleles that went becoming no-calls; AD keeps
    the remaining depths, and PL the likelihoods of the remaining genotypes of
    diploid samples, made to start at 0.
    """
    # a column of its own: inside a lambda a name that is assigned beside it would mean the new column
    held = df.withColumn("kept_alleles", F.array_sort(F.array_distinct(F.filter(keep, lambda a: (a >= 1) & (a <= F.size("alts"))))))
    kept = F.col("kept_alleles")
    old = F.concat(F.array(F.lit(0)), kept)  # old number of each new allele

    def renumbered(gt: Column) -> Column:
        mark = F.when(gt.contains("|"), "|").otherwise("/")
        return F.call_function("array_join", F.transform(F.split(gt, r"[/|]"), lambda a: F.when(F.coalesce(F.array_position(old, a.try_cast("int")), F.lit(0)) > 0, (F.array_position(old, a.try_cast("int")) - 1).cast("string")).otherwise(".")), mark)

    def depths(ad: Column) -> Column:
        xs = F.split(ad, ",")
        return F.array_join(F.transform(old, lambda i: F.coalesce(F.get(xs, i), F.lit("."))), ",")

    def likelihoods(pl: Column) -> Column:
        xs = F.transform(F.split(pl, ","), lambda x: x.try_cast("int"))
        pairs = F.flatten(F.transform(old, lambda b, j: F.transform(F.slice(old, F.lit(1), j + 1), lambda a: (b * (b + 1) / 2).cast("int") + a)))
        some = F.transform(pairs, lambda i: F.get(xs, i))
        return F.array_join(F.transform(some, lambda x: (x - F.array_min(some)).cast("string")), ",", ".")

    values = lambda g: F.transform_values(g["values"], lambda k, v: F.when(k == "GT", renumbered(v)).when(k == "AD", depths(v)).when(k == "PL", likelihoods(v)).otherwise(v))
    out = held.withColumn("genotypes", F.transform("genotypes", lambda g: F.struct(g["sample"].alias("sample"), values(g).alias("values"))))
    return out.withColumn("alts", F.transform(kept, lambda i: F.get("alts", i - 1))).drop("kept_alleles")


def used_alleles() -> Column:
    """Numbers of the alternate alleles that some genotype has."""
    every = F.flatten(F.transform("genotypes", lambda g: F.coalesce(gt_alleles(F.try_element_at(g["values"], F.lit("GT"))), F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(F.filter(every, lambda a: a > 0)))


def to_table(df: DataFrame, fields: list[str], sample_fields: list[str] = (), samples: list[str] = (), split_alleles: bool = False, molten: bool = False, key: list[str] = ("contig", "start")) -> DataFrame:
    """Columns of text: site columns, INFO fields (a trailing * is a wildcard, joined as key=value), and ``sample.field`` columns.

    split_alleles: a row for each alternate allele, comma-separated INFO values
    with one entry for each allele being dealt to them.  molten: rows of
    (key, sample, field, value) instead.
    """
    plain = {"CHROM": F.col("contig"), "POS": F.col("start"), "ID": F.col("id"), "REF": F.col("ref"), "ALT": F.array_join("alts", ","), "QUAL": F.col("qual"), "FILTER": F.when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ",")), "END": F.col("end"), "TYPE": variant_type(F.col("ref"), F.col("alts")), "NSAMPLES": F.size("genotypes"), "NO-CALL": F.size(F.filter("genotypes", lambda g: ~is_called(g["values"]["GT"]))), "HET": F.size(F.filter("genotypes", lambda g: is_het(g["values"]["GT"]))), "HOM-REF": F.size(F.filter("genotypes", lambda g: is_hom_ref(g["values"]["GT"]))), "HOM-VAR": F.size(F.filter("genotypes", lambda g: is_hom_var(g["values"]["GT"]))), "VAR": F.size(F.filter("genotypes", lambda g: is_variant_call(g["values"]["GT"]))), "NCALLED": F.size(F.filter("genotypes", lambda g: is_called(g["values"]["GT"]))), "MULTI-ALLELIC": F.size("alts") > 1}
    rows, n = df, F.size("alts")
    if split_alleles:
        rows = df.withColumn("allele", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))))
        plain["ALT"] = F.get("alts", F.col("allele"))

    def value(name: str) -> Column:
        if name in plain:
            return plain[name]
        if name.endswith("*"):
            some = F.array_sort(F.map_entries(F.map_filter("info", lambda k, _: k.startswith(name[:-1]))))
            return F.array_join(F.transform(some, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
        own = F.when(F.map_contains_key("info", name), F.coalesce(F.try_element_at("info", F.lit(name)), F.lit("true")))
        if not split_alleles:
            return own
        entries = F.split(own, ",")
        return F.when((F.size(entries) == n) & (n > 1), F.get(entries, F.col("allele"))).otherwise(own)

    out = [F.coalesce(value(name).cast("string"), F.lit("NA")).alias(name) for name in fields]
    cells = [(s, f, F.coalesce(field_of(F.col("genotypes"), s, f), F.lit("NA"))) for s in samples for f in sample_fields]
    if not molten:
        return rows.select(*out, *[c.alias(f"{s}.{f}") for s, f, c in cells])
    entries = [F.struct(F.lit("site").alias("sample"), F.lit(name).alias("field"), c.alias("value")) for name, c in zip(fields, out, strict=True)]
    entries += [F.struct(F.lit(s).alias("sample"), F.lit(f).alias("field"), c.alias("value")) for s, f, c in cells]
    return rows.select(*key, F.inline(F.array(*entries)))


def mask(df: DataFrame, masks: DataFrame, name: str, key: str, extension: int = 0, not_in_mask: bool = False, width: int = 1000) -> DataFrame:
    """Filters with ``name`` added where a mask (contig, start, end), widened by the extension, overlaps; not_in_mask: where none does.

    Sites that have the name already keep their filters.
    """
    wide = masks.select(F.col("contig").alias("mask_contig"), (F.col("start") - extension).alias("mask_start"), (F.col("end") + extension).alias("mask_end"))
    hit = overlap_join(df.select(key, "contig", "start", "end"), wide, ("contig", "start", "end"), ("mask_contig", "mask_start", "mask_end"), width, "semi", key).select(key, F.lit(True).alias("masked"))
    found = F.coalesce("masked", F.lit(False)) != F.lit(not_in_mask)
    old = F.coalesce("filters", F.array().cast("array<string>"))
    return df.join(hit, key, "left").withColumn("filters", F.when(found & ~F.array_contains(old, name), F.concat(old, F.array(F.lit(name)))).otherwise(F.col("filters"))).drop("masked")


def overlapping(df: DataFrame, other: DataFrame, key: str, concordant: bool = True, width: int = 1000) -> DataFrame:
    """Sites that overlap one of another callset (or none). Alleles are not compared."""
    wide = other.select(F.col("contig").alias("other_contig"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return overlap_join(df, wide, ("contig", "start", "end"), ("other_contig", "other_start", "other_end"), width, "semi" if concordant else "anti", key)


def genotype_concordance(df: DataFrame, other: DataFrame, samples: list[str], concordant: bool = True) -> DataFrame:
    """Sites at which all given samples have the same alleles in both callsets (or not), by place and alleles of their calls."""
    called = lambda name: F.array_sort(F.transform(gt_alleles(field_of(F.col("genotypes"), name, "GT")), lambda a: F.when(a == 0, F.col("ref")).otherwise(F.get("alts", a - 1))))
    theirs = other.select(F.col("contig").alias("other_contig"), F.col("start").alias("other_start"), *[called(s).alias(f"other_{i}") for i, s in enumerate(samples)]).dropDuplicates(["other_contig", "other_start"])
    mine = df.withColumns({f"own_{i}": called(s) for i, s in enumerate(samples)})
    same = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"own_{i}") == F.col(f"other_{i}"), F.lit(False)) for i in range(len(samples))))
    both = mine.join(theirs, (F.col("contig") == F.col("other_contig")) & (F.col("start") == F.col("other_start")), "left")
    keep = same if concordant else ~same & reduce(lambda a, b: a | b, (F.exists(F.coalesce(F.col(f"own_{i}"), F.array().cast("array<string>")), lambda a: a != F.col("ref")) for i in range(len(samples))))
    return both.filter(keep).select(*df.columns)


def trimmed_alleles(df: DataFrame) -> DataFrame:
    """Biallelic sites with the bases that both alleles end or begin with cut off, one base left of each; start follows."""
    alt = F.get("alts", F.lit(0))
    shortest = F.least(F.length("ref"), F.length(alt))
    places = F.sequence(F.lit(1), F.greatest(shortest - 1, F.lit(1)))
    tail = F.size(F.filter(places, lambda i: (i < shortest) & (F.right("ref", i) == F.right(alt, i))))
    held = df.withColumns({"cut_ref": F.substring("ref", F.lit(1), F.length("ref") - tail), "cut_alt": F.substring(alt, F.lit(1), F.length(alt) - tail)})
    least = F.least(F.length("cut_ref"), F.length("cut_alt"))
    inner = F.sequence(F.lit(1), F.greatest(least - 1, F.lit(1)))
    head = F.size(F.filter(inner, lambda i: (i < least) & (F.left("cut_ref", i) == F.left("cut_alt", i))))
    plain = (F.size("alts") == 1) & ~alt.rlike(r"[<*\[\]]")
    head = F.when(plain, head).otherwise(0)
    out = held.withColumns({"ref": F.when(plain, F.substr("cut_ref", head + 1)).otherwise(F.col("ref")), "alts": F.when(plain, F.array(F.substr("cut_alt", head + 1))).otherwise(F.col("alts")), "start": (F.col("start") + head).cast(df.schema["start"].dataType)})
    return out.drop("cut_ref", "cut_alt")


def left_aligned(df: DataFrame, before: Column) -> DataFrame:
    """Biallelic indels of one anchor base moved to the left as far as they stay the same; before: reference bases that end with the site's anchor base.

    A deletion or insertion moves by one as long as the anchor is the last base
    of what is deleted or inserted, which then turns by one.
    """
    alt = F.get("alts", F.lit(0))
    unit = F.when(F.length("ref") > 1, F.substr("ref", F.lit(2))).otherwise(F.substr(alt, F.lit(2)))
    indel = (F.size("alts") == 1) & ((F.length("ref") == 1) != (F.length(alt) == 1)) & (F.left("ref", F.lit(1)) == F.left(alt, F.lit(1)))
    n = F.length(before)
    zero = F.struct(unit.alias("unit"), F.lit(0).alias("moved"), F.lit(False).alias("done"))

    def step(a: Column, i: Column) -> Column:
        base = F.substring(before, n - i, F.lit(1))
        goes = ~a["done"] & (i < n - 1) & (F.right(a["unit"], F.lit(1)) == base)
        return F.struct(F.when(goes, F.concat(base, F.left(a["unit"], F.length(a["unit"]) - 1))).otherwise(a["unit"]).alias("unit"), (a["moved"] + goes.cast("int")).alias("moved"), (~goes).alias("done"))

    moved = df.withColumn("move", F.when(indel, F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda a: F.struct(a["unit"].alias("unit"), a["moved"].alias("moved")))))
    anchor = F.substring(before, n - F.col("move.moved"), F.lit(1))
    joint = F.concat(anchor, F.col("move.unit"))
    change = F.coalesce(F.col("move.moved") > 0, F.lit(False))
    out = moved.withColumns({"new_ref": F.when(change, F.when(F.length("ref") > 1, joint).otherwise(anchor)).otherwise(F.col("ref")), "new_alts": F.when(change, F.array(F.when(F.length("ref") > 1, anchor).otherwise(joint))).otherwise(F.col("alts")), "new_start": F.when(change, F.col("start") - F.col("move.moved")).otherwise(F.col("start")).cast(df.schema["start"].dataType)})
    return out.drop("ref", "alts", "start", "move").withColumnsRenamed({"new_ref": "ref", "new_alts": "alts", "new_start": "start"}).select(*df.columns)


def problems(df: DataFrame, reference_base: Column | None = None) -> Column:
    """What is wrong with a site, as an array of texts: reference allele, unused alternates, genotype numbers, counts of alleles."""
    every = F.flatten(F.transform("genotypes", lambda g: F.coalesce(gt_alleles(F.try_element_at(g["values"], F.lit("GT"))), F.array().cast("array<int>"))))
    called = F.filter(every, lambda a: a.isNotNull())
    an = F.try_element_at("info", F.lit("AN")).try_cast("int")
    tests = {
        "alternates that no genotype has": (F.size("genotypes") > 0) & (F.size(called) > 0) & (F.size(F.array_except(F.when(F.size("alts") > 0, F.sequence(F.lit(1), F.size("alts"))).otherwise(F.array().cast("array<int>")), called)) > 0),
        "a genotype has no such allele": F.exists(called, lambda a: a > F.size("alts")),
        "AN is not the number of called alleles": an.isNotNull() & (an != F.size(called)),
        "an alternate equals the reference": F.array_contains("alts", F.col("ref")),
        "end before start": F.col("end") < F.col("start"),
    }
    if reference_base is not None:
        tests["the reference differs"] = F.upper(reference_base) != F.upper("ref")
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests.items()]))


def fixed_sample_order(df: DataFrame, samples: list[str]) -> DataFrame:
    """Genotypes in the given order of samples."""
    one = lambda name: F.get(F.filter("genotypes", lambda g: g["sample"] == name), F.lit(0))
    return df.withColumn("genotypes", F.array_compact(F.array(*map(one, samples))))


def site_annotations(df: DataFrame) -> DataFrame:
    """contig, start, and what the site's genotypes tell: depth, quality by depth, samples with a variant, allele counts, GQ mean and deviation."""
    of = lambda name: F.filter(F.transform("genotypes", lambda g: F.try_element_at(g["values"], F.lit(name)).try_cast("double")), lambda x: x.isNotNull())
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    variant = F.filter("genotypes", lambda g: is_variant_call(F.try_element_at(g["values"], F.lit("GT"))))
    variant_depth = total(F.filter(F.transform(variant, lambda g: F.try_element_at(g["values"], F.lit("DP")).try_cast("double")), lambda x: x.isNotNull()))
    gq = of("GQ")
    mean = total(gq) / F.nullif(F.size(gq), F.lit(0))
    sd = F.sqrt(total(F.transform(gq, lambda x: (x - mean) * (x - mean))) / F.nullif(F.size(gq) - 1, F.lit(0)))
    called = F.flatten(F.transform("genotypes", lambda g: F.filter(F.coalesce(gt_alleles(F.try_element_at(g["values"], F.lit("GT"))), F.array().cast("array<int>")), lambda a: a.isNotNull())))
    counts = F.transform(F.when(F.size("alts") > 0, F.sequence(F.lit(1), F.size("alts"))).otherwise(F.array().cast("array<int>")), lambda i: F.size(F.filter(called, lambda a: a == i)))
    return df.withColumns({
        "depth": total(of("DP")).cast("long"),
        "qual_by_depth": F.col("qual") / F.nullif(variant_depth, F.lit(0.0)),
        "samples": F.array_join(F.transform(variant, lambda g: g["sample"]), ","),
        "ac": F.array_join(counts, ","),
        "an": F.size(called),
        "ncc": F.size(F.filter("genotypes", lambda g: ~is_called(F.try_element_at(g["values"], F.lit("GT"))))),
        "gq_mean": mean,
        "gq_sd": sd,
    })


def rounded_qual(x: Column, places: int = 2) -> Column:
    return half_up(x * 10**places) / 10**places
