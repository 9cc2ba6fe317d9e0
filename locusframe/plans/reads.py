"""Queries of aligned reads: filters, transforms, flag statistics, duplicates, sorting, pairs.

Orders stand in for reads.  The view gives each order all columns of a read by
arithmetic on its keys and the digits of an MD5 value: reads 2p and 2p + 1 are
a pair; contigs, flags, qualities, CIGARs (also bad ones), groups and bases
vary, so that each filter keeps some and drops some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import filters as FL
from ..operators import ordered as O  # noqa: E741
from ..operators import readsets as R
from ..operators import transforms as T
from .catalog import day, day_sql, query, table

#: CIGARs of the view and the reference bases that they cover.
CIGARS = {"20M": 20, "5S15M": 15, "10M2D8M2S": 20, "8M2I10M": 18, "5M10N15M": 30, "3H17M3S": 17, "18M": 18, "4S12M4S": 12, "6M2I2D12M": 20, "2D20M": 22, "3M10N2D20N17M": 52}
LETTERS = ("0123456789abcdef", "ACGTACGTACGTACGN")
PLATFORMS = ("ILLUMINA", "Illumina HiSeq", "PACBIO")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read view of orders; k is its key."""
    c, k, d = F.col("o_custkey"), F.col("o_orderkey"), day("o_orderdate")
    t, h = F.floor("o_totalprice"), F.md5(F.concat(F.lit("r"), k.cast("string")))
    own = table(spark, sf_dir, "orders").select(k.alias("k"), F.floor(k / 2).alias("p"), (k % 2 == 0).alias("first"), c.alias("c"), t.alias("t"), h.alias("h"), (c % 11 == 0).alias("unmapped"), (F.col("o_orderstatus") == "O").alias("reverse"), F.when(c % 11 != 0, F.concat(F.lit("chr"), (c % 5 + 1).cast("string"))).alias("contig"), F.when(c % 11 != 0, d + 1).otherwise(0).cast("int").alias("start"))
    mate = own.select((F.col("k") + F.when(F.col("first"), 1).otherwise(-1)).alias("k"), F.col("unmapped").alias("m_unmapped"), F.col("reverse").alias("m_reverse"), F.col("contig").alias("m_contig"), F.col("start").alias("m_start"))
    both = own.join(mate, "k", "left")
    c, t, p = F.col("c"), F.col("t"), F.col("p")
    paired = (p % 8 != 0) & F.col("m_unmapped").isNotNull()
    bit = lambda x, n: F.when(x, n).otherwise(0)
    flags = bit(paired, 1) + bit(paired & ~F.col("unmapped") & ~F.col("m_unmapped") & (p % 3 != 0), 2) + bit(F.col("unmapped"), 4) + bit(paired & F.col("m_unmapped"), 8) + bit(F.col("reverse"), 16) + bit(paired & F.col("m_reverse"), 32) + bit(paired & F.col("first"), 64) + bit(paired & ~F.col("first"), 128) + bit(t % 23 == 0, 256) + bit(t % 31 == 0, 512) + bit(t % 10 == 0, 1024) + bit(t % 29 == 0, 2048)
    cigar = F.when(F.col("unmapped"), "*").otherwise(F.get(F.array(*map(F.lit, CIGARS)), (t % len(CIGARS)).cast("int")))
    span = F.when(F.col("unmapped"), 0).otherwise(F.get(F.array(*map(F.lit, CIGARS.values())), (t % len(CIGARS)).cast("int")))
    none = t % 37 == 0
    bases = F.when(none, "").otherwise(F.translate(F.substring("h", 1, 20), *LETTERS))
    value = lambda x: 3 * (F.ascii(x) - F.when(F.ascii(x) >= 97, 87).otherwise(48)) + 2
    quals = F.when(none, F.array().cast("array<int>")).otherwise(F.transform(F.split(F.substring("h", 13, 20), ""), value))
    quals = F.when(~none & (t % 41 == 0), F.slice(quals, 1, 19)).otherwise(quals)
    mapq = F.when(c % 13 == 0, 255).when(c % 7 == 0, 0).otherwise((t % 61).cast("int"))
    tlen = F.when(~paired | (p % 9 == 0), 0).otherwise((t % 500 + 20) * F.when(F.col("first"), 1).otherwise(-1)).cast("int")
    out = both.select(
        "k",
        F.concat(F.lit("q"), p.cast("string"), F.when(t % 3 == 0, F.concat(F.lit("/"), F.when(F.col("first"), "1").otherwise("2"))).when(t % 3 == 1, " tail").otherwise("")).alias("name"),
        flags.alias("flags"),
        "contig",
        "start",
        (F.col("start") + span - 1).alias("end"),
        mapq.alias("mapq"),
        cigar.alias("cigar_text"),
        F.when(paired, F.col("m_contig")).alias("mate_contig"),
        F.when(paired, F.col("m_start")).otherwise(0).alias("mate_start"),
        tlen.alias("tlen"),
        bases.alias("bases"),
        quals.alias("quals"),
        F.when(c % 17 != 0, F.concat(F.lit("rg"), (c % 4).cast("string"))).alias("read_group"),
        F.when(c % 17 != 0, F.concat(F.lit("s"), (c % 2).cast("string"))).alias("sample"),
        F.when(c % 19 != 0, F.concat(F.lit("lib"), (c % 3).cast("string"))).alias("library"),
        F.get(F.array(*map(F.lit, PLATFORMS)), (c % 4).cast("int")).alias("platform"),
        F.when(c % 19 != 0, F.concat(F.lit("pu"), (c % 4).cast("string"))).alias("platform_unit"),
        F.when(t % 20 == 0, "1").when(t % 20 == 10, "0").alias("optical"),
        (F.col("k") % 5).cast("string").alias("nm"),
    )
    tags = F.map_filter(F.create_map(F.lit("OD"), F.col("optical"), F.lit("NM"), F.col("nm")), lambda _, v: v.isNotNull())
    return out.withColumns({"cigar": T.cigar_ops(F.col("cigar_text")), "tags": tags}).drop("optical", "nm")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


READS = f"""own as (select o_orderkey k, o_orderkey // 2 p, o_orderkey % 2 = 0 first, o_custkey c, cast(floor(o_totalprice) as bigint) t, md5('r' || o_orderkey) h, o_custkey % 11 = 0 unmapped, o_orderstatus = 'O' reverse,
  case when o_custkey % 11 <> 0 then 'chr' || (o_custkey % 5 + 1) end contig, case when o_custkey % 11 <> 0 then {day_sql('o_orderdate')} + 1 else 0 end as start from orders),
prs as (select a.*, b.unmapped m_unmapped, b.reverse m_reverse, b.contig m_contig, b.start m_start, a.p % 8 <> 0 and b.k is not null paired from own a left join own b on b.k = a.k + case when a.first then 1 else -1 end),
reads as (select k, 'q' || p || case t % 3 when 0 then case when first then '/1' else '/2' end when 1 then ' tail' else '' end as name,
  paired::int + 2 * (paired and not unmapped and not m_unmapped and p % 3 <> 0)::int + 4 * unmapped::int + 8 * (paired and m_unmapped)::int + 16 * reverse::int + 32 * (paired and m_reverse)::int + 64 * (paired and first)::int + 128 * (paired and not first)::int + 256 * (t % 23 = 0)::int + 512 * (t % 31 = 0)::int + 1024 * (t % 10 = 0)::int + 2048 * (t % 29 = 0)::int flags,
  contig, start, start + case when unmapped then 0 else ({_list(CIGARS.values())})[t % {len(CIGARS)} + 1] end - 1 as end, case when c % 13 = 0 then 255 when c % 7 = 0 then 0 else t % 61 end mapq,
  case when unmapped then '*' else ({_list(CIGARS)})[t % {len(CIGARS)} + 1] end cigar, case when paired then m_contig end mate_contig, case when paired then m_start else 0 end mate_start,
  case when not paired or p % 9 = 0 then 0 else (t % 500 + 20) * case when first then 1 else -1 end end tlen, case when t % 37 = 0 then '' else translate(substr(h, 1, 20), '{LETTERS[0]}', '{LETTERS[1]}') end bases,
  case when t % 37 = 0 then []::bigint[] else list_transform(range(13, case when t % 41 = 0 then 32 else 33 end), lambda i: 3 * (ascii(substr(h, i, 1)) - case when ascii(substr(h, i, 1)) >= 97 then 87 else 48 end) + 2) end quals,
  case when c % 17 <> 0 then 'rg' || c % 4 end read_group, case when c % 17 <> 0 then 's' || c % 2 end as sample, case when c % 19 <> 0 then 'lib' || c % 3 end library, ({_list(PLATFORMS)})[c % 4 + 1] platform, case when c % 19 <> 0 then 'pu' || c % 4 end platform_unit,
  case t % 20 when 0 then '1' when 10 then '0' end optical, k % 5 nm, list_transform(regexp_extract_all(case when unmapped then '' else ({_list(CIGARS)})[t % {len(CIGARS)} + 1] end, '\\d+[A-Z]'), lambda x: {{'n': regexp_extract(x, '\\d+')::bigint, 'op': right(x, 1)}}) ops from prs)"""


def _sum_sql(ops: str) -> str:
    return f"cast(coalesce(list_sum(list_transform(list_filter(ops, lambda x: contains('{ops}', x.op)), lambda x: x.n)), 0) as bigint)"


def _flag(bit: int) -> str:
    return f"(flags & {bit}) <> 0"


ORDER_OF_OPS = "array_to_string(list_transform(ops, lambda x: x.op), '')"
#: Each filter as a column, and as SQL over the view.
FILTERS: dict[str, tuple[Column, str]] = {
    "allow_all": (FL.PLAIN["allow_all"], "true"),
    "no_n_operator": (FL.PLAIN["no_n_operator"], "not contains(cigar, 'N')"),
    "first_of_pair": (FL.PLAIN["first_of_pair"], _flag(64)),
    "second_of_pair": (FL.PLAIN["second_of_pair"], _flag(128)),
    "good_cigar": (FL.PLAIN["good_cigar"], f"not regexp_matches({ORDER_OF_OPS}, '^[HS]*D|D[HS]*$|[ID][ID]|^[HS]*$')"),
    "non_zero_fragment_length": (FL.PLAIN["non_zero_fragment_length"], "tlen <> 0"),
    "matching_bases_and_quals": (FL.PLAIN["matching_bases_and_quals"], "length(bases) = len(quals)"),
    "has_read_group": (FL.PLAIN["has_read_group"], "read_group is not null"),
    "mapped": (FL.PLAIN["mapped"], f"not {_flag(4)}"),
    "mapping_quality_available": (FL.PLAIN["mapping_quality_available"], "mapq <> 255"),
    "mapping_quality_not_zero": (FL.PLAIN["mapping_quality_not_zero"], "mapq <> 0"),
    "mate_on_same_contig_or_unmapped": (FL.PLAIN["mate_on_same_contig_or_unmapped"], f"not {_flag(1)} or {_flag(8)} or (not {_flag(4)} and contig is not distinct from mate_contig)"),
    "mate_different_strand": (FL.PLAIN["mate_different_strand"], f"{_flag(1)} and not {_flag(4)} and not {_flag(8)} and ({_flag(16)}) <> ({_flag(32)})"),
    "non_zero_reference_length": (FL.PLAIN["non_zero_reference_length"], f"{_sum_sql('MDN=X')} > 0"),
    "not_duplicate": (FL.PLAIN["not_duplicate"], f"not {_flag(1024)}"),
    "not_secondary": (FL.PLAIN["not_secondary"], f"not {_flag(256)}"),
    "not_supplementary": (FL.PLAIN["not_supplementary"], f"not {_flag(2048)}"),
    "paired": (FL.PLAIN["paired"], _flag(1)),
    "passes_vendor_check": (FL.PLAIN["passes_vendor_check"], f"not {_flag(512)}"),
    "properly_paired": (FL.PLAIN["properly_paired"], _flag(2)),
    "primary_line": (FL.PLAIN["primary_line"], f"not {_flag(256)} and not {_flag(2048)}"),
    "length_equals_cigar": (FL.PLAIN["length_equals_cigar"], f"{_flag(4)} or length(bases) = {_sum_sql('MIS=X')}"),
    "sequence_stored": (FL.PLAIN["sequence_stored"], "length(bases) > 0"),
    "valid_start": (FL.PLAIN["valid_start"], f"{_flag(4)} or start > 0"),
    "valid_end": (FL.PLAIN["valid_end"], f'{_flag(4)} or "end" - start + 1 >= 0'),
    "not_optical_duplicate": (FL.PLAIN["not_optical_duplicate"], "coalesce(optical, '0') = '0'"),
    "agrees_with_header": (lambda: FL.agrees_with_header({"chr1": 2000, "chr2": 4000, "chr3": 1000, "chr4": 10}), f"{_flag(4)} or coalesce(start <= case contig when 'chr1' then 2000 when 'chr2' then 4000 when 'chr3' then 1000 when 'chr4' then 10 end, false)"),
    "ambiguous_bases": (lambda: FL.ambiguous_bases(), "length(regexp_replace(bases, '[ACGTacgt]', '', 'g')) <= floor(length(bases) * 0.05)"),
    "ambiguous_bases_most": (lambda: FL.ambiguous_bases(2), "length(regexp_replace(bases, '[ACGTacgt]', '', 'g')) <= 2"),
    "fragment_length": (lambda: FL.fragment_length(300), f"not {_flag(1)} or abs(tlen) <= 300"),
    "library": (lambda: FL.among("library", ["lib0", "lib2"]), "coalesce(library in ('lib0', 'lib2'), false)"),
    "sample": (lambda: FL.among("sample", ["s1"]), "coalesce(sample = 's1', false)"),
    "read_group": (lambda: FL.among("read_group", ["rg2"]), "coalesce(read_group = 'rg2', false)"),
    "read_name": (lambda: FL.among("name", ["q7", "q8/1"]), "name in ('q7', 'q8/1')"),
    "platform": (lambda: FL.platform(["illumina"]), "coalesce(contains(lower(platform), 'illumina'), false)"),
    "platform_unit": (lambda: FL.not_among("platform_unit", ["pu1", "pu3"]), "not coalesce(platform_unit in ('pu1', 'pu3'), false)"),
    "read_group_blacklist": (lambda: FL.not_among("read_group", ["rg0"]), "not coalesce(read_group = 'rg0', false)"),
    "mapping_quality": (lambda: FL.mapping_quality(20), "mapq >= 20"),
    "mapping_quality_range": (lambda: FL.mapping_quality(20, 40), "mapq between 20 and 40"),
    "read_length": (lambda: FL.read_length(1, 30), "length(bases) between 1 and 30"),
    "strand": (lambda: FL.strand(True), _flag(16)),
    "metrics": (lambda: FL.metrics(True, True), f"not {_flag(512)} and not {_flag(4)} and not {_flag(256)} and not {_flag(2048)}"),
    "overclipped": (lambda: FL.overclipped(14), "not (ops[1].op is not distinct from 'S' and ops[-1].op is not distinct from 'S' and " + _sum_sql("MIX=") + " < 14)"),
    "overclipped_one_end": (lambda: FL.overclipped(16, both_ends=False), "not ((ops[1].op is not distinct from 'S' or ops[-1].op is not distinct from 'S') and " + _sum_sql("MIX=") + " < 16)"),
    "host_alignment": (lambda: FL.host_alignment(16), f"not ({_sum_sql('M=X')} - {_sum_sql('D')} - nm >= 16)"),
    "evidence": (lambda: FL.evidence(10, 12), f"not {_flag(256)} and not {_flag(2048)} and not {_flag(1024)} and not {_flag(512)} and not {_flag(4)} and mapq between 10 and 254 and {_sum_sql('M=X')} >= 12"),
    "wellformed": (lambda: FL.wellformed(), "%WELLFORMED%"),
}
FILTERS["wellformed"] = (FILTERS["wellformed"][0], " and ".join(f"({FILTERS[x][1]})" for x in ("valid_start", "valid_end", "has_read_group", "matching_bases_and_quals", "length_equals_cigar", "sequence_stored", "no_n_operator")))


@query(f"with {READS}, a as (select [" + ", ".join(f"{{'name': '{n}', 'n': count(*) filter ({sql}), 'keys': cast(coalesce(sum(k) filter ({sql}), 0) as bigint)}}" for n, (_, sql) in FILTERS.items()) + "] xs from reads) select x.name as filter, x.n, x.keys from (select unnest(xs) x from a)")
def read_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reads each filter keeps, and which (their keys' sum). One scan."""
    return FL.kept_by(reads(spark, sf_dir), {n: f() for n, (f, _) in FILTERS.items()}, "k")


CASCADE = ("mapped", "not_duplicate", "wellformed", "mapping_quality")


@query(f"with {READS}, x as (select *, case " + " ".join(f"when not ({FILTERS[n][1]}) then {i}" for i, n in enumerate(CASCADE)) + f" else {len(CASCADE)} end d from reads), c(step, filter) as (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(CASCADE)) + ") select step, filter, (select count(*) from x where d >= step) n_in, (select count(*) from x where d = step) n_dropped from c")
def read_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.counted(reads(spark, sf_dir), {n: FILTERS[n][0]() for n in CASCADE})


@query(f"with {READS}, f as (select *, {_flag(1)} paired, not {_flag(4)} mapped, not {_flag(8)} mate_mapped from reads) select count(*) total, count(*) filter ({_flag(512)}) qc_failure, count(*) filter ({_flag(1024)}) duplicates, count(*) filter (mapped) mapped, count(*) filter (paired) paired_in_sequencing, count(*) filter (paired and {_flag(128)}) read2, count(*) filter (paired and not {_flag(128)} and {_flag(64)}) read1, count(*) filter (paired and {_flag(2)}) properly_paired, count(*) filter (paired and mapped and mate_mapped) with_itself_and_mate_mapped, count(*) filter (paired and mapped and not mate_mapped) singletons, count(*) filter (paired and mapped and mate_mapped and contig <> mate_contig) with_mate_mapped_to_a_different_contig, count(*) filter (paired and mapped and mate_mapped and contig <> mate_contig and mapq >= 5) with_mate_mapped_to_a_different_contig_mapq5 from f")
def read_flagstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flag_statistics(reads(spark, sf_dir))


SCORE = "coalesce(list_sum(list_filter(quals, lambda q: q >= 15)), 0)"
UNCLIPPED = "case when (flags & 16) <> 0 then \"end\" + list_sum(list_transform(regexp_extract_all(regexp_extract(cigar, '((\\d+[SH])*)$', 1), '\\d+'), lambda x: x::bigint)) else start - list_sum(list_transform(regexp_extract_all(regexp_extract(cigar, '^((\\d+[SH])*)', 1), '\\d+'), lambda x: x::bigint)) end"
MARKED = f"""with {READS}, m as (select *, {SCORE} score, coalesce(({UNCLIPPED}), case when (flags & 16) <> 0 then "end" else start end) u, regexp_replace(regexp_replace(name, '\\s.*$', ''), '/[12]$', '') template, (flags & 16) <> 0 r, (flags & 4) = 0 and (flags & 2304) = 0 ok from reads),
e as (select * from m where ok),
pairs as (select a.library, a.template, a.k k1, b.k k2, least((a.contig, a.u, a.r), (b.contig, b.u, b.r)) x, greatest((a.contig, a.u, a.r), (b.contig, b.u, b.r)) y, a.score + b.score score from e a join e b on a.template = b.template and a.library is not distinct from b.library and (a.flags & 65) = 65 and (b.flags & 129) = 129),
best as (select *, row_number() over (partition by library, x, y order by score desc, least(k1, k2)) > 1 dup from pairs),
ends as (select distinct library, x from pairs union select distinct library, y from pairs),
frag as (select e.k, e.library, (contig, u, r) x, score from e where k not in (select k1 from pairs union all select k2 from pairs)),
fd as (select f.k, exists (select 1 from ends where ends.library is not distinct from f.library and ends.x = f.x) or row_number() over (partition by f.library, f.x order by score desc, f.k) > 1 dup from frag f),
alld as (select k1 k, dup from best union all select k2, dup from best union all select k, dup from fd)"""


@query(f"{MARKED} select m.k, coalesce(alld.dup, false) duplicate from m left join alld using (k)")
def mark_duplicate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mark_duplicates(reads(spark, sf_dir), "k").select("k", "duplicate")


@query(f"{MARKED} select library, count(*) filter (ok and (flags & 1) = 1 and (flags & 8) = 0) paired_examined, count(*) filter (ok and not ((flags & 1) = 1 and (flags & 8) = 0)) unpaired_examined, count(*) filter ((flags & 4) <> 0) unmapped, count(*) filter ((flags & 2304) <> 0) secondary_or_supplementary, count(*) filter (coalesce(dup, false)) duplicates, round(count(*) filter (coalesce(dup, false)) / greatest(count(*) filter (ok), 1), 9) as share from m left join alld using (k) group by library")
def duplication_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplication_metrics(D.mark_duplicates(reads(spark, sf_dir), "k"))


@query(f"with {READS} select k, row_number() over (order by case contig when 'chr3' then 0 when 'chr1' then 1 when 'chr2' then 2 when 'chr5' then 3 when 'chr4' then 4 else 9 end, start, flags & 16, name, k) - 1 as place from reads")
def sort_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header order (here not that of names), unmapped reads last."""
    r = R.with_contig_index(reads(spark, sf_dir), ["chr3", "chr1", "chr2", "chr5", "chr4"])
    return O.ranked(r.select("k", "contig_idx", "start", "flags", "name"), R.coordinate_order("k")).select("k", "place")


@query(f"with {READS}, t as (select regexp_replace(regexp_replace(name, '\\s.*$', ''), '/[12]$', '') template, k, flags, contig, start from reads) select template, count(*) n, min(k) filter ((flags & 64) <> 0) as first, min(k) filter ((flags & 128) <> 0) as second, count(*) filter ((flags & 64) <> 0) = 1 and count(*) filter ((flags & 128) <> 0) = 1 and count(*) = 2 is_pair from t group by 1")
def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).withColumn("template", T.strip_mate_number(F.col("name")))
    return R.pairs(r, "template", "k")


_MASK = "case when length(bases) > 0 then array_to_string(list_transform(range(1, length(bases) + 1), lambda i: case when quals[i] < 15 then 'N' else substr(bases, i, 1) end), '') else bases end"


@query(f"with {READS} select k, regexp_replace(regexp_replace(name, '\\s.*$', ''), '/[12]$', '') as name, cast(case when mapq = 255 then 60 else mapq end as bigint) mapq, {_MASK} masked, array_to_string(list_transform(quals, lambda q: q + 31 - 31), ',') shifted, case cigar when '3M10N2D20N17M' then '3M32N17M' else cigar end cigar, array_to_string(list_transform(list_reverse(ops), lambda x: x.n || x.op), '') inverted, {_sum_sql('MIS=X')} in_read, {_sum_sql('MDN=X')} in_reference, {_sum_sql('SH')} clipped, substr(bases, 4, 10) part from reads")
def read_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    c = F.col
    lengths = T.cigar_lengths(c("cigar_text"))
    shifted = T.shift_qualities(F.transform("quals", lambda q: q + 31))
    long = lambda x, name: x.cast("long").alias(name)
    return r.select("k", T.strip_mate_number(c("name")).alias("name"), long(T.cap_mapping_quality(c("mapq")), "mapq"), T.mask_low_quality(c("bases"), c("quals"), 15).alias("masked"), F.array_join(shifted, ",").alias("shifted"), T.collapse_ndn(c("cigar_text")).alias("cigar"), T.invert_cigar(c("cigar_text")).alias("inverted"), long(lengths["read"], "in_read"), long(lengths["reference"], "in_reference"), long(lengths["clipped"], "clipped"), T.clip_to(c("bases"), c("quals"), F.lit(4), F.lit(13))["bases"].alias("part"))


def _best_cut(x: str) -> str:
    """Rows to clip from the start of a list: the last place of the greatest non-negative sum of 20 - q."""
    sums = f"list_transform(range(1, len({x}) + 1), lambda i: list_sum(list_transform({x}[1:i], lambda q: 20 - q)))"
    return f"coalesce((select max(i) from (select unnest({sums}) s, unnest(range(1, len({x}) + 1)) i) where s = (select max(s2) from (select unnest({sums}) s2)) and s >= 0), 0)"


@query(f"with {READS}, r as (select k, quals, list_reverse(quals) rq from reads), a as (select k, quals, {_best_cut('rq')} cut from r), b as (select k, quals, cut, quals[1:len(quals) - cut] rest from a) select k, cast({_best_cut('rest')} + 1 as bigint) as first, cast(len(quals) - cut as bigint) as last from b")
def quality_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("k", T.clip_ends(F.col("quals"), 20).alias("x")).select("k", F.col("x.first").cast("long").alias("first"), F.col("x.last").cast("long").alias("last"))


@query(f"with {READS}, q as (select read_group, unnest(quals) q, unnest(range(1, len(quals) + 1)) i, flags from reads where length(bases) > 0) select read_group, count(distinct (i)) cycles, count(*) total_bases, count(*) filter (q >= 20) q20_bases, count(*) filter (q >= 30) q30_bases, cast(sum(q) // 20 as bigint) q20_equivalent, count(*) filter ((flags & 512) = 0) pf_bases from q group by 1")
def quality_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quality_yield(reads(spark, sf_dir), ["read_group"])


@query(f"with {READS}, b as (select case when (flags & 128) <> 0 then 2 else 1 end end_, unnest(range(1, length(bases) + 1)) p, bases, flags from reads where length(bases) > 0), c as (select end_, case when (flags & 16) <> 0 then length(bases) - p + 1 else p end as cycle, substr(bases, p, 1) x from b) select cast(end_ as bigint) read_end, cast(cycle as bigint) as cycle, count(*) n, count(*) filter (x = 'A') a, count(*) filter (x = 'C') c, count(*) filter (x = 'G') g, count(*) filter (x = 'T') t, count(*) filter (x = 'N') n_unknown from c group by all")
def base_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.base_distribution(reads(spark, sf_dir))


@query(f"with {READS}, f as (select coalesce(library, '-') library, abs(tlen) v from reads where (flags & 2) <> 0 and (flags & 64) <> 0 and (flags & 3332) = 0 and tlen <> 0), m as (select library, quantile_disc(v, 0.5) median, count(*) n, min(v) least, max(v) most, round(avg(v), 6) mean from f group by 1) select nullif(library, '-') library, any_value(median) median, any_value(n) n, any_value(least) least, any_value(most) most, quantile_disc(abs(v - median), 0.5) mad, any_value(mean) mean from f join m using (library) group by library")
def fragment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert sizes by library: median and deviation from counts by value."""
    return R.insert_sizes(reads(spark, sf_dir), ["library"])
