"""Queries of copy number, blocks of sites, pileups, downsampling, annotations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import blocks as B
from ..operators import callsets as C
from ..operators import copynumber as N
from ..operators import intervals as I  # noqa: E741
from ..operators import sites as V
from ..operators import windows as W
from .catalog import SPANS, STAYS, TABLE2, _two_by_two, day, day_sql, items, query, spans, stays, table
from .reads import READS
from .reads import reads as read_view

COUNTS = "cts as (select l_linenumber s, l_partkey i, cast(sum(l_quantity) as double) v from lineitem group by all)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("s"), F.col("l_partkey").alias("i")).agg(F.sum("l_quantity").alias("v"))


@query(f"with {COUNTS}, x as (select cts.*, p_size b from cts join part on i = p_partkey), m as (select s, b, median(v) m, count(*) c from x group by all), w as (select m.s, n.b, sum(m.c * exp(-0.2 * abs(n.b - m.b))) / sum(m.c * exp(-0.2 * abs(n.b - m.b)) * m.m) f from m, (select unnest(range(0, 101)) b) n group by all), y as (select x.*, v * f z from x join w using (s, b)), t as (select s, sum(v) / sum(z) r from y group by 1) select s, i, round(z * r, 6) corrected from y join t using (s)")
def gc_bias_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _counts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("b")), "i")
    return N.gc_corrected(x, "s", "v", "b").select("s", "i", F.round("corrected", 6).alias("corrected"))


_RATIO = "sh as (select s, i, v / sum(v) over (partition by s) x from cts), md as (select s, median(x) m from sh group by 1), lg as (select s, i, log2(greatest(x / m, 1e-30)) l from sh join md using (s)), ct as (select s, median(l) c from lg group by 1)"


@query(f"with {COUNTS}, {_RATIO} select s, i, round(l - c, 6) copy_ratio from lg join ct using (s)")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.standardised(_counts(spark, sf_dir), "s", "i", "v").withColumn("copy_ratio", F.round("copy_ratio", 6))


PANEL = "pc as (select s, i, coalesce(v, 0) v from (select p_partkey i, s from part cross join (select distinct s from cts)) z left join cts using (s, i)), ps as (select s, i, v / sum(v) over (partition by s) x from pc), pm as (select i, median(x) m from ps group by 1), pr as (select i, m, (select count(*) from pm q where q.m < pm.m) below, (select count(*) from pm) n from pm), pk as (select i, m from pr where m > coalesce((select max(m) from pr where below < ceil(n * 10.0 / 100)), -1) and m > 0), p1 as (select s, i, x, m from ps join pk using (i)), z1 as (select s from p1 group by s having count(*) filter (x = 0) <= ceil(count(*) * 30.0 / 100)), p2 as (select p1.* from p1 join z1 using (s)), z2 as (select i from p2 group by i having count(*) filter (x = 0) <= ceil(count(*) * 20.0 / 100)), p3 as (select p2.s, i, x / m v from p2 join z2 using (i)), fl as (select i, median(v) f from p3 where v > 0 group by 1)"


@query(f"with {COUNTS}, {PANEL} select s, i, round(case when v > 0 then v else coalesce(f, 1) end, 6) as value from p3 left join fl using (i)")
def panel_of_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an interval and every line number as a sample; parts without a line count 0."""
    c = _counts(spark, sf_dir)
    every = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")).crossJoin(F.broadcast(c.select("s").distinct()))
    full = every.join(c, ["s", "i"], "left").fillna(0.0, ["v"])
    return N.panel(full, "s", "i", "v", 10.0, 20.0, 30.0).withColumn("value", F.round("value", 6))


@query(f"with {COUNTS}, {_RATIO}, g as (select s, i // 20 k, avg(l - c) m, count(*) * 10.0::double w from lg join ct using (s) group by all), a as (select *, pow(2, m) between 0.9 and 1.1 neutral from g), f as (select sum(w * m) / sum(w) m1, sqrt(greatest((sum(w * m * m) / sum(w) - (sum(w * m) / sum(w)) ** 2) * count(*) / nullif(count(*) - 1, 0), 0)) s1 from a where neutral), t as (select sum(w * m) / sum(w) mean, sqrt(greatest((sum(w * m * m) / sum(w) - (sum(w * m) / sum(w)) ** 2) * count(*) / nullif(count(*) - 1, 0), 0)) sd from a, f where neutral and abs(m - m1) <= 2 * coalesce(s1, 0)) select s, k, case when neutral then '0' when m > mean + 2 * sd then '+' when m < mean - 2 * sd then '-' else '0' end as call from a, t")
def call_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = N.standardised(_counts(spark, sf_dir), "s", "i", "v")
    segments = ratios.groupBy("s", F.floor(F.col("i") / 20).alias("k")).agg(F.avg("copy_ratio").alias("m"), (F.count("*") * 10.0).alias("w"))
    return N.called_segments(segments, "w", "m").select("s", "k", "call")


@query("with d as (select l_linenumber s, l_suppkey % 5 c, sum(l_quantity) / count(*) d from lineitem group by all), m as (select s, median(d) m from d group by 1) select s, c, cast(floor(2 * d / m + 0.5) as bigint) ploidy from d join m using (s)")
def contig_ploidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("s"), (F.col("l_suppkey") % 5).alias("c"), F.col("l_quantity").alias("v"), F.lit(1).alias("one"))
    return N.called_ploidy(d, "s", "c", "v", "one")


@query("with a as (select l_suppkey s, count(*) filter (l_returnflag = 'N') r, count(*) filter (l_returnflag = 'R') a from lineitem group by 1), x as (select s, 2 * a / nullif(a + r, 0) w from a) select s, round(w / sum(w) over (), 9) fraction from x")
def mixing_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_returnflag") == "N").cast("int").alias("r"), (F.col("l_returnflag") == "R").cast("int").alias("a"))
    return N.mixing_fractions(d, "s", "r", "a").withColumn("fraction", F.round("fraction", 9))


@query(f"with a as ({SPANS}), g as (select contig, s + 2 gs, e - 1 ge, case when o_orderkey % 2 = 0 then '+' else '-' end t from a where o_orderkey % 3 = 0) select o_orderkey, coalesce((select min(t) from g where g.contig = a.contig and abs(g.gs - a.s) <= 3 and abs(g.ge - a.e) <= 3), '0') tag from a")
def tag_germline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spans(spark, sf_dir).select("o_orderkey", "contig", "s", "e", F.lit(None).cast("string").alias("g"))
    events = a.filter("o_orderkey % 3 = 0").select(F.lit(None).cast("long").alias("o_orderkey"), "contig", (F.col("s") + 2).alias("s"), (F.col("e") - 1).alias("e"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("g"))
    both = a.unionByName(events)
    return N.tagged_germline(both, "contig", "s", "e", "g", "g", 3).filter("o_orderkey is not null").select("o_orderkey", "tag")


SITES = f"st as (select l_suppkey c, {day_sql('l_shipdate')} p, count(*) dp, cast(sum(l_quantity) as bigint) % 100 gq from lineitem group by all)"


@query(f"with {SITES}, b as (select *, case when least(gq, 60) >= 40 then 3 when gq >= 20 then 2 when gq >= 1 then 1 else 0 end band, dp > 3 v from st), m as (select *, case when lag(p) over w = p - 1 and lag(band) over w = band and not lag(v) over w then 0 else 1 end o from b window w as (partition by c order by p)), r as (select *, sum(o) over (partition by c order by p) g from m) select c, band, min(p) as start, max(p) as end, count(*) n, min(dp) min_dp, max(dp) max_dp, min(gq) min_gq, median(dp) median_dp from r where not v group by c, g, band")
def reference_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous sites in bands of quality; sites of depth above 3 are variants."""
    st = items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("c"), F.col("day").alias("p")).agg(F.count("*").alias("dp"), (F.sum("l_quantity").cast("long") % 100).alias("gq"))
    out = B.reference_blocks(st, "c", "p", "gq", "dp", [1, 20, 40], 60, F.col("dp") > 3)
    return out.select("c", F.col("band").cast("long").alias("band"), "start", "end", "n", F.col("min_depth").alias("min_dp"), F.col("max_depth").alias("max_dp"), F.col("min_quality").alias("min_gq"), F.col("median_depth").alias("median_dp"))


@query(f"with a as (select *, o_orderkey % 7 q from ({SPANS})), x as (select contig, p, sum(d) d from (select contig, s p, 1 d from a union all select contig, e + 1, -1 from a union all select contig, unnest(range((s // 50 + 1) * 50, e + 1, 50)), 0 from a) group by all), r as (select contig, p as start, lead(p) over w - 1 as end, sum(d) over w n from x window w as (partition by contig order by p)) select r.contig, r.start, r.end, cast(any_value(n) as bigint) n_samples, min(q) least from r join a on a.contig = r.contig and a.s <= r.end and a.e >= r.start where n > 0 group by all")
def combine_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spans(spark, sf_dir).withColumns({"q": F.col("o_orderkey") % 7, "k": F.col("o_orderkey")})
    return B.combined_blocks(a, "contig", "s", "e", "k", "q", every=50, width=30)


@query(f"with a as ({SPANS}), x as (select contig, p, sum(d) d from (select contig, s p, 1 d from a union all select contig, e + 1, -1 from a) group by all), r as (select contig, p as start, lead(p) over w - 1 as end, sum(d) over w depth from x window w as (partition by contig order by p)), h as (select *, case when lag(\"end\") over (partition by contig order by start) = start - 1 then 0 else 1 end o from r where depth >= 1), g as (select *, sum(o) over (partition by contig order by start) g from h) select contig, min(start) as start, max(\"end\") as end, cast(max(depth) as bigint) peak from g group by contig, g having max(depth) >= 2")
def covered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.covered_runs(spans(spark, sf_dir), "contig", "s", "e", 1, 2)


@query(f"with a as (select contig, s, e from ({SPANS}) where o_orderkey % 2 = 0), b as (select contig2 contig, s2 s, e2 e from ({STAYS}) where key2 % 5 = 0), x as (select contig, p, sum(a) a, sum(b) b from (select contig, s p, 1 a, 0 b from a union all select contig, e + 1, -1, 0 from a union all select contig, s, 0, 1 from b union all select contig, e + 1, 0, -1 from b) group by all), r as (select p, lead(p) over w q, sum(a) over w > 0 a, sum(b) over w > 0 b from x window w as (partition by contig order by p)) select cast(sum(q - p) filter (a and b) as bigint) common, cast(sum(q - p) filter (a) as bigint) covered, round(sum(q - p) filter (a and b) / sum(q - p) filter (a), 9) fraction from r")
def overlap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spans(spark, sf_dir).filter("o_orderkey % 2 = 0").select("contig", "s", "e")
    b = stays(spark, sf_dir).filter("key2 % 5 = 0").select(F.col("contig2").alias("contig"), F.col("s2").alias("s"), F.col("e2").alias("e"))
    return I.overlap_fraction(a, b, "contig", "s", "e").withColumn("fraction", F.round("fraction", 9))


@query(f"with a as ({SPANS}), b as ({STAYS}) select a.o_orderkey, a.s, b.key2 from a join b on a.contig = b.contig2 and s <= e2 and s2 <= e")
def shuffled_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with both sides shuffled, bins dealt to several tasks, and narrow bins for wide intervals."""
    on = ("contig", "s", "e"), ("contig2", "s2", "e2")
    return I.overlap_join(spans(spark, sf_dir), stays(spark, sf_dir), *on, 4, strategy="shuffle", salt=4).select("o_orderkey", "s", "key2")


@query(f"with a as ({SPANS}), b as ({STAYS}) select a.o_orderkey, count(b.key2) near, count(b.key2) filter (s2 = s) same_start from a left join b on a.contig = b.contig2 and s - 10 <= e2 and s2 <= e + 5 group by 1")
def side_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another track's intervals around each row, a window before and after; and those that start where it does."""
    a = spans(spark, sf_dir)
    found = C.side_input(a, stays(spark, sf_dir), ("contig", "s", "e"), ("contig2", "s2", "e2"), "o_orderkey", 10, 5, 30)
    starts = C.starting_at(a, stays(spark, sf_dir), ("contig", "s"), ("contig2", "s2"))
    n = found.groupBy("o_orderkey").agg(F.count("key2").alias("near"))
    m = starts.groupBy("o_orderkey").agg(F.count("key2").alias("same_start"))
    return n.join(m, "o_orderkey", "left").fillna(0, ["same_start"])


@query(f"with a as ({SPANS}), n as (select a.o_orderkey, count(*) - 1 n from a join a b on a.contig = b.contig and a.s <= b.e and b.s <= a.e group by 1) select o_orderkey from n where n >= 1")
def evidence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.evidence_density(spans(spark, sf_dir), "contig", "s", "e", "o_orderkey", 1, 30).select("o_orderkey")


PILED = f"""with {READS}, o as (select k, name, sample, contig, start, bases, quals, flags, mapq, ops, unnest(range(1, len(ops) + 1)) j from reads where contig is not null),
x as (select *, ops[j].op op, ops[j].n n, coalesce(list_sum(list_transform(list_filter(ops[1:j - 1], lambda z: contains('MIS=X', z.op)), lambda z: z.n)), 0) ir, coalesce(list_sum(list_transform(list_filter(ops[1:j - 1], lambda z: contains('MDN=X', z.op)), lambda z: z.n)), 0) iref from o),
pile as (select contig, cast(start + iref + i as bigint) as place, k, name, sample, ir + i as offs, substr(bases, cast(ir + i + 1 as bigint), 1) base, quals[cast(ir + i + 1 as bigint)] quality, flags, mapq from (select *, unnest(range(0, n)) i from x where contains('M=X', op)))"""


@query(f"{PILED} select contig, place as \"at\", count(*) depth, count(*) filter (quality >= 10 and base = 'A') a, count(*) filter (quality >= 10 and base = 'C') c, count(*) filter (quality >= 10 and base = 'G') g, count(*) filter (quality >= 10 and base = 'T') t from pile group by all")
def pileup_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.loci(B.pileup(read_view(spark, sf_dir), "k"), 10)


@query(f"{PILED}, l as (select contig, place, count(*) depth, count(*) filter (base = 'A') a, count(*) filter (base = 'C') c, count(*) filter (base = 'G') g, count(*) filter (base = 'T') t from pile group by all), r as (select unnest(['chr1', 'chr3']) contig, unnest([range(100, 300), range(1000, 1400)]) xs), e as (select contig, unnest(xs) place from r) select e.contig, cast(e.place as bigint) as \"at\", coalesce(depth, 0) depth, coalesce(a, 0) a, coalesce(c, 0) c, coalesce(g, 0) g, coalesce(t, 0) t from e left join l on l.contig = e.contig and l.place = e.place")
def pileup_all_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of two intervals, the empty ones too."""
    found = B.loci(B.pileup(read_view(spark, sf_dir), "k"))
    intervals = spark.createDataFrame([("chr1", 100, 299), ("chr3", 1000, 1399)], "contig string, start int, end int")
    return B.all_loci(found, intervals, ["depth", "a", "c", "g", "t"]).withColumn("at", F.col("at").cast("long"))


@query(f"{PILED}, z as (select * replace (name as name, 'q' || k % 50 as name) from pile), w as (select *, count(distinct coalesce(base, '')) over (partition by contig, place, sample, name) d, row_number() over (partition by contig, place, sample, name order by coalesce(quality, -1) desc, k) r from z) select contig, place as \"at\", k, base from w where d = 1 and r = 1".replace("* replace (name as name, 'q' || k % 50 as name)", "* replace ('q' || k % 50 as name)"))
def resolve_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names shared by many reads here, so that fragments overlap."""
    elements = B.pileup(read_view(spark, sf_dir), "k").withColumns({"name": F.concat(F.lit("q"), (F.col("read") % 50).cast("string")), "quality": F.coalesce("quality", F.lit(-1))})
    return B.resolved_fragments(elements).select("contig", "at", F.col("read").alias("k"), "base")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where substr(md5(concat(l_orderkey, ':', l_linenumber)), 1, 8) < '40000000'")
def downsample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.fraction(table(spark, sf_dir, "lineitem"), 0.25, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity")


@query("with s as (select c_nationkey g, count(*) n from customer group by 1), z as (select n, sum(n) over (order by n, g) - n below, row_number() over (order by n, g) - 1 smaller, count(*) over () total from s), l as (select max(least(n, floor((200 - below) / (total - smaller)))) level from z), r as (select c_custkey, row_number() over (partition by c_nationkey order by md5(cast(c_custkey as varchar))) r from customer) select c_custkey from r, l where r <= level")
def downsample_levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.levelled(table(spark, sf_dir, "customer"), "c_nationkey", 200, F.md5(F.col("c_custkey").cast("string"))).select("c_custkey")


@query(f"with i as (select l_suppkey g, {day_sql('l_shipdate')} // 500 b, cast(l_quantity as bigint) v from lineitem), w as (select g, b, v from i union all select g, b - 1, v from i), q as (select distinct w.g, w.b, p.v from w join (select distinct g, v from i) p using (g)), f as (select q.g, q.b, q.v, (select count(*) from w where w.g = q.g and w.b = q.b and w.v <= q.v) / (select count(*) from w where w.g = q.g and w.b = q.b) here, (select count(*) from i where i.g = q.g and i.v <= q.v) / (select count(*) from i where i.g = q.g) whole from q where q.g < 5) select g, b * 500 as start, (select count(*) from w where w.g = f.g and w.b = f.b) n, round(max(abs(here - whole)), 9) distance from f group by g, b")
def ks_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).filter("l_suppkey < 5").select(F.col("l_suppkey").alias("g"), "day", F.col("l_quantity").cast("long").alias("v"))
    return W.ks_windows(d, "g", "day", "v", 500).withColumn("distance", F.round("distance", 9))


@query("with r as (select l_suppkey k, l_returnflag = 'R' f, l_quantity q from lineitem where l_quantity <> 50 and l_quantity <> 1 and l_linestatus = 'O'), x as (select k, f, rank() over (partition by k order by q) + (count(*) over (partition by k, q) - 1) / 2 r, count(*) over (partition by k, q) c from r), s as (select k, count(*) filter (f) n1, count(*) filter (not f) n2, sum(r) filter (f) r1, sum(c * c - 1) t, count(*) n from x group by k) select k, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1.0)))), 3) z from s where n1 > 0 and n2 > 0")
def gated_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank sums by site, alternate reads first; reads of mapping quality 0 or 255 (here 1 and 50) don't count; three decimals."""
    d = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_suppkey").alias("k"), "l_quantity", "l_returnflag")
    return V.rank_sum_annotation(d, ["k"], F.col("l_returnflag") == "R", "l_quantity", ~F.col("l_quantity").isin(1, 50)).select("k", "z")


@query(f"with {READS} select c.contig, c.sample, count(*) depth, count(*) filter (contains(bases, 'GA')) alt_depth, median(mapq) mapq_median, cast(max(list_sum(list_transform(list_filter(ops, lambda x: x.op = 'H'), lambda x: x.n))) as bigint) hard_clipped from reads c where contig is not null and mapq not in (0, 255) group by all")
def depth_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Informative reads by sample, and how many hold the alternate allele (here a motif)."""
    r = read_view(spark, sf_dir).filter("contig is not null and mapq not in (0, 255)")
    clipped = F.aggregate(F.filter("cigar", lambda x: x["op"] == "H"), F.lit(None).cast("long"), lambda a, x: F.coalesce(a, F.lit(0)) + x["len"])
    out = V.sample_depths(r.withColumn("hard", clipped), ["contig"], "sample", F.col("bases").contains("GA"), F.max("hard").alias("hard_clipped"))
    middle = A.exact_median(r, ["contig", "sample"], "mapq", "mapq_median")
    from ..functions.joins import null_safe

    return null_safe(out, middle, ["contig", "sample"])


@query("with d as (select doc_id, upper(regexp_replace(text, '[^acgtuACGTU]', '', 'g')) s from documents), c as (select doc_id, s, list_transform(regexp_extract_all(replace(s, 'U', 'T'), '...'), lambda x: translate(x, 'TCAG', '0123')) cs from d) select doc_id, md5(coalesce(array_to_string(list_transform(cs, lambda x: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * substr(x, 1, 1)::int + 4 * substr(x, 2, 1)::int + substr(x, 3, 1)::int + 1, 1)), ''), '')) protein from c")
def amino_acids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^acgtuACGTU]", "")).alias("s"))
    return d.select("doc_id", F.md5(S.amino_acids(F.col("s"))).alias("protein"))


@query(f"with t as ({TABLE2}) select k, round((lgamma(a + b + c + 1) - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1)) / ln(10), 6) multinomial, round((lgamma(a + b + c + 1) - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1)) / ln(10) + (lgamma(2 + a) - lgamma(2) + lgamma(3 + b) - lgamma(3) + lgamma(1 + c) - lgamma(1) - lgamma(6 + a + b + c) + lgamma(6)) / ln(10), 6) dirichlet, round((lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + a * ln(0.3) + b * ln(0.7)) / ln(10), 6) binomial, round(-((d - 10.0::double) ** 2) / (2 * 9) / ln(10) - log10(3 * sqrt(2 * pi())), 6) gaussian, round(exp(-((d - 10.0::double) ** 2) / 18) / (3 * sqrt(2 * pi())), 9) density, case when a + b > 0 then printf('%.2f%%', 100.0 * a / (a + b)) else 'NA' end as share from t")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _two_by_two(spark, sf_dir)
    c = F.col
    counts, weights = F.array("a", "b", "c"), F.array(*[F.lit(x).cast("long") for x in (2, 3, 1)])
    binomial = S.log10_binomial_pmf(c("a") + c("b"), c("a"), 0.3)
    return t.select("k", F.round(S.log10_multinomial(counts), 6).alias("multinomial"), F.round(S.log10_dirichlet_multinomial(counts, weights), 6).alias("dirichlet"), F.round(binomial, 6).alias("binomial"), F.round(S.log10_gaussian(c("d"), 10.0, 3.0), 6).alias("gaussian"), F.round(S.gaussian(c("d"), 10.0, 3.0), 9).alias("density"), S.percent(c("a"), c("a") + c("b")).alias("share"))


@query("with v as (select vec_id, list_transform(embedding[1:6], lambda x: -1 - abs(x::double)) v from embeddings), s as (select vec_id, v, list_sum(list_transform(v, lambda x: pow(10, x))) t from v) select vec_id, round(ln(1 - exp(v[1])), 6) log1m, round(log10(1 - pow(10, v[2])), 6) log10_1m, round(log10(t), 6) log10_sum, round(pow(10, v[1]) / t, 6) first_share, round(v[3] - list_min(v), 6) renormalised, round(list_avg(v), 6) mean, round(list_sum(list_transform(range(1, 7), lambda i: v[i] * v[i])), 6) dot, round(v[1] + v[2] + v[3], 6) third_sum, round(2 * v[4], 6) doubled from s")
def log_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: -1 - F.abs(x.cast("double"))).alias("v"))
    c, at = F.col("v"), lambda i: F.get("v", F.lit(i))
    r = lambda x, name: F.round(x, 6).alias(name)
    return v.select("vec_id", r(S.log1m_exp(at(0)), "log1m"), r(S.log10_one_minus(at(1)), "log10_1m"), r(S.log10_sum(c), "log10_sum"), r(F.get(S.normalise_log10(c), F.lit(0)), "first_share"), r(F.get(S.renormalise_pl(c), F.lit(2)), "renormalised"), r(S.mean_of(c), "mean"), r(S.dot(c, c), "dot"), r(F.get(S.cumulative(c), F.lit(2)), "third_sum"), r(F.get(S.plus(c, c), F.lit(3)), "doubled"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M') told, cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) as bigint) k, md5(event_type) hash, string_split(event_type, 'i')[1] head, repeat('ab', cast(event_id % 3 as bigint)) twice, event_type || '-' || user_id joined, regexp_matches(event_type, 'c[kl]') matched, 'GATC'[cast(event_id % 4 + 1 as bigint)] base, case cast(event_id % 4 as bigint) when 0 then 'G' when 1 then 'A' when 2 then 'T' else 'C' end iupac from events")
def strings_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    base = F.substring(F.lit("GATC"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("told"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.md5("event_type").alias("hash"), F.split_part("event_type", F.lit("i"), F.lit(1)).alias("head"), F.repeat(F.lit("ab"), (F.col("event_id") % 3).cast("int")).alias("twice"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("joined"), F.col("event_type").rlike("c[kl]").alias("matched"), base.alias("base"), S.iupac_bases(base).alias("iupac"))


@query("with o as (select o_orderkey k, row_number() over (order by o_totalprice desc, o_orderkey) r from orders) select k, r as place from o where r > 10 and r <= 35")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 rows after the first 10 of an order: each task keeps 35, no global sort."""
    return C.page(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), [F.desc("o_totalprice"), F.col("k")], 25, 10, "place").select("k", "place")


@query("with k as (select o_custkey g, count(*) n from orders group by 1) select g, n from k where n between 8 and 12")
def kmer_cleaner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur neither too rarely nor too often."""
    return A.counted_between(table(spark, sf_dir, "orders"), F.col("o_custkey").alias("g"), 8, 12)


@query("with f as (select l_orderkey, l_linenumber, list_filter([case when l_quantity < 10 then 'few' end, case when l_discount > 0.07 then 'cheap' end, case when l_tax > 0.06 then 'taxed' end], lambda x: x is not null) fs, l_returnflag = 'R' t from lineitem), x as (select unnest(fs) f, len(fs) n, t from f) select f as filter, count(*) filter (not t) tn, count(*) filter (t) fn, count(*) filter (not t and n = 1) unique_tn, count(*) filter (t and n = 1) unique_fn from x group by 1")
def filter_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    tagged = table(spark, sf_dir, "lineitem").withColumn("fs", F.array_compact(F.array(F.when(c("l_quantity") < 10, "few"), F.when(c("l_discount") > 0.07, "cheap"), F.when(c("l_tax") > 0.06, "taxed"))))
    return C.filter_analysis(tagged, "fs", F.col("l_returnflag") == "R")


@query(f"with a as ({SPANS}), b as ({STAYS}) select o_orderkey, key2 from a join b on a.contig = b.contig2 and s <= e2 and s2 <= e")
def ranged_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of interval_overlap_join by ranges, after a check that no interval is too long."""
    a = I.no_longer_than(spans(spark, sf_dir), "s", "e", 1000)
    return I.overlapping_pairs(a, stays(spark, sf_dir), ("contig", "s", "e"), ("contig2", "s2", "e2"), "o_orderkey", "key2", 30, "ranges")


@query(f"with a as (select o_orderkey k, contig, s, e, (o_orderkey * 7) % 5 tc, s % 100 ts, s % 100 + 20 te from ({SPANS})) select x.k a, y.k b from a x join a y on x.k < y.k and x.contig = y.contig and x.s <= y.e and y.s <= x.e and x.tc = y.tc and x.ts <= y.te and y.ts <= x.te")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of evidence that point from overlapping places to overlapping places."""
    a = spans(spark, sf_dir).select(F.col("o_orderkey").alias("k"), "contig", "s", "e", ((F.col("o_orderkey") * 7) % 5).alias("tc"), (F.col("s") % 100).alias("ts"), (F.col("s") % 100 + 20).alias("te"))
    return I.linked_pairs(a, "k", ("contig", "s", "e"), ("tc", "ts", "te"), 30)


_GL = lambda shift: f"list_transform([0, 1, 2], lambda g: -abs((k + {shift}) % 3 - g) * ((k + {shift}) % 7 + 1) / 2.0::double)"


@query(f"with o as (select o_orderkey k from orders), l as (select k, {_GL(0)} m, {_GL(1)} f, {_GL(5)} c from o), g as (select unnest([0, 1, 2]) x), w as (select k, a.x i, b.x j, z.x h, pow(10, m[a.x + 1] + f[b.x + 1] + c[z.x + 1]) * case least(abs(z.x - ((a.x + 1) // 2) - ((b.x + 1) // 2)), abs(z.x - (a.x // 2) - (b.x // 2)), abs(z.x - ((a.x + 1) // 2) - (b.x // 2)), abs(z.x - (a.x // 2) - ((b.x + 1) // 2))) when 0 then 1 - 10 * 0.001 - 0.001 * 0.001 when 1 then 0.001 else 0.001 * 0.001 end p from l, g a, g b, g z) select k, round(sum(p) filter (i = 1) / sum(p), 9) mother_het, round(sum(p) filter (j = 0) / sum(p), 9) father_ref, round(sum(p) filter (h = 2) / sum(p), 9) child_alt from w group by k")
def family_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of trios, each helped by the other two."""
    k = F.col("o_orderkey")
    gl = lambda shift: F.array(*[-(F.abs((k + shift) % 3 - g) * ((k + shift) % 7 + 1)) / 2.0 for g in range(3)])
    o = table(spark, sf_dir, "orders").select(k.alias("k"), gl(0).alias("mother"), gl(1).alias("father"), gl(5).alias("child"))
    out = V.family_posteriors(o, "mother", "father", "child", 1e-3)
    return out.select("k", F.round(F.col("mother_posterior")[1], 9).alias("mother_het"), F.round(F.col("father_posterior")[0], 9).alias("father_ref"), F.round(F.col("child_posterior")[2], 9).alias("child_alt"))


@query(f"{PILED}, e as (select contig, place, k, offs, base, quality, flags, 'r' || k % 3 g from pile where quality >= 6 and base in ('A', 'C', 'G', 'T') and not exists (select 1 from nation where place = n_nationkey * 90 + 100 and contig = 'chr' || (n_nationkey % 5 + 1))), f as (select e.*, bases rb from e join reads using (k)), h as (select g, quality q, case when offs > 0 and substr(rb, cast(offs as bigint), 1) <> 'N' then substr(rb, cast(offs as bigint), 1) || base end context, cast((case when (flags & 16) <> 0 then length(rb) - offs else offs + 1 end) * case when (flags & 128) <> 0 then -1 else 1 end as bigint) as cycle, (base = 'T')::bigint error from f) select g, q, context, cycle, cast(grouping(g) * 8 + grouping(q) * 4 + grouping(context) * 2 + grouping(cycle) as bigint) as level, count(*) n, cast(sum(error) as bigint) errors from h group by grouping sets ((g, q), (g, q, context), (g, q, cycle))")
def covariate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalibration by context and cycle, known places left out (an error is a T here)."""
    r = read_view(spark, sf_dir)
    elements = B.pileup(r, "k").join(r.select(F.col("k").alias("read"), F.col("bases").alias("read_bases")), "read").withColumn("g", F.concat(F.lit("r"), (F.col("read") % 3).cast("string")))
    n = F.col("n_nationkey")
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("chr"), (n % 5 + 1).cast("string")).alias("contig"), (n * 90 + 100).alias("at"))
    return V.covariate_tables(elements, known, "g", F.col("base") == "T")


@query(f"with {READS}, t as (select regexp_replace(regexp_replace(name, '\\s.*$', ''), '/[12]$', '') template from reads) select template, count(*) n, 1::bigint parts from t group by 1")
def names_in_one_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads dealt by name: each name's rows lie in one partition."""
    from ..operators import readsets as R
    from ..operators import transforms as TR

    r = read_view(spark, sf_dir).withColumn("template", TR.strip_mate_number(F.col("name")))
    dealt = R.by_name(r.select("template", "k"), "template").withColumn("pid", F.spark_partition_id())
    return dealt.groupBy("template").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("parts"))


@query("with s as (select l_suppkey g, cast(sum(l_quantity) as bigint) size from lineitem group by 1), r as (select g, size, (row_number() over (order by size desc, g) - 1) % 8 p from s) select count(*) n_groups, max(size) most, count(distinct p) parts from r")
def size_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups dealt to partitions by size: each group lies in one, the largest in different ones."""
    from ..operators import readsets as R

    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").cast("long").alias("v"))
    dealt = R.size_ordered(d, "g", "v", 8).withColumn("pid", F.spark_partition_id())
    sizes = dealt.groupBy("g", "pid").agg(F.sum("v").alias("size"))
    return sizes.agg(F.count("*").alias("n_groups"), F.max("size").alias("most"), F.countDistinct("pid").alias("parts"))


@query(f"with {COUNTS} select s, i, v as value from cts")
def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long table written as rows of a matrix with its column names, and read again; missing cells stay missing."""
    from ..sources import matrix
    from ..sources.shared import scratch

    path = scratch(spark, "matrix")
    matrix.write_matrix(_counts(spark, sf_dir), path, "s", "i", "v", 500)
    back = matrix.read_matrix(spark, path)
    return back.select(F.col("row").cast("int").alias("s"), F.col("column").cast("long").alias("i"), "value")
