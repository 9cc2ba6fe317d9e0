"""Queries of sites, genotypes and read transforms. Line items stand in for reads, part brands for sites."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sites as V
from ..operators import transforms as T
from .catalog import day_sql, items, query, table


def best_sql(errors: str, n: str, reported: str) -> str:
    shift = f"abs(trunc(q - {reported}))"
    prior = f"case when {shift} >= {V.FAR} then {V.IMPOSSIBLE} else {math.log10(V.PRIOR_PEAK)!r} - {shift} * {shift} * {math.log10(math.e) / (2 * V.PRIOR_SD**2)!r} end"
    fit = f"case when q = 0 then {V.IMPOSSIBLE} else -q / 10.0::double * ({errors} + 1) + ({n} + 2 - ({errors} + 1)) * log10(1 - pow(10.0::double, -greatest(q, 1) / 10.0::double)) end"
    grid = f"list_transform(range(0, {V.GRID + 1}), lambda q: {prior} + {fit})"
    return f"(list_position({grid}, list_max({grid})) - 1)"


RECALIBRATED = f"""with c as (select l_linestatus g, cast(l_quantity as bigint) r, l_linenumber c, count(*) n, count(*) filter (l_returnflag = 'R' and l_discount > 0.05) e from lineitem group by all),
a as (select g, sum(n) n, sum(e) e, -10 * log10(sum(n * pow(10.0::double, -r / 10.0::double)) / sum(n)) b from c group by g), a2 as (select g, {best_sql('e', 'n', 'b')} q1 from a),
b as (select g, r, sum(n) n, sum(e) e from c group by g, r), b2 as (select g, r, {best_sql('e', 'n', 'q1')} q2 from b join a2 using (g)),
d as (select g, r, c, n, e, q2, {best_sql('e', 'n', 'q2')} q3 from c join b2 using (g, r))
select g, r, c, n, e as errors, cast(greatest(1, least({V.MOST}, q3)) as bigint) recalibrated from d"""


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("g"), F.col("l_quantity").cast("long").alias("r"), F.col("l_linenumber").alias("c"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)).alias("error"))


@query(RECALIBRATED)
def recalibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recalibrated(_bases(spark, sf_dir), "g", "r", ["c"], F.col("error"))


@query(f"with t as ({RECALIBRATED}) select l_orderkey, l_linenumber, recalibrated from lineitem join t on l_linestatus = g and l_quantity = r and l_linenumber = c")
def apply_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = _bases(spark, sf_dir)
    return V.apply_recalibration(bases, V.recalibrated(bases, "g", "r", ["c"], F.col("error")), ["g", "r", "c"], "r").select("l_orderkey", "l_linenumber", "recalibrated")


@query("with r as (select l_suppkey k, l_returnflag = 'R' alt, least(1 - 1e-15, pow(10.0::double, -l_quantity / 10)) e from lineitem), s as (select k, count(*) depth, sum(log10(case when alt then e else 1 - e end)) l0, count(*) * log10(0.5::double) l1, sum(log10(case when alt then 1 - e else e end)) l2 from r group by k), p as (select k, depth, list_transform([l0, l1, l2], lambda x: cast(floor(-10 * (x - greatest(l0, l1, l2)) + 0.5) as bigint)) pl from s) select k, depth, pl[1] pl0, pl[2] pl1, pl[3] pl2, cast(list_position(pl, list_min(pl)) - 1 as bigint) genotype, least(99, list_sort(pl)[2]) gq from p")
def genotype_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey"))
    return V.diploid_likelihoods(d, ["k"], F.col("l_returnflag") == "R", F.col("l_quantity"))


@query("with c as (select p_brand k, count(*) filter (p_size <= 15) rr, count(*) filter (p_size > 15 and p_size <= 35) ra, count(*) filter (p_size > 35) aa from part group by 1), x as (select *, least(2 * rr + ra, 2 * aa + ra) rare, rr + ra + aa n from c), h as (select *, unnest(range(rare % 2, rare + 1, 2)) h from x), w as (select *, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma(n - h - (rare - h) / 2 + 1) lw from h), t as (select *, max(lw) over (partition by k) top from w) select k, round(case when max(rare) <= 1 then -10 * log10(0.5) else abs(-10 * log10(sum(case when h > ra then exp(lw - top) when h = ra then exp(lw - top) / 2 else 0 end) / sum(exp(lw - top)))) end, 6) excess from t group by k")
def excess_heterozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(F.count_if(F.col("p_size") <= 15).alias("rr"), F.count_if(F.col("p_size").between(16, 35)).alias("ra"), F.count_if(F.col("p_size") > 35).alias("aa"))
    return g.select("k", F.round(V.excess_het(F.col("rr"), F.col("ra"), F.col("aa")), 6).alias("excess"))


@query("with a as (select p_brand, p_size % 4 - 1 allele from part union all select p_brand, p_partkey % 3 from part), c as (select p_brand, allele, count(*) ac from a where allele >= 0 group by all) select p_brand, cast(allele as bigint) allele, ac, cast(sum(ac) over (partition by p_brand) as bigint) an, round(ac / sum(ac) over (partition by p_brand), 9) af from c qualify allele > 0")
def allele_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 4 - 1).cast("long").alias("x"), (F.col("p_partkey") % 3).cast("long").alias("y"))
    return V.allele_numbers(d, ["p_brand"], ["x", "y"]).withColumn("af", F.round("af", 9))


@query("select l_suppkey, l_returnflag, median(l_quantity) median_l_quantity, median(l_linenumber) median_l_linenumber from lineitem group by all")
def allele_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.allele_medians(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity", "l_linenumber"])


@query("with r as (select l_suppkey, l_returnflag = 'R' a, l_linestatus = 'O' v, l_linenumber % 2 = 1 f from lineitem) select l_suppkey, count(*) filter (not a and not v) ref_fwd, count(*) filter (not a and v) ref_rev, count(*) filter (a and not v) alt_fwd, count(*) filter (a and v) alt_rev, count(*) filter (a and f <> v) alt_f1r2, count(*) filter (a and f = v) alt_f2r1, round(count(*) filter (a and f <> v) / nullif(count(*) filter (a), 0), 9) as share from r group by 1")
def strand_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return V.strand_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey"], c("l_returnflag") == "R", c("l_linestatus") == "O", c("l_linenumber") % 2 == 1).withColumn("share", F.round("share", 9))


@query(f"select l_suppkey, count(distinct ({day_sql('l_shipdate')}, l_quantity)) unique_alt from lineitem where l_returnflag = 'R' group by 1")
def unique_alt_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unique_alt_reads(items(spark, sf_dir), ["l_suppkey"], F.col("l_returnflag") == "R", "day", "l_quantity")


@query("with t as (select l_orderkey k, max(case when l_linenumber = 1 then l_returnflag end) m, max(case when l_linenumber = 2 then l_returnflag end) f, max(case when l_linenumber = 3 then l_returnflag end) c, max(case when l_linenumber = 1 then l_quantity end) mq, max(case when l_linenumber = 2 then l_quantity end) fq, max(case when l_linenumber = 3 then l_quantity end) cq from lineitem group by 1) select k, case when cq >= 20 and mq >= 20 and fq >= 20 then 'hi' else 'lo' end confidence from t where c <> 'N' and m = 'N' and f = 'N' and cq >= 10 and mq > 0 and fq > 0")
def possible_de_novo(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda i, c: F.max(F.when(F.col("l_linenumber") == i, F.col(c)))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(*[one(i, c).alias(f"{c}{i}") for i in (1, 2, 3) for c in ("l_returnflag", "l_quantity")])
    c = F.col
    return t.select("k", V.de_novo(c("l_returnflag3") != "N", (c("l_returnflag1") == "N") & (c("l_returnflag2") == "N"), c("l_quantity3"), c("l_quantity1"), c("l_quantity2")).alias("confidence")).filter("confidence is not null")


@query("with t as (select o_orderkey, cast(o_orderkey as varchar) s from orders), k as (select *, list_filter(range(1, length(s) + 1), lambda k: length(s) % k = 0 and repeat(substr(s, 1, k), length(s) // k) = s)[1] k from t) select o_orderkey, substr(s, 1, k) unit, cast(length(s) // k as bigint) times from k")
def tandem_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", V.repeat_unit(F.col("o_orderkey").cast("string")).alias("r"))
    return d.select("o_orderkey", "r.unit", "r.times")


@query("with h as (select p_partkey, upper(p_name) s, list_filter(range(1, greatest(length(p_name) - 5, 1) + 1), lambda i: length(regexp_replace(substr(upper(p_name), i, 6), '[^ATN]', '', 'g')) >= 3 or length(regexp_replace(substr(upper(p_name), i, 6), '[^GCN]', '', 'g')) >= 3) h from part) select p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i: case when len(list_filter(h, lambda j: j <= i and i < j + 6)) > 0 then 'N' else substr(s, i, 1) end), '') masked from h")
def simple_repeat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("s")).select("p_partkey", T.mask_simple_repeats(F.col("s"), 6, 3, 3).alias("masked"))


@query("with x as (select p_partkey, p_type t, list_min(list_filter(list_transform(range(1, length(p_type) - 3 + 2), lambda s: {'m': list_sum(list_transform(range(0, 5), lambda j: case when s + j <= length(p_type) and substr(p_type, s + j, 1) <> substr('STEEL', j + 1, 1) then 1 else 0 end)), 's': s}), lambda b: b.m <= 1)) b from part) select p_partkey, case when b is null then t else substr(t, 1, b.s - 1) end trimmed from x")
def adapter_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.trim_adapter(F.col("p_type"), ["STEEL"], 1, 3).alias("trimmed"))
