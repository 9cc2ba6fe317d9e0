"""Named queries on the driver's tables, each beside its DuckDB equivalent.

Line items stand in for reads (contig: supplier, position: ship day), orders
for intervals (contig: customer), events for a position-ordered stream (contig:
user, position: second), documents for sequences, regions and nations for a
taxonomy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import callsets as C
from ..operators import filters as FL
from ..operators import intervals as I  # noqa: E741
from ..operators import transforms as T
from ..operators import windows as W
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    return F.datediff(F.to_date(column), F.lit("1992-01-01")).cast("long")


def day_sql(column: str) -> str:
    return f"date_diff('day', date '1992-01-01', cast({column} as date))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("day", day("l_shipdate"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals of up to 30 days per customer."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("contig"), day("o_orderdate").alias("s"), (day("o_orderdate") + F.pmod("o_orderkey", F.lit(30))).alias("e"), "o_totalprice")


SPANS = f"select o_orderkey, o_custkey contig, {day_sql('o_orderdate')} s, {day_sql('o_orderdate')} + o_orderkey % 30 e, o_totalprice from orders"


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals per customer again, of 60 days each."""
    return spans(spark, sf_dir).select(F.col("o_orderkey").alias("key2"), F.col("contig").alias("contig2"), F.col("s").alias("s2"), (F.col("s") + 60).alias("e2"))


STAYS = f"select o_orderkey key2, contig contig2, s s2, s + 60 e2 from ({SPANS})"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("tick", F.unix_timestamp("ts"))


TICKS = "select *, cast(floor(epoch(ts)) as bigint) as tick from events"


@query("select count(*) total, count(*) filter (l_returnflag = 'R') returned, count(*) filter (l_returnflag = 'A') accepted, count(*) filter (l_returnflag <> 'R' and l_linestatus = 'O') open_items, count(*) filter (l_discount = 0) no_discount, count(*) filter (l_quantity > 25 and l_discount > 0.05) large_discounted, count(*) filter (l_tax > 0.04) high_tax, count(*) filter (l_linenumber = 1) first_lines from lineitem")
def flagstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return A.flag_statistics(table(spark, sf_dir, "lineitem"), {"returned": c("l_returnflag") == "R", "accepted": c("l_returnflag") == "A", "open_items": (c("l_returnflag") != "R") & (c("l_linestatus") == "O"), "no_discount": c("l_discount") == 0, "large_discounted": (c("l_quantity") > 25) & (c("l_discount") > 0.05), "high_tax": c("l_tax") > 0.04, "first_lines": c("l_linenumber") == 1})


@query("select 0 step, 'quantity' as filter, count(*) n_in, count(*) filter (l_quantity < 5) n_dropped from lineitem union all select 1, 'discount', count(*) filter (l_quantity >= 5), count(*) filter (l_quantity >= 5 and l_discount > 0.08) from lineitem union all select 2, 'status', count(*) filter (l_quantity >= 5 and l_discount <= 0.08), count(*) filter (l_quantity >= 5 and l_discount <= 0.08 and l_linestatus <> 'F') from lineitem")
def count_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.counted(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") >= 5, "discount": F.col("l_discount") <= 0.08, "status": F.col("l_linestatus") == "F"})


@query("select l_orderkey, l_linenumber, case when l_quantity < 5 and l_discount > 0.05 then 'few;discount' when l_quantity < 5 then 'few' when l_discount > 0.05 then 'discount' else 'PASS' end filters from lineitem")
def site_filter_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = FL.tag(table(spark, sf_dir, "lineitem"), {"few": F.col("l_quantity") < 5, "discount": F.col("l_discount") > 0.05})
    return tagged.select("l_orderkey", "l_linenumber", F.array_join("filters", ";").alias("filters"))


@query("select l_returnflag, l_linestatus, count(*) n from lineitem where l_quantity >= 10 and l_discount between 0.02 and 0.08 and l_tax < 0.06 and l_shipdate >= timestamp '1994-01-01' group by all")
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return C.select(table(spark, sf_dir, "lineitem"), [c("l_quantity") >= 10, c("l_discount").between(0.02, 0.08), c("l_tax") < 0.06, c("l_shipdate") >= F.lit("1994-01-01").cast("timestamp")]).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"with b as (select s_suppkey contig, unnest(range(0, 2700, 30)) s from supplier), p as (select l_suppkey contig, {day_sql('l_shipdate')} d from lineitem) select b.contig, cast(b.s as bigint) bin_start, cast(b.s + 29 as bigint) bin_end, count(p.d) n from b left join p on p.contig = b.contig and p.d // 30 = b.s // 30 group by all")
def point_in_bin_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contig"), F.lit(0).cast("long").alias("s"), F.lit(2699).cast("long").alias("e"))
    bins = I.tile(whole, "s", "e", 30)
    points = items(spark, sf_dir).select(F.col("l_suppkey").alias("contig"), "day")
    return I.count_starts(bins, points, "contig", "bin_start", "bin_end", "day", 30).select("contig", "bin_start", "bin_end", "n")


@query(f"with a as ({SPANS}), b as ({STAYS}) select a.o_orderkey, b.key2, a.contig from a join b on a.contig = b.contig2 and s <= e2 and s2 <= e")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlap_join(spans(spark, sf_dir), stays(spark, sf_dir), ("contig", "s", "e"), ("contig2", "s2", "e2"), 30).select("o_orderkey", "key2", "contig")


@query(f"with a as ({SPANS}), b as ({STAYS}) select o_orderkey, s, e from a where exists (select 1 from b where a.contig = b.contig2 and s <= e2 and s2 <= e)")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlap_join(spans(spark, sf_dir), stays(spark, sf_dir), ("contig", "s", "e"), ("contig2", "s2", "e2"), 30, "semi", "o_orderkey").select("o_orderkey", "s", "e")


@query(f"with a as ({SPANS}), b as (select * from ({STAYS}) where key2 % 5 = 0) select o_orderkey, s, e from a where not exists (select 1 from b where a.contig = b.contig2 and s <= e2 and s2 <= e)")
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no stay of every fifth order overlaps."""
    return I.overlap_join(spans(spark, sf_dir), stays(spark, sf_dir).filter("key2 % 5 = 0"), ("contig", "s", "e"), ("contig2", "s2", "e2"), 30, "anti", "o_orderkey").select("o_orderkey", "s", "e")


@query(f"with a as ({SPANS}), b as ({STAYS}) select o_orderkey, count(b.key2) n_overlaps from a left join b on a.contig = b.contig2 and s <= e2 and s2 <= e group by all")
def overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlap_join(spans(spark, sf_dir), stays(spark, sf_dir), ("contig", "s", "e"), ("contig2", "s2", "e2"), 30, "count", "o_orderkey").select("o_orderkey", "n_overlaps")


@query(f"with a as ({SPANS}), b as ({STAYS}) select o_orderkey, key2 from a left join b on a.contig = b.contig2 and s <= e2 and s2 <= e")
def overlap_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlap_join(spans(spark, sf_dir), stays(spark, sf_dir), ("contig", "s", "e"), ("contig2", "s2", "e2"), 30, "left", "o_orderkey").select("o_orderkey", "key2")


def _merge_sql(gap: int) -> str:
    return f"with a as ({SPANS}), m as (select *, case when s <= max(e) over (partition by contig order by s, e rows between unbounded preceding and 1 preceding) + {gap} then 0 else 1 end o from a), i as (select *, sum(o) over (partition by contig order by s, e rows unbounded preceding) g from m) select contig, min(s) s, max(e) e, count(*) n from i group by contig, g"


@query(_merge_sql(1))
def interval_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge(spans(spark, sf_dir), "contig", "s", "e").select("contig", "s", "e", "n")


@query(_merge_sql(0))
def interval_merge_overlap_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge(spans(spark, sf_dir), "contig", "s", "e", abutting=False).select("contig", "s", "e", "n")


@query(f"with a as ({SPANS}), b as ({STAYS}) select o_orderkey, key2, greatest(s, s2) as start, least(e, e2) as end from a join b on a.contig = b.contig2 and s <= e2 and s2 <= e")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.intersect(spans(spark, sf_dir), stays(spark, sf_dir), ("contig", "s", "e"), ("contig2", "s2", "e2"), 30).select("o_orderkey", "key2", "start", "end")


@query(f"with m as ({_merge_sql(1)}), w as (select *, lag(e) over (partition by contig order by s, e) b, lead(s) over (partition by contig order by s, e) a from m) select contig, s, e, cast(case when b + 20 >= s - 20 then floor((b + s) / 2) + 1 else s - 20 end as bigint) padded_start, cast(case when a - 20 <= e + 20 then floor((e + a) / 2) else e + 20 end as bigint) padded_end from w")
def pad_split_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = I.merge(spans(spark, sf_dir), "contig", "s", "e")
    return I.pad_and_split(merged, "contig", "s", "e", 20).select("contig", "s", "e", F.col("padded_start").cast("long").alias("padded_start"), F.col("padded_end").cast("long").alias("padded_end"))


@query(f"with a as ({SPANS}) select o_orderkey, b bin_start, least(b + 6, e) bin_end from (select *, unnest(range(s, e + 1, 7)) b from a)")
def tile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.tile(spans(spark, sf_dir), "s", "e", 7).select("o_orderkey", "bin_start", "bin_end")


@query(f"with m as ({_merge_sql(1)}), r as (select *, sum(e - s + 1) over (order by contig, s, e rows unbounded preceding) - (e - s + 1) d, sum(e - s + 1) over () t from m) select contig, s, e, cast(floor(d * 8 / t) as bigint) shard from r")
def scatter_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scatter(I.merge(spans(spark, sf_dir), "contig", "s", "e"), "contig", "s", "e", 8).select("contig", "s", "e", "shard")


@query(f"with a as ({SPANS}), x as (select contig, p, sum(d) d from (select contig, s p, 1 d from a union all select contig, e + 1, -1 from a) group by all), r as (select contig, p as start, lead(p) over w - 1 as end, cast(sum(d) over w as bigint) depth from x window w as (partition by contig order by p)) select * from r where depth > 0")
def pileup_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.depth(spans(spark, sf_dir), "contig", "s", "e")


@query(f"with a as ({SPANS}), b as ({STAYS}), x as (select contig, p, sum(a) a, sum(b) b from (select contig, s p, 1 a, 0 b from a union all select contig, e + 1, -1, 0 from a union all select contig2, s2, 0, 1 from b union all select contig2, e2 + 1, 0, -1 from b) group by all), r as (select contig, p as start, lead(p) over w - 1 as end, sum(a) over w > 0 in_a, sum(b) over w > 0 in_b from x window w as (partition by contig order by p)) select * from r where in_a or in_b")
def combine_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stays(spark, sf_dir).select(F.col("contig2").alias("contig"), F.col("s2").alias("s"), F.col("e2").alias("e"))
    return I.combine_breakpoints(spans(spark, sf_dir), b, "contig", "s", "e")


@query(f"with a as (select *, o_totalprice > 150000 as label, row_number() over (partition by contig order by s, e, o_orderkey) n from ({SPANS})), m as (select *, case when lag(label) over w = label then 0 else 1 end c from a window w as (partition by contig order by n)), r as (select *, sum(c) over (partition by contig order by n) g from m) select contig, label, min(s) s, max(e) e, count(*) n from r group by contig, g, label")
def merge_equal_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spans(spark, sf_dir).withColumn("label", F.col("o_totalprice") > 150000)
    return W.runs(a.withColumn("place", F.struct("s", "e", "o_orderkey")), "contig", "place", F.col("label"), [F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")]).select("contig", "label", "s", "e", "n")


@query("with d as (select doc_id, md5(lower(trim(text))) k, length(text) n from documents), r as (select *, row_number() over (partition by k order by n desc, doc_id) r from d) select doc_id, r > 1 duplicate from r")
def mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("k"), F.length("text").alias("n"))
    return W.mark_duplicates(d, [F.col("k")], F.col("n"), F.col("doc_id")).select("doc_id", "duplicate")


@query("select least(text, reverse(text)) = text forward, count(*) n, min(doc_id) first_id from documents group by least(text, reverse(text)), forward")
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = S.canonical(F.col("text"))
    return d.groupBy(key.alias("k"), (key == F.col("text")).alias("forward")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).drop("k")


@query("select l_returnflag, l_linestatus, l_linenumber, cast(grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber) as bigint) as level, count(*) n, round(sum(l_discount), 2) errors from lineitem group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus), (l_returnflag, l_linestatus, l_linenumber))")
def recal_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return A.recalibration(table(spark, sf_dir, "lineitem"), [k[:1], k[:2], k], F.col("l_discount"))


@query("select r_name, n_name, cast(grouping(r_name) * 2 + grouping(n_name) as bigint) as level, count(*) n, round(sum(c_acctbal), 2) balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def multilevel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.multilevel(c, ["r_name", "n_name"], [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")])


TAXA = "with hm as (select distinct o_orderkey r, 1 m, c_nationkey t from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey union select distinct l_orderkey, 2, s_nationkey from lineitem join supplier on l_suppkey = s_suppkey), p as (select n_nationkey t, n_name own, n_name a, r_name kingdom from nation join region on n_regionkey = r_regionkey union all select n_nationkey, n_name, r_name, r_name from nation join region on n_regionkey = r_regionkey union all select n_nationkey, n_name, 'root', null from nation)"


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as reads with two mates: the buyer's nation hits, and the sellers' nations; nations below regions below a root."""
    t = lambda n: table(spark, sf_dir, n)
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.lit(1).alias("mate"), F.col("c_nationkey").alias("t"))
    sellers = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.lit(2).alias("mate"), F.col("s_nationkey").alias("t"))
    names = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = names.select(F.col("n_name").alias("taxon"), F.explode(F.array("n_name", "r_name", F.lit("root"))).alias("ancestor"))
    kingdoms = names.select(F.explode(F.array("n_name", "r_name")).alias("ancestor"), F.col("r_name").alias("kingdom")).distinct()
    hits = buyers.unionByName(sellers).distinct().join(names.select(F.col("n_nationkey").alias("t"), "n_name"), "t").select("o_orderkey", "mate", F.col("n_name").alias("taxon"))
    return hits, paths, kingdoms


_SCORES = "n as (select r, count(*) n, max(m) m from h group by 1), e as (select r, a, kingdom, any_value(n) n, any_value(n.m) m, count(*) below, sum(n.m / n) s, sum(case when a = own then n.m / n else 0 end) self from h join n using (r) join p using (t) group by r, a, kingdom), z as (select a ancestor, any_value(kingdom) kingdom, sum(s) score, sum(self) self, cast(sum(m) as bigint) reads, cast(coalesce(sum(m) filter (below = n), 0) as bigint) unambiguous from e group by a), k as (select kingdom, sum(self) o from z group by 1) select ancestor, z.kingdom, round(score, 6) score, round(self, 6) self_score, round(case when o > 0 then 100 * self / o else 0 end, 6) normalised, reads, unambiguous from z join k on z.kingdom is not distinct from k.kingdom"


@query(f"{TAXA}, h as (select distinct r, t, 1 m from hm), {_SCORES}")
def taxon_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, paths, kingdoms = _hits(spark, sf_dir)
    return A.abundance(hits.select("o_orderkey", "taxon").distinct(), "o_orderkey", "taxon", paths, kingdoms)


@query(f"{TAXA}, h as (select r, t, any_value(c) m from (select r, t, count(distinct m) m from hm group by all) join (select r, count(distinct m) c from hm group by 1) using (r) where m = c group by all), {_SCORES}")
def taxon_abundance_of_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only taxa that both mates hit count, each pair for two."""
    hits, paths, kingdoms = _hits(spark, sf_dir)
    return A.abundance(A.shared_by_mates(hits, "o_orderkey", "mate", "taxon"), "o_orderkey", "taxon", paths, kingdoms)


@query("select l_orderkey, l_linenumber, l_extendedprice from (select *, max(l_extendedprice) over (partition by l_orderkey) m from lineitem) where l_extendedprice >= (1 - 0.1) * m")
def best_hit_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_hits(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", 0.1).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"with t as ({TICKS}), h as (select *, coalesce(lead(tick, 2) over w - tick < 86400, false) h from t window w as (partition by user_id order by tick, event_id)) select event_id, max(h) over (partition by user_id order by tick, event_id rows between 2 preceding and current row) clustered from h")
def clustered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.clustered(ticks(spark, sf_dir), "user_id", "tick", "event_id", 3, 86400).select("event_id", "clustered")


@query(f"with t as ({TICKS}), m as (select *, case when lag(event_type) over w = event_type then 0 else 1 end c from t window w as (partition by user_id order by tick, event_id)), r as (select *, sum(c) over (partition by user_id order by tick, event_id) g from m) select user_id, event_type as label, min(tick) as first_at, max(tick) as last_at, count(*) n, round(min(value), 6) least from r group by user_id, g, event_type")
def ref_block_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("place", F.struct("tick", "event_id"))
    return W.runs(t, "user_id", "place", F.col("event_type"), [F.min("tick").alias("first_at"), F.max("tick").alias("last_at"), F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least")]).drop("run", "start", "end")


@query("with c as (select l_returnflag g, l_quantity q, count(*) c, count(*) filter (l_discount > 0.05) t from lineitem group by all) select g, q, cast(sum(c) over w as bigint) n_rows, cast(sum(t) over w as bigint) n_true, round(sum(t) over w / sum(t) over (partition by g), 9) sensitivity from c window w as (partition by g order by q desc rows unbounded preceding)")
def tranche_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("q"), "l_discount")
    return W.tranches(d, "g", "q", F.col("l_discount") > 0.05)


@query("with r as (select l_returnflag g, l_extendedprice p, row_number() over (partition by l_returnflag order by l_extendedprice desc) - 1 i, count(*) over (partition by l_returnflag) n from lineitem), t(percent) as (values (1.0::double), (50.0::double), (99.0::double)) select g, percent, p cutoff, n from r join t on i = floor(percent / 100 * (n - 1))")
def nearest_rank_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("p"))
    return W.cutoffs(d, "g", "p", [1.0, 50.0, 99.0])


@query("with t as (select l_orderkey k, l_linenumber n, l_returnflag a from lineitem where l_linenumber <= 4), e as (select l_orderkey k, l_linenumber n, case when l_quantity > 40 then 'X' else l_returnflag end a, l_discount > 0.08 f from lineitem where l_linenumber >= 2) select coalesce(t.k, e.k) k, coalesce(t.n, e.n) n, case when t.k is null then case when f then 'FTN' else 'FP' end when e.k is null then 'FN' when f then 'FFN' when t.a = e.a then 'TP' else 'FN' end state from t full join e on t.k = e.k and t.n = e.n")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag", "l_quantity", "l_discount")
    truth = d.filter("n <= 4").withColumn("a", F.col("l_returnflag"))
    found = d.filter("n >= 2").withColumn("a", F.when(F.col("l_quantity") > 40, "X").otherwise(F.col("l_returnflag"))).withColumn("f", F.col("l_discount") > 0.08)
    return C.concordance(truth, found, ["k", "n"], "a", "f")


@query(f"with c as ({ORACLES['concordance']}) select n, count(*) filter (state = 'TP') true_positive, count(*) filter (state = 'FP') false_positive, count(*) filter (state in ('FN', 'FFN')) false_negative, round(count(*) filter (state = 'TP') / nullif(count(*) filter (state in ('TP', 'FN', 'FFN')), 0), 9) sensitivity, round(count(*) filter (state = 'TP') / nullif(count(*) filter (state in ('TP', 'FP')), 0), 9) as precision from c group by n")
def concordance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concordance_summary(concordance(spark, sf_dir), ["n"])


@query(f"select l_suppkey, {day_sql('l_shipdate')} as day, count(*) n, array_to_string(list_sort(list(distinct l_linestatus)), ',') as values from lineitem group by all")
def group_on_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_on_start(items(spark, sf_dir), ["l_suppkey", "day"], "l_linestatus").withColumn("values", F.array_join("values", ","))


@query(f"select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey, {day_sql('l_shipdate')} order by md5(concat(l_orderkey, ':', l_linenumber))) r from lineitem) where r <= 2")
def positional_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.downsample(items(spark, sf_dir), "l_suppkey", "day", F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber")), 2).select("l_orderkey", "l_linenumber")


LETTERS = "regexp_replace(lower(text), '[^a-z]', '', 'g')"


def kmers_sql(k: int) -> str:
    """All substrings of length k of a column t: those of each phase don't overlap."""
    return f"unnest(flatten(list_transform(range(1, {k + 1}), lambda p: regexp_extract_all(substr(t, p), '.{{{{{k}}}}}'))))".replace("{{", "{").replace("}}", "}")


def letters() -> Column:
    return F.regexp_replace(F.lower("text"), "[^a-z]", "")


@query(f"select k kmer, count(*) n from (select {kmers_sql(6)} k from (select {LETTERS} t from benchmark)) group by k having count(*) > 1")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(S.kmers(letters(), 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")).filter("n > 1")


@query()
def kmer_count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.kmer_counts(table(spark, sf_dir, "documents"), letters(), 6).filter("n > 1")


@query(f"with b as (select distinct {kmers_sql(16)} k from (select {LETTERS} t from benchmark)), d as (select doc_id, {kmers_sql(16)} k from (select doc_id, {LETTERS} t from documents)), h as (select doc_id, count(*) n from d join b using (k) group by 1) select doc_id from documents where doc_id not in (select doc_id from h where n >= 3)")
def kmer_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "benchmark").select(F.explode(S.kmers(letters(), 16)).alias("kmer"))
    return C.kmer_antijoin(table(spark, sf_dir, "documents"), "doc_id", S.kmers(letters(), 16), bad, 3).select("doc_id")


@query(f"with t as (select doc_id, length(t) n, {kmers_sql(3)} k from (select doc_id, {LETTERS} t from documents)), c as (select doc_id, n, k, count(*) c from t group by all) select d.doc_id, round(coalesce(case when max(c.n) > 3 then sum(c * (c - 1) / 2) / (max(c.n) - 3) end, 0), 6) score from documents d left join c using (doc_id) group by d.doc_id")
def dust_low_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dust_scores(table(spark, sf_dir, "documents"), "doc_id", letters()).withColumn("score", F.round("score", 6))


@query("select doc_id, round((length(text) - length(translate(text, 'aeiou', ''))) / greatest(length(text), 1), 9) share from documents")
def gc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.share_of(F.col("text"), "aeiou"), 9).alias("share"))


@query("with g as (select l_suppkey, case when l_quantity < 3 then 'improper' when l_discount < 0.01 then 'low_mapq' when l_tax < 0.01 then 'low_baseq' when l_returnflag = 'N' then 'ref' when l_returnflag = 'R' then 'alt' else 'other' end g from lineitem) select l_suppkey, count(*) raw, count(*) filter (g = 'improper') improper, count(*) filter (g = 'low_mapq') low_mapq, count(*) filter (g = 'low_baseq') low_baseq, count(*) filter (g = 'ref') ref, count(*) filter (g = 'alt') alt, count(*) filter (g = 'other') other from g group by 1")
def allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return A.gated_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [("improper", c("l_quantity") < 3), ("low_mapq", c("l_discount") < 0.01), ("low_baseq", c("l_tax") < 0.01), ("ref", c("l_returnflag") == "N"), ("alt", c("l_returnflag") == "R"), ("other", F.lit(True))])


@query("with s as (select s_suppkey k, count(*) filter (l_returnflag = 'N') r, count(*) filter (l_returnflag = 'R') a, count(*) filter (l_returnflag = 'A') o, (s_suppkey % 10) / 10.0 f from lineitem join supplier on l_suppkey = s_suppkey group by all), t as (select 1.5 * sum(o) / sum(r + a + o) e, sum(r) r, sum(r + a + o) d, sum((r + a + o) * (1 - f)) w from s) select round(e, 9) error, round(least(1, greatest(0, (r - e * d / 3) / w)), 9) contamination from t")
def contamination_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("ref_count"), F.count_if(F.col("l_returnflag") == "R").alias("alt_count"), F.count_if(F.col("l_returnflag") == "A").alias("other_count"))
    return A.contamination(counts.withColumn("af", F.pmod("l_suppkey", F.lit(10)) / 10.0))


@query("with r as (select l_linestatus g, l_returnflag = 'R' f, rank() over (partition by l_linestatus order by l_quantity) + (count(*) over (partition by l_linestatus, l_quantity) - 1) / 2 k, count(*) over (partition by l_linestatus, l_quantity) c from lineitem), s as (select g, cast(count(*) filter (f) as bigint) n1, cast(count(*) filter (not f) as bigint) n2, sum(k) filter (f) r1, sum(c * c - 1) t, count(*) n from r group by g) select g, n1, n2, round(r1 - n1 * (n1 + 1) / 2, 4) u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1.0)))), 6) z from s where n1 > 0 and n2 > 0")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), "l_quantity", "l_returnflag")
    return A.rank_sum(d, ["g"], F.col("l_returnflag") == "R", "l_quantity")


TABLE2 = "select l_suppkey k, count(*) filter (l_returnflag = 'N' and l_linenumber % 2 = 0) a, count(*) filter (l_returnflag = 'N' and l_linenumber % 2 = 1) b, count(*) filter (l_returnflag = 'R' and l_linenumber % 2 = 0) c, count(*) filter (l_returnflag = 'R' and l_linenumber % 2 = 1) d from lineitem group by 1"


def _two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda flag, odd: F.count_if((F.col("l_returnflag") == flag) & (F.pmod("l_linenumber", F.lit(2)) == odd))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(f("N", 0).alias("a"), f("N", 1).alias("b"), f("R", 0).alias("c"), f("R", 1).alias("d"))


def _fisher_sql(cells: str) -> str:
    return f"with t as ({TABLE2}), z as ({cells}), p as (select k, a, a + b r, a + c q, a + b + c + d n, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) x from z), l as (select *, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(q - x + 1) - lgamma(n - r - q + x + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1) lp from p), f as (select k, least(1, sum(exp(lp)) filter (lp <= own + 1e-7)) p from (select *, max(case when x = a then lp end) over (partition by k) own from l) group by k)"


@query(_fisher_sql("select * from t") + " select k, round(p, 6) p from f")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_by_two(spark, sf_dir).select("k", F.round(S.fisher_two_sided(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("p"))


@query(_fisher_sql("select k, case when a + b + c + d > 400 then cast(floor(a / ((a + b + c + d) / 200)) as bigint) else a end a, case when a + b + c + d > 400 then cast(floor(b / ((a + b + c + d) / 200)) as bigint) else b end b, case when a + b + c + d > 400 then cast(floor(c / ((a + b + c + d) / 200)) as bigint) else c end c, case when a + b + c + d > 400 then cast(floor(d / ((a + b + c + d) / 200)) as bigint) else d end d from t") + " select k, round(abs(-10 * log10(greatest(p, 1e-320))), 3) fs from f")
def fisher_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strand bias of a table, scaled down where it holds more than 400 reads, in Phred."""
    return _two_by_two(spark, sf_dir).select("k", F.round(S.fisher_strand(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 3).alias("fs"))


@query(f"with t as ({TABLE2}), x as (select k, a + 1.0 a, b + 1.0 b, c + 1.0 c, d + 1.0 d from t) select k, round(ln((a * d) / (b * c) + (b * c) / (a * d)) + ln(least(a, b) / greatest(a, b)) - ln(least(c, d) / greatest(c, d)), 6) sor from x")
def strand_odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_by_two(spark, sf_dir).select("k", F.round(S.strand_odds_ratio(*[F.col(x) for x in "abcd"]), 6).alias("sor"))


@query("with f as (select sum(l_discount * l_quantity) / sum(l_quantity) m, sqrt(sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - (sum(l_discount * l_quantity) / sum(l_quantity)) ** 2) s from lineitem) select round(sum(l_discount * l_quantity) / sum(l_quantity), 6) mean, round(sqrt(sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - (sum(l_discount * l_quantity) / sum(l_quantity)) ** 2), 6) sd, count(*) n from lineitem, f where abs(l_discount - m) <= 1.5 * s")
def robust_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.robust_centre(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", 1.5)


@query("with m as (select l_returnflag g, quantile_disc(l_quantity, 0.5) median, count(*) n from lineitem group by 1) select g, median, n, quantile_disc(abs(l_quantity - median), 0.5) mad from lineitem join m on l_returnflag = g group by all")
def insert_size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v"))
    return A.spread(d, ["g"], "v").select("g", "median", "n", "mad")


@query("select l_suppkey, quantile_disc(l_linenumber, 0.5) median, count(*) n from lineitem group by 1")
def hist_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber")


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::double * 100) v from embeddings) select vec_id, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) as lse from v")
def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(S.log_sum_exp(F.col("v")), 6).alias("lse"))


@query("select l_orderkey, l_linenumber, cast(greatest(1, least(93, floor(-10 * log10(greatest(l_discount, 1e-300)) + 0.5))) as integer) q, round(pow(10, -l_quantity / 10), 9) p from lineitem")
def phred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.phred(F.col("l_discount")).alias("q"), F.round(S.error_probability(F.col("l_quantity")), 9).alias("p"))


@query("select p_partkey, unnest(string_split(p_type, ' ')) word, p_size from part")
def variants_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"), "p_size")


@query("select p_partkey, 'p_size' field, p_size::double as value from part union all select p_partkey, 'p_retailprice', p_retailprice::double from part")
def molten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.molten(table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


@query(f"with t as ({TICKS}) select event_id from (select *, tick - lag(tick) over w b, lead(tick) over w - tick a from t window w as (partition by user_id order by tick, event_id)) where not coalesce(b <= 3600, false) and not coalesce(a <= 3600, false)")
def nearby_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.remove_near(ticks(spark, sf_dir), "user_id", "tick", "event_id", 3600).select("event_id")


@query("select l_returnflag, cast(sum(n) as bigint) n, cast(sum(m) as bigint) m from (select l_returnflag, count(*) n, 0 m from lineitem where l_linestatus = 'F' group by 1 union all select l_returnflag, count(*), count(*) from lineitem where l_linestatus = 'O' group by 1) group by 1")
def gather_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    parts = [d.filter(F.col("l_linestatus") == s).groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.count("*") * k).alias("m")) for s, k in (("F", 0), ("O", 1))]
    return C.gather(parts, ["l_returnflag"], ["n", "m"])


@query("select conv_id, min(turn) as first, max(turn) as second, count(*) n from conversations group by 1")
def mate_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mates(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"with d as (select l_suppkey k, {day_sql('l_shipdate')} as day, count(*)::double v from lineitem group by all) select k, day, round(0.25 * coalesce(lag(v) over w, 0) + 0.5 * v + 0.25 * coalesce(lead(v) over w, 0), 6) smoothed from d window w as (partition by k order by day)")
def band_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("k"), "day").agg(F.count("*").cast("double").alias("v"))
    return W.smooth(d, "k", "day", "v", [0.25, 0.5, 0.25]).select("k", "day", F.round("smoothed", 6).alias("smoothed"))


@query(f"with d as (select l_suppkey k, {day_sql('l_shipdate')} as day, count(*) > 1 a from lineitem group by all), m as (select *, case when lag(a) over w = a then 0 else 1 end c from d window w as (partition by k order by day)), r as (select *, sum(c) over (partition by k order by day) g from m), x as (select k, g, a, min(day) s, max(day) e from r group by all) select k, p as start, least(p + 99, e) as end, a active from (select *, unnest(range(s, e + 1, 100)) p from x)")
def cut_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("k"), "day").agg((F.count("*") > 1).alias("a"))
    return W.cut_runs(d, "k", "day", F.col("a"), 100)


@query()
def active_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of daily quantities, cut at the lowest minima. A test compares them with a plain loop."""
    d = items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("k"), "day").agg(F.sum("l_quantity").alias("v"))
    return W.active_regions(d, "k", "day", "v", 8.0, 3, 12)


@query("select s_suppkey, count(*) n, count(distinct l_partkey) parts, cast(sum(l_quantity) as bigint) bases from lineitem join supplier on l_suppkey = s_suppkey group by 1")
def count_reads_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return d.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.sum("l_quantity").cast("long").alias("bases"))


@query("with c as (select p_brand k, count(*) filter (p_size <= 15) rr, count(*) filter (p_size > 15 and p_size <= 35) ra, count(*) filter (p_size > 35) aa from part group by 1), q as (select *, (2 * rr + ra) / (2.0 * (rr + ra + aa)) p from c) select k, rr, ra, aa, cast(ra + 2 * aa as bigint) ac, cast(2 * (rr + ra + aa) as bigint) an, round(case when rr + ra + aa >= 10 then 1 - ra / (2 * p * (1 - p) * (rr + ra + aa)) end, 4) f from q")
def genotype_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(F.count_if(F.col("p_size") <= 15).alias("rr"), F.count_if(F.col("p_size").between(16, 35)).alias("ra"), F.count_if(F.col("p_size") > 35).alias("aa"))
    return g.select("*", (F.col("ra") + 2 * F.col("aa")).alias("ac"), (2 * (F.col("rr") + F.col("ra") + F.col("aa"))).alias("an"), F.round(S.inbreeding(F.col("rr"), F.col("ra"), F.col("aa")), 4).alias("f"))


@query("select l_suppkey, round(sqrt(avg(l_quantity * l_quantity)), 6) rms, count(*) filter (l_discount = 0) zeros, count(*) depth from lineitem group by 1")
def rms_mapping_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sqrt(F.avg(F.col("l_quantity") * F.col("l_quantity"))), 6).alias("rms"), F.count_if(F.col("l_discount") == 0).alias("zeros"), F.count("*").alias("depth"))


@query("select doc_id, md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) h from documents")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.reverse_complement(F.col("text"))).alias("h"))


@query("select a.vec_id, arg_max(b.label, list_dot_product(a.embedding::double[], b.c)) label from embeddings a, (select label, list(m order by i) c from (select label, i, avg(x) m from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by label, i) group by label) b group by 1")
def likelihood_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    centres = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    every = centres.agg(F.collect_list(F.struct("label", F.transform("ms", lambda x: x["m"]).alias("c"))).alias("all"))  # one row, an entry for each class
    best = F.array_max(F.transform("all", lambda k: F.struct(S.dot(F.col("embedding"), k["c"]).alias("score"), k["label"].alias("label"))))
    return e.crossJoin(F.broadcast(every)).select("vec_id", best["label"].alias("label"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed(events, "ts", "event_type", "value", "1 hour", "1 hour")
    import uuid

    name = f"windows_{uuid.uuid4().hex}"
    return streams.finished(out, name, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select event_type, count(*) n from (select distinct event_id, event_type from events) group by 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.finished(streams.deduplicated(events, "ts", "event_id", "1 hour").select("event_id", "event_type"), "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select conv_id, turn, regexp_replace(regexp_replace(role, '\\s.*$', ''), '/[12]$', '') as name, cast(case when turn = 255 then 60 else turn end as bigint) mapq from conversations")
def read_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_mate_number(F.col("role")).alias("name"), T.cap_mapping_quality(F.col("turn")).cast("long").alias("mapq"))
