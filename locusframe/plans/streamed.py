"""Queries of streams and of the extension registry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extensions as E
from ..operators import filters as FL
from ..operators import transforms as T
from ..sources.shared import scratch
from ..streaming import streams as ST
from .catalog import SPANS, query, spans, table
from .reads import READS
from .reads import reads as read_view


def _in_pieces(df: DataFrame, name: str, by: str, pieces: int = 3) -> str:
    """The rows in several files, so that a stream takes them in several batches."""
    path = scratch(df.sparkSession, name)
    df.repartition(pieces, F.pmod(F.xxhash64(by), F.lit(pieces))).write.parquet(path)
    return path


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("with e as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end o from events window w as (partition by user_id order by ts)), r as (select *, sum(o) over (partition by user_id order by ts rows unbounded preceding) g from e) select user_id, count(*) n, cast(epoch_us(min(ts)) as bigint) first_at, cast(epoch_us(max(ts)) as bigint) last_at from r group by user_id, g")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each user's events, ended by a gap of six hours."""
    out = ST.finished(ST.sessions(_events(spark, sf_dir), "ts", ["user_id"], "6 hours", "1 hour"), "sessions", "complete")
    return out.select("user_id", "n", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"))


@query("with e as (select user_id, epoch_us(ts) // 3600000000 c, epoch_us(ts + interval 1 hour * (event_id % 5)) // 3600000000 d from events), x as (select user_id, unnest(range(c, d + 1)) c from e) select user_id, cast(c * 3600 as bigint) as start, count(*) depth from x group by all")
def stream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a user's intervals (0 to 4 hours from each event) touch each hour."""
    e = _events(spark, sf_dir).withColumn("until", F.timestamp_seconds(F.unix_micros("ts") / 1000000 + (F.col("event_id") % 5) * 3600))
    return ST.finished(ST.covered(e, "ts", "until", "1 hour", "1 day", "user_id"), "coverage", "complete")


@query(f"with a as (select contig, s, e from ({SPANS})), m as (select *, case when s <= max(e) over (partition by contig order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end o from a), i as (select *, sum(o) over (partition by contig order by s, e rows unbounded preceding) g from m) select contig as key, min(s) as start, max(e) as end, count(*) n from i group by contig, g")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals merged as they arrive in three batches."""
    path = _in_pieces(spans(spark, sf_dir).select("contig", "s", "e"), "intervals", "s")
    blocks = ST.merged_blocks(ST.table_stream(spark, path, 1), "contig", "s", "e")
    return ST.last_versions(ST.finished(blocks, "blocks", "update"))


@query("with r as (select user_id, event_id, row_number() over (partition by user_id order by md5(cast(event_id as varchar)), event_id) r from events) select user_id as key, event_id as item from r where r <= 5")
def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events of each user, in three batches."""
    path = _in_pieces(table(spark, sf_dir, "events").select("user_id", "event_id"), "events", "event_id")
    return ST.last_versions(ST.finished(ST.reservoirs(ST.table_stream(spark, path, 1), "user_id", "event_id", 5), "reservoir", "update"))


@query("with t as (select c_nationkey u, c_custkey % 7 * 100 s, c_custkey % 7 * 100 + 150 e from customer) select event_id, s as track_start from events left join t on u = user_id and event_id % 1000 between s and e")
def stream_with_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the intervals of a fixed table that hold it."""
    c = table(spark, sf_dir, "customer")
    track = c.select(F.col("c_nationkey").cast("long").alias("user_id"), (F.col("c_custkey") % 7 * 100).alias("s"), (F.col("c_custkey") % 7 * 100 + 150).alias("e"))
    e = _events(spark, sf_dir).withColumn("at", F.col("event_id") % 1000)
    return ST.finished(ST.with_track(e, track, "user_id", "s", "e", "at"), "tracked").select("event_id", "track_start")


@query("select user_id, event_id from events")
def stream_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order of their ids: a stream that isn't sorted would fail."""
    path = scratch(spark, "sorted")
    table(spark, sf_dir, "events").select("user_id", "event_id").repartition(1).sortWithinPartitions("event_id").write.parquet(path)
    return ST.finished(ST.in_order(ST.table_stream(spark, path), "user_id", "event_id"), "checked")


@query("select upper(event_type) || ' ' || event_id as value from events")
def piped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through a program, as upper case."""
    lines = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"))
    return E.piped(lines, ["tr", "a-z", "A-Z"])


def _add(kind: str, name: str):
    """Registration that may be repeated, as this module's queries may be."""
    E.forget(kind, name)
    return E.register(kind, name)


@_add("filter", "odd_key")
def _odd():
    return F.col("k") % 2 == 1


@_add("transform", "short_names")
def _short(df: DataFrame) -> DataFrame:
    return df.withColumn("name", T.strip_mate_number(F.col("name")))


@_add("transform", "capped")
def _capped(df: DataFrame) -> DataFrame:
    return df.withColumn("mapq", T.cap_mapping_quality(F.col("mapq")))


@_add("annotation", "n_bases")
def _n_bases():
    return F.length("bases").cast("long")


@_add("covariate", "contig_key")
def _contig():
    return F.coalesce("contig", F.lit("none"))


@_add("covariate", "reverse")
def _reverse():
    return FL.flag(16)


@_add("accumulator", "quality")
def _quality():
    return [F.count("*").alias("n"), F.sum("mapq").cast("long").alias("mapq_sum"), F.max("mapq").cast("long").alias("mapq_max")]


@_add("rows", "op")
def _ops():
    return F.transform("cigar", lambda x: x["op"])


@_add("kernel", "longest")
def _longest(rows: pd.DataFrame) -> pd.DataFrame:
    best = rows.sort_values(["size", "k"], ascending=[False, True]).iloc[0]
    return pd.DataFrame({"region": [best["region"]], "k": [best["k"]], "n": [len(rows)]})


@query(f"with {READS} select k, regexp_replace(regexp_replace(name, '\\s.*$', ''), '/[12]$', '') as name, cast(case when mapq = 255 then 60 else mapq end as bigint) mapq, length(bases) n_bases from reads where k % 2 = 1 and (flags & 4) = 0 and not (flags & 1024) <> 0")
def extended_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered transforms, registered and built-in filters, and a registered annotation by their names."""
    out = E.transformed(read_view(spark, sf_dir), ["short_names"], ["odd_key", "mapped", "not_duplicate"], ["capped"])
    return E.annotated(out, ["n_bases"]).select("k", "name", F.col("mapq").cast("long").alias("mapq"), "n_bases")


@query(f"with {READS} select coalesce(contig, 'none') contig_key, (flags & 16) <> 0 as reverse, count(*) n, cast(sum(mapq) as bigint) mapq_sum, cast(max(mapq) as bigint) mapq_max from reads where not ((flags & 4) = 0 and mapq = 0) group by all")
def extended_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered accumulators by registered covariates, of rows that a negated filter keeps."""
    E.forget("filter", "useless")
    E.register("filter", "useless")(lambda: ~FL.flag(4) & (F.col("mapq") == 0))
    return E.accumulated(E.filtered(read_view(spark, sf_dir), ["not useless"]), ["contig_key", "reverse"], ["quality"])


@query(f"with {READS}, o as (select k, unnest(list_transform(ops, lambda x: x.op)) op from reads) select op, count(*) n, count(distinct k) reads from o group by 1")
def extended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table function: one row for each operation of a CIGAR."""
    return E.exploded(read_view(spark, sf_dir), "op", ["k"]).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("k").alias("reads"))


@query(f"with a as (select o_orderkey k, contig % 50 || ':' || s // 1000 region, e - s size from ({SPANS})) select region, cast(first(k order by size desc, k) as bigint) k, count(*) n from a group by 1")
def extended_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered kernel over each region."""
    a = spans(spark, sf_dir).select(F.concat_ws(":", (F.col("contig") % 50).cast("string"), F.floor(F.col("s") / 1000).cast("string")).alias("region"), F.col("o_orderkey").alias("k"), (F.col("e") - F.col("s")).alias("size"))
    return E.by_region(a, ["region"], "longest", "region string, k long, n long")
