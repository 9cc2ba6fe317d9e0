"""Streaming forms of ordered operators. With the availableNow trigger a stream over files ends with the batch result.

State is kept by key and bounded by the watermark or by a stated number of
items.  Results of operators that revise what they said (open blocks,
reservoirs) are versions: the last one of each key counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import scratch


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the rows of a Parquet table (a folder, or one file). files: how many are taken at a time."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    whole = path.rstrip("/")
    if whole.endswith(".parquet") and not _is_folder(spark, whole):
        return reader.option("pathGlobFilter", whole.rsplit("/", 1)[1]).parquet(whole.rsplit("/", 1)[0])
    return reader.parquet(whole)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def windowed(events: DataFrame, time: str, key: str, value: str, size: str, late: str) -> DataFrame:
    """Counts and sums by event-time window and key; state goes once the watermark has passed a window."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), key)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def covered(intervals: DataFrame, start: str, end: str, size: str, late: str, key: str) -> DataFrame:
    """How many intervals cover each window: an interval counts in every window that it touches, and is forgotten once the watermark has passed its end."""
    seconds = F.lit(int(pd.Timedelta(size).total_seconds()))
    first, last = F.floor(F.unix_timestamp(start) / seconds), F.floor(F.unix_timestamp(end) / seconds)
    each = intervals.withWatermark(start, late).withColumn("cell", F.explode(F.sequence(first, last)))
    return each.groupBy(key, "cell").agg(F.count("*").alias("depth")).select(key, (F.col("cell") * seconds).alias("start"), "depth")


def deduplicated(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, key: list[str], gap: str, late: str) -> DataFrame:
    """Blocks of a key's events that are less than a gap apart: first and last time, count. A block is written once no event can join it."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *key)
    return w.agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at")).select(*key, "first_at", "last_at", "n")


def with_track(events: DataFrame, track: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Each event with the intervals of a fixed track that hold it: the track is read again for each batch, so it needs no cache."""
    named = track.select(F.col(key).alias("track_key"), F.col(start).alias("track_start"), F.col(end).alias("track_end"))
    return events.join(named, (F.col(key) == F.col("track_key")) & F.col(at).between(F.col("track_start"), F.col("track_end")), "left")


def in_order(events: DataFrame, key: str, at: str) -> DataFrame:
    """The same rows; one whose place is before an earlier one of its key is an error. Null places are errors."""
    schema = events.schema

    def check(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        for batch in batches:
            places = batch[at].tolist()
            for p in places:
                if pd.isna(p) or (last is not None and p < last):
                    raise ValueError(f"{k[0]}: {p} comes after {last}")
                last = p
            yield batch
        if last is not None:
            state.update((int(last),))

    return events.groupBy(key).applyInPandasWithState(check, schema, "last long", "append", GroupStateTimeout.NoTimeout)


#: Lots of keys whose blocks are one state: a lot costs a call of Python, however many keys it has.
LOTS = 4096


def merged_blocks(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or abutting intervals of each key as they arrive in any order: versions (key, start, end, n, version), the last version of a key counting.

    State is the disjoint blocks of a lot of keys; a version of a key lists all
    of its blocks, so it is for keys with few open blocks.
    """

    def merge(lot: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version = ([np.array(x, np.int64) for x in state.get[:4]], state.get[4]) if state.exists else ([np.zeros(0, np.int64)] * 4, 0)
        come = [b[[key, start, end]] for b in batches]
        new = [np.concatenate([b[c].fillna(0).to_numpy(np.int64) for b in come]) if come else np.zeros(0, np.int64) for c in (key, start, end)]
        keys, starts, ends, counts = (np.concatenate(x) for x in zip(held, [*new, np.ones(len(new[0]), np.int64)], strict=True))
        order = np.lexsort((ends, starts, keys))
        keys, starts, ends, counts = keys[order], starts[order], ends[order], counts[order]
        if len(keys):
            # keys are laid end to end, so that one running maximum tells how far each one's blocks reach
            fresh = np.r_[True, keys[1:] != keys[:-1]]
            shift = (np.cumsum(fresh) - 1) * (int(ends.max()) - int(starts.min()) + 2)
            reach = np.maximum.accumulate(ends + shift)
            heads = np.flatnonzero(fresh | (starts + shift > np.r_[0, reach[:-1]] + 1))
            keys, starts, ends, counts = keys[heads], starts[heads], np.maximum.reduceat(ends, heads), np.add.reduceat(counts, heads)
        state.update((keys.tolist(), starts.tolist(), ends.tolist(), counts.tolist(), version + 1))
        told = np.isin(keys, new[0])  # a version of the keys that came
        out = pd.DataFrame({"key": keys[told], "start": starts[told], "end": ends[told], "n": counts[told], "version": version + 1})
        yield out.assign(key=pd.Series([None] * len(out), dtype="Int64")) if lot[0] < 0 else out

    rows = intervals.select(F.col(key).cast("long").alias(key), F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))
    lots = rows.withColumn("lot", F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(LOTS).cast("long"))))
    return lots.groupBy("lot").applyInPandasWithState(merge, "key long, start long, end long, n long, version long", "keys array<long>, starts array<long>, ends array<long>, counts array<long>, version long", "update", GroupStateTimeout.NoTimeout)


def reservoirs(events: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """At most n items of each key, those with the least hashes: versions (key, item, version), the last version of a key counting."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version = (list(zip(state.get[0], state.get[1], strict=True)), state.get[2]) if state.exists else ([], 0)
        for batch in batches:
            held = sorted({*held, *zip(batch["pick"], batch["item"].astype(int), strict=True)})[:n]
        state.update(([h for h, _ in held], [int(i) for _, i in held], version + 1))
        yield pd.DataFrame({"key": [k[0]] * len(held), "item": [i for _, i in held], "version": [version + 1] * len(held)})

    rows = events.select(F.col(key).cast("long").alias("key"), F.col(item).cast("long").alias("item"), F.md5(F.col(item).cast("string")).alias("pick"))
    return rows.groupBy("key").applyInPandasWithState(keep, "key long, item long, version long", "picks array<string>, items array<long>, version long", "update", GroupStateTimeout.NoTimeout)


def last_versions(df: DataFrame, key: str = "key") -> DataFrame:
    """Rows of each key's last version."""
    last = df.groupBy(key).agg(F.max("version").alias("version"))
    return df.join(last, [key, "version"], "left_semi").drop("version")


def finished(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table in the shared folder, and read that.

    Append mode holds back windows that the watermark hasn't passed; complete
    mode writes the whole result anew after each batch; update mode adds each
    batch's changes. Nothing comes to the driver.
    """
    spark = df.sparkSession
    base = scratch(spark, name)
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", base)
    else:
        how = "overwrite" if mode == "complete" else "append"
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(how).parquet(base))
    writer.option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(base)
