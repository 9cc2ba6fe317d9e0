"""Ranking and order-dependent operators. None sorts all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe
from .ordered import beside, ranged, running


def mark_duplicates(df: DataFrame, key: list[Column], score: Column, tie: Column) -> DataFrame:
    """duplicate is false for the row of each key with the greatest score, ties to the smallest ``tie``.

    The winner comes from an aggregate, so a key that a third of all rows has
    is no single task's group.  Null keys are equal to each other; a null score
    is less than any other, a null ``tie`` greater.
    """
    keyed = df.withColumns({f"key{i}": k for i, k in enumerate(key)}).withColumns({"own_score": score, "own_tie": tie})
    names = [f"key{i}" for i in range(len(key))]
    best = keyed.groupBy(*names).agg(F.max(F.struct("own_score", (-F.col("own_tie")).alias("t"))).alias("best"))
    joined = null_safe(keyed, best, names)
    return joined.withColumn("duplicate", ~(F.col("own_score").eqNullSafe(F.col("best.own_score")) & (-F.col("own_tie")).eqNullSafe(F.col("best.t")))).drop(*names, "own_score", "own_tie", "best")


def runs(df: DataFrame, contig: str, at: str, label: Column, measures: list[Column]) -> DataFrame:
    """Blocks of consecutive rows with equal labels: start, end, label and measures. ``at`` must tell a contig's rows apart."""
    rows = beside(ranged(df.withColumn("label", label), [contig], [at]), [contig], [at], F.struct("label"), "last", after=False)
    changes = F.when(F.col("last").isNotNull() & F.col("last.label").eqNullSafe(F.col("label")), 0).otherwise(1)
    numbered = running(rows, [contig], [at], changes, "sum", "run")
    return numbered.groupBy(contig, "run", "label").agg(F.min(at).alias("start"), F.max(at).alias("end"), *measures)


def clustered(df: DataFrame, contig: str, at: str, tie: str, size: int, span: int) -> DataFrame:
    """clustered: the row is one of ``size`` in order whose first and last are less than ``span`` apart."""
    w = Window.partitionBy(contig).orderBy(at, tie)
    heads = df.withColumn("heads", F.coalesce(F.lead(at, size - 1).over(w) - F.col(at) < span, F.lit(False)))
    return heads.withColumn("clustered", F.max("heads").over(w.rowsBetween(1 - size, 0))).drop("heads")


def remove_near(df: DataFrame, contig: str, at: str, tie: str, least: int) -> DataFrame:
    """Rows with no neighbour within ``least``; the nearest row seen counts even if it goes itself."""
    rows = ranged(df, [contig], [at, tie])
    rows = beside(rows, [contig], [at, tie], F.col(at), "before", after=False)
    rows = beside(rows, [contig], [at, tie], F.col(at), "after")
    near = F.coalesce(F.col(at) - F.col("before") <= least, F.lit(False)) | F.coalesce(F.col("after") - F.col(at) <= least, F.lit(False))
    return rows.filter(~near).drop("pid", "before", "after")


def downsample(df: DataFrame, contig: str, at: str, rank_by: Column, n: int) -> DataFrame:
    """At most n rows of each position, chosen by a hash: the same rows in every run and order."""
    w = Window.partitionBy(contig, at).orderBy("pick")
    return df.withColumn("pick", rank_by).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("pick", "place")


def fraction(df: DataFrame, share: float, *key: str) -> DataFrame:
    """This share of rows, by a hash of their key: the same rows in every run."""
    limit = format(min(int(share * 16**8), 16**8 - 1), "08x")
    return df.filter(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8) < limit) if share < 1 else df


def levelled(df: DataFrame, group: str, target: int, rank_by: Column) -> DataFrame:
    """At most ``target`` rows in all, taken from the largest groups first: each group keeps as many as a common level allows.

    The level is found from the groups' sizes, pre-aggregated by size.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    by_size = sizes.groupBy("size").agg(F.count("*").alias("groups"))  # a row for each different size
    w = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    total = by_size.agg(F.sum("groups").alias("all"))
    steps = by_size.select("size", F.coalesce(F.sum(F.col("size") * F.col("groups")).over(w), F.lit(0)).alias("below"), F.coalesce(F.sum("groups").over(w), F.lit(0)).alias("smaller")).crossJoin(F.broadcast(total))
    # among levels up to a size, smaller groups keep all and the others the level
    level = F.floor((F.lit(target) - F.col("below")) / (F.col("all") - F.col("smaller")))
    least = steps.select(F.least(level, F.col("size")).alias("level")).agg(F.max("level").alias("level"))
    ranked = df.withColumn("pick", rank_by).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("pick")))
    return ranked.crossJoin(F.broadcast(least)).filter(F.col("place") <= F.col("level")).drop("pick", "place", "level")


def ks_windows(df: DataFrame, group: str, at: str, value: str, width: int) -> DataFrame:
    """Each window of two blocks of ``width``: the greatest difference between the distribution of its values and the whole group's.

    Works on counts by value; a window's row has group, start (of its first block), n and distance.
    """
    own = df.withColumn("block", F.floor(F.col(at) / width))
    counts = own.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") - 1))).groupBy(group, "block", value).agg(F.count("*").alias("c"))
    whole = df.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = lambda keys: F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(Window.partitionBy(*keys))
    every = whole.select(group, value, upto([group]).alias("whole"), (F.col("c") / F.sum("c").over(Window.partitionBy(group))).alias("step"))
    here = counts.select(group, "block", value, F.col("c"), upto([group, "block"]).alias("here"), (F.col("c") / F.sum("c").over(Window.partitionBy(group, "block"))).alias("jump"))
    both = here.join(every, [group, value])
    # a window's distribution is flat between its values: the difference is greatest at one of them, or just before it
    gap = F.greatest(F.abs(F.col("here") - F.col("whole")), F.abs(F.col("here") - F.col("jump") - (F.col("whole") - F.col("step"))))
    return both.groupBy(group, "block").agg(F.sum("c").alias("n"), F.max(gap).alias("distance")).select(group, (F.col("block") * width).alias("start"), "n", "distance")


def cutoffs(df: DataFrame, group: str, score: str, percents: list[float]) -> DataFrame:
    """Nearest-rank cutoffs: the score at index int(t / 100 * (n - 1)) of the descending order, from counts by score."""
    counts = df.groupBy(group, score).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(F.desc(score))
    running = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    wanted = running.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    index = F.floor(F.col("percent") / 100 * (F.col("n") - 1))
    return wanted.filter((index < F.col("upto")) & (index >= F.col("upto") - F.col("c"))).select(group, "percent", F.col(score).alias("cutoff"), "n")


def tranches(df: DataFrame, group: str, score: str, truth: Column) -> DataFrame:
    """For each score, how many rows and true rows have at least it, and the share of all true rows."""
    counts = df.groupBy(group, score).agg(F.count("*").alias("c"), F.count_if(truth).alias("t"))
    w = Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(group)
    return counts.select(group, score, F.sum("c").over(w).alias("n_rows"), F.sum("t").over(w).alias("n_true"), F.round(F.sum("t").over(w) / F.sum("t").over(every), 9).alias("sensitivity"))


def smooth(df: DataFrame, contig: str, at: str, value: str, weights: list[float]) -> DataFrame:
    """Weighted sum over neighbouring rows (a band-pass kernel); rows beyond the ends count 0."""
    w = Window.partitionBy(contig).orderBy(at)
    half = len(weights) // 2
    total = sum((F.coalesce(F.lag(value, half - i).over(w) if i <= half else F.lead(value, i - half).over(w), F.lit(0.0)) * x for i, x in enumerate(weights)), F.lit(0.0))
    return df.withColumn("smoothed", total)


def cut_runs(df: DataFrame, contig: str, at: str, active: Column, longest: int) -> DataFrame:
    """Runs of equal activity, cut after ``longest`` positions."""
    cut = runs(df, contig, at, active, [F.count("*").alias("n")])
    step = F.sequence(F.col("start"), F.col("end"), F.lit(longest).cast(dict(df.dtypes)[at]))
    return cut.withColumn("piece", F.explode(step)).select(contig, F.col("piece").alias("start"), F.least(F.col("piece") + longest - 1, F.col("end")).alias("end"), F.col("label").alias("active"))


def cut_places(values: list[float], after: float | None, least: int, longest: int) -> list[int]:
    """Lengths of the regions of an active run. after: the value of the row behind it, if there is one.

    A stretch that is still active at its greatest length ends at the lowest of
    its local minima (lower than the row before, no higher than the one behind)
    from its ``least``-th row on, of equal ones the last; without any, it keeps
    the greatest length.
    """
    out, begin, n = [], 0, len(values)
    while n - begin >= longest:
        best = None
        for i in range(max(least - 1, 1), longest):
            x = values[begin + i]
            behind = values[begin + i + 1] if begin + i + 1 < n else after
            if behind is not None and x < values[begin + i - 1] and x <= behind and (best is None or x <= values[begin + best]):
                best = i
        size = longest if best is None else best + 1
        out.append(size)
        begin += size
    return [*out, n - begin] if begin < n else out


def active_regions(df: DataFrame, contig: str, at: str, value: str, threshold: float, least: int, longest: int) -> DataFrame:
    """Regions of consecutive rows that are active (value above the threshold) or not: start, end, active, n.

    Inactive runs are cut after ``longest`` rows, active ones at their lowest
    minima.  (contig, at) must be unique.  Only active runs that are too long
    for one region are solved one by one; a task takes its runs in order, and
    holds one run and a batch.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    rows = ranged(df.select(contig, at, F.col(value).cast("double").alias("v")).withColumn("active", F.col("v") > threshold), [contig], [at])
    rows = beside(rows, [contig], [at], F.struct("active"), "last", after=False)
    rows = beside(rows, [contig], [at], F.col("v"), "behind")
    rows = running(rows, [contig], [at], F.when(F.col("last.active") == F.col("active"), 0).otherwise(1), "sum", "run").drop("last")
    rows = running(rows, [contig, "run"], [at], F.lit(1), "sum", "place")
    sizes = rows.groupBy(contig, "run").agg(F.count("*").alias("size"))
    every = null_safe(rows, sizes, [contig, "run"])
    long = F.col("active") & (F.col("size") >= longest)
    types = dict(every.dtypes)

    def solved_runs(rows_: pd.DataFrame) -> pd.DataFrame:
        values, behind = rows_["v"].tolist(), rows_["behind"].tolist()
        begins = np.flatnonzero(_run_begins(rows_)).tolist()
        pieces: list[int] = []
        for begin, end in zip(begins, [*begins[1:], len(values)], strict=True):
            last = behind[end - 1]
            for i, n in enumerate(cut_places(values[begin:end], None if pd.isna(last) else float(last), least, longest)):
                pieces += [i] * n
        return rows_[[contig, "run", at]].assign(piece=pieces)

    def _run_begins(rows_: pd.DataFrame) -> np.ndarray:
        codes, runs_ = pd.factorize(rows_[contig], use_na_sentinel=False)[0], rows_["run"].to_numpy()
        return np.r_[True, (codes[1:] != codes[:-1]) | (runs_[1:] != runs_[:-1])]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole runs of a task, whose rows come in order: the last run of a batch waits for the next one."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            joined = pd.concat([held[-1].iloc[-1:], batch], ignore_index=True) if held else batch.reset_index(drop=True)
            begins = np.flatnonzero(_run_begins(joined)[1:]) + (0 if held else 1)
            if not len(begins):
                held.append(batch)
                continue
            last = int(begins[-1])
            whole = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = [batch.iloc[last:]]
            yield solved_runs(whole)
        if held:
            yield solved_runs(pd.concat(held, ignore_index=True))

    in_order = every.filter(long).select(contig, "run", at, "v", "behind").repartition(contig, "run").sortWithinPartitions(contig, "run", at)
    solved = in_order.mapInPandas(cut, f"{contig} {types[contig]}, run long, {at} {types[at]}, piece long").withColumn("active", F.lit(True))
    plain = every.filter(~long).select(contig, "run", at, F.floor((F.col("place") - 1) / longest).alias("piece"), "active")
    both = plain.unionByName(solved)
    return both.groupBy(contig, "run", "piece").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.first("active").alias("active"), F.count("*").alias("n")).drop("run", "piece")
