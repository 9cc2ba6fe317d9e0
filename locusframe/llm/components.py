"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces links by links to a smaller neighbour, with a minimum for
each node (pre-aggregated before the shuffle) and a join; all of them stay in
tables.  Before the steps each task replaces the links that it holds by a
spanning forest, a bounded number of links at a time.  As soon as no more links
than that are left in all, one task turns them into the components: each step
is several shuffles, whose plans, code and broadcasts take the driver's memory
however few links there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import discard, settle, written

FOREST = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def reduced(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for a, b in pairs:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = [x for x in up if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= FOREST:
            yield reduced(held)
            held, n = [], 0
    yield reduced(held)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node and component, its smallest node, for every node that differs from it.

    A link with a null end links nothing; repeated links and loops change
    nothing; no links give no rows. Each step's table replaces the one before.
    """
    links = written(links.select("u", "v").filter("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "links")
    state, n = None, links.count()
    while n > FOREST:
        now = written(_small_star(_large_star(links)), "links")
        discard(links)
        links, seen = now, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if seen == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, n = seen, seen[0]
    found = written(links.coalesce(1).mapInArrow(_forest, "u long, v long"), "links")  # at most FOREST links: one forest, whose roots are the smallest nodes
    discard(links)
    settle(found.sparkSession)
    return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
