"""Exact top-k inner products with a bit-sliced index.

Components are quantised to whole numbers.  Each task cuts the rows that it
reads into blocks of ROWS to twice as many vectors (its last: fewer) and stores a block as slices: for
each dimension and each bit of the (shifted) component, a bitmap with one bit
for each row.  A query multiplies its components by the slices with bitmap
arithmetic only: for each digit (1 or -1) of a query component the dimension's
slices, or their complements, enter a tree of carry-save adders at the weight
of that digit.  What comes out is the bit-sliced sum of all rows at once; the
greatest rows are then picked from the most significant slice downward, keeping
the rows that have a one while there are still k of them.  Rows tied at the
boundary are resolved exactly, by smaller id.

The index is written once.  GROUP blocks meet a shift of at most QUERIES
queries in one task, which keeps the k best of each query: so the index is sent
once for each QUERIES queries, and the queries once for each GROUP blocks.  A
block is skipped for a query if the greatest score that its components' ranges
allow is less than the query's k-th best so far.  The best of all groups meet
in a window.  All rows are indexed and all scores are exact, so recall is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import buckets, prepare, task_id, written

#: Rows from which a block of the index is full; blocks that one task searches; queries that it searches for.
ROWS, GROUP, QUERIES = 8192, 16, 8192
#: Components are whole numbers below this in size, so that scores of up to 8,192 dimensions are exact.
LARGEST = 1 << 25
INDEX, ASKS = 0, 1
BUILT = "kind int, block long, dims int, n int, ids binary, low binary, bits binary, slices binary, places binary, v binary"


def slices(values: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """For each dimension its slices, least significant first, as whole numbers with a bit for each row; and what was subtracted."""
    low = values.min(0)
    shifted = values - low
    out = []
    for d in range(values.shape[1]):
        column = shifted[:, d]
        bits = int(column.max()).bit_length()
        out.append([int.from_bytes(np.packbits((column >> b) & 1, bitorder="little").tobytes(), "little") for b in range(bits)])
    return out, low


def added(planes: dict[int, list[int]]) -> list[int]:
    """Bit-sliced sum of bitmaps by weight: full adders turn three bitmaps of a weight into one, and one of the next weight."""
    out, weight = [], 0
    while weight <= max(planes, default=-1):
        stack = planes.get(weight, [])
        up = planes.setdefault(weight + 1, []) if len(stack) > 1 else None
        while len(stack) > 2:
            a, b, c = stack.pop(), stack.pop(), stack.pop()
            x = a ^ b
            stack.append(x ^ c)
            up.append((a & b) | (x & c))
        if len(stack) == 2:
            a, b = stack.pop(), stack.pop()
            stack.append(a ^ b)
            up.append(a & b)
        out.append(stack[0] if stack else 0)
        weight += 1
    return out


def digits(q: int) -> list[tuple[int, int]]:
    """q as a sum of powers of two with signs, no two of them neighbours: (place, sign)."""
    out, place = [], 0
    while q:
        if q & 1:
            sign = 2 - (q & 3)
            out.append((place, sign))
            q -= sign
        q >>= 1
        place += 1
    return out


def scores(index: list[list[int]], query: np.ndarray, every: int) -> tuple[list[int], int]:
    """Slices of a non-negative sum for all rows, and what to subtract from it to get sum(query * shifted components).

    A digit of -1 adds the complement of the slices.
    """
    planes: dict[int, list[int]] = {}
    excess = 0
    for own, q in zip(index, query.tolist(), strict=True):
        for place, sign in digits(q):
            flip = every if sign < 0 else 0
            if flip:
                excess += ((1 << len(own)) - 1) << place
            for i, s in enumerate(own):
                planes.setdefault(place + i, []).append(s ^ flip)
    return added(planes), excess


def greatest(total: list[int], alive: int, k: int) -> tuple[int, int]:
    """Bitmaps of rows surely among the k greatest, and of those tied at the boundary."""
    sure = 0
    n = 0
    for s in reversed(total):
        ones = alive & s
        count = ones.bit_count()
        if n + count > k:
            alive = ones
        else:
            sure |= ones
            n += count
            alive &= ~s
        if n == k:
            return sure, 0
    return sure, alive


def rows_of(bitmap: int, most: int | None = None) -> list[int]:
    """Places of the ones, lowest first."""
    out = []
    while bitmap and (most is None or len(out) < most):
        one = bitmap & -bitmap
        out.append(one.bit_length() - 1)
        bitmap ^= one
    return out


class Block:
    """One block of the index, as it is stored."""

    def __init__(self, n: int, ids: bytes, low: bytes, bits: bytes, raw: bytes):
        self.n, self.every = n, (1 << n) - 1
        self.ids, self.low = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64)
        counts, size = np.frombuffer(bits, np.uint8), (n + 7) // 8
        at, self.index = 0, []
        for c in counts.tolist():
            self.index.append([int.from_bytes(raw[at + i * size : at + (i + 1) * size], "little") for i in range(c)])
            at += c * size
        self.high = self.low + (1 << counts.astype(np.int64)) - 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No less than the greatest score of each query."""
        return np.maximum(queries * self.low, queries * self.high).sum(1)

    def best(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k greatest rows, ties to smaller ids. own: the place of a row that is left out."""
        total, excess = scores(self.index, query, self.every)
        alive = self.every if own is None else self.every & ~(1 << own)
        sure, tied = greatest(total, alive, k)
        found = rows_of(sure)
        found += rows_of(tied, k - len(found))
        base = int(query @ self.low) - excess
        return [(base + sum(((s >> i) & 1) << b for b, s in enumerate(total)), int(self.ids[i])) for i in found]


def quantised(table: DataFrame, levels: int = 256) -> DataFrame:
    """vec_id and v, the components as floor(levels * x). Rows whose id or vector is null, or that hold null or non-finite components, or are empty, are left out."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = lambda c: F.floor(c.cast("double") * levels)
    checked = lambda c: F.when(F.abs(c.cast("double") * levels) < LARGEST, whole(c).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {levels} is {LARGEST} or more")).cast("int"))
    return table.filter(fine).select(F.col("vec_id").cast("long"), F.transform(x, checked).alias("v"))


def _build(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        serial = 0

        def block(dims: int) -> pa.RecordBatch:
            nonlocal serial
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            index, low = slices(values)
            number = (task_id() << 32) + serial
            serial += 1
            size = (len(ids) + 7) // 8
            raw = b"".join(s.to_bytes(size, "little") for own in index for s in own)
            asks = np.flatnonzero(ids % every == 0)
            rows = [(INDEX, number, dims, len(ids), ids.tobytes(), low.tobytes(), np.array([len(x) for x in index], np.uint8).tobytes(), raw, None, None)]
            if len(asks):
                rows.append((ASKS, number, dims, len(asks), ids[asks].tobytes(), None, None, None, asks.tobytes(), values[asks].astype(np.int32).tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in BUILT.split(", ")])

        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            offsets, flat = np.asarray(v.offsets), v.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                values = flat[offsets[:-1][own][:, None] + np.arange(dims)].astype(np.int64)
                for at in range(0, len(own), ROWS):
                    part = held.setdefault(dims, [])
                    part.append((ids[own[at : at + ROWS]], values[at : at + ROWS]))
                    if sum(len(x) for x, _ in part) >= ROWS:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    return run


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
        rows = unit.to_pylist()
        out = []
        for dims in {r["dims"] for r in rows}:
            asks = [r for r in rows if r["kind"] == ASKS and r["dims"] == dims]
            if not asks:
                continue
            queries = np.concatenate([np.frombuffer(r["v"], np.int32).reshape(-1, dims) for r in asks]).astype(np.int64)
            names = [(r["block"], int(p), int(i)) for r in asks for p, i in zip(np.frombuffer(r["places"], np.int64), np.frombuffer(r["ids"], np.int64), strict=True)]
            heaps: list[list[tuple[int, int]]] = [[] for _ in names]  # (score, -id), the least first
            for r in rows:
                if r["kind"] != INDEX or r["dims"] != dims:
                    continue
                block = Block(r["n"], r["ids"], r["low"], r["bits"], r["slices"])
                for heap, query, bound, (home, place, _) in zip(heaps, queries, block.bounds(queries).tolist(), names, strict=True):
                    if len(heap) == k and bound < heap[0][0]:
                        continue
                    for score, i in block.best(query, k, place if home == r["block"] else None):
                        if len(heap) < k:
                            heappush(heap, (score, -i))
                        elif (score, -i) > heap[0]:
                            heapreplace(heap, (score, -i))
            out += [(*name, -i, score) for name, heap in zip(names, heaps, strict=True) for score, i in heap]
        columns = zip(*out, strict=True) if out else ((),) * 5
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["home", "place", "query_id", "vec_id", "score"])

    return run


def top_k(table: DataFrame, every: int = 50, k: int = 5, levels: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k best among all other rows.

    table: vec_id and embedding; more columns are ignored.  Vectors of another
    length than the query's are no candidates.  Rows that share an id are rows
    of their own: each may be a query, and is a candidate for the others; equal
    scores and ids are in no order.  Rows without an id, without a vector, or
    with a null or non-finite component take no part; a component that is
    LARGEST or more in size, times ``levels``, is an error.  No rows give no
    rows.  table should be read from files: a task that is run again has to see
    the same rows.
    """
    spark = table.sparkSession
    prepare(spark)
    built = written(quantised(table, levels).mapInArrow(_build(every), BUILT), "slices")
    sizes = {r.kind: (r.blocks, r.n) for r in built.groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).collect()}
    if ASKS not in sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, asked = sizes[INDEX][0], sizes[ASKS][1]
    groups, shifts = max(-(-blocks // GROUP), min(blocks, buckets(spark))), -(-asked // QUERIES)
    place = lambda n, seed: F.pmod(F.xxhash64("block", "dims", F.lit(seed)), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = built.filter(F.col("kind") == INDEX).withColumn("g", place(groups, 1)).withColumn("shift", numbers(shifts))
    asks = built.filter(F.col("kind") == ASKS).withColumn("shift", place(shifts, 2)).withColumn("g", numbers(groups))
    units = index.unionByName(asks).repartition(min(groups * shifts, max(buckets(spark), groups * shifts // 4)), "g", "shift")
    found = units.groupBy("g", "shift").applyInArrow(_search(k), "home long, place long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) v from embeddings),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) rank, vec_id, score from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 5
"""
