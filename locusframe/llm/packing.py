"""Packing: documents into sequences of bounded length, in their order, by dynamic programming.

The token stream of a task (its documents, one after another) is cut into
windows of at most ``limit`` tokens.  Cuts are chosen among the ends of
documents, the ends of sentences, and a sparse grid inside long sentences, so
that padding plus penalties for cutting a document is least.  A window of
``limit`` or a power of two needs no padding.

With cuts at positions p, the best cost of a packing that ends at p[j] is
``penalty[j] + min(cost[i] + limit - (p[j] - p[i]))`` over all p[i] within
``limit``.  As p[j] is the same for all i, the minimum of ``cost[i] + p[i]``
over a sliding window is needed: a monotone queue gives it in amortised
constant time.  Windows of a smaller power of two are looked up one by one.

No exchange is needed: each task packs what it reads, holding a block of BLOCK
tokens.  The last window of a block is carried into the next one, so only the
last window of a task is padded without choice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocabulary
from .blocks import prepare, task_id, trimmed

BLOCK = 1 << 18
#: Penalties in tokens of padding: for any window, for a cut at a sentence's end, for one inside a sentence.
WINDOW, SENTENCE, INSIDE = 8, 1, 4
#: Sentence ends nearer than NEAR to the cut before are no cuts; inside a sentence there is a cut every FAR tokens.
NEAR, FAR = 8, 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(ids: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a document may be cut, its end last, and the penalties."""
    n, points, penalties, last = len(ids), [], [], 0
    for p in (np.flatnonzero(ends[ids[:-1]]) + 1).tolist():
        if p - last < NEAR:
            continue
        while p - last > FAR:
            last += FAR
            points.append(last)
            penalties.append(INSIDE)
        if p > last:
            points.append(p)
            penalties.append(SENTENCE)
            last = p
    while n - last > FAR:
        last += FAR
        points.append(last)
        penalties.append(INSIDE)
    if points and points[-1] == n:
        points.pop(), penalties.pop()
    return [*points, n], [*penalties, 0]


def best_cuts(points: list[int], penalties: list[int], limit: int) -> list[int]:
    """Indices of the cuts of a cheapest packing. points: ascending, from 0, with gaps of at most ``limit``."""
    place = {p: i for i, p in enumerate(points)}
    smaller = [1 << k for k in range(6, 32) if 1 << k < limit][::-1]
    cost, back = [0] * len(points), [0] * len(points)
    queue, keys, head = [0], [0], 0
    for j in range(1, len(points)):
        p = points[j]
        while points[queue[head]] < p - limit:
            head += 1
        best, i = keys[head] + limit - p, queue[head]
        for size in smaller:
            k = place.get(p - size)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + penalties[j] + WINDOW, i
        key = cost[j] + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop(), queue.pop()
        keys.append(key)
        queue.append(j)
    out, j = [], len(points) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one stream of documents, a block at a time."""

    def __init__(self, path: str, limit: int, first_sequence: int):
        self.ends, self.limit, self.sequence = vocabulary.sentence_ends(path), limit, first_sequence
        self.held: list[tuple] = []  # doc_id, start, ids, doc_tokens, cuts, penalties
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> pa.RecordBatch | None:
        self.held.append((doc_id, 0, ids, len(ids), *cut_points(ids, self.ends)))
        self.tokens += len(ids)
        return self.flush(False) if self.tokens >= BLOCK else None

    def flush(self, last: bool = True) -> pa.RecordBatch | None:
        if not self.held:
            return None
        points, penalties, at = [0], [0], 0
        for _, _, ids, _, cuts, costs in self.held:
            points += [at + c for c in cuts]
            penalties += costs
            at += len(ids)
        if last:  # places for windows of powers of two at the very end
            extra = dict(zip(points, penalties, strict=True))
            for p in range(at - FAR, max(0, at - 2 * self.limit), -FAR):
                extra.setdefault(p, INSIDE)
            points, penalties = (list(x) for x in zip(*sorted(extra.items()), strict=True))
        cuts = np.array([points[j] for j in best_cuts(points, penalties, self.limit)])
        if not last and len(cuts) > 1:
            cuts = cuts[:-1]
        starts = np.cumsum([0] + [len(x[2]) for x in self.held])
        whole = np.concatenate([x[2] for x in self.held])
        end = int(cuts[-1])
        edges = np.union1d(starts[starts < end], np.append(cuts, 0))
        begin, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(starts, begin, "right") - 1
        window = np.searchsorted(cuts, begin, "right")
        window_start = np.append(0, cuts)[window]
        raw = memoryview(whole.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        before = np.array([x[1] for x in self.held])
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.held[d][0] for d in doc.tolist()], pa.int64()),
                pa.array(begin - starts[doc] + before[doc]),
                pa.array(stop - begin),
                pa.array(crc, pa.int64()),
                pa.array(np.array([x[3] for x in self.held])[doc]),
                pa.array(window + self.sequence),
                pa.array(begin - window_start),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )
        self.sequence += len(cuts)
        held = []
        for (doc_id, start, ids, total, points, costs), at in zip(self.held, starts.tolist(), strict=False):
            if at + len(ids) > end:
                skip = max(0, end - at)
                later = [(p - skip, c) for p, c in zip(points, costs, strict=True) if p > skip]
                held.append((doc_id, start + skip, ids[skip:], total, [p for p, _ in later], [c for _, c in later]))
        self.held, self.tokens = held, sum(len(x[2]) for x in held)
        return out


def pack(docs: DataFrame, path: str | None = None, limit: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence.

    docs: doc_id and text; more columns are ignored.  Ids are those of the
    byte-level BPE vocabulary at ``path`` (as the ``tokenizers`` library gives
    them without adding special tokens), then ``end_id``.
    A null or empty text is that one id.  A null doc_id stays null; repeated
    rows are packed like others.  No rows give no rows.  Documents keep the
    order in which their task reads them.  sequence_id is unique, not gapless.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary.json_file()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(path, limit, task_id() << 36)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([vocabulary.encode(path, text.as_py() or ""), tail])
                if (out := packer.add(doc_id, ids)) is not None:
                    yield out
        while (out := packer.flush()) is not None:
            yield out

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(packed), SCHEMA)
