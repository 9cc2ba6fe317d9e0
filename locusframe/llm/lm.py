"""Stupid-backoff scores from n-gram counts of the whole corpus, a document's own counts left out.

With c(g) how often the n-gram g occurs in all other documents, the score of a
word w after u v is c(u v w) / c(u v) if c(u v w) > 0, else BACKOFF times the
score of w after v, and so on; the shortest is c(w) / N, with 1 / (N + 1) for
a word that no other document has (N: words of all other documents).

1. A task lists the distinct n-grams of its block of documents with their
   counts and sends them, sorted, to the buckets of their hashes' ranges.
2. A bucket has the count table of one range: it adds up equal n-grams, joins
   the totals to what each block sent and returns them in that order.
3. At the block's home, where its texts wait (compressed), the n-grams are
   exploded again, totals are joined to them, the document's own counts are
   subtracted, and the logarithms are summed for each document.

The number of words is the count of the empty n-gram.  An n-gram that each
document has is sent once by each block.  Hashes have 56 bits, so of 10^10
distinct n-grams about one in ten million shares its count with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, PACKED, SPACE, buckets, exchange, groups, pack, packed_batch, prepare, task_id, texts, trimmed, unpack, windows, word_hashes

ORDER, BACKOFF = 3, 0.4
BLOCK = 12 << 20
GRAMS, TEXTS, TOTALS = 0, 1, 2
U = np.uint64
#: The empty n-gram.
NOTHING = U(0)
SHIFT = U(8)


def block_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n: hashes of all n-grams, and their bounds by text. And the bounds of words."""
    _, _, hashes, bounds = word_hashes(data, offsets, SPACE, LOWER)
    found = []
    for n in range(1, order + 1):
        g, to = windows(hashes + U(n), bounds, n)
        found.append(((g >> SHIFT) | U(1), to))
    return found, bounds


def distinct(found: list[tuple[np.ndarray, np.ndarray]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes with counts, the empty n-gram first."""
    every = np.concatenate([g for g, _ in found])
    every.sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(new)
    return np.concatenate([[NOTHING], every[at]]), np.concatenate([[words], np.diff(at, append=len(every))])


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of 56-bit hashes begins in a sorted array."""
    return np.searchsorted(hashes, np.array([(i << 56) // n for i in range(n)] + [1 << 57], np.uint64))


def small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the greatest needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pack(*arrays))


def expand(raw: bytes) -> list[np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(raw))


def home_pid(home: int, n: int) -> int:
    return ((home >> 20) + 31 * (home & 0xFFFFF)) % n


def _send(order: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, block in enumerate(groups(batches, BLOCK)):
            home = (task_id() << 20) + serial
            whole = pa.Table.from_batches(block).combine_chunks().to_batches()[0]
            data, offsets = texts(whole)
            found, bounds = block_grams(data, offsets, order)
            hashes, counts = distinct(found, int(bounds[-1] - bounds[0]))
            del found
            edges = ranges(hashes, n).tolist()
            out = []
            for pid in range(n):
                own = slice(edges[pid], edges[pid + 1])
                if own.stop > own.start:
                    out.append((pid, GRAMS, home, squeeze(np.diff(hashes[own], prepend=U(0)), small(counts[own]))))
                    if len(out) >= 64:
                        yield packed_batch(out)
                        out = []
            ids = whole.column(0)
            known = np.array(ids.is_valid())
            text = data[offsets[0] : offsets[-1]]
            out.append((home_pid(home, n), TEXTS, home, zstandard.ZstdCompressor(3).compress(pack(ids.fill_null(0).to_numpy(), known, offsets - offsets[0], text))))
            yield packed_batch(out)

    return run


def _total(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = []
        for batch in batches:
            for pid, kind, home, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == TEXTS:
                    yield packed_batch([(pid, kind, home, data)])
                else:
                    steps, counts = expand(data)
                    sent.append((pid, home, np.cumsum(steps, dtype=np.uint64), counts))
        if not sent:
            return
        hashes = np.concatenate([x[2] for x in sent])
        counts = np.concatenate([x[3].astype(np.int64) for x in sent])
        where = [(pid, home, len(h)) for pid, home, h, _ in sent]
        del sent
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        del hashes
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        totals = np.empty(len(order), np.int64)
        totals[order] = sums[np.cumsum(new) - 1]
        at = 0
        for pid, home, size in where:
            yield packed_batch([(home_pid(home, n), TOTALS, home, squeeze(np.array([pid], np.uint32), small(totals[at : at + size])))])
            at += size

    return run


def without_own(found: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray) -> list[np.ndarray]:
    """For each n-gram its total less its own document's count, by n. One stable sort: equal n-grams stay in the order of documents."""
    every = np.concatenate([g for g, _ in found])
    doc = np.concatenate([np.repeat(np.arange(len(to) - 1, dtype=np.int32), np.diff(to)) for _, to in found])
    place = np.argsort(every, kind="stable")
    every, doc = every[place], doc[place]
    new = np.ones(len(place), bool)
    new[1:] = every[1:] != every[:-1]
    run = new.copy()
    run[1:] |= doc[1:] != doc[:-1]
    del every, doc
    first = np.flatnonzero(run)
    own = np.diff(first, append=len(place))
    rest = totals[np.cumsum(new)[first]] - own  # the first total is the empty n-gram's
    out = np.empty(len(place), np.int64)
    out[place] = np.repeat(rest, own)
    return np.split(out, np.cumsum([to[-1] for _, to in found])[:-1])


def document_scores(data: np.ndarray, offsets: np.ndarray, totals: np.ndarray, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and sum of log scores of each text of a block. totals: of the block's distinct n-grams, in order."""
    found, bounds = block_grams(data, offsets, order)
    words = np.diff(bounds)
    others = without_own(found, totals)  # for each n: how often each n-gram occurs in other documents
    found = [(None, to) for _, to in found]
    rest = np.repeat(totals[0] - words, words)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(others[0] > 0, others[0] / rest, 1 / (rest + 1.0))
        for n in range(2, order + 1):
            longer, to = others[n - 1], found[n - 1][1]
            counts = np.diff(to)
            some = counts > 0
            # the word that each n-gram ends with, and the shorter n-gram that it begins with
            last = np.repeat(bounds[:-1][some] + n - 1, counts[some]) + np.arange(len(longer)) - np.repeat(to[:-1][some], counts[some])
            shorter = found[n - 2][1]
            begin = np.repeat(shorter[:-1][some], counts[some]) + np.arange(len(longer)) - np.repeat(to[:-1][some], counts[some])
            step = score * backoff
            start = bounds[:-1]
            for i in range(n - 1):  # words with too short a history can't have been backed off
                at = (start + i)[words > i]
                step[at] = score[at]
            ratio = longer / others[n - 2][begin]
            step[last] = np.where(longer > 0, ratio, step[last])
            score = step
    logs = np.concatenate([[0.0], np.cumsum(np.log(score))])
    return words, logs[bounds[1:]] - logs[bounds[:-1]]


def _score(order: int, backoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, bytes] = {}
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, home, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == TEXTS:
                    waiting[home] = data
                else:
                    parts.setdefault(home, []).append(data)
        while waiting:
            home, data = waiting.popitem()
            got = sorted(map(expand, parts.pop(home)), key=lambda x: int(x[0][0]))
            totals = np.concatenate([x[1].astype(np.int64) for x in got])
            ids, known, offsets, text = expand(data)
            words, logs = document_scores(text, offsets, totals, order, backoff)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~known.astype(bool)), pa.array(words), pa.array(logs)], names=["doc_id", "n_words", "log_score"])

    return run


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed over words) for every row of docs.

    docs: doc_id and text; more columns are ignored.  Words are separated by
    space and the characters 9 to 13; A to Z count as a to z.  Null, empty and
    blank texts have no words and log_score 0.  A null doc_id stays null.
    Repeated rows are documents of their own, and each other's evidence.
    """
    prepare(docs.sparkSession)
    n = buckets(docs.sparkSession)
    sent = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(trimmed(_send(order, n)), PACKED)
    totals = exchange(sent, n).mapInArrow(trimmed(_total(n)), PACKED)
    return exchange(totals, n).mapInArrow(trimmed(_score(order, backoff)), "doc_id long, n_words long, log_score double")


SQL = f"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') ws from documents),
t as (select rid, i, ws[i] w, case when i > 1 then ws[i - 1] end v, case when i > 2 then ws[i - 2] end u, case when i > 1 then ws[i - 1] || ' ' || ws[i] end vw, case when i > 2 then ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] end uvw from (select rid, ws, unnest(range(1, len(ws) + 1)) i from d)),
g as (select rid, w g from t union all select rid, vw from t where vw is not null union all select rid, uvw from t where uvw is not null),
own as (select rid, g, count(*) c from g group by all),
c as (select rid, g, sum(c) over (partition by g) - c o from own),
n as (select rid, (select count(*) from t) - count(*) n from t group by rid),
s as (select t.rid, t.i, n.n, a.o a, b.o b, e.o e, case when t.v is not null then f.o end f, case when t.u is not null then h.o end h, t.v, t.u
  from t join n using (rid) join c a on a.rid = t.rid and a.g = t.w left join c b on b.rid = t.rid and b.g = t.vw left join c e on e.rid = t.rid and e.g = t.uvw
  left join c f on f.rid = t.rid and f.g = t.v left join c h on h.rid = t.rid and h.g = t.u || ' ' || t.v),
p1 as (select *, case when a > 0 then a / n else 1 / (n + 1.0) end p from s),
p2 as (select *, case when v is null then p when b > 0 then b / f else {BACKOFF} * p end q from p1),
p3 as (select rid, ln(case when u is null then q when e > 0 then e / h else {BACKOFF} * q end) l from p2)
select d.doc_id, len(d.ws)::bigint n_words, round(coalesce(x.l, 0), 4) log_score, case when len(d.ws) > 0 then round(x.l / len(d.ws), 4) end mean_log_score from d left join (select rid, sum(l) l from p3 group by rid) x using (rid)
"""
