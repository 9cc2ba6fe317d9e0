"""Suffix-array dedup: bytes of documents that repeat an earlier document.

A byte goes if it lies in a string of LENGTH bytes that also starts in a
document with a smaller doc_id.  A suffix for each byte would multiply the
input by LENGTH, so the suffix array is sparse: in each string of LENGTH bytes
one suffix is chosen by content (of those that leave GRAM bytes, the one whose
GRAM leading bytes have the least hash), so equal strings choose the same one.
A suffix stands for the run of strings that chose it, which start up to
WINDOW - 1 bytes before it; it travels with all bytes of them, as a record:
the bytes from the suffix on, the bytes before it, and the run's bounds.

1. A task sorts the records of its block of documents, keeps each distinct one
   once with the smallest doc_id that has it, and sends them, in order, to the
   ranges between splitters of GRAM leading bytes, sampled from the corpus.
2. A bucket sorts its records by multikey quicksort: by their first 8 bytes,
   then ties by the next 8, and so on.  Neighbours' longest common prefixes
   tell which strings of a record may occur in another one: equal records with
   a larger doc_id are covered as a whole, and the strings of records that
   share only a prefix long enough are sorted in the same way.
3. At the block's home, where its texts wait (compressed), bytes are cut.

No comparison crosses a bucket's boundary: splitters have GRAM bytes, so
suffixes on two sides of one differ within them, and two equal strings agree
in at least GRAM bytes after the chosen place.  Where one such lead is so
frequent that it fills a good part of a bucket, its strings are taken one by
one instead, as suffixes of exactly LENGTH bytes that are dealt by all of them.
A record reaches its bucket once for each block, whatever its frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PACKED, buckets, exchange, groups, mixed, pack, packed_batch, prepare, task_id, texts, trimmed, unpack

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
BLOCK = 6 << 20
#: Level of compression of what is sent: disk is scarcer than time here.
SQUEEZE = 9
#: Starts of strings that are looked at together: small arrays stay in the processor's cache.
PIECE = 1 << 16
#: Records that are built at once.
ROWS = 1 << 14
#: Low bits of a hash that hold a place within a piece.
PLACE = 17
#: Documents, in expectation, from which splitters are sampled (or one for each bucket, if those are more), and suffixes taken of each.
SAMPLE, EACH = 2000, 32
#: A lead is frequent if it takes more than this share of a bucket.
FREQUENT = 0.25
#: Strings that a bucket compares at once.
STRINGS = 1 << 20
#: Bytes of a record: the suffix, what lies before it, the run's two bounds, two unused.
BEFORE = WINDOW - 1
RECORD = LENGTH + BEFORE + 4
WORDS, LEAD, STRING = RECORD // 8, GRAM // 8, -(-LENGTH // 8)
U = np.uint64
#: A record all of whose strings are covered.
ALL = U(1 << 63)
RECORDS, TEXTS, STRINGS_OF, ANSWERS, STRING_ANSWERS = range(5)


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)) if len(data) >= 8 else np.zeros(0, np.uint64)


def chosen(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen suffixes of texts that lie one after another: where each begins, and the first and last start of a string that chose it."""
    total = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if total <= 0:
        return none, none, none
    words, turns, ats, last = loads(data), [], [], -1
    for low in range(0, total, PIECE):
        high = min(total, low + PIECE)
        w = words[low : high + LENGTH - 8].copy()
        value = w[:-8] * U(0x9E3779B97F4A7C15)
        value ^= w[8:]
        value *= U(0xD6E8FEB86659FD93)
        value ^= value >> U(29)
        value *= U(0xBF58476D1CE4E5B9)
        value &= U((1 << 64) - (1 << PLACE))
        value |= np.arange(len(value), dtype=np.uint64)
        size = 1
        while size * 2 <= WINDOW:
            value = np.minimum(value[:-size], value[size:])
            size *= 2
        if size < WINDOW:
            value = np.minimum(value[: size - WINDOW], value[WINDOW - size :])
        at = (value & U((1 << PLACE) - 1)).astype(np.int64) + low
        turn = np.flatnonzero(np.diff(at, prepend=last))
        turns.append(turn + low), ats.append(at[turn])
        last = int(at[-1])
    turn, at = np.concatenate(turns), np.concatenate(ats)
    # a run ends with its text
    first = np.sort(np.concatenate([turn, offsets[:-1][offsets[:-1] < total]]))
    first = first[np.diff(first, prepend=-1) > 0]
    at = at[np.searchsorted(turn, first, "right") - 1]
    doc = np.searchsorted(offsets, first, "right") - 1
    end = np.minimum(np.append(first[1:] - 1, total - 1), offsets[doc + 1] - LENGTH)
    keep = end >= first
    return at[keep], first[keep], end[keep]


def records(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of WORDS numbers for each suffix, which compare as their bytes do."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    size = BEFORE + LENGTH
    near = np.ndarray((len(padded) - size + 1,), f"V{size}", padded, strides=(1,))
    out = np.zeros((len(at), RECORD), np.uint8)
    column = np.arange(size, dtype=np.int16)
    for i in range(0, len(at), ROWS):  # a slice at a time: what is needed for it stays small
        own = slice(i, i + ROWS)
        low, high = ((at[own] - x[own]).astype(np.int16)[:, None] for x in (last, first))
        some = near[at[own]].view(np.uint8).reshape(-1, size)
        some *= (column >= BEFORE - high) & (column < size - low)
        out[own, :LENGTH], out[own, LENGTH:size] = some[:, BEFORE:], some[:, :BEFORE]
        out[own, size : size + 1], out[own, size + 1 : size + 2] = low, high
    return as_words(out)


def as_words(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.uint64).byteswap(inplace=True)


def as_bytes(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words).byteswap().view(np.uint8)


def bounds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before the suffix the last and the first string of each record's run start."""
    return ((words[:, -1] >> U(24)) & U(255)).astype(np.int64), ((words[:, -1] >> U(16)) & U(255)).astype(np.int64)


def multikey(words: np.ndarray, depth: int, order: np.ndarray | None = None, new: np.ndarray | None = None, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows by their first ``depth`` words: a quicksort by one word, then by the next among its ties.

    Returns the order, and where a row differs from the one before it. order
    and new: of a sort by the first ``since`` words, which goes on.
    """
    if order is None:
        order = np.argsort(words[:, 0])
        value = words[order, 0]
        new = np.ones(len(order), bool)
        new[1:] = value[1:] != value[:-1]
        since = 1
    tied = ~new
    tied[:-1] |= ~new[1:]
    at, group = np.flatnonzero(tied), np.cumsum(new)[tied]
    for d in range(since, depth):
        if not len(at):
            break
        value = words[order[at], d]
        turn = np.lexsort((value, group))
        order[at] = order[at[turn]]
        value, group = value[turn], group[turn]
        change = np.ones(len(at), bool)
        change[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        new[at] = change
        tied = ~change
        tied[:-1] |= ~change[1:]
        at, group = at[tied], np.cumsum(change)[tied]
    return order, new


def exploded(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of records that start low to high bytes before the suffix: their rows, records and starts."""
    rows = as_bytes(words)
    size = BEFORE + LENGTH
    text = np.concatenate([rows[:, LENGTH:size], rows[:, :LENGTH]], 1)
    counts = high - low + 1
    owner = np.repeat(np.arange(len(words)), counts)
    back = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + low[owner]
    flat = np.append(text.ravel(), np.zeros(LENGTH, np.uint8))
    own = np.ndarray((len(flat) - LENGTH + 1,), f"V{LENGTH}", flat, strides=(1,))[owner * size + BEFORE - back].view(np.uint8).reshape(-1, LENGTH)
    out = np.zeros((len(own), 8 * STRING), np.uint8)
    out[:, :LENGTH] = own
    return as_words(out), owner, back


def runs(new: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: the run of equal rows that each is in, and the least doc of each run."""
    return np.cumsum(new) - 1, np.minimum.reduceat(doc, np.flatnonzero(new)) if len(doc) else doc


def masks(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each record, which of its strings occur in a smaller doc: bit k for the one that starts k bytes before the suffix, or ALL."""
    out = np.zeros(len(doc), np.uint64)
    order, new = multikey(words, LEAD)
    several = ~new
    several[:-1] |= ~new[1:]
    order, new = order[several], new[several]  # a lead that one record has is in one document only
    if not len(order):
        return out
    lead = new.copy()
    order, new = multikey(words, WORDS, order, new, LEAD)
    run, least = runs(new, doc[order])
    heads = np.flatnonzero(new)
    kind = np.cumsum(lead)[heads] - 1  # the lead of each distinct record
    one = words[order[heads]]
    rows = as_bytes(one)[:, :LENGTH]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(1), differs.argmax(1), LENGTH)
    common[kind[1:] != kind[:-1]] = 0
    longest = np.maximum(np.append(common, 0), np.append(0, common))
    low, high = bounds(one)
    low = np.maximum(low, LENGTH - longest)
    edges = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    mixed_docs = (np.maximum.reduceat(least, edges) > np.minimum.reduceat(least, edges))[kind]
    some = np.flatnonzero((low <= high) & mixed_docs)
    found = np.zeros(len(heads), np.uint64)
    size = np.cumsum((high - low + 1)[some])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STRINGS, "right")))
        if to < len(some):  # a lead's records stay together
            to = int(np.searchsorted(kind[some], kind[some[to - 1]], "right"))
        own = some[at:to]
        strings, owner, back = exploded(one[own], low[own], high[own])
        turn, new_string = multikey(strings, STRING)
        group, smallest = runs(new_string, least[own][owner[turn]])
        hit = np.empty(len(turn), bool)
        hit[turn] = least[own][owner[turn]] > smallest[group]
        bits = np.where(hit, U(1) << back.astype(np.uint64), U(0))
        found[own] = np.add.reduceat(bits, np.flatnonzero(np.diff(owner, prepend=-1)))
        at = to
    out[order] = np.where(doc[order] > least[run], ALL, found[run])
    return out


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(SQUEEZE).compress(pack(*arrays))


def _expand(raw: bytes) -> list[np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(raw))


def shortened(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted records without what each shares with the one before it, and without the unused bytes: prefix lengths, bounds, bytes."""
    rows = as_bytes(words)
    differs = rows[1:, :LENGTH] != rows[:-1, :LENGTH]
    common = np.zeros(len(rows), np.uint8)
    common[1:] = np.where(differs.any(1), differs.argmax(1), LENGTH)
    low, high = bounds(words)
    return common, low.astype(np.uint8), high.astype(np.uint8), rows[_own(common, low, high)]


def _own(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    column, size = np.arange(RECORD), LENGTH + BEFORE
    low, high = low.astype(np.int64)[:, None], high.astype(np.int64)[:, None]
    return ((column >= common[:, None]) & (column < LENGTH - low)) | ((column >= size - high) & (column < size))


def restored(common: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The bytes of shortened records."""
    rows = np.zeros((len(common), RECORD), np.uint8)
    rows[_own(common, low, high)] = data
    every = np.arange(len(common))
    for j in range(int(common.max(initial=0))):  # a column's byte is that of the last record that has its own there
        rows[:, j] = rows[np.maximum.accumulate(np.where(common <= j, every, 0)), j]
    rows[:, LENGTH + BEFORE], rows[:, LENGTH + BEFORE + 1] = low, high
    return rows


def cuts(words: np.ndarray, order: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Where each range between splitters begins among the rows in order, and the end. splitters: rows of LEAD words."""
    first, second = words[order, 0], words[order, 1]
    low, high = (np.searchsorted(first, splitters[:, 0], side) for side in ("left", "right"))
    inner = [a + int(np.searchsorted(second[a:b], s, "left")) for a, b, s in zip(low.tolist(), high.tolist(), splitters[:, 1], strict=True)]
    return np.array([0, *inner, len(order)])


def among(words: np.ndarray, order: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Which of the rows, in order, have one of these leads."""
    out = np.zeros(len(order), bool)
    if not len(leads):
        return out
    column, other = words[order, 0], words[order, 1]
    for first, second in leads:
        a, b = np.searchsorted(column, first, "left"), np.searchsorted(column, first, "right")
        c, d = a + np.searchsorted(other[a:b], second, "left"), a + np.searchsorted(other[a:b], second, "right")
        out[c:d] = True
    return out


def _home_pid(home: int, n: int) -> int:
    return ((home >> 20) + 31 * (home & 0xFFFFF)) % n


class Part(NamedTuple):
    """Suffixes of a block, or of as much of it as is sorted at once."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rank: np.ndarray  # of each suffix's record among the distinct ones
    again: np.ndarray  # a smaller document of the block has the same record
    often: np.ndarray  # of each distinct record: its lead is frequent
    words: np.ndarray  # all records
    distinct: np.ndarray  # which of them are the other distinct ones, in order
    least: np.ndarray  # their least documents
    strings: np.ndarray  # distinct strings of the records with a frequent lead, by bucket
    pid: np.ndarray
    smallest: np.ndarray
    place: np.ndarray  # of each string of each of these records among the distinct ones
    low: np.ndarray
    high: np.ndarray
    local: np.ndarray  # a smaller document of the block has the same string


def parts(batch: pa.RecordBatch, frequent: np.ndarray, n: int) -> Iterator[Part]:
    """Suffixes of a block's documents. The same block always gives the same parts: its home asks again for what it sent."""
    data, offsets = texts(batch)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    ids = batch.column("doc_id")
    known, ids = np.array(ids.is_valid()), ids.fill_null(0).to_numpy()
    every = chosen(data, offsets)
    doc = np.searchsorted(offsets, every[1], "right") - 1
    keep = known[doc]
    every, doc = [x[keep] for x in every], ids[doc[keep]]
    # long texts are sorted in parts, which bounds the memory of records
    for a in range(0, len(doc), BLOCK // 8):
        (at, first, last), own = (x[a : a + BLOCK // 8] for x in every), doc[a : a + BLOCK // 8]
        words = records(data, at, first, last)
        order, new = multikey(words, WORDS)
        group, least = runs(new, own[order])
        rank = np.empty(len(order), np.int64)
        rank[order] = group
        distinct = order[new]
        del order, new, group
        again = own > least[rank]
        often = among(words, distinct, frequent)
        some = words[distinct[often]]
        low, high = bounds(some)
        strings, owner, _ = exploded(some, low, high)
        order, new = multikey(strings, STRING)
        group, smallest = runs(new, least[often][owner[order]])
        strings = strings[order[new]]
        pid = (mixed((strings * np.arange(1, 2 * STRING, 2, dtype=np.uint64)).sum(1, dtype=np.uint64)) % U(n)).astype(np.int64)
        dealt = np.argsort(pid, kind="stable")
        place, string = np.empty(len(dealt), np.int64), np.empty(len(order), np.int64)
        place[dealt], string[order] = np.arange(len(dealt)), group
        local = smallest[string] < least[often][owner]
        yield Part(at, first, last, rank, again, often, words, distinct[~often], least[~often], strings[dealt], pid[dealt], smallest[dealt], place[string], low, high, local)


def _ipc(batch: pa.RecordBatch) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _send(n: int, told):
    """Sorted distinct records of each block, and its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters, frequent = told.value
        for serial, block in enumerate(groups(batches, BLOCK)):
            home = (task_id() << 20) + serial
            whole = pa.Table.from_batches(block).combine_chunks().to_batches()[0]
            yield packed_batch([(_home_pid(home, n), TEXTS, home, _squeeze(_ipc(whole)))])
            for i, part in enumerate(parts(whole, frequent, n)):
                head, out = np.array([i], np.uint32), []
                strings, edges = np.searchsorted(part.pid, np.arange(n + 1)).tolist(), cuts(part.words, part.distinct, splitters).tolist()
                for k in range(n):
                    own = slice(strings[k], strings[k + 1])
                    if own.stop > own.start:
                        out.append((k, STRINGS_OF, home, _squeeze(head, as_bytes(part.strings[own]).ravel(), part.smallest[own])))
                    own = slice(edges[k], edges[k + 1])
                    if own.stop > own.start:
                        out.append((k, RECORDS, home, _squeeze(head, *shortened(part.words[part.distinct[own]]), part.least[own])))
                    if len(out) >= 64:
                        yield packed_batch(out)
                        out = []
                if out:
                    yield packed_batch(out)

    return run


def _answer(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, list] = {RECORDS: [], STRINGS_OF: []}
        for batch in batches:
            for pid, kind, home, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == TEXTS:
                    yield packed_batch([(pid, kind, home, data)])
                else:
                    part, *rows, doc = _expand(data)
                    sent[kind].append((pid, home, int(part[0]), rows, doc))
        for kind, answer, width in ((RECORDS, ANSWERS, RECORD), (STRINGS_OF, STRING_ANSWERS, 8 * STRING)):
            if not sent[kind]:
                continue
            where = [(pid, home, part, len(doc)) for pid, home, part, _, doc in sent[kind]]
            doc = np.concatenate([x[4] for x in sent[kind]])
            rows, at = np.empty((len(doc), width), np.uint8), 0
            for x in sent.pop(kind):
                own = restored(*x[3]) if kind == RECORDS else x[3][0].reshape(-1, width)
                rows[at : at + len(own)] = own
                at += len(own)
            words = as_words(rows)
            del rows, x, own
            if kind == RECORDS:
                found = masks(words, doc)
            else:
                order, new = multikey(words, STRING)
                group, least = runs(new, doc[order])
                found = np.zeros(len(doc), np.uint64)
                found[order] = doc[order] > least[group]
            del words
            at = 0
            for pid, home, part, size in where:
                own = found[at : at + size]
                some = np.flatnonzero(own)
                yield packed_batch([(_home_pid(home, n), answer, home, _squeeze(np.array([part, pid, size], np.uint32), np.diff(some, prepend=0).astype(np.uint32), own[some]))])
                at += size

    return run


def _gathered(answers: list[list[np.ndarray]]) -> np.ndarray:
    """Answers of all buckets, in the order in which they were asked."""
    out = []
    for head, steps, values in sorted(answers, key=lambda x: int(x[0][1])):
        own = np.zeros(int(head[2]), np.uint64)
        own[np.cumsum(steps, dtype=np.int64)] = values
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"


def covered(part: Part, found: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of strings that go. found, strings: answers for the part's records and for its strings of frequent leads."""
    mask = np.zeros(len(part.often), np.uint64)
    mask[~part.often] = found
    if part.often.any():
        counts = part.high - part.low + 1
        starts = np.cumsum(counts) - counts
        back = np.arange(counts.sum()) - np.repeat(starts - part.low, counts)
        hit = (strings[part.place] > 0) | part.local
        mask[part.often] = np.add.reduceat(np.where(hit, U(1) << back.astype(np.uint64), U(0)), starts)
    mask = mask[part.rank]
    whole = part.again | (mask == ALL)
    first, last = [part.first[whole]], [part.last[whole]]
    some = np.flatnonzero((mask > 0) & ~whole)
    mask, at = mask[some], part.at[some]
    for k in range(WINDOW):
        start = at[(mask >> U(k)) & U(1) > 0] - k
        first.append(start), last.append(start)
    return np.concatenate(first), np.concatenate(last)


def joined(begin: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes from each begin to its end: begin, end and text. No run goes on into the next text."""
    order = np.argsort(begin)
    begin = begin[order]
    reach = np.maximum.accumulate(end[order])
    doc = np.searchsorted(offsets, begin, "right") - 1
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    return begin[starts], reach[np.append(starts[1:] - 1, len(begin) - 1)] if len(begin) else reach, doc[starts]


def whole_characters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes of UTF-8 texts, widened to the characters that they touch."""
    inner = np.append((data & 0xC0) == 0x80, False)
    begin, end = begin.copy(), end.copy()
    for _ in range(3):
        begin -= inner[begin]
        end += inner[end]
    return begin, end


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _cut(n: int, told, carried: tuple[str, ...], characters: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, bytes] = {}
        answers: dict[int, dict[tuple[int, int], list]] = {}
        for batch in batches:
            for kind, home, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == TEXTS:
                    waiting[home] = data
                else:
                    head, *rest = _expand(data)
                    answers.setdefault(home, {}).setdefault((kind, int(head[0])), []).append([head, *rest])
        while waiting:
            home, data = waiting.popitem()
            batch = next(iter(pa.ipc.open_stream(pa.py_buffer(_expand(data)[0]))))
            given = answers.pop(home, {})
            data, offsets = texts(batch)
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            found = [covered(part, *(_gathered(given.get((kind, i), [])) for kind in (ANSWERS, STRING_ANSWERS))) for i, part in enumerate(parts(batch, told.value[1], n))]
            first, last = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            begin, end, doc = joined(first, last + LENGTH, offsets)
            if characters:
                begin, end, doc = joined(*whole_characters(data, begin, end), offsets)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[begin] += 1
            edge[end] -= 1
            gone = np.cumsum(edge[:-1], dtype=np.int8) > 0
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(offsets))), pa.int32()), pa.StructArray.from_arrays([pa.array(begin - offsets[doc]), pa.array(end - begin)], ["start", "length"]))
            size = np.diff(offsets)
            removed = np.bincount(doc, end - begin, len(size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(removed), spans, _binary(data[~gone], size - removed), *(batch.column(c) for c in carried)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", *carried])

    return run


def sampled(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n - 1 leads that cut a sample's suffixes into equal parts, and the frequent ones. What comes to the driver is bounded by SAMPLE, n and EACH."""
    count = rows.count()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch)
            leads = [np.zeros((0, LEAD), np.uint64)]
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                at, first, last = chosen(own, np.array([0, len(own)]))
                step = max(1, len(at) // EACH)
                leads.append(records(own, at[::step], first[::step], last[::step])[:, :LEAD])
            found = np.concatenate(leads).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(LEAD)], names=["a", "b"])

    share = min(1.0, max(SAMPLE, n) / max(count, 1))
    picked = rows.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))
    table = picked.select("text").mapInArrow(trimmed(some), "a long, b long").toArrow()
    leads = np.stack([table.column(i).to_numpy().view(np.uint64) for i in range(LEAD)], 1)
    if not len(leads):
        return np.zeros((n - 1, LEAD), np.uint64), np.zeros((0, LEAD), np.uint64)
    order, new = multikey(leads, LEAD)
    leads = leads[order]
    starts = np.flatnonzero(new)
    often = starts[np.diff(starts, append=len(leads)) > max(8, FREQUENT * len(leads) / n)]
    return leads[(np.arange(1, n) * len(leads)) // n], leads[often] if n > 1 else leads[:0]


def dedup(docs: DataFrame, *carried: str, characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs), kept (the other bytes) and the carried columns for every row of docs.

    docs: doc_id and text; more columns are ignored.  Texts are UTF-8 bytes;
    matches never cross documents, and are judged on the input.  A null text
    is empty.  characters: a character goes as a whole if one of its bytes does,
    so what is kept is a text.  A null doc_id is smaller than none: nothing of it goes, and it
    removes nothing.  Rows of one doc_id never remove each other's bytes.  A
    text of any length is one row, which its task holds as a whole.  No rows
    give no rows.  docs should be read from files: a task that is run again
    has to see the same rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = buckets(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *carried)
    told = spark.sparkContext.broadcast(sampled(rows.filter(F.length("text") >= LENGTH), n))
    sent = exchange(rows.mapInArrow(trimmed(_send(n, told)), PACKED), n)
    return exchange(sent.mapInArrow(trimmed(_answer(n)), PACKED), n).mapInArrow(trimmed(_cut(n, told, carried, characters)), ", ".join([KEPT, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)]))
