"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. A task splits each text into pre-tokens, numbers the distinct ones of its
   block of documents, and sends each of them once to the bucket of its hash.
   The documents' pre-tokens with their positions go, as numbers, to the
   block's home partition.
2. A bucket holds all blocks' words with one range of hashes: it encodes each
   distinct word once and sends the ids back to the blocks' homes.
3. At home, the ids of each word are put in its positions.  Decoding looks up
   each id in the table of token bytes (bounded by the vocabulary) and joins
   the bytes.

A word reaches its bucket once for each block, whatever its frequency, so the
commonest word is no hot key.  Blocks are cut by bytes; texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .blocks import PACKED, buckets, exchange, groups, pack, packed_batch, prepare, task_id, trimmed, unpack

BLOCK = 16 << 20
WORDS, PLACES, IDS = 0, 1, 2
#: The pattern as the standard library can run it, which is faster. For letters, digits and white space both agree on texts without OTHER.
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\t\n\r -~\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-ɏ]")


@lru_cache(1)
def full_pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def pretokens(text: str) -> list[str]:
    return (full_pattern() if OTHER.search(text) else QUICK).findall(text)


def _bucket_of(words: list[bytes], n: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(n)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pack(*arrays))


def _expand(raw: bytes) -> list[np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(raw))


def _split(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, block in enumerate(groups(batches, BLOCK)):
            number: dict[str, int] = {}
            ids, places = [], []
            for batch in block:
                ids += batch.column(0).to_pylist()
                for text in batch.column(1):
                    found = pretokens(text.as_py() or "")
                    for w in found:
                        if w not in number:
                            number[w] = len(number)
                    places.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
            every = np.concatenate(places)
            # numbered anew by frequency: small numbers compress well
            ranked = np.argsort(-np.bincount(every, minlength=len(number)), kind="stable")
            rank = np.empty(len(ranked), np.uint32)
            rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
            words = [w.encode() for w in number]
            words = [words[i] for i in ranked.tolist()]
            bucket = _bucket_of(words, n)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n + 1)).tolist()
            home = (task_id() << 20) + serial
            out = []
            for pid in range(n):
                own = [words[i] for i in order[edges[pid] : edges[pid + 1]].tolist()]
                if own:
                    out.append((pid, WORDS, home, _squeeze(np.fromiter(map(len, own), np.uint32, len(own)), np.frombuffer(b"".join(own), np.uint8))))
            yield packed_batch(out)
            known = np.array([i is not None for i in ids])
            yield packed_batch([(_home_pid(home, n), PLACES, home, _squeeze(np.array([i or 0 for i in ids], np.int64), known, np.array([len(x) for x in places], np.uint32), rank[every], bucket.astype(np.uint32)))])

    return run


def _home_pid(home: int, n: int) -> int:
    return ((home >> 20) + 31 * (home & 0xFFFFF)) % n


def _encode(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoding(path)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for pid, kind, home, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == PLACES:
                    yield packed_batch([(pid, kind, home, data)])
                    continue
                sizes, whole = _expand(data)
                whole, ends = whole.tobytes(), np.cumsum(sizes).tolist()
                out = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    w = whole[a:b]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(encode(w), np.uint32).tobytes()
                    out.append(ids)
                counts = (np.fromiter(map(len, out), np.uint32, len(out)) // 4).astype(np.uint32)
                yield packed_batch([(_home_pid(home, n), IDS, home, _squeeze(np.array([pid], np.uint32), counts, np.frombuffer(b"".join(out), np.uint32)))])

    return run


def _reassemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.token_bytes(path)
        places: dict[int, bytes] = {}
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, home, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == PLACES:
                    places[home] = data
                else:
                    parts.setdefault(home, []).append(data)
        while places:
            home, data = places.popitem()
            got = sorted(map(_expand, parts.pop(home, [])), key=lambda x: int(x[0][0]))
            counts = np.concatenate([x[1] for x in got] or [np.zeros(0, np.uint32)]).astype(np.int64)
            flat = np.concatenate([x[2] for x in got] or [np.zeros(0, np.uint32)])
            del got
            doc_ids, known, sizes, ranks, bucket = _expand(data)
            order = np.argsort(bucket, kind="stable")  # buckets' answers, one after another, are in this order of words
            starts = np.empty(len(order), np.int64)
            starts[order] = np.cumsum(counts) - counts
            counts[order] = counts.copy()
            rows, held, at = [], 0, 0
            for doc_id, real, size in zip(doc_ids.tolist(), known.tolist(), sizes.tolist(), strict=True):
                own = ranks[at : at + size]
                at += size
                lengths = counts[own]
                total = int(lengths.sum())
                first = np.repeat(starts[own] - (np.cumsum(lengths) - lengths), lengths)
                ids = flat[first + np.arange(total)]
                decoded = b"".join(map(table.__getitem__, ids.tolist()))
                rows.append((doc_id if real else None, total, ids.astype("<u4").tobytes(), decoded))
                held += len(decoded) + 4 * total
                if held > BLOCK // 2:
                    yield _rows(rows)
                    rows, held = [], 0
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every text and decode the ids again.

    docs: doc_id and text; more columns are ignored.  Returns doc_id,
    n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (bytes).
    A null or empty text has no ids and no bytes.  A null doc_id stays null;
    repeated rows each give a row; no rows give no rows.  Ids are those of the
    ``tiktoken`` library without special tokens.
    """
    prepare(docs.sparkSession)
    path, n = path or vocabulary.rank_file(), buckets(docs.sparkSession)
    sent = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(_split(n)), PACKED)
    encoded = exchange(sent, n).mapInArrow(trimmed(_encode(path, n)), PACKED)
    return exchange(encoded, n).mapInArrow(trimmed(_reassemble(path)), "doc_id long, n_tokens long, ids binary, decoded binary")
