"""Shared pieces of the corpus operators.

*Packed exchange.*  Several operators have to bring together facts about
hundreds of millions of short strings (n-grams, shingles, suffixes, words).  A
row for each would spend most of its bytes and CPU time on row headers, so a
map task packs what it knows about one bucket into a single binary value:
sorted, deduplicated within the task's block, and cut into byte planes so that
shuffle compression sees the regular high bytes.  A bucket is a partition of
the following exchange (``repartitionById``), whose tasks unpack with numpy.  A
block never sends an empty value, so there are at most as many values as
distinct strings, and a string that a third of all rows hold is sent once for
each block.

*Words.*  ``word_hashes`` finds words in a whole Arrow batch with array
operations only, without a Python object for each word.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Rows and bytes that Spark hands to Python at once; they bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of text that are turned into arrays at once.
PIECE = 2 << 20
#: Columns of the rows of a packed exchange.
PACKED = "pid int, kind int, home long, data binary"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: text rows differ in length by a factor of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def buckets(spark: SparkSession) -> int:
    """Partitions of a packed exchange: what the session is set to, which should follow the input's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Without one, a temporary folder, but only where all tasks run on this machine (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


#: Paths of tables that this process has written and not discarded.
_kept: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return a reader of it: cuts lineage, and later use doesn't compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _kept.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that written() returned and nothing reads any more."""
    _delete(df.sparkSession, df.written_to)


def clear(spark: SparkSession) -> None:
    """Delete all tables of written(), once the results that were computed from them are written elsewhere."""
    for path in list(_kept):
        _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _kept.remove(name)


def settle(spark: SparkSession) -> None:
    """Let the driver collect its garbage: only then does Spark drop shuffles and broadcasts that nothing uses any more, and the JVM gives heap back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def exchange(df: DataFrame, n: int) -> DataFrame:
    return df.repartitionById(n, F.col("pid"))


def packed_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    pid, kind, home, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(kind, pa.int32()), pa.array(home, pa.int64()), pa.array(data, pa.binary())], names=["pid", "kind", "home", "data"])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_rng = np.random.default_rng(20240229)
#: A random odd value for each byte, and the base of the polynomial over a word's bytes.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(int(_rng.integers(1, 2**62)) * 4 + 3)
#: Multipliers for combining neighbouring words.
COMBINE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)

#: Words are separated by space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def piece_hashes(data: np.ndarray, first: np.ndarray, outside: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word of some bytes. first: where a document starts; a word ends there."""
    inside = ~outside[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = first[first < len(data)]
    begins[at] = inside[at]
    where = np.flatnonzero(inside)
    if not len(where):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    head = np.flatnonzero(begins[where])
    lengths = np.diff(head, append=len(where))
    place = np.arange(len(where)) - np.repeat(head, lengths)
    values = BYTE[fold[data[where]]] * powers(int(lengths.max()))[place]
    return where[head], lengths, mixed(np.add.reduceat(values, head) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that lie one after another in ``data``: start, length, hash, and bounds of each text's words.

    outside: bytes that are no part of a word. fold: what each byte counts as.
    Pieces of PIECE bytes, or one word if that is longer, are taken at a time.
    """
    base = int(offsets[0])
    parts, at, end = [], base, int(offsets[-1])
    while at < end:
        to = min(end, at + PIECE)
        while to < end:  # to the next byte that ends a word
            gap = np.flatnonzero(outside[data[to : min(end, to + 65536)]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(end, to + 65536)
        lo, hi = np.searchsorted(offsets, (at, to))
        begin, length, value = piece_hashes(data[at:to], offsets[lo:hi] - at, outside, fold)
        parts.append((begin + at, length, value))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin, length, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return begin, length, value, np.searchsorted(begin, offsets)


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column, without a copy; a null is an empty text."""
    x = batch.column(column)
    if x.null_count:
        x = x.fill_null(b"" if pa.types.is_binary(x.type) else "")
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(x.type) or pa.types.is_large_string(x.type)
    offsets = np.frombuffer(x.buffers()[1], np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None and x.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and bounds of each text's runs. Texts with fewer words have none."""
    n = len(hashes) - size + 1
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    to = np.concatenate(([0], np.cumsum(counts)))
    if n <= 0 or not counts.sum():
        return np.zeros(0, np.uint64), to
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += hashes[i : i + n] * COMBINE[i]
    keep = np.repeat(bounds[:-1][counts > 0], counts[counts > 0]) + np.arange(to[-1]) - np.repeat(to[:-1][counts > 0], counts[counts > 0])
    return mixed(out[keep]), to


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, most significant byte of all values first: sorted values then have long runs of equal bytes."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T[::-1].tobytes()


def unplanes(raw: bytes | memoryview, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1)[::-1].T).view(kind).ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, one after another, with their types and lengths."""
    head, body = [], []
    for x in arrays:
        raw = planes(x) if x.itemsize > 1 else np.ascontiguousarray(x).tobytes()
        head.append(f"{x.dtype.str}{len(x)}")
        body.append(raw)
    top = ",".join(head).encode()
    return len(top).to_bytes(2, "little") + top + b"".join(body)


def unpack(raw: bytes) -> list[np.ndarray]:
    n = int.from_bytes(raw[:2], "little")
    out, at = [], 2 + n
    for x in raw[2 : 2 + n].decode().split(","):
        kind, count = np.dtype(x[:3]), int(x[3:])
        size = kind.itemsize * count
        out.append(unplanes(raw[at : at + size], kind) if kind.itemsize > 1 else np.frombuffer(raw, kind, count, at))
        at += size
    return out


def groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in blocks of about ``size`` bytes. A block is what a task deduplicates before it sends anything."""
    block, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block.append(batch)
        total += batch.nbytes
        if total >= size:
            yield block
            block, total = [], 0
            release()
    if block:
        yield block


def _libc():
    """malloc_trim of the C library, where it has one."""
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, giving back to the system what it has freed when it ends: workers live on and serve later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    _libc()(0)


def task_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def crc32_mod(column: str, n: int):
    """crc32 of a whole number as text, modulo n: the folds of the learned operators. Null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
