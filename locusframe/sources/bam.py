"""Binary alignment files (BAM), read and written in shards.

A file is a task's: a large set of reads should lie in many files, as
write_bam writes them (each with the header).  The format's blocks are gzip
members, its records little-endian structs; a task holds a bounded number of
records at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: letters of CIGAR operations and of bases, the empty last block, the header of a block.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
#: Bytes that go into one block, and records that are turned into rows at once.
BLOCK, ROWS = 0xFF00, 5000
PAIRS = np.array([a + b for a in BASES for b in BASES])
CODES = {c: i for i, c in enumerate(BASES)}
SCHEMA = "name string, flags int, contig string, start int, mapq int, cigar array<struct<len:int,op:string>>, mate_contig string, mate_start int, tlen int, bases string, quals array<int>, tags map<string,string>"
SIZES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def inflated(raw: bytes) -> Iterator[bytes]:
    """The contents of a file's blocks, one after another."""
    while raw:
        block = zlib.decompressobj(31)
        yield block.decompress(raw)
        raw = block.unused_data


class _Reader:
    """Bytes of a stream of blocks, a number at a time."""

    def __init__(self, raw: bytes):
        self.blocks, self.held = inflated(raw), b""

    def take(self, n: int) -> bytes:
        parts = [self.held]
        size = len(self.held)
        while size < n:
            block = next(self.blocks, None)
            if block is None:
                break
            parts.append(block)
            size += len(block)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        key, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in SIZES:
            size = struct.calcsize(SIZES[kind])
            value = f"{struct.unpack(SIZES[kind], raw[at : at + size])[0]:g}" if kind == "f" else str(struct.unpack(SIZES[kind], raw[at : at + size])[0])
            at += size
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind in "ZH":
            end = raw.index(0, at)
            value, at = raw[at:end].decode(), end + 1
        else:  # an array
            sub, n = chr(raw[at]), struct.unpack("<I", raw[at + 1 : at + 5])[0]
            size = struct.calcsize(SIZES[sub])
            items = [struct.unpack(SIZES[sub], raw[at + 5 + i * size : at + 5 + (i + 1) * size])[0] for i in range(n)]
            value, at = ",".join([sub, *map(str, items)]), at + 5 + n * size
        out.setdefault(key, value)
    return out


def records(raw: bytes) -> Iterator[dict]:
    """Rows of one file's reads."""
    reader = _Reader(raw)
    if reader.take(4) != b"BAM\1":
        raise ValueError("not a binary alignment file")
    reader.take(reader.number())
    contigs = []
    for _ in range(reader.number()):
        contigs.append(reader.take(reader.number())[:-1].decode())
        reader.number()
    name_of = lambda i: contigs[i] if i >= 0 else None
    while size := reader.take(4):
        body = reader.take(struct.unpack("<i", size)[0])
        ref, pos, n_name, mapq, _, n_ops, flags, n_bases, mate_ref, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", body[:32])
        at = 32 + n_name
        ops = np.frombuffer(body, "<u4", n_ops, at)
        at += 4 * n_ops
        packed = np.frombuffer(body, np.uint8, (n_bases + 1) // 2, at)
        at += len(packed)
        quals = np.frombuffer(body, np.uint8, n_bases, at)
        at += n_bases
        yield {
            "name": body[32 : 32 + n_name - 1].decode(),
            "flags": flags,
            "contig": name_of(ref),
            "start": pos + 1,
            "mapq": mapq,
            "cigar": [{"len": int(x >> 4), "op": OPS[int(x & 15)]} for x in ops],
            "mate_contig": name_of(mate_ref),
            "mate_start": mate_pos + 1,
            "tlen": tlen,
            "bases": "".join(PAIRS[packed].tolist())[:n_bases],
            "quals": quals.tolist() if n_bases and quals[0] != 255 else ([] if not n_bases else None),
            "tags": list(_tags(body[at:]).items()),
        }


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of all binary alignment files of a folder (or of one file), with end and read_group."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    kind = pa.schema([("name", pa.string()), ("flags", pa.int32()), ("contig", pa.string()), ("start", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))), ("mate_contig", pa.string()), ("mate_start", pa.int32()), ("tlen", pa.int32()), ("bases", pa.string()), ("quals", pa.list_(pa.int32())), ("tags", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = []
                for row in records(content.as_py()):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    files = spark.read.format("binaryFile").load(path).filter(F.col("path").endswith(".bam")).select("content")
    rows = files.mapInArrow(run, schema)
    span = F.aggregate("cigar", F.lit(0), lambda a, c: a + F.when(c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(0))
    return rows.withColumn("end", F.col("start") + span - 1).withColumn("read_group", F.col("tags")["RG"])


def _bin(start: int, end: int) -> int:
    """The smallest bin of the format's index that holds a closed interval from 0."""
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


def encoded(row: dict, place: dict[str, int]) -> bytes:
    """One read as a record of the format."""
    cigar = row["cigar"] or []
    bases, quals = row["bases"] or "", row["quals"]
    codes = np.array([CODES.get(c, 15) for c in bases.upper()] + [0] * (len(bases) % 2), np.uint8)
    name = row["name"].encode() + b"\0"
    start = (row["start"] or 0) - 1
    span = sum(c["len"] for c in cigar if c["op"] in "MDN=X")
    number = _bin(max(start, 0), max(start, 0) + max(span, 1) - 1) if start >= 0 else 4680
    head = struct.pack("<iiBBHHHiiii", place.get(row["contig"], -1), start, len(name), row["mapq"], number, len(cigar), row["flags"], len(bases), place.get(row["mate_contig"], -1), (row["mate_start"] or 0) - 1, row["tlen"] or 0)
    ops = b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in cigar)
    packed = (codes[0::2] << 4 | codes[1::2]).astype(np.uint8).tobytes() if len(codes) else b""
    told = bytes(quals[: len(bases)]) + b"\xff" * (len(bases) - len(quals)) if quals else b"\xff" * len(bases)
    tags = b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in sorted(dict(row["tags"] or {}).items()))
    body = head + name + ops + packed + told + tags
    return struct.pack("<i", len(body)) + body


def deflated(data: bytes) -> bytes:
    """A block of the format: a gzip member that tells its own size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(reads: DataFrame, path: str, sequences: list[tuple[str, int]], read_groups: list[str] = (), parts: int | None = None) -> None:
    """Shards in header order, each a whole file with the header; unmapped reads last.

    sequences: contigs and lengths, in order.  A shard's bytes are put together
    in its task, and written by a task through the folder's file system.
    """
    from ..operators.readsets import with_contig_index

    spark = reads.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("contig_idx").asc_nulls_last(), "start", "name", "flags"]
    columns = ["name", "flags", "contig", "start", "mapq", "cigar", "mate_contig", "mate_start", "tlen", "bases", "quals", "tags"]
    rows = with_contig_index(reads, [c for c, _ in sequences])
    rows = (rows.repartition(1) if n == 1 else rows.repartitionByRange(n, *order)).sortWithinPartitions(*order)
    place = {c: i for i, (c, _) in enumerate(sequences)}
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{size}\n" for c, size in sequences) + "".join(f"@RG\tID:{g}\tSM:{g}\n" for g in read_groups)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(sequences)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", size) for c, size in sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, held, any_row = [], bytearray(head), False
        for batch in batches:
            for row in batch.to_pylist():
                any_row = True
                held += encoded(row, place)
                while len(held) >= BLOCK:
                    out.append(deflated(bytes(held[:BLOCK])))
                    del held[:BLOCK]
        if any_row:
            out += [deflated(bytes(held)), LAST]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([b"".join(out)], pa.binary())], names=["shard", "content"])

    shards = rows.select(*columns).mapInArrow(run, "shard int, content binary")
    _write_files(shards, path)


def _write_files(shards: DataFrame, path: str) -> None:
    """One file for each row of (shard, content), by the path's file system as the executors' Python sees it."""
    top = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(top) if "://" in top or top.startswith("file:") else (fs.LocalFileSystem(), top)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # a task that is run again writes the same file again
                with system.open_output_stream(f"{folder}/part-{shard:05d}.bam") as file:
                    file.write(content.as_buffer())
            yield batch.select(["shard"])

    shards.mapInArrow(run, "shard int").write.format("noop").mode("overwrite").save()
