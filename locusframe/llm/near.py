"""N-gram Jaccard join: exact links between near-duplicate texts, and their groups.

A text's set holds hashes of its 5-word shingles.  Texts with equal sets are
one node.  With a fixed order of all shingles, two sets with a Jaccard
coefficient of 3/4 share one among their first n - ceil(3n / 4) + 1, whatever
the order; frequent shingles, as a sample of texts shows, come last in it.

1. A task sends those first shingles, sorted and packed, to the buckets of
   their hashes.  One that is known as frequent goes to a bucket by hash and
   node, so that no bucket gets all of its texts.
2. A bucket finds shingles that several nodes have.  Within a shingle, nodes
   are tiled by bands of set sizes (a linked pair lies in one band or in two
   that touch).  The first node of each tile is paired with the others.
3. Pairs whose sizes differ too much go.  Each node has a hashed bitmap; bits
   that only one of two bitmaps has bound the overlap from above, and most
   other pairs go.  For what is left the two sorted arrays are intersected.
4. Groups are formed from the links.  In turns, as long as each at least halves
   what is apart, a node of each group of a shingle is paired with one of the
   shingle's largest group.  Then the same is done for *all* pairs of nodes that
   share a shingle but are still in different groups, so no link between groups
   is lost, while no pairs within a group of copies are listed.  A shingle at
   places i and j of the order doesn't list a pair if min(n - i, m - j) is too
   small an overlap: the first shingle that a linked pair shares lists it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import COMBINE, LOWER, SPACE, buckets, discard, exchange, groups, mixed, pack, prepare, texts, trimmed, unpack, windows, word_hashes, written
from .components import components

SIZE = 5
BLOCK = 6 << 20
#: Texts for the order of shingles: one in RATE, SAMPLE at least. FREQUENT: in so many of them. At most LISTED shingles are told to the tasks.
RATE, SAMPLE, FREQUENT, LISTED = 64, 4000, 3, 500_000
#: So many members of a block go to one bucket, which the block chooses.
DEALT = 64
#: Places in a set are told in so many steps, rounded down.
STEPS = 1000
U = np.uint64
ENTRIES, MEMBERS = 0, 1
SENT = "pid int, kind int, data binary, doc_id long, n long, node long, bits binary"


def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text."""
    _, _, hashes, bounds = word_hashes(data, offsets, SPACE, LOWER)
    found, to = windows(hashes, bounds, SIZE)
    out = []
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= SIZE:
            out.append(np.unique(found[to[i] : to[i + 1]]))
        elif b > a:
            out.append(mixed((hashes[a:b] * COMBINE[SIZE : SIZE + b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(own: np.ndarray) -> int:
    """A fingerprint of a set as a signed number."""
    return int(mixed(np.array([(mixed(own ^ U(0x5BD1E995)) * U(len(own) * 2 + 1)).sum()], np.uint64)).view(np.int64)[0])


def bitmap(own: np.ndarray) -> bytes:
    """A hashed bitmap, wider for larger sets: 512 bits up to 512 elements, then doubling up to 16,384."""
    width = 512
    while width < len(own) and width < 16384:
        width *= 2
    bits = np.zeros(width, bool)
    bits[(own >> U(7)) & U(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(a: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of a smaller width: halves are joined by or."""
    while len(a) > size:
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    return a


def overlap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """No fewer than the common elements: a bit that only one bitmap has stands for an element that only that set has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = folded(x, size), folded(y, size)
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def linked(overlap: int, n: int, m: int) -> bool:
    return 4 * overlap >= 3 * (n + m - overlap)


def first_shingles(own: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's first n - ceil(3n / 4) + 1 in the common order, and which of them are frequent."""
    p = len(own) - (3 * len(own) + 3) // 4 + 1
    if not len(frequent):
        return own[:p], np.zeros(p, bool)
    often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    rare = own[~often][:p]
    late = own[often][: p - len(rare)]
    return np.concatenate([rare, late]), np.arange(p) >= len(rare)


def _send(n: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = frequent.value
        for block in groups(batches, BLOCK):
            members, nodes, sizes, keys, owners, hot, places = [], {}, [], [], [], [], []
            for batch in block:
                for doc_id, own in zip(batch.column(0).to_pylist(), sets_of(*texts(batch)), strict=True):
                    if not len(own) or doc_id is None:
                        members.append((doc_id, len(own), None, None))
                        continue
                    node = node_of(own)
                    members.append((doc_id, len(own), node, bitmap(own) if node not in nodes else None))
                    if node not in nodes:
                        nodes[node] = len(nodes)
                        sizes.append(len(own))
                        first, late = first_shingles(own, listed)
                        keys.append(first), hot.append(late)
                        places.append((np.arange(len(first)) * STEPS // len(own)).astype(np.uint8))
                        owners.append(np.full(len(first), nodes[node], np.uint32))
            rows = []
            if keys:
                key, owner, late, place = (np.concatenate(x) for x in (keys, owners, hot, places))
                ids, size = np.array(list(nodes), np.int64), np.array(sizes, np.uint32)
                spread = np.where(late, mixed(key + mixed(ids.view(np.uint64))[owner]), key)
                pid = ((spread >> U(32)) * U(n)) >> U(32)
                order = np.lexsort((key, pid))
                key, owner, late, place, pid = key[order], owner[order], late[order], place[order], pid[order]
                edges = np.searchsorted(pid, np.arange(n + 1)).tolist()
                for k in range(n):
                    own = slice(edges[k], edges[k + 1])
                    if own.stop > own.start:
                        used, local = np.unique(owner[own], return_inverse=True)
                        local = local.astype(np.uint16 if len(used) < 65536 else np.uint32)
                        rows.append((k, ENTRIES, zstandard.ZstdCompressor(1).compress(pack(np.diff(key[own], prepend=U(0)), local, late[own], place[own], ids[used], size[used])), None, None, None, None))
            spots = mixed(np.arange(0, len(members), DEALT).astype(np.uint64) + U((members[0][0] or 0) & (2**62 - 1))) % U(n)
            rows += [(int(spots[i // DEALT]), MEMBERS, None, *m) for i, m in enumerate(members)]
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 2000], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["pid", "kind", "data", "doc_id", "n", "node", "bits"])

    return run


SHARED, PAIRS, HEADS = 2, 3, 4
FOUND = "kind int, doc_id long, n long, node long, bits binary, key long, other long"


def _found(kind: int, count: int, **columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "bits": pa.binary(), "key": pa.int64(), "other": pa.int64()}
    columns["kind"] = np.full(count, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(count, t) for k, t in kinds.items()], names=list(kinds))


def band(n: np.ndarray) -> np.ndarray:
    """Sizes in one band differ by a factor of at most 4/3."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3)).astype(np.int64)


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = []
    for batch in batches:
        member = batch.filter(pc.equal(batch.column(1), MEMBERS))
        if member.num_rows:
            nulls = pa.nulls(member.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([member.column(1), *member.columns[3:7], nulls, nulls], names=[x.split()[0] for x in FOUND.split(", ")])
        for data in batch.filter(pc.equal(batch.column(1), ENTRIES)).column(2).to_pylist():
            steps, local, late, place, ids, sizes = unpack(zstandard.ZstdDecompressor().decompress(data))
            parts.append((np.cumsum(steps, dtype=np.uint64).view(np.int64), ids[local], sizes[local], late.astype(bool), place))
    if not parts:
        return
    key, node, size, late, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((node, key))
    key, node, size, late, place = key[order], node[order], size[order], late[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size, late, place = key[new], node[new], size[new].astype(np.int64), late[new], place[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(starts, append=len(key))
    # shingles with the same nodes tell the same: one of them is kept, unless other buckets have nodes of it too
    tag = np.add.reduceat(mixed(node.view(np.uint64) ^ U(0x9E3779B97F4A7C15)), starts)
    once = np.zeros(len(starts), bool)
    _, one, alike = np.unique(tag, return_index=True, return_inverse=True)
    once[one] = True
    # what is kept has each node's first place in any of them
    alike = np.repeat(alike, counts)
    order = np.lexsort((node, alike))
    runs = np.flatnonzero(np.concatenate([[True], (alike[order][1:] != alike[order][:-1]) | (node[order][1:] != node[order][:-1])]))
    place[order] = np.repeat(np.minimum.reduceat(place[order], runs), np.diff(runs, append=len(order)))
    kept = np.repeat(((counts > 1) & once) | late[starts], counts)
    key, node, size, late, place = key[kept], node[kept], size[kept], late[kept], place[kept]
    if not len(key):
        return
    for at in range(0, len(key), 100_000):
        own = slice(at, at + 100_000)
        yield _found(SHARED, len(key[own]), key=key[own], node=node[own], n=size[own], other=place[own].astype(np.int64) * size[own] // STEPS)
    tile = band(size)
    order = np.lexsort((node, tile, key))
    key, node, tile, late = key[order], node[order], tile[order], late[order]
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    at = np.flatnonzero(head)
    first = node[at][np.cumsum(head) - 1]
    pairs = [np.stack([first[~head], node[~head]])]
    touch = np.flatnonzero((key[at][1:] == key[at][:-1]) & (tile[at][1:] == tile[at][:-1] + 1))
    pairs.append(np.stack([node[at][touch], node[at][touch + 1]]))
    pairs = np.unique(np.sort(np.concatenate(pairs, 1), 0), axis=1)
    for k in range(0, pairs.shape[1], 100_000):
        a, b = pairs[:, k : k + 100_000]
        yield _found(PAIRS, len(a), node=a, other=b)
    hot = at[late[at]]
    if len(hot):
        yield _found(HEADS, len(hot), key=key[hot], n=tile[hot], node=node[hot])


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of frequent shingles: at most LISTED. They only decide the order, not which links are found."""
    n = rows.count()
    share = max(1 / RATE, min(1.0, SAMPLE / max(n, 1)))
    some = rows.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["text"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 4 << 20):
            found = np.concatenate([x for batch in block for x in sets_of(*texts(batch))])
            value, count = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["key", "c"])

    often = some.select("doc_id", "text").mapInArrow(trimmed(every), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT)
    listed = often.orderBy(F.desc("c"), "key").limit(LISTED).select("key").toArrow().column(0).to_numpy()
    return np.sort(listed.view(np.uint64))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, n, x, b, m, y = (batch.column(k).to_pylist() for k in ("a", "n", "x", "b", "m", "y"))
        keep = [linked(overlap_bound(p, q, i, j), i, j) for p, q, i, j in zip(x, y, n, m, strict=True)]
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = (None, None)
    for batch in batches:
        keep = []
        for x, y, b in zip(batch.column("s"), batch.column("t"), batch.column("b").to_pylist(), strict=True):
            if last[0] != b:
                last = b, _one_set(y.as_py())
            p, q = _one_set(x.as_py()), last[1]
            keep.append(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["u", "v"])


def _one_set(text: bytes) -> np.ndarray:
    return sets_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def verified(pairs: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Links (u, v) among pairs (a, b) of nodes. nodes: node, n, bits. sources: node, text."""
    one = nodes.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    sized = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").filter("4 * n >= 3 * m and 4 * m >= 3 * n")
    left = written(sized.select("a", "n", "x", "b", "m", "y").mapInArrow(trimmed(_bounded), "a long, b long"), "pairs")
    s, t = (sources.select(F.col("node").alias(k), F.col("text").alias(x)) for k, x in (("a", "s"), ("b", "t")))
    return left.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(trimmed(_intersected), "u long, v long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of the group) for every row of docs.

    docs: doc_id and text; more columns are ignored.  Words are separated by
    space and the characters 9 to 13; A to Z count as a to z.  Null, empty and
    blank texts have no shingle and are their own group.  Rows with a null
    doc_id are counted but linked with nothing (component_id null); repeated
    rows each give a row.  Hashes have 64 bits.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = buckets(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    listed = spark.sparkContext.broadcast(frequent_shingles(rows))
    found = written(exchange(rows.mapInArrow(trimmed(_send(n, listed)), SENT), n).mapInArrow(trimmed(_tile), FOUND), "tiles")
    members = found.filter(F.col("kind") == MEMBERS).select("doc_id", "n", "node", "bits")
    shared = found.filter(F.col("kind") == SHARED).select("key", "node", "n", F.col("other").alias("place"))
    nodes = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("bits").alias("bits"))
    nodes = written(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "nodes")
    # texts of nodes that share a shingle with another: a row of the smallest doc_id with that set
    wanted = nodes.select("node", "doc_id")
    sources = written(rows.join(wanted, "doc_id").mapInArrow(trimmed(_same_set), "node long, text binary").dropDuplicates(["node"]), "texts")
    heads = found.filter(F.col("kind") == HEADS).select("key", F.col("n").alias("tile"), "node")
    least = heads.groupBy("key", "tile").agg(F.min("node").alias("first"))
    far = heads.join(least, ["key", "tile"]).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = found.filter(F.col("kind") == PAIRS).select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    done = written(pairs.distinct(), "done")
    group = components(written(verified(done, nodes, sources), "links"))
    placed, apart = _placed(shared, group)
    turn = 0
    while apart:
        tested = written(_to_hubs(placed, turn).join(done, ["a", "b"], "left_anti"), "hubs")
        done = done.unionByName(tested)
        group = components(_edges(group).unionByName(written(verified(tested, nodes, sources), "links")))
        before, turn = apart, turn + 1
        discard(placed)
        placed, apart = _placed(shared, group)
        if 2 * apart > before:
            break
    # all other pairs that share a shingle and are in different groups
    right = placed.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("component").alias("component2"))
    across = placed.join(right, "key").filter("component < component2 and 4 * n >= 3 * n2 and 4 * n2 >= 3 * n and 7 * least(n - place, n2 - place2) >= 3 * (n + n2)").select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    rest = verified(across.join(done, ["a", "b"], "left_anti"), nodes, sources)
    group = components(_edges(group).unionByName(rest))
    return _named(members, group)


#: A key's rows are dealt to so many tasks in the last joins: a third of all rows may be copies of one text, or of one group.
SALT = 64


def _dealt(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """A left join whose left rows of one key are dealt by a hash of ``by``; right, which has a row for each key, is repeated."""
    some = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)))
    every = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return some.join(every, [key, "salt"], "left").drop("salt")


def _named(members: DataFrame, group: DataFrame) -> DataFrame:
    """Each row with the smallest doc_id of its group. Only nodes of several documents or in a group with others are looked up."""
    nodes = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    placed = nodes.join(group, "node", "left")
    best = placed.withColumn("component", F.coalesce("component", "node")).groupBy("component").agg(F.min("least").alias("best"), F.sum("c").alias("of"), F.count("*").alias("parts")).filter("of > 1")
    several = _dealt(placed.withColumn("component", F.coalesce("component", "node")), best.filter("parts > 1").select("component", "best"), "component", "node").filter("best is not null or c > 1")
    known = several.select("node", F.coalesce("best", "least").alias("component_id"))
    named = _dealt(members.select("doc_id", F.col("n").alias("n_shingles"), "node"), known, "node", "doc_id")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _edges(group: DataFrame) -> DataFrame:
    return group.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _placed(shared: DataFrame, group: DataFrame) -> tuple[DataFrame, int]:
    """Nodes by shingle, with their groups, of shingles that more than one group has; and how many (shingle, group) there are."""
    placed = shared.join(group, "node", "left").select("key", "node", "n", "place", F.coalesce("component", "node").alias("component"))
    every = written(placed, "placed")
    open_keys = every.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    placed = written(every.join(open_keys, "key", "left_semi"), "open")
    discard(every)
    return placed, placed.select("key", "component").distinct().count()


def _to_hubs(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): within a shingle and band of sizes, a node of the largest group with one of each other group.

    In the first turn they are nodes that have the shingle early: few of their
    shingles are rarer, so they resemble more of the others.  Later they depend
    on the shingle and the turn, so a group meets many hubs.  There are at most
    as many pairs as (shingle, band, group).
    """
    own = F.floor(F.lit(STEPS) * F.col("place") / F.col("n")) if turn == 0 else F.lit(0)
    chance = F.struct(own, F.xxhash64("key", "node", F.lit(turn)))
    tile = F.floor(F.log("n") / F.log(F.lit(4 / 3)))
    one = placed.withColumn("tile", tile).groupBy("key", "tile", "component").agg(F.min_by("node", chance).alias("node"), F.count("*").alias("size"))
    one = written(one, "one")
    hub = one.groupBy("key", "tile").agg(F.max_by("node", F.struct("size", "component")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("key", "tile", "hub")
    return one.join(hub, ["key", "tile"]).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts whose set is the node's: rows of one doc_id may have different texts."""
    for batch in batches:
        keep = [bool(len(own)) and node_of(own) == node for own, node in zip(sets_of(*texts(batch)), batch.column("node").to_pylist(), strict=True)]
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("node"), out.column("text")], names=["node", "text"])


SQL = """
with recursive d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
s as (select rid, doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end g from d),
e as (select rid, len(g) n, unnest(g) g from s),
c as (select a.rid x, b.rid y, a.n, b.n m, count(*) o from e a join e b on a.g = b.g and a.rid <> b.rid and 4 * a.n >= 3 * b.n and 4 * b.n >= 3 * a.n group by all),
l as (select x, y from c where 100 * o >= 75 * (n + m - o)),
r(rid, k) as (select rid, rid from s union select r.rid, l.y from r join l on r.k = l.x)
select s.doc_id, len(s.g)::bigint n_shingles, min(t.doc_id) component_id from s join r using (rid) join s t on t.rid = r.k group by s.rid, s.doc_id, s.g
"""
