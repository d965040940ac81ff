"""Set-similarity join of documents on five-word shingles, exact at a Jaccard similarity of 0.75 or more.

1. Documents with equal shingle sets form a class (a 128-bit key of the sorted set); only classes go on.
2. A sketch of fixed size counts the documents of each shingle, over all documents; it orders shingles rare first. A
   set's prefix are its first n - ceil(0.75 n) + 1 shingles in that order and n / 16 more: similar sets share 1 + n / 16
   of them at least, so what shares fewer, by chance, goes before any pair is made.
3. Prefix entries travel as packed arrays; an entry whose shingle is in no other prefix stops there. Where one task
   alone has many entries of a shingle they bypass the grouping, so a shingle that a third of all documents have lands
   in no single task.
4. Classes that are left take as their block the least class they reach over three steps of shared lists. Blocks are
   dealt into buckets of bounded size, a large block into several, and each whole set travels to its bucket once. There
   candidates come from a prefix index, rare first within the bucket, pass the length, positional and suffix filters,
   and are verified on the whole sets. A class that is linked is not compared with its own component again, so a group
   of copies costs about its size times those that stay apart from it.
5. What buckets separate is compared afterwards: the parts of a large block with its first part, then classes that are
   still outside the block's main component with the other parts, then pairs of lists that hold several blocks. Only
   pairs of different components that were in no bucket together are compared, so no pair is verified twice, and
   nothing is capped: the components are exact.

A group of n differing near copies of which r stay outside its main component needs about n * r comparisons.

Defined cases: a null, empty or wordless text has the empty set, is linked with nothing and is its own component; a
text of fewer than five words is one shingle; equal ids are kept apart as rows; a null id is never a component's name
unless all ids of the component are null; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.closure import components
from .storage import discard, keep, partitions, quoted, small_batches
from .text import SLOT, mix, release, shingle_sets, sliced

#: Buckets of the sketch of document counts: 2**23, broadcast as a rank of one byte each.
SKETCH_BITS = 23
CHUNK = 1 << 18
#: Entries of one shingle in one task beyond which they bypass the grouping.
LOCAL_HOT = 64
#: A prefix is longer by 1 / MORE of its set than one common shingle would ask for; so many more have to be shared.
MORE = 16
#: Classes and bytes of sets of a bucket; a larger block is split.
MEMBERS = 1024
BUCKET_BYTES = 8 << 20
#: Up to this many ids (16 bytes each) are broadcast to take their rows out; beyond, the rows are shuffled.
BROADCAST_IDS = 1_000_000
#: Steps over shared lists that gather a block.
STEPS = 3
LEADS = 8
#: Most bits of the bitmap of documents whose sets are wanted (16 MB); it has 64 bits a document up to there.
BITMAP_BITS = 27
BITMAP_CHUNK = 1 << 18
#: Up to this many classes (64 bytes each) are broadcast to pick out or to name their sets; beyond, the sets are shuffled.
BROADCAST_CLASSES = 200_000


def set_key(s: np.ndarray) -> bytes:
    """A 128-bit key of a sorted set."""
    n = np.uint64(len(s))
    h = [mix(s * SLOT[50]).sum(keepdims=True, dtype=np.uint64) + n, mix(s ^ SLOT[51]).sum(keepdims=True, dtype=np.uint64) ^ n]
    return mix(np.concatenate(h) * SLOT[52:54]).tobytes()


def short(key: bytes) -> int:
    """The first half of a key, which stands for it in lists."""
    return int.from_bytes(key[:8], "little", signed=True)


def needed(a: int | np.ndarray, b: int | np.ndarray):
    """The least intersection of sets of sizes a and b with 100 |I| >= 75 |U|."""
    return -(-3 * (a + b) // 7)


def prefix_length(n: int | np.ndarray):
    return np.minimum(n, n + (-3 * n // 4) + 1 + n // MORE)


def _packed(counts: np.ndarray) -> bytes:
    small = counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)
    return bytes([small.itemsize]) + zlib.compress(small.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), np.uint8 if raw[0] == 1 else np.uint32)


SURVEYED = "doc_id long, n_shingles long, k long, key binary, chunk int, counts binary"


def _survey(batches):
    """A row for each document, and at a task's end its part of the sketch."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    seen: set[bytes] = set()
    for whole in batches:
        for batch in sliced(whole, "text"):
            sets = shingle_sets(batch.column("text"))
            keys = [set_key(s) for s in sets]
            fresh = []
            for s, k in zip(sets, keys):
                if k not in seen:
                    seen.add(k)
                    fresh.append(s)
            if fresh:
                np.add.at(counts, (np.concatenate(fresh) & mask).astype(np.int64), np.uint32(1))
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([short(k) for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "n_shingles", "k", "key", "chunk", "counts"],
            )
    if counts.any():
        parts = [(c, _packed(counts[c * CHUNK : (c + 1) * CHUNK])) for c in range(len(counts) // CHUNK)]
        m = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
            names=["doc_id", "n_shingles", "k", "key", "chunk", "counts"],
        )


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for raw in pdf["counts"]:
        total += _unpacked(raw)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [ranks(total).tobytes()]})


def ranks(counts: np.ndarray) -> np.ndarray:
    """Counts as ranks of one byte that keep their order, eight to a doubling."""
    return np.minimum(np.floor(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)


def prefix(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The 44-bit names of the first n - ceil(3 n / 4) + 1 + n // 16 shingles, rare first. Of two similar sets each has
    the least 1 + n // 16 (for the smaller n) of their common shingles in its prefix."""
    n = len(s)
    p = int(prefix_length(n))
    order = (rank[(s & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20))
    if p < n:
        order = np.partition(order, p - 1)[:p]
    return order & np.uint64((1 << 44) - 1)


#: need: how many entries a class has to share with others to have a partner at all; 0 marks a list that bypassed.
ENTRY = np.dtype([("name", "<u4"), ("key", "<i8"), ("need", "u1")])


def _entries(shared, ranges: int):
    """Packed prefix entries by range of names; a list that is long in this task alone goes to a range of its own
    choice, marked as shared, and leaves one entry and a mark behind."""

    def pack(held):
        name = np.concatenate([h[0] for h in held])
        rows = np.empty(len(name), ENTRY)
        rows["key"], rows["need"] = (np.repeat(np.array([h[i] for h in held]), [len(h[0]) for h in held]) for i in (1, 2))
        rows["name"] = (name >> np.uint64(12)).astype(np.uint32)
        where = (name % np.uint64(ranges)).astype(np.int64)
        list_of = (where.astype(np.uint64) << np.uint64(32)) | rows["name"]
        by = np.argsort(list_of, kind="stable")
        rows, where, list_of = rows[by], where[by], list_of[by]
        first = np.flatnonzero(np.append(True, list_of[1:] != list_of[:-1]))
        length = np.diff(np.append(first, len(rows)))
        hot = length > LOCAL_HOT
        stays = np.ones(len(rows), bool)
        out = []
        for a, m in zip(first[hot].tolist(), length[hot].tolist()):
            spread = int(mix(np.array([list_of[a] + np.uint64(int(rows["key"][a]) & 0xFFFFFFFF)], np.uint64))[0] % np.uint64(ranges))
            out.append((spread, int(where[a]), True, rows[a + 1 : a + m].tobytes()))
            stays[a + 1 : a + m] = False
        marks = rows[first[hot]]
        marks["need"] = 0
        rows, where = np.concatenate([rows[stays], marks]), np.concatenate([where[stays], where[first[hot]]])
        by = np.argsort(where, kind="stable")
        rows, where = rows[by], where[by]
        cut = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(rows)).tolist()):
            out.append((int(where[a]), int(where[a]), False, rows[a:b].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.bool_()), pa.array([o[3] for o in out], pa.binary())],
            names=["to", "range", "direct", "rows"],
        )

    def run(batches):
        rank = np.frombuffer(shared.value, np.uint8)
        seen: set[bytes] = set()
        held, n = [], 0
        for whole in batches:
            for batch in sliced(whole, "text"):
                for s in shingle_sets(batch.column("text")):
                    if not len(s) or (k := set_key(s)) in seen:
                        continue
                    seen.add(k)
                    p = prefix(s, rank)
                    held.append((p, short(k), min(1 + -(-3 * len(s) // 4) // MORE, 255)))
                    n += len(p)
                if n > 300_000:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return run


LISTS = "list long, k long, lead long, need int"


def _shared_lists(table: pa.Table) -> pa.Table:
    """Entries of the lists with two different keys or more, in one range, each with a name (lead) that all entries of
    its list have: the least k; of a list of which some bypassed, the list's own number. What bypassed is passed on."""
    out, plain = [], []
    for where, direct, raw in zip(table["range"].to_pylist(), table["direct"].to_pylist(), table["rows"].to_pylist()):
        rows = np.frombuffer(raw, ENTRY)
        if direct:
            number = (np.int64(where) << np.int64(32)) | rows["name"].astype(np.int64)
            out.append((number, rows["key"], number, rows["need"].astype(np.int32)))
        else:
            plain.append((where, rows))
    if plain:
        rows = np.concatenate([r for _, r in plain])
        rows = rows[np.lexsort((rows["need"], rows["key"], rows["name"]))]
        new_list, new_key = rows["name"][1:] != rows["name"][:-1], rows["key"][1:] != rows["key"][:-1]
        rows = rows[np.append(True, new_list | new_key | (rows["need"][1:] != rows["need"][:-1]))]  # copies in several tasks
        at = np.flatnonzero(np.append(True, rows["name"][1:] != rows["name"][:-1]))
        length = np.diff(np.append(at, len(rows)))
        number = (np.int64(plain[0][0]) << np.int64(32)) | rows["name"].astype(np.int64)
        marked = np.logical_or.reduceat(rows["need"] == 0, at)
        lead = np.where(np.repeat(marked, length), number, np.repeat(rows["key"][at], length))
        stays = np.repeat(length > 1, length) & (rows["need"] > 0)
        out.append((number[stays], rows["key"][stays], lead[stays], rows["need"][stays].astype(np.int32)))
    kinds = (np.int64, np.int64, np.int64, np.int32)
    return pa.table({c: np.concatenate([o[i] for o in out]) if out else np.zeros(0, kinds[i]) for i, c in enumerate(("list", "k", "lead", "need"))})


def _blocks(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, block): the least k that a class reaches over shared lists in STEPS steps, for the classes that share enough
    entries to have a partner; and (k, leads), the leads of each. Lists of one lead count as one. Steps go over a class's
    LEADS least leads: what they miss is only compared later (:func:`_blocks_joined` looks at all lists)."""
    count = lists.groupBy("k", "lead").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    rich = count.groupBy("k").agg(F.sum("n").alias("n"), F.first("need").alias("need"), F.sort_array(F.collect_set("lead")).alias("leads"))
    reach = keep(rich.where("n >= need").select("k", "leads"), "reach")
    edges = reach.select("k", F.explode(F.slice("leads", 1, LEADS)).alias("lead"))
    block = None
    for _ in range(STEPS):
        of = edges.withColumn("block", F.col("k")) if block is None else edges.join(block, "k")
        least = keep(of.groupBy("lead").agg(F.min("block").alias("block")), "least")  # as a table, so that a hot lead can be split below
        discard(block)
        block = keep(edges.join(least, "lead").groupBy("k").agg(F.min("block").alias("block")), "blocks")
        discard(least)
    return block, reach


def _marks(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk of a bitmap."""
    bits = np.zeros(BITMAP_CHUNK, bool)
    bits[(pdf["slot"] % BITMAP_CHUNK).to_numpy()] = True
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _bitmap(hashes: DataFrame) -> bytes:
    """A bitmap of hashes ``h``, with 64 bits for each up to 2**BITMAP_BITS."""
    slots = 1 << min(BITMAP_BITS, max(18, (64 * hashes.count()).bit_length()))
    slot = hashes.select(F.pmod("h", F.lit(slots)).alias("slot")).distinct().withColumn("chunk", F.floor(F.col("slot") / BITMAP_CHUNK).cast("int"))
    out = bytearray(slots // 8)
    for r in slot.groupBy("chunk").applyInPandas(_marks, "chunk int, bits binary").toLocalIterator():  # 32 KB each, 512 at most
        out[r.chunk * BITMAP_CHUNK // 8 : (r.chunk + 1) * BITMAP_CHUNK // 8] = r.bits
    return bytes(out)


def _wanted(shared):
    """Whole sets of the documents that the bitmap marks, one of each key a task. Only these are read for words."""

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        seen: set[bytes] = set()
        for whole in batches:
            slot = whole.column("slot").to_numpy()
            marked = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            for batch in sliced(whole.filter(pa.array(marked.astype(bool))), "text"):
                keys, sets = [], []
                for s in shingle_sets(batch.column("text")):
                    k = set_key(s)
                    if len(s) and k not in seen:
                        seen.add(k)
                        keys.append(k)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    return run


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def indexed(sets: list[np.ndarray]) -> SimpleNamespace:
    """Sets as numbers that ascend from the rarest shingle here, with an index of their prefixes."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    value, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, count))] = np.arange(len(value))
    row = np.repeat(np.arange(m), size)
    ids = rank[number]
    ids = ids[np.lexsort((ids, row))]
    start = np.cumsum(size) - size
    p = prefix_length(size)
    inside = _ranges(start, p)
    by = np.argsort(ids[inside], kind="stable")
    index = row[inside][by]
    index_start = np.searchsorted(ids[inside][by], np.arange(len(value) + 1))
    bins = np.bincount(row * 32 + (flat >> np.uint64(59)).astype(np.int64), minlength=m * 32).reshape(m, 32).astype(np.int32)
    return SimpleNamespace(m=m, size=size, ids=ids, start=start, p=p, last=ids[start + p - 1], index=index, index_start=index_start, bins=bins, mark=np.zeros(len(value), bool))


def partners(x: SimpleNamespace, q: int, open_: np.ndarray) -> np.ndarray:
    """The rows of ``open_`` whose sets are similar to that of row q: prefix index, length filter, positional filter (all
    that follows the prefix that ends first), suffix filter (32 equal parts of the hash space), whole sets."""
    own = x.ids[x.start[q] : x.start[q] + x.size[q]]
    at = own[: x.p[q]]
    shares = np.bincount(x.index[_ranges(x.index_start[at], x.index_start[at + 1] - x.index_start[at])], minlength=x.m)
    c = np.flatnonzero((shares > 0) & open_)
    n, s = x.size[q], x.size[c]
    least, smaller = needed(n, s), np.minimum(n, s)
    rest = np.where(x.last[c] <= x.last[q], s - x.p[c], n - x.p[q])
    ok = (smaller >= least) & (shares[c] > smaller // MORE) & (shares[c] + rest >= least)
    c, least = c[ok], least[ok]
    ok = np.minimum(x.bins[c], x.bins[q]).sum(axis=1) >= least
    c, least = c[ok], least[ok]
    if not len(c):
        return c
    x.mark[own] = True
    hits = x.mark[x.ids[_ranges(x.start[c], x.size[c])]].astype(np.int64)
    x.mark[own] = False
    return c[np.add.reduceat(hits, np.cumsum(x.size[c]) - x.size[c]) >= least]


def grouped(sets: list[np.ndarray]) -> np.ndarray:
    """The first row of each row's component. Each row looks once for partners among those that nothing reached yet."""
    x = indexed(sets)
    out, free = np.full(x.m, -1), np.ones(x.m, bool)
    for seed in range(x.m):
        if not free[seed]:
            continue
        free[seed], out[seed], queue = False, seed, [seed]
        while queue:
            got = partners(x, queue.pop(), free)
            free[got], out[got] = False, seed
            queue += got.tolist()
    return out


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column.to_pylist()]


LABELLED = "key binary, k long, size long, block long, parts int, part int, bucket long, label binary"


def _together(table: pa.Table) -> pa.Table:
    """Classes of one bucket, each with the least key of its component there."""
    keys = np.array(table["key"].to_pylist(), object)
    by = np.argsort(keys, kind="stable")
    by = by[np.append(True, keys[by][1:] != keys[by][:-1])]  # a class of a document that repeats
    table = table.take(pa.array(by))
    out = table.drop_columns(["set"]).append_column("label", pa.array(keys[by][grouped(_sets(table["set"]))].tolist(), pa.binary()))
    release()
    return out


def _across(table: pa.Table) -> pa.Table:
    """Links (a, b) of labels between the two sides of a group, for pairs that differ in label and bucket. Where both
    are outside their main component, the pair is compared from its smaller key."""
    query = np.array(table["query"].to_pylist(), bool)
    if query.all() or not query.any():
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    name, label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
    _, order = np.unique(np.array(table["key"].to_pylist(), object), return_inverse=True)
    bucket, outside = table["bucket"].to_numpy(), np.array(table["outside"].to_pylist(), bool)
    x, root, links = indexed(_sets(table["set"])), np.arange(len(name)), []
    for q in np.flatnonzero(query).tolist():
        apart = ~query & (root[label] != root[label[q]]) & (bucket != bucket[q])
        if outside[q]:
            apart &= ~(outside & (order < order[q]))
        for r in np.unique(root[label[partners(x, q, apart)]]).tolist():
            links.append((name[root[label[q]]], name[r]))
            root[root == r] = root[label[q]]
    release()
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(.., label)`` with the labels that links (a, b) connect made one."""
    links = keep(links, "links")
    out = labels
    if not links.isEmpty():
        names = components(links)
        out = keep(labels.join(names.withColumnRenamed("node", "label"), "label", "left").select(*[c for c in labels.columns if c != "label"], F.coalesce("component", "label").alias("label")), "labels")
        discard(labels)
    discard(links)
    return out


SIDES = ["block", "t", "query", "key", "label", "bucket", "outside", "set"]


def _parts_joined(labels: DataFrame, sets: DataFrame, members: int) -> DataFrame:
    """Links between the parts of large blocks: first all parts with part 0, then what is outside the block's main
    component with the other parts. Here part 0 stands for all that a part of its block was compared with."""
    whole = lambda df: df.join(sets.where("parts > 1").select("key", "set"), "key")
    large = whole(labels.where("parts > 1")).withColumn("outside", F.lit(False))
    first = large.where("part = 0").withColumn("t", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).withColumn("query", F.lit(True))
    rest = large.where("part > 0").withColumn("t", F.col("part")).withColumn("query", F.lit(False))
    labels = _merged(labels, first.select(SIDES).unionByName(rest.select(SIDES)).groupBy("block", "t").applyInArrow(_across, "a binary, b binary"))
    sizes = labels.where("parts > 1").groupBy("block", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("left"))
    main = main.select("block", "main", F.ceil(F.col("left") / members).cast("int").alias("groups")).where("groups > 0")
    large = whole(labels.where("part > 0").join(main, "block")).withColumn("outside", F.col("label") != F.col("main"))
    deal = F.pmod(F.xxhash64("key", F.lit(2)), F.col("groups")).cast("int")
    queries = large.where("outside").withColumn("g", deal).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).withColumn("query", F.lit(True))
    others = large.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("t", F.col("part")).withColumn("query", F.lit(False))
    sides = queries.select("g", *SIDES).unionByName(others.select("g", *SIDES))
    return _merged(labels, sides.groupBy("block", "t", "g").applyInArrow(_across, "a binary, b binary"))


def _verify(batches):
    for batch in batches:
        ok = []
        for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            pair = [np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]
            ok.append(len(partners(indexed(pair), 0, np.array([False, True]))) == 1)
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])


def _sent(few: DataFrame, most: int = BROADCAST_CLASSES) -> DataFrame:
    """Broadcast if they are few."""
    return F.broadcast(few) if few.count() <= most else few


def _blocks_joined(labels: DataFrame, sets: DataFrame, lists: DataFrame, reach: DataFrame) -> DataFrame:
    """Links between classes of different blocks that share a list."""
    info = labels.select("k", "key", "size", "block", "bucket", "label")
    several = reach.join(info.select("k", "block"), "k").select("block", F.explode("leads").alias("lead")).groupBy("lead").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo <> hi").select("lead")
    several = keep(several, "several")
    if several.isEmpty():
        discard(several)
        return labels
    told = keep(lists.join(several, "lead").select("list", "k").distinct().join(info, "k"), "told")
    apart = (F.col("x.list") == F.col("y.list")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.block") != F.col("y.block")) & (F.col("x.bucket") != F.col("y.bucket")) & (F.col("x.label") != F.col("y.label"))
    size = 4 * F.least("x.size", "y.size") >= 3 * F.greatest("x.size", "y.size")
    pairs = told.alias("x").join(told.alias("y"), apart & size).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()
    pairs = keep(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = keep(sets.join(_sent(named), "key", "left_semi").select("key", "set"), "some")
    side = lambda k: sets.select(F.col("key").alias(k), F.col("set").alias(f"s{k}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"), "sa", "sb").mapInArrow(_verify, "a binary, b binary")
    out = _merged(labels, links)
    for df in (several, told, pairs, sets):
        discard(df)
    return out


def _dealt(left: DataFrame, members: int, bucket_bytes: int) -> DataFrame:
    """Classes with their blocks' number of parts, their own part and bucket."""
    totals = left.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    buckets = max(1, -(-totals.n // members), -(-8 * totals.s // bucket_bytes))
    load = left.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / members, F.sum("size") * 8 / bucket_bytes)).cast("int").alias("parts"))
    out = left.join(load, "block").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int"))
    return out.withColumn("bucket", F.pmod(F.xxhash64("block", "part"), F.lit(buckets)))


def join(docs: DataFrame, members: int = MEMBERS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_shingles, key, label, component_id) for every row of ``docs(doc_id, text)``. Equal labels are one
    component; component_id names it by its smallest doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    survey = keep(rows.mapInArrow(_survey, SURVEYED), "survey")
    parts = survey.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(_add_up, "chunk int, counts binary").collect()
    table = survey.where("chunk is null").select("doc_id", "n_shingles", "k", "key")
    if not parts:
        return table.select("doc_id", "n_shingles", "key", F.col("key").alias("label"), F.col("doc_id").alias("component_id"))
    sketch = spark.sparkContext.broadcast(b"".join(bytes(r.counts) for r in sorted(parts, key=lambda r: r.chunk)))  # 8 MB
    entries = rows.mapInArrow(_entries(sketch, 4 * partitions(spark)), "to int, range int, direct boolean, rows binary")
    lists = keep(entries.groupBy("to").applyInArrow(_shared_lists, LISTS), "lists")
    blocks, reach = _blocks(lists)
    worded = table.where("n_shingles > 0")
    classes = keep(worded.groupBy("k", "key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")), "classes")
    left = keep(_dealt(classes.join(blocks, "k"), members, bucket_bytes), "left")
    bitmap = spark.sparkContext.broadcast(_bitmap(left.select(F.xxhash64("rep").alias("h"))))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(bitmap.value)))
    marked = rows.select("text", slot.alias("slot")).mapInArrow(_wanted(bitmap), "key binary, set binary")
    sets = keep(marked.join(_sent(left.select("key", "k", "size", "block", "parts", "part", "bucket")), "key"), "sets")
    labels = keep(sets.groupBy("bucket").applyInArrow(_together, LABELLED), "labels")
    if not labels.where("parts > 1").isEmpty():
        labels = _parts_joined(labels, sets, members)
    labels = _blocks_joined(labels, sets, lists, reach)
    near = left.select("key", "rep").join(labels.select("key", "label"), "key")
    least = keep(near.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    named = classes.select("key", "rep").join(near.join(least, "label").select("key", "label", "least"), "key", "left")
    named = keep(named.select("key", F.coalesce("label", "key").alias("label"), F.coalesce("least", "rep").alias("component_id")), "named")
    for df in (lists, reach, blocks, classes, left, sets, labels, least):
        discard(df)
    sketch.unpersist()
    bitmap.unpersist()
    empty = table.where("n_shingles = 0").select("doc_id", "n_shingles", "key", F.col("key").alias("label"), F.col("doc_id").alias("component_id"))
    return worded.join(named, "key").select("doc_id", "n_shingles", "key", "label", "component_id").unionByName(empty)


def _keyed(batches):
    """Rows with the key of their text's set; null where that is empty."""
    for whole in batches:
        for batch in sliced(whole, "text"):
            keys = [set_key(s) if len(s) else None for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(keys, pa.binary())], names=["row", "key"])


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each group of similar documents, that with the smallest id; same columns. Rows that share an id are
    told apart by their texts: of those of one group that with the smallest key stays, and of equal rows one. Rows
    without an id or without words all stay."""
    found = keep(join(docs).where("n_shingles > 0 and doc_id is not null").select("doc_id", "key", "label", "component_id"), "found")
    gone = _sent(keep(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone"), BROADCAST_IDS)
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    columns = quoted(docs.columns)
    if twice.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    once = docs.join(twice, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*columns)
    rows = docs.join(twice, "doc_id", "left_semi").select(F.struct(*columns).alias("row"), "text")
    rows = rows.mapInArrow(_keyed, StructType([*rows.select("row").schema.fields]).add("key", "binary")).withColumn("id", F.col("row.doc_id").cast("long"))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").alias("id"), "key")).alias("s")).select("s.*")
    kept = rows.where("key is not null").join(first, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return once.unionByName(kept.unionByName(rows.where("key is null")).select("row.*"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity components of ``documents``."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM g),
sh AS (SELECT doc_id, unnest(s) AS h FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON reach.other = u.a)
SELECT n.doc_id, n.n_shingles, min(other) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n.n_shingles
"""
