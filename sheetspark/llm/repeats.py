"""Exact removal of repeated 100-byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if some 100-byte string over it also starts earlier (smaller doc_id, or the same document further left).
Whether two strings are equal is decided by sorted order alone:

1. Every 100-byte window has a minimizer, the leftmost least hash of the 32-byte strings in it, so equal windows share
   it. Neighbouring windows with one minimizer are a run. A first pass over all texts finds, for each minimizer, whether
   it occurs more than once and whether its runs differ. Runs with equal bytes are aggregated to the earliest of them,
   in the task and then in the minimizer's group; the later ones are repeats as a whole. Where all runs of a minimizer
   are equal that is all there is to know, and only their heads travel; where they differ, their bytes go along.
2. In a group of minimizers each task's differing runs are a shard. Equal strings agree on the 10-byte symbols at tens
   before and behind their minimizer, so runs are cut at those that occur once there; as minimizers have nothing in
   common, some 64 kB are taken at a time. A shard's suffixes are sorted and give its transform, over an alphabet
   of 10-byte strings. The shards' transforms are merged by interleave refinement: starting from the shards one after
   the other, each round sends the interleave through the transforms' symbols, stably, after which it is right to 10
   more bytes; ten rounds, or fewer if nothing moves, order it to 100 bytes. Boundaries between different prefixes are
   carried along, so intervals without a boundary are the strings that occur more than once; no suffix is sorted again.
3. In each interval all but the earliest string mark their bytes. Marks are joined to the documents that have any.

Only two bitmaps are broadcast, of three bytes a name up to 64 MB each; where they fill up, more runs are looked at
than needed, never fewer.
Equality of whole runs is that of 64-bit hashes of their bytes.

Defined cases: a null text is empty; texts under 100 bytes keep everything; rows with a null id come first in the
order; rows with one id are ordered by a hash of their text, and rows with equal id and text are one document, with
the same result each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import keep, partitions, small_batches
from .text import RAW_VALUE, mix, powers, sliced, strings

SPAN = 100
GRAM = 32
STEP = 10
SLICE = 1 << 17
PART_BYTES = 1 << 16
BLOCK = 1 << 14
BITMAP_BITS = 29
DOC_BITS = 22
FIRST_ID = -(1 << 63)

# ---- minimizers


class Windows:
    """The runs of windows of the texts in one byte array."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data = offsets, data
        n = len(data)
        up, down = powers(n + 1)
        self.down = down[: n + 1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(RAW_VALUE[data] * up[:n], out=self.sums[1:])
        self.start = self.last = self.gram = np.zeros(0, np.int64)
        self.name = np.zeros(0, np.uint64)
        if n < SPAN:
            return
        at = self.minimizers()
        inside = np.ones(len(at), bool)
        for e in offsets[1:-1].tolist():
            inside[max(0, e - SPAN + 1) : e] = False
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        np.not_equal(at[1:], at[:-1], out=fresh[1:])
        fresh[1:] |= inside[1:] & ~inside[:-1]
        cuts = offsets[1:-1]
        fresh[cuts[cuts < len(fresh)]] = True
        first = np.flatnonzero(fresh & inside)
        ends = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True))
        self.start, self.last, self.gram = first, ends, at[first]
        h = (self.sums[self.gram + GRAM] - self.sums[self.gram]) * self.down[self.gram]
        self.name = mix(h ^ np.uint64(0x9E3779B97F4A7C15))

    def minimizers(self) -> np.ndarray:
        """Of each window start: the leftmost place of the least hash. In blocks that stay in the processor's cache."""
        n, want = len(self.down) - SPAN, SPAN - GRAM + 1
        at = np.empty(n, np.int64)
        a, b = np.empty(BLOCK + want, np.uint64), np.empty(BLOCK + want, np.uint64)
        number = np.arange(BLOCK + want, dtype=np.uint64)
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            m = hi - lo + want - 1
            x, y = a[:m], b[:m]
            np.subtract(self.sums[lo + GRAM : lo + GRAM + m], self.sums[lo : lo + m], out=x)
            x *= self.down[lo : lo + m]
            x &= np.uint64(0xFFFFFFFF00000000)
            x |= number[:m]
            width = 1
            while width < want:
                step = min(width, want - width)
                m -= step
                np.minimum(x[:m], x[step : step + m], out=y[:m])
                x, y, width = y, x, width + step
            np.bitwise_and(x[:m], np.uint64(0xFFFFFFFF), out=y[:m])
            np.add(y[:m].view(np.int64), lo, out=at[lo:hi])
        return at

    def take(self, chosen: np.ndarray) -> None:
        self.start, self.last, self.gram, self.name = self.start[chosen], self.last[chosen], self.gram[chosen], self.name[chosen]

    def content(self) -> np.ndarray:
        """A hash of each run's bytes and of where its minimizer stands in it."""
        end = self.last + SPAN
        h = (self.sums[end] - self.sums[self.start]) * self.down[self.start]
        return mix(h + mix((self.gram - self.start).astype(np.uint64) * np.uint64(1 << 20) + (end - self.start).astype(np.uint64)))


def _groups_of(name: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    return (name % np.uint64(ranges)).astype(np.int64), (name >> np.uint64(32)).astype(np.uint32)


NAME = np.dtype([("name", "<u4"), ("content", "<u8")])


def _names(ranges: int):
    """Packed (minimizer, run content) of a task by group; what occurs twice in the task is sent twice."""

    def pack(held):
        name, content = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(name ^ mix(content))  # brings equal ones together
        name, content = name[by], content[by]
        at = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (content[1:] != content[:-1])))
        twice = np.diff(np.append(at, len(name))) > 1
        at = np.concatenate([at, at[twice]])
        group, short = _groups_of(name[at], ranges)
        by = np.argsort(group, kind="stable")
        rows = np.empty(len(at), NAME)
        rows["name"], rows["content"] = short[by], content[at][by]
        group = group[by]
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        stop = np.append(cut[1:], len(group))
        return pa.RecordBatch.from_arrays(
            [pa.array(group[cut], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(cut.tolist(), stop.tolist())], pa.binary())], names=["group", "names"]
        )

    def run(batches):
        held, n = [], 0
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                w = Windows(*strings(batch.column("text")))
                if len(w.name):
                    held.append((w.name, w.content()))
                    n += len(w.name)
                if n > 1_000_000:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return run


def _section(most: int):
    """A group's part of the bitmaps: names that occur more than once, and those whose runs differ. Three bytes a name,
    ``most`` at most."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b, NAME) for b in table["names"].to_pylist()])
        by = np.argsort(rows["name"])
        name, content = rows["name"][by], rows["content"][by]
        same = name[1:] == name[:-1]
        parts = []  # where a name's runs differ, two neighbours do
        for hit in (same, same & (content[1:] != content[:-1])):
            found = name[1:][hit]
            distinct = int((found[1:] != found[:-1]).sum()) + 1
            part = np.zeros(8 * min(most, 3 * distinct), bool)
            part[found % len(part)] = True
            parts.append(pa.array([np.packbits(part).tobytes()], pa.binary()))
        return pa.table({"group": table["group"].slice(0, 1), "twice": parts[0], "mixed": parts[1]})

    return run


class Bitmap:
    """The groups' parts of one bitmap; a group may have none."""

    def __init__(self, parts: dict[int, bytes], ranges: int):
        parts = [parts.get(g, b"\0") for g in range(ranges)]
        self.size = np.array([len(p) for p in parts])
        self.at = np.cumsum(self.size) - self.size
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def on(self, group: np.ndarray, short: np.ndarray) -> np.ndarray:
        bit = short % (8 * self.size)[group]
        return (self.bits[self.at[group] + (bit >> 3)] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0


# ---- runs

HEAD = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("start", "<i8"), ("content", "<u8"), ("length", "u1"), ("gram", "u1"), ("mixed", "?")])  # a run has at most 168 bytes
MARKS = "doc long, hash long, start long, end long, group int, heads binary, bytes binary"


def text_hash(offsets: np.ndarray, data: np.ndarray, w: Windows) -> np.ndarray:
    n = np.diff(offsets)
    return mix((w.sums[offsets[1:]] - w.sums[offsets[:-1]]) * w.down[offsets[:-1]] + mix(n.astype(np.uint64))).view(np.int64)


def _runs(shared, ranges: int):
    """Spans that are repeats within the task (dealt to any group, to be passed on), and the other runs by group."""

    def marks(doc, hash_, start, end):
        m = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(hash_, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(hash_ % ranges, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())],
            names=["doc", "hash", "start", "end", "group", "heads", "bytes"],
        )

    def pack(held):
        doc, hash_, start, length, gram, mixed, name, content = (np.concatenate(x) for x in zip(*(h[:8] for h in held)))
        texts = np.concatenate([h[8] for h in held])
        at = np.cumsum(length * mixed) - length * mixed
        by = np.lexsort((start, hash_, doc, content))
        first = np.append(True, content[by][1:] != content[by][:-1])
        later, by = by[~first], by[first]
        if len(later):
            yield marks(*_merged(doc[later], hash_[later], start[later], start[later] + length[later]))
        group, _ = _groups_of(name[by], ranges)
        order = np.argsort(group, kind="stable")
        by, group = by[order], group[order]
        head = np.empty(len(by), HEAD)
        for field, values in (("doc", doc), ("hash", hash_), ("start", start), ("content", content), ("length", length), ("gram", gram), ("mixed", mixed)):
            head[field] = values[by]
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        stop = np.append(cut[1:], len(group))
        size = length[by] * mixed[by]
        total = np.cumsum(size) - size
        flat = texts[np.repeat(at[by] - total, size) + np.arange(int(size.sum()))]
        edges = np.append(total, len(flat))
        m = len(cut)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(m, pa.int64()) for _ in range(4)), pa.array(group[cut], pa.int32()),
             pa.array([head[a:b].tobytes() for a, b in zip(cut.tolist(), stop.tolist())], pa.binary()),
             pa.array([flat[edges[a] : edges[b]].tobytes() for a, b in zip(cut.tolist(), stop.tolist())], pa.binary())],
            names=["doc", "hash", "start", "end", "group", "heads", "bytes"],
        )

    def run(batches):
        twice, differ = shared.value
        held, n = [], 0
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                offsets, data = strings(batch.column("text"))
                docs = batch.column("doc_id").fill_null(FIRST_ID).to_numpy(zero_copy_only=False)
                w = Windows(offsets, data)
                if not len(w.start):
                    continue
                own = text_hash(offsets, data, w)
                copies = []
                for i, (d, h, size) in enumerate(zip(docs.tolist(), own.tolist(), np.diff(offsets).tolist())):
                    if size >= SPAN:
                        if h in seen and seen[h] < d:
                            copies.append(i)
                        elif h not in seen or d < seen[h]:
                            seen[h] = d
                if copies:
                    c = np.array(copies)
                    yield marks(docs[c], own[c], np.zeros(len(c), np.int64), np.diff(offsets)[c])
                group, short = _groups_of(w.name, ranges)
                chosen = twice.on(group, short)
                doc_of = np.searchsorted(offsets, w.start, side="right") - 1
                skip = np.zeros(len(docs), bool)
                skip[copies] = True
                chosen &= ~skip[doc_of]
                w.take(chosen)
                doc_of, mixed = doc_of[chosen], differ.on(group[chosen], short[chosen])
                if not len(w.start):
                    continue
                length = w.last + SPAN - w.start
                size = length * mixed
                before = np.cumsum(size) - size
                texts = data[np.repeat(w.start - before, size) + np.arange(int(size.sum()))]
                held.append((docs[doc_of], own[doc_of], w.start - offsets[doc_of], length, w.gram - w.start, mixed, w.name, w.content(), texts))
                n += len(length)
                if n > 250_000:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)

    return run


def _merged(doc, hash_, start, end):
    """Overlapping or touching spans of a document as one."""
    by = np.lexsort((start, hash_, doc))
    doc, hash_, start, end = doc[by], hash_[by], start[by], end[by]
    new_doc = np.append(True, (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1]))
    lift = np.cumsum(new_doc) * np.int64(1 << 40)  # far apart, so that a running maximum stays within a document
    reach = np.maximum.accumulate(end + lift)
    fresh = np.append(True, start[1:] + lift[1:] > reach[:-1])
    at = np.flatnonzero(fresh)
    stop = np.append(at[1:], len(doc)) - 1
    return doc[at], hash_[at], start[at], reach[stop] - lift[stop]


# ---- transforms and their merge


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks of numbers, equal for equal ones."""
    by = np.argsort(key)
    s = key[by]
    out = np.empty(len(key), np.int64)
    out[by] = np.cumsum(np.append(False, s[1:] != s[:-1]))
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return dense((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def alphabet(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The symbol of each place: the rank of its next 10 bytes. Places with fewer bytes ``left`` in their run get
    symbols of their own, so nothing equals what runs out."""
    five = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(STEP, np.uint8)])
    for j in range(5):
        five = (five << np.uint64(8)) | padded[j : j + len(data)]
    r5 = dense(five)
    r10 = _pair(r5, _ahead(r5, 5))
    short = left < STEP
    r10[short] = int(r10.max(initial=0)) + 1 + np.arange(int(short.sum()))
    return r10


def suffix_order(symbol: np.ndarray, left: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Places by shard, each shard's in the order of their suffixes (to 100 bytes): the suffix arrays, one after the
    other, by doubling within the shards. Only what is still equal within its shard is sorted again."""
    n = len(symbol)
    key = (shard.astype(np.uint64) << np.uint64(32)) | symbol.astype(np.uint64)
    order = np.argsort(key)
    where, width = np.arange(n), STEP
    key = key[order]
    rank = np.empty(n, np.int64)
    while True:
        fresh = np.append(True, key[1:] != key[:-1])
        rank[order[where]] = np.maximum.accumulate(np.where(fresh, where, 0))  # where their equals begin
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied) or width >= SPAN:
            return order
        where = where[tied]
        place = order[where]
        ahead = np.where(left[place] > width, rank[np.minimum(place + width, n - 1)] + 1, 0)  # 0: at an end
        key = (rank[place] << 32) | ahead
        by = np.argsort(key)
        order[where], key = place[by], key[by]
        width *= 2


def merge(symbol: np.ndarray, left: np.ndarray, shard: np.ndarray, first: np.ndarray, order: np.ndarray, rounds: int = SPAN // STEP) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves the shards' suffix arrays (``order``: one after the other) by refinement. ``first``: places less than
    10 bytes behind a run's start have no symbol before them. Returns the places in merged order and, for each, whether
    it differs from the one before within ``rounds`` symbols."""
    n = len(order)
    kind, half = (np.uint32, 16) if max(n, int(symbol.max(initial=0)) + 2) <= 1 << 16 else (np.uint64, 32)
    none, half = kind(np.iinfo(kind).max), kind(half)
    high = symbol.astype(kind) << half
    transform = np.where(first[order], none, high[order - STEP])  # the symbols before, shard by shard
    interleave = shard[order]  # the shards one after the other
    edge = np.zeros(n, bool)
    ends = np.flatnonzero(left <= STEP)  # their suffixes have no later place to come from
    ends = ends[np.argsort(symbol[ends], kind="stable")]
    m, numbers, low = len(ends), np.arange(n, dtype=kind), kind((1 << int(half)) - 1)
    key, own, block, sent = np.empty(n, kind), np.empty(n, shard.dtype), np.empty(n, np.int32), np.empty(n, kind)
    for k in range(rounds):
        sent[np.argsort(interleave, kind="stable")] = transform
        behind = np.flatnonzero(sent != none)
        key[:m], key[m:] = high[ends], sent[behind]
        own[:m], own[m:] = shard[ends], interleave[behind]
        block[:m], block[m:] = -1 if k else 0, np.cumsum(edge, dtype=np.int32)[behind]  # an end tells from the 2nd symbol on
        key |= numbers
        key.sort()
        to = (key & low).astype(np.int64)
        key >>= half
        step = key[1:] != key[:-1]
        now, came = own[to], block[to]
        fresh = np.append(True, step | (came[1:] != came[:-1]))
        if np.array_equal(now, interleave) and np.array_equal(fresh, edge):
            break
        interleave, edge = now, fresh
    merged = np.empty(n, np.int64)
    merged[np.argsort(interleave, kind="stable")] = order
    return merged, edge


def _mark(table: pa.Table) -> pa.Table:
    """The spans of a group's runs that also occur earlier, and the spans passed on."""
    passed = table.filter(pc.is_null(table["heads"]))
    out = [tuple(passed[k].to_numpy() for k in ("doc", "hash", "start", "end"))]
    heads = [np.frombuffer(b, HEAD) for b in table["heads"].to_pylist() if b is not None]
    if heads:
        head = np.concatenate(heads)
        shard = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        data = np.frombuffer(b"".join(b for b in table["bytes"].to_pylist() if b is not None), np.uint8)
        size = head["length"].astype(np.int64) * head["mixed"]
        at = np.cumsum(size) - size
        by = np.lexsort((head["start"], head["hash"], head["doc"], head["content"]))
        first = np.append(True, head["content"][by][1:] != head["content"][by][:-1])
        later = by[~first]
        if len(later):
            out.append((head["doc"][later], head["hash"][later], head["start"][later], head["start"][later] + head["length"][later]))
        chosen = np.sort(by[first])
        chosen = chosen[head["mixed"][chosen]]
        if len(chosen):
            out.append(_mark_mixed(head[chosen], shard[chosen], data, at[chosen]))
    doc, hash_, start, end = (np.concatenate([np.asarray(o[i], np.int64) for o in out]) for i in range(4))
    if len(doc):
        doc, hash_, start, end = _merged(doc, hash_, start, end)
    return pa.table({"doc": doc, "hash": hash_, "start": start, "end": end})


def at_any(data: np.ndarray, kind: str) -> np.ndarray:
    """The numbers of a kind that start at each byte."""
    return np.ndarray((len(data) - np.dtype(kind).itemsize + 1,), kind, data, strides=(1,))


def stretches(data: np.ndarray, where: np.ndarray, length: np.ndarray, gram: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of what of the runs can hold a string of 100 bytes that another run of the minimizer has.
    Equal strings have their minimizer at one place, so they agree on the symbols that stand at tens before and behind
    it; at least nine of these are in the string. Runs are cut at those that occur once."""
    lead = gram % STEP
    cells = (length - lead) // STEP
    run = np.repeat(np.arange(len(length)), cells)
    cell = np.arange(len(run)) - (np.cumsum(cells) - cells)[run]
    place = (where + lead)[run] + cell * STEP
    eight = at_any(data, "<u8")
    key = mix(eight[place] ^ mix(eight[place + STEP - 8] ^ mix(name[run] + (cell - (gram // STEP)[run]).astype(np.uint64))))
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    again = np.zeros(len(run) + 2, bool)  # with one place before and one behind
    again[1 + by[:-1][same]] = again[1 + by[1:][same]] = True
    inside = np.append(False, run[1:] == run[:-1])
    begin = np.flatnonzero(again[1:-1] & ~(again[:-2] & inside))
    stop = np.flatnonzero(again[1:-1] & ~(again[2:] & np.append(inside[1:], False)))
    long = stop - begin + 1 >= SPAN // STEP - 1
    run, begin, stop = run[begin[long]], cell[begin[long]], cell[stop[long]]
    start = np.maximum(lead[run] + begin * STEP - STEP + 1, 0)
    end = np.minimum(lead[run] + (stop + 2) * STEP - 1, length[run])
    long = end - start >= SPAN
    return run[long], start[long], end[long]


def _mark_mixed(head: np.ndarray, shard: np.ndarray, data: np.ndarray, where: np.ndarray):
    """The same for different runs, by their shards' merged transforms. Minimizers have nothing in common, so some at a
    time, however large the group is."""
    length, gram = head["length"].astype(np.int64), head["gram"].astype(np.int64)
    eight = at_any(data, "<u8")
    name = np.zeros(len(head), np.uint64)
    for k in range(0, GRAM, 8):
        name = mix(name ^ eight[where + gram + k])
    by = np.argsort(name)
    total = np.cumsum(length[by])
    fresh = np.flatnonzero(np.append(True, name[by][1:] != name[by][:-1]))
    part = (total - length[by])[fresh] // PART_BYTES
    cut = np.append(fresh[np.append(True, part[1:] != part[:-1])], len(by))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = np.sort(by[a:b])
        run, start, end = stretches(data, where[own], length[own], gram[own], name[own])
        if len(run):
            out.append(_mark_stretches(head[own[run]], shard[own[run]], data, where[own[run]], start, end))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4))


def _mark_stretches(head: np.ndarray, shard_of: np.ndarray, data: np.ndarray, where: np.ndarray, start: np.ndarray, end: np.ndarray):
    length = end - start
    at = np.cumsum(length) - length
    run = np.repeat(np.arange(len(head)), length)
    inner = np.arange(len(run)) - at[run]
    data = data[(where + start - at)[run] + np.arange(len(run))]
    shards, label = np.unique(shard_of, return_inverse=True)
    shard = label.astype(np.uint8 if len(shards) <= 256 else np.uint16)[run]
    left = length[run] - inner
    symbol = alphabet(data, left)
    order = suffix_order(symbol, left, shard)
    merged, edge = merge(symbol, left, shard, inner < STEP, order)
    # documents in their order, then places: who is first in an interval
    by = np.lexsort((head["hash"], head["doc"]))
    new = np.append(True, (head["doc"][by][1:] != head["doc"][by][:-1]) | (head["hash"][by][1:] != head["hash"][by][:-1]))
    rank = np.empty(len(head), np.int64)
    rank[by] = np.cumsum(new)
    first = head["start"] + start
    when = ((rank << 40) + first)[run] + inner
    seq = when[merged]
    cut = np.flatnonzero(edge)
    earliest = np.repeat(np.minimum.reduceat(seq, cut), np.diff(np.append(cut, len(seq))))
    marked = np.zeros(len(data), bool)
    marked[merged[(seq != earliest) & (left[merged] >= SPAN)]] = True  # shorter suffixes may be equal to their ends
    places = np.flatnonzero(marked)
    begin = places[np.append(True, np.diff(places) != 1)[: len(places)]]  # a run's last 99 places are never marked
    stop = places[np.append(np.diff(places) != 1, True)[: len(places)]]
    r = run[begin]
    return head["doc"][r], head["hash"][r], first[r] + inner[begin], first[r] + inner[stop] + SPAN


# ---- documents


def _slot(doc: np.ndarray) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) >> np.uint64(64 - DOC_BITS)).astype(np.int64)


def _slots(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column("doc").to_numpy())), pa.int64())], names=["slot"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ROWS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, doc long, hash long, open boolean"


def _split(shared):
    """Documents without marks are done; the others go on with their text."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                offsets, data = strings(batch.column("text"))
                docs = batch.column("doc_id").fill_null(FIRST_ID).to_numpy(zero_copy_only=False)
                open_ = bits[_slot(docs)]
                raw = data.tobytes()
                bounds = offsets.tolist()
                sha = [None if o else hashlib.sha256(raw[a:b]).hexdigest() for o, a, b in zip(open_.tolist(), bounds[:-1], bounds[1:])]
                own = text_hash(offsets, data, Sums(offsets, data))
                zero = np.zeros(len(docs), np.int64)
                texts = batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(zero), pa.array(zero), pa.array(sha, pa.string()),
                     pa.array([t if o else None for t, o in zip(texts.to_pylist(), open_.tolist())], pa.string()), pa.array(docs), pa.array(own), pa.array(open_)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "doc", "hash", "open"],
                )

    return run


class Sums:
    """The hash sums alone, without minimizers."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(RAW_VALUE[data] * up[: len(data)], out=self.sums[1:])


def _cut_out(batches):
    for batch in batches:
        ids, ns, removed, spans, shas = batch.column("doc_id"), [], [], [], []
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, at, gone, n = [], 0, 0, 0
            reach = -1
            for a, b in sorted(zip(starts or (), ends or ())):
                if a > reach:
                    n += 1
                    kept.append(raw[at:a])
                    gone += b - a
                    reach = b
                elif b > reach:
                    gone += b - reach
                    reach = b
                at = reach
            kept.append(raw[at:])
            ns.append(len(raw)), removed.append(gone), spans.append(n), shas.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def marks(rows: DataFrame) -> DataFrame:
    """(doc, hash, start, end): spans of bytes covered by strings that also start earlier; they may overlap."""
    spark = rows.sparkSession
    ranges = 8 * partitions(spark)
    most = max(1, (1 << BITMAP_BITS) // 8 // ranges)
    parts = rows.mapInArrow(_names(ranges), "group int, names binary").groupBy("group").applyInArrow(_section(most), "group int, twice binary, mixed binary").collect()  # 3 bytes a name that is repeated, 128 MB at most
    shared = spark.sparkContext.broadcast(tuple(Bitmap({r["group"]: bytes(r[kind]) for r in parts}, ranges) for kind in ("twice", "mixed")))
    runs = rows.mapInArrow(_runs(shared, ranges), MARKS)
    return keep(runs.groupBy("group").applyInArrow(_mark, "doc long, hash long, start long, end long"), "marks")


def remove(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    spans = marks(rows)
    bits = np.zeros(1 << DOC_BITS, bool)
    bits[spans.select("doc").mapInArrow(_slots, "slot long").distinct().toArrow()["slot"].to_numpy()] = True  # at most 2**22 numbers
    shared = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
    split = rows.mapInArrow(_split(shared), _ROWS)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done = split.where("not open").select(*columns)
    grouped = spans.groupBy("doc", "hash").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    open_ = split.where("open").select("doc_id", "text", "doc", "hash").join(grouped, ["doc", "hash"], "left")
    return done.unionByName(open_.select("doc_id", "text", "starts", "ends").mapInArrow(_cut_out, RESULT))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of every whole text of ``documents``."""
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
