"""Periodic runs of words, by the longest-previous-factor variant of the enumeration of all maximal repetitions.

A run is a stretch with smallest period q, at least ``min_exponent * q`` long, that cannot be extended on either side
with that period. The texts of a batch are one sequence of symbols; a symbol stands for a word of one document, so
nothing ever matches across documents and no separators are needed. The steps:

* suffix array by prefix doubling, of which only the groups that are not yet told apart are sorted again; the ranks of
  every level are kept, since two equal ranks of level k are two equal stretches of 2**k words, which gives any longest
  common extension, forwards or backwards, in one comparison a level;
* common prefixes of neighbours in the suffix array, and from them each place's longest previous factor: the nearest
  suffixes on either side that start earlier, found by jumping over those that start later;
* blocks: from each block's start, the longest previous factor is the next block, at least one word;
* boundary extensions: a run that holds the first or the last word of a block is found there. The block that a run ends
  in and the one before it bound its period, as the stretch from the block before would otherwise have occurred earlier;
* copying: every other run lies within one block, hence also in that block's earlier occurrence; from there runs are
  copied from their buckets of start places, in order, so that copies are copied on.

All but the walk over blocks and the copies is whole-array work. Words are compared as such, not by hashes.

Defined cases: a null text is empty; a text without words has no run and an empty collapsed text; a null doc_id stays
null; repeated rows and rows with equal ids are rows of their own; an empty table gives no rows; extra columns are
ignored. A text is worked on whole, in one task, in about 150 bytes a word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches
from .text import SEPARATOR, sliced, strings

MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Whitespace between words: code points 9 to 13 and 32.
SPACE = r"[\x20\x09-\x0D]+"


class Suffixes:
    """Suffix array and ranks by level of symbols that differ from document to document."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        order = np.argsort(symbols, kind="stable")
        s = symbols[order]
        first = np.append(True, s[1:] != s[:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]  # a group's rank is where it begins
        rank = np.empty(n + 1, np.int32)
        rank[order], rank[n] = lead, -1
        self.levels = [rank]
        size = np.diff(np.append(np.flatnonzero(first), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # places of the array that are not settled
        width = 1
        while len(open_):
            at = order[open_]
            key = rank[at].astype(np.int64) * (n + 1) + rank[np.minimum(at + width, n)] + 1
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[open_] = at  # groups stay in their own places, as keys begin with their rank
            fresh = np.append(True, key[1:] != key[:-1])
            heads = np.flatnonzero(fresh)
            size = np.diff(np.append(heads, len(at)))
            rank = rank.copy()
            rank[at] = np.repeat(open_[heads], size)
            self.levels.append(rank)
            open_ = open_[np.repeat(size > 1, size)]
            width *= 2
        self.order = order

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at x and y, which differ."""
        x, y = x.copy(), y.copy()
        out = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.levels[0][x] == self.levels[0][y])
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = x[live], y[live]
            go = live[self.levels[k][a] == self.levels[k][b]]
            out[go] += 1 << k
            x[go] += 1 << k
            y[go] += 1 << k
        return out

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common stretches that end before x and before y, x < y."""
        x, y = x.copy(), y.copy()
        out = np.zeros(len(x), np.int64)
        live = np.flatnonzero((x > 0) & (self.levels[0][x - 1] == self.levels[0][y - 1]))
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = x[live] - (1 << k), y[live] - (1 << k)
            go = live[(a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])]
            out[go] += 1 << k
            x[go] -= 1 << k
            y[go] -= 1 << k
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest stretch from it that also starts earlier, and such an earlier start
        (-1 where the length is 0)."""
        n, at = self.n, self.order
        lcp = np.zeros(n + 1, np.int64)  # of a place of the array and the one before it
        if n > 1:
            lcp[1:n] = self.forward(at[:-1].astype(np.int64), at[1:].astype(np.int64))
        length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for step in (-1, 1):
            least = (lcp[:n] if step < 0 else lcp[1:]).copy()  # towards the neighbour that ``jump`` names
            jump = np.arange(n) + step
            live = np.flatnonzero(least > 0)
            while len(live):
                to = jump[live]
                later = at[to] > at[live]
                live, to = live[later], to[later]
                least[live] = np.minimum(least[live], least[to])
                jump[live] = jump[to]
                live = live[least[live] > 0]  # a common prefix of 0 is no factor, however far one goes on
            good = np.flatnonzero((least > 0) & (least > length[at]))
            length[at[good]], source[at[good]] = least[good], at[jump[good]]
        return length, source


def blocks(length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the blocks of every document, and the end of the last one."""
    step, out = np.maximum(length, 1).tolist(), []
    for i, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        while i < end:
            out.append(i)
            i += step[i]
    return np.array([*out, int(bounds[-1])], np.int64)


def _spread(anchor: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor with each period from 1 up to its own bound."""
    periods = np.maximum(periods, 0)
    of = np.repeat(np.arange(len(anchor)), periods)
    before = np.cumsum(periods) - periods
    return anchor[of], np.arange(len(of)) - before[of] + 1


def at_boundaries(sa: Suffixes, starts: np.ndarray, new_doc: np.ndarray, exponent: int, shortest: int) -> np.ndarray:
    """Rows (start, end, period), sorted, of the runs that hold the first or the last word of a block."""
    size = np.diff(starts)
    before = np.where(new_doc, 0, np.append(0, size[:-1]))
    first, p1 = _spread(starts[:-1], (before + size) // (exponent - 1))
    last, p2 = _spread(starts[1:] - 1, size // exponent)
    anchor, period = np.concatenate([first, last]), np.concatenate([p1, p2])
    zero, n = sa.levels[0], sa.n
    x = np.concatenate([anchor, anchor - period])
    y = np.concatenate([anchor + period, anchor])
    period = np.concatenate([period, period])
    inside = (x >= 0) & (y < n)
    x, y, period = x[inside], y[inside], period[inside]
    same = zero[x] == zero[y]
    x, y, period = x[same], y[same], period[same]
    ahead = sa.forward(x, y)
    behind = sa.backward(x, y)
    start, end = x - behind, y + ahead  # end exclusive
    good = (end - start >= exponent * period) & (end - start >= shortest)
    rows = np.stack([start[good], end[good], period[good]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # of the periods of one stretch the smallest is its period
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]
    return rows


def copied(rows: np.ndarray, starts: np.ndarray, source: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """All runs: those given, and those that lie strictly within a block, copied from its earlier occurrence."""
    runs = [tuple(r) for r in rows.tolist()]
    if not runs:
        return runs
    least = max(shortest, exponent) + 2
    for b, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - b < least:
            continue
        src = int(source[b])
        shift, last = b - src, src + (e - b) - 1  # last place of the earlier occurrence
        k = bisect_right(runs, (src, last + shift + 1, 0))
        while k < len(runs) and runs[k][0] < last:
            s, t, p = runs[k]
            if s > src and t - 1 < last:
                copy = (s + shift, t + shift, p)
                j = bisect_left(runs, copy)
                if j == len(runs) or runs[j] != copy:
                    insort(runs, copy)
            k += 1
    return runs


def find_runs(symbols: np.ndarray, bounds: np.ndarray, exponent: int = MIN_EXPONENT, shortest: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period) of all runs of documents ``bounds[i]:bounds[i + 1]`` of a sequence whose symbols differ
    from document to document; ends are exclusive, an exponent is 2 or more."""
    if not len(symbols):
        return np.zeros((0, 3), np.int64)
    sa = Suffixes(symbols)
    length, source = sa.previous_factors()
    starts = blocks(length, bounds)
    new_doc = np.isin(starts[:-1], bounds)
    found = at_boundaries(sa, starts, new_doc, exponent, shortest)
    return np.array(copied(found, starts, source, exponent, shortest), np.int64).reshape(-1, 3)


def split_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Start and end byte of every word, the number of the first word of each text (n + 1 values), the words."""
    token = ~SEPARATOR[data]
    opens, closes = token.copy(), token.copy()
    opens[1:] &= ~token[:-1]
    closes[:-1] &= ~token[1:]
    inner = offsets[1:-1]
    opens[inner[inner < len(data)]] = token[inner[inner < len(data)]]
    cut = inner[inner > 0] - 1
    closes[cut] = token[cut]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    width = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(width.astype(np.int64)), pa.py_buffer(data[token])])
    return begin, end, np.searchsorted(begin, offsets), words


def symbols_of(words: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """A number for each word, equal only for equal words of one document, ascending with the documents."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return doc * (len(coded.dictionary) + 1) + codes


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_string())])
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _collapsed(offsets, data, begin, end, bounds, keep) -> pa.Array:
    """Each text's kept words, joined by one space."""
    width = (end - begin)[keep] + 1  # with the space before it, but for a text's first
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[keep]
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    width = width - first
    close = np.cumsum(width)
    size = int(close[-1]) if len(close) else 0
    out = np.full(size, 0x20, np.uint8)
    word = np.repeat(np.arange(len(width)), width - ~first)  # the bytes of words, without the spaces
    at = np.arange(len(word)) - np.repeat(np.cumsum(width - ~first) - (width - ~first), width - ~first)
    out[(close - (width - ~first))[word] + at] = data[begin[keep][word] + at]
    ends = np.concatenate([[0], close])[np.searchsorted(doc, np.arange(len(bounds)))] if len(doc) else np.zeros(len(bounds), np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])


def _work(exponent: int, shortest: int):
    def run(batches):
        for whole in batches:
            for batch in sliced(whole, "text"):
                offsets, data = strings(batch.column("text"))
                begin, end, bounds, words = split_words(offsets, data)
                rows = find_runs(symbols_of(words, bounds), bounds, exponent, shortest)
                drop = np.zeros(len(begin) + 1, np.int64)
                np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
                np.add.at(drop, rows[:, 1], -1)
                keep = np.cumsum(drop[:-1]) == 0
                doc = np.searchsorted(bounds, rows[:, 0], side="right") - 1
                own = pa.StructArray.from_arrays([pa.array(rows[:, 0] - bounds[doc]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(OUT.field("runs").type.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), own)
                text = _collapsed(offsets, data, begin, end, bounds, keep)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), lists, text.cast(pa.string())], names=OUT.names)

    return run


def runs(docs: DataFrame, exponent: int = MIN_EXPONENT, shortest: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of ``docs(doc_id, text)``: all runs by start and period, and the
    words that are left when each run keeps its first period only, joined by single spaces. No shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_work(exponent, shortest), RESULT)


# ---- the query


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` where the words from a on repeat the p words from there, if the checksum h of doc_id ends in 0 and there
    are words."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(F.col("_h") / 10), F.size("_words")
    a = g % n
    again = lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    marked = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    marked = marked.withColumn("_a", F.when(n > 0, a)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    text = F.when(F.col("_a").isNotNull(), F.array_join(F.transform("_words", again), " ")).otherwise(F.col("text"))
    return marked.select("doc_id", text.alias("text"))


def _longest(found: Column) -> Column:
    """The run of the greatest exact exponent, the first by start and period of equals; null where there is none."""
    beats = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(beats(r, best), r).otherwise(best))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, a tenth of which repeat themselves by rule."""
    found = runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", _longest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
