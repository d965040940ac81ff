"""Best-fit packing by a grouping genetic algorithm on islands.

A document's token ids are followed by id 0; only what is longer than a sequence is cut. Pieces of a whole sequence
stand alone. The others are dealt to blocks of about ``BLOCK`` pieces; each block is solved by ``ISLANDS`` islands with
populations of their own. A child takes whole well-filled bins from one parent, drops the other parent's bins that
hold any of the same pieces, and puts the displaced pieces where they fit best. Between epochs each island's best
individual migrates to the next island of its block. Badly filled bins of all blocks then meet in fewer blocks, until
one block is left; where well-filled bins hold less than half of a block's pieces, the next fullest ones stay too, so that
each level has half the pieces of the one before at most. Only ids and lengths move; a block's size is bounded, so no task
grows with the input.

Defined cases: a null or empty text is the one token 0; rows with a null id are packed like others; repeated rows and
equal ids are packed each on its own; long texts are cut; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discard, keep, partitions, small_batches
from .text import sliced, strings
from .tokens import default_path, tokenizer

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
WELL_FILLED = 0.995

PIECES = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches):
        tok = tokenizer(path)
        rid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        zero = np.zeros(1, "<u4")
        for whole in batches:
            for batch in sliced(whole, "text"):
                ids_of = tok.of(*strings(batch.column("text")))
                rows: list[list[int]] = [[], [], [], [], []]
                for i, ids in enumerate(ids_of):
                    raw = ids.astype("<u4").tobytes() + zero.tobytes()
                    n = len(ids) + 1
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        for col, value in zip(rows, (i, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                            col.append(value)
                m = len(rows[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + m)), batch.column("doc_id").take(pa.array(rows[0], pa.int64())),
                     pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])],
                    names=["rid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                rid += m

    return run


def cut(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, with a row number of their own (unique in one run of the query only, so
    the result must be kept before it is used twice)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer_path or default_path(), capacity), PIECES)


# ---- the genetic algorithm on one block; an individual is an array: the bin of each piece


def best_fit(lengths: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Puts the ``loose`` pieces, longest (or heaviest by ``weight``) first, into the fullest bin that has room, else a
    new one."""
    out = bins.copy()
    held = np.ones(len(lengths), bool)
    held[loose] = False
    n = int(bins[held].max()) + 1 if held.any() else 0
    fill = np.bincount(bins[held], lengths[held], n).astype(np.int64) if held.any() else np.zeros(0, np.int64)
    shortest = int(lengths[loose].min()) if len(loose) else 0
    room = sorted((capacity - int(f), b) for b, f in enumerate(fill) if f and capacity - f >= shortest)
    for i in loose[np.argsort(-(lengths if weight is None else weight)[loose], kind="stable")].tolist():
        need = int(lengths[i])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, n
            n += 1
        out[i] = b
        if left - need >= shortest:
            insort(room, (left - need, b))
    return out


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, those with fuller and emptier bins rather than evenly filled ones."""
    fill = np.bincount(bins, lengths)
    fill = fill[fill > 0] / capacity
    return (-len(fill), float((fill**2).sum()))


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(b, lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    injected = np.zeros(len(fill), bool)
    injected[rng.choice(good, max(1, len(good) // 4), replace=False)] = True
    moving = injected[b]
    struck = np.zeros(int(a.max()) + 1, bool)
    struck[a[moving]] = True
    loose = np.flatnonzero(struck[a] & ~moving)
    child = a.copy()
    child[moving] = b[moving] + int(a.max()) + 1
    return best_fit(lengths, compact(child), loose, capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties the worst bins and some others, and fits their pieces again."""
    fill = np.bincount(a, lengths)
    n = max(2, len(fill) // 20)
    gone = np.concatenate([np.argsort(fill, kind="stable")[:n], rng.choice(len(fill), n)])
    out = np.zeros(len(fill), bool)
    out[gone] = True
    return best_fit(lengths, a, np.flatnonzero(out[a]), capacity)


def evolve(lengths: np.ndarray, seed: int, elite: np.ndarray | None, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """One epoch of an island; ``elite``: its own best so far and the immigrant, rows of an array."""
    rng = np.random.default_rng(seed)
    every = np.arange(len(lengths))
    blank = np.zeros(len(lengths), np.int64)
    lower = -(-int(lengths.sum()) // capacity)
    people = [] if elite is None else [compact(e) for e in elite]
    if not people:
        people.append(compact(best_fit(lengths, blank, every, capacity)))
    while len(people) < population:
        people.append(compact(best_fit(lengths, blank, every, capacity, lengths * rng.uniform(0.7, 1.3, len(lengths)))))
    people.sort(key=lambda p: fitness(lengths, p, capacity), reverse=True)
    for k in range(generations):
        if k and int(people[0].max()) + 1 <= lower:  # no fewer bins are possible
            break
        i, j = rng.choice(population, 2, replace=False)
        made = [crossover(people[i], people[j], lengths, capacity, rng), mutate(people[int(rng.integers(population))], lengths, capacity, rng)]
        people = sorted(people + [compact(m) for m in made], key=lambda p: fitness(lengths, p, capacity), reverse=True)[:population]
    return people[0]


STATE = "block long, island int, rid long, length long, bin long"


def _epoch(epoch: int, level: int, capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        elite = None if epoch == 0 else pdf[["bin", "immigrant"]].to_numpy(np.int64).T
        seed = (int(key[0]) * 131 + int(key[1])) * 31 + epoch * 7 + level
        return pdf[["block", "island", "rid", "length"]].assign(bin=evolve(lengths, seed, elite, capacity))

    return run


def _choose(level: int, last: bool, capacity: int):
    """The best island of a block. Bins that are well filled, the fullest ones that hold half of the pieces, or all of
    them on the last level, are final: their pieces get a sequence and a place. The pieces of the others go on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best, score = None, None
        for _, own in sorted(pdf.groupby("island")):
            s = fitness(own["length"].to_numpy(np.int64), own["bin"].to_numpy(np.int64), capacity)
            if score is None or s > score:
                best, score = own, s
        best = best.sort_values(["bin", "rid"], kind="stable")
        before = best.groupby("bin")["length"].cumsum() - best["length"]
        bins = best.groupby("bin")["length"].agg(["sum", "size"]).sort_values("sum", ascending=False, kind="stable")
        half = bins["size"].cumsum() - bins["size"] < len(best) / 2
        full = best["bin"].isin(bins.index[half | (bins["sum"] >= WELL_FILLED * capacity)])
        seq = (level << 56) + best["block"].astype("int64") * (1 << 20) + best["bin"]
        done = full | last
        return pd.DataFrame({"rid": best["rid"], "length": best["length"], "sequence_id": seq.where(done, -1), "offset": before.where(done, -1)})

    return run


PLACED = "rid long, length long, sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces(rid, length, ...)`` with unique rids, kept; adds sequence_id and offset."""
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") == capacity).select("rid", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = pieces.where(F.col("length") < capacity).select("rid", "length")
    placed = [whole]
    left, level = open_.count(), 0
    while left:
        n = -(-left // block)
        last = n == 1
        deal = open_.select(F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(n)).alias("block"), "rid", "length")
        state = deal.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("bin", F.lit(0).cast("long"))
        spread = min(2 * n * ISLANDS, 4 * partitions(spark)) if n > 1 else ISLANDS
        for epoch in range(EPOCHS):
            if epoch:
                guest = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), "rid", F.col("bin").alias("immigrant"))
                state = state.join(guest, ["block", "island", "rid"])
            state = keep(state.groupBy("block", "island").applyInPandas(_epoch(epoch, level, capacity), STATE), "islands")
            if epoch:
                discard(held)
            held = state
        got = keep(state.groupBy("block").applyInPandas(_choose(level, last, capacity), PLACED), "packed")
        discard(held)
        placed.append(got.where("sequence_id >= 0").select("rid", "sequence_id", "offset"))
        open_ = got.where("sequence_id < 0").select("rid", "length")
        left = 0 if last else open_.count()
        level += 1
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return pieces.join(out, "rid")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of at most 2048 tokens."""
    pieces = keep(cut(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces")
    return pack(pieces).drop("rid")
