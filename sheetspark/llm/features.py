"""Hashed text features of whole texts, and a bounded labelled sample to fit linear models on.

A text's features are the distinct hashes of its letter runs (lower-case), of their first 4 and 5 bytes, and of binned
shares: kinds of signs, repeated words, word length. Words lie in ``DIM`` hashed buckets, bins behind them. Kernels work on the Arrow byte array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, keep, small_batches
from .text import BYTE_VALUE, SLOT, mix, powers, sliced, strings

DIM = 1 << 21

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
#: Kinds of bytes whose shares are features.
KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "!": (33,), "?": (63,), "*": (42,), "#": (35,), "%": (37,), "&": (38,), "$": (36,), "|": (124,), ".": (46, 44), "wide": range(0x80, 0x100)}
KIND = np.full(256, len(KINDS), np.uint8)
for _i, _k in enumerate(KINDS.values()):
    KIND[list(_k)] = _i
_EDGES = np.array([0.0005, 0.002, 0.008, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_WIDTH = np.array([0, 2, 3, 4, 5, 6, 7, 8, 10, 14, 20])
N_SHARES = len(KINDS) + 3
ALL = DIM + 16 * N_SHARES


def letter_runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and hashes of the runs of letters."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    token = LETTER[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.logical_not(token[:-1], out=fresh[1:])
    inner = offsets[1:-1]
    fresh[inner[inner < len(data)]] = True
    starts = np.flatnonzero(token & fresh)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    cum = np.concatenate([[0], np.cumsum(token)])
    lengths = np.diff(np.append(cum[starts], cum[-1]))
    up, down = powers(len(data))
    value = np.where(token, BYTE_VALUE[data] * up[: len(data)], np.uint64(0))
    return starts, lengths, mix(np.add.reduceat(value, starts) * down[starts])


def shares(offsets: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(texts, N_SHARES): share of each kind of byte, of repeated words, of words like the one before; mean length."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * 16 + KIND[data], minlength=16 * n).reshape(n, 16)[:, : len(KINDS)]
    out = np.zeros((n, N_SHARES))
    size = np.maximum(np.diff(offsets), 1)
    out[:, : len(KINDS)] = counts / size[:, None]
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    if len(hashes):
        same = np.zeros(len(hashes) + 1)
        same[1:-1] = np.cumsum(hashes[1:] == hashes[:-1])
        same[-1] = same[-2]
        cum = np.concatenate([[0], np.cumsum(lengths)])
        some = words > 0
        a, b = bounds[:-1][some], bounds[1:][some]
        out[some, -2] = (same[b - 1 + 0] - same[a]) / words[some]
        out[some, -1] = (cum[b] - cum[a]) / words[some]
        out[some, -3] = [1 - len(np.unique(hashes[x:y])) / (y - x) for x, y in zip(a.tolist(), b.tolist())]
    return out


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct feature numbers of each text, ascending."""
    offsets, data = strings(column)
    starts, lengths, hashes = letter_runs(offsets, data)
    bounds = np.searchsorted(starts, offsets)
    groups = [hashes]
    owner = [np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))]
    if len(starts):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        prefix = np.zeros(len(starts), np.uint64)
        for j in range(5):
            prefix = prefix + BYTE_VALUE[padded[starts + j]] * SLOT[j]
            if j >= 3:
                long = lengths > j + 1
                groups.append(mix(prefix[long] + SLOT[20 + j]))
                owner.append(owner[0][long])
    share = shares(offsets, data, starts, lengths, hashes)
    binned = np.searchsorted(_EDGES, share)
    binned[:, -1] = np.searchsorted(_WIDTH, share[:, -1])
    fixed = DIM + np.arange(N_SHARES) * 16 + binned
    n = len(offsets) - 1
    ids = np.concatenate([(g & np.uint64(DIM - 1)).astype(np.int64) for g in groups] + [fixed.ravel()])
    doc = np.concatenate([*owner, np.repeat(np.arange(n), N_SHARES)])
    keys = np.sort((doc << 24) + ids)
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    cuts = np.searchsorted(keys, np.arange(n + 1) << 24)
    ids = (keys & ((1 << 24) - 1)).astype(np.int32)
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


#: Feature numbers of a sample that reach the driver, together (4 bytes each).
FEATURES = 30_000_000


def _emit(batches):
    for whole in batches:
        for batch in sliced(whole, "text"):
            found = features(batch.column("text"))
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            arr = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), arr], names=["doc_id", "mark", "ids"])


def sample(docs: DataFrame, labels: DataFrame, limit: int) -> list[tuple[int, object, np.ndarray]]:
    """Features of at most ``limit`` rows of ``docs``, those of ``labels(doc_id, mark)`` with the smallest hashed ids,
    as (doc_id, mark, feature numbers) by id. Only that bounded list of ids is broadcast, and only its features reach
    the driver: of the first ids that have no more than ``FEATURES`` together. Ids with several label rows use the
    largest mark, ids with several texts the one with the smallest hash."""
    small_batches(docs.sparkSession)
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("mark").alias("mark"))
    chosen = one.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(limit).drop("_h")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("mark").cast("int"))
    one = rows.groupBy("doc_id", "mark").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "mark")
    found = keep(one.mapInArrow(_emit, "doc_id long, mark int, ids array<int>"), "sample")
    sizes = found.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.size("ids").alias("n")).toPandas().sort_values(["h", "doc_id"])  # ``limit`` rows at most
    some = sizes["doc_id"][(sizes["n"].cumsum() <= FEATURES).to_numpy()].tolist()
    mine = found if len(some) == len(sizes) else found.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in some], "doc_id long")), "doc_id", "left_semi")
    out = mine.toArrow()
    discard(found)
    got = [(d, m, np.array(i, np.int32)) for d, m, i in zip(out["doc_id"].to_pylist(), out["mark"].to_pylist(), out["ids"].to_numpy(zero_copy_only=False))]
    return sorted(got, key=lambda r: r[0])


def values_of(flat: np.ndarray, lengths: np.ndarray, scaled: bool) -> np.ndarray:
    """Bins count 1; words count 1, or with ``scaled`` 1 / sqrt(features of the text)."""
    if not scaled:
        return np.ones(len(flat))
    return np.where(flat >= DIM, 1.0, np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths))


class Rows:
    """Feature lists as one sparse matrix."""

    def __init__(self, ids: list[np.ndarray], scaled: bool):
        self.n = len(ids)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.lengths = np.fromiter(map(len, ids), np.int64, self.n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.values = values_of(flat, self.lengths, scaled)
        self.used, self.local = np.unique(flat, return_inverse=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """``w``: over the features that occur."""
        return np.add.reduceat(w[self.local] * self.values, self.starts) if self.n else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.local, np.repeat(g, self.lengths) * self.values, len(self.used))


def adam(w: np.ndarray, grad, rounds: int, rate: float, l1: float = 0.0) -> np.ndarray:
    """Full-batch Adam; ``l1`` shrinks the entries ``grad`` says are penalised (all but a possible tail)."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if l1:
            w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate, 0)
    return w


def dense(used: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(ALL, np.float32)
    out[used] = w
    return out


def row_sums(ids: list[np.ndarray], weights: np.ndarray, scaled: bool) -> np.ndarray:
    if not ids:
        return np.zeros(0)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids)
    return np.add.reduceat(weights[flat].astype(np.float64) * values_of(flat, lengths, scaled), np.cumsum(lengths) - lengths)
