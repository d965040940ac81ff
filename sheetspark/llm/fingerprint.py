"""Document fingerprints by consistent weighted sampling.

A text's terms are its five-word shingles, weighted by how often they occur. For each of ``SAMPLES`` samples and each
term there are r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the term's value is
ln c - r (t - b) - r, and the sample is the (term, t) with the least value. Two texts have the same sample with a
probability equal to the generalised Jaccard similarity of their weights, sum min / sum max. Every value is computed as
ln c - r (t + (1 - b)) in single precision, whatever the weight, so one (term, t) has the same bits in every text, and
the least value itself, hashed to 16 bits, is what the fingerprint holds.

The variates are drawn by table: r, c and b of a term come from three tables of 4,096 rows by three separate pieces of
its hash, which makes 6.9e10 triples; for the weight 1, t is 0 and no logarithm is needed.

Texts move once: rows are dealt into buckets by ranges of doc_id, and each bucket also gets the row that follows it.

Defined cases: a null text is empty; an empty text has a fingerprint of its own (empty) and is like another empty text;
rows with a null doc_id come first in the order; rows with equal ids follow each other by text; a single row is its own
next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import partitions, small_batches
from .text import mix, shingles, word_bounds, words

SAMPLES = 128
TABLE = 4096
SEED = 20240501


class Variates:
    """The tables of gamma and uniform variates, alike on every machine."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        shape = (TABLE, samples)
        self.r = (-np.log(rng.random(shape) * rng.random(shape))).astype(np.float32)
        self.ln_c = np.log(-np.log(rng.random(shape) * rng.random(shape))).astype(np.float32)
        self.b = rng.random(shape).astype(np.float32)
        self.b1 = (1 - self.b).astype(np.float32)
        self.samples = samples

    def rows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = np.uint64(TABLE - 1)
        return tuple(((h >> np.uint64(k)) & m).astype(np.int64) for k in (4, 24, 44))

    def signature(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The least value of each sample (float32)."""
        best = np.full(self.samples, np.inf, np.float32)
        one = weights == 1
        for plain, h, w in ((True, terms[one], None), (False, terms[~one], weights[~one])):
            for at in range(0, len(h), 1024):
                i, j, k = self.rows(h[at : at + 1024])
                r, step = self.r[i], self.b1[k]
                if not plain:  # for the weight 1, t is 0 and adds nothing
                    step += np.floor(np.log(w[at : at + 1024])[:, None] / r.astype(np.float64) + self.b[k]).astype(np.float32)
                step *= r
                value = self.ln_c[j]
                value -= step
                np.minimum(best, value.min(axis=0), out=best)
        return best


_made: dict[int, Variates] = {}


def variates(samples: int = SAMPLES) -> Variates:
    if samples not in _made:
        _made[samples] = Variates(samples)
    return _made[samples]


def signatures(offsets: np.ndarray, data: np.ndarray, v: Variates) -> np.ndarray:
    """(texts, samples) of 16 bits; texts without words have zeros."""
    starts, hashes = words(offsets, data)
    found = shingles(word_bounds(offsets, starts), hashes)
    least = np.zeros((len(found), v.samples), np.float32)
    none = np.zeros(len(found), bool)
    for n, s in enumerate(found):
        if len(s) == 0:
            none[n] = True
            continue
        s = np.sort(s)
        fresh = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        least[n] = v.signature(s[fresh], np.diff(np.append(fresh, len(s))))
    out = (mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(">u2")
    out[none] = 0
    return out


def texts_of(signature: np.ndarray, empty: np.ndarray) -> list[str]:
    return ["" if e else s.tobytes().hex() for s, e in zip(signature, empty.tolist())]


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the first of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _block(ids: list, texts: list[str], v: Variates) -> pa.RecordBatch:
    """Rows 0..n-2 of n rows in order, the last one being only what follows."""
    edited = [edited_text(a, b) for a, b in zip(texts[:-1], texts[1:])]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts + edited]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sig = signatures(offsets, np.frombuffer(b"".join(raw), np.uint8), v)
    n = len(edited)
    empty = ~sig.any(axis=1)
    prints = texts_of(sig, empty)
    own, nxt, ed = slice(0, n), slice(1, n + 1), slice(n + 1, 2 * n + 1)
    near = lambda a, b: np.where(empty[a] | empty[b], (empty[a] & empty[b]).astype(float), (sig[a] == sig[b]).mean(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw[n + 1 :]], pa.string()),
         pa.array(prints[own], pa.string()), pa.array(prints[ed], pa.string()), pa.array(near(own, ed)), pa.array(near(own, nxt))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


BLOCK_CHARS = 1_500_000


def _walk(samples: int):
    """Rows come sorted by bucket and order; a bucket ends with the row that follows it (``_tail``)."""

    def run(batches):
        v = variates(samples)
        ids, texts, size, bucket = [], [], 0, None
        for batch in batches:
            for b, i, t, tail in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "doc_id", "text", "_tail"))):
                if b != bucket:
                    ids, texts, size, bucket = [], [], 0, b
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if tail or size > BLOCK_CHARS:
                    if len(texts) > 1:
                        yield _block(ids, texts, v)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    return run


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    n = min(4 * partitions(spark), 2000)
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    # the bucket is the number of cuts that are no greater: found by halving, a few comparisons a row
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket_of(cuts, 0, len(cuts)))
    dealt = rows.withColumn("_bucket", bucket.cast("int"))
    first = dealt.groupBy("_bucket").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("_bucket").collect()
    if not first:
        return spark.createDataFrame([], OUT)
    heads = [(first[i - 1]["_bucket"], None if f["nulls"] else f["least"]) for i, f in enumerate(first)]  # of the bucket before, the last one's being the first
    # the first row of each bucket once more, as the end of the one before: a row for each bucket
    head = F.broadcast(spark.createDataFrame([(b, i) for b, i in heads], "_to int, _id long"))
    matched = rows.join(head, rows.doc_id.eqNullSafe(head._id)).select(F.col("_to").alias("_bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tails = matched.groupBy("_bucket", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", "_bucket", F.lit(True).alias("_tail"))
    every = dealt.withColumn("_tail", F.lit(False)).unionByName(tails)
    placed = every.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_tail", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    return placed.mapInArrow(_walk(samples), OUT)


def _bucket_of(cuts: list[int], lo: int, hi: int):
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col("doc_id") >= cuts[mid], _bucket_of(cuts, mid + 1, hi)).otherwise(_bucket_of(cuts, lo, mid))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
