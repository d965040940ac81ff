"""Toxicity by weak supervision.

Lexicons are learnt from labelled training rows and dealt to many voters; pattern voters look at how many lexicon words
a text has and how densely. A generative label model (a mixture of two classes with a vote table for each voter, fitted
by expectation maximisation) estimates each voter's accuracy; the correlation of voters' errors under the posterior
divides the evidence of voters that repeat each other. A linear classifier over hashed features is trained on the
posterior labels and scores every whole text.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are used to learn; the sample is at most ``SAMPLE`` labelled rows.
Neither labels, lang, source nor doc_id is an input of a score.

Defined cases: a null or empty text is scored like an empty one; without a toxic label (or without any) every score is
the share of toxic labels, 0 without any; rows with a null id are scored and count as not held out; repeated rows score
alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import ALL, DIM, Rows, adam, dense, features, row_sums, sample
from .storage import small_batches
from .text import sliced

SAMPLE = 9000
LEXICON = 320
VOTERS = 24
THRESHOLD = 0.7
#: Deviation, in standard deviations, that a sample's tens of thousands of words don't reach by chance.
CHANCE = 5.5


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def deviation(x: Rows, p: np.ndarray) -> np.ndarray:
    """By how many standard deviations each feature is more frequent in class 1 (of which ``p`` is the probability or
    label) than chance would have it."""
    df = np.bincount(x.local, minlength=len(x.used))
    one = np.bincount(x.local, np.repeat(p, x.lengths), len(x.used))
    share = max(float(p.mean()), 1e-6)
    z = (one - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
    return np.where((one >= 2.5) & (one > 0.6 * df) & (x.used < DIM), z, 0)  # bins tell the shape of a text, not what it says


def lexicon(x: Rows, y: np.ndarray, size: int = LEXICON) -> np.ndarray:
    """The features (numbers among those used) that speak most for class 1, best first."""
    z = deviation(x, (y == 1).astype(float))
    order = np.argsort(-z, kind="stable")[:size]
    return order[z[order] >= CHANCE]


def votes(x: Rows, words: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    """(texts, voters): 1 toxic, -1 not, 0 abstains. A lexicon voter never says no; the patterns do."""
    place = np.full(len(x.used), -1)
    place[words] = np.arange(len(words)) % voters
    owner = np.repeat(np.arange(x.n), x.lengths)
    at = place[x.local]
    hits = np.zeros((x.n, voters))
    np.add.at(hits, (owner[at >= 0], at[at >= 0]), 1)
    total = hits.sum(1)
    dense_share = total / np.maximum(x.lengths, 1)
    patterns = [
        np.where(total >= 4, 1, np.where(total == 0, -1, 0)),
        np.where(dense_share >= 0.004, 1, np.where(dense_share < 0.0005, -1, 0)),
        np.where((hits > 0).sum(1) >= 2, 1, -1),
    ]
    return np.concatenate([(hits > 0).astype(np.int8), np.array(patterns, np.int8).T], axis=1)


@dataclass
class LabelModel:
    prior: float
    tables: np.ndarray  # (voters, class, vote + 1): log probability
    shares: np.ndarray  # how much of a voter's evidence is its own

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logit = np.log(self.prior / (1 - self.prior))
        for j in range(v.shape[1]):
            logit = logit + self.shares[j] * (self.tables[j, 1, v[:, j] + 1] - self.tables[j, 0, v[:, j] + 1])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def accuracies(self, v: np.ndarray) -> np.ndarray:
        """Estimated share of a voter's votes that are right."""
        p = self.posterior(v)
        right = np.where(v == 1, p[:, None], np.where(v == -1, 1 - p[:, None], 0)).sum(0)
        return right / np.maximum((v != 0).sum(0), 1)


def fit_label_model(v: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """EM from the majority of votes; after each round the correlations are estimated anew."""
    n, m = v.shape
    start = (v == 1).sum(1) - (v == -1).sum(1)
    p = np.clip(np.where((v == 1).sum(1) > 0, 0.5 + 0.45 * np.tanh(start), 0.02), 0.01, 0.99)
    model = LabelModel(prior, np.zeros((m, 2, 3)), np.ones(m))
    for _ in range(rounds):
        for c, weight in ((0, 1 - p), (1, p)):
            for vote in (-1, 0, 1):
                model.tables[:, c, vote + 1] = np.log(((v == vote) * weight[:, None]).sum(0) + 0.1)
            model.tables[:, c] -= np.log(np.exp(model.tables[:, c]).sum(1, keepdims=True))
        expected = [np.exp(model.tables[:, c]) @ np.array([-1, 0, 1]) for c in (0, 1)]
        residual = v - (1 - p)[:, None] * expected[0] - p[:, None] * expected[1]
        residual = residual / np.maximum(residual.std(0), 1e-6)
        rho = np.abs(residual.T @ residual / n)
        np.fill_diagonal(rho, 0)
        model.shares = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(1))
        model.prior = float(np.clip(p.mean(), 0.005, 0.9))
        p = model.posterior(v)
    return model


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(row_sums(ids, self.weights, scaled=False) + self.bias, -40, 40)))


def fit(ids: list[np.ndarray], y: np.ndarray) -> Classifier:
    """``y``: labels that build the lexicons; the classifier itself learns from the label model's posteriors."""
    share = float(np.mean(y == 1)) if len(y) else 0.0
    nothing = Classifier(np.zeros(ALL, np.float32), -40.0 if share == 0 else float(np.log(share / max(1 - share, 1e-9))))
    if share in (0.0, 1.0):
        return nothing
    _, first = np.unique([hash(i.tobytes()) for i in ids], return_index=True)  # copies would inflate their words
    ids, y = [ids[i] for i in np.sort(first)], y[np.sort(first)]
    x = Rows(ids, scaled=False)
    words = lexicon(x, y)
    if not len(words):
        return nothing
    v = votes(x, words)
    p = fit_label_model(v, share).posterior(v)
    seen = (deviation(x, p) >= CHANCE).astype(float)
    balance = np.where(p > 0.5, 0.5 / max(p.mean(), 1e-3), 0.5 / max(1 - p.mean(), 1e-3)) ** 0.5

    def grad(w):
        g = (1 / (1 + np.exp(-np.clip(x.dot(w[:-1] * seen) + w[-1], -40, 40))) - p) * balance / len(p)
        return np.append(x.back(g) * seen + 1e-5 * w[:-1], g.sum())

    w = adam(np.append(np.zeros(len(x.used)), -2.0), grad, 150, 0.1)
    return Classifier(dense(x.used, w[:-1] * seen), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Classifier:
    """Learns from training rows only."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = sample(docs, marks.select(F.col("doc_id").cast("long"), F.col("toxic").alias("mark")), limit)
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))


def _score(shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in sliced(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(batch.column("text"))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared), "doc_id long, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
