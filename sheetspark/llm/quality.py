"""Quality by ordinal cumulative-link regression.

Ratings have grades 0..K-1; P(grade <= k) = sigmoid(theta_k - x.w) with one weight vector over hashed text features and
ordered thresholds (kept in order by summing exponentials). The fitted model gives each text its expected grade and
the probability of reaching a grade, by which texts are selected.

Grades come from ``labels``: 0 where quality is 0, 1 where the text is of quality but toxic, 2 otherwise. The model is
fitted on at most ``SAMPLE`` labelled rows (those with the smallest hashed ids); everything is scored.

Defined cases: a null or empty text is scored like an empty one; without any rating, or with one grade only, every
text is kept and has the expected grade of the ratings (2 without any); rows with a null id are scored; repeated rows
score alike; extra columns pass through :func:`select`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .features import ALL, Rows, adam, dense, features, row_sums, sample
from .storage import folded, fresh, quoted, small_batches, unfolded
from .text import sliced

SAMPLE = 6000
GRADES = 3
#: A text is kept if it reaches grade 1 with at least this probability.
KEEP = 0.5


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, one row per text."""
        return 1 - _sigmoid(self.thresholds[None, :] - x[:, None])


def thresholds_of(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def fit(ids: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, rounds: int = 120, rate: float = 0.05, l2: float = 1e-4) -> Ordinal:
    """Maximum likelihood with a small ridge; grades that do not occur leave their thresholds close to the next."""
    if not len(ids) or len(np.unique(grades)) < 2:
        only = int(grades[0]) if len(ids) else n_grades - 1
        return Ordinal(np.zeros(ALL, np.float32), np.where(np.arange(1, n_grades) <= only, -40.0, 40.0))
    x = Rows(ids, scaled=True)
    k = n_grades - 1
    n = x.n
    low = np.array([np.clip(np.mean(grades <= j), 0.01, 0.99) for j in range(k)])
    start = np.log(low / (1 - low))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    rows = np.arange(n)

    def grad(p: np.ndarray) -> np.ndarray:
        w, raw = p[:-k], p[-k:]
        theta = np.concatenate([[-np.inf], thresholds_of(raw), [np.inf]])
        s = x.dot(w)
        c = _sigmoid(theta[None, :] - s[:, None])
        prob = np.maximum(c[rows, grades + 1] - c[rows, grades], 1e-9)
        d = c * (1 - c)
        up, down = d[rows, grades + 1], d[rows, grades]
        by_x = (up - down) / prob / n  # of -log p, through s
        by_theta = np.zeros((n, k + 2))
        by_theta[rows, grades + 1] -= up / prob / n
        by_theta[rows, grades] += down / prob / n
        t = by_theta.sum(0)[1:-1]
        tail = np.cumsum(t[::-1])[::-1]
        by_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        return np.concatenate([x.back(by_x) + l2 * w, by_raw])

    p = adam(np.concatenate([np.zeros(len(x.used)), raw]), grad, rounds, rate)
    return Ordinal(dense(x.used, p[:-k]), thresholds_of(p[-k:]))


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, mark): the grade of every rated id."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), grade.alias("mark"))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Ordinal:
    rows = sample(docs, ratings(labels), limit)
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))


def _score(shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in sliced(whole, "text"):
                t = model.tails(row_sums(features(batch.column("text")), model.weights, scaled=True))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("text"), pa.array(t.sum(1)), pa.array(t[:, 0])], names=["_row", "text", "_grade", "_tail"])

    return run


def score(docs: DataFrame, model: Ordinal, grade: str = "_grade", tail: str = "_tail") -> DataFrame:
    """``docs`` with the expected grade and the probability of grade 1 or more, under names that ``docs`` doesn't have."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    rows = folded(docs, "text")
    out = rows.mapInArrow(_score(shared), StructType([*rows.schema.fields]).add("_grade", "double").add("_tail", "double"))
    return out.select(*unfolded(docs.columns, text=F.col("text")), F.col("_grade").alias(grade), F.col("_tail").alias(tail))


def select(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that reach grade 1 with probability ``keep`` or more; same columns."""
    names = [fresh(n, docs.columns) for n in ("_grade", "_tail")]
    return score(docs, train(docs, labels), *names).where(F.col(names[1]) >= keep).select(*quoted(docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and decision for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select(
        "doc_id", F.col("_grade").alias("expected_grade"), F.col("_tail").alias("p_keep"), (F.col("_tail") >= KEEP).alias("kept")
    )
