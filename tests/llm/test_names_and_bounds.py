"""Extra columns with names that the stages use themselves, and samples that stay bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.llm import features, jaccard, mixing, pii, quality
from sheetspark.llm.storage import fresh

NAMES = ["_grade", "_TAIL", "_src", "_tok", "_h", "_d1", "_d2", "copies", "_pass", "_full", "_rest", "_end_d1", "_left_d1", "_row", "_id", "key", "label", "component_id", "n_shingles", "row", "slot", "k", "with.dot"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some plain words of text number {i} and then {i * 7} more of them", "en", f"s{i % 2}", 10, *[100 * i + j for j in range(len(NAMES))]) for i in range(12)]
    rows += [(12, None, None, None, None, *[j for j in range(len(NAMES))]), (3, *rows[3][1:5], *[j for j in range(len(NAMES))])]
    schema = "doc_id int, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(2)


def stages(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    return {"quality": lambda d: quality.select(d, labels, 0.0), "join": jaccard.survivors, "pii": pii.redact, "mix": mixing.mix}


@pytest.mark.parametrize("name", ["quality", "join", "pii", "mix"])
def test_extra_columns_keep_names_and_values(spark, clashing, name):
    out = stages(spark)[name](clashing)
    assert out.columns == clashing.columns and dict(out.dtypes) == dict(clashing.dtypes)
    had = {tuple(r[5:]) for r in clashing.collect()}
    got = [tuple(r[5:]) for r in out.collect()]
    assert got and set(got) <= had
    if name in ("quality", "pii"):
        assert sorted(got) == sorted(tuple(r[5:]) for r in clashing.collect())


def test_fresh_names():
    assert fresh("a", ["A", "a_"]) == "a__" and fresh("b", ["a"]) == "b"


def test_a_sample_has_one_text_for_an_id_and_a_bounded_number_of_features(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 5, f"text {i} " + "word" * (i % 3)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, mark int")
    rows = features.sample(docs, labels, 4)
    assert len(rows) == 4 == len({r[0] for r in rows})
    assert [(r[0], r[1], r[2].tolist()) for r in rows] == [(r[0], r[1], r[2].tolist()) for r in features.sample(docs.repartition(7), labels, 4)]
    monkeypatch.setattr(features, "FEATURES", sum(len(r[2]) for r in rows) - 1)
    assert 0 < len(features.sample(docs, labels, 4)) < 4


def test_copies_follow_a_plain_plan(spark):
    """The mix against the same plan in plain Python: whole passes, then a prefix of the rows in keyed order."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 30))), f"s{min(int(r.geometric(0.4)), 4)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.copies for x in mixing.plan(docs, seed=3)[0].collect()}
    hashed = {x.doc_id: x.h for x in docs.select("doc_id", F.xxhash64(F.lit(3), "doc_id", "text").alias("h")).collect()}
    tokens = {i: len(t.split()) for i, t, _ in rows}
    by = {s: [i for i, _, x in rows if x == s] for s in {x[2] for x in rows}}
    share = {s: sum(tokens[i] for i in ids) / sum(tokens.values()) for s, ids in by.items()}

    def mixed(a):
        q = {s: p**a for s, p in share.items()}
        return {s: x / sum(q.values()) for s, x in q.items()}

    def fits(a):
        w, plain = mixed(a), lambda w: -sum(x * np.log(x) for x in w.values())
        return plain(w) <= 0.5 * (plain(mixed(0)) + plain(mixed(1))) + 1e-12 and max(w[s] / share[s] for s in w) <= mixing.MAX_REPEATS

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    for s, ids in by.items():
        budget, whole = mixed(high)[s] * sum(tokens.values()), sum(tokens[i] for i in ids)
        block = lambda i: (hashed[i] % 1024, (hashed[i] % 2**64 >> 20) % 1024, hashed[i], i)
        rest, at, want = round(budget) % whole, 0, {}
        for i in sorted(ids, key=block):
            at += tokens[i]
            want[i] = int(budget + 0.5) // whole + (at <= rest)
        differ = [i for i in ids if want[i] != got[i]]
        assert len(differ) <= 1  # a budget rounded at its last token
