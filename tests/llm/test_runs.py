"""Runs against plain enumeration, and the query against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.llm import runs


def plain_runs(w, exponent, shortest):
    """(start, length, period) by trying every period at every place."""
    n, best = len(w), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(shortest, exponent * p):
                best.setdefault((i, j + p), p)  # periods ascend, so the first one of a stretch is its smallest
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


@pytest.mark.parametrize("exponent,shortest", [(2, 2), (3, 1), (4, 6)])
def test_random_words_against_all_periods(exponent, shortest):
    rng = np.random.default_rng(exponent)
    docs = []
    for k in range(300):
        n, letters = int(rng.integers(0, 60)), int(rng.integers(1, 4))
        w = rng.integers(0, letters, n).tolist()
        if k % 3 == 0 and n:
            p = int(rng.integers(1, 6))
            w = (w[:p] * 30)[: int(rng.integers(1, 60))] + w
        if k % 5 == 0:
            w = w + [9] + w + w
        docs.append(w)
    a, b = "a", "ab"
    for _ in range(8):
        a, b = b, b + a
    docs += [[ord(c) for c in b], [1] * 500, ([1, 2, 3, 1, 2] * 20 + [7]) * 5]
    bounds = np.cumsum([0] + [len(d) for d in docs])
    symbols = np.array([1000 * i + x for i, d in enumerate(docs) for x in d], np.int64)
    found = runs.find_runs(symbols, bounds, exponent, shortest)
    for i, d in enumerate(docs):
        own = found[(found[:, 0] >= bounds[i]) & (found[:, 0] < bounds[i + 1])]
        assert sorted((s - bounds[i], e - s, p) for s, e, p in own.tolist()) == plain_runs(d, exponent, shortest), d


def plain_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 4, 6)
    drop = set()
    for s, length, q in found:
        drop.update(range(s + q, s + length))
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *tail, sha("".join(f"{s},{ln},{p}\n" for s, ln, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def query_over(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return runs.op11(spark, str(tmp_path))


def test_query_against_plain_python(spark, sf_dir):
    want = {r.doc_id: plain_query(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 20000").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in runs.op11(spark, sf_dir).collect()}
    assert len(want) > 150 and all(got[i] == w for i, w in want.items())
    assert sum(w[0] > 0 for w in want.values()) > 5


def test_nulls_empties_separators_repeats_and_extra_columns(spark, tmp_path):
    odd = "a\tb\x0bc\x0c a b   " * 9
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, " \t\r\n ", 5, "x"), (None, "la la la la la la", 5, "x"), (4, "one", 5, None), (4, "one", 5, None), (5, odd, 5, "x"), (6, "A a " * 10, 5, "x"), (7, "été " * 7, 5, "x")]
    rows += [(i, "w1 w2 w3 " * 8, 0, "x") for i in range(100, 160)]
    got = query_over(spark, spark.createDataFrame(rows, "doc_id long, text string, start int, collapsed string"), tmp_path).collect()
    assert sorted(map(repr, ((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got))) == sorted(repr((i, *plain_query(i, t))) for i, t, _, _ in rows)


def test_an_empty_table_and_a_very_long_text(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.runs(empty).count() == 0
    long = " ".join(f"w{i % 7000}" for i in range(70_000)) + " end" + " tick tock" * 60_000
    row = runs.runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 70_000, 7000), (70_001, 120_000, 2)]
    assert row["collapsed"] == " ".join(f"w{i}" for i in range(7000)) + " end tick tock"


def test_shorter_exponents_as_an_operator(spark):
    docs = spark.createDataFrame([(1, "x a b a b y z z")], "doc_id long, text string")
    assert [tuple(r) for r in runs.runs(docs, 2, 2).select(F.explode("runs")).select("col.*").collect()] == [(1, 4, 2), (6, 2, 1)]
