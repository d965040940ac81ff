"""Every column of the fingerprint query against plain Python over the same order of documents."""

import hashlib

from sheetspark.llm import fingerprint


def test_likeness_and_edited_columns(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(texts)
    after = dict(zip(order, order[1:] + order[:1]))
    edited = {}
    for i in order:
        half = len(texts[i]) // 2
        edited[i] = texts[i][: len(texts[i]) - half] + texts[after[i]][:half]
    got = {r.doc_id: r for r in fingerprint.op9(spark, sf_dir).collect()}
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    assert sorted(got) == order
    for i, r in got.items():
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r.edited_fingerprint == prints[i]
        assert r.near_edited == fingerprint.likeness(r.fingerprint, prints[i]) and r.near_next == fingerprint.likeness(r.fingerprint, got[after[i]].fingerprint)
    same = {}
    for i, r in got.items():
        assert same.setdefault(texts[i], r.fingerprint) == r.fingerprint


def test_likeness_is_near_the_weighted_jaccard_similarity(spark, sf_dir):
    """Texts against their halves: the mean error of 128 samples stays small."""
    from collections import Counter

    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 2000 and 9000").limit(40).collect()]
    cut = [(i, t[: len(t) * (2 + i % 7) // 9]) for i, t in rows]
    of = lambda rows: {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole, part = of(rows), of(cut)
    errors = []
    for (i, a), (_, b) in zip(rows, cut):
        x, y = shingles(a), shingles(b)
        truth = sum((x & y).values()) / sum((x | y).values())
        errors.append(fingerprint.likeness(whole[i], part[i]) - truth)
    assert len(errors) > 20 and abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.2
