"""Cases in which less than the whole job was done once."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sheetspark.llm import fingerprint, jaccard, neardup, packing, pii


def weighted_jaccard(a, b):
    return np.minimum(a, b).sum() / np.maximum(a, b).sum()


@pytest.mark.parametrize("first, second", [(1, 2), (1, 3), (2, 5)])
def test_a_sample_has_the_same_bits_at_every_weight(first, second):
    v = fingerprint.Variates(1024)
    rng = np.random.default_rng(3)
    near, true = [], []
    for _ in range(4):
        terms = rng.integers(0, 1 << 63, 600).astype(np.uint64)
        a = np.full(600, first)
        b = np.where(np.arange(600) < 300, second, first)
        near.append((v.signature(terms, a).view(np.uint32) == v.signature(terms, b).view(np.uint32)).mean())
        true.append(weighted_jaccard(a, b))
    assert np.mean(near) == pytest.approx(np.mean(true), abs=0.035)


def tight_group(n, total, dim=64):
    """A group of differing near copies among strangers; within the group most pairs link, not all."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(total, dim))
    x[:n] = x[0] + 0.27 * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def brute(x):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    return (y @ y.T >= neardup.THRESHOLD).sum(1) - 1


def found_links(spark, x):
    df = spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    return {r.vec_id: r for r in neardup.near_duplicates(df).collect()}


def test_a_tight_group_in_many_shards_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TARGET", 100)
    monkeypatch.setattr(neardup, "ATTEMPTS", 1, raising=False)
    monkeypatch.setattr(neardup, "all_pairs", None, raising=False)  # the first search is enough
    x = tight_group(1800, 3600)
    got, true = found_links(spark, x), brute(x)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * true.sum() > 0
    assert all(got[i].n_links <= true[i] for i in range(len(x)))


def test_all_pairs_where_no_search_is_good_enough(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TARGET", 100)
    monkeypatch.setattr(neardup, "ATTEMPTS", 1, raising=False)
    monkeypatch.setattr(neardup, "BLOCK", 150, raising=False)
    monkeypatch.setattr(neardup, "RECALL", 1.1)
    x = tight_group(200, 500)
    got, true = found_links(spark, x), brute(x)
    assert [got[i].n_links for i in range(len(x))] == true.tolist()
    assert all(got[i].component_id == 0 for i in range(200) if true[i])


@pytest.mark.parametrize("key", ["AKIAIOSFODNNEXAMPLE", "sk-abcdefghijklmnopqrstuvwx", "ghp_abcdefghijklmnopqrstuvwx"])
def test_a_key_without_digits_is_read(key):
    raw = [b"nothing here", f"see {key} here".encode()]
    offsets = np.cumsum([0, *map(len, raw)])
    assert pii._KEYLIKE.search(raw[1].decode())
    assert pii.worth_reading(offsets, np.frombuffer(b"".join(raw), np.uint8)).tolist() == [False, True]


def edited(seed, copies, words, edits):
    """Copies of one text, each with words of its own, and strangers."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(100_000 + i, " ".join(f"w{r.randrange(10**6)}" for _ in range(words))) for i in range(50)]


def shingled(rows):
    return {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in rows)}


def brute_components(rows):
    """Smallest id of each component, from all pairs that share a shingle."""
    sets, root = shingled(rows), {i: i for i, _ in rows}
    number = {s: n for n, s in enumerate(sorted(set().union(*sets.values())))}
    dense = np.zeros((len(sets), len(number)), np.float32)
    ids = list(sets)
    for a, i in enumerate(ids):
        dense[a, [number[s] for s in sets[i]]] = 1
    both, size = dense @ dense.T, dense.sum(1)
    link = 100 * both >= 75 * (size[:, None] + size[None, :] - both)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(link, 1))):
        a, b = find(ids[a]), find(ids[b])
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("members", [1024, 128])
def test_thousands_of_near_copies(spark, members):
    rows = edited(5, 2600, 60, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_components(rows)
    assert 60 < len(set(want.values())) < 2000  # one large component, and copies that stay apart from it
    assert {x.doc_id: x.component_id for x in jaccard.join(df, members=members).collect()} == want


def test_each_class_looks_once_for_partners_and_finds_all():
    rows = edited(9, 300, 50, 7)
    sets = [np.sort(np.array([hash(s) & (2**64 - 1) for s in x], np.uint64)) for x in shingled(rows).values()]
    want = brute_components(rows)
    got = jaccard.grouped(sets)
    first = {i: n for n, i in enumerate(want)}
    assert got.tolist() == [first[want[i]] for i in want]
    x = jaccard.indexed(sets)
    for q in range(0, len(sets), 7):
        true = [c for c in range(len(sets)) if 100 * len(both := np.intersect1d(sets[q], sets[c])) >= 75 * (len(sets[q]) + len(sets[c]) - len(both))]
        assert jaccard.partners(x, q, np.ones(len(sets), bool)).tolist() == true


def test_pairs_of_different_blocks_are_compared(spark, monkeypatch):
    """With blocks of one step only, lists hold several blocks and their pairs are compared one by one."""
    monkeypatch.setattr(jaccard, "STEPS", 1)
    chain = []
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    for i in range(120):  # each is like the next, not like those further on
        base[(7 * i) % 80] = f"c{i}"
        chain.append((i, " ".join(base)))
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.join(df, members=2).collect()} == brute_components(chain)


def test_rows_that_share_an_id_are_told_apart(spark):
    r = random.Random(6)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(60)]
    a, b = text(), text()
    near = list(a)
    near[30] = "other"
    rows = [(1, " ".join(a), 0), (2, " ".join(near), 1), (2, " ".join(b), 2), (3, " ".join(b), 3), (5, " ".join(a), 4), (5, " ".join(a), 5), (6, "", 6), (6, "", 7), (None, " ".join(a), 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3)
    left = sorted(x.key for x in jaccard.survivors(df).collect())
    assert left == [0, 2, 6, 7, 8]


def test_blocks_whose_bins_are_badly_filled_still_meet(spark):
    """Pieces of which none fit well together: every level must place some and hand on the rest until one block is left."""
    r = random.Random(8)
    rows = [(i, r.randrange(700, 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid long, length long").withColumn("doc_id", F.col("rid"))
    from sheetspark.llm.storage import keep

    got = packing.pack(keep(df, "lengths"), block=256).toPandas()
    assert sorted(got["rid"]) == list(range(3000))
    got = got.sort_values(["sequence_id", "offset"])
    before = got.groupby("sequence_id")["length"].cumsum() - got["length"]
    assert (before == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= 1500 + 12  # two fit in each; an odd one may be left in a block


def test_a_generation_is_bred_even_from_a_seed_at_the_bound(monkeypatch):
    bred = []
    plain = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: bred.append(1) or plain(*a))
    lengths = np.full(64, 512)
    assert len(np.unique(packing.evolve(lengths, 1, None))) == 16 and bred


def test_candidates_keep_off_base_spans_however_they_overlap():
    text = "call 555-123-4567 or +49 555-123-4567 99 or (555) 123-4567, token=abcdefgh12345678 x@y.org"
    for taken in ([], pii.base_spans(text), [(0, 30, "card"), (2, 6, "ip"), (40, 41, "ip")]):
        free = {s for s in pii.candidates(text, []) if not any(s[0] < y and x < s[1] for x, y, _ in taken)}
        assert set(pii.candidates(text, taken)) == free


def test_decoding_and_marginals_against_all_segmentations():
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(2, 7)
        arcs = [(i, j, y, []) for i in range(n) for j in range(i + 1, n) for y in range(2) if r.random() < 0.5]
        scores = [r.uniform(-2, 2) for _ in arcs]
        ways = [[]]
        for k, (i, j, _, _) in sorted(enumerate(arcs), key=lambda a: a[1][0]):
            ways += [w + [k] for w in ways if not w or arcs[w[-1]][1] <= i]
        total = [sum(scores[k] for k in w) for w in ways]
        assert sum(scores[k] for k in pii.decode(n, arcs, scores)) == pytest.approx(max(total))
        z, p = pii.log_marginals(n, arcs, scores)
        assert z == pytest.approx(np.log(np.exp(total).sum()))
        for k, q in enumerate(p):
            assert q == pytest.approx(sum(np.exp(t) for w, t in zip(ways, total) if k in w) / np.exp(z))


def test_doubles_are_compared_as_doubles(spark):
    c = neardup.THRESHOLD
    above, below = ([c + d, np.sqrt(1 - (c + d) ** 2)] for d in (1e-12, -1e-12))
    rows = [(1, [1.0, 0.0], 0), (2, above, 0), (3, [1.0, 0.0], 1), (4, below, 1), (5, [1e60, 0.0], 2), (6, [3e60, 0.0], 2)]
    df = spark.createDataFrame([(i, [float(v) for v in x], k) for i, x, k in rows], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1}
