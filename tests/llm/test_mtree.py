"""The tree and the search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.llm import mtree


def plain(rows, k=10, every=100):
    """Sorted (query_id, rank, vec_id, score)."""
    good = sorted({(i, tuple(math.floor(1024 * float(c)) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for i, q in good:
        if i % every == 0:
            hits = sorted((-min(max(sum(a * b for a, b in zip(q, v)), mtree.LOW), mtree.HIGH), j) for j, v in good if len(v) == len(q) and (j, v) != (i, q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits[:k])]
    return sorted(out)


def over(spark, rows, tmp_path, kind="array<double>"):
    spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding {kind}, label int, vec string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in mtree.op12(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small_pages(monkeypatch):
    """Several shards, deep trees and several tasks a shard already on small tables."""
    for name, value in {"SHARD_ROWS": 150, "SHARD_BYTES": 256 * 4 * 8, "LEAF": 8, "FANOUT": 4, "CHUNK": 3}.items():
        monkeypatch.setattr(mtree, name, value)


def test_clusters_ties_and_copies(spark, tmp_path, small_pages):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 4))
    rows = [(i, (centres[i % 9] + 0.1 * rng.normal(size=4)).round(3).tolist()) for i in range(1500)]
    rows += [(2000 + i, [0.5, 0.5, -0.25, 1.0]) for i in range(700)]  # one vector for a third of all, with queries among them
    rows += [(3000 + i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(60)]
    assert over(spark, rows, tmp_path) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [5.0, -1.0]), (100, None), (200, [float("nan"), 1.0]), (300, [None, 1.0]), (400, [float("inf"), 1.0]), (500, []), (501, []), (600, [1.0]), (None, [9.0, 9.0]), (700, [3e30, 1.0]), (701, [-3e30, 1e-5]), (702, [3e30, 0.0]), (800, [0.0, 0.0]), (900, [1e12, 7.5]), (901, [1e12 + 3, -7.5])]
    got = over(spark, rows, tmp_path)
    assert got == plain(rows)
    assert {q for q, *_ in got} == {0, 500, 700, 800, 900}


def test_floats_and_an_empty_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=16)).tolist()) for i in range(300)]
    assert over(spark, rows, tmp_path, "array<float>") == plain(rows)
    assert mtree.top_k(*[spark.createDataFrame([], "id long, vec array<double>")] * 2).count() == 0


def test_bounds_hold_and_save_products():
    rng = np.random.default_rng(3)
    x = np.floor(1024 * np.concatenate([c + 0.02 * rng.normal(size=(200, 8)) for c in rng.normal(size=(30, 8))]))
    pivot = x.mean(0)
    pages = mtree.bulk_load(x, [[i] for i in range(len(x))], pivot, np.random.default_rng(0))
    assert len(pages) > 100 and all(len(p["objects"]) <= max(mtree.LEAF, mtree.FANOUT) for p in pages)
    import pandas as pd

    rows = [{"page": n, "leaf": p["leaf"], "n": len(p["objects"]), **{c: p[c].tobytes() for c in ("objects", "radii", "distances", "children")}, "ids": p["ids"]} for n, p in enumerate(pages)]
    tree = mtree.Tree.read(pd.DataFrame(rows), pivot)

    def under(n):
        p = pages[n]
        return p["objects"] if p["leaf"] else np.concatenate([under(c) for c in p["children"]])

    for p in pages:
        if not p["leaf"]:
            for c, o, r in zip(p["children"], p["objects"], p["radii"]):
                assert mtree.distances(under(c), o).max() <= r + 1e-6
    seen = []
    for q in x[::500]:
        want = sorted(((-int(s), i) for i, s in enumerate((x @ q).tolist())))[:10]
        assert [(-s, i) for s, i, _ in tree.search(q, 10, seen=seen)] == want
    assert np.mean(seen) < len(x) / 2


def test_query_is_the_same_as_duckdb(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = mtree.op12(spark, sf_dir).select("query_id", "rank", "vec_id", "score").toPandas()
    want = con.sql(mtree.OP12_SQL).df()
    assert dict(got.dtypes) == dict(want.dtypes)
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want[list(got.columns)].itertuples(index=False, name=None))


def test_a_search_asks_for_no_more_than_the_index_has(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vec array<double>")
    index = mtree.MTree(rows, 3)
    with pytest.raises(ValueError):
        index.search(rows.withColumnRenamed("id", "q"), 5)
    assert {r["q"]: [x["id"] for x in r["results"]] for r in index.search(rows.withColumn("q", F.col("id")), 4).collect()} == {1: [2, 1], 2: [2, 1]}


def test_queries_that_go_down_together_open_a_page_once():
    import pandas as pd

    class Opened(dict):
        times = 0

        def __getitem__(self, key):
            self.times += 1
            return super().__getitem__(key)

    rng = np.random.default_rng(4)
    x = np.floor(1024 * np.concatenate([c + 0.1 * rng.normal(size=(100, 8)) for c in rng.normal(size=(20, 8))]))
    x[7] *= 2.0**45  # its products with itself are beyond what doubles and longs hold
    pages = mtree.bulk_load(x, [[i, 5000 + i] for i in range(len(x))], x[0], np.random.default_rng(0))
    rows = [{"page": n, "leaf": p["leaf"], "n": len(p["objects"]), **{c: p[c].tobytes() for c in ("objects", "radii", "distances", "children")}, "ids": p["ids"]} for n, p in enumerate(pages)]
    tree = mtree.Tree.read(pd.DataFrame(rows), x[0])
    tree.pages = Opened(tree.pages)
    asked = [*range(0, 2000, 10), 7]
    whole = [[int(c) for c in v] for v in x.tolist()]
    want = []
    for i in asked:
        scores = [min(mtree.HIGH, max(mtree.LOW, sum(a * b for a, b in zip(whole[i], v)))) for v in whole]
        want.append(sorted([(s, j + more, bool((x[j] == x[i]).all())) for j, s in enumerate(scores) for more in (0, 5000)], key=lambda t: (-t[0], t[1]))[:11])
    assert tree.search_all(x[asked], 11, [mtree.LOW] * len(asked)) == want
    assert tree.pages.times <= len(pages)
    floors = [w[4][0] for w in want]
    assert tree.search_all(x[asked], 11, floors) == [[h for h in w if h[0] >= f] for w, f in zip(want, floors)]
