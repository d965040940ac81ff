"""Nearest neighbours and matching in order against plain walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.fixtures import view
from sheetspark.operators import spatial


def places(rng, n, kind):
    if kind == "lattice":  # many ties
        return rng.integers(-9, 9, (n, 2)).astype(float)
    if kind == "far":  # two lumps far apart
        return rng.normal(size=(n, 2)) + np.where(rng.random(n) < 0.5, -3e4, 5e3)[:, None]
    return rng.uniform(-40, 60, (n, 2))


def table(spark, xy, keys=None, ids=None):
    ids = range(len(xy)) if ids is None else ids
    keys = [0] * len(xy) if keys is None else keys
    return spark.createDataFrame([(int(i), float(x), float(y), int(k)) for i, (x, y), k in zip(ids, xy, keys)], "id long, x double, y double, k int")


@pytest.mark.parametrize("kind", ["lattice", "far", "even"])
def test_nearest_in_every_layer(spark, kind):
    rng = np.random.default_rng(len(kind))
    p, n = places(rng, 120, "even" if kind == "far" else kind), places(rng, 90, kind)
    pk, nk = rng.integers(0, 4, len(p)), rng.integers(0, 3, len(n))
    n[:5], nk[:5] = n[5:10], nk[5:10]  # nodes at one place
    got = {r.point: (r.node, r.d2) for r in spatial.nearest(table(spark, p, pk), table(spark, n, nk), 2.0, ["k"], "left").collect()}
    inner = {r.point: (r.node, r.d2) for r in spatial.nearest(table(spark, p, pk), table(spark, n, nk), 2.0, ["k"]).collect()}
    close = {r.point: r.node for r in spatial.nearest(table(spark, p, pk), table(spark, n, nk), 2.0, ["k"], within=3.5).collect()}
    assert len(got) == len(p)
    for i, (x, k) in enumerate(zip(p, pk)):
        own = [(float((x[0] - a[0]) * (x[0] - a[0]) + (x[1] - a[1]) * (x[1] - a[1])), j) for j, (a, b) in enumerate(zip(n, nk)) if b == k]
        want = min(own) if own else (None, None)
        assert got[i] == (want[1], want[0])
        assert inner.get(i, (None, None)) == got[i]
        assert close.get(i) == (want[1] if own and want[0] <= 3.5**2 else None)


def test_nearest_without_nodes_or_places(spark):
    p = table(spark, [(1.0, 1.0)])
    none = p.limit(0)
    assert spatial.nearest(p, none, 1.0).count() == 0
    assert [tuple(r) for r in spatial.nearest(p, none, 1.0, how="left").collect()] == [(0, None, None)]
    assert spatial.nearest(none, p, 1.0, how="left").count() == 0
    lost = spark.createDataFrame([(5, None, 1.0, 0)], "id long, x double, y double, k int")
    assert [tuple(r) for r in spatial.nearest(lost, p, 1.0, how="left").collect()] == [(5, None, None)]
    assert spatial.nearest(p, lost, 1.0).count() == 0


def in_order(g, f, gk, fk, most):
    free, out = set(range(len(f))), []
    for i in range(len(g)):
        d = [(float((g[i][0] - f[j][0]) * (g[i][0] - f[j][0]) + (g[i][1] - f[j][1]) * (g[i][1] - f[j][1])), j) for j in free if gk[i] == fk[j]]
        if d and (most is None or min(d)[0] <= most * most):
            free.discard(min(d)[1])
            out.append((i, min(d)[1]))
    return out


@pytest.mark.parametrize("kind,most", [("lattice", None), ("lattice", 4.0), ("even", 15.0), ("far", None)])
def test_matching_is_that_of_the_walk_in_order(spark, kind, most):
    rng = np.random.default_rng(17)
    g, f = places(rng, 60, kind), places(rng, 45, kind)
    got = spatial.greedy_match(table(spark, g), table(spark, f), (), most).collect()
    zero = np.zeros(60, int)
    assert sorted((r.golden, r.found) for r in got) == in_order(g, f, zero, zero, most)
    gk, fk = rng.integers(0, 3, 60), rng.integers(0, 3, 45)
    got = spatial.greedy_match(table(spark, g, gk), table(spark, f, fk), ["k"], most).collect()
    assert sorted((r.golden, r.found) for r in got) == in_order(g, f, gk, fk, most)


def test_matching_of_rows_at_one_place_and_of_nothing(spark):
    g, f = table(spark, [(0.0, 0.0)] * 6), table(spark, [(float(i), 0.0) for i in range(4)])
    assert sorted((r.golden, r.found, r.d) for r in spatial.greedy_match(g, f).collect()) == [(i, i, float(i)) for i in range(4)]
    assert spatial.greedy_match(g, f.limit(0)).count() == 0 == spatial.greedy_match(g.limit(0), f).count()
    lost = g.withColumn("x", F.lit(None).cast("double"))
    assert spatial.greedy_match(lost, f).count() == 0


def _broadcast(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_exploded_tables_are_not_broadcast(spark, sf_dir):
    """Spark takes cells for as small as the file that they are made of; broadcast, they fill the driver."""
    from sheetspark.operators import fields, quadtree, rings, solve
    from sheetspark.plans import queries, shapes

    r = view(spark, sf_dir, "f_rect")
    assert not _broadcast(spatial.grid_join(r, r, 64.0))
    leaves = quadtree.base_cells(r, 5.0)
    assert not _broadcast(quadtree.refine(leaves, leaves, 3))
    assert not _broadcast(quadtree.hanging(leaves))
    for name in ("hanging_nodes", "quad_refine_levels", "grid_mesh_counts", "hex_mesh_counts", "terminal_role_lookup", "rect_difference", "polygon_contains"):
        assert not _broadcast(queries.QUERIES[name](spark, sf_dir)), name
    edges = rings.edges_of(shapes.shapes(spark, sf_dir), ["layer"])
    assert not _broadcast(rings.connected(edges, 64.0))
    e = spark.range(10).select(F.lit(1).alias("key"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("g"))
    u = spark.range(11).select(F.lit(1).alias("key"), F.col("id").alias("node"), F.lit(0.0).alias("u"))
    assert not _broadcast(fields.edge_drops(e, u)) and not _broadcast(solve.power(e, u, "key"))


def test_rows_are_dealt_by_what_becomes_of_them(spark):
    from sheetspark.storage import spread

    few = spark.range(100).coalesce(1)
    assert spread(few, F.lit(1)).rdd.getNumPartitions() == 1
    assert spread(few, F.lit(10), 100).rdd.getNumPartitions() == 10
    assert sorted(r.id for r in spread(few, F.lit(10), 100).collect()) == list(range(100))


def test_boxes_at_one_place_all_answer(spark):
    p = spark.createDataFrame([(k, 1.0 * (k % 2), 0.0) for k in range(6)] + [(6, None, 0.0), (7, None, 0.0)], "id long, x double, y double")
    n = spark.createDataFrame([(10, 0.2, 0.0), (11, 90.0, 0.0)], "id long, x double, y double")
    got = {r.point: (r.node, r.d2) for r in spatial.nearest(p, n, 1.0, how="left").collect()}
    assert {k: v[0] for k, v in got.items()} == {**dict.fromkeys(range(6), 10), 6: None, 7: None}
    b = p.withColumns({"hx": F.lit(0.5), "hy": F.lit(0.5)})
    assert {(r.box, r.node) for r in spatial.footprint_nodes(b, n, 1.0).collect()} == {*((k, 10) for k in range(6)), (6, None), (7, None)}


def test_rounds_of_matching_leave_no_table_to_a_broadcast(spark, monkeypatch):
    from sheetspark import storage

    plans, keep = [], storage.keep
    monkeypatch.setattr(storage, "keep", lambda df, name: plans.append((name, _broadcast(df))) or keep(df, name))
    monkeypatch.setattr(spatial, "FEW", -1)
    rng = np.random.default_rng(5)
    g, f = places(rng, 40, "lattice"), places(rng, 30, "lattice")
    got = spatial.greedy_match(table(spark, g), table(spark, f), (), 4.0).collect()
    zero = np.zeros(40, int)
    assert sorted((r.golden, r.found) for r in got) == in_order(g, f, zero, zero, 4.0)
    assert {"asked", "held", "again"} <= {n for n, _ in plans} and not [n for n, b in plans if b]
