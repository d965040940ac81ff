"""Analytic shapes, kernels and joins on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.operators import closure, network, quadtree, rects, solve, spatial


def resistance_of(spark, rectangles, cell, left, right):
    r = spark.createDataFrame(rectangles, "id long, x0 double, y0 double, x1 double, y1 double").selectExpr("id", "'M1' physical", "0 component", "1.0D r_sheet", "x0", "y0", "x1", "y1")
    cells = network.grid_rects(r, cell, 1000)
    nodes = network.nodes_of(cells)
    ends = nodes.where((F.col("x") == left) | (F.col("x") == right)).select("component", "node", F.when(F.col("x") == left, 1.0).otherwise(0.0).alias("value"))
    return solve.resistance(network.fv_edges(cells), ends).first()["r"]


@pytest.mark.parametrize("w,h,want", [(10, 10, 1.0), (20, 10, 2.0), (10, 1, 10.0), (40, 4, 10.0)])
def test_bars(spark, w, h, want):
    assert resistance_of(spark, [(1, 0.0, 0.0, float(w), float(h))], 1.0, 0.0, float(w)) == pytest.approx(want, rel=1e-9)


def test_two_rectangles_side_by_side_share_their_side(spark):
    assert resistance_of(spark, [(1, 0.0, 0.0, 5.0, 5.0), (2, 5.0, 0.0, 10.0, 5.0)], 1.0, 0.0, 10.0) == pytest.approx(2.0, rel=1e-9)


def test_isolated_part_is_open(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0), (0, 3, 4, 1.0)], "component int, a long, b long, g double")
    t = spark.createDataFrame([(0, 1, 1.0), (0, 4, 0.0)], "component int, node long, value double")
    assert solve.resistance(e, t).first()["r"] == float("inf")


def test_distributed_solver_agrees_with_local_one(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1, float(rng.uniform(0.5, 2))) for i in range(12)] + [(0, 7, 1.0), (3, 10, 0.5)]
    e = spark.createDataFrame(edges, "a long, b long, g double")
    f = spark.createDataFrame([(0, 1.0), (12, 0.0)], "node long, value double")
    far = {r.node: r.u for r in solve.distributed_cg(e, f, tol=1e-10).collect()}
    near = {r.node: r.u for r in solve.solve_components(e.withColumn("component", F.lit(0)), f.withColumn("component", F.lit(0))).collect()}
    assert far.keys() == near.keys() and all(abs(far[k] - near[k]) < 1e-8 for k in far)


def test_solvers_refuse_to_stop_early(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "a long, b long, g double")
    f = spark.createDataFrame([(0, 1.0), (40, 0.0)], "node long, value double")
    with pytest.raises(ValueError, match="did not converge"):
        solve.distributed_cg(e, f, most=8)
    assert {r.node: r.u for r in solve.distributed_cg(e, f).collect()}[20] == pytest.approx(0.5, abs=1e-10)
    flat = f.withColumn("value", F.lit(0.0))
    assert all(r.u == 0 for r in solve.distributed_cg(e, flat).collect())


def test_pcg_and_incomplete_cholesky():
    n = 30
    i = np.concatenate([np.arange(n), np.arange(n - 1), np.arange(1, n)])
    j = np.concatenate([np.arange(n), np.arange(1, n), np.arange(n - 1)])
    v = np.concatenate([np.full(n, 2.5), np.full(2 * n - 2, -1.0)])
    b = np.ones(n)
    x = solve.pcg(n, i, j, v, b)
    assert np.allclose(np.bincount(i, v * x[j], n), b)
    low = j <= i
    by = np.lexsort((j[low], i[low]))
    start, l = solve.incomplete_cholesky(n, i[low][by], j[low][by], v[low][by])
    assert start[-1] == len(l) and (l[[start[k + 1] - 1 for k in range(n)]] > 0).all()


def test_four_vias_make_one(spark):
    v = spark.createDataFrame([(0.1 * k, 0.0, 4.0, 0.0, 0.0) for k in range(4)], "x double, y double, r double, hx double, hy double")
    assert network.group_vias(v, 1.0, []).first()["r"] == pytest.approx(1.0, abs=1e-12)
    assert network.group_vias(v.withColumn("x", F.col("x") * 1000), 1.0, []).count() == 4


def test_closure(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (3, 1), (8, 2), (None, 4)], "a long, b long")
    assert {(r.node, r.component) for r in closure.components(e).collect()} == {(1, 1), (3, 1), (4, 1), (5, 1), (2, 2), (8, 2), (9, 2)}
    assert closure.components(e.limit(0)).count() == 0
    path = spark.range(60).selectExpr("id a", "id + 1 b")
    assert closure.components(path).where("component <> 0").count() == 0


def test_rectangles():
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    left = rects.difference(ring, [hole])
    assert sum((c - a) * (d - b) for a, b, c, d in left) == 12 and len(left) == 4
    assert rects.intersection(ring, hole) == [(1, 1, 3, 3)]
    assert rects.difference(ring, []) == [(0, 0, 4, 4)] and rects.difference([(0, 0), (1, 1)], []) == []


def test_stacked_boxes_do_not_touch_but_neighbours_do(spark):
    r = spark.createDataFrame([(1, "a", 0.0, 0.0, 2.0, 2.0), (2, "a", 0.0, 2.0, 2.0, 4.0), (3, "a", 2.0, 0.0, 4.0, 2.0)], "id long, layer string, x0 double, y0 double, x1 double, y1 double")
    assert {(p.a, p.b) for p in spatial.overlap_pairs(r, 1.5).collect()} == {(1, 3)}
    assert {(p.a, p.b) for p in spatial.overlap_pairs(r, 1.5, touch_all_sides=True).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(2)
    pts, nodes = rng.uniform(-50, 50, (40, 2)), rng.uniform(-50, 50, (15, 2))
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "id long, x double, y double")
    n = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(nodes)], "id long, x double, y double")
    want = ((pts[:, None] - nodes[None]) ** 2).sum(2).argmin(1)
    assert {r.point: r.node for r in spatial.nearest(p, n, 2.0).collect()} == dict(enumerate(want.tolist()))
    assert spatial.nearest(p, n.limit(0), 2.0).count() == 0


def test_refinement_around_a_spot(spark):
    sheet = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    spot = spark.createDataFrame([(1, 7.3, 7.7, 3.0)], "id long, x double, y double, r double")
    leaves = quadtree.refine_around(quadtree.base_cells(sheet, 1.0), spot, 4, 1.0)
    assert leaves.where("x0 <= 7.3 and 7.3 <= x1 and y0 <= 7.7 and 7.7 <= y1").select("level").first()["level"] == 4
    assert leaves.agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)"))).first()[0] == pytest.approx(100.0)
