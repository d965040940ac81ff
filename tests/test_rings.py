"""Tests on rings against plain walks along them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.operators import rings
from sheetspark.plans import sheet_rds

RING = "id long, layer string, points array<struct<x:double,y:double>>"


def plain_inside(ring, x, y):
    inside = False
    for (xi, yi), (xj, yj) in zip(ring, ring[-1:] + ring[:-1]):
        if (yi > y) != (yj > y) and x < xi + (y - yi) / (yj - yi) * (xj - xi):
            inside = not inside
    return inside


def plain_ranges(ring, y):
    xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1]) if (a[1] <= y < b[1]) or (b[1] <= y < a[1]))
    return list(zip(xs[::2], xs[1::2]))


def plain_connected(p, q, eps=1e-12):
    if len(p) < 3 or len(q) < 3:
        return False
    ys = sorted({y for _, y in p + q})
    for lo, hi in zip(ys[:-1], ys[1:]):
        y = 0.5 * (lo + hi)
        if any(min(a1, b1) - max(a0, b0) > -eps for a0, a1 in plain_ranges(p, y) for b0, b1 in plain_ranges(q, y)):
            return True
    return False


def some_rings(rng, n):
    out = []
    for k in range(n):
        m, (cx, cy) = int(rng.integers(3, 12)), rng.integers(0, 14, 2)
        angle = np.sort(rng.random(m)) * 2 * np.pi
        radius = rng.uniform(0.5, 4, m)
        ring = np.round(np.stack([cx + radius * np.cos(angle), cy + radius * np.sin(angle)], 1) * 2) / 2  # corners on a lattice: many touch
        out.append([tuple(map(float, p)) for p in ring] + ([tuple(map(float, ring[0]))] if k % 4 == 0 else []))
    return [*out, [], [(1.0, 1.0)], [(0.0, 0.0), (5.0, 5.0)]]


@pytest.fixture(scope="module")
def drawn(spark):
    shapes = some_rings(np.random.default_rng(5), 60)
    df = spark.createDataFrame([*((i, f"m{i % 2}", r) for i, r in enumerate(shapes)), (900, "m0", None), (901, None, shapes[0])], RING)
    return shapes, df


@pytest.mark.parametrize("cell", [0.7, 5.0])
def test_points_in_rings(spark, drawn, cell):
    shapes, df = drawn
    spots = [(x / 2, y / 2) for x in range(-4, 34, 2) for y in range(-3, 33, 3)] + [(x + 0.25, y + 0.25) for x in range(9) for y in range(9)]
    p = spark.createDataFrame([(i, float(x), float(y), f"m{i % 3}") for i, (x, y) in enumerate(spots)], "id long, x double, y double, layer string")
    got = {(r.point, r.id) for r in rings.contains(p, rings.edges_of(df, ["layer"]), cell, ["layer"]).collect()}
    want = {(i, k) for i, (x, y) in enumerate(spots) for k, r in enumerate(shapes) if i % 3 == k % 2 and len(r) > 2 and plain_inside(r, x, y)}
    assert got == want and len(want) > 50
    first = {r.point: r.id for r in rings.first_containing(p, rings.edges_of(df, ["layer"]), cell, ["layer"]).collect()}
    assert first == {i: min(k for j, k in want if j == i) for i, _ in want}


def test_points_at_one_place_ask_once(spark, monkeypatch):
    box = spark.createDataFrame([(7, "m", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (8, "m", [(1.0, 1.0), (3.0, 1.0), (1.0, 3.0)])], RING)
    p = spark.range(600).select("id", (F.col("id") % 3 + 0.5).alias("x"), F.when(F.col("id") < 590, 1.25).alias("y"), F.lit("m").alias("layer"))
    sizes, join = [], rings.spatial.grid_join
    monkeypatch.setattr(rings.spatial, "grid_join", lambda left, *a, **k: (sizes.append(left.where("y is not null").count()), join(left, *a, **k))[1])
    got = rings.contains(p, rings.edges_of(box, ["layer"]), 2.0, ["layer"])
    assert sorted(map(tuple, got.collect())) == sorted((i, r) for i in range(590) for r in (7, 8) if r == 7 or i % 3 in (1, 2) and i % 3 + 0.5 < 2.75)
    assert sizes == [3]


@pytest.mark.parametrize("cell", [0.7, 5.0])
def test_rings_that_meet(spark, drawn, cell):
    shapes, df = drawn
    got = {(r.a, r.b) for r in rings.connected(rings.edges_of(df, ["layer"]), cell).collect()}
    assert got == {(i, j) for i, p in enumerate(shapes) for j, q in enumerate(shapes) if i < j and i % 2 == j % 2 and plain_connected(p, q)}


def test_gaps_about_the_tolerance_and_stacked_sides(spark):
    box = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    df = spark.createDataFrame([(1, "m", box(0.0, 0.0)), (2, "m", box(1.0 + 5e-13, 0.5)), (3, "m", box(-1.0 - 3e-12, 0.0)), (4, "m", box(0.0, 1.0))], RING)
    assert {(r.a, r.b) for r in rings.connected(rings.edges_of(df, ["layer"]), 1.0).collect()} == {(1, 2), (2, 4)}


def test_plan_tests_slanted_polygons_by_their_rings(spark):
    shapes = [(1, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]), (2, [(4.0, 8.0), (4.0, 9.0), (3.0, 9.0)]), (3, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]), (4, [(3.7, 8.0), (6.0, 8.0), (6.0, 12.0), (3.7, 12.0)])]
    p = spark.createDataFrame([(i, "net_M1", "M1", r) for i, r in shapes], "id long, logical string, physical string, points array<struct<x:double,y:double>>")
    parts = sheet_rds.pieces(p)
    assert {tuple(r) for r in sheet_rds.met(parts, 4.0).select("a", "b").collect()} > {(1, 2)}  # steps of slanted sides overlap
    assert {tuple(r) for r in sheet_rds.met(parts, 4.0, p).select("a", "b").collect()} == {(1, 3), (2, 4)}
    assert sheet_rds.met(parts.where(F.col("id") > 2), 4.0, p.where("id > 2")).count() == 0
