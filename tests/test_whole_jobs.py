"""Cases in which less than the whole job was done once."""

import pytest
from pyspark.sql import functions as F

from sheetspark.fixtures import view
from sheetspark.operators import quadtree
from sheetspark.plans import queries, sheet_rds


def test_queries_of_whole_tables(spark, sf_dir):
    n = {t: view(spark, sf_dir, t).count() for t in ("f_rect", "f_via")}
    run = lambda name: queries.QUERIES[name](spark, sf_dir)
    assert run("gds_roundtrip").count() == n["f_rect"]
    assert run("quad_refine_levels").select("id").distinct().count() == n["f_rect"]
    assert run("hanging_nodes").count() == n["f_rect"]
    assert run("footprint_nodes").select("box").distinct().count() == n["f_via"]


def test_every_rectangle_is_balanced(spark, sf_dir):
    r = view(spark, sf_dir, "f_rect").where("id <= 40").select("id", "x0", "y0", "x1", "y1")
    leaves = queries.balanced(r)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    parts = {x.poly: x.a for x in leaves.groupBy("poly").agg(F.sum(area).alias("a")).collect()}
    assert parts == pytest.approx({x.id: x.a for x in r.select("id", area.alias("a")).collect()})
    assert leaves.groupBy("poly").agg(F.max("level").alias("m")).where("m <> 4").count() == 0
    assert quadtree.neighbours(leaves, 5.0).where("abs(level_a - level_b) > 1").count() == 0


def comb(x, teeth=3):
    """A comb open to the right whose teeth are at y = 0, 4, 8, .. beside a spine at ``x``."""
    ring = [(x, 0.0), (x, 4.0 * teeth - 3)]
    for k in reversed(range(teeth)):
        ring += [(x + 9, 4.0 * k + 1), (x + 9, 4.0 * k)] + ([(x + 1, 4.0 * k), (x + 1, 4.0 * k - 3)] if k else [])
    return ring


SHAPES = "id long, logical string, physical string, points array<struct<x:double,y:double>>, r_sheet double"
FEET = "id long, bottom string, top string, r double, x double, y double, hx double, hy double"


def test_interlocking_polygons_are_not_one_net(spark):
    left = comb(0.0)
    right = [(10.5 - x, y + 2) for x, y in comb(0.0)]
    shapes = [(1, "net_M1", "M1", left, 1.0), (2, "net_M1", "M1", right, 1.0), (3, "net_M1", "M1", [(9.0, 0.2), (9.2, 0.2), (9.2, 0.8), (9.0, 0.8)], 1.0)]
    p = spark.createDataFrame(shapes, SHAPES)
    v = spark.createDataFrame([], FEET).selectExpr("id", "bottom", "top", "x - hx as x0", "y - hy as y0", "x + hx as x1", "y + hy as y1")
    assert {r.id: r.component for r in sheet_rds.nets(p, v, 4.0).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_via_lands_on_a_polygon_and_not_in_its_box(spark):
    bent = [(0.0, 0.0), (10.0, 0.0), (10.0, 1.0), (1.0, 1.0), (1.0, 10.0), (0.0, 10.0)]
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    p = spark.createDataFrame([(1, "net_M1", "M1", bent, 1.0), (2, "net_M1", "M1", box(4.0, 4.0, 12.0, 12.0), 1.0), (3, "net_M2", "M2", box(4.0, 4.0, 6.0, 6.0), 1.0)], SHAPES)
    v = spark.createDataFrame([(1, "M1", "M2", 4.5, 4.5, 5.5, 5.5)], "id long, bottom string, top string, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.component for r in sheet_rds.nets(p, v, 4.0).collect()} == {1: 1, 2: 2, 3: 2}


def test_vias_of_two_nets_side_by_side_stay_apart(spark):
    box = lambda y0: [(0.0, y0), (10.0, y0), (10.0, y0 + 0.7), (0.0, y0 + 0.7)]
    shapes = [(k, f"net_M{m}", f"M{m}", box(y), 1.0) for k, (m, y) in enumerate([(1, 0.0), (2, 0.0), (1, 0.8), (2, 0.8)])]
    vias = [(1, "M1", "M2", 1.0, 5.0, 0.65, 0.05, 0.05), (2, "M1", "M2", 1.0, 5.0, 0.85, 0.05, 0.05)]
    ends = lambda b: [("D", 1.0, "M1", 0.0, 0.35, 0.0, 0.35), ("S", 0.0, *b)]
    net = lambda b: sheet_rds.build(*(spark.createDataFrame(r, t) for r, t in ((shapes, SHAPES), (vias, FEET), (ends(b), "name string, voltage double, physical string, x double, y double, hx double, hy double"))), 0.5, 100)
    own = sheet_rds.report(net(("M2", 10.0, 0.35, 0.0, 0.35)))[1]
    assert 10 / 0.7 + 0.9 < own < 10 / 0.7 + 3  # one via, not two in parallel, and its own net's nodes
    assert sheet_rds.report(net(("M2", 10.0, 1.15, 0.0, 0.35)))[1] > 1e9


def resistance(spark, polygons, terminals):
    p = spark.createDataFrame(polygons, "id long, logical string, physical string, points array<struct<x:double,y:double>>, r_sheet double")
    v = spark.createDataFrame([], "id long, bottom string, top string, r double, x double, y double, hx double, hy double")
    t = spark.createDataFrame(terminals, "name string, voltage double, physical string, x double, y double, hx double, hy double")
    return sheet_rds.report(sheet_rds.build(p, v, t, 1.0, 100))[1]


def test_overlapping_polygons_of_different_grids_are_stitched(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    two = [(1, "net_M1", "M1", box(0.0, 0.0, 20.0, 4.0), 1.0), (2, "net_M1", "M1", box(19.5, 0.5, 40.0, 3.5), 1.0)]
    ends = [("D", 1.0, "M1", 0.0, 2.0, 0.0, 2.0), ("S", 0.0, "M1", 40.0, 2.0, 0.0, 1.5)]
    # 1 ohm from the first polygon's corner, which the terminal holds, to the second one's corner: no less than both in series
    assert 1 + 20.5 / 3 < resistance(spark, two, ends) < 1 + 20.5 / 3 + 3


def test_a_loose_fragment_of_a_net_is_merged(spark):
    tee = [(0.0, 0.0), (10.0, 0.0), (10.0, 3.0), (6.7, 3.0), (6.7, 6.0), (3.3, 6.0), (3.3, 3.0), (0.0, 3.0)]
    ends = [("D", 1.0, "M1", 5.0, 6.0, 1.7, 0.0), ("S", 0.0, "M1", 5.0, 0.0, 5.0, 0.0)]
    assert 3 / 3.4 + 3 / 10 < resistance(spark, [(1, "net_M1", "M1", tee, 1.0)], ends) < 6
