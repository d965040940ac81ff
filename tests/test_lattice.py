"""Linear quadtrees against the geometric ones, and adaptive networks over polygons, layers and vias."""

import pytest
from pyspark.sql import functions as F

from sheetspark.operators import adaptive, lattice, network, quadtree
from sheetspark.storage import keep

RECT = "id long, physical string, component int, r_sheet double, x0 double, y0 double, x1 double, y1 double"
VIA = "id long, bottom string, top string, component int, r double, x double, y double, hx double, hy double"
PIN = "name string, voltage double, physical string, x double, y double, hx double, hy double"


@pytest.fixture(scope="module")
def refined(spark):
    """Two rectangles split at random three times."""
    rects = spark.createDataFrame([(1, "M1", 0, 1.0, 0.0, 0.0, 4.0, 3.0), (2, "M1", 0, 1.0, 10.0, 0.0, 12.5, 1.0)], RECT)
    lat = keep(lattice.lattices(rects, 1.0, keep=["physical", "component", "r_sheet"]), "lattices")
    leaves = lattice.base(lat)
    for k in range(4):
        some = leaves.where(F.pmod(F.xxhash64(F.lit(k), *lattice.KEY), F.lit(4)) == 0)
        leaves = keep(lattice.split(leaves, some, 4), "leaves")
    return rects, lat, leaves


def squares(leaves, lat):
    return {(r.poly, r.level, round(r.x0, 9), round(r.y0, 9), round(r.x1, 9), round(r.y1, 9)) for r in lattice.boxes(leaves, lat).collect()}


def test_balance_is_that_of_repeated_refinement(refined):
    _, lat, leaves = refined
    assert lattice.uneven(leaves, 4).count() > 0
    got = keep(lattice.balanced(leaves, lat, 4), "balanced")
    assert lattice.uneven(got, 4).count() == 0
    boxed = lattice.boxes(leaves, lat).withColumn("id", F.xxhash64(*lattice.KEY)).select(*quadtree.CELL)
    want = {(r.poly, r.level, round(r.x0, 9), round(r.y0, 9), round(r.x1, 9), round(r.y1, 9)) for r in quadtree.balance(boxed, 1.0, 4).collect()}
    assert squares(got, lat) == want
    assert squares(lattice.balanced(got, lat, 4), lat) == want
    hung = {(r.poly, round(r.x, 9), round(r.y, 9)) for r in quadtree.hanging(lattice.boxes(got, lat).withColumn("id", F.xxhash64(*lattice.KEY))).collect()}
    mids = {"bottom": ("(x0 + x1) / 2", "y0"), "top": ("(x0 + x1) / 2", "y1"), "left": ("x0", "(y0 + y1) / 2"), "right": ("x1", "(y0 + y1) / 2")}
    at = lattice.boxes(got, lat).join(lattice.hanging(got), lattice.KEY)
    own = {(r.poly, round(r.x, 9), round(r.y, 9)) for s, (x, y) in mids.items() for r in at.where(F.col("side") == s).select("poly", F.expr(x).alias("x"), F.expr(y).alias("y")).collect()}
    assert own == hung and hung


def test_conformed_leaves_have_one_level(refined):
    _, lat, leaves = refined
    levels = {r.poly: (r.low, r.high, r.n) for r in lattice.conformed(leaves, lat).groupBy("poly").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.count("*").alias("n")).collect()}
    finest = {r.poly: r.m for r in leaves.groupBy("poly").agg(F.max("level").alias("m")).collect()}
    cells = {r.poly: r.nx * r.ny for r in lat.collect()}
    assert levels == {p: (m, m, cells[p] * 4**m) for p, m in finest.items()}
    boxed = lattice.boxes(leaves.where("poly = 2"), lat).withColumn("id", F.xxhash64(*lattice.KEY)).select(*quadtree.CELL)
    assert quadtree.conform(boxed, 1.0, 4).count() == levels[2][2]


def test_nothing_to_split_and_no_rectangles(spark, refined):
    rects, lat, _ = refined
    flat = lattice.base(lat)
    assert squares(lattice.balanced(flat, lat, 4), lat) == squares(flat, lat)
    assert squares(lattice.balanced(flat, lat, 0), lat) == squares(flat, lat)
    none = lattice.lattices(rects.limit(0), 1.0)
    assert lattice.balanced(lattice.base(none), none, 3).count() == 0


def resistance(spark, rects, vias, pins, links=(), **more):
    t = lambda rows, schema: keep(spark.createDataFrame(list(rows), schema), "input")
    return adaptive.adaptive_layers(t(rects, RECT), t(vias, VIA), t(pins, PIN), t(links, "a long, b long"), more.pop("cell", 0.5), **more)


def test_two_layers_through_a_via(spark):
    rects = [(1, "M1", 0, 1.0, 0.0, 0.0, 5.0, 1.0), (2, "M2", 0, 1.0, 5.0, 0.0, 10.0, 1.0)]
    pins = [("d", 1.0, "M1", 0.0, 0.5, 0.0, 0.5), ("s", 0.0, "M2", 10.0, 0.5, 0.0, 0.5)]
    via = [(1, "M1", "M2", 0, 2.0, 5.0, 0.5, 0.01, 0.5)]
    leaves, history = resistance(spark, rects, via, pins, max_level=2, rounds=2, fraction=0.3)
    assert history[0][2] == pytest.approx(12.0, rel=0.01)
    # more cells by the via, and the layers stay joined
    assert history[1][1] > history[0][1] and history[1][2] == pytest.approx(history[0][2], rel=0.15)
    assert leaves.agg(F.max("level")).first()[0] == 1
    again = resistance(spark, rects, via, pins, max_level=2, rounds=2, fraction=0.3)[1]
    assert [h[:2] for h in again] == [h[:2] for h in history] and [h[2] for h in again] == pytest.approx([h[2] for h in history], rel=1e-12)


def test_two_polygons_of_a_net_refined_in_one(spark):
    rects = [(1, "M1", 0, 1.0, 0.0, 0.0, 5.0, 1.0), (2, "M1", 0, 1.0, 5.0, 0.0, 10.0, 1.0)]
    pins = [("d", 1.0, "M1", 0.0, 0.5, 0.0, 0.5), ("s", 0.0, "M1", 10.0, 0.5, 0.0, 0.5)]
    df = spark.createDataFrame(rects, RECT)
    lat = lattice.lattices(df, 0.25)
    flat = lattice.base(lat)
    mid = lattice.boxes(flat, lat).where("poly = 1 and abs((x0 + x1) / 2 - 2) < 1")
    start = keep(lattice.split(flat, mid, 2), "start")
    for links in ([], [(1, 2)]):  # welded along their common side, and with the stitch of polygons that meet
        plain = resistance(spark, rects, [], pins, links, cell=0.25, rounds=1)[1][0]
        fine = resistance(spark, rects, [], pins, links, cell=0.25, rounds=1, max_level=2, start=start)[1][0]
        assert links or plain[2] == pytest.approx(10.0, rel=1e-6)
        assert fine[1] > plain[1] and fine[2] == pytest.approx(plain[2], rel=0.05)


def test_refined_mesh_has_no_loose_nodes(spark):
    rects = spark.createDataFrame([(1, "M1", 0, 1.0, 0.0, 0.0, 16.0, 16.0)], RECT)
    lat = lattice.lattices(rects, 1.0, keep=["physical", "component", "r_sheet"])
    flat = lattice.base(lat)
    mid = lattice.boxes(flat, lat).where("abs((x0 + x1) / 2 - 8) < 3 and abs((y0 + y1) / 2 - 8) < 3")
    leaves = keep(lattice.balanced(lattice.split(flat, mid, 4), lat, 4), "leaves")
    nodes, edges = lattice_tables = adaptive.lattice_network(leaves, lat)
    corners = leaves.select(F.explode(F.array(*[F.struct(((F.col("ix") + i) / F.expr("shiftleft(1L, level)")).alias("x"), ((F.col("iy") + j) / F.expr("shiftleft(1L, level)")).alias("y")) for i in (0, 1) for j in (0, 1)])).alias("p")).select("p.*").distinct()
    assert corners.count() == nodes.count() and len(lattice_tables) == 2
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    assert ends.count() == nodes.count()
    # no edge passes over a node: every side is as long as the smallest leaf beside it
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    long = edges.join(at("a"), "a").join(at("b"), "b")
    over = long.join(nodes.select("x", "y"), ((F.col("ya") == F.col("yb")) & (F.col("y") == F.col("ya")) & (F.col("x") > F.least("xa", "xb")) & (F.col("x") < F.greatest("xa", "xb"))) | ((F.col("xa") == F.col("xb")) & (F.col("x") == F.col("xa")) & (F.col("y") > F.least("ya", "yb")) & (F.col("y") < F.greatest("ya", "yb"))))
    assert over.count() == 0
    assert network.WELD == 1e-12
