"""Solids and meshes with failures beside them."""

import pytest
from pyspark.sql import functions as F

from sheetspark.operators import model

REGION = "id long, layer string, kind string, points array<struct<x:double,y:double>>, z0 double, z1 double"
SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]


def test_one_bad_ring_among_good_ones(spark):
    rows = [
        (1, "m", "box", SQUARE, 0.0, 1.0), (2, "m", "prism", [(0.0, 0.0), (1.0, 1.0)], 0.0, 1.0), (3, "m", "prism", [(5.0, 0.0), (7.0, 0.0), (6.0, 2.0)], 0.0, 2.0),
        (4, "m", "box", SQUARE, 1.0, 1.0), (5, "m", "prism", SQUARE, 2.0, 1.0), (6, "m", "prism", None, 0.0, 1.0), (7, "m", "prism", [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], 0.0, 1.0),
        (8, "fine", "box", SQUARE, 0.0, 1.0), (9, "off", "box", SQUARE, 0.0, 1.0), (10, "m", None, SQUARE, 0.0, 1.0), (11, "m", "box", None, 0.0, 1.0), (12, "m", "prism", [*SQUARE, SQUARE[0]], 0.0, 1.0),
    ]
    out = model.mesh(spark.createDataFrame(rows, REGION), 2.0, 1.0, {"fine": (1.0, 0.5), "off": (0.0, 1.0)})
    v = model.volume(F.col("points"), F.col("kind"))
    got = {r.id: (r.n, r.v, r.error) for r in out.groupBy("id").agg(F.count("points").alias("n"), F.sum(v).alias("v"), F.max("error").alias("error")).collect()}
    assert got == {
        1: (1, 4.0, None), 2: (0, None, "ring has fewer than three points"), 3: (1, 4.0, None), 4: (0, None, "box has no volume"), 5: (0, None, "prism has no height"),
        6: (0, None, "ring has fewer than three points"), 7: (0, None, "ring covers no area"), 8: (8, 4.0, None), 9: (0, None, "cell sizes must be positive"),
        10: (0, None, "unknown kind of solid"), 11: (0, None, "box has no volume"), 12: (2, 4.0, None),
    }
    assert model.mesh(spark.createDataFrame([], REGION), 1.0, 1.0).count() == 0


def test_a_keyhole_ring_is_covered_once(spark):
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0), (2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0), (2.0, 2.0)]
    out = model.mesh(spark.createDataFrame([(1, "m", "prism", ring, 0.0, 1.0)], REGION), 1.0, 1.0)
    assert out.agg(F.sum(model.volume(F.col("points"), F.col("kind")))).first()[0] == pytest.approx(32.0)


def test_regions_side_by_side_share_their_nodes(spark):
    right = [(x + 2.0, y) for x, y in SQUARE]
    out = model.mesh(spark.createDataFrame([(1, "m", "box", SQUARE, 0.0, 1.0), (2, "m", "box", right, 0.0, 1.0)], REGION), 1.0, 1.0)
    nodes, elements = model.welded(out.where("error is null"))
    assert nodes.count() == 5 * 3 * 2 and elements.count() == 8
    ends = elements.select(F.explode("nodes").alias("node")).distinct()
    assert ends.join(nodes, "node").count() == nodes.count()


def test_assembly_reasons_and_first_entries(spark):
    polygons = spark.createDataFrame([(1, "net_m", "a", SQUARE), (2, "net_m", "a", SQUARE[:3]), (3, "seed_x", None, SQUARE), (4, None, None, SQUARE), (5, "lost", None, SQUARE), (6, "flat", None, SQUARE), (7, "bare", None, SQUARE)], "id long, logical string, net string, points array<struct<x:double,y:double>>")
    to = spark.createDataFrame([("net_m", "M1"), ("net_m", "M9"), ("flat", "F"), ("bare", "B")], "logical string, physical string")
    z = spark.createDataFrame([("M1", 0.0, 1.0, 1), ("F", 2.0, 2.0, 2)], "physical string, z0 double, z1 double, material int")
    out = model.assemble(polygons, to, z)
    assert {r.id: (r.layer, r.kind if r.reason is None else None, r.material, r.reason) for r in out.collect()} == {
        1: ("M1", "box", 1, None), 2: ("M1", "prism", 1, None), 3: (None, None, None, "marker"), 4: (None, None, None, "unnamed"), 5: (None, None, None, "unmatched"),
        6: ("F", None, 2, "no height"), 7: ("B", None, None, "no height"),
    }
    assert {tuple(r) for r in model.assembly_counts(out).collect()} == {("box", "M1", 1), ("prism", "M1", 1), ("marker", "seed_x", 1), ("unnamed", "", 1), ("unmatched", "lost", 1), ("no height", "F", 1), ("no height", "B", 1)}


def test_bricks_name_each_node_once(spark):
    from pyspark.sql import functions as F

    from sheetspark.operators import fem

    b = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 1.0 + k, 2.0 + k % 3, 1.0 + k % 2) for k in range(6)], "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    e = fem.with_nodes(fem.hex_elements(b, 1.0, 1.0))
    every = e.select("id", F.explode("nodes").alias("n")).distinct().collect()
    own = e.select("id", F.explode(fem.own_nodes()).alias("n")).collect()
    assert len(own) == len(every) and set(own) == set(every)


def test_elements_with_their_own_conductivity_conduct_as_joined_ones(spark):
    from pyspark.sql import functions as F

    from sheetspark.operators import fem

    b = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 2.0, 1.0, 1.0, [2.0, 0.0, None][k]) for k in range(3)], "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, sigma double")
    told = fem.conductance_edges(fem.with_nodes(fem.hex_elements(b.drop("sigma"), 1.0, 1.0)), b.select("id", "sigma"))
    own = fem.conductance_edges(fem.with_nodes(fem.hex_elements(b, 1.0, 1.0)))
    rounded = lambda e: sorted(tuple(r) for r in e.select("id", "a", "b", F.round("g", 9)).collect())
    assert rounded(own) == rounded(told) and {r.id for r in own.collect()} == {0}
