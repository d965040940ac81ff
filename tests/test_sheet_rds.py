"""End to end: strip, two metals with a via, parallel vias, a biased channel; and the brick solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.operators import fem, solve
from sheetspark.plans import sheet_rds

POLY = "id long, logical string, physical string, points array<struct<x:double,y:double>>, r_sheet double"
VIA = "id long, bottom string, top string, r double, x double, y double, hx double, hy double"
TERM = "name string, voltage double, physical string, x double, y double, hx double, hy double"


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def run(spark, polygons, vias, right, layer="M1", cell=1.0):
    p = spark.createDataFrame(polygons, POLY)
    v = spark.createDataFrame(vias, VIA)
    t = spark.createDataFrame([("D", 1.0, "M1", 0.0, 2.0, 0.0, 2.0), ("S", 0.0, layer, right, 2.0, 0.0, 2.0)], TERM)
    net = sheet_rds.build(p, v, t, cell, 100)
    return sheet_rds.report(net)


def test_strip(spark):
    table, r = run(spark, [(1, "net_M1", "M1", rect(0.0, 0.0, 40.0, 4.0), 1.0)], [], 40.0)
    assert r == pytest.approx(10.0, rel=1e-6)
    row = table.first()
    assert row["layer"] == "M1" and row["share"] == pytest.approx(100.0) and row["power"] == pytest.approx(0.1, rel=1e-6)


def test_two_metals_and_a_via(spark):
    metals = [(1, "net_M1", "M1", rect(0.0, 0.0, 20.0, 4.0), 1.0), (2, "net_M2", "M2", rect(20.0, 0.0, 40.0, 4.0), 1.0)]
    _, one = run(spark, metals, [(1, "M1", "M2", 0.5, 20.0, 2.0, 0.25, 2.0)], 40.0, "M2")
    assert one == pytest.approx(10.5, rel=0.03)
    _, two = run(spark, metals, [(1, "M1", "M2", 1.0, 20.0, 1.0, 0.25, 1.0), (2, "M1", "M2", 1.0, 20.0, 3.0, 0.25, 1.0)], 40.0, "M2")
    assert two == pytest.approx(one, rel=0.02)


def test_channel_settles_at_its_own_bias(spark):
    p = spark.createDataFrame([(1, "net_M1", "M1", rect(0.0, 0.0, 4.0, 4.0), 1.0), (2, "net_M2", "M2", rect(10.0, 0.0, 14.0, 4.0), 1.0)], POLY)
    t = spark.createDataFrame([("D", 1.0, "M1", 0.0, 2.0, 0.0, 2.0), ("S", 0.0, "M2", 14.0, 2.0, 0.0, 2.0)], TERM)
    net = sheet_rds.build(p, spark.createDataFrame([], VIA), t, 4.0)
    ends = {(r.physical, r.x, r.y): r.node for r in net.nodes.collect()}
    ch = spark.createDataFrame([(k, ends["M1", 4.0, y], None, ends["M2", 10.0, y], 1.0) for k, y in enumerate((0.0, 4.0))], "id long, drain long, gate long, source long, w double")
    # current 0.05 vds (1 + vgs): a channel of 20 ohm at vgs 0
    table = spark.createDataFrame([(27.0, g, d, 0.05 * d * (1 + g)) for g in (-0.9, 0.0, 1.0) for d in (0.0, 0.5, 1.0)], "t double, vgs double, vds double, id double")
    state, n = sheet_rds.bias_loop(net, ch, table, 1.0, tol=1e-9, rounds=40)
    r = [x.r for x in state.orderBy("id").collect()]
    # two equal channels of r between squares of 1 ohm: source at u, u = 1 / (2 + r / 2), r = 20 / (1 - u)
    assert n < 40 and r[0] == pytest.approx(r[1])
    assert r[0] == pytest.approx(20 / (1 - 1 / (2 + r[0] / 2)), rel=1e-6)


def test_brick_and_bar(spark):
    k = fem.brick_stiffness(1.0, 2.0, 3.0)
    assert np.allclose(k, k.T) and np.allclose(k.sum(1), 0)
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 10.0, 2.0, 0.5)], "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    e = fem.with_nodes(fem.hex_elements(box, 1.0, 0.25))
    assert e.count() == 40 and fem.volume(e).first()["volume"] == pytest.approx(10.0)
    edges = fem.conductance_edges(e, spark.createDataFrame([(1, 2.0)], "id long, sigma double"))
    ends = e.select("id", F.explode("nodes").alias("node"), "nx").distinct().where("node % (nx + 1) = 0 or node % (nx + 1) = nx")
    fixed = ends.select("id", "node", F.when(F.col("node") % (F.col("nx") + 1) == 0, 1.0).otherwise(0.0).alias("value"))
    assert solve.resistance(edges, fixed, "id").first()["r"] == pytest.approx(10 / (2.0 * 1.0), rel=1e-6)


def test_prism_bases():
    l_shape = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    assert len(fem.prism_bases(l_shape)) == 2
    tri = fem.prism_bases([(0, 0), (4, 0), (5, 3), (2, 5), (0, 3)])
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
    assert all(len(t) == 3 for t in tri) and sum(map(area, tri)) == pytest.approx(area([(0, 0), (4, 0), (5, 3), (2, 5), (0, 3)]))
