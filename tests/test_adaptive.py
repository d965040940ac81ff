"""Adaptive refinement and hanging nodes."""

import pytest
from pyspark.sql import functions as F

from sheetspark.operators import adaptive, network


def test_bar_keeps_its_resistance(spark):
    bar = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 2.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    leaves, history = adaptive.adaptive_resistance(bar, 1.0, 1.0, 0.0, 10.0, max_level=2, rounds=2, fraction=0.3)
    assert history[0][2] == pytest.approx(5.0, rel=1e-9) and history[1][1] > history[0][1]
    assert history[1][2] == pytest.approx(5.0, rel=0.15)
    assert leaves.agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)"))).first()[0] == pytest.approx(20.0)


def test_hanging_node_reaches_into_the_coarse_cell(spark):
    gaps = spark.createDataFrame([("M1", 1.0, 0.5, 0.25, 0.0, 0.25, 0.25), ("M1", 0.0, 0.0, 0.0, 0.25, 0.0, 0.25)], "layer string, x double, y double, l double, r double, b double, t double")
    hung = spark.createDataFrame([("M1", 1.0, 0.5, "left", 0.5)], "layer string, x double, y double, side string, half double")
    got = {(r.x, r.y): (r.l, r.r, r.b, r.t) for r in network.hanging_gaps(gaps, hung).collect()}
    assert got == {(1.0, 0.5): (0.25, 0.5, 0.25, 0.25), (0.0, 0.0): (0.0, 0.25, 0.0, 0.25)}


def test_weighted_edges_of_a_unit_cell(spark):
    corner = [("M1", x, y, 0.5 * x, 0.5 * (1 - x), 0.5 * y, 0.5 * (1 - y)) for x in (0.0, 1.0) for y in (0.0, 1.0)]
    gaps = spark.createDataFrame(corner, "layer string, x double, y double, l double, r double, b double, t double")
    e = spark.createDataFrame([("M1", 0.0, 0.0, 1.0, 0.0, 2.0), ("M1", 0.0, 0.0, 0.0, 1.0, 2.0)], "layer string, ax double, ay double, bx double, by double, r_sheet double")
    assert [r.g for r in network.weighted_edges(e, gaps).collect()] == [0.25, 0.25]
