"""Small helpers of geometry and devices."""

import numpy as np
from pyspark.sql import functions as F

from sheetspark.functions import geometry as geo
from sheetspark.operators import devices, solve


def test_rings(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0)])], "id long, ring array<struct<x:double,y:double>>")
    r = df.select(geo.clean_ring(F.col("ring")).alias("c"), geo.rescaled(F.col("ring"), 2.0).alias("s"), geo.rescaled(F.col("ring"), float("nan")).alias("n"), geo.area(F.col("ring")).alias("a"), geo.db_units(F.lit(-2.5e-9), 1e-9).alias("u")).first()
    assert [(p.x, p.y) for p in r.c] == [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0)]
    assert r.s[3].y == 6.0 and r.n[3].y == 3.0 and r.a == 3.0 and r.u == -3
    inside = df.select(*[geo.contains_point(F.col("ring"), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("i", 1.5, 1.0), ("o", 0.5, 1.0))]).first()
    assert (inside.i, inside.o) == (True, False)


def test_reports(spark):
    inst = spark.createDataFrame([("n", {"w": 2.0}), ("n", {"l": 1.0}), ("p", {"w": 1.0})], "model string, params map<string,double>")
    assert {tuple(r) for r in devices.model_summary(inst).collect()} == {("n", 2, 2.0), ("p", 1, 1.0)}
    ports = spark.createDataFrame([("D",), ("S",), ("s",)], "name string")
    assert {r.name for r in devices.unserved_ports(ports, ports.where("name <> 's'")).collect()} == {"s"}
    c = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, "c", 1.0)], "ord int, name string, height double")
    assert [r.name for r in devices.conductors_by_height(c).collect()] == ["b", "c", "a"]
    s = spark.createDataFrame([(1, "seed_x", None, None), (1, "m1", "M1", 0.0), (2, "m2", "M2", None), (3, None, None, None)], "layer int, logical string, physical string, z0 double")
    assert {(r.reason, r.layer) for r in devices.assembly_report(s).collect()} == {("marker", 1), ("no height", 2), ("unnamed", 3)}


def test_long_chains_with_branches_are_solved_exactly():
    """A chain of more nodes than conjugate gradients have steps, in any numbering, with a loose branch and an edge twice."""
    n, rng = 30_002, np.random.default_rng(3)
    ohm, at = rng.integers(1, 51, n - 2).astype(float), rng.permutation(n)
    a, b, g = at[: n - 2], at[1 : n - 1], 1 / ohm
    a, b, g = np.append(a, [at[7], at[0]]), np.append(b, [at[n - 1], at[1]]), np.append(g, [2.0, g[0]])
    fixed, value = np.isin(np.arange(n), at[[0, n - 2]]), np.zeros(n)
    value[at[0]] = 1
    ohm[0] /= 2
    want = 1 - np.append(0, np.cumsum(ohm)) / ohm.sum()
    u = solve.solve_dirichlet(n, a, b, g, fixed, value)
    assert np.abs(u[at[: n - 1]] - want).max() < 1e-12
    assert abs(u[at[n - 1]] - want[7]) < 1e-12


def test_folding_leaves_what_hangs_together_by_more():
    side = 40
    grid = np.arange(side * side).reshape(side, side)
    tail = side * side + np.arange(500)
    a = np.concatenate([grid[:, :-1].ravel(), grid[:-1].ravel(), [7], tail[:-1], [3, 5]])
    b = np.concatenate([grid[:, 1:].ravel(), grid[1:].ravel(), [tail[0]], tail[1:], [tail[-1], 5]])
    n = side * side + 500
    g = np.random.default_rng(4).random(len(a)) + 0.1
    fixed, value = np.isin(np.arange(n), [0, side * side - 1]), np.where(np.arange(n) == 0, 1.0, 0.0)
    full = np.zeros((n, n))
    for i, j, v in ((a, a, g), (b, b, g), (a, b, -g), (b, a, -g)):
        np.add.at(full, (i, j), v)
    want = value.copy()
    want[~fixed] = np.linalg.solve(full[np.ix_(~fixed, ~fixed)], -full[np.ix_(~fixed, fixed)] @ value[fixed])
    assert np.abs(solve.solve_dirichlet(n, a, b, g, fixed, value) - want).max() < 1e-10


def test_a_rings_tolerance_is_taken_once_and_not_for_each_edge(spark):
    steps = [(float(i // 2), float((i + 1) // 2)) for i in range(1200)] + [(0.0, 600.0)]
    rows = [(1, steps), (2, [*steps[:-1], (5.0, 700.0)]), (3, [(0.0, 0.0), (0.0, 5.0), (4.0, 5.0 + 1e-10), (4.0, 0.0)]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>").select("id", geo.is_rectilinear(F.col("p")).alias("r"))
    assert {r["id"]: r["r"] for r in df.collect()} == {1: True, 2: False, 3: True, 4: True, 5: None}
    assert "array_max(" not in df._jdf.queryExecution().analyzed().toString().split("forall(", 1)[1].split("AS r", 1)[0]
