"""Brackets and ranks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspark.operators import devices


def plain_bracket(axis, v, eps=1e-12):
    if v is None or np.isnan(v):
        return None
    if len(axis) == 1:
        return (axis[0], axis[0]) if abs(v - axis[0]) <= 1e-9 else None
    for lo, hi in zip(axis[:-1], axis[1:]):
        if lo - eps <= v <= hi + eps:
            return lo, hi
    return None


@pytest.mark.parametrize("most", [1000, 3])
@pytest.mark.parametrize("size", [0, 1, 2, 40])
def test_brackets_by_array_and_in_order(spark, size, most):
    rng = np.random.default_rng(size)
    axis = np.sort(rng.choice(np.arange(-60, 60), size, replace=False)) / 4.0
    points = [*(rng.uniform(-18, 18, 60).tolist()), *axis.tolist(), *(axis + 5e-13).tolist(), *(axis - 5e-13).tolist(), *(axis + 1e-6).tolist(), None, float("nan")]
    df = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(points)], "id long, t double, `_x` string").repartition(5)
    table = spark.createDataFrame([(float(a),) for a in [*axis, *axis]] + [(None,)], "t double")
    got = {r["id"]: (r["t_lo"], r["t_hi"]) for r in devices.bracketed(df, table, "t", most=most).collect()}
    assert got == {i: b for i, v in enumerate(points) if (b := plain_bracket(axis.tolist(), v)) is not None}


def test_lookups_plan_no_nested_loop(spark):
    table = spark.createDataFrame([(float(t), float(g), float(v), t + 2.0 * g + 3 * v) for t in range(3) for g in range(4) for v in range(2)], "t double, vgs double, vds double, id double")
    points = spark.createDataFrame([(1, 0.5, 1.25, 0.5), (2, 9.0, 1.0, 0.0), (3, 2.0, 3.0, 1.0)], "id long, t double, vgs double, vds double")
    out = devices.model_lookup(points, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["id"]: r["current"] for r in out.collect()} == {1: pytest.approx(4.5), 2: None, 3: 11.0}


@pytest.mark.parametrize("kind", ["spread", "ties", "halves", "few"])
def test_ranks(spark, kind, monkeypatch):
    monkeypatch.setattr(devices, "PREFIX", 50)
    rng = np.random.default_rng(3)
    v = {
        "spread": np.exp(rng.normal(size=20_001) * 90) * rng.choice([-1, 1], 20_001),
        "ties": rng.integers(0, 5, 20_000).astype(float), "halves": np.r_[np.zeros(9_000), np.full(9_000, 1e300)], "few": rng.normal(size=40),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    s = np.sort(v)
    for rank in (0, 1, len(v) // 3, len(v) // 2, len(v) - 1):
        assert devices.of_rank(df, rank) == s[rank]
    odd = df.unionByName(spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double"))
    assert tuple(devices.upper_median(odd, "v").first()) == (len(v), s[len(v) // 2])
    assert tuple(devices.upper_median(df.limit(0), "v").first()) == (0, None)


def test_an_axis_of_ties_keeps_its_table(spark):
    table = spark.createDataFrame([(1.0, 1.0, 1.0, 7.0)], "t double, vgs double, vds double, id double")
    points = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 1.0, 1.1, 1.0)], "id long, t double, vgs double, vds double")
    assert {r["id"]: r["current"] for r in devices.model_lookup(points, table).select("id", F.col("current")).collect()} == {1: 7.0, 2: None}
