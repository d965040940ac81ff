"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetspark.fixtures import view
from sheetspark.operators import quadtree
from sheetspark.plans import queries
from sheetspark.storage import keep

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(tuple, pdf.where(pdf.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_duckdb(spark, duck, sf_dir, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_balance_leaves_levels_close(spark, sf_dir):
    sheet = spark.createDataFrame([(1, 0.0, 0.0, 16.0, 16.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    leaves = quadtree.base_cells(sheet, 1.0)
    for _ in range(4):
        leaves = keep(quadtree.refine(leaves, leaves.where("x0 = 0 and y0 = 0"), 4), "corner")
    levels = {r["level"]: r["n"] for r in quadtree.balance(leaves, 1.0, 4).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert sum(n / 4 ** l for l, n in levels.items()) == 256
    cells = quadtree.base_cells(view(spark, sf_dir, "f_rect").select("id", "x0", "y0", "x1", "y1"), 5.0).count()
    assert sum(r["n"] / 4 ** r["level"] for r in queries.quad_balance(spark, sf_dir).collect()) == cells


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
