"""Layout-shaped views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View bodies by name; the same text runs in Spark SQL and DuckDB.
VIEWS = {
    "f_rect": """SELECT p_partkey AS id, p_type AS layer,
       CAST((p_partkey % 50) * 10 AS DOUBLE) AS x0,
       CAST((p_partkey - p_partkey % 50) / 50 * 10 AS DOUBLE) AS y0,
       CAST((p_partkey % 50) * 10 + p_size AS DOUBLE) AS x1,
       CAST((p_partkey - p_partkey % 50) / 50 * 10 + 1 + p_partkey % 13 AS DOUBLE) AS y1
FROM part""",
    "f_via": """SELECT o_orderkey AS id, o_orderpriority AS via_layer, o_custkey % 5 AS component,
       CAST(o_orderkey % 500 AS DOUBLE) AS x,
       CAST((o_orderkey - o_orderkey % 500) / 500 * 13 AS DOUBLE) AS y,
       CAST(1 + o_orderkey % 9 AS DOUBLE) AS r
FROM orders""",
    "f_pts": """SELECT event_id AS id, event_type AS layer, CAST(user_id AS DOUBLE) AS x,
       CAST(event_id % 97 AS DOUBLE) AS y, CAST(event_id * 7919 % 1009 AS BIGINT) AS power
FROM events""",
    "f_grid": """SELECT e.r_regionkey AS layer, a.n_nationkey AS ix, b.n_nationkey AS iy,
       CAST(a.n_nationkey * a.n_nationkey AS DOUBLE) AS x, CAST(b.n_nationkey * 2 AS DOUBLE) AS y,
       CAST(a.n_nationkey * 3 + b.n_nationkey * (e.r_regionkey + 1) AS DOUBLE) AS u
FROM region e CROSS JOIN nation a CROSS JOIN nation b""",
    "f_idtable": """SELECT CAST(a.r_regionkey * 25 AS DOUBLE) AS t, CAST(g.n_nationkey AS DOUBLE) AS vgs,
       CAST(b.r_regionkey AS DOUBLE) AS vds,
       CAST(a.r_regionkey * 100 + g.n_nationkey * g.n_nationkey * b.r_regionkey AS DOUBLE) AS id
FROM region a CROSS JOIN nation g CROSS JOIN region b""",
    "f_bias": """SELECT event_id AS id, CAST(event_id % 17 AS DOUBLE) * 25 / 4 AS t,
       CAST(event_id % 101 AS DOUBLE) / 4 AS vgs, CAST(event_id % 18 AS DOUBLE) / 4 AS vds
FROM events""",
    "f_chain": """SELECT p_brand AS chain, CAST(ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS k,
       CAST(p_size AS DOUBLE) AS r
FROM part""",
    "f_strip": """SELECT s_suppkey AS id, CAST(4 + s_suppkey % 9 AS DOUBLE) AS len,
       CAST(1 + s_suppkey % 4 AS DOUBLE) AS width, CAST(1 + s_nationkey % 3 AS DOUBLE) AS r_sheet
FROM supplier""",
    "f_rho": """SELECT r_regionkey AS layer, CAST(n_nationkey + 1 AS DOUBLE) AS width,
       CAST(100 - n_nationkey AS DOUBLE) AS rho
FROM nation CROSS JOIN region""",
    "f_seed": """SELECT c_custkey AS id, CONCAT('X', CAST(c_custkey AS VARCHAR(20))) AS name, c_mktsegment AS template,
       CAST(c_custkey % 40 * 100 AS DOUBLE) AS x,
       CAST((c_custkey - c_custkey % 40) / 40 * 100 AS DOUBLE) AS y,
       CAST(2 AS DOUBLE) AS w, CAST(20 + c_nationkey AS DOUBLE) AS h
FROM customer""",
}
TABLES = {"f_rect": ["part"], "f_via": ["orders"], "f_pts": ["events"], "f_grid": ["region", "nation"], "f_idtable": ["region", "nation"], "f_bias": ["events"], "f_chain": ["part"], "f_strip": ["supplier"], "f_rho": ["nation", "region"], "f_seed": ["customer"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables of ``sf_dir``."""
    body = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    for t in frames:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(body, **frames)


def sql(body: str, *names: str) -> str:
    """An oracle query with the named views as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    head = body.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{head[len('WITH RECURSIVE'):]}"
    if head.upper().startswith("WITH"):
        return f"WITH {ctes},\n{head[4:]}"
    return f"WITH {ctes}\n{head}"
