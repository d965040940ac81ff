"""The jobs as queries: each runs its job twice over the whole given tables into one new shared folder and returns what
the job's output then is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetspark.fixtures import sql
from sheetspark.storage import shared_dir

from . import layout_nets, text_names
from .common import config

#: Where the columns of a layout are in the given tables.
LAYOUT = {
    "shape_id": "p_partkey", "shape_layer": "p_type", "shape_x0": "p_partkey % 50 * 10", "shape_y0": "(p_partkey - p_partkey % 50) / 50 * 10",
    "shape_x1": "p_partkey % 50 * 10 + p_size", "shape_y1": "(p_partkey - p_partkey % 50) / 50 * 10 + 1 + p_partkey % 13",
    "via_id": "o_orderkey", "via_x": "o_orderkey % 500", "via_y": "(o_orderkey - o_orderkey % 500) / 500 * 13", "via_ohm": "1 + o_orderkey % 9",
}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the names in all ``documents`` by source."""
    at, settings = _folder(spark, "job1"), config(None, text_names.__file__)
    for _ in range(2):
        text_names.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint", settings)
    return text_names.read(spark, f"{at}/index")


def job2_layout_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nets of the boxes made from ``part`` with vias made from ``orders``."""
    at, settings = _folder(spark, "job2"), config(None, layout_nets.__file__) | LAYOUT
    for _ in range(2):
        layout_nets.run(spark, spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet"), at, settings)
    out = layout_nets.read(spark, at)
    return out.withColumn("r_vias", F.round("r_vias", 6))


QUERIES = {"job1_text_names": job1_text_names, "job2_layout_nets": job2_layout_nets}

ORACLES = {
    "job1_text_names": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, regexp_split_to_array(text, '\r?\n') AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT k, doc_id, source, unnest(x) AS v, generate_subscripts(x, 1) AS line FROM d),
t AS (SELECT k, doc_id, source, line, unnest(regexp_split_to_array(v, '[ \t\n\x0B\f\r]+')) AS name FROM l WHERE NOT regexp_matches(ltrim(v, ' '), '^[#%*]'))
SELECT source AS "group", name, count(*) AS n, count(DISTINCT k) AS n_texts,
  arg_min(doc_id, {'d': doc_id, 'l': line}) AS first_id, CAST(arg_min(line, {'d': doc_id, 'l': line}) AS BIGINT) AS first_line
FROM t WHERE name <> '' GROUP BY source, name""",
    "job2_layout_nets": sql("""WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM f_rect a JOIN f_rect b ON a.layer = b.layer AND a.id < b.id
 AND least(a.x1, b.x1) >= greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, other) AS (SELECT id, id FROM f_rect UNION SELECT reach.id, u.b FROM reach JOIN u ON reach.other = u.a),
named AS (SELECT r.*, n.net FROM f_rect r JOIN (SELECT id, min(other) AS net FROM reach GROUP BY id) n ON r.id = n.id),
landed AS (SELECT v.id AS via, v.r, arg_min(r.net, {'a': (r.x1 - r.x0) * (r.y1 - r.y0), 'i': r.id}) AS net FROM f_via v
 JOIN named r ON v.x - 1 <= r.x1 AND r.x0 <= v.x + 1 AND v.y - 1 <= r.y1 AND r.y0 <= v.y + 1 GROUP BY v.id, v.r),
through AS (SELECT net, count(*) AS n_vias, round(1 / sum(1 / r), 6) AS r_vias FROM landed GROUP BY net)
SELECT layer, n.net, count(*) AS n_shapes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum((x1 - x0) * (y1 - y0)) AS area, coalesce(any_value(n_vias), 0) AS n_vias, any_value(r_vias) AS r_vias
FROM named n LEFT JOIN through t ON n.net = t.net GROUP BY layer, n.net""", "f_rect", "f_via"),
}
