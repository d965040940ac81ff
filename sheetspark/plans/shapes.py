"""Queries over rings: combs, L shapes and triangles made from the boxes of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import geometry as geo
from ..operators import closure, model, rings
from . import sheet_rds
from .queries import CELL, query

#: The shape of a box by its id: 0 an L, 1 a comb of three teeth upwards, 2 a triangle with its right angle at the lower
#: left, 3 one with its right angle at the upper right.
SHAPES = """shape AS (SELECT id, layer, id % 4 AS kind, x0, y0, x1, y1 + 4 AS y1, x1 - x0 AS w FROM f_rect),
box AS (SELECT id, layer, x0, y0, x1, y0 + 1 AS y1 FROM shape WHERE kind < 2 UNION ALL SELECT id, layer, x0, y0 + 1, x0 + w / 4, y1 FROM shape WHERE kind = 0
 UNION ALL SELECT id, layer, x0 + k * 3 * w / 8, y0 + 1, x0 + k * 3 * w / 8 + w / 4, y1 FROM shape CROSS JOIN (VALUES (0), (1), (2)) t(k) WHERE kind = 1)"""


def shapes(spark, d) -> DataFrame:
    """(id, layer, kind, points) of every box."""
    s = view(spark, d, "f_rect").withColumn("y1", F.col("y1") + 4).withColumns({"w": F.col("x1") - F.col("x0"), "kind": F.col("id") % 4})
    x, y, w, top = F.col("x0"), F.col("y0"), F.col("w"), F.col("y1")
    p = geo.point
    bend = F.array(p(x, y), p(F.col("x1"), y), p(F.col("x1"), y + 1), p(x + w / 4, y + 1), p(x + w / 4, top), p(x, top))
    teeth = [q for k in (2, 1, 0) for q in (p(x + k * 3 * w / 8 + w / 4, y + 1), p(x + k * 3 * w / 8 + w / 4, top), p(x + k * 3 * w / 8, top), p(x + k * 3 * w / 8, y + 1))]
    comb = F.array(p(x, y), p(F.col("x1"), y), p(F.col("x1"), y + 1), *teeth)
    low = F.array(p(x, y), p(F.col("x1"), y), p(x, top), p(x, y))  # a ring may name its first point again
    high = F.array(p(F.col("x1"), y), p(F.col("x1"), top), p(x, top))
    return s.select("id", "layer", "kind", F.when(F.col("kind") == 0, bend).when(F.col("kind") == 1, comb).when(F.col("kind") == 2, low).otherwise(high).alias("points"))


@query(f"""WITH {SHAPES}, p AS (SELECT id, x / 2 AS x, y / 2 AS y FROM f_pts),
hit AS (SELECT p.id AS point, b.id FROM p JOIN box b ON b.x0 <= p.x AND p.x < b.x1 AND b.y0 <= p.y AND p.y < b.y1
 UNION ALL SELECT p.id, s.id FROM p JOIN shape s ON s.kind = 2 AND s.y0 <= p.y AND p.y < s.y1 AND s.x0 <= p.x AND p.x < s.x0 + (p.y - s.y1) / (s.y0 - s.y1) * (s.x1 - s.x0)
 UNION ALL SELECT p.id, s.id FROM p JOIN shape s ON s.kind = 3 AND s.y0 <= p.y AND p.y < s.y1 AND p.x < s.x1 AND NOT p.x < s.x1 + (p.y - s.y0) / (s.y1 - s.y0) * (s.x0 - s.x1))
SELECT point, count(*) AS n, min(id) AS id FROM hit GROUP BY point""", "f_rect", "f_pts")
def polygon_contains(spark, d):
    """How many rings a point lies in, and the first of them."""
    p = view(spark, d, "f_pts").select("id", (F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y"))
    inside = rings.contains(p, rings.edges_of(shapes(spark, d)), CELL)
    return inside.groupBy("point").agg(F.count("*").alias("n"), F.min("id").alias("id"))


_LINKS = f"""{SHAPES}, meet AS (SELECT a.id AS a, b.id AS b FROM box a JOIN box b ON a.layer = b.layer AND a.id < b.id AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > -1e-12)"""


@query(f"""WITH RECURSIVE {_LINKS}, u AS (SELECT a, b FROM meet UNION SELECT b, a FROM meet), own AS (SELECT id FROM shape WHERE kind < 2),
reach(id, other) AS (SELECT id, id FROM own UNION SELECT reach.id, u.b FROM reach JOIN u ON reach.other = u.a)
SELECT id, min(other) AS net FROM reach GROUP BY id""", "f_rect")
def comb_nets(spark, d):
    """The nets of all L shapes and combs by the plan's own rule; many interlock without touching."""
    from ..storage import keep

    s = shapes(spark, d).where("kind < 2").select("id", F.col("layer").alias("logical"), F.col("layer").alias("physical"), "points")
    s = keep(s, "shapes")  # tests that name the points often would make them anew each time
    links = sheet_rds.met(keep(sheet_rds.pieces(s), "pieces"), CELL, s)
    names = closure.components(links).withColumnRenamed("node", "id")
    return s.select("id").join(names.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("net"))


@query(f"""WITH {SHAPES}, t AS (SELECT * FROM shape WHERE kind > 1), p AS (SELECT a.id AS a, b.id AS b, a.kind AS ka, b.kind AS kb, a.x0 AS ax0, a.x1 AS ax1, b.x0 AS bx0, b.x1 AS bx1,
 a.y0 AS ay0, a.y1 AS ay1, b.y0 AS by0, b.y1 AS by1, 0.5e0 * (greatest(a.y0, b.y0) + least(a.y1, b.y1)) AS y FROM t a JOIN t b ON a.layer = b.layer AND a.id < b.id AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
h AS (SELECT *, ax1 + (y - ay0) / (ay1 - ay0) * (ax0 - ax1) AS ah, bx1 + (y - by0) / (by1 - by0) * (bx0 - bx1) AS bh FROM p),
i AS (SELECT a, b, CASE WHEN ka = 2 THEN ax0 ELSE ah END AS s, CASE WHEN ka = 2 THEN ah ELSE ax1 END AS e, CASE WHEN kb = 2 THEN bx0 ELSE bh END AS p, CASE WHEN kb = 2 THEN bh ELSE bx1 END AS q FROM h)
SELECT a, b FROM i WHERE least(e, q) - greatest(s, p) > -1e-12""", "f_rect")
def triangle_links(spark, d):
    """Pairs of triangles of a layer that meet at the middle of their common heights."""
    t = shapes(spark, d).where("kind > 1")
    return rings.connected(rings.edges_of(t, ["layer"]), CELL)


_KINDS = "SELECT id, layer, id % 5 AS kind, x1 - x0 AS w, y1 - y0 + 4 AS h, CASE WHEN layer LIKE 'S%' THEN 2e0 ELSE 4e0 END AS c FROM f_rect"


@query(f"""WITH k AS ({_KINDS}), n AS (SELECT *, greatest(CAST(ceil(w / c * (1 - 1e-12)) AS BIGINT), 1) * greatest(CAST(ceil(h / c * (1 - 1e-12)) AS BIGINT), 1) * 2 AS hexes FROM k)
SELECT id, CASE kind WHEN 0 THEN hexes WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END AS elements,
 CASE kind WHEN 0 THEN round(3 * w * h, 6) WHEN 1 THEN round(3 * (w + w / 4 * (h - 1)), 6) WHEN 2 THEN round(3 * w * h / 2, 6) END AS volume,
 CASE kind WHEN 3 THEN 'ring has fewer than three points' WHEN 4 THEN 'box has no volume' END AS error FROM n""", "f_rect")
def mesh_model(spark, d):
    """Boxes, L shapes and triangles as solids 3 high, among them rings of two points and boxes without height: the elements
    and volume of each, or why it has none."""
    s = view(spark, d, "f_rect").withColumns({"y1": F.col("y1") + 4, "k": F.col("id") % 5})
    x, y, u, v, p = F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), geo.point
    w = (u - x) / 4
    bend = F.array(p(x, y), p(u, y), p(u, y + 1), p(x + w, y + 1), p(x + w, v), p(x, v))
    ring = F.when(F.col("k") == 1, bend).when(F.col("k") == 2, F.array(p(x, y), p(u, y), p(x, v))).when(F.col("k") == 3, F.array(p(x, y), p(u, v)))
    ring = ring.otherwise(geo.rect_ring(x, y, u, v))
    regions = s.select("id", "layer", F.when(F.col("k").isin(0, 4), "box").otherwise("prism").alias("kind"), ring.alias("points"), F.lit(0.0).alias("z0"), F.when(F.col("k") == 4, 0.0).otherwise(3.0).alias("z1"))
    sizes = {r.layer: (2.0, 1.5) for r in s.where("layer like 'S%'").select("layer").distinct().collect()}  # a row for each layer
    made = model.mesh(regions, 4.0, 1.5, sizes)
    return made.groupBy("id").agg(F.count("points").alias("elements"), F.round(F.sum(model.volume(F.col("points"), F.col("kind"))), 6).alias("volume"), F.max("error").alias("error"))


@query("""WITH p AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN concat('seed_', layer) ELSE layer END AS logical FROM f_rect),
r AS (SELECT CASE WHEN logical IS NULL THEN 'unnamed' WHEN logical LIKE 'seed_%' THEN 'marker' WHEN NOT (logical LIKE 'S%' OR logical LIKE 'P%') THEN 'unmatched' WHEN logical LIKE 'P%' THEN 'no height'
 WHEN id % 3 = 0 THEN 'prism' ELSE 'box' END AS what, logical FROM p)
SELECT what, CASE WHEN what IN ('box', 'prism') THEN 'metal' WHEN what = 'no height' THEN 'poly' ELSE coalesce(logical, '') END AS layer, count(*) AS n FROM r GROUP BY 1, 2""", "f_rect")
def stack_assembly(spark, d):
    """All boxes, a third with a corner cut off, as solids of a stack of two layers, one of them without a height."""
    r = view(spark, d, "f_rect")
    logical = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 7 == 0, F.concat(F.lit("seed_"), "layer")).otherwise(F.col("layer"))
    whole = geo.rect_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    shapes_ = r.select("id", logical.alias("logical"), F.lit(None).cast("string").alias("net"), F.when(F.col("id") % 3 == 0, F.slice(whole, 1, 3)).otherwise(F.slice(whole, 1, 4)).alias("points"))
    names = r.select(F.col("layer").alias("logical")).distinct()
    to = names.where("logical like 'S%' or logical like 'P%'").select("logical", F.when(F.col("logical").startswith("S"), "metal").otherwise("poly").alias("physical"))
    z = spark.createDataFrame([("metal", 1.0, 2.0, 1), ("poly", 3.0, 3.0, 2)], "physical string, z0 double, z1 double, material int")
    return model.assembly_counts(model.assemble(shapes_, to, z))
