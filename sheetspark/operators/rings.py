"""Exact tests on rings by an index of their edges.

A ring is a set of edges (id, k, xa, ya, xb, yb), k numbering them along the ring; each edge is listed in every horizontal
row of height ``cell`` that it crosses. A test asks the edges of a ring in one row, so no ring, however long, is ever in
one row of a table or one group. Edges along a row cross no horizontal line and are not listed.

Defined cases: rings with fewer than three points, or null ones, hold and touch nothing; a point that closes the ring
again makes no difference; nulls in keys never match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial

#: Gap below which intervals of two rings still touch.
TOUCH = 1e-12
#: Rows of vertices closer than this are one.
SAME = 1e-15


def edges_of(polygons: DataFrame, keys: Sequence[str] = (), ring: str = "points") -> DataFrame:
    """The edges of ``polygons(id, keys, ring)``, the last going back to the first point."""
    p = F.col(ring)
    turned = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    e = polygons.where(F.size(p) >= 3).select("id", *keys, F.posexplode(F.arrays_zip(p.alias("a"), turned.alias("b"))).alias("k", "e"))
    return e.select("id", *keys, "k", F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb"))


def extents(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The bounding box (id, keys, x0, y0, x1, y1) of each ring."""
    return edges.groupBy("id", *keys).agg(F.min("xa").alias("x0"), F.min("ya").alias("y0"), F.max("xa").alias("x1"), F.max("ya").alias("y1"))


def _rows(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def indexed(edges: DataFrame, cell: float) -> DataFrame:
    """(id, row, k, xa, ya, xb, yb) of each edge and row that it reaches."""
    return edges.where("ya <> yb").select("id", "k", "xa", "ya", "xb", "yb", _rows(F.least("ya", "yb"), F.greatest("ya", "yb"), cell).alias("row"))


def contains(points: DataFrame, edges: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """(point, id): each ring of equal ``keys`` that a point (id, x, y, keys) lies in: a ray from it to greater x crosses an
    odd number of edges. An edge counts from its lower end on, its upper end left out, and only right of the point, so a
    point on a left or lower side is within and one on a right or upper side is not. Points at one place ask once."""
    place = ["x", "y", *keys]
    spot = points.select(*place).distinct().select(*place, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    near = spatial.grid_join(spot, extents(edges, keys), cell, keys)
    asked = near.select(*[F.col(f"a_{c}").alias(c) for c in place], F.col("b_id").alias("id"), F.floor(F.col("a_y") / cell).alias("row"))
    over = (F.col("yb") > F.col("y")) != (F.col("ya") > F.col("y"))
    at = F.col("xb") + (F.col("y") - F.col("yb")) / (F.col("ya") - F.col("yb")) * (F.col("xa") - F.col("xb"))
    crossed = asked.join(indexed(edges, cell).hint("merge"), ["id", "row"]).where(over & (F.col("x") < at))
    inside = crossed.groupBy(*place, "id").agg((F.count("*") % 2).alias("odd")).where("odd = 1").drop("odd")
    return points.select(F.col("id").alias("point"), *place).join(inside.hint("merge"), place).select("point", "id")


def first_containing(points: DataFrame, edges: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """(point, id): the ring with the smallest id that a point lies in."""
    return contains(points, edges, cell, keys).groupBy("point").agg(F.min("id").alias("id"))


def _heights(pairs: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(a, b, band, y): the middle of each band between neighbouring vertices of both rings of a pair (a, b, lo, hi), within
    lo and hi."""
    ends = edges.select("id", F.col("ya").alias("y"), F.floor(F.col("ya") / cell).alias("row")).distinct()
    rows = pairs.withColumn("row", _rows(F.col("lo"), F.col("hi"), cell))
    own = [rows.join(ends.withColumnRenamed("id", side).hint("merge"), [side, "row"]).where("y between lo and hi").select("a", "b", "y") for side in "ab"]
    turn = Window.partitionBy("a", "b").orderBy("y")
    ys = own[0].unionByName(own[1]).distinct().withColumn("up", F.lead("y").over(turn))
    return ys.where(F.col("up") - F.col("y") >= SAME).select("a", "b", F.col("y").alias("band"), (0.5 * (F.col("y") + F.col("up"))).alias("y"))


def _intervals(heights: DataFrame, index: DataFrame, side: str, cell: float) -> DataFrame:
    """(a, b, band, side, x0, x1): the x ranges that the ring ``side`` of each pair covers at the heights."""
    at = heights.withColumn("row", F.floor(F.col("y") / cell)).join(index.withColumnRenamed("id", side).hint("merge"), [side, "row"])
    over = ((F.col("ya") <= F.col("y")) & (F.col("yb") > F.col("y"))) | ((F.col("yb") <= F.col("y")) & (F.col("ya") > F.col("y")))
    x = F.col("xa") + (F.col("y") - F.col("ya")) / (F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa"))
    turn = Window.partitionBy("a", "b", "band").orderBy("x", "k")
    crossings = at.where(over).select("a", "b", "band", "k", x.alias("x"))
    paired = crossings.withColumns({"n": F.row_number().over(turn), "x1": F.lead("x").over(turn)})
    return paired.where("n % 2 = 1 and x1 is not null").select("a", "b", "band", F.lit(side).alias("side"), F.col("x").alias("x0"), "x1")


def connected(edges: DataFrame, cell: float, keys: Sequence[str] = ("layer",), eps: float = TOUCH, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: rings of equal ``keys`` that overlap or touch. Within the bands between the vertices of both, at the
    middle of each, some x range of the one must reach one of the other to less than ``eps``; so rings that share only a
    horizontal side do not touch, and interlocking combs do not. ``pairs``: boxes (a_, b_) to be tested instead of all that
    meet."""
    boxes = extents(edges, keys)
    near = spatial.grid_join(boxes, boxes, cell, keys, margin=eps).where("a_id < b_id") if pairs is None else pairs
    near = near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.greatest("a_y0", "b_y0").alias("lo"), F.least("a_y1", "b_y1").alias("hi")).where("hi > lo")
    heights, index = _heights(near, edges, cell), indexed(edges, cell)
    both = _intervals(heights, index, "a", cell).unionByName(_intervals(heights, index, "b", cell))
    # sweep by x: where a range begins, how far ranges of the other ring have come; ranges that begin alike see each other
    sweep = Window.partitionBy("a", "b", "band").orderBy("x0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    come = lambda s: F.max(F.when(F.col("side") == s, F.col("x1"))).over(sweep)
    swept = both.withColumns({"reach_a": come("a"), "reach_b": come("b")})
    other = F.when(F.col("side") == "a", F.col("reach_b")).otherwise(F.col("reach_a"))
    return swept.where(other - F.col("x0") > -eps).select("a", "b").distinct()
