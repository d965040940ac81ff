"""Plane geometry as Column expressions over rings, ``array<struct<x,y>>``; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rect_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The closed ring of a rectangle, five points."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _edges(ring: Column) -> Column:
    """(a, b) of each edge, the last going back to the first point."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), turned.alias("b"))


def signed_area(ring: Column) -> Column:
    """Shoelace; 0 for fewer than three points."""
    total = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.when(F.size(ring) < 3, 0.0).otherwise(total / 2)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def is_ccw(ring: Column) -> Column:
    return signed_area(ring) > 0


def bbox(ring: Column) -> Column:
    """min_x, min_y, max_x, max_y; nulls for an empty ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def _at_corner(at, cx: Column, cy: Column):
    return lambda p: at(p, cx, cy)


def is_rectangle(ring: Column) -> Column:
    """All vertices are corners of the bounding box and all four corners are there (tolerance 1e-9 of the longer side)."""
    b = bbox(ring)
    eps = 1e-9 * F.greatest(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"])
    near = lambda u, v: F.abs(u - v) <= eps
    at = lambda p, cx, cy: near(p["x"], cx) & near(p["y"], cy)
    corners = [(b[x], b[y]) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    on_corner = F.forall(ring, lambda p: (near(p["x"], b["min_x"]) | near(p["x"], b["max_x"])) & (near(p["y"], b["min_y"]) | near(p["y"], b["max_y"])))
    every = F.lit(True)
    for corner in corners:
        every = every & F.exists(ring, _at_corner(at, *corner))
    return F.coalesce((F.size(ring) >= 4) & (eps > 0) & on_corner & every, F.lit(False))


def is_rectilinear(ring: Column) -> Column:
    """Every edge runs along an axis (tolerance 1e-9 of the size, at least of 1)."""
    b = bbox(ring)
    eps = 1e-9 * F.greatest(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"], F.lit(1.0))
    along = lambda t: F.forall(_edges(ring), lambda e: (F.abs(e["a"]["x"] - e["b"]["x"]) <= t) | (F.abs(e["a"]["y"] - e["b"]["y"]) <= t))
    return F.get(F.transform(F.array(eps), along), F.lit(0))  # an array of one: the tolerance once a ring, not once an edge


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray test."""

    def crosses(e):
        over = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
        return F.coalesce(over & (x < at), F.lit(False))

    return F.aggregate(_edges(ring), F.lit(False), lambda s, e: s != crosses(e))


def bbox_overlap(a: dict[str, Column], b: dict[str, Column], eps: float = 0.0) -> Column:
    """Boxes given as columns x0, y0, x1, y1 touch or overlap."""
    return (a["x0"] <= b["x1"] + eps) & (b["x0"] <= a["x1"] + eps) & (a["y0"] <= b["y1"] + eps) & (b["y0"] <= a["y1"] + eps)


def shares_edge(a: dict[str, Column], b: dict[str, Column], eps: float = 1e-15) -> Column:
    """Rectangles touch along a stretch of positive length."""
    along = lambda lo, hi: F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    touch = lambda lo, hi: (F.abs(a[hi] - b[lo]) < eps) | (F.abs(b[hi] - a[lo]) < eps)
    return (touch("x0", "x1") & (along("y0", "y1") > eps)) | (touch("y0", "y1") & (along("x0", "x1") > eps))


def cells_for(length: Column, cell: Column) -> Column:
    """Number of cells: the ceiling with a shrink of 1e-12, at least 1."""
    return F.greatest(F.ceil(length / cell * (1 - 1e-12)), F.lit(1)).cast("long")


def linspace(a: Column, b: Column, n: Column) -> Column:
    """n + 1 values from a to b; the last is b itself."""
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.when(i == n, b).otherwise(a + (b - a) * i / n))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])) / 2


def solid_volume(kind: Column, ring: Column, z0: Column, z1: Column) -> Column:
    """Of a box (its bounding box) or a prism (its ring), extruded from z0 to z1."""
    b = bbox(ring)
    flat = F.when(kind == "box", (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])).otherwise(area(ring))
    return flat * (z1 - z0)


def det3(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def channel_axis(w: Column, h: Column) -> Column:
    """Direction of current in a device's bounding box: (1, 0) and 0 degrees if it is at least as high as wide, else
    (0, 1) and 90; null if it is square or has no extent."""
    axis = lambda x, y, deg: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(deg).alias("deg"))
    return F.when((w <= 0) | (h <= 0) | (w == h), None).when(h > w, axis(1.0, 0.0, 0.0)).otherwise(axis(0.0, 1.0, 90.0))


def rescaled(ring: Column, factor: float) -> Column:
    """Points times ``factor``; unchanged for a factor that is not finite, not positive, or 1."""
    if not (factor > 0 and factor != float("inf")) or abs(factor - 1) < 1e-12:
        return ring
    return F.transform(ring, lambda p: point(p["x"] * factor, p["y"] * factor))


def clean_ring(ring: Column) -> Column:
    """Without points equal to the one before, and without a closing point."""
    kept = F.filter(ring, lambda p, i: (i == 0) | (p != F.element_at(ring, F.greatest(i, F.lit(1)))))
    closed = (F.size(kept) > 1) & (F.element_at(kept, 1) == F.element_at(kept, -1))
    return F.when(closed, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)


def db_units(metres: Column, dbu: float) -> Column:
    """Database units, halves away from zero."""
    return F.round(metres / dbu).cast("int")
