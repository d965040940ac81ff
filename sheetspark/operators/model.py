"""Solid models of a layer stack and their meshes. What cannot be built or meshed becomes a row with its reason beside the
others, and never stops them: both are made in one pass and told apart afterwards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bbox, cells_for, is_rectangle
from ..storage import spread
from .devices import is_marker
from .fem import ear_clip
from .rects import KERNEL, bands

#: Least area of a base.
LEAST = 1e-30


def assemble(polygons: DataFrame, layer_map: DataFrame, heights: DataFrame) -> DataFrame:
    """(id, logical, layer, net, material, kind, points, z0, z1, reason) of polygons (id, logical, net, points): a box of an
    axis-parallel rectangle, else a prism, between the heights (physical, z0, z1, material) of the layer that ``layer_map``
    (logical, physical) names; else the reason why there is no solid: "unnamed" (no logical name), "marker", "unmatched" (not
    in the map) or "no height" (none, or not one above the other). Of a layer's several entries the first by name counts."""
    to = layer_map.groupBy("logical").agg(F.min("physical").alias("layer"))
    z = heights.groupBy(F.col("physical").alias("layer")).agg(F.min(F.struct("z0", "z1", "material")).alias("h"))
    j = polygons.join(to, "logical", "left").join(z, "layer", "left").select("id", "logical", "layer", "net", "points", "h.*")
    reason = F.when(F.col("logical").isNull(), "unnamed").when(is_marker(F.col("logical")), "marker").when(F.col("layer").isNull(), "unmatched")
    reason = reason.when(~F.coalesce(F.col("z1") > F.col("z0"), F.lit(False)), "no height")
    kind = F.when(is_rectangle(F.col("points")), "box").otherwise("prism")
    return j.select("id", "logical", "layer", "net", "material", kind.alias("kind"), "points", "z0", "z1", reason.alias("reason"))


def assembly_counts(assembled: DataFrame) -> DataFrame:
    """(what, layer, n): solids by kind and layer, and what was left out by reason and layer, a layer without a name being
    empty."""
    layer = F.when(F.col("reason") == "no height", F.col("layer")).when(F.col("reason").isNotNull(), F.coalesce("logical", F.lit(""))).otherwise(F.col("layer"))
    return assembled.groupBy(F.coalesce("reason", "kind").alias("what"), layer.alias("layer")).agg(F.count("*").alias("n"))


def _triangles(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles that cover a ring whose sides don't cross: cut ears of a simple one, else two for each piece of its bands."""
    pts = [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]
    pts = pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts
    if len(pts) < 3:
        raise ValueError("ring has fewer than three points")
    sides = list(zip(pts, pts[1:] + pts[:1]))
    if not all(a[0] == b[0] or a[1] == b[1] for a, b in sides):
        try:
            return [tuple(pts[i] for i in t) for t in ear_clip(pts)]
        except ValueError:
            pass
    x_at = lambda s, y: s[0][0] + (y - s[0][1]) / (s[1][1] - s[0][1]) * (s[1][0] - s[0][0])
    out = []
    for y0, y1 in bands(pts):
        mid = (y0 + y1) / 2
        over = sorted((s for s in sides if (s[0][1] <= mid < s[1][1]) or (s[1][1] <= mid < s[0][1])), key=lambda s: x_at(s, mid))
        for p, q in zip(over[::2], over[1::2]):
            a, b, c, d = (x_at(p, y0), y0), (x_at(q, y0), y0), (x_at(q, y1), y1), (x_at(p, y1), y1)
            for t in ((a, b, c), (a, c, d)):
                if abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) >= 2 * LEAST:
                    out.append(t)
    if not out:
        raise ValueError("ring covers no area")
    return out


def _wedges(frames):
    for pdf in frames:
        rows = []
        for i, points in pdf.itertuples(index=False):
            try:
                found = _triangles([(p["x"], p["y"]) for p in points] if points is not None else [])
                rows += [(i, n, [{"x": x, "y": y} for x, y in t], None) for n, t in enumerate(found)]
            except ValueError as e:
                rows.append((i, 0, None, str(e)))
        yield pd.DataFrame(rows, columns=["id", "n", "base", "error"])


def _size(sizes: dict[str, tuple[float, float]], at: int, default: float) -> Column:
    own = [F.lit(x) for layer, s in sizes.items() for x in (layer, float(s[at]))]
    return F.coalesce(F.element_at(F.create_map(*own), F.col("layer")), F.lit(default)) if own else F.lit(default)


def mesh(regions: DataFrame, lateral: float, vertical: float, sizes: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(id, n, kind, points, error) of regions (id, layer, kind, points, z0, z1), ids being unique: the elements of each, n
    numbering them, as hexahedra of boxes, which are gridded by the cells of their layer (``sizes``: layer to lateral and
    vertical cell), or wedges of prisms; a region that fails has one row with an error and no points."""
    sizes = sizes or {}
    r = regions.select("id", "kind", "points", "z0", "z1", _size(sizes, 0, lateral).alias("lateral"), _size(sizes, 1, vertical).alias("vertical"))
    flat = ~F.coalesce(F.col("z1") > F.col("z0"), F.lit(False))
    b = r.where("kind = 'box'").withColumn("b", bbox(F.col("points"))).select("id", "z0", "z1", "lateral", "vertical", F.col("b.min_x").alias("x0"), F.col("b.max_x").alias("x1"), F.col("b.min_y").alias("y0"), F.col("b.max_y").alias("y1"))
    full = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False)) & ~flat
    error = F.when(~full, "box has no volume").when((F.col("lateral") <= 0) | (F.col("vertical") <= 0), "cell sizes must be positive")
    b = b.withColumn("error", error)
    n = lambda a, size: cells_for(F.col(f"{a}1") - F.col(f"{a}0"), F.col(size))
    g = b.where("error is null").withColumns({"nx": n("x", "lateral"), "ny": n("y", "lateral"), "nz": n("z", "vertical")})
    g = spread(g, F.col("nx") * F.col("ny") * F.col("nz"))
    for a in "ijk":
        g = g.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.col({"i": "nx", "j": "ny", "k": "nz"}[a]) - 1)))
    at = lambda a, k, m: F.when(k == F.col(m), F.col(f"{a}1")).otherwise(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * k / F.col(m))
    point = lambda i, j, k: F.struct(at("x", F.col("i") + i, "nx").alias("x"), at("y", F.col("j") + j, "ny").alias("y"), at("z", F.col("k") + k, "nz").alias("z"))
    none = F.lit(None).cast("string")
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    number = (F.col("k") * F.col("ny") + F.col("j")) * F.col("nx") + F.col("i")
    hexes = g.select("id", number.alias("n"), F.lit("hexahedron").alias("kind"), F.array(*[point(i, j, k) for k in (0, 1) for i, j in ring]).alias("points"), none.alias("error"))
    kind = hexes.schema["points"].dataType
    failed = lambda df, why: df.select("id", F.lit(0).cast("long").alias("n"), none.alias("kind"), F.lit(None).cast(kind).alias("points"), why.alias("error"))
    prisms = r.where("kind = 'prism'")
    level = prisms.where(flat)
    bases = spread(prisms.where(~flat).select("id", "points"), F.lit(1), KERNEL).mapInPandas(_wedges, "id long, n long, base array<struct<x:double,y:double>>, error string")
    up = bases.where("error is null").join(prisms.select("id", "z0", "z1").hint("merge"), "id")
    side = lambda z: F.transform("base", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.col(z).alias("z")))
    wedges = up.select("id", "n", F.lit("wedge").alias("kind"), F.concat(side("z0"), side("z1")).alias("points"), none.alias("error"))
    other = r.where(~F.coalesce(F.col("kind").isin("box", "prism"), F.lit(False)))
    return hexes.unionByName(wedges).unionByName(failed(b.where("error is not null"), F.col("error"))).unionByName(failed(bases.where("error is not null"), F.col("error"))).unionByName(failed(level, F.lit("prism has no height"))).unionByName(failed(other, F.lit("unknown kind of solid")))


def volume(points: Column, kind: Column) -> Column:
    """Of a brick or of a wedge with vertical sides."""
    p = lambda k: F.get(points, F.lit(k))
    brick = (p(1)["x"] - p(0)["x"]) * (p(3)["y"] - p(0)["y"]) * (p(4)["z"] - p(0)["z"])
    wedge = F.abs((p(1)["x"] - p(0)["x"]) * (p(2)["y"] - p(0)["y"]) - (p(2)["x"] - p(0)["x"]) * (p(1)["y"] - p(0)["y"])) / 2 * (p(3)["z"] - p(0)["z"])
    return F.when(kind == "hexahedron", brick).otherwise(wedge)


def welded(elements: DataFrame, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, x, y, z), elements with ``nodes``): corners at one place, to ``tolerance``, are one node, whichever
    regions they belong to, so regions that share a side are joined there."""
    q = lambda p: F.xxhash64(*[F.round(p[a] / tolerance).cast("long") for a in "xyz"])
    numbered = elements.withColumn("nodes", F.transform("points", q))
    spots = numbered.select(F.explode(F.arrays_zip("nodes", "points")).alias("e")).select(F.col("e.nodes").alias("node"), "e.points.*")
    return spots.groupBy("node").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("z").alias("z")), numbered
