"""Three-dimensional meshes of extruded shapes and their conductance."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cells_for
from ..storage import ROWS, spread
from .rects import EPS, bands, intervals

#: Corners of a brick: x, y, z steps, in the order of the format (bottom ring, then top ring).
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
#: Bricks that a task makes: each becomes eight nodes or 28 edges.
BRICKS = ROWS // 4


def hex_elements(boxes: DataFrame, lateral: float, vertical: float) -> DataFrame:
    """Bricks of boxes (id, x0, y0, z0, x1, y1, z1, ...): (id, i, j, k, nx, ny, nz, corner coordinates)."""
    n = lambda lo, hi, size: cells_for(F.col(hi) - F.col(lo), F.lit(size))
    b = boxes.withColumns({"nx": n("x0", "x1", lateral), "ny": n("y0", "y1", lateral), "nz": n("z0", "z1", vertical)})
    b = spread(b, F.col("nx") * F.col("ny") * F.col("nz"), BRICKS)
    for a, c in (("i", "nx"), ("j", "ny"), ("k", "nz")):
        b = b.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    return b


def node_number(i, j, k) -> Column:
    """Of a grid place within its box: row-major over (nx + 1) (ny + 1) (nz + 1)."""
    return (k * (F.col("ny") + 1) + j) * (F.col("nx") + 1) + i


def with_nodes(elements: DataFrame) -> DataFrame:
    """Adds ``nodes``, the eight corner numbers within the box, and the brick's size dx, dy, dz."""
    nodes = F.array(*[node_number(F.col("i") + a, F.col("j") + b, F.col("k") + c) for a, b, c in CORNERS])
    size = {f"d{a}": (F.col(f"{a}1") - F.col(f"{a}0")) / F.col(f"n{a}") for a in "xyz"}
    return elements.withColumn("nodes", nodes).withColumns(size)


def own_nodes() -> Column:
    """Those of a brick's ``nodes`` that are its own: its first corner, and of the others those that no brick further on has
    for its first. Over a box's bricks each node is named once, so nothing needs to be told apart by a shuffle."""
    ends = {"i": "nx", "j": "ny", "k": "nz"}
    last = lambda c: [F.col(a) == F.col(n) - 1 for (a, n), step in zip(ends.items(), c) if step]
    own = [F.when(reduce(and_, last(c), F.lit(True)), F.get("nodes", F.lit(p))) for p, c in enumerate(CORNERS)]
    return F.filter(F.array(*own), lambda v: v.isNotNull())


def volume(elements: DataFrame) -> DataFrame:
    return elements.groupBy("id").agg(F.sum(F.col("dx") * F.col("dy") * F.col("dz")).alias("volume"))


def brick_stiffness(dx: float, dy: float, dz: float) -> np.ndarray:
    """8 x 8 conductance of a brick of unit conductivity, by 2 x 2 x 2 Gauss points."""
    g = 1 / 3**0.5
    signs = np.array(CORNERS) * 2 - 1
    k = np.zeros((8, 8))
    for p in signs * g:
        one = (1 + signs * p) / 2  # per axis
        grad = np.stack([signs[:, a] / 2 * one[:, (a + 1) % 3] * one[:, (a + 2) % 3] for a in range(3)])
        grad = grad * 2 / np.array([[dx], [dy], [dz]])
        k += grad.T @ grad * dx * dy * dz / 8
    return k


def conductance_edges(elements: DataFrame, conductivity: DataFrame | None = None) -> DataFrame:
    """(id, a, b, g) of the assembled stiffness: g = -K_ab summed over the elements. ``conductivity(id, sigma)``;
    what has none or none that is positive conducts nothing. Without it elements have a sigma of their own, and stay in the
    tasks that made them."""

    def run(frames):
        for pdf in frames:
            parts = []
            for (dx, dy, dz), own in pdf.groupby(["dx", "dy", "dz"]):
                k = brick_stiffness(dx, dy, dz)
                nodes = np.stack(own["nodes"].to_numpy())
                for p in range(8):
                    for q in range(p):
                        a, b = nodes[:, p], nodes[:, q]
                        parts.append(pd.DataFrame({"id": own["id"].to_numpy(), "a": np.minimum(a, b), "b": np.maximum(a, b), "g": -k[p, q] * own["sigma"].to_numpy()}))
            if parts:
                yield pd.concat(parts)

    known = elements if conductivity is None else elements.join(conductivity.hint("merge"), "id")
    e = known.where("sigma > 0").select("id", "nodes", "dx", "dy", "dz", "sigma")
    return e.mapInPandas(run, "id long, a long, b long, g double").groupBy("id", "a", "b").agg(F.sum("g").alias("g"))


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles of a simple ring by cutting ears; raises if none is left to cut."""
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    n = len(ring)
    area = sum(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1] for i in range(n))
    left = list(range(n)) if area > 0 else list(range(n))[::-1]
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = (left[(k + d) % len(left)] for d in (-1, 0, 1))
            p, q, r = ring[a], ring[b], ring[c]
            if cross(p, q, r) <= 0:
                continue
            if any(cross(p, q, ring[v]) >= 0 and cross(q, r, ring[v]) >= 0 and cross(r, p, ring[v]) >= 0 for v in left if v not in (a, b, c)):
                continue
            out.append((a, b, c))
            left.pop(k)
            break
        else:
            raise ValueError("ring can't be triangulated")
    return [*out, tuple(left)]


def prism_bases(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """Base polygons of a prism mesh: rectangles of a rectilinear ring's bands, else triangles."""
    pts = ring[:-1] if ring[0] == ring[-1] else ring
    clean = [p for k, p in enumerate(pts) if p != pts[k - 1]]
    if all(a[0] == b[0] or a[1] == b[1] for a, b in zip(clean, clean[1:] + clean[:1])):
        return [[(s, y0), (e, y0), (e, y1), (s, y1)] for y0, y1 in bands(clean) for s, e in intervals(clean, (y0 + y1) / 2) if e - s > EPS]
    return [[clean[i] for i in t] for t in ear_clip(clean)]


def prism_elements(shapes: DataFrame) -> DataFrame:
    """(id, kind, ring, z0, z1) of shapes (id, ring, z0, z1): hexahedra or wedges by base, and shapes that fail as kind
    'error' without a ring."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    for base in prism_bases([(p["x"], p["y"]) for p in r.ring]):
                        rows.append((r.id, "hexahedron" if len(base) == 4 else "wedge", [{"x": x, "y": y} for x, y in base], r.z0, r.z1))
                except (ValueError, IndexError):
                    rows.append((r.id, "error", None, r.z0, r.z1))
            yield pd.DataFrame(rows, columns=["id", "kind", "ring", "z0", "z1"])

    return shapes.select("id", "ring", "z0", "z1").mapInPandas(run, "id long, kind string, ring array<struct<x:double,y:double>>, z0 double, z1 double")
