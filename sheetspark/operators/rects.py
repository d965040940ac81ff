"""Rectangle set algebra on rings.

Horizontal bands lie between consecutive distinct y of the rings; in a band a ring covers the intervals between paired
crossings of its edges with the band's middle. Exact for rectilinear rings, holes included; slanted edges give steps.
The kernel is a few comparisons over one row's rings, handed over in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread

EPS = 1e-15
#: Rings that a task takes.
KERNEL = 10_000
Ring = list[tuple[float, float]]


def bands(*rings: Ring) -> list[tuple[float, float]]:
    out: list[float] = []
    for y in sorted(p[1] for r in rings for p in r):
        if not out or y - out[-1] > EPS:
            out.append(y)
    return list(zip(out[:-1], out[1:]))


def intervals(ring: Ring, y: float) -> list[tuple[float, float]]:
    """Covered x ranges at height y, by the even-odd rule."""
    if len(ring) < 3:
        return []
    xs = sorted(
        a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
        for a, b in zip(ring, ring[1:] + ring[:1])
        if (a[1] <= y < b[1]) or (b[1] <= y < a[1])
    )
    return list(zip(xs[::2], xs[1::2]))


def difference(a: Ring, others: list[Ring]) -> list[tuple[float, float, float, float]]:
    """Rectangles (x0, y0, x1, y1) of a without the others, by band and then from the left."""
    out = []
    if len(a) < 3:
        return out
    for y0, y1 in bands(a, *others):
        mid = (y0 + y1) / 2
        pieces = intervals(a, mid)
        for b in others:
            for lo, hi in intervals(b, mid):
                pieces = [p for s, e in pieces for p in ((s, min(e, lo)), (max(s, hi), e)) if p[1] - p[0] > EPS]
        out += [(s, y0, e, y1) for s, e in pieces if e - s > EPS]
    return out


def intersection(a: Ring, b: Ring) -> list[tuple[float, float, float, float]]:
    out = []
    if len(a) < 3 or len(b) < 3:
        return out
    for y0, y1 in bands(a, b):
        mid = (y0 + y1) / 2
        out += [(max(s, p), y0, min(e, q), y1) for s, e in intervals(a, mid) for p, q in intervals(b, mid) if min(e, q) - max(s, p) > EPS]
    return out


def _ring(points) -> Ring:
    out = [(p["x"], p["y"]) for p in points] if points is not None else []
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


SCHEMA = "id long, n int, x0 double, y0 double, x1 double, y1 double"


def _emit(op):
    def run(frames):
        for pdf in frames:
            rows = [(i, n, *r) for i, *rings in pdf.itertuples(index=False) for n, r in enumerate(op(*rings))]
            yield pd.DataFrame(rows, columns=["id", "n", "x0", "y0", "x1", "y1"])

    return run


def decompose(shapes: DataFrame) -> DataFrame:
    """``shapes(id, ring)`` into rectangles (id, n, x0, y0, x1, y1)."""
    return spread(shapes.select("id", "ring"), F.lit(1), KERNEL).mapInPandas(_emit(lambda r: difference(_ring(r), [])), SCHEMA)


def subtract(pairs: DataFrame) -> DataFrame:
    """``pairs(id, ring, cuts)``: the ring without all rings of ``cuts`` (an array, may be empty or null)."""
    return pairs.select("id", "ring", "cuts").mapInPandas(_emit(lambda r, cuts: difference(_ring(r), [_ring(c) for c in (cuts if cuts is not None else [])])), SCHEMA)


def intersect(pairs: DataFrame) -> DataFrame:
    """``pairs(id, ring, other)``: rectangles of the intersection."""
    return pairs.select("id", "ring", "other").mapInPandas(_emit(lambda r, o: intersection(_ring(r), _ring(o))), SCHEMA)


def intersect_boxes(pairs: DataFrame) -> DataFrame:
    """The same for pairs of boxes a_, b_, as plain columns; pairs without a common area are gone."""
    box = {"x0": F.greatest("a_x0", "b_x0"), "y0": F.greatest("a_y0", "b_y0"), "x1": F.least("a_x1", "b_x1"), "y1": F.least("a_y1", "b_y1")}
    return pairs.withColumns(box).where((F.col("x1") - F.col("x0") > EPS) & (F.col("y1") - F.col("y0") > EPS))
