"""Linear quadtrees: a leaf is the whole numbers (poly, level, ix, iy), its place on its level's grid.

Each rectangle has a lattice of its own, ``poly(x0, y0, x1, y1, nx, ny)`` with nx x ny cells at level 0 and twice as many
each way at every further level. Parents, children and neighbours are found by shifting and adding, so refining, balancing
and finding hanging middles are explodes, distincts and equi-joins; no geometry is compared and nothing is repeated until
it settles. Leaves of different lattices never see each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cells_for
from ..storage import spread

KEY = ["poly", "level", "ix", "iy"]
#: A cell and its four neighbours.
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def lattices(rects: DataFrame, cell: float | Column, cap: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    """(poly, x0, y0, x1, y1, nx, ny, keep) of rectangles (id, x0, y0, x1, y1, keep), whose cells are at most ``cell`` wide,
    but not more than ``cap`` each way. ``cell`` may be a column of ``rects``."""
    n = lambda lo, hi: F.least(F.greatest(cells_for(F.col(hi) - F.col(lo), F.lit(cell)), F.lit(1)), F.lit(cap)).cast("long")
    return rects.select(F.col("id").alias("poly"), "x0", "y0", "x1", "y1", n("x0", "x1").alias("nx"), n("y0", "y1").alias("ny"), *keep)


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def base(lat: DataFrame) -> DataFrame:
    """The leaves of level 0."""
    return spread(lat, F.col("nx") * F.col("ny")).select("poly", F.lit(0).alias("level"), "ny", _upto(F.col("nx")).alias("ix")).select("poly", "level", "ix", _upto(F.col("ny")).alias("iy"))


def children(cells: DataFrame) -> DataFrame:
    four = F.array(*[F.struct((2 * F.col("ix") + i).alias("ix"), (2 * F.col("iy") + j).alias("iy")) for j in (0, 1) for i in (0, 1)])
    return cells.select("poly", (F.col("level") + 1).alias("level"), F.explode(four).alias("c")).select("poly", "level", "c.ix", "c.iy")


def split(leaves: DataFrame, marked: DataFrame, max_level: int) -> DataFrame:
    """Marked leaves below ``max_level`` give way to their four children. Leaves are read twice: keep them between splits."""
    hit = leaves.join(marked.select(*KEY).distinct().hint("merge"), KEY, "left_semi").where(F.col("level") < max_level)
    return leaves.select(*KEY).join(hit.select(*KEY).hint("merge"), KEY, "left_anti").unionByName(children(hit))


def inner(leaves: DataFrame) -> DataFrame:
    """All cells above the leaves."""
    up = F.explode(F.sequence(F.lit(1), F.col("level")))
    above = leaves.where("level > 0").withColumn("k", up)
    return above.select("poly", (F.col("level") - F.col("k")).alias("level"), F.expr("shiftright(ix, k)").alias("ix"), F.expr("shiftright(iy, k)").alias("iy")).distinct()


def leaves_of(lat: DataFrame, split_cells: DataFrame) -> DataFrame:
    """The leaves of the trees whose split cells are given, parents included."""
    all_ = base(lat).unionByName(children(split_cells))
    return all_.join(split_cells.select(*KEY).hint("merge"), KEY, "left_anti")


def balanced(leaves: DataFrame, lat: DataFrame, max_level: int) -> DataFrame:
    """The fewest further splits after which levels across a side differ by one at most. Where a cell is split, its
    neighbours of the same level must be there, so their parents are split too; that goes from the finest level to the
    coarsest once, and at each level it is an explode and a distinct."""
    from ..storage import keep

    above = keep(inner(leaves), "inner")
    size = lat.select("poly", "nx", "ny")
    split_cells = None
    forced = None
    for level in range(max_level - 1, -1, -1):
        here = above.where(F.col("level") == level)
        here = here if forced is None else keep(here.unionByName(forced).distinct(), "split")
        split_cells = here if split_cells is None else split_cells.unionByName(here)
        if level:
            step = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in CROSS]))
            near = here.withColumn("s", step).select("poly", (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"))
            near = near.join(size.hint("merge"), "poly").where((F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < F.col("nx") * (1 << level)) & (F.col("iy") < F.col("ny") * (1 << level)))
            forced = near.select("poly", F.lit(level - 1).alias("level"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).distinct()
    if split_cells is None:
        return leaves.select(*KEY)
    return leaves_of(lat, split_cells)


def conformed(leaves: DataFrame, lat: DataFrame) -> DataFrame:
    """Leaves of equal level across every side: a rectangle's finest level everywhere, as its cells all hang together."""
    finest = leaves.groupBy("poly").agg(F.max("level").alias("level"))
    fine = lat.join(finest, "poly").withColumn("f", F.expr("shiftleft(1L, level)"))
    return fine.select("poly", "level", (F.col("ny") * F.col("f")).alias("n"), _upto(F.col("nx") * F.col("f")).alias("ix")).select("poly", "level", "ix", _upto(F.col("n")).alias("iy"))


def boxes(leaves: DataFrame, lat: DataFrame) -> DataFrame:
    """The leaves with their boxes (x0, y0, x1, y1) and the lattice's further columns."""
    own = [c for c in lat.columns if c not in ("poly", "x0", "y0", "x1", "y1", "nx", "ny")]
    j = leaves.join(lat.withColumnsRenamed({c: f"_{c}" for c in ("x0", "y0", "x1", "y1")}), "poly").withColumn("_f", F.expr("shiftleft(1L, level)"))
    at = lambda a, k, n: F.when(k == F.col(n) * F.col("_f"), F.col(f"_{a}1")).otherwise(F.col(f"_{a}0") + (F.col(f"_{a}1") - F.col(f"_{a}0")) * k / (F.col(n) * F.col("_f")))
    return j.select(*KEY, at("x", F.col("ix"), "nx").alias("x0"), at("y", F.col("iy"), "ny").alias("y0"), at("x", F.col("ix") + 1, "nx").alias("x1"), at("y", F.col("iy") + 1, "ny").alias("y1"), *own)


#: Sides of a leaf, and the step to the cell beyond each.
SIDES = {"bottom": (0, -1), "top": (0, 1), "left": (-1, 0), "right": (1, 0)}


def hanging(leaves: DataFrame) -> DataFrame:
    """(KEY, side) of balanced leaves: sides beyond which there are two smaller leaves, so that their middle is a node."""
    step = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for s, (i, j) in SIDES.items()]))
    # the lower left child of the cell beyond is there only if that cell is split
    beyond = leaves.withColumn("s", step).select(*KEY, "s.side", (F.col("level") + 1).alias("_l"), (2 * (F.col("ix") + F.col("s.i"))).alias("_x"), (2 * (F.col("iy") + F.col("s.j"))).alias("_y"), "s.i", "s.j")
    # of that cell, the child on this side's edge: the right one beyond the left side, the upper one beyond the bottom
    beyond = beyond.withColumns({"_x": F.when(F.col("i") == -1, F.col("_x") + 1).otherwise(F.col("_x")), "_y": F.when(F.col("j") == -1, F.col("_y") + 1).otherwise(F.col("_y"))})
    there = leaves.select("poly", F.col("level").alias("_l"), F.col("ix").alias("_x"), F.col("iy").alias("_y"))
    return beyond.join(there.hint("merge"), ["poly", "_l", "_x", "_y"], "left_semi").select(*KEY, "side")


def uneven(leaves: DataFrame, max_level: int) -> DataFrame:
    """(KEY) of leaves that are more than one level coarser than a neighbour; none once balanced."""
    step = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in CROSS[1:]]))
    beyond = leaves.where("level > 1").withColumn("s", step).withColumn("k", F.explode(F.expr("sequence(2, level)")))
    at = beyond.select("poly", (F.col("level") - F.col("k")).alias("level"), F.expr("shiftright(ix + s.i, k)").alias("ix"), F.expr("shiftright(iy + s.j, k)").alias("iy")).distinct()
    return leaves.where(F.col("level") < max_level).join(at.hint("merge"), KEY, "left_semi").select(*KEY)
