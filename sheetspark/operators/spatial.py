"""Spatial joins by a uniform grid: candidates meet by equal cell numbers, so Catalyst plans an equi-join and never a
nested loop. Each pair is produced in one cell only, that of the lower left corner of the two boxes' intersection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def _cells(df: DataFrame, cell: float, prefix: str, box: Sequence[str] = BOX, margin: float = 0.0) -> DataFrame:
    lo = lambda c: F.floor((F.col(c) - margin) / cell)
    hi = lambda c: F.floor((F.col(c) + margin) / cell)
    x0, y0, x1, y1 = box
    return df.withColumn(f"{prefix}gx", F.explode(F.sequence(lo(x0), hi(x1)))).withColumn(f"{prefix}gy", F.explode(F.sequence(lo(y0), hi(y1))))


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def grid_join(left: DataFrame, right: DataFrame, cell: float, keys: Sequence[str] = (), margin: float = 0.0) -> DataFrame:
    """Pairs of boxes (columns x0, y0, x1, y1, equal ``keys``) that touch or overlap, grown by ``margin``; columns get
    the prefixes a_ and b_."""
    a, b = _cells(renamed(left, "a_"), cell, "a_", [f"a_{c}" for c in BOX], margin), _cells(renamed(right, "b_"), cell, "b_", [f"b_{c}" for c in BOX])
    on = (F.col("a_gx") == F.col("b_gx")) & (F.col("a_gy") == F.col("b_gy"))
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    touch = (
        (F.col("a_x0") - margin <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1") + margin)
        & (F.col("a_y0") - margin <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1") + margin)
    )
    home = (F.col("a_gx") == F.floor(F.greatest(F.col("a_x0") - margin, "b_x0") / cell)) & (F.col("a_gy") == F.floor(F.greatest(F.col("a_y0") - margin, "b_y0") / cell))
    # a side that is listed by cells is larger than Spark takes it for: neither is broadcast
    return a.join(b.hint("merge"), on & touch & home).drop("a_gx", "a_gy", "b_gx", "b_gy")


def band_overlap(x_touch: bool = True) -> Column:
    """Boxes a and b connect: their y ranges overlap by a positive length and their x ranges touch or overlap. Boxes
    that are only stacked, sharing a horizontal edge, do not."""
    return (F.least("a_y1", "b_y1") > F.greatest("a_y0", "b_y0")) & (F.least("a_x1", "b_x1") >= F.greatest("a_x0", "b_x0"))


def overlap_pairs(rects: DataFrame, cell: float, keys: Sequence[str] = ("layer",), touch_all_sides: bool = False) -> DataFrame:
    """(a, b), a < b, of connected boxes of the same keys."""
    joined = grid_join(rects, rects, cell, keys).where(F.col("a_id") < F.col("b_id"))
    if not touch_all_sides:
        joined = joined.where(band_overlap())
    return joined.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def smallest_landing(vias: DataFrame, rects: DataFrame, cell: float) -> DataFrame:
    """(via, id): the overlapping rectangle of least area for each via box; of ties the first id."""
    joined = grid_join(vias, rects, cell)
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    return joined.groupBy(F.col("a_id").alias("via")).agg(F.min_by("b_id", F.struct(area, F.col("b_id"))).alias("id"))


def first_containing(points: DataFrame, rects: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """(point, id): the rectangle with the smallest id that contains the point (left and lower sides included)."""
    boxes = points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    joined = grid_join(boxes, rects, cell, keys)
    inside = (F.col("b_x0") <= F.col("a_x")) & (F.col("a_x") < F.col("b_x1")) & (F.col("b_y0") <= F.col("a_y")) & (F.col("a_y") < F.col("b_y1"))
    return joined.where(inside).groupBy(F.col("a_id").alias("point")).agg(F.min("b_id").alias("id"))


#: Cells of a level of the pyramid are so many times as wide as those of the level below.
STEP = 3  # as a power of two


def pyramid(nodes: DataFrame, keys: Sequence[str], cell: float, levels: int) -> DataFrame:
    """(level, keys, gx, gy, x0, y0, x1, y1, latest): the occupied cells of every level from 0, whose cells have side
    ``cell``, up to ``levels``, with the extent of the nodes (keys, x, y, holder) in them and their latest holder."""
    ground = nodes.groupBy(*keys, F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.max("holder").alias("latest"))
    up = lambda c: F.expr(f"shiftright({c}, {STEP} * level)").alias(c)
    every = ground.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select("level", *keys, up("gx"), up("gy"), "x0", "y0", "x1", "y1", "latest")
    return every.groupBy("level", *keys, "gx", "gy").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("latest").alias("latest"))


NOBODY = (1 << 63) - 1
#: Rows of a counted table up to which it is broadcast; larger ones, and those of unknown size, are not.
FEW = 50_000


def _met(df: DataFrame, rows: int) -> DataFrame:
    """A table of a join as Spark shall take it. By itself Spark goes by the bytes of the files beneath, and broadcasts
    what explodes and joins have made of a small one."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def nearest(points: DataFrame, nodes: DataFrame, cell: float, keys: Sequence[str] = (), how: str = "inner", within: float | None = None, free: bool = False) -> DataFrame:
    """(point, node, d2): the nearest node (id, x, y, keys) of equal ``keys`` for each point (id, x, y, keys), ids of points
    being unique; of ties the smallest id. ``how="left"`` keeps points that have none, with nulls. ``within``: no farther
    than that. ``free``: nodes have a ``holder``, and a point takes only a node whose holder is null or greater than its id.

    Every point first looks into the 3 x 3 cells around it; what it finds within one cell's side is final. The others go
    down a pyramid of occupied cells, from a few per key to cells of side ``cell``: at each level the extents of the
    nodes in a cell give the least and the greatest distance of its nearest node, and cells whose least distance is beyond
    the smallest greatest one are left. Only nodes of the cells that are left at the end are compared. All joins are
    equi-joins; written are the nodes, the first look and, if any point is left by it, the pyramid. ``cell`` should hold a few nodes:
    nodes of one cell are all compared with the points that come to it. Points are dealt to tasks before they are listed by
    cells: a small file's reader is one task."""
    from ..storage import keep, spread

    keys = list(keys)
    spots = nodes.select(F.col("id").alias("n_id"), "x", "y", *keys, (F.coalesce("holder", F.lit(NOBODY)) if free else F.lit(NOBODY)).cast("long").alias("holder"))
    if not free:  # of nodes at one place only the first counts
        spots = spots.groupBy("x", "y", *keys).agg(F.min("n_id").alias("n_id"), F.max("holder").alias("holder"))
    spots = spots.where("x is not null and y is not null")
    spots = keep(spots, "spots")
    n_spots = spots.count()
    ground = spots.select("n_id", F.col("x").alias("n_x"), F.col("y").alias("n_y"), *keys, "holder", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    d2 = (F.col("x") - F.col("n_x")) * (F.col("x") - F.col("n_x")) + (F.col("y") - F.col("n_y")) * (F.col("y") - F.col("n_y"))
    best = F.min(F.struct(d2.alias("d2"), F.col("n_id").alias("node"))).alias("b")
    open_ = F.col("holder") > F.col("id") if free else F.lit(True)
    asked = spread(points.select("id", "x", "y", *keys), F.lit(9))
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / cell) - 1, F.floor(F.col(c) / cell) + 1))
    near = asked.withColumn("gx", around("x")).withColumn("gy", around("y")).join(_met(ground, n_spots), [*keys, "gx", "gy"]).where(open_).groupBy("id").agg(best)
    looked = keep(asked.join(near.hint("merge"), "id", "left").select("id", "x", "y", *keys, "b.d2", "b.node"), "looked")
    reach = float("inf") if within is None else within * within
    sure = (F.col("d2") <= cell * cell) if within is None or within > cell else F.lit(True)
    final = looked.where(sure).select(F.col("id").alias("point"), "node", "d2")
    rest = looked.where(~F.coalesce(sure, F.lit(False))).where("x is not null and y is not null")
    unplaced = looked.where("x is null or y is null").select(F.col("id").alias("point"), "node", "d2")
    if rest.limit(1).count():
        span = spots.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
        if span[0] is not None:
            levels, lo, hi = 0, [int(span[i] // cell) for i in (0, 2)], [int(span[i] // cell) for i in (1, 3)]
            while any((h >> STEP * levels) - (b >> STEP * levels) > 3 for b, h in zip(lo, hi)):
                levels += 1
            stones = keep(pyramid(spots, keys, cell, levels), "pyramid")
            few = {} if n_spots <= FEW else {r["level"]: r["n"] for r in stones.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row for each level
            first = lambda i: F.explode(F.sequence(F.lit(lo[i] >> STEP * levels).cast("long"), F.lit(hi[i] >> STEP * levels).cast("long")))
            at = rest.select("id", "x", "y", *keys, F.least(F.coalesce("d2", F.lit(float("inf"))), F.lit(reach)).alias("bound")).withColumn("ux", first(0)).withColumn("uy", first(1))
            for level in range(levels, -1, -1):
                own = stones.where(F.col("level") == level).drop("level")
                if level < levels:
                    own = own.withColumns({"ux": F.shiftright("gx", STEP), "uy": F.shiftright("gy", STEP)})
                else:
                    own = own.withColumns({"ux": F.col("gx"), "uy": F.col("gy")})
                seen = at.join(_met(own, few.get(level, n_spots)), [*keys, "ux", "uy"])
                if free:
                    seen = seen.where(F.col("latest") > F.col("id"))
                gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
                most = lambda c: F.greatest(F.abs(F.col(f"{c}1") - F.col(c)), F.abs(F.col(c) - F.col(f"{c}0")))
                seen = seen.withColumns({"least": gap("x") * gap("x") + gap("y") * gap("y"), "most": most("x") * most("x") + most("y") * most("y")})
                seen = seen.where(F.col("least") <= F.col("bound"))
                seen = seen.withColumn("bound", F.least("bound", F.min("most").over(Window.partitionBy("id")))).where(F.col("least") <= F.col("bound"))
                at = seen.select("id", "x", "y", *keys, "bound", F.col("gx").alias("ux"), F.col("gy").alias("uy"))
            met = at.select("id", "x", "y", *keys, F.col("ux").alias("gx"), F.col("uy").alias("gy")).join(_met(ground, n_spots), [*keys, "gx", "gy"]).where(open_)
            met = met.where(d2 <= reach).groupBy("id").agg(best).select("id", "b.d2", "b.node")
            # what the first look found is in the cells met, unless it is the best itself
            rest = rest.select("id", F.col("d2").alias("d2_"), F.col("node").alias("node_")).join(met.hint("merge"), "id", "left")
            one = F.least(F.when(F.col("node").isNotNull(), F.struct("d2", "node")), F.when(F.col("node_").isNotNull(), F.struct(F.col("d2_").alias("d2"), F.col("node_").alias("node"))))
            rest = rest.withColumn("o", one).select("id", F.col("o.d2").alias("d2"), F.col("o.node").alias("node"))
        final = final.unionByName(rest.select(F.col("id").alias("point"), "node", "d2"))
    out = final.unionByName(unplaced)
    if within is not None:
        far = F.col("d2") > reach
        out = out.select("point", F.when(~far, F.col("node")).alias("node"), F.when(~far, F.col("d2")).alias("d2"))
    return out if how == "left" else out.where("node is not null")


def footprint_nodes(boxes: DataFrame, nodes: DataFrame, cell: float, slack: float = 1e-15, keys: Sequence[str] = ()) -> DataFrame:
    """(box, node): nodes of equal ``keys`` within each box (half sizes hx, hy around x, y), or the nearest one where
    there is none; boxes for whose keys there is no node have a null. Boxes of one size at one place ask once."""
    from ..storage import keep

    place = ["x", "y", "hx", "hy", *keys]
    asked = keep(boxes.groupBy(*place).agg(F.min("id").alias("id")), "places")
    found = _footprints(asked, nodes, cell, slack, keys)
    told = asked.join(found.hint("merge"), asked["id"] == F.col("box")).select(*[F.col(c).alias(f"_{c}") for c in place], "node").hint("merge")
    on = F.lit(True)
    for c in place:
        on = on & boxes[c].eqNullSafe(F.col(f"_{c}"))
    return boxes.select("id", *place).join(told, on).select(F.col("id").alias("box"), "node")


def _footprints(boxes: DataFrame, nodes: DataFrame, cell: float, slack: float, keys: Sequence[str]) -> DataFrame:
    """:func:`footprint_nodes` with a box for each place."""
    from ..storage import keep

    area = boxes.withColumns({"x0": F.col("x") - F.col("hx"), "y0": F.col("y") - F.col("hy"), "x1": F.col("x") + F.col("hx"), "y1": F.col("y") + F.col("hy")})
    spots = nodes.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    inside = grid_join(area, spots, cell, keys, margin=slack).select(F.col("a_id").alias("box"), F.col("b_id").alias("node"))
    bare = keep(boxes.join(inside.select(F.col("box").alias("id")).distinct().hint("merge"), "id", "left_anti"), "bare")
    fallback = nearest(bare, nodes, cell, keys, "left").select(F.col("point").alias("box"), "node")
    return inside.unionByName(fallback)


def map_solution(old: DataFrame, new: DataFrame, cell: float, quantum: float = 1e-12) -> DataFrame:
    """(id, u): the old solution at the same place (to ``quantum``), else at the nearest old node in the 3 x 3 cells
    around, else 0."""
    q = lambda df: df.withColumns({"xq": F.round(F.col("x") / quantum).cast("long"), "yq": F.round(F.col("y") / quantum).cast("long")})
    o, n = q(old), q(new)
    same = o.groupBy("layer", "component", "xq", "yq").agg(F.min_by("u", "id").alias("same"))
    hit = n.join(same, ["layer", "component", "xq", "yq"], "left")
    rest = hit.where("same is null").select("id", "layer", "component", "x", "y")
    g = lambda c, d: F.floor(F.col(c) / cell) + d
    p = rest.withColumn("gx", F.explode(F.sequence(g("x", -1), g("x", 1)))).withColumn("gy", F.explode(F.sequence(g("y", -1), g("y", 1))))
    m = old.select("layer", "component", F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("u").alias("ou")).withColumns({"gx": F.floor(F.col("ox") / cell), "gy": F.floor(F.col("oy") / cell)})
    d2 = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)
    near = p.join(m, ["layer", "component", "gx", "gy"]).groupBy("id").agg(F.min_by("ou", F.struct(d2, F.col("oid"))).alias("near"))
    return hit.join(near, "id", "left").select("id", F.coalesce("same", "near", F.lit(0.0)).alias("u"))


def spacing(df: DataFrame) -> float:
    """A cell's side that holds about two of the places (x, y) if they are spread evenly."""
    r = df.agg(F.count("*").alias("n"), *[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    if not r["n"] or r[1] is None:
        return 1.0
    w, h, n = r[2] - r[1], r[4] - r[3], max(1, r["n"] / 2)
    return max((w * h / n) ** 0.5, max(w, h) / n, 1e-9)


def greedy_match(golden: DataFrame, found: DataFrame, by: Sequence[str] = (), max_distance: float | None = None, cell: float | None = None) -> DataFrame:
    """(golden, found, d): each golden row, in id order, takes the nearest found row that is still free (of ties the
    smallest id), no farther than ``max_distance``; ids are unique, rows without a place match nothing.

    The order is kept without one task that walks through it: in rounds, every golden row that has none asks for the nearest
    found row that no smaller golden id holds; of those that ask for one found row the smallest id holds it, and who is
    put off asks again. A row is never refused for a greater id, so what stands when nobody asks any more is what the
    walk in order gives. Rounds end where displacements do: as many as the longest chain of golden rows that put each
    other off, two or three if conflicts are local. A round's holdings are written to the shared folder; nothing that
    grows with the rows is broadcast."""
    from ..storage import discard, keep

    keys = list(by)
    cell = cell or spacing(found)
    place = lambda df: df.select("id", "x", "y", *keys).where("id is not null and x is not null and y is not null")
    everyone, spots = keep(place(golden), "golden"), place(found)
    held = None
    asking = everyone
    while True:
        state = spots.withColumn("holder", F.lit(None).cast("long")) if held is None else spots.join(held.select(F.col("found").alias("id"), F.col("golden").alias("holder")).hint("merge"), "id", "left")
        asked = keep(nearest(asking, state, cell, keys, within=max_distance, free=True), "asked")
        won = asked.groupBy("node").agg(F.min_by(F.struct("point", "d2"), "point").alias("w")).select(F.col("w.point").alias("golden"), F.col("node").alias("found"), F.col("w.d2").alias("d2"))
        after = won if held is None else won.unionByName(held.join(won.select("found").hint("merge"), "found", "left_anti"))
        after = keep(after, "held")
        lost = asked.select(F.col("point").alias("golden"))
        if held is not None:
            lost = lost.unionByName(held.select("golden"))
        again = keep(lost.join(after.select("golden").hint("merge"), "golden", "left_anti").select(F.col("golden").alias("id")), "again")
        discard(asked), discard(held)
        held = after
        if not again.limit(1).count():
            break
        asking = everyone.join(again.hint("merge"), "id")
    return held.select("golden", "found", F.sqrt("d2").alias("d"))
