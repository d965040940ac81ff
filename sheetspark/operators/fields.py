"""Field quantities, reports and aggregates of a solved network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cell_scalars(cells: DataFrame) -> DataFrame:
    """Cells with corner potentials u0..u3 (SW, SE, NE, NW), dx, dy and r_sheet: gradient, power, current density,
    current and mean potential."""
    c = F.col
    gx = ((c("u1") + c("u2")) - (c("u0") + c("u3"))) / (2 * c("dx"))
    gy = ((c("u2") + c("u3")) - (c("u0") + c("u1"))) / (2 * c("dy"))
    g2 = c("gx") * c("gx") + c("gy") * c("gy")
    spread = F.greatest("u0", "u1", "u2", "u3") - F.least("u0", "u1", "u2", "u3")
    return (
        cells.withColumns({"gx": gx, "gy": gy})
        .withColumns({"power": g2 / c("r_sheet") * c("dx") * c("dy"), "density": F.sqrt(g2) / c("r_sheet"), "potential": (c("u0") + c("u1") + c("u2") + c("u3")) / 4})
        .withColumn("current", F.when(spread > 1e-15, c("power") / spread).otherwise(0.0))
    )


def edge_drops(edges: DataFrame, potentials: DataFrame) -> DataFrame:
    """Edges (key, a, b, g, ...) with du = u(a) - u(b)."""
    ua, ub = potentials.select("key", F.col("node").alias("a"), F.col("u").alias("ua")), potentials.select("key", F.col("node").alias("b"), F.col("u").alias("ub"))
    return edges.join(ua.hint("merge"), ["key", "a"]).join(ub.hint("merge"), ["key", "b"]).withColumn("du", F.col("ua") - F.col("ub"))


def via_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different layers, with their middle."""
    a, b = (nodes.select(F.col("node").alias(k), F.col("physical").alias(f"p{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "ab")
    j = edges.join(a, "a").join(b, "b").where("pa <> pb")
    return j.select("a", "b", "g", "pa", "pb", ((F.col("xa") + F.col("xb")) / 2).alias("x"), ((F.col("ya") + F.col("yb")) / 2).alias("y"))


def power_report(drops: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(layer, power, share, r): layers by power; share in percent of all, r = power / I^2 with the drain current."""
    p = drops.groupBy("layer").agg(F.sum(F.col("g") * F.col("du") * F.col("du")).alias("power"))
    total = p.agg(F.sum("power").alias("total"))
    p = p.crossJoin(F.broadcast(total))  # one row
    if current is not None:
        p = p.crossJoin(F.broadcast(current.select(F.first("i").alias("i"))))
    out = p.select("layer", "power", (100 * F.col("power") / F.col("total")).alias("share"), *([(F.col("power") / (F.col("i") * F.col("i"))).alias("r")] if current is not None else []))
    return out


def terminal_currents(drops: DataFrame, terminals: DataFrame) -> DataFrame:
    """(name, i): signed current out of each terminal's nodes; an edge within a terminal counts on neither side."""
    t = terminals.select("key", "name", "node")
    ta, tb = t.select("key", F.col("node").alias("a"), F.col("name").alias("na")), t.select("key", F.col("node").alias("b"), F.col("name").alias("nb"))
    j = drops.join(ta, ["key", "a"], "left").join(tb, ["key", "b"], "left").where("na is not null or nb is not null").where("not (na <=> nb)")
    flow = F.col("g") * F.col("du")
    rows = j.select(F.explode(F.array(F.struct(F.col("na").alias("name"), flow.alias("i")), F.struct(F.col("nb").alias("name"), (-flow).alias("i")))).alias("r")).select("r.*")
    return rows.where("name is not null").groupBy("name").agg(F.sum("i").alias("i"))


def voltage_pair(terminals: DataFrame) -> DataFrame:
    """Drain and source: by the names d and s, else the pair with the largest difference of voltage. One row."""
    one = terminals.groupBy("name").agg(F.max("voltage").alias("v"))
    hi, lo = F.max_by(F.struct("name", "v"), F.struct(F.col("v"), -F.ascii("name"))), F.min_by(F.struct("name", "v"), F.struct("v", "name"))
    by = lambda k: F.max(F.when(F.lower("name") == k, F.struct("name", "v")))
    named = F.col("nd").isNotNull() & F.col("ns").isNotNull()
    return one.agg(by("d").alias("nd"), by("s").alias("ns"), hi.alias("hi"), lo.alias("lo")).select(
        F.when(named, F.col("nd")).otherwise(F.col("hi")).alias("drain"), F.when(named, F.col("ns")).otherwise(F.col("lo")).alias("source"))


def gradient_jump(cells: DataFrame) -> DataFrame:
    """(id, jump): the largest change of the gradient to a neighbour across a shared side; cells(layer, ix, iy, gx, gy)."""
    moves = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    other = cells.select("layer", F.col("ix").alias("ox"), F.col("iy").alias("oy"), F.col("gx").alias("hx"), F.col("gy").alias("hy"))
    near = cells.withColumn("m", F.explode(moves)).withColumns({"ox": F.col("ix") + F.col("m.dx"), "oy": F.col("iy") + F.col("m.dy")})
    d = F.sqrt(F.pow(F.col("gx") - F.col("hx"), 2) + F.pow(F.col("gy") - F.col("hy"), 2))
    return near.join(other, ["layer", "ox", "oy"]).groupBy("layer", "ix", "iy").agg(F.max(d).alias("jump"))


def rho_at_width(points: DataFrame, table: DataFrame) -> DataFrame:
    """(id, rho): table(layer, width, rho) read linearly at points(id, layer, width), held constant beyond its ends."""
    w = Window.partitionBy("layer").orderBy("width")
    spans = table.withColumns({"w1": F.lead("width").over(w), "r1": F.lead("rho").over(w), "first": F.row_number().over(w) == 1})
    spans = spans.select("layer", F.col("width").alias("w0"), F.col("rho").alias("r0"), "w1", "r1", "first")
    j = points.join(spans, "layer")
    held = (F.col("first") & (F.col("width") < F.col("w0"))) | ((F.col("width") >= F.col("w0")) & (F.col("w1").isNull() | (F.col("width") < F.col("w1"))))
    rho = F.when(F.col("w1").isNull() | (F.col("width") < F.col("w0")), F.col("r0")).otherwise(F.col("r0") + (F.col("r1") - F.col("r0")) * (F.col("width") - F.col("w0")) / (F.col("w1") - F.col("w0")))
    return j.where(held).select("id", rho.alias("rho"))
