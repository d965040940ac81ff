"""The adaptive loop: refine where most power is lost, balance, solve again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from . import lattice, network, quadtree, solve, spatial
from .closure import components
from .network import node_key


def quad_network(leaves: DataFrame, r_sheet: float) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, x, y), edges(a, b, g, id)) of balanced leaves: a side with a hanging middle becomes two edges of
    half the resistance; the first leaf that has a pair of nodes owns it. Side resistance is r w / h along x and
    r h / w along y, halved between the two leaves that share a side."""
    c = F.col
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    side = lambda name, ax, ay, bx, by, r: F.struct(F.lit(name).alias("side"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), r.alias("r"))
    four = F.array(
        side("bottom", c("x0"), c("y0"), c("x1"), c("y0"), w / h), side("top", c("x0"), c("y1"), c("x1"), c("y1"), w / h),
        side("left", c("x0"), c("y0"), c("x0"), c("y1"), h / w), side("right", c("x1"), c("y0"), c("x1"), c("y1"), h / w),
    )
    sides = leaves.withColumn("s", F.explode(four)).select("id", "poly", "s.*")
    hung = quadtree.hanging(leaves).select("id", "side", F.lit(True).alias("hung"))
    sides = sides.join(hung, ["id", "side"], "left")
    mx, my = (c("ax") + c("bx")) / 2, (c("ay") + c("by")) / 2
    part = lambda ax, ay, bx, by, r: F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), r.alias("r"))
    whole = F.array(part(c("ax"), c("ay"), c("bx"), c("by"), c("r")))
    halves = F.array(part(c("ax"), c("ay"), mx, my, c("r") / 2), part(mx, my, c("bx"), c("by"), c("r") / 2))
    parts = sides.withColumn("p", F.explode(F.when(c("hung"), halves).otherwise(whole))).select("id", "poly", "p.*")
    key = lambda x, y: node_key(F.lit(""), c("poly"), c(x), c(y))
    e = parts.withColumns({"p": key("ax", "ay"), "q": key("bx", "by")})
    # each leaf carries half of the current along its sides, so the conductance of a side is half its square count
    edges = e.groupBy("poly", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum(1 / (2 * r_sheet * c("r"))).alias("g"), F.min("id").alias("id"))
    nodes = e.select("poly", F.explode(F.array(F.struct(c("p").alias("node"), c("ax").alias("x"), c("ay").alias("y")), F.struct(c("q").alias("node"), c("bx").alias("x"), c("by").alias("y")))).alias("n")).select("poly", "n.*").groupBy("poly", "node").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return nodes, edges


def adaptive_resistance(rects: DataFrame, r_sheet: float, cell: float, left: float, right: float, max_level: int = 3, rounds: int = 8, fraction: float = 0.5, tol: float = 0.0, max_nodes: int = 400_000) -> tuple[DataFrame, list[tuple[int, int, float, float]]]:
    """Leaves and history (round, nodes, resistance, power) of shapes between the lines x = left (1 V) and x = right
    (0 V). Stops at ``rounds``, at the node budget (the mesh before it stays), when the power changes by less than
    ``tol``, or when nothing is left to refine."""
    leaves = keep(quadtree.base_cells(rects, cell), "leaves")
    history: list[tuple[int, int, float, float]] = []
    for n in range(1, rounds + 1):
        nodes, edges = quad_network(leaves, r_sheet)
        nodes, edges = keep(nodes, "nodes"), keep(edges, "edges")
        count = nodes.count()
        if count > max_nodes and history:
            break
        ends = nodes.where((F.col("x") == left) | (F.col("x") == right)).select("poly", "node", F.when(F.col("x") == left, 1.0).otherwise(0.0).alias("value"))
        u = keep(solve.solve_components(edges, ends, "poly"), "potentials")
        at = lambda k: u.select("poly", F.col("node").alias(k), F.col("u").alias(f"u{k}"))
        lost = edges.join(at("a"), ["poly", "a"]).join(at("b"), ["poly", "b"]).withColumn("power", F.col("g") * (F.col("ua") - F.col("ub")) * (F.col("ua") - F.col("ub")))
        power = lost.agg(F.sum("power")).first()[0] or 0.0
        history.append((n, count, 1 / power if power > 1e-300 else float("inf"), power))
        if tol > 0 and n > 1 and abs(history[-2][3] - power) / power < tol:
            break
        marked = quadtree.mark_by_power(lost.groupBy("id").agg(F.sum("power").alias("power")), fraction)
        marked = keep(marked.select("id").join(leaves.where(F.col("level") < max_level).select("id"), "id", "left_semi"), "marked")
        if marked.isEmpty() or n == rounds:
            break
        leaves = quadtree.balance(quadtree.refine(leaves, marked, max_level), cell, max_level)
    return leaves, history


# ---- several polygons, layers and vias


def lattice_network(leaves: DataFrame, lat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, physical, component, x, y, poly), edges(a, b, g, cell)) of balanced leaves of lattices with ``physical``,
    ``component`` and ``r_sheet``: as :func:`quad_network`, with nodes at one place of a layer and net welded, whichever
    polygons they come from; ``cell`` holds the key of the leaf that an edge's power counts for."""
    c = F.col
    cells = lattice.boxes(leaves, lat)
    hung = lattice.hanging(leaves).groupBy(*lattice.KEY).agg(F.collect_set("side").alias("hung"))  # four at most
    cells = cells.join(hung, lattice.KEY, "left").withColumns({"w": c("x1") - c("x0"), "h": c("y1") - c("y0")})
    mid = {"x": (c("x0") + c("x1")) / 2, "y": (c("y0") + c("y1")) / 2}
    part = lambda ax, ay, bx, by, r: F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), r.alias("r"))

    def side(name: str):
        flat = name in ("bottom", "top")
        at = c({"bottom": "y0", "top": "y1", "left": "x0", "right": "x1"}[name])
        lo, hi, m, r = (c("x0"), c("x1"), mid["x"], c("w") / c("h")) if flat else (c("y0"), c("y1"), mid["y"], c("h") / c("w"))
        one = lambda a, b, r: part(a, at, b, at, r) if flat else part(at, a, at, b, r)
        return F.when(F.array_contains(F.coalesce("hung", F.array().cast("array<string>")), name), F.array(one(lo, m, r / 2), one(m, hi, r / 2))).otherwise(F.array(one(lo, hi, r)))

    parts = cells.withColumn("p", F.explode(F.concat(*[side(s) for s in lattice.SIDES]))).select("poly", "physical", "component", "r_sheet", F.struct(*lattice.KEY).alias("cell"), "p.*")
    key = lambda x, y: node_key(c("physical"), c("component"), c(x), c(y))
    e = parts.withColumns({"p": key("ax", "ay"), "q": key("bx", "by")})
    edges = e.groupBy("poly", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum(1 / (2 * c("r_sheet") * c("r"))).alias("g"), F.min("cell").alias("cell"))
    spot = lambda n, x, y: F.struct(c(n).alias("node"), c(x).alias("x"), c(y).alias("y"))
    nodes = e.select("poly", "physical", "component", F.explode(F.array(spot("p", "ax", "ay"), spot("q", "bx", "by"))).alias("n")).select("poly", "physical", "component", "n.*")
    return nodes.groupBy("node", "physical", "component").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.collect_set("poly").alias("polys")), edges.drop("poly")


def joined_network(nodes: DataFrame, edges: DataFrame, vias: DataFrame, links: DataFrame, grid: float = 4.0) -> DataFrame:
    """The edges (a, b, g, cell) of :func:`lattice_network` with those of vias (id, bottom, top, component, r, x, y, hx, hy),
    the stitches of polygons that meet (links a, b) and the links of loose fragments; ``cell`` is null for these."""
    spots = nodes.select(F.col("node").alias("id"), "physical", "component", "x", "y")
    ends = []
    for side in ("bottom", "top"):
        feet = vias.select("id", F.col(side).alias("physical"), "component", "x", "y", "hx", "hy")
        ends.append(spatial.footprint_nodes(feet, spots, grid, 1e-12, ["physical", "component"]).where("node is not null").withColumnRenamed("box", "via"))
    through = network.via_edges(vias.select(F.col("id").alias("via"), "r"), *ends).select("a", "b", "g")
    stitches = network.stitch(links, nodes.withColumn("poly", F.explode("polys")).select("poly", "node", "x", "y"))
    every = keep(edges.select("a", "b", "g", "cell").unionByName(through.unionByName(stitches), allowMissingColumns=True), "edges")
    loose = network.fragments(every, nodes.withColumnRenamed("component", "net").drop("polys"))
    return every.unionByName(loose, allowMissingColumns=True)


def adaptive_layers(rects: DataFrame, vias: DataFrame, terminals: DataFrame, links: DataFrame, cell: float, max_level: int = 3, rounds: int = 8, fraction: float = 0.5, tol: float = 0.0, max_nodes: int = 400_000, cap: int = 30, start: DataFrame | None = None) -> tuple[DataFrame, list[tuple[int, int, float, float]]]:
    """Leaves and history (round, nodes, resistance, power) of a net over several rectangles (id, physical, component,
    r_sheet, x0..y1) and layers, with ``vias`` and ``links`` as :func:`joined_network` takes them, between the ``terminals``
    (name, voltage, physical, x, y, hx, hy) at 1 and 0 V. Stops as :func:`adaptive_resistance` does. ``start``: leaves to
    begin with, else those of level 0."""
    lat = keep(lattice.lattices(rects, cell, cap, ["physical", "component", "r_sheet"]), "lattices")
    leaves = keep(lattice.base(lat) if start is None else lattice.balanced(start, lat, max_level), "leaves")
    history: list[tuple[int, int, float, float]] = []
    for n in range(1, rounds + 1):
        nodes, edges = lattice_network(leaves, lat)
        nodes = keep(nodes, "nodes")
        count = nodes.count()
        if count > max_nodes and history:
            break
        edges = keep(joined_network(nodes, edges, vias, links), "edges")
        spots = nodes.select(F.col("node").alias("id"), "physical", "x", "y")
        pins = terminals.withColumn("id", F.xxhash64("name"))
        held = spatial.footprint_nodes(pins, spots, 4.0, 1e-12, ["physical"]).where("node is not null")
        parts = keep(components(edges.select("a", "b")).withColumnRenamed("component", "key"), "parts")
        fixed = held.join(pins.select(F.col("id").alias("box"), "voltage"), "box").join(parts, "node").select("key", "node", F.col("voltage").alias("value"))
        keyed = keep(edges.join(parts.withColumnRenamed("node", "a"), "a"), "keyed")
        u = keep(solve.solve_by_size(keyed, fixed, "key"), "potentials")
        at = lambda k: u.select("key", F.col("node").alias(k), F.col("u").alias(f"u{k}"))
        lost = keyed.join(at("a"), ["key", "a"]).join(at("b"), ["key", "b"]).withColumn("power", F.col("g") * (F.col("ua") - F.col("ub")) * (F.col("ua") - F.col("ub")))
        lost = keep(lost.groupBy("cell").agg(F.sum("power").alias("power")), "lost")
        power = lost.agg(F.sum("power")).first()[0] or 0.0
        history.append((n, count, 1 / power if power > 1e-300 else float("inf"), power))
        if tol > 0 and n > 1 and abs(history[-2][3] - power) / power < tol:
            break
        # ties go by key: the same input marks the same cells
        by_cell = lost.where("cell is not null").select(F.col("cell").alias("id"), "power", "cell.*")
        marked = keep(quadtree.mark_by_power(by_cell, fraction).where(F.col("level") < max_level).select(*lattice.KEY), "marked")
        if marked.isEmpty() or n == rounds:
            break
        leaves = keep(lattice.balanced(lattice.split(leaves, marked, max_level), lat, max_level), "leaves")
    return lattice.boxes(leaves, lat), history
