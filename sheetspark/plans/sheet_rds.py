"""The core computation end to end: polygons, technology and terminals to resistance, power and currents.

Polygons meet their layers and technology by joins, nets come from the closure of overlaps and vias, each conducting
polygon becomes rectangles, cells and welded nodes, polygons that meet on a layer are stitched, vias join layers by
conductance, channels by a bias-dependent resistance, loose fragments of a net are merged into its main one, and every
net group is solved where it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bbox, is_rectilinear
from ..operators import closure, devices, fields, network, rects, rings, solve, spatial, summary
from ..storage import keep


@dataclass
class Network:
    """nodes(node, physical, component, x, y), edges(a, b, g, layer), terminals(name, voltage, node), and of a built one
    polygons(id, logical, component, x0..y1) and cells(id, physical, component, r_sheet, cx0..cy1)."""

    nodes: DataFrame
    edges: DataFrame
    terminals: DataFrame
    polygons: DataFrame | None = None
    cells: DataFrame | None = None


def pieces(polygons: DataFrame) -> DataFrame:
    """(id, logical, physical, x0..y1): the rectangles of polygons(id, logical, physical, points)."""
    parts = rects.decompose(polygons.select("id", F.col("points").alias("ring")))
    return parts.join(polygons.select("id", "logical", "physical").hint("merge"), "id").select("id", "logical", "physical", *spatial.BOX)


def met(parts: DataFrame, cell: float, polygons: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: polygons of which rectangles overlap or touch within a logical layer. Boxes of whole polygons would
    join what only interlocks. The rectangles of slanted polygons are steps; with ``polygons`` at hand, pairs that one of
    them belongs to are tested by their rings."""
    steps = spatial.overlap_pairs(parts.select("id", F.col("logical").alias("layer"), *spatial.BOX), cell).distinct()
    if polygons is None:
        return steps
    slanted = polygons.where(~is_rectilinear(F.col("points"))).select("id")
    if not slanted.limit(1).count():
        return steps
    edges = keep(rings.edges_of(polygons.withColumnRenamed("logical", "layer"), ["layer"]), "ring_edges")
    boxes = keep(rings.extents(edges, ["layer"]).join(slanted.withColumn("slanted", F.lit(True)), "id", "left"), "ring_boxes")
    near = spatial.grid_join(boxes, boxes, cell, ["layer"], margin=rings.TOUCH).where("a_id < b_id and (a_slanted or b_slanted)")
    exact = rings.connected(edges, cell, pairs=near)
    either = steps.join(slanted.withColumnRenamed("id", "a"), "a", "left_anti").join(slanted.withColumnRenamed("id", "b"), "b", "left_anti")
    return either.unionByName(exact)


def landings(parts: DataFrame, vias: DataFrame, cell: float) -> DataFrame:
    """(via, id): on either layer of vias(id, bottom, top, x0..y1) the polygon of least area of which a rectangle meets
    the via."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sizes = parts.groupBy(F.col("id").alias("b_id")).agg(F.sum(area).alias("area"))
    out = []
    for side in ("bottom", "top"):
        hit = spatial.grid_join(vias.select("id", F.col(side).alias("physical"), *spatial.BOX), parts.drop("logical"), cell, ["physical"])
        hit = hit.where(spatial.band_overlap() | (F.col("a_y0") == F.col("a_y1"))).select("a_id", "b_id").distinct().join(sizes, "b_id")
        out.append(hit.groupBy(F.col("a_id").alias("via")).agg(F.min_by("b_id", F.struct("area", "b_id")).alias("id")))
    return out[0].unionByName(out[1])


def nets(polygons: DataFrame, vias: DataFrame, cell: float, same: DataFrame | None = None, landed: DataFrame | None = None) -> DataFrame:
    """(id, component): polygons(id, logical, physical, points) joined by overlaps within a logical layer, and by vias
    (id, bottom, top, x0..y1) to the smallest polygon they meet on either layer. ``same`` and ``landed`` are the results of
    :func:`met` and :func:`landings`, if known."""
    if same is None or landed is None:
        parts = keep(pieces(polygons), "pieces")
        same = met(parts, cell, polygons) if same is None else same
        landed = landings(parts, vias, cell) if landed is None else landed
    joined = landed.groupBy("via").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    names = closure.components(same.unionByName(joined)).withColumnRenamed("node", "id")
    return polygons.select("id").join(names.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _held(pins: DataFrame, parts: DataFrame, component: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """(box, node): a terminal's nodes, of the net of the first polygon that its middle lies in, else of the first that
    its box meets; of any net on its layer where it meets none."""
    box = pins.select("id", "physical", "x", "y", (F.col("x") - F.col("hx")).alias("x0"), (F.col("y") - F.col("hy")).alias("y0"), (F.col("x") + F.col("hx")).alias("x1"), (F.col("y") + F.col("hy")).alias("y1"))
    hit = spatial.grid_join(box, parts.drop("logical"), cell, ["physical"], margin=1e-12)
    within = F.col("a_x").between(F.col("b_x0"), F.col("b_x1")) & F.col("a_y").between(F.col("b_y0"), F.col("b_y1"))
    first = hit.groupBy(F.col("a_id").alias("pin")).agg(F.min_by("b_id", F.struct(~within, F.col("b_id"))).alias("id"))
    known = pins.join(first.join(component, "id").select(F.col("pin").alias("id"), "component"), "id", "left")
    spots = nodes.select(F.col("node").alias("id"), "physical", "component", "x", "y")
    own = spatial.footprint_nodes(known.where("component is not null"), spots, cell, keys=["physical", "component"])
    return own.unionByName(spatial.footprint_nodes(known.where("component is null").drop("component"), spots.drop("component"), cell, keys=["physical"]))


def build(polygons: DataFrame, vias: DataFrame, terminals: DataFrame, cell: float, cap: int = 30, via_radius: float = 0.5, grid: float = 4.0, layer_sizes: dict[str, float] | None = None) -> Network:
    """``polygons(id, logical, physical, points, r_sheet)``, ``vias(id, bottom, top, r, x, y, hx, hy)``,
    ``terminals(name, voltage, physical, x, y, hx, hy)``; ``layer_sizes``: cells of physical layers other than ``cell``."""
    box = bbox(F.col("points"))
    flat = keep(polygons.withColumn("b", box).select("id", "logical", "physical", "points", "r_sheet", F.col("b.min_x").alias("x0"), F.col("b.min_y").alias("y0"), F.col("b.max_x").alias("x1"), F.col("b.max_y").alias("y1")), "polygons")
    feet = vias.withColumns({"x0": F.col("x") - F.col("hx"), "y0": F.col("y") - F.col("hy"), "x1": F.col("x") + F.col("hx"), "y1": F.col("y") + F.col("hy")})
    parts = keep(pieces(flat), "pieces")
    same = keep(met(parts, grid, flat), "met")
    landed = keep(landings(parts, feet, grid), "landed")
    component = keep(nets(flat, feet, grid, same, landed), "nets")
    told = parts.drop("logical").join(flat.select("id", "r_sheet"), "id").join(component, "id")
    sized = summary.layer_cells(told, layer_sizes or {}, cell)
    cells = network.grid_rects(sized.select("id", "physical", "component", "r_sheet", "lateral", *spatial.BOX), F.col("lateral"), cap)
    nodes = keep(network.nodes_of(cells), "nodes")
    sheet = network.fv_edges(cells).select("a", "b", "g", F.col("physical").alias("layer"))
    owned = vias.join(landed.join(component, "id").groupBy(F.col("via").alias("id")).agg(F.min("component").alias("component")), "id")
    grouped = keep(network.group_vias(owned, via_radius, ["bottom", "top", "component"]).withColumn("id", F.monotonically_increasing_id()), "vias")
    spots = nodes.select(F.col("node").alias("id"), "physical", "component", "x", "y")
    ends = []
    for side in ("bottom", "top"):
        feet = grouped.select("id", F.col(side).alias("physical"), "component", "x", "y", "hx", "hy")
        ends.append(spatial.footprint_nodes(feet, spots, grid, 1e-12, ["physical", "component"]).where("node is not null").withColumnRenamed("box", "via"))
    via = network.via_edges(grouped.select(F.col("id").alias("via"), "r"), ends[0], ends[1]).select("a", "b", "g", F.lit("vias").alias("layer"))
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("physical").alias(f"p_{k}"))
    one_layer = F.when(F.col("p_a") == F.col("p_b"), F.col("p_a")).otherwise("vias")
    on_layers = lambda links: links.join(at("a"), "a").join(at("b"), "b").select("a", "b", "g", one_layer.alias("layer"))
    stitches = on_layers(network.stitch(same, network.poly_nodes_of(cells)))
    edges = keep(sheet.unionByName(stitches).unionByName(via), "edges")
    merged = on_layers(network.fragments(edges, nodes.withColumnRenamed("component", "net")))
    edges = keep(edges.unionByName(merged), "edges")
    pins = terminals.withColumn("id", F.xxhash64("name"))
    at = _held(pins, parts, component, nodes, grid)
    fixed = at.where("node is not null").join(pins.select(F.col("id").alias("box"), "name", "voltage"), "box").select("name", "voltage", "node")
    return Network(nodes, edges, keep(fixed, "terminals"), flat.select("id", "logical", *spatial.BOX).join(component, "id"), cells)


def solved(net: Network, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with key and du, potentials): each connected part on its own; parts without a terminal are at 0 V."""
    edges = net.edges if extra is None else net.edges.unionByName(extra)
    names = keep(closure.components(edges.select("a", "b")).withColumnRenamed("component", "key"), "parts")
    keyed = edges.join(names.withColumnRenamed("node", "a"), "a")
    fixed = net.terminals.join(names, "node").select("key", "node", F.col("voltage").alias("value"))
    keyed = keep(keyed, "keyed")
    u = keep(solve.solve_by_size(keyed, fixed, "key"), "potentials")
    return keep(fields.edge_drops(keyed, u), "drops"), u


def _currents(net: Network, drops: DataFrame) -> DataFrame:
    """(name, i): the current out of each terminal."""
    ends = F.explode(F.array(F.struct("key", F.col("a").alias("node")), F.struct("key", F.col("b").alias("node"))))
    keyed = net.terminals.join(drops.select(ends.alias("n")).select("n.*").distinct(), "node")
    return fields.terminal_currents(drops, keyed.select("key", "name", "node"))


def results(net: Network, extra: DataFrame | None = None) -> tuple[DataFrame, float, DataFrame]:
    """(power by layer, resistance, currents of terminals): the resistance is |Vd - Vs| over the drain current."""
    return totals(net, solved(net, extra)[0])


def totals(net: Network, drops: DataFrame) -> tuple[DataFrame, float, DataFrame]:
    """:func:`results` from the edges of :func:`solved`."""
    pair = fields.voltage_pair(net.terminals.select("name", "voltage")).first()
    flows = keep(_currents(net, drops), "currents")
    current = {r["name"]: r["i"] for r in flows.collect()}  # a row for each terminal
    i = abs(current.get(pair["drain"]["name"], 0.0))
    r = abs(pair["drain"]["v"] - pair["source"]["v"]) / i if i > 0 else float("inf")
    return fields.power_report(drops).orderBy(F.desc("power"), "layer"), r, flows


def report(net: Network, extra: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(power by layer, resistance)."""
    return results(net, extra)[:2]


def bias_loop(net: Network, channels: DataFrame, table: DataFrame, w_ref: float, tol: float = 1e-3, rounds: int = 20, temperature: float = 27.0) -> tuple[DataFrame, int]:
    """Channels (id, drain, gate, source, w) between nodes: solve, look up each channel's resistance at its own
    voltages, repeat until no resistance changes by more than ``tol``. A channel without a valid new value keeps the old
    one. Returns (id, r) and the number of rounds."""
    start = channels.select("id", F.lit(1e3).alias("r"))
    state = keep(start, "channels")
    for n in range(1, rounds + 1):
        both = channels.join(state, "id")
        extra = both.where("r < double('infinity')").select(F.col("drain").alias("a"), F.col("source").alias("b"), (1 / F.col("r")).alias("g"), F.lit("channels").alias("layer"))
        _, u = solved(net, extra)
        at = lambda k: u.select(F.col("node").alias(k), F.col("u").alias(f"u_{k}"))
        v = both.join(at("drain"), "drain", "left").join(at("source"), "source", "left").join(at("gate"), "gate", "left")
        us = F.coalesce("u_source", F.lit(0.0))
        points = keep(v.select("id", F.lit(temperature).alias("t"), (F.coalesce("u_gate", F.lit(0.0)) - us).alias("vgs"), (F.coalesce("u_drain", F.lit(0.0)) - us).alias("vds"), "w", F.col("r").alias("old")), "bias")
        new = devices.channel_resistance(points.select("id", "t", "vgs", "vds", "w"), table, w_ref, F.col("w"))
        ok = F.col("r").isNotNull() & (F.col("r") > 0) & (F.col("r") < float("inf"))
        after = keep(points.join(new, "id").select("id", F.when(ok, F.col("r")).otherwise(F.col("old")).alias("r"), F.when(ok, F.abs(F.col("r") - F.col("old")) / F.greatest("old", F.lit(1e-30))).otherwise(0.0).alias("change")), "channels")
        state = after.select("id", "r")
        if (after.agg(F.max("change")).first()[0] or 0) < tol:
            return state, n
    return state, rounds
