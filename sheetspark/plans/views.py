"""All exports of a solved run in one call: colour maps as layout streams with their layer properties, the sheet and the
stack as unstructured grids, each as many files as its size asks for.

Lengths of a run are micrometres; layout streams get metres.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cells_for
from ..log import LOG, section
from ..operators import export, fields, network, spatial, summary
from ..sinks import parts
from ..sinks.files import COLOURS, STRIDE, binned, layer_properties
from ..storage import keep
from .sheet_rds import Network

MICRO = 1e-6
#: First layer numbers of the maps: fixed values.
BASES = {"potential": 1000, "current_density": 2000, "mesh": 3000, "power": 4000, "current": 5000, "resistance": 6000, "channel_resistance": 7000, "via_current": 8000}
#: Half the side of a via's mark, the least extent and the height of a terminal's box in micrometres: fixed values.
VIA_HALF, TERMINAL_PAD, TERMINAL_RISE = 0.25, 0.25, 0.3
VALUES = ["current_density", "power_W", "current_A", "resistance_ohm", "via_current_A", "net_id", "layer_id", "conductivity_S_m", "channel_ohm"]
CELL_KEY = ["id", "physical", "component", "r_sheet", "cx0", "cy0", "cx1", "cy1"]


@dataclass
class Field:
    """What a run solved: the network, (key, node, u), vias(id, physical, bottom, top, x, y, hx, hy), (name, i) of terminals,
    (name, height, thickness) of sheets, settled channels(id, drain, source, r, x0..y1), and the cell of a channel."""

    net: Network
    potentials: DataFrame
    vias: DataFrame
    currents: DataFrame
    heights: DataFrame
    channels: DataFrame | None = None
    cell: float = 1.0


def cells_of(field: Field) -> DataFrame:
    """Cells (id, physical, component, r_sheet, x0..y1, u0..u3, gx, gy, power, density, potential, current, resistance); the
    resistance is the cell's power over the square of the largest current of a terminal, null without any current."""
    at = lambda k, x, y: F.struct(F.lit(k).alias("k"), network.node_key(F.col("physical"), F.col("component"), F.col(x), F.col(y)).alias("node"))
    corners = F.array(at(0, "cx0", "cy0"), at(1, "cx1", "cy0"), at(2, "cx1", "cy1"), at(3, "cx0", "cy1"))
    c = field.net.cells.select(*CELL_KEY, F.explode(corners).alias("c")).select(*CELL_KEY, "c.k", "c.node")
    u = c.join(field.potentials.select("node", "u"), "node", "left")
    wide = u.groupBy(*CELL_KEY).agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("u"))), F.lit(0.0)).alias(f"u{k}") for k in range(4)])
    sized = wide.withColumns({"dx": F.col("cx1") - F.col("cx0"), "dy": F.col("cy1") - F.col("cy0")})
    total = field.currents.agg(F.max(F.abs("i")).alias("_i"))
    out = fields.cell_scalars(sized).crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("resistance", F.when(F.col("_i") > 0, F.col("power") / (F.col("_i") * F.col("_i"))))
    return out.drop("_i", "dx", "dy").withColumnsRenamed({"cx0": "x0", "cy0": "y0", "cx1": "x1", "cy1": "y1"})


def links_of(field: Field) -> DataFrame:
    """(id, a, b, g, x, y, ua, ub, i, component): what joins two layers, with the current from its bottom to its top node."""
    links = fields.via_links(field.net.edges.where("layer = 'vias'"), field.net.nodes)
    at = lambda k: field.potentials.select(F.col("node").alias(k), F.col("u").alias(f"u{k}"))
    net = field.net.nodes.select(F.col("node").alias("a"), "component")
    j = links.join(at("a"), "a").join(at("b"), "b").join(net, "a")
    return j.withColumn("i", F.col("g") * (F.col("ub") - F.col("ua"))).withColumn("id", F.xxhash64("a", "b", "g"))


def split_channels(field: Field) -> DataFrame | None:
    """Channels cut into cells: (id, i, j, n, x0..y1, resistance, component, ud, us); None without channels."""
    if field.channels is None:
        return None
    side = lambda lo, hi: cells_for(F.col(hi) - F.col(lo), F.lit(field.cell))
    boxes = export.channel_cells(field.channels, side("x0", "x1"), side("y0", "y1"))
    at = lambda k, u: field.potentials.select(F.col("node").alias(k), F.col("u").alias(u))
    ends = field.channels.join(at("drain", "ud"), "drain", "left").join(at("source", "us"), "source", "left")
    ends = ends.join(field.net.nodes.select(F.col("node").alias("drain"), "component"), "drain", "left")
    cut = boxes.groupBy("id").agg(F.count("*").alias("n"))
    return boxes.join(cut, "id").join(ends.select("id", F.col("r").alias("resistance"), "component", F.coalesce("ud", F.lit(0.0)).alias("ud"), F.coalesce("us", F.lit(0.0)).alias("us")), "id")


def _ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda x, y: F.struct((x * MICRO).alias("x"), (y * MICRO).alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def _box_ring() -> Column:
    return _ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])


def maps(cells: DataFrame, links: DataFrame, channels: DataFrame | None, bins: int = COLOURS) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Polygons of all maps as :func:`parts.gds_files` takes them, and (name, text) of their layer properties. A map without
    any item has neither."""
    layers = [r["physical"] for r in cells.select("physical").distinct().orderBy("physical").collect()]  # layers of the stack
    stride = max(bins, STRIDE)
    flat = cells.select(F.col("physical").alias("group"), _box_ring().alias("points"), "potential", F.col("density").alias("current_density"), "power", "current", "resistance")
    number = F.create_map(*[F.lit(x) for k, name in enumerate(layers) for x in (name, BASES["mesh"] + k)]) if layers else F.lit(None)
    tables, props = [], []

    def add(name: str, items: DataFrame, groups: list[str]):
        made = binned(items, BASES[name], bins, "group", stride)
        tables.append(made.select(F.lit(name).alias("file"), F.upper(F.lit(name)).alias("cell"), F.col("layer_no").cast("int").alias("layer"), F.lit(0).alias("datatype"), "points"))
        props.append((f"{name}.lyp", layer_properties([(g, BASES[name] + k * stride, 0) for k, g in enumerate(groups)], bins)))

    if layers:
        tables.append(flat.select(F.lit("mesh").alias("file"), F.lit("MESH").alias("cell"), number[F.col("group")].alias("layer"), F.lit(0).alias("datatype"), "points"))
        props.append(("mesh.lyp", layer_properties([(g, BASES["mesh"] + k, 0) for k, g in enumerate(layers)], 1)))
    for name in ("potential", "current_density", "power", "current", "resistance"):
        if layers:
            add(name, flat.select("group", "points", F.col(name).alias("value")), layers)
    marks = links.select(F.lit("Vias").alias("group"), _ring(F.col("x") - VIA_HALF, F.col("y") - VIA_HALF, F.col("x") + VIA_HALF, F.col("y") + VIA_HALF).alias("points"), F.col("i").alias("value"))
    if not marks.isEmpty():
        add("via_current", marks, ["Vias"])
    if channels is not None and not channels.isEmpty():
        add("channel_resistance", channels.select(F.lit("Channel").alias("group"), _box_ring().alias("points"), F.col("resistance").alias("value")), ["Channel"])
    out = tables[0] if tables else cells.sparkSession.createDataFrame([], "file string, cell string, layer int, datatype int, points array<struct<x:double,y:double>>")
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, props


def _prism(low: Column, high: Column, u_low: list[Column], u_high: list[Column]) -> Column:
    """The eight corners of a box between two heights."""
    xy = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    at = lambda k, z, u: F.struct(F.col(xy[k][0]).alias("x"), F.col(xy[k][1]).alias("y"), z.alias("z"), u[k].alias("u"))
    return F.array(*[at(k, low, u_low) for k in range(4)], *[at(k, high, u_high) for k in range(4)])


def _element(df: DataFrame, whole: str, layer: Column, kind: str, points: Column, values: dict[str, Column]) -> DataFrame:
    given = [values.get(v, F.lit(0.0)).cast("double").alias(v) for v in VALUES if v != "layer_id"]
    return df.select(F.concat(F.lit(f"{whole}_"), summary.safe_name(layer)).alias("mesh"), F.lit(whole).alias("whole"), layer.alias("_layer"), F.lit(kind).alias("kind"), points.alias("points"), *given)


def _scalars() -> dict[str, Column]:
    return {"power_W": F.col("power"), "current_A": F.col("current"), "resistance_ohm": F.col("resistance"), "net_id": F.col("component")}


def sheet_elements(cells: DataFrame) -> DataFrame:
    """Cells as quads at height 0, a mesh for each layer; the density is in amperes a metre."""
    p = lambda x, y, u: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("z"), F.col(u).alias("u"))
    ring = F.array(p("x0", "y0", "u0"), p("x1", "y0", "u1"), p("x1", "y1", "u2"), p("x0", "y1", "u3"))
    return _element(cells, "sheet", F.col("physical"), "quad", ring, _scalars() | {"current_density": F.col("density") / MICRO})


def stack_elements(field: Field, cells: DataFrame, links: DataFrame, channels: DataFrame | None, z_scale: float = 25.0) -> DataFrame:
    """Sheets between their heights, vias between the sheets they join with the values of their nearest link, the cells of
    channels in the lowest sheet's place, terminals above their layer; the density is in amperes a square metre. Sheets and
    vias of layers without a height are left out, and so are terminals on them."""
    h = field.heights.where("height is not null and thickness is not null")
    z = h.select(F.col("name").alias("physical"), F.col("height").alias("z0"), (F.col("height") + F.col("thickness")).alias("z1"), "thickness")
    up = lambda c: c * z_scale
    us = [F.col(f"u{k}") for k in range(4)]
    thick = F.col("thickness") * MICRO
    solid = cells.join(z.where("thickness > 0"), "physical")
    made = _element(solid, "stack", F.col("physical"), "hexahedron", _prism(up(F.col("z0")), up(F.col("z1")), us, us),
                    _scalars() | {"current_density": F.col("density") / MICRO / thick, "conductivity_S_m": 1 / (F.col("r_sheet") * thick)})
    feet = export.via_heights(field.vias, h).where("z1 > z0")
    near = summary.nearest_links(field.vias.select("id", "x", "y"), links.select("id", "x", "y"), 4.0)
    total = field.currents.agg(F.max(F.abs("i")).alias("_i"))
    v = feet.join(near.withColumnRenamed("via", "id"), "id", "left").join(links.select(F.col("id").alias("link"), "ua", "ub", "i", "component"), "link", "left").crossJoin(F.broadcast(total))  # one row
    v = v.withColumns({"x0": F.col("x") - F.col("hx"), "x1": F.col("x") + F.col("hx"), "y0": F.col("y") - F.col("hy"), "y1": F.col("y") + F.col("hy")})
    i, power = F.coalesce(F.abs("i"), F.lit(0.0)), F.coalesce(F.abs("i") * F.abs(F.col("ub") - F.col("ua")), F.lit(0.0))
    square = F.when(F.col("_i") > 0, F.col("_i") * F.col("_i"))
    flat = lambda u: [F.coalesce(F.col(u), F.lit(0.0))] * 4
    area = 4 * F.col("hx") * F.col("hy") * MICRO * MICRO
    made = made.unionByName(_element(v, "stack", F.col("physical"), "hexahedron", _prism(up(F.col("z0")), up(F.col("z1")), flat("ua"), flat("ub")),
                                     {"current_density": F.when(area > 0, i / area), "power_W": power, "current_A": i, "resistance_ohm": power / square, "via_current_A": i, "net_id": F.coalesce(F.col("component"), F.lit(-1))}))
    if channels is not None:
        low = h.agg(F.min_by(F.struct("height", "thickness"), "height").alias("b")).select(F.col("b.height").alias("z0"), (F.col("b.height") + F.col("b.thickness")).alias("z1"))
        c = channels.crossJoin(F.broadcast(low)).where("z0 is not null")  # one row
        u, dv = (F.col("ud") + F.col("us")) / 2, F.abs(F.col("ud") - F.col("us"))
        share = F.when(F.col("resistance") > 0, dv / F.col("resistance")) / F.col("n")
        made = made.unionByName(_element(c, "stack", F.lit("Channel"), "hexahedron", _prism(up(F.col("z0")), up(F.col("z1")), [u] * 4, [u] * 4),
                                         {"power_W": share * dv, "current_A": share, "net_id": F.col("component"), "channel_ohm": F.col("resistance")}))
    held = field.net.terminals.join(field.net.nodes, "node").groupBy("name", "physical").agg(F.first("voltage").alias("voltage"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"], F.min("component").alias("component")).join(z, "physical")
    wide = lambda c: F.when(F.col(f"max_{c}") - F.col(f"min_{c}") < TERMINAL_PAD, TERMINAL_PAD).otherwise(0.0)
    t = held.withColumns({f"{c}{k}": F.col(f"{n}_{c}") + s * wide(c) for c in "xy" for k, n, s in ((0, "min", -1), (1, "max", 1))})
    return made.unionByName(_element(t, "stack", F.lit("Terminal"), "hexahedron", _prism(up(F.col("z1")), up(F.col("z1") + TERMINAL_RISE), [F.col("voltage")] * 4, [F.col("voltage")] * 4), {"net_id": F.col("component")}))


def _with_layer_ids(elements: DataFrame) -> DataFrame:
    names = [r["_layer"] for r in elements.select("_layer").distinct().orderBy("_layer").collect()]  # layers of the stack
    ids = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, float(k))]) if names else F.lit(None).cast("map<string,double>")
    return elements.withColumn("layer_id", ids[F.col("_layer")])


def write_views(field: Field, path: str, dbu: float = 1e-9, z_scale: float = 25.0, bins: int = COLOURS, per: int = parts.PER_FILE) -> None:
    """Everything to look at of a solved run, as files under ``path/maps`` (colour maps) and ``path/grids`` (sheet and stack);
    files of an earlier call are replaced."""
    if bins < 2:
        raise ValueError("a map needs two bins")
    with section("views"):
        cells, links = keep(cells_of(field), "view_cells"), keep(links_of(field), "view_links")
        cut = split_channels(field)
        cut = None if cut is None else keep(cut, "view_channels")
        polygons, props = maps(cells, links, cut, bins)
        told = field.net.nodes.sparkSession.createDataFrame([(n, t.encode()) for n, t in props], parts.FILE)  # a map each
        parts.write_files(parts.gds_files(polygons, dbu, per=per).unionByName(told), f"{path.rstrip('/')}/maps")
        elements = sheet_elements(cells).unionByName(stack_elements(field, cells, links, cut, z_scale))
        parts.write_files(parts.vtu_files(_with_layer_ids(elements), VALUES, per), f"{path.rstrip('/')}/grids")
    LOG.info("views are in %s", path)
