"""Summaries of technology, netlist and results, and the lookups that reports and exports need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep
from . import spatial


def rho_summary(values: Column) -> Column:
    """A resistivity as text: one value, or of pairs (value, width) those of the narrowest and the widest."""
    n = F.coalesce(F.size(values), F.lit(0))
    at = F.sequence(F.lit(0), F.greatest((n / 2).cast("int") - 1, F.lit(0)))
    pairs = F.array_sort(F.transform(at, lambda i: F.struct(F.get(values, 2 * i + 1).alias("w"), i.alias("i"), F.get(values, 2 * i).alias("rho"))))
    lo, hi = F.element_at(pairs, 1), F.element_at(pairs, -1)
    span = F.format_string("%.4f..%.4f ohm/sq @ %.2f..%.2fum", lo["rho"], hi["rho"], lo["w"], hi["w"])
    return F.when(n < 1, "-").when(n < 2, F.format_string("%.4f ohm/sq", F.get(values, F.lit(0)))).otherwise(span)


def _numbers(fields: Column, key: str) -> Column:
    return F.transform(F.split(F.btrim(fields[key]), "\\s+"), lambda s: s.try_cast("double"))


def technology_summary(blocks: DataFrame) -> DataFrame:
    """(ord, kind, name, z0, z1, rs, ra, tc1) of technology blocks (ord, kind, name, fields): heights and resistivity of
    conductors and diffusions, resistance times area of vias (0 without an area)."""
    f = F.col("fields")
    height, thickness = f["height"].try_cast("double"), f["thickness"].try_cast("double")
    table = _numbers(f, "area_resistance")
    area = F.get(table, F.lit(1))
    sheet = F.col("kind").isin("conductor", "diffusion")
    return blocks.where(sheet | (F.col("kind") == "via")).select(
        "ord", "kind", "name", F.when(sheet, height).alias("z0"), F.when(sheet, height + thickness).alias("z1"),
        F.when(sheet, F.when(f["resistivity"].isNull(), "-").otherwise(rho_summary(_numbers(f, "resistivity")))).alias("rs"),
        F.when(~sheet, F.when(area > 0, F.get(table, F.lit(0)) * area).otherwise(0.0)).alias("ra"),
        F.coalesce(f["temp_tc1"].try_cast("double"), F.lit(0.0)).alias("tc1"),
    )


def netlist_summary(instances: DataFrame) -> DataFrame:
    """(model, n, total_w, total_weff): instances of each model and their summed widths; a missing width counts as 0."""
    width = lambda k: F.sum(F.coalesce(F.col("params")[k], F.lit(0.0)))
    return instances.groupBy("model").agg(F.count("*").alias("n"), width("w").alias("total_w"), width("weff").alias("total_weff"))


def first_templates(templates: DataFrame, n: int = 8) -> DataFrame:
    """The templates with the smallest ids."""
    return templates.orderBy("id").limit(n)


def extreme_channels(channels: DataFrame, top: int = 4, bottom: int = 3) -> DataFrame:
    """The channels (id, r) of the largest and of the smallest resistance, with which end they belong to."""
    high = channels.orderBy(F.desc("r"), "id").limit(top).withColumn("side", F.lit("top"))
    return high.unionByName(channels.orderBy("r", "id").limit(bottom).withColumn("side", F.lit("bottom")))


def terminal_component(devices: DataFrame, polygons: DataFrame, cell: float, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """(device, component): for devices (id, layer, x0..y1) the net of the polygon (id, layer, component, x0..y1) whose
    box touches theirs and whose middle is nearest; of ties the first id."""
    hit = spatial.grid_join(devices, polygons, cell, keys).where("b_component is not null")
    middle = lambda side, k: (F.col(f"{side}_{k}0") + F.col(f"{side}_{k}1")) / 2
    d2 = F.pow(middle("a", "x") - middle("b", "x"), 2) + F.pow(middle("a", "y") - middle("b", "y"), 2)
    return hit.groupBy(F.col("a_id").alias("device")).agg(F.min_by("b_component", F.struct(d2, F.col("b_id"))).alias("component"))


def leaf_of(vias: DataFrame, leaves: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """(via, leaf): the first leaf (id, x0..y1) that holds the via's middle (id, x, y), sides included, else the leaf
    with the nearest middle; vias for whose keys there is no leaf have a null."""
    spots = vias.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    inside = spatial.grid_join(spots, leaves, cell, keys).groupBy(F.col("a_id").alias("via")).agg(F.min("b_id").alias("leaf"))
    inside = keep(inside, "inside")
    middles = leaves.select("id", *keys, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    bare = vias.join(inside.select(F.col("via").alias("id")).hint("merge"), "id", "left_anti")
    return inside.unionByName(spatial.nearest(bare, middles, cell, keys, "left").select(F.col("point").alias("via"), F.col("node").alias("leaf")))


def nearest_links(vias: DataFrame, links: DataFrame, cell: float) -> DataFrame:
    """(via, link): the solved link (id, x, y) that is nearest to a via's middle (id, x, y); of ties the first id; null
    where there is no link at all."""
    return spatial.nearest(vias, links, cell, how="left").select(F.col("point").alias("via"), F.col("node").alias("link"))


def terminal_ranges(terminals: DataFrame, nodes: DataFrame, potentials: DataFrame) -> DataFrame:
    """(name, component, n, low, high): potentials in the component of each terminal's first node."""
    first = terminals.groupBy("name").agg(F.min("node").alias("node")).join(nodes.select("node", "component"), "node")
    spans = nodes.join(potentials.select("node", "u"), "node").groupBy("component").agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high"))
    return first.join(spans, "component").select("name", "component", "n", "low", "high")


def group_current(drops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, i): the current out of ``nodes(key, node)`` over edges (key, a, b, g, du); an edge counts once, from its a
    side where both ends belong to the group."""
    side = lambda k, flag: nodes.select("key", F.col("node").alias(k)).distinct().withColumn(flag, F.lit(True))
    j = drops.join(side("a", "at_a"), ["key", "a"], "left").join(side("b", "at_b"), ["key", "b"], "left")
    flow = F.col("g") * F.col("du")
    return j.groupBy("key").agg(F.sum(F.when(F.col("at_a"), flow).when(F.col("at_b"), -flow).otherwise(0.0)).alias("i"))


def total_current(currents: DataFrame) -> DataFrame:
    """One row (total, n): over all terminals (name, i), 0 by Kirchhoff's law."""
    return currents.agg(F.sum("i").alias("total"), F.count("*").alias("n"))


def cell_info(cells: DataFrame) -> DataFrame:
    """Cells with corners x0, y0 .. x3, y3 (SW, SE, NE, NW): their mean extents dx and dy, at least 1e-12."""
    c = F.col
    dx = (F.abs(c("x1") - c("x0")) + F.abs(c("x2") - c("x3"))) / 2
    dy = (F.abs(c("y3") - c("y0")) + F.abs(c("y2") - c("y1"))) / 2
    return cells.withColumns({"dx": F.greatest(dx, F.lit(1e-12)), "dy": F.greatest(dy, F.lit(1e-12))})


def merge_meshes(points: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (mesh, id, ...) and cells (mesh, nodes, ...) of several meshes as one mesh: ids from 0 in each mesh are
    moved by the numbers of points of the meshes before it."""
    before = Window.orderBy("mesh").rowsBetween(Window.unboundedPreceding, -1)  # a row for each mesh
    counts = points.groupBy("mesh").agg(F.count("*").alias("n"))
    offset = counts.select("mesh", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    moved = points.join(offset, "mesh").withColumn("id", F.col("id") + F.col("offset")).drop("offset")
    cells = cells.join(offset, "mesh").withColumn("nodes", F.expr("transform(nodes, n -> n + offset)")).drop("offset")
    return moved, cells


def numbered(df: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """Rows numbered from 0 in the order of ``by`` without one task for all: sorted ranges are numbered each and moved by
    the sizes of the ranges before."""
    ranged = keep(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offset = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(offset), "_range").withColumn(name, F.col("_own") + F.col("_offset")).drop("_own", "_offset", "_range")


def inverse3(m: Sequence[Column]) -> Column:
    """The inverse of a 3 x 3 matrix given by rows, as an array of nine; null where the determinant is under 1e-300."""
    minor = lambda r, c: [m[3 * i + j] for i in range(3) if i != r for j in range(3) if j != c]
    cofactor = lambda r, c: (lambda a, b, d, e: a * e - b * d)(*minor(r, c)) * (1 if (r + c) % 2 == 0 else -1)
    det = sum((m[c] * cofactor(0, c) for c in range(3)), F.lit(0.0))
    return F.when(F.abs(det) >= 1e-300, F.array(*[cofactor(c, r) / det for r in range(3) for c in range(3)]))


def safe_name(name: Column) -> Column:
    """A layer's name for a file: everything but ASCII letters and digits becomes an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def layer_cells(rects: DataFrame, sizes: dict[str, float], default: float) -> DataFrame:
    """Rectangles with the lateral cell size of their physical layer; sizes that are not positive do not count."""
    own = [F.lit(x) for k, v in sizes.items() if v > 0 for x in (k, float(v))]
    size = F.coalesce(F.element_at(F.create_map(*own), F.col("physical")), F.lit(default)) if own else F.lit(default)
    return rects.withColumn("lateral", size)


def resistance_report(power: DataFrame, currents: DataFrame, resistance: float) -> str:
    """The report as text: layers (layer, power, share) by power, terminals (name, i), the resistance. Layers and
    terminals are few."""
    lines = [f"Resistance: {resistance:.6g} ohm", "", f"{'layer':<16}{'power W':>16}{'share %':>12}"]
    layers = power.orderBy(F.desc("power"), "layer").collect()
    lines += [f"{r['layer']:<16}{r['power']:>16.6e}{r['share']:>12.3f}" for r in layers]
    lines += [f"{'total':<16}{sum(r['power'] for r in layers):>16.6e}", "", f"{'terminal':<16}{'current A':>16}"]
    return "\n".join([*lines, *(f"{r['name']:<16}{r['i']:>16.6e}" for r in currents.orderBy("name").collect())]) + "\n"


def channel_report(channels: DataFrame) -> str:
    """The channels (id, instance, r) as text: their number and those of the largest and the smallest resistance."""
    ends = extreme_channels(channels.select("id", "instance", "r")).collect()  # seven at most
    lines = ["", f"Channels: {channels.count()}", f"{'end':<8}{'device':>10}  {'instance':<16}{'ohm':>16}"]
    return "\n".join([*lines, *(f"{r['side']:<8}{r['id']:>10}  {r['instance'] or '-':<16}{r['r']:>16.6e}" for r in ends)]) + "\n"


def stack_problems(layers: DataFrame, vias: DataFrame) -> DataFrame:
    """(problem, item) of a stack of layers (id) and vias (item, a, b): "unknown layer" and "same layer" name the via,
    "untouched" a layer that no via names, and "separate" the first layer of each group, if the vias that join two known
    layers leave more than one group of layers, a layer by itself being one."""
    from .closure import components

    ends = vias.select("item", F.explode(F.array("a", "b")).alias("id"))
    unknown = ends.join(layers, "id", "left_anti").select("item").distinct().select(F.lit("unknown layer").alias("problem"), "item")
    same = vias.where("a = b").select(F.lit("same layer").alias("problem"), "item")
    touched = ends.select("id").distinct().hint("merge")  # a row for each layer named, not for each via
    bare = layers.join(touched, "id", "left_anti").select(F.lit("untouched").alias("problem"), F.col("id").alias("item"))
    known = vias.where("a <> b").join(layers.withColumnRenamed("id", "a"), "a", "left_semi").join(layers.withColumnRenamed("id", "b"), "b", "left_semi")
    names = components(known.select("a", "b")).withColumnRenamed("node", "id")
    groups = keep(layers.join(names, "id", "left").select(F.coalesce("component", "id").alias("item")).distinct(), "groups")
    apart = groups.join(groups.agg((F.count("*") > 1).alias("many")), F.col("many")).select(F.lit("separate").alias("problem"), "item")
    return unknown.unionByName(same).unionByName(bare).unionByName(apart)


def by_kind(devices: DataFrame, kind: str = "template", width: str = "w") -> DataFrame:
    """(kind, n, total_w, first_name): devices (id, name, kind, width) of each kind."""
    return devices.groupBy(kind).agg(F.count("*").alias("n"), F.sum(width).alias("total_w"), F.min_by("name", "id").alias("first_name"))


def ranges(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, low, high, n) of the values in each group."""
    return values.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
