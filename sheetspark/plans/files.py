"""A run from files: a settings document names the layout, its maps and the technology; lengths are in micrometres.

Layout shapes on conducting layers become polygons with the sheet resistance of their technology layer at their width,
shapes on via layers become vias with the reference resistance scaled to their area, both at the run's temperature. With a
device table, shapes on layers named like its entries become channels, whose resistances follow from the model table at the
voltages that they settle at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.geometry import bbox, clean_ring
from ..log import LOG, section
from ..operators import devices, fields, spatial, summary
from ..sources import gdsii, text
from ..sources.config import Settings, settings
from ..storage import keep
from . import channels as chan
from . import sheet_rds, views

METRE = 1e6


@dataclass
class Result:
    resistance: float
    power: DataFrame
    currents: DataFrame
    text: str
    channels: DataFrame | None = None
    field: views.Field | None = None


def _path(root: str, name: str) -> str:
    return name if "://" in name or name.startswith("/") else f"{root.rstrip('/')}/{name}"


def _pairs(values: Column) -> Column:
    """Pairs (width, rho) of a resistivity; a single value holds at every width."""
    n = F.size(values)
    at = F.sequence(F.lit(0), F.greatest((n / 2).cast("int") - 1, F.lit(0)))
    pair = lambda w, rho: F.struct(w.alias("width"), rho.alias("rho"))
    return F.when(n < 2, F.array(pair(F.lit(0.0), F.get(values, F.lit(0))))).otherwise(F.transform(at, lambda i: pair(F.get(values, 2 * i + 1), F.get(values, 2 * i))))


def _warmth(blocks: DataFrame, temperature: float) -> Column:
    """The temperature factor of a block; the reference temperature is the process's, else 25 degrees."""
    row = blocks.where("kind = 'process'").select(F.col("fields")["temp_reference"].try_cast("double").alias("t")).first()  # one block
    zero, f = F.lit(0.0), F.col("fields")
    reference = row["t"] if row is not None and row["t"] is not None else physics.REFERENCE_C
    return physics.temp_factor(F.coalesce(f["temp_tc1"].try_cast("double"), zero), F.coalesce(f["temp_tc2"].try_cast("double"), zero), F.lit(temperature), reference)


def _shapes(spark: SparkSession, s: Settings, root: str) -> tuple[DataFrame, float]:
    """(id, logical, points in micrometres) of the layout, and the micrometres of its database unit."""
    names, _ = text.layer_numbers(text.read_lines(spark, _path(root, s.paths["gds_map"])))
    elements = gdsii.read_gds(spark, _path(root, s.paths["layout"]))
    unit = elements.agg(F.max("dbu_meters")).first()[0]
    scaled = F.transform("points", lambda p: F.struct((p["x"] * METRE).alias("x"), (p["y"] * METRE).alias("y")))
    shapes = gdsii.layout(elements, names).select(F.col("poly_id").alias("id"), "logical", clean_ring(scaled).alias("points"))
    return shapes, (unit or 0.0) * METRE


def inputs(spark: SparkSession, s: Settings, root: str) -> tuple[DataFrame, DataFrame]:
    """(polygons, vias) as :func:`sheet_rds.build` takes them."""
    lines = lambda key: text.read_lines(spark, _path(root, s.paths[key]))
    roles, _ = text.layer_map(lines("layer_map"))
    blocks, diags = text.technology(lines("tech_ict"))
    for d in diags.limit(20).collect():
        LOG.warning("line %s: %s", d["line"], d["message"])
    f = F.col("fields")
    shapes = _shapes(spark, s, root)[0].join(roles, "logical").withColumn("b", bbox(F.col("points")))
    w, h = F.col("b.max_x") - F.col("b.min_x"), F.col("b.max_y") - F.col("b.min_y")
    factor = _warmth(blocks, s.temperature_c)
    sheets = blocks.where("kind in ('conductor', 'diffusion')").where(f["resistivity"].isNotNull())
    rho = sheets.select(F.col("name").alias("layer"), F.explode(_pairs(text.numbers(f["resistivity"]))).alias("p")).select("layer", "p.width", "p.rho")
    flat = shapes.where("role = 'conducting'")
    at = fields.rho_at_width(flat.select("id", F.col("physical").alias("layer"), F.least(w, h).alias("width")), rho)
    warm = sheets.select(F.col("name").alias("physical"), factor.alias("factor"))
    polygons = flat.join(at, "id").join(warm, "physical").select("id", "logical", "physical", "points", (F.col("rho") * F.col("factor")).alias("r_sheet"))
    table = text.numbers(f["area_resistance"])
    kinds = blocks.where("kind = 'via'").select(
        F.col("name").alias("physical"), F.btrim(f["bottom_layer"], F.lit('"')).alias("bottom"), F.btrim(f["top_layer"], F.lit('"')).alias("top"),
        F.get(table, F.lit(0)).alias("r_ref"), F.coalesce(F.get(table, F.lit(1)), F.lit(0.0)).alias("a_ref"), factor.alias("factor"))
    vias = shapes.where("role = 'via'").join(kinds, "physical").select(
        "id", "physical", "bottom", "top", (physics.via_resistance(F.col("r_ref"), F.col("a_ref"), w * h) * F.col("factor")).alias("r"),
        ((F.col("b.min_x") + F.col("b.max_x")) / 2).alias("x"), ((F.col("b.min_y") + F.col("b.max_y")) / 2).alias("y"), (w / 2).alias("hx"), (h / 2).alias("hy"))
    return polygons, vias


def heights(spark: SparkSession, s: Settings, root: str) -> DataFrame:
    """(name, height, thickness) in micrometres of the technology's sheets, null where it doesn't tell."""
    f = F.col("fields")
    blocks = text.technology(text.read_lines(spark, _path(root, s.paths["tech_ict"])))[0]
    return blocks.where("kind in ('conductor', 'diffusion')").select("name", f["height"].try_cast("double").alias("height"), f["thickness"].try_cast("double").alias("thickness"))


def pins(spark: SparkSession, s: Settings) -> DataFrame:
    """The settings' terminals, at most a few: name, voltage, layer, middle and extents in micrometres."""
    rows = [(str(t["name"]), float(t.get("voltage") or 0), t.get("layer"), *(float(t.get(k) or 0) for k in ("x_um", "y_um")), *(float(t.get(k) or 0) / 2 for k in ("dx_um", "dy_um"))) for t in s.terminals]
    return spark.createDataFrame(rows, "name string, voltage double, physical string, x double, y double, hx double, hy double")


def settled(spark: SparkSession, s: Settings, root: str, net: sheet_rds.Network) -> DataFrame | None:
    """Channels (id, instance, drain, gate, source, w, r) at the resistances that they settle at; None without a device
    table, or without a model table if the settings leave such channels open."""
    if not s.paths.get("devtab"):
        return None
    lines = lambda key: text.read_lines(spark, _path(root, s.paths[key]))
    nothing = lambda schema: spark.createDataFrame([], schema)
    given = lambda key, parser, schema: parser(lines(key))[0] if s.paths.get(key) else nothing(schema)
    shapes, unit = _shapes(spark, s, root)
    instances = given("spi", text.spice_instances, "name string, nodes array<string>, model string, params map<string,double>, x double, y double, d string")
    names = given("net_names", text.net_names, "id long, name string")
    dictionary = given("pin_xy", text.device_templates, "id long, model string, seed string, terminals array<struct<term:string,layer:string>>")
    found = keep(chan.found_devices(shapes, text.device_table(lines("devtab"))[0]), "devices")
    matched = keep(chan.with_instances(found, instances, unit), "matched")
    components = chan.role_components(matched, net, names, dictionary, _ports(spark, s, root, unit))
    made = keep(chan.channels(net, matched, components), "channels")
    n, with_instance = made.agg(F.count("*"), F.count("instance")).first()
    LOG.info("%d channels, %d of them with an instance", n, with_instance)
    if not n:
        return None
    if not s.paths.get("model_csv"):
        if s.solver.missing_model == "error":
            raise ValueError("channels need a model table")
        LOG.warning("no model table: channels are open")
        return None
    table, reference, _ = text.model_table(lines("model_csv"))
    state, rounds = sheet_rds.bias_loop(net, made, table, reference.first()["w_ref"], s.solver.bias_tolerance, s.solver.bias_iterations, s.temperature_c)
    LOG.info("channels settled after %d rounds", rounds)
    return made.join(state, "id").join(matched.select("id", *spatial.BOX), "id")


def _ports(spark: SparkSession, s: Settings, root: str, unit: float) -> DataFrame:
    if not s.paths.get("ports"):
        return spark.createDataFrame([], "name string, id long, direction string, x double, y double, net string")
    return text.ports(text.read_lines(spark, _path(root, s.paths["ports"])), unit)[0]


def run(spark: SparkSession, document: str, root: str) -> Result:
    """The whole run of a settings document whose relative paths start at ``root``. A port that no terminal bears the name
    of has no voltage, and the run is refused."""
    s = settings(document)
    if len(s.terminals) < 2:
        raise ValueError("a run needs two terminals")
    with section("inputs"):
        polygons, vias = inputs(spark, s, root)
        held = pins(spark, s)
        left = devices.unserved_ports(_ports(spark, s, root, 1.0), held).select("name").orderBy("name").limit(20).collect()
        if left:
            raise ValueError(f"ports without a terminal: {', '.join(r['name'] for r in left)}")
    with section("network"):
        m = s.meshing
        sizes = {k: float(v) for k, v in m.per_layer_cell_um.items()}
        net = sheet_rds.build(polygons, vias, held, m.cell_um, m.max_cells, m.via_group_um, layer_sizes=sizes)
    with section("channels"):
        on = settled(spark, s, root, net)
    with section("solve"):
        extra = None if on is None else on.where("r < double('infinity')").select(F.col("drain").alias("a"), F.col("source").alias("b"), (1 / F.col("r")).alias("g"), F.lit("channels").alias("layer"))
        drops, u = sheet_rds.solved(net, extra)
        power, resistance, currents = sheet_rds.totals(net, drops)
    LOG.info("resistance %.6g ohm", resistance)
    report = summary.resistance_report(power, currents, resistance)
    field = views.Field(net, u, vias, currents, heights(spark, s, root), on, m.cell_um)
    return Result(resistance, power, currents, report if on is None else report + summary.channel_report(on), on, field)
