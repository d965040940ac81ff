"""Channels of a run from files: seed shapes become devices, devices are matched with netlist instances, and their drain,
gate and source become nodes of the sheet network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bbox
from ..operators import devices, spatial, summary
from ..storage import keep
from .sheet_rds import Network

METRE = 1e6
#: Fixed names of each role, and its place among an instance's nodes if no template says otherwise.
ROLES = {"drain": (("d", "drain"), 0), "gate": (("g", "gate"), 1), "source": (("s", "source"), 2)}
#: Width of a channel whose instance gives none.
NO_WIDTH = 1e-3


def found_devices(shapes: DataFrame, table: DataFrame) -> DataFrame:
    """Devices (id, template, x, y, x0..y1, terminals) of shapes (id, logical, points in micrometres) on the layer that is
    named like an entry of the device table; a device has its seed's id."""
    b = F.col("b")
    boxed = shapes.withColumn("b", bbox(F.col("points"))).select("id", F.col("logical").alias("layer"), *[(b[m] / METRE).alias(c) for m, c in zip(("min_x", "min_y", "max_x", "max_y"), spatial.BOX)], F.lit(None).cast("string").alias("name"))
    templates = table.groupBy(F.col("name").alias("template")).agg(F.first("kind").alias("kind"), F.first("terminals").alias("terminals"))
    seeds = devices.recognise(boxed, templates.select(F.col("template").alias("logical"), F.col("template").alias("layer")), templates.select("template", "kind", F.col("template").alias("seed")))
    um = lambda c: F.col(c) * METRE
    out = seeds.select("id", "template", um("x0").alias("x0"), um("y0").alias("y0"), (um("x0") + um("w")).alias("x1"), (um("y0") + um("h")).alias("y1"))
    return out.withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2}).join(templates.select("template", "terminals"), "template")


def with_instances(found: DataFrame, instances: DataFrame, unit_um: float) -> DataFrame:
    """Devices with the netlist instance (name, nodes, params, d) that each takes by its middle, in the order of their ids;
    instances stand in database units of ``unit_um``, and one without a place is nobody's."""
    listed = keep(instances.withColumn("k", F.monotonically_increasing_id()), "instances")
    spots = listed.select(F.col("k").alias("id"), (F.col("x") * unit_um).alias("x"), (F.col("y") * unit_um).alias("y"))
    taken = spatial.greedy_match(found.select("id", "x", "y"), spots).select(F.col("golden").alias("id"), F.col("found").alias("k"))
    return found.join(taken, "id", "left").join(listed.select("k", F.col("name").alias("instance"), "nodes", "params", "d"), "k", "left").drop("k")


def _place(terminals: Column, names: tuple[str, ...]) -> Column:
    """The place of the first terminal with one of the names, in either case; null without any."""
    at = F.array_position(F.transform(terminals, lambda t: F.lower(t["term"]).isin(*names)), True)
    return F.when(at > 0, (at - 1).cast("int"))


def role_components(matched: DataFrame, net: Network, names: DataFrame, dictionary: DataFrame, ports: DataFrame) -> DataFrame:
    """(id, role, component): the net of each role of a device. The node at the role's place in the instance's template,
    else at its usual place, has a net name or a port of that number, which a terminal of the run bears; else a terminal
    is named like the role; else the device table names a layer for it, and the nearest polygon there that meets the
    device counts."""
    own = net.terminals.join(net.nodes.select("node", "component"), "node").groupBy("name").agg(F.min_by("component", "node").alias("component"))
    own = keep(own, "terminal_nets")
    told = matched.join(dictionary.select(F.col("id").alias("_t"), F.col("terminals").alias("order")), F.col("d").try_cast("double").cast("long") == F.col("_t"), "left")
    wish = lambda role: F.array(*[F.struct(F.lit(role).alias("role"), F.lit(n).alias("turn"), at.alias("at")) for n, at in enumerate((_place(F.col("order"), ROLES[role][0]), F.lit(ROLES[role][1])))])
    asked = told.select("id", "nodes", F.explode(F.concat(*[wish(r) for r in ROLES])).alias("w")).select("id", "w.role", "w.turn", F.get("nodes", F.col("w.at")).try_cast("double").cast("long").alias("number")).where("number is not null")
    labels = names.select(F.col("id").alias("number"), F.lit(0).alias("kind"), "name").unionByName(ports.where("id is not null").select(F.col("id").alias("number"), F.lit(1).alias("kind"), "name"))
    by_net = asked.join(labels, "number").join(own, "name").select("id", "role", F.struct(F.col("turn"), F.col("kind"), "name").alias("rank"), "component")
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("word"), F.lit(k).alias("k")) for r, (words, _) in ROLES.items() for k, n in enumerate(words)])).alias("r")
    rank = lambda turn, k: F.struct(F.lit(turn).alias("turn"), k.cast("int").alias("kind"), F.lit("").alias("name"))
    by_role = matched.select("id", roles).select("id", "r.*").join(own.withColumn("word", F.lower("name")), "word").select("id", "role", rank(2, F.col("k")).alias("rank"), "component")
    letters = matched.select("id", *spatial.BOX, F.explode("terminals").alias("t")).withColumn("word", F.lower("t.name"))
    layered = letters.select(F.concat_ws("|", F.col("id").cast("string"), "word").alias("id"), F.col("t.layer").alias("layer"), *spatial.BOX)
    near = summary.terminal_component(layered, net.polygons.select("id", F.col("logical").alias("layer"), "component", *spatial.BOX), 16.0)
    to_role = F.create_map(*[F.lit(x) for r, (words, _) in ROLES.items() for x in (words[0], r)])
    by_layer = near.select(F.split("device", "[|]")[0].cast("long").alias("id"), F.element_at(to_role, F.split("device", "[|]")[1]).alias("role"), rank(3, F.lit(0)).alias("rank"), "component").where("role is not null")
    return by_net.unionByName(by_role).unionByName(by_layer).groupBy("id", "role").agg(F.min_by("component", "rank").alias("component"))


def channels(net: Network, matched: DataFrame, components: DataFrame) -> DataFrame:
    """(id, instance, drain, gate, source, w): each role's node is the nearest one of its net; a device without a drain or
    a source is none."""
    number = F.create_map(*[F.lit(x) for k, r in enumerate(ROLES) for x in (r, k)])
    spots = components.join(matched.select("id", "x", "y"), "id").withColumn("device", F.col("id")).withColumn("id", 3 * F.col("id") + F.element_at(number, F.col("role")))
    spots = keep(spots, "roles")
    near = spatial.nearest(spots.select("id", "x", "y", "component"), net.nodes.select(F.col("node").alias("id"), "x", "y", "component"), 4.0, ["component"])
    ends = spots.select(F.col("id").alias("point"), "device", "role").join(near, "point")
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("node"))).alias(r)
    wide = ends.groupBy(F.col("device").alias("id")).agg(*[of(r) for r in ROLES]).where("drain is not null and source is not null")
    w = F.try_element_at("params", F.lit("w"))
    return wide.join(matched.select("id", "instance", F.when(w > 0, w).otherwise(NO_WIDTH).alias("w")), "id")
