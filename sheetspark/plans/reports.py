"""Queries of the summaries and report lookups, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import geometry as geo
from ..operators import export, rects, summary
from ..storage import spread
from .queries import CELL, _drops, query, tidy


@query("SELECT layer, printf('%.4f..%.4f ohm/sq @ %.2f..%.2fum', arg_min(rho, width), arg_max(rho, width), min(width), max(width)) AS rs FROM f_rho GROUP BY layer", "f_rho")
def rho_table_summary(spark, d):
    pairs = view(spark, d, "f_rho").groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("width", "rho")), asc=False).alias("p"))
    return pairs.select("layer", summary.rho_summary(F.flatten(F.transform("p", lambda p: F.array(p["rho"], p["width"])))).alias("rs"))


@query("""SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'conductor' ELSE 'via' END AS kind, 'L' || p_partkey AS name,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS z0, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5::DOUBLE END AS z1,
  CASE WHEN p_partkey % 2 = 0 THEN printf('%.4f ohm/sq', CAST(p_size AS DOUBLE)) END AS rs, CASE WHEN p_partkey % 2 = 1 THEN p_size * 0.25::DOUBLE END AS ra FROM part""")
def technology_summary(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size").cast("string")
    made = F.create_map(F.lit("height"), size, F.lit("thickness"), F.lit("0.5"), F.lit("resistivity"), size, F.lit("area_resistance"), F.concat(size, F.lit(" 0.25")))
    blocks = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, "conductor").otherwise("via").alias("kind"), F.concat(F.lit("L"), F.col("p_partkey")).alias("name"), made.alias("fields"))
    return summary.technology_summary(blocks).drop("tc1")


@query("SELECT template AS model, count(*) AS n, sum(w) AS total_w, sum(CASE WHEN id % 2 = 0 THEN h ELSE 0 END) AS total_weff FROM f_seed GROUP BY template", "f_seed")
def netlist_summary(spark, d):
    both = F.create_map(F.lit("w"), F.col("w"), F.lit("weff"), F.col("h"))
    params = F.when(F.col("id") % 2 == 0, both).otherwise(F.create_map(F.lit("w"), F.col("w")))
    return summary.netlist_summary(view(spark, d, "f_seed").select(F.col("template").alias("model"), params.alias("params")))


@query("SELECT id, layer FROM f_rect ORDER BY id LIMIT 8", "f_rect")
def first_templates(spark, d):
    return summary.first_templates(view(spark, d, "f_rect").select("id", "layer"))


@query("""(SELECT id, r, 'top' AS side FROM f_via ORDER BY r DESC, id LIMIT 4) UNION ALL (SELECT id, r, 'bottom' AS side FROM f_via ORDER BY r, id LIMIT 3)""", "f_via")
def extreme_channels(spark, d):
    return summary.extreme_channels(view(spark, d, "f_via").select("id", "r"))


@query("""SELECT id AS device, component FROM (
  SELECT v.id, r.id % 7 AS component, row_number() OVER (PARTITION BY v.id ORDER BY (v.x - (r.x0 + r.x1) / 2) ** 2 + (v.y - (r.y0 + r.y1) / 2) ** 2, r.id) AS k
  FROM f_via v JOIN f_rect r ON r.x1 >= v.x - 4 AND r.x0 <= v.x + 4 AND r.y1 >= v.y - 4 AND r.y0 <= v.y + 4) WHERE k = 1""", "f_via", "f_rect")
def terminal_component(spark, d):
    v = view(spark, d, "f_via").select("id", F.lit("m").alias("layer"), (F.col("x") - 4).alias("x0"), (F.col("y") - 4).alias("y0"), (F.col("x") + 4).alias("x1"), (F.col("y") + 4).alias("y1"))
    r = view(spark, d, "f_rect").withColumns({"layer": F.lit("m"), "component": F.col("id") % 7})
    return summary.terminal_component(v, r, CELL)


@query("""SELECT id AS via, leaf FROM (
  SELECT s.id, r.id AS leaf, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1 THEN -1
    ELSE (s.x - (r.x0 + r.x1) / 2) ** 2 + (s.y - (r.y0 + r.y1) / 2) ** 2 END, r.id) AS k FROM f_seed s CROSS JOIN f_rect r) WHERE k = 1""", "f_seed", "f_rect")
def via_leaf(spark, d):
    return summary.leaf_of(view(spark, d, "f_seed").select("id", "x", "y"), view(spark, d, "f_rect").drop("layer"), CELL)


@query("SELECT 'T' || layer AS name, layer AS component, count(*) AS n, min(u) AS low, max(u) AS high FROM f_grid GROUP BY layer", "f_grid")
def terminal_ranges(spark, d):
    g = view(spark, d, "f_grid").select((F.col("layer").cast("long") * 10000 + F.col("ix") * 100 + F.col("iy")).alias("node"), F.col("layer").alias("component"), "u")
    t = g.where("node % 10000 = 0").select(F.concat(F.lit("T"), F.col("component").cast("string")).alias("name"), "node")
    return summary.terminal_ranges(t, g.select("node", "component"), g.select("node", "u"))


@query("SELECT 0.0::DOUBLE AS total, 2 * count(DISTINCT chain) AS n FROM f_chain", "f_chain")
def total_current(spark, d):
    from ..operators import fields

    drops = _drops(spark, d)
    ends = drops.groupBy("key").agg(F.min(F.least("a", "b")).alias("low"), F.max(F.greatest("a", "b")).alias("high"))
    t = ends.select("key", F.explode(F.create_map(F.concat(F.col("key"), F.lit("-")), F.col("low"), F.concat(F.col("key"), F.lit("+")), F.col("high"))).alias("name", "node"))
    return summary.total_current(fields.terminal_currents(drops, t)).select(tidy(F.col("total")).alias("total"), "n")


@query("SELECT id, greatest((x1 - x0 + x1 + 1 - x0) / 2, 1e-12::DOUBLE) AS dx, y1 - y0 AS dy FROM f_rect", "f_rect")
def cell_info(spark, d):
    r = view(spark, d, "f_rect").selectExpr("id", "x0", "y0", "x1", "y0 AS ya", "x1 + 1 AS x2", "y1 AS y2", "x0 AS x3", "y1 AS y3").withColumnRenamed("ya", "y1")
    return summary.cell_info(r).select("id", "dx", "dy")


@query("SELECT layer AS mesh, ix, iy, CAST(layer * 625 + ix * 25 + iy AS BIGINT) AS first, CAST(layer * 625 + (ix + 1) * 25 + iy + 1 AS BIGINT) AS last FROM f_grid WHERE ix < 24 AND iy < 24", "f_grid")
def merge_meshes(spark, d):
    g = view(spark, d, "f_grid").withColumn("mesh", F.col("layer"))
    number = F.col("ix").cast("long") * 25 + F.col("iy")
    cells = g.where("ix < 24 and iy < 24").select("mesh", "ix", "iy", F.array(number, number + 25, number + 26, number + 1).alias("nodes"))
    _, merged = summary.merge_meshes(g.select("mesh", number.alias("id"), "x", "y"), cells)
    return merged.select("mesh", "ix", "iy", F.col("nodes")[0].alias("first"), F.col("nodes")[2].alias("last"))


@query("SELECT layer, id, row_number() OVER (ORDER BY layer, id) - 1 AS number FROM f_rect", "f_rect")
def leaf_order(spark, d):
    return summary.numbered(view(spark, d, "f_rect").select("layer", "id"), "layer", "id")


@query("SELECT id, CASE WHEN id % 10 <> 0 THEN round(1 / (x1 - x0), 6) END AS a, CASE WHEN id % 10 <> 0 THEN round(-1 / (x1 - x0), 6) END AS c, CASE WHEN id % 10 <> 0 THEN round(1 / (y1 - y0), 6) END AS e FROM f_rect", "f_rect")
def matrix_inverse(spark, d):
    zero, one = F.lit(0.0), F.lit(1.0)
    h = F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("y1") - F.col("y0"))
    m = summary.inverse3([F.col("x1") - F.col("x0"), zero, one, zero, h, zero, zero, zero, one])
    return view(spark, d, "f_rect").withColumn("m", m).select("id", F.round(F.col("m")[0], 6).alias("a"), F.round(F.col("m")[2], 6).alias("c"), F.round(F.col("m")[4], 6).alias("e"))


@query("SELECT id, regexp_replace(layer, '[^A-Za-z0-9]', '_', 'g') AS file, CASE WHEN layer LIKE 'S%' THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS lateral FROM f_rect", "f_rect")
def layer_files(spark, d):
    r = view(spark, d, "f_rect").withColumnRenamed("layer", "physical")
    sizes = {x.physical: 0.5 if x.physical.startswith("S") else -1.0 for x in r.select("physical").distinct().collect()}  # a row for each layer
    return summary.layer_cells(r, sizes, 2.0).select("id", summary.safe_name(F.col("physical")).alias("file"), "lateral")


@query("""WITH v AS (SELECT o_orderkey AS item, o_orderkey % 12 AS a, (o_orderkey % 12 + 3) % 12 AS b FROM orders WHERE o_orderkey % 12 <> 5)
SELECT 'separate' AS problem, CAST(k AS BIGINT) AS item FROM range(3) t(k) UNION ALL SELECT 'untouched', 12 UNION ALL SELECT 'separate', 12
UNION ALL SELECT 'unknown layer', item FROM v WHERE a > 12 OR b > 12""")
def stack_groups(spark, d):
    """Thirteen layers whose vias go up by three, round about: three groups and a layer by itself."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 12 <> 5")
    v = o.select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 12).alias("a"), ((F.col("o_orderkey") % 12 + 3) % 12).alias("b"))
    return summary.stack_problems(spark.range(13), v)


@query("SELECT id, CAST(3 AS BIGINT) AS n, round((x1 - x0) * (y1 - y0) * 0.75e0, 6) AS area FROM f_rect", "f_rect")
def channel_cut_area(spark, d):
    """Active boxes without two gates that cross them: three channels each."""
    r = view(spark, d, "f_rect")
    x, w, y0, y1 = F.col("x0"), F.col("x1") - F.col("x0"), F.col("y0"), F.col("y1")
    gate = lambda k: geo.rect_ring(x + w * k / 8, y0 - 1, x + w * (k + 1) / 8, y1 + 1)
    left = rects.subtract(spread(r, F.lit(1), rects.KERNEL).select("id", geo.rect_ring(x, y0, F.col("x1"), y1).alias("ring"), F.array(gate(2), gate(5)).alias("cuts")))
    return left.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 6).alias("area"))


@query("""SELECT concat('dev', CAST(c_custkey AS VARCHAR)) AS name, 'NMOS' AS kind, CASE WHEN c_custkey % 4 <> 0 THEN concat('nch', CAST(c_nationkey AS VARCHAR)) END AS model,
 CASE WHEN c_custkey % 2 = 0 THEN 'd:rx' ELSE 'd:rx,g:pc' END AS terminals, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'prop' END AS layers, 'w,l' AS params FROM customer WHERE c_custkey % 9 <> 0""")
def parse_devtab(spark, d):
    """Device entries over several lines, one file for each customer; a ninth of them break off."""
    from ..sources import text

    c = spark.read.parquet(f"{d}/customer.parquet")
    k, s = F.col("c_custkey"), lambda *v: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v])
    pins = F.when(k % 2 == 0, s("1", "d rx")).otherwise(s("2", "d rx", "g pc"))
    head = s("Device Entry", "Mon Jan 1 00:00:00 2024", F.concat(F.lit("dev"), k), "NMOS", F.when(k % 4 != 0, F.concat(F.lit("nch"), F.col("c_nationkey"))).otherwise("(null)"), "-", "-", "-")
    rows = F.concat(head, pins, F.when(k % 3 == 0, s("0")).otherwise(s("1", "prop")), F.when(k % 9 != 0, s("2", "w", "l")).otherwise(s("2", "w")))
    lines = c.select(k.cast("string").alias("source"), F.posexplode(rows).alias("pos", "value")).select("source", (F.col("pos") + 1).cast("long").alias("line"), "value")
    t = text.device_table(lines)[0]
    pin = F.transform("terminals", lambda p: F.concat_ws(":", p["name"], p["layer"]))
    return t.select("name", "kind", "model", F.concat_ws(",", pin).alias("terminals"), F.concat_ws(",", "property_layers").alias("layers"), F.concat_ws(",", "params").alias("params"))


@query("""SELECT id, layer, CASE WHEN layer LIKE 'P%' THEN 1e0 ELSE 4e0 END AS z0, CASE WHEN layer LIKE 'P%' THEN 2e0 ELSE 4.5e0 END AS z1, CAST(8 AS INTEGER) AS corners,
 round((x1 - x0) * (y1 - y0) * CASE WHEN layer LIKE 'P%' THEN 1e0 ELSE 0.5e0 END, 6) AS volume FROM f_rect WHERE layer LIKE 'P%' OR layer LIKE 'S%'""", "f_rect")
def stack_export(spark, d):
    """Cells as boxes of a stack of two layers; cells of other layers have no height."""
    r = view(spark, d, "f_rect").withColumn("physical", F.substring("layer", 1, 1))
    z = spark.createDataFrame([("P", 1.0, 2.0), ("S", 4.0, 4.5)], "physical string, z0 double, z1 double")
    c = export.stack_cells(r, z)
    p = lambda k: F.get("points", F.lit(k))
    volume = (p(1)["x"] - p(0)["x"]) * (p(3)["y"] - p(0)["y"]) * (p(4)["z"] - p(0)["z"])
    return c.select("id", "layer", "z0", "z1", F.size("points").alias("corners"), F.round(volume, 6).alias("volume"))


@query("SELECT layer, count(*) AS n, sum(u) AS total FROM f_grid GROUP BY layer", "f_grid")
def fingerprint_cache(spark, d):
    """The solution on the grid, saved under the fingerprint of its inputs and found again by it."""
    import uuid

    from ..storage import shared_dir

    root = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    key = export.fingerprint({"cell": CELL, "tables": d}, [("region", 1, 1), ("nation", 1, 1)])
    export.save_fields({"nodes": view(spark, d, "f_grid")}, root, key)
    return export.load_fields(spark, root, key, ["nodes"])["nodes"].groupBy("layer").agg(F.count("*").alias("n"), F.sum("u").alias("total"))


def _out(spark, name: str) -> str:
    import uuid

    from ..storage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(id % 8 AS INTEGER) AS layer, count(*) AS n, CAST(count(*) FILTER (WHERE id % 8 < 4) AS BIGINT) AS n_low,
 CAST(sum(floor(abs(x1 - x0) * 1000 + 0.5)) AS BIGINT) AS width FROM f_rect GROUP BY id % 8""", "f_rect")
def gds_files_roundtrip(spark, d):
    """Rectangles as layout streams of at most 100 polygons a file, written and read by many tasks."""
    from ..sinks import parts
    from ..sources import gdsii

    r = view(spark, d, "f_rect").select("id", *[(F.col(c) * 1e-6).alias(c) for c in ("x0", "y0", "x1", "y1")])
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    made = r.select(F.lit("rects").alias("file"), F.when(F.col("id") % 8 < 4, "LOW").otherwise("HIGH").alias("cell"), (F.col("id") % 8).cast("int").alias("layer"), F.lit(0).alias("datatype"), ring.alias("points"))
    root = _out(spark, "gds")
    parts.write_files(parts.gds_files(made, 1e-9, per=100), root)
    back = gdsii.read_gds(spark, root).select(F.col("layer").cast("int").alias("layer"), "struct_name", F.abs(F.col("xy")[1]["x"] - F.col("xy")[0]["x"]).alias("w"))
    return back.groupBy("layer").agg(F.count("*").alias("n"), F.count(F.when(F.col("struct_name") == "LOW", True)).alias("n_low"), F.sum("w").cast("long").alias("width"))


@query("""SELECT layer AS mesh, CAST(count(*) AS BIGINT) AS n_cells, CAST(ceil(count(*) / 50) AS BIGINT) AS n_files, round(sum((x1 - x0) * (y1 - y0)), 3) AS area
 FROM (SELECT regexp_replace(layer, '[^A-Za-z0-9]', '_', 'g') AS layer, x0, y0, x1, y1 FROM f_rect) GROUP BY layer""", "f_rect")
def grid_files(spark, d):
    """Rectangles as unstructured grids, read back from the files' own text: cells and the sum of their areas."""
    from ..sinks import parts

    r = view(spark, d, "f_rect").withColumns({"mesh": summary.safe_name(F.col("layer")), "area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))})
    made = _quads(r)
    root = _out(spark, "grids")
    parts.write_files(parts.vtu_files(made, ["area"], per=50), root)
    text = spark.read.text(f"{root}/*/*.vtu", wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("mesh"), "value")
    cells = F.regexp_extract("value", 'NumberOfCells="([0-9]+)"', 1).cast("long")
    body = F.regexp_extract("value", 'Name="area"[^>]*>([^<]*)<', 1)
    areas = F.aggregate(F.transform(F.filter(F.split(body, "\\s+"), lambda v: v != ""), lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return text.groupBy("mesh").agg(F.sum(cells).alias("n_cells"), F.count("*").alias("n_files"), F.round(F.sum(areas), 3).alias("area"))


def _quads(r):
    """(mesh, whole, kind, points, area) of rectangles at height 0 without a potential."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("u"))
    return r.select("mesh", F.lit("all").alias("whole"), F.lit("quad").alias("kind"), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("points"), "area")
