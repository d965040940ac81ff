"""Batch job: the nets of a layout, layer by layer, with the vias that land on them.

Reads a table of boxes and a table of vias, finds which boxes of a layer touch (shared length in y, as the sheet network
wants it), names each net by its smallest id, puts every via on the smallest box that it meets, and writes one row a net:
its layer, number of boxes, extent, summed area of boxes, vias, and their resistance in parallel. Boxes that cannot be
used go to ``OUTPUT/rejected`` with the reason.

A run over all layers replaces ``OUTPUT/nets`` as a whole; one over some layers replaces those layers' partitions only. A
rerun gives the same rows.

Defined cases: boxes with a null in id, layer or a coordinate, with a side that is not finite or of negative length, and
boxes that repeat an id are rejected (of equal ids, all); vias with a null lie nowhere; a via without a box counts for no
net; a net without vias has no via resistance, and a via of 0 ohm or less none of its own; empty tables give no rows;
other columns are ignored.

    python -m jobs.layout_nets SHAPES VIAS OUTPUT [--config FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetspark import log
from sheetspark.operators import closure, spatial
from sheetspark.operators.summary import safe_name
from sheetspark.storage import discard, keep

from .common import config

BOX = ["x0", "y0", "x1", "y1"]
NETS = "layer string, net long, n_shapes long, x0 double, y0 double, x1 double, y1 double, area double, n_vias long, r_vias double"


def checked(shapes: DataFrame) -> DataFrame:
    """``shapes(id, layer, x0, y0, x1, y1)`` with the reason why a box cannot be used, else null."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    missing = F.col("id").isNull() | F.col("layer").isNull()
    reason = F.when(missing, "no id or layer").when(bad("x0") | bad("y0") | bad("x1") | bad("y1"), "coordinate is not a number").when((F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0")), "negative side")
    counted = shapes.groupBy("id").agg(F.count("*").alias("times")).where("times > 1 and id is not null").select("id", F.lit("id is not unique").alias("again"))
    return shapes.withColumn("reason", reason).join(counted.hint("merge"), "id", "left").withColumn("reason", F.coalesce("reason", "again")).drop("again")


def nets(shapes: DataFrame, vias: DataFrame, cell: float) -> DataFrame:
    """One row a net; see the module."""
    links = closure.components(spatial.overlap_pairs(shapes, cell)).withColumnRenamed("node", "id")
    named = keep(shapes.join(links.hint("merge"), "id", "left").withColumn("net", F.coalesce("component", "id")).drop("component"), "named")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    extent = named.groupBy("layer", "net").agg(F.count("*").alias("n_shapes"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum(area).alias("area"))
    landed = spatial.smallest_landing(vias.select("id", *BOX), named.select("id", *BOX), cell)
    on = landed.join(vias.select(F.col("id").alias("via"), "ohm").hint("merge"), "via").join(named.select("id", "net").hint("merge"), "id")
    through = on.groupBy("net").agg(F.count("*").alias("n_vias"), F.sum(F.when(F.col("ohm") > 0, 1 / F.col("ohm"))).alias("siemens"))
    return extent.join(through.hint("merge"), "net", "left").select("layer", "net", "n_shapes", *BOX, "area", F.coalesce("n_vias", F.lit(0)).alias("n_vias"), (1 / F.col("siemens")).alias("r_vias"))


def run(spark: SparkSession, shapes: DataFrame, vias: DataFrame, output: str, settings: dict) -> None:
    """Computes and writes the nets of ``shapes`` and ``vias``, whose columns the settings name."""
    cell, layers = float(settings["cell"]), [str(x) for x in settings["layers"]]
    box = [F.expr(str(settings[f"shape_{c}"])).cast("double").alias(c) for c in BOX]
    given = shapes.select(F.expr(str(settings["shape_id"])).cast("long").alias("id"), F.expr(str(settings["shape_layer"])).cast("string").alias("layer"), *box)
    if layers:
        given = given.where(F.col("layer").isin(*layers))
    half = F.expr(str(settings["via_half"])).cast("double")
    at = vias.select(F.expr(str(settings["via_id"])).cast("long").alias("id"), F.expr(str(settings["via_x"])).cast("double").alias("x"), F.expr(str(settings["via_y"])).cast("double").alias("y"), half.alias("h"), F.expr(str(settings["via_ohm"])).cast("double").alias("ohm"))
    at = at.where("id is not null and x is not null and y is not null and h is not null")
    at = at.select("id", "ohm", (F.col("x") - F.col("h")).alias("x0"), (F.col("y") - F.col("h")).alias("y0"), (F.col("x") + F.col("h")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    whole = {"partitionOverwriteMode": "dynamic" if layers else "static"}
    with log.section("layout nets"):
        tested = keep(checked(given), "tested")
        rejected = tested.where("reason is not null").withColumn("why", F.col("reason"))
        rejected.write.mode("overwrite").options(**whole).partitionBy("why").parquet(f"{output}/rejected")
        n, bad = tested.agg(F.count("*"), F.count("reason")).first()
        log.LOG.info("read %d boxes, rejected %d", n, bad)
        vias_kept = keep(at, "vias")
        log.LOG.info("read %d vias with a place", vias_kept.count())
        out = nets(tested.where("reason is null").drop("reason"), vias_kept, cell)
        out = out.withColumn("layer_file", safe_name(F.col("layer")))
        out.hint("rebalance", "layer_file").write.mode("overwrite").options(**whole).partitionBy("layer_file").parquet(f"{output}/nets")
        discard(tested)
        discard(vias_kept)
        log.LOG.info("wrote %d nets to %s/nets", read(spark, output).count(), output)


def read(spark: SparkSession, output: str) -> DataFrame:
    """The nets written."""
    return spark.read.schema(f"{NETS}, layer_file string").parquet(f"{output}/nets").drop("layer_file")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.layout_nets", description="Nets of a layout with their vias.")
    p.add_argument("shapes", help="Parquet table of boxes")
    p.add_argument("vias", help="Parquet table of vias")
    p.add_argument("output", help="folder of the result")
    p.add_argument("--config", help="settings that differ from jobs/layout_nets.yaml")
    p.add_argument("--log", default="info", choices=["off", "error", "warning", "info", "debug"])
    given = p.parse_args(argv)
    log.configure(given.log)
    settings = config(given.config, __file__)
    spark = SparkSession.builder.appName("layout nets").getOrCreate()
    try:
        run(spark, spark.read.parquet(given.shapes), spark.read.parquet(given.vias), given.output, settings)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
