"""Export views of a solved stack: cells as boxes at their layer's height, and a cache of field tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stack_cells(cells: DataFrame, heights: DataFrame) -> DataFrame:
    """Sheet cells (id, physical, x0, y0, x1, y1, ...) as hexahedra between their layer's z0 and z1
    (``heights(physical, z0, z1)``); cells of layers without a height are left out."""
    z = heights.select("physical", "z0", "z1")
    j = cells.join(z, "physical")
    corner = lambda x, y, h: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(h).alias("z"))
    ring = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    return j.withColumn("points", F.array(*[corner(x, y, h) for h in ("z0", "z1") for x, y in ring])).withColumn("kind", F.lit("hexahedron"))


def via_heights(vias: DataFrame, conductors: DataFrame) -> DataFrame:
    """Vias (name, bottom, top) with z0 = top of the lower conductor and z1 = bottom of the upper one."""
    c = conductors.select(F.col("name").alias("_n"), "height", "thickness")
    low = c.select(F.col("_n").alias("bottom"), (F.col("height") + F.col("thickness")).alias("z0"))
    high = c.select(F.col("_n").alias("top"), F.col("height").alias("z1"))
    return vias.join(low, "bottom").join(high, "top")


def channel_cells(channels: DataFrame, nx: Column, ny: Column) -> DataFrame:
    """Channel boxes (id, x0, y0, x1, y1) split into nx by ny parts, one at least each way."""
    one = F.lit(1).cast("long")
    n = channels.withColumns({"nx": F.greatest(nx.cast("long"), one), "ny": F.greatest(ny.cast("long"), one)})
    n = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    at = lambda lo, hi, k, m: F.col(lo) + (F.col(hi) - F.col(lo)) * k / F.col(m)
    return n.select("id", "i", "j", at("x0", "x1", F.col("i"), "nx").alias("x0"), at("y0", "y1", F.col("j"), "ny").alias("y0"), at("x0", "x1", F.col("i") + 1, "nx").alias("x1"), at("y0", "y1", F.col("j") + 1, "ny").alias("y1"))


CACHE_VERSION = 3


def fingerprint(settings: dict, files: list[tuple[str, int, int]]) -> str:
    """Of all settings and the (path, size, modification time) of the inputs."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([CACHE_VERSION, settings, sorted(files)], sort_keys=True, default=str).encode()).hexdigest()[:16]


def save_fields(tables: dict[str, DataFrame], root: str, key: str) -> None:
    """Field tables under a fingerprint's folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{key}/{name}")


def load_fields(spark: SparkSession, root: str, key: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables saved under the fingerprint; None unless all of them are there."""
    from pyspark.errors import AnalysisException

    try:
        return {n: spark.read.parquet(f"{root}/{key}/{n}") for n in names}
    except AnalysisException:
        return None


def stack_messages(conductors: DataFrame) -> DataFrame:
    """(name, message) of conductors that have no height or thickness, or overlap the one below."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col("height").asc_nulls_first(), "ord")  # a technology's conductors: a dozen rows
    c = conductors.withColumns({"_low": F.lag("name").over(w), "_top": F.lag(F.col("height") + F.col("thickness")).over(w)})
    bare = c.where("height is null or thickness is null").select("name", F.lit("conductor has no height or thickness").alias("message"))
    over = c.where("height < _top - 1e-12").select("name", F.concat(F.lit("conductor overlaps "), F.col("_low")).alias("message"))
    return bare.unionByName(over)
