"""Devices: model table lookup, recognition, matching, terminal roles, unit inference, bias loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import channel_axis
from ..functions.physics import r_device, r_on
from ..storage import discard, keep
from .spatial import greedy_match

LEAST_SEED_AREA = 1e-14
#: Fixed names of device kinds in netlists.
KINDS = {"NMOS": "nmos", "PMOS": "pmos", "RES": "resistor", "CAP": "capacitor", "DIODE": "diode", "BJT": "bjt"}


#: Values of an axis up to which they are searched as one array in every task (8 MB); longer axes are joined in order.
AXIS = 1_000_000


def _by_array(points: DataFrame, values: np.ndarray, column: str, eps: float) -> DataFrame:
    """The bracket of each value by halving a sorted array."""

    @F.pandas_udf("struct<lo: double, hi: double>")
    def find(v: pd.Series) -> pd.DataFrame:
        x = v.to_numpy(float)
        i = np.minimum(np.searchsorted(values[1:] + eps, x), len(values) - 2)
        return pd.DataFrame({"lo": values[i], "hi": values[i + 1]})

    return points.withColumn("_b", find(F.col(column)))


def _in_order(points: DataFrame, values: DataFrame, column: str, eps: float) -> DataFrame:
    """The bracket of each value by one order of points and axis: ranges of it are walked by a task each, and where a range
    begins, the last axis value of those before it counts."""
    ends = values.select(F.col(column).alias("_lo"))
    first = ends.agg(F.min("_lo")).first()[0]
    tagged = points.withColumns({"_lo": F.lit(None).cast("double"), "_at": F.col(column)})
    marks = ends.withColumn("_at", F.col("_lo") + eps)
    # a point that is level with an axis value belongs to the bracket below it, so it comes first
    both = keep(tagged.unionByName(marks, allowMissingColumns=True).repartitionByRange("_at", F.col("_lo").isNotNull()).withColumn("_range", F.spark_partition_id()), "axis")
    row = Window.partitionBy("_range").orderBy("_at", F.col("_lo").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = both.groupBy("_range").agg(F.max("_lo").alias("_last")).select("_range", F.max("_last").over(before).alias("_carried"))
    ahead = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    next_ = both.groupBy("_range").agg(F.min("_lo").alias("_first")).select("_range", F.min("_first").over(ahead).alias("_next"))
    after = Window.partitionBy("_range").orderBy("_at", F.col("_lo").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    own = both.withColumns({"_own": F.max("_lo").over(row), "_up": F.min("_lo").over(after)}).where("_lo is null")
    out = own.join(F.broadcast(carried), "_range").join(F.broadcast(next_), "_range")  # as many rows as ranges
    lo = F.coalesce("_own", "_carried")
    hi = F.coalesce("_up", "_next")
    # below the first value the first bracket is meant, beyond the last one none
    second = ends.where(F.col("_lo") > F.lit(first)).agg(F.min("_lo")).first()[0]
    out = out.withColumn("_b", F.struct(F.coalesce(lo, F.lit(first)).alias("lo"), F.when(lo.isNull(), F.lit(second)).otherwise(hi).alias("hi")))
    return out.select(*points.columns, "_b")


def bracketed(points: DataFrame, table: DataFrame, column: str, eps: float = 1e-12, most: int = AXIS) -> DataFrame:
    """Adds lo, hi (``column``_lo, ``column``_hi) and the weight of hi; points out of range go, as do those without a value.
    The first bracket that holds a point to ``eps`` wins; an axis of one value holds what lies within 1e-9 of it. No range
    join: see :func:`_by_array` and, for axes of more than ``most`` values, :func:`_in_order`."""
    v = F.col(column)
    known = points.where(v.isNotNull() & ~F.isnan(v))
    values = table.select(v.cast("double").alias(column)).where(v.isNotNull() & ~F.isnan(column)).distinct()
    some = values.limit(most + 1).toPandas()[column].to_numpy(float)
    names = [F.col(f"`{c}`") for c in points.columns]
    if len(some) < 2:
        one = F.lit(float(some[0])) if len(some) else F.lit(None).cast("double")
        held = known.where(F.abs(v - one) <= 1e-9)
        return held.select(*names, one.alias(f"{column}_lo"), one.alias(f"{column}_hi"), F.lit(0.0).alias(f"{column}_w"))
    found = _by_array(known, np.sort(some), column, eps) if len(some) <= most else _in_order(known, values, column, eps)
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    held = found.where((v >= lo - eps) & (v <= hi + eps))
    return held.select(*names, lo.alias(f"{column}_lo"), hi.alias(f"{column}_hi"), ((v - lo) / (hi - lo)).alias(f"{column}_w"))


AXES = ("t", "vgs", "vds")


def model_lookup(points: DataFrame, table: DataFrame) -> DataFrame:
    """Trilinear current: (id, current) for points (id, t, vgs, vds) in table(t, vgs, vds, id); null outside the table
    or where a corner is missing."""
    b = points
    for c in AXES:
        b = bracketed(b, table, c)
    sides = [F.array(F.struct(F.col(f"{c}_lo").alias("at"), (1 - F.col(f"{c}_w")).alias("w")), F.struct(F.col(f"{c}_hi").alias("at"), F.col(f"{c}_w").alias("w"))) for c in AXES]
    corners = b
    for c, s in zip(AXES, sides):
        corners = corners.withColumn(f"_{c}", F.explode(s))
    corners = corners.select("id", *[F.col(f"_{c}.at").alias(c) for c in AXES], (F.col("_t.w") * F.col("_vgs.w") * F.col("_vds.w")).alias("w"))
    values = table.select(*AXES, F.col("id").alias("current"))
    joined = corners.join(values, list(AXES), "left").groupBy("id").agg(F.sum(F.col("w") * F.col("current")).alias("s"), F.count("current").alias("n"))
    found = joined.select("id", F.when(F.col("n") == 8, F.col("s")).alias("current"))
    return points.select("id").join(found, "id", "left")


def channel_resistance(points: DataFrame, table: DataFrame, w_ref: float, w_eff: Column) -> DataFrame:
    """(id, r): on-resistance at each point scaled to the width."""
    at = points.join(model_lookup(points, table), "id")
    return at.select("id", r_device(r_on(F.col("vds"), F.col("current")), F.lit(w_ref), w_eff).alias("r"))


def physical_layers(shapes: DataFrame, conducting: DataFrame, vias: DataFrame) -> DataFrame:
    """``shapes`` (logical, contact, ..., a contact layer of their own or null) with ``physical``, the conducting layer of
    their logical one (logical, physical), else its via layer, and ``contact``, their own one, else that, else the logical
    name itself. Maps have a row for each logical layer."""
    m = conducting.select("logical", F.col("physical").alias("_conducting"))
    v = vias.select("logical", F.col("physical").alias("_via"))
    j = shapes.join(m, "logical", "left").join(v, "logical", "left")
    physical = F.coalesce("_conducting", "_via")
    return j.withColumns({"physical": physical, "contact": F.coalesce("contact", physical, "logical")}).drop("_conducting", "_via")


def recognise(polygons: DataFrame, layers: DataFrame, templates: DataFrame) -> DataFrame:
    """Seed polygons become devices: polygons(id, layer, x0, y0, x1, y1, name) on the seed layer of a template
    (template, kind, seed), by layer name. Seeds under 1e-14 square metres go; a device without an axis has half the
    confidence."""
    first = layers.groupBy("logical").agg(F.min("layer").alias("layer"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    named = templates.join(first, templates.seed == first.logical).drop("logical")
    out = polygons.join(named, "layer").where(w * h >= LEAST_SEED_AREA).withColumn("axis", channel_axis(w, h))
    turn = Window.partitionBy("template").orderBy("id")
    name = F.coalesce("name", F.concat("template", F.lit("_"), (F.row_number().over(turn) - 1).cast("string")))
    return out.select("id", "template", "kind", name.alias("name"), "x0", "y0", w.alias("w"), h.alias("h"), "axis", F.when(F.col("axis").isNull(), 0.5).otherwise(1.0).alias("confidence"))


def verify(golden: DataFrame, found: DataFrame, by: tuple[str, ...] = (), max_distance: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, golden rows that are missing, found rows that are extra."""
    m = greedy_match(golden, found, by, max_distance)
    missing = golden.join(m.select(F.col("golden").alias("id")), "id", "left_anti")
    extra = found.join(m.select(F.col("found").alias("id")), "id", "left_anti")
    return m, missing, extra


#: Rows up to which a rank is taken from a sorted prefix.
PREFIX = 10_000


def of_rank(values: DataFrame, rank: int) -> float:
    """The value of place ``rank`` (from 0) in the order of ``values(v)``, which has no nulls and more rows than that. A
    sketch of the values names two of them that enclose the rank closely; their exact counts narrow the range, and it is
    sketched again until a short prefix of it holds the rank. Two rounds do for billions of rows, whatever their spread;
    each leaves out at least one value, so ties end it too."""
    left, n = values, None
    while True:
        n = left.count() if n is None else n
        if n <= PREFIX:
            return left.orderBy("v").offset(rank).limit(1).first()["v"]
        at, width = (rank + 0.5) / n, 2e-4
        low, high = left.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, at - width)), F.lit(min(1.0, at + width))), F.lit(20_000))).first()[0]
        v = F.col("v")
        less, same, within, top = left.agg(*[F.count_if(c) for c in (v < low, v == low, (v > low) & (v < high), v == high)]).first()
        if low == high:
            within = top = 0
        if less <= rank < less + same:
            return low
        if less + same + within <= rank < less + same + within + top:
            return high
        if rank < less:
            left, n = left.where(v < low), less
        elif rank < less + same + within:
            left, rank, n = left.where((v > low) & (v < high)), rank - less - same, within
        else:
            left, rank, n = left.where(v > high), rank - less - same - within - top, n - less - same - within - top


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The element at half the count of the sorted finite values: one row (n, median); no task sees all values."""
    good = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf"))).select(F.col(column).cast("double").alias("v"))
    good = keep(good, "values")
    n = good.count()
    median = of_rank(good, n // 2) if n else None
    discard(good)
    return df.sparkSession.createDataFrame([(n, median)], "n long, median double")


def infer_db_unit(matches: DataFrame, dbu: float) -> DataFrame:
    """The database unit that makes drawn widths agree with the netlist: upper median of w dbu / extent."""
    ratio = matches.where("extent > 0 and w > 0").select((F.col("w") * F.lit(dbu) / F.col("extent")).alias("v"))
    return upper_median(ratio, "v").select(F.col("median").alias("unit"), "n")


def device_kind(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.upper(F.trim(name)))


def terminal_roles(devices: DataFrame, pins: DataFrame, by_position: bool = True) -> DataFrame:
    """(device, role, net): by a pin's name in the template (d, g, s in either case), else its position 0, 1, 2."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i).alias("at")) for i, r in enumerate("dgs")])
    wanted = devices.select("device").withColumn("w", F.explode(roles)).select("device", "w.role", "w.at")
    named = pins.groupBy("device", F.lower("pin").alias("role")).agg(F.min_by("net", "pos").alias("named"))
    placed = pins.groupBy("device", F.col("pos").alias("at")).agg(F.first("net").alias("placed"))
    out = wanted.join(named.hint("merge"), ["device", "role"], "left").join(placed.hint("merge"), ["device", "at"], "left")
    return out.select("device", "role", F.coalesce("named", *(["placed"] if by_position else [])).alias("net"))


def unserved_ports(ports: DataFrame, terminals: DataFrame) -> DataFrame:
    """Ports without a terminal of the same name (case matters); a run with any of them is refused."""
    return ports.join(terminals.select("name").distinct(), "name", "left_anti")


def model_summary(instances: DataFrame) -> DataFrame:
    """(model, n, total_w): instances and summed widths of each model; a missing width counts as 0."""
    return instances.groupBy("model").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("params")["w"], F.lit(0.0))).alias("total_w"))


def conductors_by_height(conductors: DataFrame) -> DataFrame:
    """From the bottom up, those without a height first, else in file order."""
    return conductors.orderBy(F.col("height").asc_nulls_first(), "ord")


#: Fixed beginnings and parts of the names of layers that mark something and are no conductors.
MARKER_STARTS, MARKER_PARTS = ("seed_", "BLOCK_"), ("_prop", "marker", "drawing")


def is_marker(logical: Column, starts: tuple[str, ...] = MARKER_STARTS, parts: tuple[str, ...] = MARKER_PARTS) -> Column:
    """Whether a logical layer is a marker."""
    out = F.lit(False)
    for s in starts:
        out = out | logical.startswith(s)
    for s in parts:
        out = out | logical.contains(s)
    return out


def assembly_report(shapes: DataFrame) -> DataFrame:
    """(reason, layer, n) of shapes that do not become solids: marker layers, layers without technology or height."""
    reason = F.when(F.col("logical").isNull(), "unnamed").when(is_marker(F.col("logical")), "marker").when(F.col("physical").isNull(), "unmatched").when(F.col("z0").isNull(), "no height")
    return shapes.withColumn("reason", reason).where("reason is not null").groupBy("reason", "layer").agg(F.count("*").alias("n"))
