"""Sheet, via and channel formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE_C = 25.0


def temp_factor(tc1: Column, tc2: Column, temperature: Column, reference: float = REFERENCE_C) -> Column:
    d = temperature - reference
    return 1 + tc1 * d + tc2 * d * d


def via_resistance(r_ref: Column, a_ref: Column, a_actual: Column) -> Column:
    """Scaled by area; the reference value where an area is missing or not positive, 1 ohm without a table."""
    return F.when(r_ref.isNull(), 1.0).when((a_ref > 0) & (a_actual > 0), r_ref * a_ref / a_actual).otherwise(r_ref)


def r_on(vds: Column, current: Column) -> Column:
    """|Vds / Id|; infinite for currents under 1e-15."""
    return F.when(current.isNull(), None).when(F.abs(current) < 1e-15, float("inf")).otherwise(F.abs(vds / current))


def r_device(r: Column, w_ref: Column, w_eff: Column) -> Column:
    return F.when(w_eff > 0, r * w_ref / w_eff)


def jet(t: Column) -> Column:
    """Colour ramp from blue over green to red for t in 0..1, as a struct of three bytes."""
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ramp = lambda mid: F.round(255 * F.least(F.greatest(1.5 - F.abs(4 * t - mid), F.lit(0.0)), F.lit(1.0))).cast("int")
    return F.struct(ramp(3).alias("r"), ramp(2).alias("g"), ramp(1).alias("b"))


def colour_bin(value: Column, low: Column, high: Column, n: int) -> Column:
    """round(t (n - 1)) with t the clamped place between low and high; null for what is not finite."""
    span = F.greatest(high - low, F.lit(1e-300))
    t = F.least(F.greatest((value - low) / span, F.lit(0.0)), F.lit(1.0))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.least(F.round(t * (n - 1)), F.lit(n - 1)).cast("int"))
