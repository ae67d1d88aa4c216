"""Column functions of series and fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seconds(text: Column) -> Column:
    """A time with a unit (``2 days``, ``1.5d``, ``90 s``, ``90sec``) in seconds; null if it is none."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(days?|d|sec|s)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(days?|d|sec|s)\s*$", 2)
    return number * F.when(unit.startswith("d"), 86400.0).otherwise(1.0)


def model_step(sec: Column, dt: float) -> dict[str, Column]:
    """The model step at a time, and whether the time is off the steps."""
    return {"step": sec / dt, "off": F.abs(F.pmod(sec, F.lit(dt))) > 1e-6}


def from_si(value: Column, unit: Column) -> Column:
    """Metres and m3/s to ft and cfs; other units pass."""
    return F.when(unit == "m", value / 0.3048).when(unit == "cms", value / 0.028316846592).otherwise(value)


def flag_mask(value: Column, flag: Column) -> Column:
    """Null where the user's flag is 1."""
    return F.when(~F.coalesce(flag == 1, F.lit(False)), value)


def near_surface_temperature(value: Column, z: Column, wet: Column) -> Column:
    """Wet temperatures above -10 are lowered by 1; none is below 0."""
    return F.greatest(F.when(wet & (z > -10), value - 1).otherwise(value), F.lit(0.0))


def reference_surface(x: Column, y: Column, x0: float, slope_x: float, east: float, y0: float, slope_y: float) -> Column:
    """A ramp in x from ``x0`` on, and one in y from ``y0`` on east of a line, not below 0."""
    return F.greatest((x - x0) * slope_x + F.when(x > east, (y - y0) * slope_y).otherwise(0.0), F.lit(0.0))
