"""Smallest movement that a measurement can show, and unit conversion."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the micro sign, the micrometres in units of length and the minutes in units of time, small ones first.
MICRO_SIGNS = ("\u00b5", "\u03bc", r"\u00b5", r"\u03bc")
UM_PER_UNIT = {
    "nm": 1e-3, "nanometer": 1e-3, "nanometers": 1e-3, "nanometre": 1e-3, "nanometres": 1e-3,
    "um": 1.0, "umeter": 1.0, "umeters": 1.0, "umetre": 1.0, "umetres": 1.0, "micron": 1.0, "microns": 1.0, "micrometer": 1.0, "micrometers": 1.0, "micrometre": 1.0, "micrometres": 1.0,
    "mm": 1e3, "millimeter": 1e3, "millimeters": 1e3, "millimetre": 1e3, "millimetres": 1e3,
    "cm": 1e4, "centimeter": 1e4, "centimetre": 1e4,
    "m": 1e6, "meter": 1e6, "metre": 1e6,
}
MIN_PER_UNIT = {
    "us": 1 / 60e6, "usec": 1 / 60e6,
    "ms": 1 / 60e3, "msec": 1 / 60e3, "millisecond": 1 / 60e3, "milliseconds": 1 / 60e3,
    "s": 1 / 60, "sec": 1 / 60, "secs": 1 / 60, "second": 1 / 60, "seconds": 1 / 60,
    "min": 1.0, "mins": 1.0, "minute": 1.0, "minutes": 1.0,
    "h": 60.0, "hr": 60.0, "hrs": 60.0, "hour": 60.0, "hours": 60.0,
}


def _in_table(unit: Column, table: dict[str, float]) -> Column:
    """The unit's factor: blanks, case and the spelling of a leading micro sign do not count."""
    name = F.lower(F.trim(unit))
    signs = "|".join(re.escape(x) for x in MICRO_SIGNS)
    name = F.regexp_replace(name, f"^(?:{signs})", "u")
    return F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))), name)


def um_per_unit(unit: Column) -> Column:
    """Micrometres in one unit of length; null for any other text."""
    return _in_table(unit, UM_PER_UNIT)


def min_per_unit(unit: Column) -> Column:
    """Minutes in one unit of time; null for any other text."""
    return _in_table(unit, MIN_PER_UNIT)


def displacement_floor(area_px: Column, boundary_sigma: float = 0.5, noise_to_signal: float = 0.0, registration_sigma: float = 0.0) -> Column:
    """The displacement that boundary jitter and registration alone may show: sqrt(2) times a position's sigma; infinite without area."""
    edge = boundary_sigma * (1 + noise_to_signal)
    centre = F.lit(edge) / F.sqrt(area_px)
    floor = math.sqrt(2) * F.sqrt(centre * centre + registration_sigma**2)
    return F.when(area_px <= 0, float("inf")).otherwise(floor)


def below_floor(magnitude_px: Column, floor_px: Column, k: float = 3.0) -> Column:
    """Whether a displacement is under ``k`` floors."""
    return F.when(floor_px > 0, magnitude_px / floor_px < k).otherwise(False)


def volume_rate_floor(surface_px: Column, dt_frames: Column, boundary_sigma: float = 0.5, noise_to_signal: float = 0.0) -> Column:
    """The volume rate, in voxels a frame, that boundary jitter over the surface may show."""
    return math.sqrt(2) * boundary_sigma * (1 + noise_to_signal) * surface_px / F.greatest(dt_frames, F.lit(1.0))


def f1_ceiling(precision: Column) -> Column:
    """The best F1 at a given precision."""
    return 2 * precision / (precision + 1)
