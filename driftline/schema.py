"""Calibration, flags and fixed settings shared by all operators."""

from __future__ import annotations

import math
from dataclasses import dataclass


def positive(value: float | None) -> bool:
    """Whether a number is there, finite and above zero."""
    return value is not None and math.isfinite(value) and value > 0


@dataclass(frozen=True)
class Scale:
    """Pixel size and frame interval; a value that is missing or not positive counts as 1 and not calibrated."""

    pixel_um: float = 1.0
    interval_min: float = 1.0
    z_um: float | None = None
    pixel_calibrated: bool = False
    interval_calibrated: bool = False

    @classmethod
    def of(cls, pixel_um: float | None = None, interval_min: float | None = None, z_um: float | None = None) -> Scale:
        p, t = positive(pixel_um), positive(interval_min)
        return cls(float(pixel_um) if p else 1.0, float(interval_min) if t else 1.0, float(z_um) if positive(z_um) else None, p, t)

    @property
    def anisotropy(self) -> float | None:
        """z step over pixel size, if both are calibrated."""
        return self.z_um / self.pixel_um if self.z_um is not None and self.pixel_calibrated else None


@dataclass(frozen=True)
class TrackingSettings:
    """Gates and costs of linking. The defaults are part of the results."""

    max_gap: int = 3
    max_speed_um_per_min: float = 5.0
    min_observations: int = 2
    unmatched_cost: float = 15.0
    sigma_ln_area: float = 0.30
    sigma_ln_aspect: float = 0.35
    sigma_solidity: float = 0.10
    least_size_ratio: float = 0.3
    most_size_ratio: float = 3.0

    @property
    def max_delta_frames(self) -> int:
        return self.max_gap + 1

    @property
    def gate(self) -> float:
        return 2 * self.unmatched_cost


#: The calibration that the event adapter's rows are read with.
EVENT_SCALE = Scale.of(pixel_um=0.5, interval_min=60.0)
#: Severities in their order.
SEVERITIES = ("critical", "warning", "info")
#: Quantiles of chi-square at 0.999 for 2 to 6 degrees of freedom that gate a move.
MOTION_GATES = {2: 13.816, 3: 16.266, 4: 18.467, 6: 22.458}


def tolerant(kind: type, values: dict):
    """Settings of a dataclass from a stored document: unknown names are passed over, missing ones take their default, lists become tuples."""
    from dataclasses import fields

    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})
