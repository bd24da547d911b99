"""Axis layouts of image files: what is refused, and how the rest becomes time, z, y, x."""

from __future__ import annotations

import numpy as np

ORDER = "TZYX"


def canonical(data: np.ndarray, axes: str, channel: int = 0) -> np.ndarray:
    """``data`` with axes T[Z]YX as float32: one channel picked, single axes dropped, a still given a time axis.

    Raises ValueError for axes that do not fit, repeat, are unknown, or lack Y or X.
    """
    axes = axes.upper()
    if len(axes) != data.ndim:
        raise ValueError(f"{len(axes)} axes {axes} for {data.ndim} dimensions")
    if len(set(axes)) != len(axes):
        raise ValueError(f"an axis is there twice in {axes}")
    if unknown := set(axes) - set("TZCYX"):
        raise ValueError(f"axes {''.join(sorted(unknown))} have no meaning here: say which are T, Z, C, Y and X")
    if not {"Y", "X"} <= set(axes):
        raise ValueError(f"{axes} has no Y and X")
    if "C" in axes:
        at = axes.index("C")
        if not 0 <= channel < data.shape[at]:
            raise ValueError(f"channel {channel} of {data.shape[at]}")
        data, axes = np.take(data, channel, axis=at), axes.replace("C", "")
    for a in "TZ":
        if a in axes and data.shape[axes.index(a)] == 1:
            data, axes = np.squeeze(data, axes.index(a)), axes.replace(a, "")
    data = np.transpose(data, [axes.index(a) for a in ORDER if a in axes])
    if "T" not in axes:
        data = data[None]
    return np.ascontiguousarray(data, dtype=np.float32)


def labels(data: np.ndarray) -> np.ndarray:
    """A label image as int32; refused unless its values are whole and not negative."""
    if not np.isfinite(data).all() or (data < 0).any() or (data != np.rint(data)).any():
        raise ValueError("labels must be whole numbers from 0 on")
    return data.astype(np.int32)
