"""Lanes of a device: which one a point is in, and steps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinematics import by_track

#: (index, x of origin, y of origin, unit direction x, unit direction y, half width in px)
Lane = tuple[int, float, float, float, float, float]


def _offset(lane: Lane, x: Column, y: Column) -> Column:
    """Signed distance from the lane's centre line."""
    _, x0, y0, dx, dy, _ = lane
    return (x - x0) * F.lit(-dy) + (y - y0) * F.lit(dx)


def lane_of(lanes: Sequence[Lane], x: Column, y: Column) -> Column:
    """The nearest lane's index; beyond the outermost lane on a side only within its half width; else -1.

    Lanes are few settings, so the choice is one expression: no join, no shuffle.
    """
    if not lanes:
        return F.lit(-1)
    near = F.least(*[F.abs(_offset(v, x, y)) for v in lanes]) if len(lanes) > 1 else F.abs(_offset(lanes[0], x, y))
    choice = F.lit(-1)
    for lane in reversed(lanes):
        side = _offset(lane, x, y)
        inside = F.abs(side) <= lane[5]
        for other in lanes:
            if other is not lane:
                # another lane on the point's side makes this a point between two lanes
                far = _offset(other, x, y)
                foot = _offset(lane, x - far * F.lit(-other[4]), y - far * F.lit(other[3]))
                inside = inside | (foot * side > 0)
        choice = F.when((F.abs(side) == near) & (inside | (side == 0)), lane[0]).when(F.abs(side) == near, -1).otherwise(choice)
    return choice


def with_lane(obs: DataFrame, lanes: Sequence[Lane]) -> DataFrame:
    return obs.withColumn("channel", lane_of(lanes, F.col("x_px"), F.col("y_px")))


def cross_lane_steps(obs: DataFrame) -> DataFrame:
    """Steps of a track (with channel) between two different lanes; -1 is no lane and never counts."""
    before = F.lag("channel").over(by_track())
    return obs.withColumn("from_channel", before).where("from_channel is not null and from_channel >= 0 and channel >= 0 and from_channel <> channel")
