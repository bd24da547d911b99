"""Near ones are found without making all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.nearest import nearest
from driftline.operators import gaps
from driftline.plans.catalog import SCALE, SETTINGS


@pytest.mark.parametrize("kind", ["even", "steps", "line", "crowd", "one"])
@pytest.mark.parametrize("reached", [False, True])
@pytest.mark.parametrize("picky", [False, True])
def test_as_all_pairs(kind, reached, picky):
    rng = np.random.default_rng(3)
    points = {"even": rng.random((90, 2)) * [560, 100], "steps": rng.integers(0, 9, (200, 2)).astype(float), "line": np.c_[rng.random(80), np.full(80, 3.0)], "crowd": np.c_[rng.exponential(20, 500), rng.integers(0, 3, 500)], "one": np.array([[4.0, 5.0]])}[kind]
    asked = np.r_[points[rng.integers(0, len(points), 60)], rng.normal(0, 900, (60, 2)).round(), rng.random((60, 2)) * 9]
    reach = rng.random(len(asked)) * 40 if reached else None
    place, far = nearest(points, asked, reach, (lambda i, j: (i + j) % 3 > 0) if picky else None)
    dx, dy = points[None, :, 0] - asked[:, None, 0], points[None, :, 1] - asked[:, None, 1]
    d = np.sqrt(dx * dx + dy * dy)
    if reached:
        d[d > reach[:, None]] = np.inf
    if picky:
        d[np.add.outer(np.arange(len(asked)), np.arange(len(points))) % 3 == 0] = np.inf
    assert (far == d.min(axis=1)).all()
    assert (place == np.where(np.isfinite(far), d.argmin(axis=1), -1)).all()


def plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scene(spark):
    rows = [(1, 0, 0.0, 0.0), (2, 0, 3.0, 4.0), (3, 0, 0.0, 0.0), (4, 2, 0.0, 0.0), (5, 2, 3.0, 4.0), (6, 2, None, 1.0), (7, 2, float("nan"), 1.0), (8, 3, 3.0, 4.0), (9, 2, 1e200, 0.0)]
    return spark.createDataFrame(rows, "track_id bigint, frame int, x_px double, y_px double")


def test_starts_take_the_nearest_end(spark):
    got = {r.track_id: (r.candidate_track_id, r.candidate_last_frame, None if r.distance_px is None else str(r.distance_px)) for r in gaps.unlinked_starts(scene(spark), SETTINGS, SCALE).collect()}
    assert got == {4: (1, 0, "0.0"), 5: (2, 0, "0.0"), 6: (1, 0, None), 7: (1, 0, "nan"), 8: (5, 2, "0.0"), 9: (1, 0, "inf")}


def test_a_start_before_all_ends_has_none(spark):
    rows = spark.createDataFrame([(1, 5, 0.0, 0.0), (2, 6, 0.0, 0.0), (2, 7, 0.0, 0.0)], "track_id bigint, frame int, x_px double, y_px double")
    got = {r.track_id: (r.candidate_track_id, r.candidate_last_frame, r.distance_px, r.refused_because) for r in gaps.unlinked_starts(rows, SETTINGS, SCALE).collect()}
    assert got == {1: (None, None, None, None), 2: (1, 5, 0.0, None)}


def test_starts_and_ends_make_no_pairs(spark):
    """Every start of a frame with every end of another was sorted by distance: rows grew with the square of a frame's."""
    n = 3000
    rows = spark.range(2 * n).select(F.col("id").alias("track_id"), (F.col("id") >= n).cast("int").alias("frame"), (F.col("id") % n).cast("double").alias("x_px"), F.lit(0.0).alias("y_px"))
    found = gaps.unlinked_starts(rows, SETTINGS, SCALE)
    assert "Window [row_number()" not in plans(found)
    assert found.where(F.col("candidate_track_id") == F.col("track_id") - n).count() == n


def lost(spark):
    obs = [(1, 0, 0.0, 0.0, 10.0), (1, 4, 8.0, 0.0, 10.0), (2, 0, 1.0, 0.0, 10.0), (2, 4, 9.0, 0.0, 10.0), (3, 0, float("nan"), 0.0, 10.0), (3, 2, 0.0, 0.0, 10.0), (4, 0, None, 0.0, 10.0), (4, 2, 0.0, 0.0, 10.0), (5, 6, 0.0, 0.0, 10.0), (5, 20, 0.0, 0.0, 10.0)]
    others = [(1, 7, 2.0, 0.0, 10.0, "permissive"), (1, 8, 3.0, 0.0, 10.0, "window"), (1, 9, 3.0, 0.0, 100.0, "window"), (2, 3, 4.0, 44.0, 10.0, "window"), (2, 4, 4.0, 44.0, 10.0, "window"), (3, 1, 7.0, 46.0, 10.0, "window"), (10, 1, None, 0.0, 10.0, "window"), (10, 2, float("nan"), 0.0, float("nan"), "window"), (17, 1, 0.0, 45.0, 40.0, "window")]
    return spark.createDataFrame(obs, "track_id bigint, frame int, x_px double, y_px double, area_px double"), spark.createDataFrame(others, "frame int, label int, x_px double, y_px double, area_px double, source string")


def test_attempts_by_tier_and_claim(spark):
    from driftline.operators import gates

    rows = gates.recovery_attempts(*lost(spark)).collect()
    got = {(r.track_id, r.frame): (r.label, r.found_by, r.offset_px) for r in rows if r.recovered}
    assert got == {(2, 1): (8, "window", 0.0), (1, 2): (3, "window", 44.0), (5, 17): (1, "window", 45.0)}
    assert {(r.track_id, r.frame) for r in rows if r.detail == "taken by another track"} == {(1, 1), (2, 2)}
    assert len(rows) == 3 + 3 + 1 + 1 + 13


def test_candidates_at_the_edge_of_reach(spark):
    from driftline.operators import gates

    got = {(r.track_id, r.frame): (r.label, r.offset_px) for r in gates.recovery_candidates(*lost(spark)).collect()}
    assert got == {(1, 1): (7, 0.0), (2, 1): (8, 0.0), (1, 2): (3, 44.0), (2, 2): (3, (1.0 + 44.0**2) ** 0.5), (5, 17): (1, 45.0)}


def test_gaps_and_candidates_make_no_pairs(spark):
    """Every gap frame met every candidate of its cells, and all these pairs were sorted."""
    from driftline.operators import gates

    for df in (gates.recovery_attempts(*lost(spark)), gates.recovery_candidates(*lost(spark))):
        assert "Join" not in plans(df)


def test_neighbours_in_time_make_no_pairs(spark):
    """Every observation met every object of four frames, and all these pairs were sorted."""
    from driftline.operators import audit

    rows = [(1, 7, 0.0, 0.0, 1), (2, 7, 5.0, 0.0, 2), (3, 8, 2.5, 0.0, 1), (4, 9, 0.0, 1.0, 2), (5, 9, 0.0, 1.0, 1), (6, 9, None, 0.0, 0), (7, 20, 0.0, 0.0, 1)]
    found = audit.temporal_candidates(spark.createDataFrame(rows, "track_id bigint, frame int, x_px double, y_px double, det_label int"))
    assert "Join" not in plans(found)
    got = {(r.track_id, r.offset): (r.label, r.distance_px) for r in found.collect()}
    far = (2.5**2 + 1) ** 0.5
    assert got == {(1, 1): (1, 2.5), (1, 2): (1, 1.0), (2, 1): (1, 2.5), (2, 2): (1, 26**0.5), (3, -1): (1, 2.5), (3, 1): (1, far), (4, -1): (1, far), (4, -2): (1, 1.0), (5, -1): (1, far), (5, -2): (1, 1.0), (6, -1): (1, None), (6, -2): (1, None)}
