"""Shapes, crops, merged passes, distinct fields, folders and bundles against plain versions."""

import itertools
import json
import random

import numpy as np
import pytest

from driftline.operators import fields, labels, morphology
from driftline.schema import Scale
from driftline.sinks import bundles, tables
from driftline.sources import folders, results


def plain_hull(points):
    """Area of the smallest convex polygon: its edges have all points on one side or between their ends."""
    points = sorted(set(points))

    def held(a, b, c):
        side = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return side > 0 or side == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    edges = [(a, b) for a, b in itertools.permutations(points, 2) if all(held(a, b, c) for c in points)]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in edges)) / 2


@pytest.mark.parametrize("seed", range(6))
def test_hull(seed):
    rng = random.Random(seed)
    points = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.choice([1, 2, 5, 25]))]
    assert morphology.hull_area(np.array(points)) == pytest.approx(plain_hull(points))


def blob(rng, turn=0):
    """A lopsided object, turned by quarter turns."""
    y, x = np.nonzero(np.add.outer((np.arange(40) - 15) ** 2 / 150, (np.arange(30) - 12) ** 2 / 60) + np.add.outer(np.arange(40) / 90, np.arange(30) / 70) < 1)
    for _ in range(turn):
        y, x = x, -y
    return y - y.min() + rng.randrange(50), x - x.min() + rng.randrange(50)


def rows_of(y, x, frame):
    return [(frame, 1, int(a), int(b), float(a * 3 + b)) for a, b in zip(y, x, strict=True)]


def test_invariants_and_crops_do_not_turn(spark):
    rng = random.Random(1)
    shapes = [blob(rng, k) for k in range(4)]
    pixels = spark.createDataFrame([r for k, s in enumerate(shapes) for r in rows_of(*s, k)], "frame int, label int, y int, x int, value double")
    hu = np.array([list(r)[2:] for r in sorted(morphology.hu_invariants(pixels).collect())])
    assert np.ptp(hu[:, :4], axis=0).max() < 1e-6
    # moments against numpy
    y, x = (v - v.mean() for v in shapes[0])
    n = len(x)
    got = morphology.moments(pixels).where("frame = 0").first()
    for p, q in ((2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)):
        assert got[f"n{p}{q}"] == pytest.approx((x**p * y**q).sum() / n ** (1 + (p + q) / 2), abs=1e-9)
    crops = [np.unpackbits(np.frombuffer(r.crop, np.uint8)) for r in sorted(morphology.crops(pixels).collect())]
    assert all(np.mean(c != crops[0]) < 0.01 for c in crops)
    assert crops[0].sum() > 500
    solid = [r.solidity for r in morphology.hulls(pixels).collect()]
    assert all(0.9 < s <= 1 for s in solid) and max(solid) - min(solid) < 1e-9


def test_outline_and_texture_of_a_checkerboard(spark):
    rows = [(0, 1, y, x, float((y + x) % 2)) for y in range(6) for x in range(6)]
    pixels = spark.createDataFrame(rows, "frame int, label int, y int, x int, value double")
    r = morphology.outline(pixels).first()
    assert (r.sides, r.edge_pixels) == (24, 20)
    t = morphology.texture(pixels, 2).first()
    # straight neighbours differ, slanting ones are equal
    assert (t.glcm_contrast, t.glcm_homogeneity, t.glcm_correlation) == (0.5, 0.75, pytest.approx(0.0, abs=0.05))


def test_merged_passes(spark):
    def box(number, label, y0, y1, x0, x1):
        return [(0, number, label, y, x) for y in range(y0, y1) for x in range(x0, x1)]

    rows = box(0, 1, 0, 10, 0, 10) + box(1, 1, 0, 10, 2, 12) + box(1, 2, 8, 30, 0, 5) + box(1, 3, 20, 24, 3, 30) + box(2, 1, 40, 44, 0, 4)
    got = labels.merge_passes(spark.createDataFrame(rows, "frame int, pass_no int, label int, y int, x int")).collect()
    size = {}
    for r in got:
        size[r.label, r.pass_no] = size.get((r.label, r.pass_no), 0) + 1
    # the second is the first again; the third is clipped; of the fourth the larger piece stays; the last is apart
    assert size == {(1, 0): 100, (2, 1): 100, (3, 1): 4 * 25, (4, 2): 16}
    assert len({(r.y, r.x) for r in got}) == len(got)


def test_split_piece_keeps_its_largest_part(spark):
    rows = [(0, 0, 1, y, x) for y in range(30) for x in range(10, 13)] + [(0, 1, 1, 15, x) for x in range(40)] + [(0, 1, 1, 16, x) for x in range(40)]
    got = labels.merge_passes(spark.createDataFrame(rows, "frame int, pass_no int, label int, y int, x int")).where("pass_no = 1").collect()
    assert {r.x for r in got} == set(range(13, 40))


def test_distinct_fields_and_units(spark):
    sizes = {"a": 5, "b": 9, "c": 7, "d": 1}
    verdicts = {("a", "b"): "different regions", ("b", "c"): "same pixels", ("c", "a"): "different regions", ("b", "d"): "different acquisitions", ("a", "d"): "different regions"}
    assert fields.distinct_fields(sizes, verdicts) == ["b", "a", "d"]
    unit = lambda *ids: fields.outer_unit(spark.createDataFrame([(i,) for i in ids], "acquisition string"))[0]
    assert (unit("x", "y"), unit("x", "x"), unit("x", "unknown:m"), unit("x", None)) == ("acquisition", "field", "field", "field")


def test_radius_partners_against_all_pairs(spark):
    rng = random.Random(3)
    side = lambda: [(f, k, rng.uniform(0, 40), rng.uniform(0, 40)) for f in range(4) for k in range(12)]
    a, b = side(), side()
    near = [(p, q) for p in a for q in b if p[0] == q[0] and np.hypot(p[2] - q[2], p[3] - q[3]) <= 6]
    want = {(p[0], p[1], q[1]) for p, q in near if sum(x[0] is p for x in near) == 1 and sum(x[1] is q for x in near) == 1}
    frame = lambda rows: spark.createDataFrame(rows, "f int, key int, x double, y double")
    assert {(r.f, r.a, r.b) for r in fields.radius_partners(frame(a), frame(b), "f", 6.0).collect()} == want and want


def test_folders_and_bundles(spark, tmp_path):
    tracks = spark.createDataFrame([(1, 0, 1, 1.0, 2.0), (1, 1, 1, 2.0, 2.0), (1, 3, 2, 4.0, 2.0)], "track_id int, frame int, det_label int, x_px double, y_px double")
    for name, manifest in (("m1", {"experiment": "e1", "acquisition": "q1", "condition": "c0", "calibration": {"pixel_size_um": 0.5, "frame_interval_min": 10, "temporally_calibrated": False}}), ("m2", {"experiment": "e1"})):
        tables.save_run(spark, str(tmp_path / name), {"tracks": tracks if name == "m1" else tracks.drop("y_px")}, manifest)
    one = folders.resolve(spark, str(tmp_path / "m1"), {"q1": "named", "e1": "other"})
    assert (one.movie, one.experiment, one.acquisition, one.condition, one.pixel_um, one.interval_min) == ("m1", "e1", "q1", "named", 0.5, None)
    two = folders.resolve(spark, str(tmp_path / "m2"))
    assert (two.acquisition, two.condition) == ("unknown:m2", None)
    every = folders.read_folders(spark, [str(tmp_path / "m1"), str(tmp_path / "m2")], {"e1": "x"})
    assert every.count() == 6 and every.where("movie = 'm2' AND y_px IS NULL AND condition = 'x'").count() == 3
    run = results.load_run(spark, str(tmp_path / "m1"))
    written = bundles.export_bundle(run, str(tmp_path / "out"), Scale.of(0.5, 10))
    assert written == ["tracks.csv", "track_msd.csv", "run.json"]
    assert json.loads((tmp_path / "out/run.json").read_text())["experiment"] == "e1"
    msd = results.read_table(spark, str(tmp_path / "out/track_msd.csv"))
    assert tuple(msd.columns) == bundles.MSD_COLUMNS and {(r.lag_frames, r.msd_px2) for r in msd.collect()} == {(1, 1.0), (2, 4.0), (3, 9.0)}
    bundles.export_table(run, "tracks", str(tmp_path / "t.csv"))
    assert results.read_table(spark, str(tmp_path / "t.csv")).count() == 3
    verdicts = spark.createDataFrame([(1, 0, ["a", "b"], "CONFIRMED", 0.5)], "object_id int, t int, reasons array<string>, state string, wall double")
    bundles.export_verdicts(verdicts, str(tmp_path / "v.csv"))
    assert [c for c in results.read_table(spark, str(tmp_path / "v.csv")).columns if not c.endswith("_text")] == ["object_id", "t", "z", "state", "reasons", "wall"]


def test_displacements_of_a_run_saved_without_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, f, 3.0 * f, 0.0) for f in (0, 1, 2, 4)], "track_id int, frame int, x_px double, y_px double")
    tables.save_run(spark, str(tmp_path / "r"), {"tracks": rows}, {"calibration": {"pixel_size_um": 0.5, "frame_interval_min": 10}})
    got = results.load_run(spark, str(tmp_path / "r")).msd(1).collect()
    assert {(r.lag_frames, r.n_pairs, r.msd_um2) for r in got} == {(1, 2, 2.25), (2, 2, 9.0), (3, 1, 20.25), (4, 1, 36.0)}


def test_bracket_reasons_in_their_order(spark):
    from pyspark.sql import functions as F

    from driftline.operators.brackets import brackets

    rows = [("a", t, t in (1, 3, 9), True, t != 2) for t in range(1, 10)] + [("b", 2, False, None, True)]
    got = brackets(spark.createDataFrame(rows, "s string, t int, l boolean, o boolean, e boolean"), "s", "t", F.col("l"), 4, F.col("o"), F.col("e"))
    why = {(r.s, r.t): r.why for r in got.collect()}
    assert why["b", 2] == "no true time order" and why["a", 1] == "first labelled time" and why["a", 9] == "last labelled time"
    assert why["a", 2] == "nothing to test" and why["a", 5] == "bracket too long" and why["a", 3] == "bracket too long"


def test_resolved_scale():
    from driftline.functions.calibration import resolved

    scale, origin = resolved({"pixel_um": -1.0, "interval_min": 5.0}, {"pixel_um": 0.5, "interval_min": 10.0, "z_um": float("nan")})
    assert (scale.pixel_um, scale.interval_min, scale.z_um) == (0.5, 5.0, None)
    assert origin == {"pixel_um": "file", "interval_min": "user", "z_um": "none"}
