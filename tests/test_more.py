"""Models, statistics, imaging, registry, verdicts, command line."""

import itertools
import math
import time

import numpy as np
import pytest

from driftline.__main__ import main
from driftline.functions import metadata, precision, stats
from driftline.operators import brackets, consensus, grouping, imaging, inference, lanes, models, quality, regions, scoring
from driftline.schema import Scale
from driftline.sources.projects import Registry


def test_ridge_and_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5
    df = spark.createDataFrame([(float(a), float(b), float(c), float(c > 5)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double, z double")
    m = models.ridge(df, ["a", "b"], "y", 0.0)
    assert m.weights == pytest.approx((3, -2)) and m.intercept == pytest.approx(5)
    p = df.withColumn("p", models.logistic(df, ["a", "b"], "z").probability()).collect()
    assert np.mean([(r.p > 0.5) == (r.z == 1) for r in p]) > 0.97


def test_leave_one_group_out(spark):
    df = spark.createDataFrame([(g, float(i), 2.0 * i) for g in "abc" for i in range(5)], "g string, x double, y double")
    assert all(abs(r.pred - r.y) < 1e-6 for r in models.leave_one_group_out(df, "g", ["x"], "y", lambda d, f, y: models.ridge(d, f, y, 0.0)).collect())


def test_intervals():
    assert stats.beta_share(0.5, 2, 2) == pytest.approx(0.5)
    low, high = stats.binomial_interval(5, 10)
    assert (low, high) == pytest.approx((0.187086, 0.812914), abs=1e-5)
    assert stats.binomial_interval(0, 4) == pytest.approx((0, 0.602365), abs=1e-5)
    assert stats.binomial_interval(0, 0) == (0.0, 1.0)


def test_conformal_is_infinite_when_small(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", float(i)) for i in range(19)], "g string, residual double")
    got = {r.g: r.quantile for r in inference.conformal_quantile(df, "g", 0.1).collect()}
    assert got == {"a": math.inf, "b": 17.0}


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([("a", 10), ("b", 6), ("c", 5), ("d", 1)], "group string, n int")
    fold = {r.group: r.fold for r in inference.group_folds(df, 2).collect()}
    assert fold["a"] != fold["b"] == fold["c"] and fold["d"] == fold["a"]


def test_registration_finds_shift():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(64, 64))
    smooth = np.real(np.fft.ifft2(np.fft.fft2(base) * np.exp(-(np.fft.fftfreq(64)[:, None] ** 2 + np.fft.fftfreq(64)[None] ** 2) * 200)))
    dx, dy, _ = imaging.shift_between(smooth, np.roll(smooth, (3, -5), (0, 1)))
    assert (dx, dy) == pytest.approx((-5, 3), abs=0.3)


def test_shifted_overlap():
    a = np.ones((4, 4), bool)
    assert imaging.shifted_iou(a, (0, 0), a, (2, 0)) == pytest.approx(8 / 24)
    assert imaging.shifted_iou(a, (0, 0), a, (2, 0), (2, 0)) == 1.0


def test_label_images_to_regions(spark):
    im = np.zeros((8, 10), np.float32)
    im[1:4, 2:8] = 1
    df = spark.createDataFrame([(1, 0, 8, 10, bytearray(im.tobytes()))], "movie bigint, frame int, height int, width int, pixels binary")
    from pyspark.sql import functions as F

    r = regions.region_metrics(imaging.label_rows(df).withColumn("value", F.lit(1.0))).first()
    assert (r.area_px, r.min_x, r.max_x, r.min_y, r.max_y, r.extent_px) == (18, 2, 8, 1, 4, 6)
    assert r.major_axis_px == pytest.approx(4 * 6 / math.sqrt(12)) and r.minor_axis_px == pytest.approx(4 * 3 / math.sqrt(12))


def test_principal_axes_of_a_box(spark):
    rows = [(0, 1, z, y, x) for z, y, x in itertools.product(range(3), range(6), range(12))]
    r = regions.principal_axes(spark.createDataFrame(rows, "frame int, label int, z int, y int, x int")).first()
    want = [math.sqrt(20 * (n * n - 1) / 12) for n in (12, 6, 3)]
    assert [r.principal_axis_1, r.principal_axis_2, r.principal_axis_3] == pytest.approx(want, rel=1e-6)


def test_registry(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "reg"))
    reg.put("a", name="one", source="s")
    time.sleep(0.01)
    reg.put("b", name="two", source="s")
    time.sleep(0.01)
    reg.put("a", status="done")
    assert [r.id for r in reg.recent(5).collect()] == ["a", "b"]
    assert (reg.get("a").name, reg.get("a").status, reg.by_source("s").id) == ("one", "done", "a")
    time.sleep(0.01)
    reg.delete("a")
    assert reg.get("a") is None


EV = "present_now boolean, cellprob double, atlas_class string, atlas_wall_fraction double, atlas_class_confidence double, past_support boolean, future_support boolean, speed double, max_speed double, shape_plausible boolean, structure_match double"


@pytest.mark.parametrize(
    ("row", "state"),
    [
        ((True, 5.0, "CHANNEL_WALL", 0.82, 0.9, True, True, None, None, True, None), "REJECTED"),
        ((True, 5.0, "VALID_CELL_REGION", 0.1, 0.9, True, True, None, None, True, None), "CONFIRMED"),
        ((True, None, "UNKNOWN", 0.0, 0.0, False, False, None, None, True, None), "AMBIGUOUS"),
        ((True, -1.0, "UNKNOWN", 0.0, 0.0, False, False, None, None, True, None), "REJECTED"),
        ((True, 1.0, "UNKNOWN", 0.0, 0.0, True, False, 9.0, 5.0, True, None), "AMBIGUOUS"),
        ((False, None, None, None, None, True, True, None, None, None, 0.6), "TEMPORAL_RECOVERY_CANDIDATE"),
        ((False, None, None, None, None, True, False, None, None, None, 0.6), "REJECTED"),
    ],
)
def test_verdicts(spark, row, state):
    assert consensus.verdict(spark.createDataFrame([row], EV)).first().state == state


def test_lanes(spark):
    three = [(0, 0.0, 0.0, 0.0, 1.0, 20.0), (1, 40.0, 0.0, 0.0, 1.0, 20.0), (2, 120.0, 0.0, 0.0, 1.0, 40.0)]
    rows = spark.createDataFrame([(x, 5.0) for x in (-30.0, -10.0, 0.0, 15.0, 65.0, 90.0, 159.0, 161.0)], "x_px double, y_px double")
    assert [r.channel for r in lanes.with_lane(rows, three).collect()] == [-1, 0, 0, 0, 1, 2, 2, -1]
    assert [r.channel for r in lanes.with_lane(rows.limit(1), []).collect()] == [-1]


def test_brackets(spark):
    rows = spark.createDataFrame([(1, t, lab) for t, lab in ((0, True), (2, False), (5, True), (7, False))], "k int, t int, lab boolean")
    from pyspark.sql import functions as F

    got = {r.t: (r.before, r.after, r.fraction, r.why) for r in brackets.brackets(rows, "k", "t", F.col("lab")).collect()}
    assert got[2] == (0, 5, 0.4, "") and got[7][3] == "last labelled time" and got[0][3] == "first labelled time"


def test_metadata(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "Exposure = 5 ms\nbad line\nExposure = 7 ms\nGain=2")], "k int, t string")
    assert {r.name: r.value for r in metadata.settings(rows, "k", "t").collect()} == {"Exposure": "5 ms", "Gain": "2"}
    labels = spark.createDataFrame([(["t:4/54 - a", "t:5/54 - a"],), (["t:4/54", "x"],), ([],)], "l array<string>")
    assert [r[0] for r in labels.select(metadata.source_frames(F.col("l"))).collect()] == [[4, 5], None, None]
    v = spark.createDataFrame([("v1.2.0",), ("1.10",), ("0.9.9",), ("2",)], "v string")
    assert [r[0] for r in v.select(metadata.version_at_least(F.col("v"), "1.3")).collect()] == [False, True, False, True]


def test_precision(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(100.0,), (0.0,)], "a double")
    assert [r[0] for r in rows.select(precision.displacement_floor(F.col("a"), 0.5)).collect()] == pytest.approx([math.sqrt(2) * 0.05, math.inf])


def test_findings_of_events(spark):
    events = spark.createDataFrame([(3, [4, 5], [])], "frame int, merge_suspected array<int>, split_suspected array<int>")
    assert sorted(r.track_id for r in quality.suspected(events, "merge").collect()) == [4, 5]
    assert quality.suspected(events, "split").count() == 0
    flagged = spark.createDataFrame([(1, 2, 9, True, False)], "track_id bigint, first_frame int, last_frame int, enters boolean, exits boolean")
    assert [(r.code, r.frame) for r in quality.border_flags(flagged).collect()] == [("border_entry", 2)]
    assert [r.code for r in quality.run_findings(spark, Scale.of(0.5, 1), ndim=3).collect()] == ["no_z_step"]


def test_score_of_nothing(spark):
    rows = spark.createDataFrame([(False, False)], "truth boolean, predicted boolean")
    r = scoring.prf(rows).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_straddling_is_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "unit int, grp string")
    with pytest.raises(ValueError):
        grouping.refuse_straddling(rows, "unit", "grp")
    assert grouping.refuse_straddling(rows.where("grp = 'a'"), "unit", "grp").count() == 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.root for r in grouping.components(links).collect()} == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100}


def test_command_line(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("frame,label,x,y,area\n" + "\n".join(f"{f},1,45,{20 + 2 * f},800" for f in range(6)))
    out = str(tmp_path / "run")
    assert main(["analyse", str(p), "-o", out, "--pixel-um", "0.5", "--interval-min", "10"]) == 0
    assert main(["show", out]) == 0
    assert main(["show", str(tmp_path / "none")]) == 3
    assert main(["analyse"]) == 2


def test_long_chains_and_cycles(spark):
    """Neither ancestors nor components end at a fixed depth."""
    from driftline.operators import grouping

    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(0, 5), (7, None)], "child bigint, parent bigint")
    got = {r.node: r.depth for r in grouping.lineage(edges, 39, checkpoint=lambda df: spark.createDataFrame(df.collect(), df.schema)).collect()}
    assert got == {39 - k: k for k in range(40)}


def test_margins_of_rows_and_columns():
    """Against leaving each match's row and column out one by one."""
    import numpy as np

    from driftline.functions import assign

    rng = np.random.default_rng(7)
    for _ in range(40):
        costs = rng.integers(0, 8, (rng.integers(1, 6), rng.integers(1, 6))).astype(float)
        costs[rng.random(costs.shape) < 0.3] = assign.FORBIDDEN
        matches = assign.match(costs, 5.0)
        want = {(i, j): min([10.0] + [costs[i, k] for k in range(costs.shape[1]) if k != j] + [costs[k, j] for k in range(costs.shape[0]) if k != i]) - costs[i, j] for i, j in matches}
        assert assign.local_margins(costs, matches, 5.0) == want


def test_workbook_limits_and_kinds():
    import zipfile
    from io import BytesIO

    import pytest

    from driftline.sinks import tables

    data = tables.workbook([("a/b", ["x", "y"], [[True, 0.1 + 0.2], [None, float("nan")], [3, "<\x00&\ud800>"]])])
    sheet = zipfile.ZipFile(BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="A2" t="b"><v>1</v></c><c r="B2"><v>0.3</v></c>' in sheet and "&lt;&amp;&gt;" in sheet and 'r="A3"' not in sheet.replace('row r="A3"', "")
    with pytest.raises(ValueError):
        tables.workbook([("wide", ["c"] * 20_000, [])])


def test_units_in_any_spelling(spark):
    from pyspark.sql import functions as F

    from driftline.functions import precision

    rows = spark.createDataFrame([(u,) for u in (" µm", "μm", "\\u00b5m", "um", "UM", "micron", "nm", "cm", "inch", None, "")], "u string")
    got = [r[0] for r in rows.select(precision.um_per_unit(F.col("u"))).collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1e-3, 1e4, None, None, None]


def test_peaks_against_plain(spark):
    import random

    from driftline.operators import audit

    rng = random.Random(6)
    rows = [(g, float(rng.randrange(60)), rng.randrange(9)) for g in range(3) for _ in range(40)]
    want = []
    for g in range(3):
        kept = []
        for _, p, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if all(abs(p - q) >= 5 for q, _ in kept):
                kept.append((p, s))
        want += [(g, *k) for k in kept]
    got = audit.peaks(spark.createDataFrame(rows, "g int, p double, s int"), "g", "p", "s", 5.0).collect()
    assert sorted(map(tuple, got)) == sorted(want)
