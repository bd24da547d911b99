"""Mask archives, registries, locks, axes, stills, matching."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import axes, stills
from driftline.operators import matching
from driftline.schema import TrackingSettings, tolerant
from driftline.sources import arrays


def test_masks_round_trip(spark, tmp_path):
    m = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4)
    df = spark.createDataFrame([(k, 3, 4, bytearray(m[k].tobytes())) for k in range(2)], "frame int, height int, width int, pixels binary")
    arrays.write_masks(spark, str(tmp_path / "masks.npz"), df)
    rows = arrays.read_masks(spark, str(tmp_path / "masks.npz")).orderBy("frame").collect()
    assert (np.stack([np.frombuffer(r.pixels, np.float32).reshape(3, 4) for r in rows]) == m).all()


def test_registry_versions(spark, tmp_path):
    folder = str(tmp_path)
    assert arrays.write_versioned(spark, folder, "models", [{"id": 1}]).endswith("models.1.json")
    second = arrays.write_versioned(spark, folder, "models", [{"id": 1}, {"id": 2}])
    assert second.endswith("models.2.json") and arrays.read_registry(spark, second).count() == 2


def test_locks(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_bytes(n.encode())
    locks = spark.createDataFrame([("a", hashlib.sha256(b"a").hexdigest()), ("b", "00")], "name string, sha256 string")
    states = arrays.verify_locks(spark, str(tmp_path), locks)
    assert {r.name: r.state for r in states.collect()} == {"a": "ok", "b": "changed", "c": "missing_lock"}
    assert arrays.refuse_changed(states.where("name = 'a'")).count() == 1
    with pytest.raises(Exception, match="locked"):
        arrays.refuse_changed(states).collect()


def test_axes():
    d = np.arange(24).reshape(2, 3, 4)
    assert axes.canonical(d, "TYX").shape == (2, 3, 4)
    assert axes.canonical(d, "YXT").shape == (4, 2, 3)
    assert (axes.canonical(d, "CYX", 1) == d[1][None]).all()
    assert axes.canonical(d[None], "ZTYX").shape == (2, 3, 4)
    for bad in ("YX", "TTX", "QYX", "TZX"):
        with pytest.raises(ValueError):
            axes.canonical(d, bad)
    with pytest.raises(ValueError):
        axes.labels(np.array([0.5]))


def test_stills(spark):
    rows = spark.createDataFrame([("t:42/54 - 052924_2.nd2 (series 01)",), ("t:1/9 - 20240131 x (series 2)",), ("none",)], "l string")
    got = [r.s for r in rows.select(stills.still(F.col("l")).alias("s")).collect()]
    assert (got[0].frame, got[0].frames, got[0].name, got[0].series, str(got[0].recorded)) == (42, 54, "052924_2.nd2", 1, "2024-05-29")
    assert str(got[1].recorded) == "2024-01-31" and got[2].frame is None


def test_augmentation_is_replayed(spark):
    rows = spark.range(200)
    a, b = (rows.repartition(n).select("id", stills.augmentation(7, F.col("id")).alias("a")).orderBy("id").collect() for n in (1, 4))
    assert a == b and {r.a.turns for r in a} == {0, 1, 2, 3}


def test_matching_counts_pairs_first(spark):
    rng = np.random.default_rng(2)
    for k in range(6):
        iou = rng.uniform(0.3, 0.9, (3, 3))
        rows = [(1, t, p, float(iou[t, p])) for t in range(3) for p in range(3)]
        got = matching.match_instances(spark.createDataFrame(rows, "image bigint, truth_label bigint, pred_label bigint, iou double"), 0.5).collect()
        best = max(((sum(iou[t, p] >= 0.5 for t, p in enumerate(q)), sum(iou[t, p] for t, p in enumerate(q) if iou[t, p] >= 0.5)) for q in itertools.permutations(range(3))))
        assert (len(got), sum(r.iou for r in got)) == (best[0], pytest.approx(best[1])), k


def test_image_scores(spark):
    m = spark.createDataFrame([(1, 1, 1, 0.8)], "image bigint, truth_label bigint, pred_label bigint, iou double")
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "image bigint, label int")
    p = spark.createDataFrame([(1, 1), (3, 1)], "image bigint, label int")
    got = {r.image: (r.tp, r.fp, r.fn, r.mean_iou) for r in matching.image_scores(m, t, p).collect()}
    assert got == {1: (1, 0, 1, 0.8), 2: (0, 0, 1, 0.0), 3: (0, 1, 0, 0.0)}


def test_tolerant_settings():
    s = tolerant(TrackingSettings, {"max_gap": 5, "unheard_of": 1})
    assert s.max_gap == 5 and s.min_observations == 2
