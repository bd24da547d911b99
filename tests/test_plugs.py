"""Flow paths, models from sums, consistency of shifts, plugged-in parts and staged runs."""

import itertools
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.assign import FORBIDDEN
from driftline.operators import imaging, matching, models, plugs


def best_total(costs, enter, leave, reward):
    """Least cost over all choices of a follower, or none, or staying out, for each detection."""
    n = len(costs)
    best = 0.0
    for choice in itertools.product(*[[None, "end", *[j for j in range(n) if costs[i, j] < FORBIDDEN]] for i in range(n)]):
        to = [c for c in choice if isinstance(c, int)]
        if len(set(to)) < len(to) or any(choice[j] is None for j in to):
            continue
        total = sum(0.0 if c is None else -reward + (leave if c == "end" else costs[i, c]) + (enter if i not in to else 0.0) for i, c in enumerate(choice))
        best = min(best, total)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_paths(seed):
    rng = np.random.default_rng(seed)
    n = 6
    costs = np.where(np.triu(rng.random((n, n)) < 0.6, 1), rng.integers(0, 9, (n, n)).astype(float), FORBIDDEN)
    enter, leave, reward = 2.0, 1.0, float(rng.integers(1, 6))
    paths = matching.cheapest_paths(costs, enter, leave, reward)
    seen = [i for p in paths for i in p]
    assert len(set(seen)) == len(seen)
    total = sum(enter + leave - reward * len(p) + sum(costs[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths)
    assert total == pytest.approx(best_total(costs, enter, leave, reward))


def test_flow_tracks(spark):
    rows = [(m, f, k, 10.0 * f, 100.0 * k) for m in (1, 2) for f in range(5) for k in (1, 2) if (f, k) != (2, 1)] + [(1, 3, 9, 500.0, 500.0)]
    d = spark.createDataFrame(rows, "movie int, frame int, label int, x double, y double")
    got = matching.flow_tracks(d, 20.0, 0.1, 1.0, 3.0, 3.0, 4.0).collect()
    of = {}
    for r in got:
        of.setdefault((r.movie, r.track_id), []).append((r.frame, r.label))
    assert sorted(map(sorted, of.values())) == sorted([sorted((f, k) for f in range(5) if (f, k) != (2, 1)) for k in (1, 2)] * 2)


def table(spark, n=300, groups=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n) + 5
    rows = [(int(i % groups), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "g int, a double, b double, c double, y double"), x, y


def test_folds_from_sums_are_fits_without_the_group(spark):
    df, _, _ = table(spark)
    got = models.leave_one_group_out(df, "g", ["a", "b", "c"], "y")
    for g in (0, 5):
        want = models.ridge(df.where(F.col("g") != g), ["a", "b", "c"], "y").column()
        worst = got.where(F.col("g") == g).withColumn("want", want).agg(F.max(F.abs(F.col("pred") - F.col("want")))).first()[0]
        assert worst < 1e-9
    alone = models.leave_one_group_out(df.where("g = 1"), "g", ["a"], "y")
    assert alone.where("pred is not null").count() == 0 and alone.count() == 50
    assert models.leave_one_group_out(df.limit(0), "g", ["a"], "y").count() == 0


def test_elastic_net_meets_its_conditions(spark):
    df, x, y = table(spark)
    penalty, part = 0.3, 0.6
    m = models.elastic_net(df, ["a", "b", "c"], "y", penalty, part)
    scale = x.std(axis=0)
    z, w = (x - x.mean(axis=0)) / scale, np.array(m.weights) * scale
    slope = z.T @ (y - y.mean() - z @ w) / len(y) - penalty * (1 - part) * w
    assert m.weights[2] == 0.0 and abs(slope[2]) <= penalty * part + 1e-6
    assert slope[:2] == pytest.approx(penalty * part * np.sign(w[:2]), abs=1e-6)


def test_principal_axes(spark):
    df, x, _ = table(spark)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    scores = df.select(*[m.column().alias(f"p{k}") for k, m in enumerate(models.principal_axes(df, ["a", "b", "c"], 2))]).toPandas().to_numpy()
    assert scores.var(axis=0) == pytest.approx(values[:2]) and abs(np.corrcoef(scores.T)[0, 1]) < 1e-9


def frames(spark, shifts):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(64, 64))
    base = sum(np.roll(base, (i, j), (0, 1)) for i in range(3) for j in range(3))
    rows = [(1, k, 64, 64, bytearray(np.roll(base, (dy, dx), (0, 1)).astype(np.float32).tobytes())) for k, (dx, dy) in enumerate(shifts)]
    return spark.createDataFrame(rows, "movie bigint, frame int, height int, width int, pixels binary")


def test_forward_and_backward_agree(spark):
    rows = sorted(imaging.forward_backward(frames(spark, [(0, 0), (3, -2), (5, 5)])).collect())
    assert [(round(r.dx), round(r.dy)) for r in rows] == [(3, -2), (2, 7)] and all(r.error_px < 0.5 for r in rows)


def test_plugged_parts(spark):
    f = frames(spark, [(0, 0), (1, 0)])
    labels = plugs.segmented(f, lambda im: (im > np.sort(im.ravel())[-10]).astype(int))
    assert {(r.frame, r.n) for r in labels.groupBy("frame").agg(F.count("*").alias("n")).collect()} == {(0, 9), (1, 9)}
    expected = spark.createDataFrame([(1, 0, 7, 5.0, 5.0), (1, 1, 8, 9.0, 9.0)], "movie bigint, frame int, track_id bigint, x double, y double")
    got = plugs.proposed(expected, f, lambda im, at: [(at[0], at[1], 0.2), (at[0] + 1, at[1], 0.9)] if at[0] < 9 else [(0, 0, 0.1)], 0.15).collect()
    assert [(r.track_id, r.x, r.confidence) for r in got] == [(7, 6.0, 0.9)]
    scored = plugs.weighted(expected, {"x": 2.0, "y": lambda c: F.greatest(c - 6, F.lit(0.0))}).collect()
    assert [r.score for r in scored] == [10.0, 21.0]
    with pytest.raises(Exception, match="segmenter"):
        plugs.segmented(f, lambda im: im[:3]).count()


def test_staged_run_reports_and_stops(spark):
    said = []
    run = plugs.StagedRun(spark, lambda *x: said.append(x))
    assert run.run([("one", lambda _: spark.range(5)), ("two", lambda d: d.count())]) == 5
    assert said == [("one", 0, 2), ("two", 1, 2), ("done", 2, 2)]
    run = plugs.StagedRun(spark)

    def slow(_):
        threading.Timer(2.0, run.cancel).start()
        return spark.range(4).repartition(4).mapInPandas(_sleepy, "id long").count()

    with pytest.raises(plugs.Cancelled, match="slow"):
        run.run([("slow", slow), ("never", lambda v: 1 / 0)])
    assert plugs.StagedRun(spark).run([("after", lambda _: spark.range(3).count())]) == 3


def _sleepy(batches):
    import time

    for b in batches:
        time.sleep(30)
        yield b
