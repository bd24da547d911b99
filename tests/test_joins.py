"""Joins that must not pass through the driver, whatever the session would broadcast, nor send rows more often than they need."""

import math

import numpy as np

from driftline.operators import gaps, grouping, morphology
from driftline.plans import catalog


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_texture_broadcasts_nothing(spark):
    px = spark.createDataFrame([(0, 1, y, x, float(x * 7 + y)) for y in range(4) for x in range(4)], "frame int, label int, y int, x int, value double")
    assert "Broadcast" not in plan(morphology.texture(px))


def test_components_broadcast_nothing(spark):
    plans = []

    def cut(df):
        plans.append(plan(df))
        return df.localCheckpoint()

    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (8, 9), (9, 20)], "a bigint, b bigint")
    got = {r.node: r.root for r in grouping.components(links, cut).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7}
    assert not [p for p in plans if "Broadcast" in p]


def sent(spark, df):
    """Its rows, and how many rows the stages that made them wrote for shuffles."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    rows = df.collect()
    return rows, sum(n for k, n in stages().items() if k not in before)


def pieces(spark, n=150):
    """Tracks of two observations, some without a place, and the pairs that may be joined."""
    rng = np.random.default_rng(7)
    tracks = [(k, f, f + int(rng.integers(0, 4)), *map(float, rng.uniform(0, 1500, 4))) for k, f in enumerate(map(int, rng.integers(-20, 40, n)))]
    tracks += [(n, 3, 4, 1.0, None, 1.0, None), (n + 1, 5, 6, math.nan, 1.0, math.nan, 1.0), (n + 2, None, None, 1.0, 1.0, 1.0, 1.0)]
    rows = [r for k, f, last, sx, sy, ex, ey in tracks for r in ([(k, f, sx, sy), (k, last, ex, ey)] if f != last else [(k, f, ex, ey)])]
    first = {k: (f, ex, ey) if f == last else (f, sx, sy) for k, f, last, sx, sy, ex, ey in tracks}
    want = set()
    for a, _, last, _, _, ex, ey in tracks[:n]:
        for b in range(n):
            f, x, y = first[b]
            if a != b and 1 <= f - last <= 4 and math.hypot(x - ex, y - ey) * 0.5 / ((f - last) * 60.0) <= 5.0:
                want.add((a, b, last, f, f - last))
    return spark.createDataFrame(rows, "track_id bigint, frame int, x_px double, y_px double"), want


def test_closing_sends_an_end_for_a_block_not_for_a_gap(spark):
    obs, want = pieces(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, n = sent(spark, gaps.closing_candidates(obs, catalog.SETTINGS, catalog.SCALE))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want) and len(want) > 500
    # to find tracks' starts and ends, then a start once and an end for two blocks at most
    assert n <= 5 * 153


def test_closing_with_many_starts_in_a_frame(spark, monkeypatch):
    monkeypatch.setattr(gaps, "TOGETHER", 2, raising=False)
    obs, want = pieces(spark)
    assert sorted(tuple(r)[:5] for r in gaps.closing_candidates(obs, catalog.SETTINGS, catalog.SCALE).collect()) == sorted(want)


def test_gap_closing_sends_the_events_once(spark):
    sf = "/root/testdata/sf0.001"
    rows, n = sent(spark, catalog.gap_closing_candidates(spark, sf))
    assert len(rows) > 1000
    assert n <= 2.5 * catalog.events(spark, sf).count()


def test_closing_takes_a_missing_coordinate_from_the_nearest_frame(spark):
    rows = [(1, 0, 3.0, 1.0), (1, 1, 4.0, None), (1, 2, None, None), (2, 4, None, 9.0), (2, 5, 10.0, 2.0)]
    obs = spark.createDataFrame(rows, "track_id bigint, frame int, x_px double, y_px double")
    got = gaps.closing_candidates(obs, catalog.SETTINGS, catalog.SCALE).collect()
    # as arg_min and arg_max do: from (4, 1) to (10, 9)
    assert [tuple(r)[:6] for r in got] == [(1, 2, 2, 4, 2, 10.0)]
