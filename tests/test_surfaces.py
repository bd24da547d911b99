"""Outlines and the device map on drawn scenes."""

import numpy as np

from driftline.operators import surfaces


def test_moving_square(spark):
    rows = [(1, f, y, x + 2 * f) for f in (0, 1) for y in range(4) for x in range(6)]
    r = surfaces.surface_delta(spark.createDataFrame(rows, "track_id bigint, frame int, y int, x int")).collect()
    assert len(r) == 1 and r[0].n_kept == 16
    assert r[0].extension_front == 8 and r[0].extension_rear == 0
    assert r[0].retraction_rear + r[0].retraction_flank == 8 and r[0].retraction_front == 0


def test_patches():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], bool)
    p = surfaces.patches(m)
    assert len(set(p[m])) == 3 and p[0, 0] == p[1, 1] and p[0, 3] == p[1, 3] and (p[~m] == 0).all()
    snake = np.zeros((40, 41), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert len(set(surfaces.patches(snake)[snake])) == 1


def test_device_map():
    rng = np.random.default_rng(0)
    stack = rng.normal(100, 1, (12, 80, 300))
    stack[:, :, 120:124] += 60
    stack[:, 70:, :] += 0
    for t in range(12):
        stack[t, 20:40, 30 + 12 * t : 50 + 12 * t] += 40
    s = surfaces.AtlasSettings(longest_cell_px=60, largest_cell_px=2000)
    code, _, persistence = surfaces.device_map(stack, None, s)
    name = np.array(surfaces.CLASSES)[code]
    assert (name[60:, 120:124] == "CHANNEL_WALL").mean() > 0.9
    assert (name[60:, 200:] == "STATIC_BACKGROUND").mean() > 0.8
    assert persistence[5, 5] > 0.9


def test_device_maps_per_movie(spark):
    im = np.zeros((6, 7), np.float32)
    df = spark.createDataFrame([(m, f, 6, 7, bytearray(im.tobytes())) for m in (1, 2) for f in range(3)], "movie bigint, frame int, height int, width int, pixels binary")
    rows = surfaces.device_maps(df).collect()
    assert sorted(r.movie for r in rows) == [1, 2] and all(len(r.classes) == 42 for r in rows)
