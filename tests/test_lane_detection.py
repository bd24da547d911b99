import numpy as np
import pytest

from driftline.operators.lane_detection import detect, median_line, ridge_peaks


def test_tilted_walls():
    rng = np.random.default_rng(0)
    stack = rng.normal(100, 2, (8, 160, 200))
    y = np.arange(160)
    for x0 in (40, 90, 140):
        for dx in (-1, 0, 1):
            stack[:, y, (x0 + 0.02 * y).round().astype(int) + dx] += 60
    lanes = detect(stack)
    assert [round(v[1]) for v in lanes] == [65, 115]
    assert all(v[3] / v[4] == pytest.approx(0.02, abs=0.01) and v[5] == pytest.approx(25, abs=1.5) for v in lanes)


def test_no_walls():
    assert detect(np.random.default_rng(1).normal(100, 2, (4, 60, 80))) == []


def test_peaks_keep_apart():
    p = np.zeros(100)
    p[[20, 26, 60]] = [9, 8, 7]
    assert len(ridge_peaks(p + 1e-6 * np.arange(100), 3, 12)) == 2


def test_line_with_outliers():
    t = np.arange(9.0)
    v = 2 * t + 1
    v[[1, 7]] = 50
    assert median_line(t, v) == pytest.approx((2, 1))
