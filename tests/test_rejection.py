"""Rejection rules on small samples, against plain loops."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.operators import rejection

OUTLIER = [1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 9.0]


@pytest.mark.parametrize("rule", list(rejection.KERNELS))
def test_constant_and_small(rule):
    for values in ([0.25] * 5, [0.25], [], [0.1, 0.9], [1.0, 1.0, 1.0]):
        new, kept = rejection.apply_kernel([np.array(values)], rule)
        assert kept[0].all() and new[0].tolist() == values


@pytest.mark.parametrize("rule", [r for r in rejection.KERNELS if r != "sigmedian"])
def test_outlier(rule):
    options = {"low": 2.0, "high": 2.0} if rule in ("sigma", "winsorized") else {"low": 3.0, "high": 1.9} if rule == "linear" else {}
    _, kept = rejection.apply_kernel([np.array(OUTLIER)], rule, **options)
    assert not kept[0][-1] and kept[0][:6].sum() >= 5


def test_sigma_median_replaces():
    new, kept = rejection.apply_kernel([np.array(OUTLIER)], "sigmedian")
    assert kept[0].all() and new[0][-1] == pytest.approx(1.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=0, max_size=12), st.floats(1, 3), st.floats(1, 3))
def test_sigma_against_loop(values, low, high):
    _, kept = rejection.apply_kernel([np.array(values)], "sigma", low=low, high=high)
    left = list(range(len(values)))
    while True:
        if len(left) < 3:
            break
        now = np.array([values[i] for i in left])
        m, s = np.median(now), np.std(now, ddof=1)
        stay = [i for i in left if not (m - values[i] > low * s or values[i] - m > high * s)]
        if len(stay) == len(left) or len(stay) < 3:
            break
        left = stay
    # sums are added in another order: values within rounding of a limit may differ
    if set(np.flatnonzero(kept[0])) != set(left):
        now = np.array(values)
        assert min(abs(abs(v - np.median(now)) - k * np.std(now, ddof=1)) for v in values for k in (low, high)) < 1e-6


def test_ragged_is_each_alone():
    rng = random.Random(1)
    samples = [np.array([rng.gauss(0, 1) + (8 if rng.random() < 0.05 else 0) for _ in range(rng.randint(0, 30))]) for _ in range(40)]
    for rule in rejection.KERNELS:
        together = rejection.apply_kernel(samples, rule)
        if rule == "gesd":
            continue  # its number of candidates follows each depth; see below
        for k, s in enumerate(samples):
            v, kept = rejection.apply_kernel([s], rule)
            assert np.allclose(v[0], together[0][k]) and (kept[0] == together[1][k]).all(), rule


def plain_gesd(values, fraction=0.3, alpha=0.05):
    """One sample after the other, each pass over all that are left."""
    left, removed, last = list(range(len(values))), [], 0
    for i in range(int(np.floor(len(values) * fraction))):
        k = len(left)
        if k <= 3:
            break
        now = np.array([values[j] for j in left])
        gap, spread = np.abs(now - now.mean()), now.std(ddof=1)
        t = rejection.student_quantile(1 - alpha / (2 * k), k - 2)
        worst = int(gap.argmax())
        if spread > 0 and gap[worst] / spread > (k - 1) * t / np.sqrt((k - 2 + t * t) * k):
            last = i + 1
        removed.append(left.pop(worst))
    return sorted(removed[:last])


def test_gesd_against_loop():
    rng = np.random.default_rng(9)
    samples = []
    for k in range(60):
        v = rng.normal(0, 1, int(rng.integers(3, 70)))
        v[rng.random(len(v)) < 0.15] *= 10.0 ** rng.integers(1, 9)
        samples.append(np.round(v * 2) / 2 if k % 3 == 0 else v)
    _, kept = rejection.apply_kernel(samples, "gesd")
    found = [np.flatnonzero(~k).tolist() for k in kept]
    assert found == [plain_gesd(v.tolist()) for v in samples] and sum(map(bool, found)) > 20


def test_gesd_of_deep_samples():
    """Thousands of candidates: a step must not go over all samples again."""
    import time

    rng = np.random.default_rng(10)
    samples = [rng.normal(0, 1, 30_000) for _ in range(4)]
    for v in samples:
        v[::100] = 50.0 + np.arange(300)
    start = time.process_time()
    _, kept = rejection.apply_kernel(samples, "gesd")
    assert all(not k[::100].any() and k.sum() >= 29_690 for k in kept) and time.process_time() - start < 10


def test_deep_and_shallow_pixels_in_parts(spark, monkeypatch):
    """Rows are cut into parts by their samples; each pixel's result stays its own."""
    import pyarrow as pa

    column = pa.array([[0.0] * n for n in (5, 1, 0, 9, 2, 2, 2, 30, 1)], pa.list_(pa.float64()))
    monkeypatch.setattr(rejection, "PART", 12)
    cuts = list(rejection._parts(column, False))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(9))
    assert all(b - a == 1 or max(len(r) for r in column[a:b].to_pylist()) * (b - a) <= 12 for a, b in cuts)
    rows = [(0, OUTLIER), (1, [1.0] * 40 + OUTLIER), (2, []), (3, [0.5])]
    got = {r["k"]: r for r in rejection.reject(spark.createDataFrame(rows, "k int, values array<double>"), "gesd", ["k"]).collect()}
    for k, v in rows:
        assert got[k]["values"] == v and got[k]["kept"] == [i not in plain_gesd(v) for i in range(len(v))]


def test_gesd_quantiles():
    assert rejection.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert rejection.student_quantile(0.975, 30) == pytest.approx(2.042272, abs=2e-4)
    x = [0.0] + [k / 10 for k in range(-9, 10)] + [8.0, -9.0]
    _, kept = rejection.apply_kernel([np.array(x)], "gesd")
    assert np.flatnonzero(~kept[0]).tolist() == [len(x) - 2, len(x) - 1]


def test_linear_fit_keeps_a_ramp():
    _, kept = rejection.apply_kernel([np.arange(20.0)], "linear")
    assert kept[0].all()


def test_median_column(spark):
    from pyspark.sql import functions as F

    rows = [([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],), ([5.0],)]
    got = [r["m"] for r in spark.createDataFrame(rows, "v array<double>").select(rejection.median_of(F.col("v")).alias("m")).collect()]
    assert got == [statistics.median([3, 1, 2]), 2.5, None, 5.0]
