"""Script commands of calibration, background and stacking, against plain arithmetic."""

from __future__ import annotations

import numpy as np
import pytest

from framelake.plans import script

SCHEMA = "frame_id long, x int, y int, c int, v double"


def session(spark, **images):
    """Images as arrays of (frame, y, x) or (frame, c, y, x)."""
    s = script.Session(spark)
    for name, a in images.items():
        a = np.asarray(a, float)
        a = a[:, None] if a.ndim == 3 else a
        s.sequences[name] = spark.createDataFrame([(*map(int, (f, x, y, c)), float(v)) for (f, c, y, x), v in np.ndenumerate(a)], SCHEMA)
    return s


def array(px):
    rows = px.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r["v"]
    return out


def test_bias_and_scaled_dark_and_pedestal(spark):
    s = session(spark, light=np.full((2, 4, 4), 0.9), bias=np.full((1, 4, 4), 0.1), dark=np.full((1, 4, 4), 0.2))
    script.run("setmaster bias bias\nsetmaster dark dark\ncalibrate light -dark_scale=1.5 -pedestal=0.05", s)
    assert {round(r["v"], 9) for r in s.sequences["pp_light"].collect()} == {0.55}


def test_a_plane_of_each_frame_is_subtracted(spark):
    y, x = np.mgrid[0:32, 0:32]
    s = session(spark, light=[0.2 + 0.01 * x, 0.5 + 0.005 * y])
    script.run("seqsubsky light 1", s)
    got = {(r["frame_id"], round(r["v"], 6)) for r in s.sequences["bkg_light"].collect()}
    assert got == {(0, 0.355), (1, 0.5775)}


def test_weights_follow_a_rejection(spark):
    rng = np.random.default_rng(5)
    a = 0.5 + rng.normal(0, [[[0.01]], [[0.02]], [[0.05]], [[0.01]], [[0.03]]], (5, 6, 6))
    a[2, 3, 3] = 0.99
    got = array(script.run("stack light mean mad 3 3 -nonorm", session(spark, light=a)).current)
    w = 1 / a.reshape(5, -1).var(axis=1, ddof=1)
    plain = array(script.run("stack light --rejection=none -nonorm", session(spark, light=a)).current)
    assert plain == pytest.approx(np.average(a, axis=0, weights=w))
    at = a[:, 3, 3]
    assert got[3, 3] == pytest.approx(np.average(np.delete(at, 2), weights=np.delete(w, 2)))
    none = array(script.run("stack light --rejection=none -nonorm --weighting=none", session(spark, light=a)).current)
    assert none == pytest.approx(a.mean(axis=0))


@pytest.mark.parametrize("rule", ["percentile", "sigma", "mad", "winsorized", "linear", "gesdt"])
def test_equal_weights_change_no_rule(spark, rule):
    from framelake.operators import stacking

    rng = np.random.default_rng(6)
    a = rng.uniform(0.3, 0.6, (9, 4, 4))
    a[4, 1:3] = 3.0
    s = session(spark, light=a)
    options = {"low": 0.2, "high": 0.1} if rule == "percentile" else {}
    want = array(stacking.stack_rejected(s.sequences["light"], script.REJECTIONS[rule], **options).drop("n_rejected"))
    got = array(script.run(f"stack light --rejection={rule} -nonorm --weighting=none", s).current)
    assert got == pytest.approx(want)


def test_feather_fades_towards_a_frames_edge(spark):
    a = np.stack([np.full((8, 8), 0.2), np.full((8, 8), 0.6)])
    s = session(spark, light=a)
    from pyspark.sql import functions as F

    s.sequences["light"] = s.sequences["light"].withColumn("x", F.when(F.col("frame_id") == 1, F.col("x") + 4).otherwise(F.col("x")))
    got = array(script.run("stack light --rejection=none -nonorm --weighting=none --feather=4", s).current)
    step = lambda t: t * t * (3 - 2 * t)
    w0, w1 = step(min(3, 7 - 6, 4) / 4), step(min(3, 6 - 4, 4) / 4)
    assert got[3, 6] == pytest.approx((0.2 * w0 + 0.6 * w1) / (w0 + w1))
    assert got[3, 0] == pytest.approx(0.2)  # no weight there: the plain mean


def test_finer_grid(spark):
    s = session(spark, light=np.stack([np.arange(16).reshape(4, 4) / 20 + 0.1] * 2))
    fast = array(script.run("stack light -nonorm --fast --scale=2", s).current)
    assert fast[1::2, 1::2] == pytest.approx(np.arange(16).reshape(4, 4) / 20 + 0.1)
    whole = array(script.run("stack light -nonorm --drizzle --scale=2 --pixfrac=1", s).current)
    assert whole == pytest.approx(np.kron(np.arange(16).reshape(4, 4) / 20 + 0.1, np.ones((2, 2))))
    with pytest.raises(script.ScriptError):
        script.run("stack light -nonorm --fast --scale=0", s)


def test_channels_are_brought_to_greens_median(spark):
    a = np.stack([np.stack([np.full((3, 3), v) for v in (0.2, 0.4, 0.8)])] * 2)
    out = script.run("stack light --rejection=none -nonorm --rgb_equal", session(spark, light=a)).current
    assert {round(r["v"], 9) for r in out.collect()} == {0.4} and out.count() == 27


def test_registered_frames_are_kept_whole_if_asked(spark):
    y, x = np.mgrid[0:24, 0:24]
    spot = lambda cx: 0.1 + 0.8 * np.exp(-((x - cx) ** 2 + (y - 12) ** 2) / 4)
    a = np.stack([spot(10), spot(13), np.full((24, 24), 0.1)])
    s = session(spark, light=a)
    script.run("register light", s)
    assert {r["frame_id"] for r in s.sequences["r_light"].collect()} == {0, 1, 2}  # one has nothing to detect
    inside = array(script.run("stack r_light --rejection=none -nonorm", s).current)
    wide = array(script.run("stack r_light --rejection=none -nonorm --maximize", s).current)
    assert inside.shape == (24, 24) and wide.shape == (24, 27)
