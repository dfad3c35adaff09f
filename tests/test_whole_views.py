"""Queries over whole views, against brute force over every pair."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from framelake.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Pixels off the multiples of 25, with 1 to 45 samples."""
    rng = random.Random(3)
    rows = []
    for pixel, depth in ((3, 1), (7, 4), (8, 21), (26, 30), (50, 45)):
        rows += [(pixel, frame, rng.uniform(900, 1100) * (9 if rng.random() < 0.1 else 1), 1.0) for frame in rng.sample(range(1000), depth)]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_extendedprice double, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    frames = [(i, [rng.uniform(0.1, 1) for _ in range(64)], i % 10) for i in range(90)]
    spark.createDataFrame(frames, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    samples = {}
    for pixel, _, v, _ in sorted(rows):
        samples.setdefault(pixel, []).append(v / 1000)
    return path, samples


def test_qn_of_every_pixel(spark, folder):
    path, samples = folder
    got = {r["pixel"]: (r["mean"], r["n_kept"]) for r in registry.queries()["qn_robust_mean"](spark, path).collect()}
    assert got.keys() == samples.keys()
    for pixel, vs in samples.items():
        n, s = len(vs), sorted(vs)
        kept = s[int(n * 0.3) : n - int(n * 0.3)]
        if n >= 5:
            h = n // 2 + 1
            apart = sorted(abs(a - b) for i, a in enumerate(s) for b in s[:i])
            kept = [v for v in s if abs(v - median(s)) <= 3 * 2.2219 * apart[h * (h - 1) // 2 - 1]]
        assert got[pixel] == (pytest.approx(sum(kept) / len(kept), abs=2e-9), len(kept))


def test_repeated_median_of_every_pixel(spark, folder):
    path, samples = folder
    got = {r["pixel"]: (r["slope"], r["intercept"]) for r in registry.queries()["repeated_median"](spark, path).collect()}
    assert got.keys() == {p for p, vs in samples.items() if len(vs) > 1}
    for pixel in got:
        at = list(enumerate(samples[pixel], 1))
        slope = median(median((b - a) / (j - i) for j, b in at if j != i) for i, a in at)
        assert got[pixel] == pytest.approx((slope, median(v - slope * i for i, v in at)), abs=2e-9)


def test_overlap_of_every_frame(spark, folder):
    path, _ = folder
    assert sorted(r["frame_id"] for r in registry.queries()["norm_overlap"](spark, path).collect()) == list(range(90))


@pytest.fixture(scope="module")
def two_mosaics(spark, tmp_path_factory):
    """256 + 32 frames of plain noise; the second mosaic is brighter."""
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("mosaics"))
    frames = [(i, [rng.uniform(0.4, 0.6) + (i // 256) for _ in range(64)], i % 10) for i in range(288)]
    spark.createDataFrame(frames, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["bg_samples", "bg_poly", "gradient_fit", "bg_removed", "bg_rbf", "star_detect", "psf_fit", "colour_surface"])
def test_every_mosaic_is_in_the_result(spark, two_mosaics, name):
    assert {r["frame_id"] for r in registry.queries()[name](spark, two_mosaics).select("frame_id").collect()} == {0, 1}


def test_mosaics_are_fitted_by_themselves(spark, two_mosaics):
    """The first mosaic's results are those of the operators on that mosaic alone."""
    from framelake.operators import fitting
    from framelake.plans.q_kernels import fields

    img = fields(spark, two_mosaics).where("frame_id = 0")
    same = lambda df, name: (
        {(r["x"], r["y"]): pytest.approx(r["v"], abs=1e-6) for r in df.collect()}
        == {(r["x"], r["y"]): r["v"] for r in registry.queries()[name](spark, two_mosaics).where("frame_id = 0").collect()})
    c = fitting.fit_background(fitting.background_samples(img, 8, 3.0), 2)
    assert same(fitting.remove_background(img, c, 2), "bg_removed")
    c = fitting.fit_background(fitting.background_samples(img, 8, 1e9), 3)
    assert same(fitting.remove_background(img, c, 3, divide=True), "colour_surface")
    s = [tuple(r) for r in fitting.background_samples(img, 32, 1e9).collect()]
    assert same(fitting.rbf_background(img, s).withColumn("v", F.col("model")), "bg_rbf")
