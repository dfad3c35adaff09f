"""Tables of detections: rejection codes, summaries, masks, frame quality and solving."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fitting, spatial
from .rejection import median_of

#: 2 * sqrt(2 * ln 2): width of a Gaussian at half maximum over sigma.
FWHM = 2.3548200450309493


def rejection_code(*, roundness: float = 0.5, most: float = 2.0, colour: bool = False, kernel: float = 3.0, dynamic_range: float = 1.0, sigma: float = 1.0, low: float = 0.0, high: float = 0.0, beta: float | None = None) -> Column:
    """The first test that a profile (fwhmx, fwhmy, x0, y0, mag, sx, sy, rmse, a, beta) fails, or OK."""
    missing = lambda *c: F.greatest(*[(F.col(k).isNull() | F.isnan(k)).cast("int") for k in c], F.lit(0)) == 1
    ratio = F.col("fwhmy") / F.when(F.col("fwhmx") != 0, F.col("fwhmx"))
    wide = F.greatest("sx", "sy")
    limit = wide * FWHM * (1.0 + 0.5 * F.ln(F.greatest(wide / kernel, F.lit(1.001))))
    code = F.when(missing("fwhmx", "fwhmy"), "NO_FWHM").when(missing("x0", "y0"), "NO_POS").when(missing("mag"), "NO_MAG")
    if colour:
        code = code.when((F.col("fwhmx") <= 1) | (F.col("fwhmy") <= 1), "FWHM_TOO_SMALL")
    code = code.when((F.col("fwhmx") <= 0) | (F.col("fwhmy") <= 0), "FWHM_NEG").when((ratio < roundness) | (ratio > most), "ROUNDNESS")
    code = code.when(F.col("fwhmx") > limit, "FWHM_TOO_LARGE")
    code = code.when((F.col("rmse") * sigma > 0.2 * F.col("a")) & ~(F.col("a") > dynamic_range), "RMSE_TOO_LARGE")
    if low > 0:
        code = code.when(F.col("a") < low, "AMPLITUDE")
    if high > 0:
        code = code.when(F.col("a") > high, "AMPLITUDE")
    if beta is not None:
        code = code.when(F.col("beta") < beta, "MOFFAT_BETA_TOO_SMALL")
    return code.otherwise("OK")


def summary(stars: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population deviation and upper median of a measure."""
    s = F.sort_array(F.collect_list(value))
    return stars.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.get(s, F.floor(F.size(s) / 2).cast("int")).alias("median"))


def frame_quality(stars: DataFrame, noise: DataFrame, top: int = 50) -> DataFrame:
    """``frame_id, fwhm, roundness, wfwhm, n, quality`` of the brightest stars with a sane
    width; frames without such stars have width 99 and quality 0."""
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("flux"), "id"))
    s = stars.withColumn("k", rank)
    sane = (F.col("k") <= top) & (F.col("fwhm") > 0.5) & (F.col("fwhm") < 20)
    m = s.groupBy("frame_id").agg(F.count("*").alias("n"), F.avg(F.when(sane, F.col("fwhm"))).alias("fwhm"), F.avg(F.when(sane, F.col("roundness"))).alias("roundness"))
    m = noise.join(m, "frame_id", "left")
    wide = F.when(F.col("fwhm").isNotNull(), F.col("fwhm") / F.greatest(F.lit(0.05), F.col("roundness"))).otherwise(99.0)
    quality = F.when(F.col("fwhm").isNotNull(), F.greatest(F.lit(1.0), F.col("n").cast("double")) / (F.greatest(F.lit(0.05), wide) * F.greatest(F.lit(0.01), F.col("noise")))).otherwise(0.0)
    return m.select("frame_id", F.coalesce("fwhm", F.lit(99.0)).alias("fwhm"), F.coalesce("roundness", F.lit(0.0)).alias("roundness"), wide.alias("wfwhm"), F.coalesce("n", F.lit(0)).alias("n"), quality.alias("quality"))


def star_mask(stars: DataFrame, width: int, height: int, core: float = 2.5) -> DataFrame:
    """``x, y, m``: discs of core * radius with a linear skirt of the same width; the greatest
    wins. A star is copied to the pixels of its bounding box only."""
    r = F.col("radius") * core
    reach = F.ceil(r * 2).cast("int")
    s = stars.select(F.col("x").alias("sx"), F.col("y").alias("sy"), r.alias("r"), reach.alias("q")).withColumn("i", F.explode(F.sequence(-F.col("q"), F.col("q")))).withColumn("j", F.explode(F.sequence(-F.col("q"), F.col("q"))))
    s = s.withColumns({"x": (F.round("sx") + F.col("i")).cast("int"), "y": (F.round("sy") + F.col("j")).cast("int")})
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    d = F.sqrt(dx * dx + dy * dy)
    m = F.when(d < F.col("r"), 1.0).when(d < 2 * F.col("r"), 1.0 - (d - F.col("r")) / F.col("r")).otherwise(0.0)
    s = s.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).withColumn("m", m).where("m > 0")
    return s.groupBy("x", "y").agg(F.max("m").alias("m"))


def disc_median(px: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Pixels of a disc become the median of a ring of twice its radius: a repair brush."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    ring = px.where((d2 > radius * radius) & (d2 <= 4 * radius * radius)).groupBy("frame_id", "c").agg(F.median("v").alias("fill"))
    j = px.join(F.broadcast(ring), ["frame_id", "c"], "left")
    return j.withColumn("v", F.when(d2 <= radius * radius, F.coalesce("fill", "v")).otherwise(F.col("v"))).drop("fill")


def bad_lines(px: DataFrame, k: float = 4.0) -> DataFrame:
    """``frame_id, c, y``: rows whose median is beyond k * 1.4826 MAD of their frame's row medians."""
    rows = px.groupBy("frame_id", "c", "y").agg(F.median("v").alias("m"))
    f = rows.groupBy("frame_id", "c").agg(F.collect_list("m").alias("ms"))
    f = f.withColumn("mid", median_of(F.col("ms")))
    dev = F.zip_with("ms", F.array_repeat(F.col("mid"), F.size("ms")), lambda a, b: F.abs(a - b))
    f = f.withColumn("mad", median_of(dev))
    return rows.join(f.select("frame_id", "c", "mid", "mad"), ["frame_id", "c"]).where(F.abs(F.col("m") - F.col("mid")) > k * 1.4826 * F.col("mad")).select("frame_id", "c", "y")


def fix_lines(px: DataFrame, k: float = 4.0) -> DataFrame:
    """Bad rows are replaced by the mean of the rows above and below (those that exist)."""
    w = Window.partitionBy("frame_id", "c", "x").orderBy("y")
    up, down = F.lag("v").over(w), F.lead("v").over(w)
    fill = F.when(up.isNotNull() & down.isNotNull(), (up + down) / 2).otherwise(F.coalesce(up, down, F.col("v")))
    bad = bad_lines(px, k).withColumn("bad", F.lit(True))
    return px.withColumn("fill", fill).join(bad, ["frame_id", "c", "y"], "left").withColumn("v", F.when(F.col("bad"), F.col("fill")).otherwise(F.col("v"))).drop("fill", "bad")


def match_catalog(image: DataFrame, catalog: DataFrame, *, stars: int = 20, radius: float = 0.002, rounds: int = 4, tolerance: float = 20.0) -> np.ndarray | None:
    """Affine map of image positions to catalog plane positions, or None.

    Triangles of the brightest stars vote; the best pairs give a first map; nearest
    pairs under the map give the next, with a shrinking tolerance. Only votes of
    short lists and the sums of normal equations reach the driver.
    """
    a = image.orderBy(F.desc("flux"), "id").limit(stars).select("id", "x", "y")
    b = catalog.orderBy(F.desc("flux"), "id").limit(stars).select("id", "x", "y")
    votes = spatial.triangle_votes(a, b, radius)
    best = votes.withColumn("k", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("votes"), "right_id"))).where("k = 1 AND votes > 1")
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("right_id").orderBy(F.desc("votes"), "left_id"))).where("k = 1")
    best = best.orderBy(F.desc("votes"), "left_id").limit(max(3, stars // 2))
    p = best.join(a.toDF("left_id", "x_a", "y_a"), "left_id").join(b.toDF("right_id", "x_b", "y_b"), "right_id")
    m = fitting.affine(p, 3)
    for k in range(rounds):
        if m is None:
            return None
        (a1, a2, a3), (b1, b2, b3) = m.tolist()
        moved = image.select("id", (a1 * F.col("x") + a2 * F.col("y") + a3).alias("x"), (b1 * F.col("x") + b2 * F.col("y") + b3).alias("y"), F.struct("x", "y").alias("from"))
        near = spatial.nearest_one_to_one(moved, catalog.select("id", "x", "y"), tolerance / 2**k)
        m = fitting.affine(near.select(F.col("from_a.x").alias("x_a"), F.col("from_a.y").alias("y_a"), "x_b", "y_b"), 3)
    return m


def solution(m: np.ndarray) -> dict[str, float]:
    """Scale, rotation in degrees and parity of an affine map."""
    det = m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    return {"scale": math.sqrt(abs(det)), "rotation": math.degrees(math.atan2(m[1, 0], m[0, 0])) % 360, "flipped": det < 0}
