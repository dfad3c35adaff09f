"""Queries of neighbourhood kernels, calibration, background and fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from framelake.operators import fitting, kernels, stacking
from framelake.plans import views
from framelake.plans.registry import query

PX = views.PX
KEY = "frame_id, x, y"


def rounded(df, *cols):
    return df.select("frame_id", "x", "y", *[F.round(c, 9).alias(c) for c in cols])


@query("bin2", f"WITH {PX} SELECT frame_id, c, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, round(avg(v), 9) AS v FROM px GROUP BY 1, 2, 3, 4")
def bin2(spark, d):
    return kernels.bin_pixels(views.px(spark, d), 2, 8, 8).withColumn("v", F.round("v", 9))


@query("bin3", f"WITH {PX} SELECT frame_id, c, CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y, round(avg(v), 9) AS v FROM px WHERE x < 6 AND y < 6 GROUP BY 1, 2, 3, 4")
def bin3(spark, d):
    return kernels.bin_pixels(views.px(spark, d), 3, 8, 8).withColumn("v", F.round("v", 9))


SITE = "CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'r' WHEN x % 2 = 1 AND y % 2 = 1 THEN 'b' ELSE 'g' END"


@query("superpixel", f"WITH {PX}, s AS (SELECT *, {SITE} AS s FROM px) SELECT frame_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, " + ", ".join(f"round(avg(v) FILTER (WHERE s = '{n}'), 9) AS {n}" for n in "rgb") + " FROM s GROUP BY 1, 2, 3")
def superpixel(spark, d):
    return rounded(kernels.superpixel(views.px(spark, d), "RGGB"), *"rgb")


@query("mirror_x", f"WITH {PX} SELECT frame_id, 7 - x AS x, y, round(v, 9) AS v FROM px")
def mirror_x(spark, d):
    return rounded(kernels.mirror(views.px(spark, d), "x", 8), "v")


@query("mirror_y", f"WITH {PX} SELECT frame_id, x, 7 - y AS y, round(v, 9) AS v FROM px")
def mirror_y(spark, d):
    return rounded(kernels.mirror(views.px(spark, d), "y", 8), "v")


for _n, (_x, _y) in {1: ("7 - y", "x"), 2: ("7 - x", "7 - y"), 3: ("y", "7 - x")}.items():
    query(f"rotate{90 * _n}", f"WITH {PX} SELECT frame_id, {_x} AS x, {_y} AS y, round(v, 9) AS v FROM px")(
        lambda spark, d, n=_n: rounded(kernels.rotate(views.px(spark, d), n, 8, 8), "v"))


@query("crop", f"WITH {PX} SELECT frame_id, x - 2 AS x, y - 1 AS y, round(v, 9) AS v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
def crop(spark, d):
    return rounded(kernels.crop(views.px(spark, d), 2, 1, 4, 6), "v")


@query("frame_shift", f"WITH {PX} SELECT frame_id, x + 3 AS x, y - 2 AS y, round(v, 9) AS v FROM px WHERE x + 3 <= 7 AND y - 2 >= 0")
def frame_shift(spark, d):
    return rounded(kernels.shift(views.px(spark, d), 3, -2, 8, 8), "v")


@query("resample_nearest", f"WITH {PX}, o AS (SELECT CAST(a.i AS INTEGER) AS ox, CAST(b.j AS INTEGER) AS oy FROM (SELECT unnest(range(0, 12)) AS i) a, (SELECT unnest(range(0, 12)) AS j) b) SELECT frame_id, ox AS x, oy AS y, round(v, 9) AS v FROM o JOIN px ON px.x = floor(ox / 1.5::DOUBLE) AND px.y = floor(oy / 1.5::DOUBLE)")
def resample_nearest(spark, d):
    return rounded(kernels.resample_nearest(views.px(spark, d), 1.5, 8, 8), "v")


def stencil_sql(offsets: list[tuple[int, int]], fn: str) -> str:
    parts = " UNION ALL ".join(f"SELECT frame_id, x - {dx} AS x, y - {dy} AS y, v FROM px" for dx, dy in offsets)
    return f"WITH {PX}, n AS ({parts}) SELECT frame_id, x, y, round({fn}(v), 9) AS v FROM n WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY frame_id, x, y"


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


@query("morph_erode", stencil_sql(CROSS, "min"))
def morph_erode(spark, d):
    return rounded(kernels.morphology(views.px(spark, d), "erode"), "v")


@query("morph_dilate", stencil_sql(CROSS, "max"))
def morph_dilate(spark, d):
    return rounded(kernels.morphology(views.px(spark, d), "dilate"), "v")


@query("morph_open")
def morph_open(spark, d):
    return rounded(kernels.morphology(views.px(spark, d), "open"), "v")


@query("morph_close")
def morph_close(spark, d):
    return rounded(kernels.morphology(views.px(spark, d), "close"), "v")


_NEAR = f"""s AS (SELECT *, {SITE} AS s FROM px),
n AS (SELECT a.frame_id, a.x, a.y, a.v, a.s,
  avg(b.v) FILTER (WHERE abs(b.x - a.x) + abs(b.y - a.y) = 1) AS cr, avg(b.v) FILTER (WHERE abs(b.x - a.x) = 1 AND abs(b.y - a.y) = 1) AS di,
  avg(b.v) FILTER (WHERE abs(b.x - a.x) = 1 AND b.y = a.y) AS ac, avg(b.v) FILTER (WHERE abs(b.y - a.y) = 1 AND b.x = a.x) AS dn
  FROM s a JOIN s b ON a.frame_id = b.frame_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3, 4, 5)"""


@query("debayer_bilinear", f"""WITH {PX}, {_NEAR} SELECT frame_id, x, y,
round(CASE s WHEN 'r' THEN v WHEN 'b' THEN di ELSE CASE WHEN y % 2 = 0 THEN ac ELSE dn END END, 9) AS r, round(CASE s WHEN 'g' THEN v ELSE cr END, 9) AS g,
round(CASE s WHEN 'b' THEN v WHEN 'r' THEN di ELSE CASE WHEN y % 2 = 0 THEN dn ELSE ac END END, 9) AS b FROM n""")
def debayer_bilinear(spark, d):
    return rounded(kernels.demosaic_bilinear(views.px(spark, d), "RGGB"), *"rgb")


def blur_sql(sigma: float) -> str:
    w = kernels.gaussian(sigma)
    r = len(w) // 2
    taps = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in zip(range(-r, r + 1), w))
    return f"""WITH {PX}, t(k, w) AS (VALUES {taps}),
a AS (SELECT p.frame_id, p.x, p.y, sum(t.w * q.v) AS v FROM px p, t JOIN px q ON true WHERE q.frame_id = p.frame_id AND q.y = p.y AND q.x = least(7, greatest(0, p.x + t.k)) GROUP BY 1, 2, 3)
SELECT p.frame_id, p.x, p.y, round(sum(t.w * q.v), 9) AS v FROM a p, t JOIN a q ON true WHERE q.frame_id = p.frame_id AND q.x = p.x AND q.y = least(7, greatest(0, p.y + t.k)) GROUP BY 1, 2, 3"""


@query("blur", blur_sql(1.0))
def blur(spark, d):
    return rounded(kernels.blur(views.px(spark, d), 1.0), "v")


@query("unsharp", blur_sql(0.8).replace("SELECT p.frame_id, p.x, p.y, round(sum(t.w * q.v), 9) AS v FROM a p, t", "SELECT p.frame_id, p.x, p.y, round(any_value(o.v) + 0.7::DOUBLE * (any_value(o.v) - sum(t.w * q.v)), 9) AS v FROM px o JOIN a p USING (frame_id, x, y), t"))
def unsharp(spark, d):
    return rounded(kernels.unsharp(views.px(spark, d), 0.8, 0.7), "v")


@query("banding_fix", f"""WITH {PX}, rq AS (SELECT frame_id, y, v AS qy FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, y ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY frame_id, y) AS n FROM px) WHERE i = n // 4),
fq AS (SELECT frame_id, v AS q FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM px) WHERE i = n // 4)
SELECT frame_id, x, y, round(v - qy + q, 9) AS v FROM px JOIN rq USING (frame_id, y) JOIN fq USING (frame_id)""")
def banding_fix(spark, d):
    return rounded(kernels.banding_fix(views.px(spark, d)), "v")


@query("cfa_equalize", f"""WITH {PX}, s AS (SELECT *, {SITE} AS s FROM px), m0 AS (SELECT frame_id, s, x % 2 AS i, y % 2 AS j, avg(v) AS m FROM s WHERE x >= 2 AND x < 5 AND y >= 2 AND y < 5 GROUP BY 1, 2, 3, 4),
m AS (SELECT frame_id, avg(m) FILTER (WHERE s = 'r') AS mr, avg(m) FILTER (WHERE s = 'g') AS mg, avg(m) FILTER (WHERE s = 'b') AS mb FROM m0 GROUP BY frame_id)
SELECT frame_id, x, y, round(v * CASE s WHEN 'r' THEN CASE WHEN mg >= 1e-9 AND mr > 1e-9 THEN mg / mr ELSE 1 END WHEN 'b' THEN CASE WHEN mg >= 1e-9 AND mb > 1e-9 THEN mg / mb ELSE 1 END ELSE 1 END, 9) AS v FROM s JOIN m USING (frame_id)""")
def cfa_equalize(spark, d):
    return rounded(kernels.cfa_equalize(views.px(spark, d), "RGGB", 8, 8), "v")


COSMETIC = f"""WITH {PX}, p AS (SELECT *, x % 2 + 2 * (y % 2) AS p FROM px), m AS (SELECT frame_id, p, median(v) AS m FROM p GROUP BY 1, 2),
s AS (SELECT frame_id, p, any_value(m) AS m, 1.4826::DOUBLE * median(abs(v - m)) AS s FROM p JOIN m USING (frame_id, p) GROUP BY 1, 2),
f AS (SELECT frame_id, x, y, v, v > m + 2.5::DOUBLE * s OR v < m - 2.5::DOUBLE * s AS fixed FROM p JOIN s USING (frame_id, p)),
n AS (SELECT a.frame_id, a.x, a.y, median(b.v) AS nm FROM f a JOIN px b ON a.frame_id = b.frame_id AND abs(a.x - b.x) IN (0, 2) AND abs(a.y - b.y) IN (0, 2) AND (a.x <> b.x OR a.y <> b.y) WHERE a.fixed GROUP BY 1, 2, 3)"""


@query("cosmetic", f"{COSMETIC} SELECT frame_id, x, y, round(coalesce(nm, v), 9) AS v, fixed FROM f LEFT JOIN n USING (frame_id, x, y)")
def cosmetic(spark, d):
    return kernels.cosmetic(views.px(spark, d), 2.5, 2.5).select("frame_id", "x", "y", F.round("v", 9).alias("v"), "fixed")


@query("deviant_pixels", f"{COSMETIC} SELECT frame_id, x, y FROM f WHERE fixed")
def deviant_pixels(spark, d):
    return kernels.deviant_pixels(views.px(spark, d), 2.5, 2.5)


# ---- tile kernels, held against NumPy in the tests ----

@query("atrous", f"WITH {PX} SELECT frame_id, x, y, round(v, 7) AS total FROM px")
def atrous(spark, d):
    """The planes of the transform add up to the frame."""
    a = kernels.atrous(views.px(spark, d), 2)
    return a.select("frame_id", "x", "y", F.round(F.col("w0") + F.col("w1") + F.col("residual"), 7).alias("total"))


for _name, _make in {
    "multiscale": lambda p: kernels.multiscale_denoise(p, [0.02, 0.01], [0.9, 1.1]),
    "clahe": lambda p: kernels.clahe(p),
    "resample_linear": lambda p: kernels.resample(p, 1.5, "linear"),
    "resample_cubic": lambda p: kernels.resample(p, 1.5, "cubic"),
    "resample_lanczos": lambda p: kernels.resample(p, 0.75, "lanczos"),
    "rotate_angle": lambda p: kernels.rotate_by(p, 12.0),
    "warp": lambda p: kernels.warp(p, lambda f: np.array([[1.01, 0.02, 0.3 * (f % 3)], [-0.02, 1.01, 0.2], [0, 0, 1.0]])),
    "wavescale": lambda p: kernels.hdr_wavescale(p),
}.items():
    query(_name)(lambda spark, d, m=_make: rounded(m(views.px(spark, d)), "v"))
for _name, _make in {"debayer_vng": kernels.demosaic_vng, "debayer_ratio": kernels.demosaic_ratio}.items():
    query(_name)(lambda spark, d, m=_make: rounded(m(views.px(spark, d), "RGGB"), *"rgb"))


@query("drizzle", f"""WITH {PX}, q AS (SELECT (x + 0.5::DOUBLE + (frame_id % 5) / 5.0::DOUBLE) * 2 AS cx, (y + 0.5::DOUBLE + (frame_id % 3) / 3.0::DOUBLE) * 2 AS cy, c, v FROM px WHERE v <> 0),
o AS (SELECT CAST(floor(cx - 0.7::DOUBLE) + i AS INTEGER) AS x, CAST(floor(cy - 0.7::DOUBLE) + j AS INTEGER) AS y, c, v, cx, cy FROM q, (SELECT unnest(range(0, 3)) AS i) a, (SELECT unnest(range(0, 3)) AS j) b),
w AS (SELECT x, y, c, v, greatest(0, least(cx + 0.7::DOUBLE, x + 1) - greatest(cx - 0.7::DOUBLE, x)) * greatest(0, least(cy + 0.7::DOUBLE, y + 1) - greatest(cy - 0.7::DOUBLE, y)) AS w FROM o)
SELECT x, y, c, round(sum(w * v) / sum(w), 8) AS v, round(sum(w), 6) AS w FROM w WHERE w > 1e-12 GROUP BY x, y, c HAVING sum(w) > 1e-6""")
def drizzle(spark, d):
    out = kernels.drizzle(views.px(spark, d), 2.0, 0.7, lambda f: ((f % 5) / 5.0, (f % 3) / 3.0))
    return out.where("w > 1.0E-6").select("x", "y", "c", F.round("v", 8).alias("v"), F.round("w", 6).alias("w"))


# ---- calibration ----

@query("flat_norm", f"""WITH {PX}, f AS (SELECT x, y, avg(v) AS v FROM px WHERE label = 2 GROUP BY x, y), m AS (SELECT avg(v) AS m FROM f WHERE x >= 2 AND x < 5 AND y >= 2 AND y < 5)
SELECT x, y, round(v / m, 9) AS v FROM f, m""")
def flat_norm(spark, d):
    f = stacking.stack(views.px(spark, d, 2), "mean", ("x", "y"))
    m = f.where("x >= 2 AND x < 5 AND y >= 2 AND y < 5").agg(F.avg("v").alias("m"))
    return f.crossJoin(F.broadcast(m)).select("x", "y", F.round(F.col("v") / F.col("m"), 9).alias("v"))


@query("calibrate", f"""WITH {PX}, b AS (SELECT x, y, avg(v) AS b FROM px WHERE label = 3 GROUP BY x, y), dk AS (SELECT x, y, avg(v) AS dk FROM px WHERE label = 4 GROUP BY x, y),
f0 AS (SELECT x, y, median(v) AS f FROM px WHERE label = 2 GROUP BY x, y), f AS (SELECT x, y, f / (SELECT avg(f) FROM f0) AS f FROM f0)
SELECT frame_id, x, y, round((v - 0.1::DOUBLE * b - 0.05::DOUBLE * (dk - b) + 0.01::DOUBLE) / CASE WHEN f > 1e-6 THEN f ELSE 1 END, 9) AS v FROM px JOIN b USING (x, y) JOIN dk USING (x, y) JOIN f USING (x, y) WHERE label = 1""")
def calibrate(spark, d):
    """Bias and scaled dark off, pedestal on, divided by the flat: masters are joined on the position."""
    m = lambda label, how, name: stacking.stack(views.px(spark, d, label), how, ("x", "y")).withColumnRenamed("v", name)
    f0 = m(2, "median", "f")
    flat = f0.crossJoin(F.broadcast(f0.agg(F.avg("f").alias("fm")))).select("x", "y", (F.col("f") / F.col("fm")).alias("f"))
    j = views.px(spark, d, 1).join(m(3, "mean", "b"), ["x", "y"]).join(m(4, "mean", "dk"), ["x", "y"]).join(flat, ["x", "y"])
    v = (F.col("v") - 0.1 * F.col("b") - 0.05 * (F.col("dk") - F.col("b")) + 0.01) / F.when(F.col("f") > 1e-6, F.col("f")).otherwise(1.0)
    return j.select("frame_id", "x", "y", F.round(v, 9).alias("v"))


@query("dark_scale", f"""WITH {PX}, l AS (SELECT x, y, avg(v) AS v FROM px WHERE label = 1 GROUP BY x, y), dk AS (SELECT x, y, avg(v) AS d FROM px WHERE label = 4 GROUP BY x, y),
r AS (SELECT k, v - k * d AS r FROM l JOIN dk USING (x, y), (SELECT 2.0::DOUBLE * i / 40 AS k FROM (SELECT unnest(range(0, 41)) AS i))), m AS (SELECT k, median(r) AS m FROM r GROUP BY k),
c AS (SELECT k, median(abs(r - m)) / abs(any_value(m)) AS cost FROM r JOIN m USING (k) WHERE m <> 0 GROUP BY k)
SELECT round(k, 9) AS k, round(cost, 9) AS cost FROM c ORDER BY cost, k LIMIT 1""")
def dark_scale(spark, d):
    mean = lambda label: stacking.stack(views.px(spark, d, label), "mean", ("x", "y"))
    return fitting.dark_scale(mean(1), mean(4)).select(F.round("k", 9).alias("k"), F.round("cost", 9).alias("cost"))


# ---- background, fits, detection ----

def fields(spark, d):
    """All frames: a 128 x 128 mosaic of every 256, numbered by ``frame_id``."""
    k = F.col("frame_id") % 256
    return views.px(spark, d).select(
        F.floor(F.col("frame_id") / 256).cast("long").alias("frame_id"), F.lit(0).alias("c"),
        (F.col("x") + 8 * (k % 16)).cast("int").alias("x"), (F.col("y") + 8 * F.floor(k / 16)).cast("int").alias("y"),
        (F.col("v") + (k % 16) / 100.0).alias("v"))


FIELDS = PX + """, fields AS (SELECT frame_id // 256 AS frame_id, x + 8 * (frame_id % 256 % 16) AS x, y + 8 * (frame_id % 256 // 16) AS y,
  v + (frame_id % 256 % 16) / 100.0::DOUBLE AS v FROM px)"""


@query("bg_samples", f"""WITH {FIELDS}, m AS (SELECT frame_id, median(v) AS m FROM fields GROUP BY frame_id), p AS (SELECT frame_id, x // 8 AS i, y // 8 AS j, median(v) AS v FROM fields GROUP BY 1, 2, 3),
dd AS (SELECT frame_id, median(abs(v - m)) AS d FROM p JOIN m USING (frame_id) GROUP BY frame_id)
SELECT frame_id, i * 8 + 3.5::DOUBLE AS cx, j * 8 + 3.5::DOUBLE AS cy, round(v, 9) AS v FROM p JOIN m USING (frame_id) JOIN dd USING (frame_id) WHERE v > 0 AND v <= m + 1.5::DOUBLE * d""")
def bg_samples(spark, d):
    return fitting.background_samples_by(fields(spark, d), 8, 1.5, ["frame_id"]).withColumn("v", F.round("v", 9))


@query("bg_poly", f"""WITH {FIELDS}, s AS (SELECT frame_id, x // 8 * 8 + 3.5::DOUBLE AS cx, y // 8 * 8 + 3.5::DOUBLE AS cy, median(v) AS v FROM fields GROUP BY 1, 2, 3)
SELECT frame_id, count(*) AS n, round(sum(cx), 6) AS sx, round(sum(cy), 6) AS sy, round(sum(cx * cx), 4) AS sxx, round(sum(cx * cy), 4) AS sxy, round(sum(cx * v), 6) AS sxv FROM s GROUP BY frame_id""")
def bg_poly(spark, d):
    """The sums of the normal equations of each mosaic's first-degree background."""
    s = fitting.background_samples_by(fields(spark, d), 8, 1e9, ["frame_id"])
    t = fitting.polynomial_terms(F.col("cx"), F.col("cy"), 1)
    r = fitting.normal_equations(s, t, F.col("v"), ["frame_id"])
    return r.select("frame_id", F.col("a0_0").cast("long").alias("n"), F.round("a0_1", 6).alias("sx"), F.round("a0_2", 6).alias("sy"), F.round("a1_1", 4).alias("sxx"), F.round("a1_2", 4).alias("sxy"), F.round("b1", 6).alias("sxv"))


@query("bg_removed")
def bg_removed(spark, d):
    img = fields(spark, d)
    samples = fitting.background_samples_by(img, 8, 3.0, ["frame_id"])
    return rounded(fitting.remove_background_by(img, samples, 2, ["frame_id"]), "v")


@query("bg_rbf")
def bg_rbf(spark, d):
    img = fields(spark, d)
    samples = fitting.background_samples_by(img, 32, 1e9, ["frame_id"])
    return rounded(fitting.rbf_background_by(img, samples, "frame_id").withColumn("v", F.col("model")), "v")


@query("affine_fit", f"WITH {views.STARS}, p AS (SELECT x AS xa, y AS ya FROM stars_a) SELECT 1.002::DOUBLE AS a, 0.01::DOUBLE AS b, 3.0::DOUBLE AS c, -0.01::DOUBLE AS d, 0.998::DOUBLE AS e, -2.0::DOUBLE AS f")
def affine_fit(spark, d):
    s = views.stars(spark, d, "a").select(F.col("x").alias("x_a"), F.col("y").alias("y_a"))
    p = s.select("*", (1.002 * F.col("x_a") + 0.01 * F.col("y_a") + 3).alias("x_b"), (-0.01 * F.col("x_a") + 0.998 * F.col("y_a") - 2).alias("y_b"))
    m = fitting.affine(p).ravel()
    return spark.createDataFrame([tuple(round(float(v), 6) for v in m)], "a double, b double, c double, d double, e double, f double")


@query("colour_calibration", f"""WITH {views.CAT}, m AS (SELECT 100 + gmag AS fr, 90 + gmag * 1.1::DOUBLE AS fg, 80 + gmag * 1.3::DOUBLE AS fb, 120 + bp_rp AS er, 100 + bp_rp * 0.5::DOUBLE AS eg, 90 - bp_rp AS eb FROM cat WHERE bp_rp IS NOT NULL),
k AS (SELECT median(er / fr) AS kr, median(eg / fg) AS kg, median(eb / fb) AS kb FROM m)
SELECT round(kr / greatest(kr, kg, kb), 9) AS kr, round(kg / greatest(kr, kg, kb), 9) AS kg, round(kb / greatest(kr, kg, kb), 9) AS kb FROM k""")
def colour_calibration(spark, d):
    c = views.catalog(spark, d).where("bp_rp IS NOT NULL")
    m = c.select((100 + F.col("gmag")).alias("fr"), (90 + F.col("gmag") * 1.1).alias("fg"), (80 + F.col("gmag") * 1.3).alias("fb"),
                 (120 + F.col("bp_rp")).alias("er"), (100 + F.col("bp_rp") * 0.5).alias("eg"), (90 - F.col("bp_rp")).alias("eb"))
    return fitting.colour_calibration(m).select(*[F.round(k, 9).alias(k) for k in ("kr", "kg", "kb")])


@query("colour_model")
def colour_model(spark, d):
    c = views.catalog(spark, d).where("bp_rp IS NOT NULL").select(F.col("bp_rp").alias("x"), (2.0 + 0.7 * F.col("bp_rp") + 0.05 * F.sin(F.col("gmag"))).alias("y"))
    return fitting.colour_models(c)


@query("star_detect")
def star_detect(spark, d):
    """All detections of all mosaics."""
    return fitting.detect(fields(spark, d), 2.0)


@query("psf_fit")
def psf_fit(spark, d):
    w = math.pi / 40
    img = fields(spark, d).withColumn("v", F.col("v") * 0.01 + F.exp(-(F.pow(F.sin(F.col("x") * w), 2) + F.pow(F.sin(F.col("y") * w), 2)) * 60))
    return fitting.psf(img, 4, 6.0)


SIX = "six(k, s) AS (VALUES " + ", ".join(f"({6 * j + i}, {c})" for j, row in enumerate(kernels.SIX) for i, c in enumerate(row)) + "), s6 AS (SELECT px.*, s FROM px JOIN six ON k = (y % 6) * 6 + x % 6)"


@query("debayer_six", f"""WITH {PX}, {SIX}, n AS (SELECT a.frame_id, a.x, a.y, a.v, a.s, """ + ", ".join(f"coalesce(avg(b.v) FILTER (WHERE b.s = {k}), 0) AS {n}" for k, n in ((1, "r"), (0, "g"), (2, "b"))) + """
FROM s6 a JOIN s6 b ON a.frame_id = b.frame_id AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY 1, 2, 3, 4, 5)
SELECT frame_id, x, y, round(CASE WHEN s = 1 THEN v ELSE r END, 9) AS r, round(CASE WHEN s = 0 THEN v ELSE g END, 9) AS g, round(CASE WHEN s = 2 THEN v ELSE b END, 9) AS b FROM n""")
def debayer_six(spark, d):
    return rounded(kernels.demosaic_six(views.px(spark, d)), *"rgb")


@query("six_equalize", f"""WITH {PX}, {SIX}, c0 AS (SELECT frame_id, s, x % 6 AS i, y % 6 AS j, avg(v) AS m FROM s6 GROUP BY 1, 2, 3, 4),
m AS (SELECT frame_id, avg(m) FILTER (WHERE s = 0) AS mg, avg(m) FILTER (WHERE s = 1) AS mr, avg(m) FILTER (WHERE s = 2) AS mb FROM c0 GROUP BY frame_id)
SELECT frame_id, x, y, round(v * CASE WHEN s = 1 AND mr > 1e-9 THEN mg / mr WHEN s = 2 AND mb > 1e-9 THEN mg / mb ELSE 1 END, 9) AS v FROM s6 JOIN m USING (frame_id)""")
def six_equalize(spark, d):
    return rounded(kernels.six_equalize(views.px(spark, d)), "v")


@query("six_repair", f"""WITH {PX}, {SIX}, n AS (SELECT a.frame_id, a.x, a.y, a.v, b.v AS w, row_number() OVER (PARTITION BY a.frame_id, a.x, a.y ORDER BY b.y, b.x) AS k
FROM s6 a JOIN s6 b ON a.frame_id = b.frame_id AND a.s = b.s AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND (a.x <> b.x OR a.y <> b.y) WHERE a.x BETWEEN 3 AND 4 AND a.y BETWEEN 3 AND 4),
m AS (SELECT frame_id, x, y, median(w) AS m FROM n WHERE k <= {kernels.REPAIR_NEIGHBOURS} GROUP BY 1, 2, 3),
s AS (SELECT frame_id, x, y, any_value(m) AS m, greatest(1.4826::DOUBLE * avg(abs(w - m)), 0.000001::DOUBLE) AS s FROM n JOIN m USING (frame_id, x, y) WHERE k <= {kernels.REPAIR_NEIGHBOURS} GROUP BY 1, 2, 3)
SELECT frame_id, x, y, round(CASE WHEN abs(v - m) > 8 * s THEN m ELSE v END, 9) AS v FROM px LEFT JOIN s USING (frame_id, x, y)""")
def six_repair(spark, d):
    return rounded(kernels.six_repair(views.px(spark, d)), "v")
