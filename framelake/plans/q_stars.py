"""Queries of detections, curves, masters' metadata and line repair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import curves, fitting, stars, statistics
from framelake.plans import views
from framelake.plans.q_kernels import FIELDS, fields
from framelake.plans.registry import query

PX, STARS, CAT = views.PX, views.STARS, views.CAT

#: Pseudo profiles from lineitem rows.
PROFILE = {
    "fwhmx": "CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE (l_orderkey % 40) / 10.0E0 - 0.3E0 END", "fwhmy": "(l_partkey % 40) / 10.0E0 - 0.1E0",
    "x0": "CASE WHEN l_suppkey % 31 = 0 THEN NULL ELSE l_quantity END", "y0": "l_quantity + 1.0E0", "mag": "CASE WHEN l_linenumber % 29 = 0 THEN NULL ELSE 10.0E0 + l_tax END",
    "sx": "0.8E0 + (l_suppkey % 10) / 10.0E0", "sy": "1.0E0", "rmse": "l_discount", "a": "0.1E0 + l_tax * 10.0E0", "beta": "1.0E0 + l_discount * 20.0E0",
}
CODE = """CASE WHEN fwhmx IS NULL OR fwhmy IS NULL THEN 'NO_FWHM' WHEN x0 IS NULL OR y0 IS NULL THEN 'NO_POS' WHEN mag IS NULL THEN 'NO_MAG'
WHEN fwhmx <= 0 OR fwhmy <= 0 THEN 'FWHM_NEG' WHEN fwhmy / fwhmx < 0.5 OR fwhmy / fwhmx > 2 THEN 'ROUNDNESS'
WHEN fwhmx > greatest(sx, sy) * 2.3548200450309493::DOUBLE * (1 + 0.5::DOUBLE * ln(greatest(greatest(sx, sy) / 3.0::DOUBLE, 1.001::DOUBLE))) THEN 'FWHM_TOO_LARGE'
WHEN rmse > 0.2::DOUBLE * a AND NOT a > 1 THEN 'RMSE_TOO_LARGE' WHEN beta < 1.5 THEN 'MOFFAT_BETA_TOO_SMALL' ELSE 'OK' END"""


@query("star_reject_codes", "WITH p AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PROFILE.items()) + f" FROM lineitem) SELECT {CODE} AS code, count(*) AS n FROM p GROUP BY 1")
def star_reject_codes(spark, d):
    p = views.table(spark, d, "lineitem").select(*[F.expr(e).alias(n) for n, e in PROFILE.items()])
    return p.select(stars.rejection_code(beta=1.5).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("star_summary", f"""WITH {CAT}, r AS (SELECT id % 7 AS g, gmag, row_number() OVER (PARTITION BY id % 7 ORDER BY gmag) - 1 AS i, count(*) OVER (PARTITION BY id % 7) AS n FROM cat)
SELECT g, count(*) AS n, round(avg(gmag), 9) AS mean, round(stddev_pop(gmag), 9) AS sd, round(max(CASE WHEN i = n // 2 THEN gmag END), 9) AS median FROM r GROUP BY g""")
def star_summary(spark, d):
    c = views.catalog(spark, d).select((F.col("id") % 7).alias("g"), "gmag")
    return stars.summary(c, "gmag", ["g"]).select("g", "n", *[F.round(k, 9).alias(k) for k in ("mean", "sd", "median")])


_FQ = "SELECT id, id % 9 AS frame_id, gmag AS flux, 0.3E0 + (id % 50) / 2.0E0 AS fwhm, 0.02E0 + (id % 10) / 10.0E0 AS roundness FROM cat"


@query("frame_quality", f"""WITH {CAT}, s AS ({_FQ}), n AS (SELECT i AS frame_id, 0.005::DOUBLE * i AS noise FROM (SELECT unnest(range(0, 12)) AS i)),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, id) AS k FROM s),
m AS (SELECT frame_id, count(*) AS n, avg(fwhm) FILTER (WHERE k <= 50 AND fwhm > 0.5 AND fwhm < 20) AS fwhm, avg(roundness) FILTER (WHERE k <= 50 AND fwhm > 0.5 AND fwhm < 20) AS roundness FROM k GROUP BY frame_id),
q AS (SELECT n.frame_id, noise, n, fwhm, roundness, CASE WHEN fwhm IS NULL THEN 99.0::DOUBLE ELSE fwhm / greatest(0.05::DOUBLE, roundness) END AS wfwhm FROM n LEFT JOIN m USING (frame_id))
SELECT frame_id, coalesce(n, 0) AS n, round(coalesce(fwhm, 99), 9) AS fwhm, round(coalesce(roundness, 0), 9) AS roundness, round(wfwhm, 9) AS wfwhm,
round(CASE WHEN fwhm IS NULL THEN 0 ELSE greatest(1, n) / (greatest(0.05::DOUBLE, wfwhm) * greatest(0.01::DOUBLE, noise)) END, 6) AS quality FROM q""")
def frame_quality(spark, d):
    c = views.catalog(spark, d)
    s = c.select("id", (F.col("id") % 9).alias("frame_id"), F.col("gmag").alias("flux"), F.expr("0.3E0 + (id % 50) / 2.0E0").alias("fwhm"), F.expr("0.02E0 + (id % 10) / 10.0E0").alias("roundness"))
    noise = spark.range(12).select(F.col("id").alias("frame_id"), (0.005 * F.col("id")).alias("noise"))
    q = stars.frame_quality(s, noise)
    return q.select("frame_id", "n", *[F.round(k, 9).alias(k) for k in ("fwhm", "roundness", "wfwhm")], F.round("quality", 6).alias("quality"))


@query("mask_star", f"""WITH {STARS}, s AS (SELECT x AS sx, y AS sy, 2.5::DOUBLE * (0.8::DOUBLE + id % 3) AS r FROM stars_a),
a AS (SELECT *, CAST(unnest(range(CAST(ceil(sx - 2 * r) AS BIGINT), CAST(floor(sx + 2 * r) AS BIGINT) + 1)) AS INTEGER) AS x FROM s), g AS (SELECT *, CAST(unnest(range(CAST(ceil(sy - 2 * r) AS BIGINT), CAST(floor(sy + 2 * r) AS BIGINT) + 1)) AS INTEGER) AS y FROM a),
m AS (SELECT x, y, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS d, r FROM g WHERE x BETWEEN 0 AND 1999 AND y BETWEEN 0 AND 1999)
SELECT x, y, round(max(CASE WHEN d < r THEN 1 ELSE 1 - (d - r) / r END), 9) AS m FROM m WHERE d < 2 * r GROUP BY x, y HAVING round(max(CASE WHEN d < r THEN 1 ELSE 1 - (d - r) / r END), 9) > 0""")
def mask_star(spark, d):
    s = views.stars(spark, d, "a").select("x", "y", (0.8 + F.col("id") % 3).alias("radius"))
    return stars.star_mask(s, 2000, 2000).select("x", "y", F.round("m", 9).alias("m")).where("m > 0")


@query("brush_median", f"""WITH {PX}, r AS (SELECT frame_id, median(v) AS fill FROM px WHERE pow(x - 4, 2) + pow(y - 3, 2) > 2.25 AND pow(x - 4, 2) + pow(y - 3, 2) <= 9 GROUP BY frame_id)
SELECT frame_id, x, y, round(CASE WHEN pow(x - 4, 2) + pow(y - 3, 2) <= 2.25 THEN fill ELSE v END, 9) AS v FROM px JOIN r USING (frame_id)""")
def brush_median(spark, d):
    return stars.disc_median(views.px(spark, d), 4.0, 3.0, 1.5).select("frame_id", "x", "y", F.round("v", 9).alias("v"))


@query("bad_lines", f"""WITH {PX}, r AS (SELECT frame_id, c, y, median(v) AS m FROM px GROUP BY 1, 2, 3), f AS (SELECT frame_id, c, median(m) AS mid FROM r GROUP BY 1, 2), g AS (SELECT frame_id, c, any_value(mid) AS mid, median(abs(m - mid)) AS mad FROM r JOIN f USING (frame_id, c) GROUP BY 1, 2)
SELECT frame_id, c, y FROM r JOIN g USING (frame_id, c) WHERE abs(m - mid) > 2.5::DOUBLE * 1.4826::DOUBLE * mad""")
def bad_lines(spark, d):
    return stars.bad_lines(views.px(spark, d), 2.5)


@query("fix_lines")
def fix_lines(spark, d):
    return stars.fix_lines(views.px(spark, d), 2.5).select("frame_id", "x", "y", F.round("v", 9).alias("v"))


@query("plate_solve", "SELECT 1.01::DOUBLE AS a, 0.02::DOUBLE AS b, 12.0::DOUBLE AS c, -0.02::DOUBLE AS d, 1.01::DOUBLE AS e, -7.0::DOUBLE AS f")
def plate_solve(spark, d):
    """An image of catalog stars under a known map; the map is found again."""
    image = views.stars(spark, d, "a").withColumn("flux", F.col("flux") + F.col("id") / 1000.0)
    cat = image.select("id", (1.01 * F.col("x") + 0.02 * F.col("y") + 12).alias("x"), (-0.02 * F.col("x") + 1.01 * F.col("y") - 7).alias("y"), "flux")
    m = stars.match_catalog(image, cat, stars=14, radius=0.0005)
    flat = [round(float(v), 4) + 0.0 for v in (m if m is not None else np.full((2, 3), np.nan)).ravel()]
    return spark.createDataFrame([tuple(flat)], "a double, b double, c double, d double, e double, f double")


@query("ikss_huber")
def ikss_huber(spark, d):
    return statistics.ikss_huber(views.px(spark, d).select("frame_id", "v"), ["frame_id"]).select("frame_id", F.round("location", 9).alias("location"), F.round("scale", 9).alias("scale"))


@query("hampel_mean")
def hampel_mean(spark, d):
    return statistics.hampel_mean(views.depth(spark, d).select("pixel", "v"), ["pixel"]).select("pixel", F.round("mean", 9).alias("mean"))


# ---- curves ----

NAMES = [("Filter R RED",), ("Filter R",), ("SensorBLUE",), ("Sensor",), ("Plain",)]


@query("curve_lookup", """WITH c(name) AS (VALUES ('Filter R RED'), ('Filter R'), ('SensorBLUE'), ('Sensor'), ('Plain')), w(name, channel) AS (VALUES ('Filter R', 'RED'), ('Filter R', 'GREEN'), ('Sensor', 'BLUE'), ('Plain', ''), ('None', 'RED'))
SELECT w.name, channel, coalesce(a.name, b.name, e.name) AS found FROM w LEFT JOIN c a ON channel <> '' AND a.name = w.name || ' ' || channel LEFT JOIN c b ON channel <> '' AND b.name = w.name || channel LEFT JOIN c e ON e.name = w.name""")
def curve_lookup(spark, d):
    c = spark.createDataFrame([(n[0], [1.0], [1.0]) for n in NAMES], "name string, wl array<double>, y array<double>")
    w = spark.createDataFrame([("Filter R", "RED"), ("Filter R", "GREEN"), ("Sensor", "BLUE"), ("Plain", ""), ("None", "RED")], "name string, channel string")
    return curves.find(c, w).select("name", "channel", "found")


@query("synthetic_flux", """WITH g AS (SELECT unnest(range(3000, 11001)) AS w), s AS (SELECT w, 1 + (w - 3000) / 8000.0::DOUBLE AS s FROM g), f AS (SELECT w, 1 - abs(w - 5500) / 500.0::DOUBLE AS f FROM g WHERE w >= 5000 AND w < 6000)
SELECT 'flat' AS source, 'tri' AS filter, round(sum(s * f), 6) AS flux FROM s JOIN f USING (w)""")
def synthetic_flux(spark, d):
    source = spark.createDataFrame([("flat", [3000.0, 11000.0], [1.0, 2.0])], "name string, wl array<double>, y array<double>")
    tri = spark.createDataFrame([("tri", [5000.0, 5500.0, 6000.0], [0.0, 1.0, 0.0])], "name string, wl array<double>, y array<double>")
    return curves.synthetic_flux(source, tri).select("source", "filter", F.round("flux", 6).alias("flux"))


@query("sed_match")
def sed_match(spark, d):
    t = spark.createDataFrame([("G2V",), ("G3V",), ("K5",), ("M",), ("B9III",), ("X1",)], "type string")
    n = spark.createDataFrame([(k,) for k in ("G0V", "G2V", "G2III", "K4V", "K7V", "M0V", "M5V", "B8V", "B5III")], "name string")
    m = curves.sed_matches(t, n)
    return m.select("type", F.concat_ws(",", "found").alias("found"))


@query("type_index", f"WITH {CAT}, t AS (SELECT id, CASE id % 6 WHEN 0 THEN 'o5v' WHEN 1 THEN 'B5III' WHEN 2 THEN 'A3' WHEN 3 THEN 'G2V' WHEN 4 THEN 'M4' ELSE 'zz' END AS t FROM cat) SELECT id, {curves.index_of_type('t')} AS bp_rp FROM t")
def type_index(spark, d):
    t = views.catalog(spark, d).select("id", F.expr("CASE id % 6 WHEN 0 THEN 'o5v' WHEN 1 THEN 'B5III' WHEN 2 THEN 'A3' WHEN 3 THEN 'G2V' WHEN 4 THEN 'M4' ELSE 'zz' END").alias("t"))
    return t.select("id", F.expr(curves.index_of_type("t")).alias("bp_rp"))


@query("sorted_names", "SELECT p_brand, p_name FROM part WHERE p_size > 40 ORDER BY p_brand, p_name")
def sorted_names(spark, d):
    return views.table(spark, d, "part").where("p_size > 40").select("p_brand", "p_name").orderBy("p_brand", "p_name")


# ---- metadata of a stack ----

@query("stack_metadata", """WITH f AS (SELECT event_id AS frame_id, user_id AS grp, event_type AS key, value, ts FROM events),
k AS (SELECT grp, key, arg_min(value, (ts, frame_id)) AS first_value FROM f GROUP BY grp, key), t AS (SELECT grp, count(*) AS stack_count, round(sum(value), 6) AS exposure, min(ts) AS date_obs FROM f GROUP BY grp)
SELECT grp, stack_count, exposure, date_obs, key, round(first_value, 9) AS first_value FROM t JOIN k USING (grp)""")
def stack_metadata(spark, d):
    """Exposures add up, frames are counted, of each header key the first frame's value stays."""
    f = views.table(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("grp"), F.col("event_type").alias("key"), "value", "ts")
    first = F.row_number().over(Window.partitionBy("grp", "key").orderBy("ts", "frame_id"))
    k = f.withColumn("n", first).where("n = 1").select("grp", "key", F.round("value", 9).alias("first_value"))
    t = f.groupBy("grp").agg(F.count("*").alias("stack_count"), F.round(F.sum("value"), 6).alias("exposure"), F.min("ts").alias("date_obs"))
    return t.join(k, "grp").select("grp", "stack_count", "exposure", "date_obs", "key", "first_value")


@query("gradient_fit", f"""WITH {FIELDS} SELECT frame_id, round(regr_slope(v, x), 9) AS gx, round(regr_slope(v, y), 9) AS gy FROM fields GROUP BY frame_id""")
def gradient_fit(spark, d):
    return fields(spark, d).groupBy("frame_id").agg(F.round(F.regr_slope("v", "x"), 9).alias("gx"), F.round(F.regr_slope("v", "y"), 9).alias("gy"))


@query("pattern_detect", f"""WITH {PX}, s AS (SELECT x % 2 AS i, y % 2 AS j, avg(v) AS m FROM px GROUP BY 1, 2), p(name, ri, rj, bi, bj) AS (VALUES ('RGGB', 0, 0, 1, 1), ('BGGR', 1, 1, 0, 0), ('GRBG', 1, 0, 0, 1), ('GBRG', 0, 1, 1, 0)),
g AS (SELECT name, max(m) - min(m) AS score FROM p JOIN s ON NOT (i = ri AND j = rj) AND NOT (i = bi AND j = bj) GROUP BY name) SELECT name, round(score, 9) AS score FROM g""")
def pattern_detect(spark, d):
    """Score of each filter pattern: how far its two greens differ (the least is the likeliest)."""
    s = views.px(spark, d).groupBy((F.col("x") % 2).alias("i"), (F.col("y") % 2).alias("j")).agg(F.avg("v").alias("m"))
    rows = [("RGGB", 0, 0, 1, 1), ("BGGR", 1, 1, 0, 0), ("GRBG", 1, 0, 0, 1), ("GBRG", 0, 1, 1, 0)]
    p = spark.createDataFrame(rows, "name string, ri int, rj int, bi int, bj int")
    green = ~((F.col("i") == F.col("ri")) & (F.col("j") == F.col("rj"))) & ~((F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj")))
    return p.join(F.broadcast(s), green).groupBy("name").agg(F.round(F.max("m") - F.min("m"), 9).alias("score"))


@query("star_white_balance", f"""WITH {views.RGB}, t AS (SELECT img, sum(r) AS fr, sum(g) AS fg, sum(b) AS fb FROM rgb WHERE pow(x - 3.5, 2) + pow(y - 3.5, 2) <= 9 GROUP BY img)
SELECT round(regr_slope(fr, fg), 8) AS kr, round(regr_slope(fb, fg), 8) AS kb FROM t""")
def star_white_balance(spark, d):
    r = views.rgb(spark, d).where("(x - 3.5D) * (x - 3.5D) + (y - 3.5D) * (y - 3.5D) <= 9").groupBy("img").agg(*[F.sum(n).alias("f" + n) for n in "rgb"])
    return r.agg(F.round(F.regr_slope("fr", "fg"), 8).alias("kr"), F.round(F.regr_slope("fb", "fg"), 8).alias("kb"))


@query("colour_surface")
def colour_surface(spark, d):
    img = fields(spark, d)
    samples = fitting.background_samples_by(img, 8, 1e9, ["frame_id"])
    return fitting.remove_background_by(img, samples, 3, ["frame_id"], divide=True).select("frame_id", "x", "y", F.round("v", 8).alias("v"))
