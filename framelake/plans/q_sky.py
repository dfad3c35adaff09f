"""Queries of spatial joins, catalog search, coordinates and photometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions.spec import Layer, Transform
from framelake.operators import sky, spatial
from framelake.plans import views
from framelake.plans.registry import query

STARS, CAT, PX = views.STARS, views.CAT, views.PX


@query("star_match_first", f"WITH {STARS} SELECT a.id AS id_a, min(b.id) AS id_b FROM stars_a a JOIN stars_b b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 400 GROUP BY a.id")
def star_match_first(spark, d):
    return spatial.first_match(views.stars(spark, d, "a"), views.stars(spark, d, "b"), 20.0)


@query("nearest_one_to_one", f"""WITH {STARS}, p AS (SELECT a.id AS id_a, b.id AS id_b, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2 FROM stars_a a JOIN stars_b b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 2500),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) = 1)
SELECT id_a, id_b, round(d2, 6) AS d2 FROM n QUALIFY row_number() OVER (PARTITION BY id_b ORDER BY d2, id_a) = 1""")
def nearest_one_to_one(spark, d):
    return spatial.nearest_one_to_one(views.stars(spark, d, "a"), views.stars(spark, d, "b"), 50.0).select("id_a", "id_b", F.round("d2", 6).alias("d2"))


@query("star_assoc_rgb", f"""WITH {STARS}, m1 AS (SELECT a.id, min(b.id) AS id1 FROM stars_a a JOIN stars_b b ON abs(a.x - b.x) < 25 AND abs(a.y - b.y) < 25 GROUP BY a.id),
c AS (SELECT id, y AS x, x AS y FROM stars_b), m2 AS (SELECT a.id, min(c.id) AS id2 FROM stars_a a JOIN c ON abs(a.x - c.x) < 25 AND abs(a.y - c.y) < 25 GROUP BY a.id)
SELECT m1.id AS id0, id1, id2 FROM m1 JOIN m2 USING (id)""")
def star_assoc_rgb(spark, d):
    b = views.stars(spark, d, "b")
    return spatial.associate([views.stars(spark, d, "a"), b, b.select("id", F.col("y").alias("x"), F.col("x").alias("y"), "flux")], 25.0)


def _tri(view: str, name: str) -> str:
    return f"""{name}0 AS (SELECT p.id AS i1, q.id AS i2, r.id AS i3, sqrt(pow(q.x - r.x, 2) + pow(q.y - r.y, 2)) AS s1, sqrt(pow(p.x - r.x, 2) + pow(p.y - r.y, 2)) AS s2, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS s3
FROM {view} p JOIN {view} q ON p.id < q.id JOIN {view} r ON q.id < r.id),
{name}1 AS (SELECT list_sort([{{'len': s1, 'id': i1}}, {{'len': s2, 'id': i2}}, {{'len': s3, 'id': i3}}], 'DESC') AS s FROM {name}0),
{name} AS (SELECT s[1].id AS a, s[2].id AS b, s[3].id AS c, s[2].len / s[1].len AS ba, s[3].len / s[1].len AS ca FROM {name}1 WHERE s[1].len > 0 AND s[2].len / s[1].len <= 0.9::DOUBLE)"""


@query("triangle_votes", f"""WITH {STARS}, ta AS (SELECT id, x, y FROM stars_a ORDER BY flux DESC, id LIMIT 20), tb AS (SELECT id, x * 1.001::DOUBLE + 3 AS x, y * 1.001::DOUBLE - 2 AS y FROM stars_a ORDER BY flux DESC, id LIMIT 24), {_tri('ta', 'l')}, {_tri('tb', 'r')},
h AS (SELECT l.a AS a1, l.b AS b1, l.c AS c1, r.a AS a2, r.b AS b2, r.c AS c2 FROM l JOIN r ON pow(l.ba - r.ba, 2) + pow(l.ca - r.ca, 2) < 0.0004::DOUBLE * 0.0004::DOUBLE)
SELECT left_id, right_id, count(*) AS votes FROM (SELECT a1 AS left_id, a2 AS right_id FROM h UNION ALL SELECT b1, b2 FROM h UNION ALL SELECT c1, c2 FROM h) GROUP BY 1, 2""")
def triangle_votes(spark, d):
    """Votes between the brightest stars of two lists: 20 of one, 24 of the other."""
    s = views.stars(spark, d, "a").orderBy(F.desc("flux"), "id")
    moved = s.limit(24).select("id", (F.col("x") * 1.001 + 3).alias("x"), (F.col("y") * 1.001 - 2).alias("y"))
    return spatial.triangle_votes(s.limit(20).select("id", "x", "y"), moved, 0.0004)


def _field(spark, d):
    """All frames in one mosaic, 256 to a row."""
    row = F.floor(F.col("frame_id") / 256)
    return views.px(spark, d).select((F.col("x") + 8 * (F.col("frame_id") % 256)).cast("int").alias("x"), (F.col("y") + 8 * row).cast("int").alias("y"), "v")


def _spread_stars(spark, d):
    """All stars, spread over the mosaic's height."""
    rows = views.table(spark, d, "embeddings").agg((F.floor(F.max("vec_id") / 256) + 1).alias("rows"))  # one row
    return views.stars(spark, d, "a").crossJoin(F.broadcast(rows)).select("id", "x", (F.col("y") * 8 * F.col("rows") / 2000).alias("y"))


@query("aperture_flux", f"""WITH {PX}, f AS (SELECT x + 8 * (frame_id % 256) AS x, y + 8 * (frame_id // 256) AS y, v FROM px), {STARS},
s AS (SELECT id, x, y * 8 * (SELECT max(vec_id) // 256 + 1 FROM embeddings) / 2000 AS y FROM stars_a)
SELECT id, round(sum(v), 7) AS flux, count(*) AS n FROM s JOIN f ON f.x BETWEEN round(s.x) - 4 AND round(s.x) + 4 AND f.y BETWEEN round(s.y) - 4 AND round(s.y) + 4 AND pow(f.x - s.x, 2) + pow(f.y - s.y, 2) <= 9 GROUP BY id""")
def aperture_flux(spark, d):
    s, field = _spread_stars(spark, d), _field(spark, d)
    return spatial.aperture_sums(s, field, 3.0).select("id", F.round("flux", 7).alias("flux"), "n")


@query("annulus_photometry")
def annulus_photometry(spark, d):
    """Net signals of the stars of ``aperture_flux``: the sky is a robust mean, which has no SQL."""
    s = _spread_stars(spark, d).withColumn("radius", F.lit(4.0))
    found = spatial.annulus_photometry(s, _field(spark, d), 6.0, 10.0)
    return found.select("id", F.round("signal", 7).alias("signal"), F.round("area", 7).alias("area"), F.round("sky", 9).alias("sky"), "n_sky")


@query("dedupe_objects", f"""WITH {CAT} SELECT id FROM cat a WHERE NOT EXISTS (SELECT 1 FROM cat b WHERE b.id < a.id AND abs(a.ra - b.ra) < 3 AND abs(a.dec - b.dec) < 3)""")
def dedupe_objects(spark, d):
    return spatial.dedupe(views.catalog(spark, d).withColumn("ord", F.col("id")), 3.0).select("id")


ANCHORS = [(0.0, 1.0), (0.4, 2.0), (1.1, 1.5), (2.0, 4.0), (3.0, 3.0)]


@query("curve_interp", f"WITH {CAT}, a AS (SELECT * FROM (VALUES " + ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in ANCHORS) + """) t(x, y)),
i AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2, row_number() OVER (ORDER BY x) AS k FROM a)
SELECT id, round(CASE WHEN x2 IS NULL OR bp_rp <= x THEN y ELSE y + (bp_rp - x) * (y2 - y) / (x2 - x) END, 9) AS value FROM cat JOIN i ON (k = 1 OR bp_rp >= x) AND (x2 IS NULL OR bp_rp < x2) WHERE bp_rp IS NOT NULL""")
def curve_interp(spark, d):
    p = views.catalog(spark, d).where("bp_rp IS NOT NULL").select("id", F.col("bp_rp").alias("t"))
    return spatial.interpolate(p, spark.createDataFrame(ANCHORS, "x double, y double")).select("id", F.round("value", 9).alias("value"))


@query("curve_trapezoid", """WITH g AS (SELECT unnest(range(3000, 11001)) AS w), f AS (SELECT w, exp(-pow((w - 5500) / 600.0::DOUBLE, 2)) AS y FROM g)
SELECT round(sum((y + y2) / 2), 6) AS area FROM (SELECT y, lead(y) OVER (ORDER BY w) AS y2 FROM f) WHERE y2 IS NOT NULL""")
def curve_trapezoid(spark, d):
    t = (F.col("w") - 5500) / 600.0
    f = spark.range(3000, 11001).select(F.col("id").alias("w")).withColumn("y", F.exp(-t * t))
    nxt = f.select((F.col("w") - 1).alias("w"), F.col("y").alias("y2"))  # a step of 1: the next sample is an equi-join
    return f.join(nxt, "w").agg(F.round(F.sum((F.col("y") + F.col("y2")) / 2), 6).alias("area"))


@query("comet_shift", """SELECT event_id, round((epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) / 3600e6 * 1.5::DOUBLE, 6) AS dx, round((epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) / 3600e6 * -0.75::DOUBLE, 6) AS dy FROM events""")
def comet_shift(spark, d):
    ev = views.table(spark, d, "events")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ref = ev.agg(F.min("ts").alias("t0"))
    h = (us("ts") - us("t0")) / 3600e6
    return ev.crossJoin(F.broadcast(ref)).select("event_id", F.round(h * 1.5, 6).alias("dx"), F.round(h * -0.75, 6).alias("dy"))


@query("calibrate_lookup", f"""WITH {PX}, m AS (SELECT x, y, c, avg(v) AS d FROM px WHERE label = 0 GROUP BY x, y, c) SELECT frame_id, x, y, round(v - d + 0.1::DOUBLE, 9) AS v FROM px JOIN m USING (x, y, c) WHERE label = 1""")
def calibrate_lookup(spark, d):
    m = views.px(spark, d, 0).groupBy("x", "y", "c").agg(F.avg("v").alias("d"))
    return views.px(spark, d, 1).join(m, ["x", "y", "c"]).select("frame_id", "x", "y", F.round(F.col("v") - F.col("d") + 0.1, 9).alias("v"))


# ---- catalog ----

_SEP = sky.separation("ra", "dec", 120.0, 10.0)


@query("cone_search", f"WITH {CAT} SELECT id, ra, dec, round({_SEP}, 8) AS sep FROM cat WHERE dec BETWEEN -20 AND 40 AND {_SEP} <= 30")
def cone_search(spark, d):
    # the declination band is a range on a stored column; the exact test follows
    c = views.catalog(spark, d).where("dec BETWEEN -20 AND 40").withColumn("sep", F.expr(_SEP))
    return c.where("sep <= 30").select("id", "ra", "dec", F.round("sep", 8).alias("sep"))


@query("catalog_topk", f"WITH {CAT} SELECT id, ra, dec, gmag FROM cat WHERE gmag < 20 AND {_SEP} <= 60 ORDER BY gmag, id LIMIT 50")
def catalog_topk(spark, d):
    return views.catalog(spark, d).where(F.expr(f"gmag < 20 AND {_SEP} <= 60")).orderBy("gmag", "id").limit(50).select("id", "ra", "dec", "gmag")


@query("catalog_region", f"WITH {CAT} SELECT id, ra, dec FROM cat WHERE ra BETWEEN 40 AND 80 AND dec BETWEEN -15 AND 30")
def catalog_region(spark, d):
    return views.catalog(spark, d).where("ra BETWEEN 40 AND 80 AND dec BETWEEN -15 AND 30").select("id", "ra", "dec")


def cat_query(name: str, t: Transform) -> None:
    query(name, t.sql(CAT, "cat", ["id"]))(lambda spark, d: t.apply(views.catalog(spark, d), ["id"], 7))


cat_query("colour_index", Transform((), sky.COLOUR))
cat_query("galaxy_axes", Transform((), sky.GALAXY))
_layers, _limit = sky.magnitude_limit_layers(2.0, 500)
cat_query("magnitude_limit", Transform(tuple(map(Layer, _layers)), {"lim": _limit}))
_layers, _out = sky.blackbody_layers()
cat_query("blackbody", Transform((Layer({"b_v": sky.COLOUR["b_v"]}), *map(Layer, _layers)), _out))
WCS = sky.Wcs(120.0, 20.0, (1000.5, 900.5), ((-0.011, 0.0005), (0.0004, 0.0112)), a={(2, 0): 1e-7, (1, 1): -2e-7}, b={(0, 2): 1.5e-7})
_pix = Layer({"ix": "(id % 2000) * 1.0E0", "iy": "((id * 7) % 1800) * 1.0E0"})
cat_query("wcs_pixel_to_world", Transform((_pix, *map(Layer, WCS.pixel_to_world())), {"ra_out": "ra_out", "dec_out": "dec_out"}))
_near = Layer({"ra0": "ra", "dec0": "dec"})
cat_query("wcs_tan_project", Transform(tuple(map(Layer, sky.tan_project(120.0, 20.0))), {"xi": "xi", "eta": "eta"}))


@query("wcs_roundtrip", f"WITH {CAT} SELECT id, true AS ok FROM cat")
def wcs_roundtrip(spark, d):
    c = views.catalog(spark, d).select("id")
    there = Transform((_pix, *map(Layer, WCS.pixel_to_world())), {"ix": "ix", "iy": "iy", "ra": "ra_out", "dec": "dec_out"}).apply(c, ["id"])
    back = Transform(tuple(map(Layer, WCS.world_to_pixel())), {"ox": "ox", "oy": "oy", "ix": "ix", "iy": "iy"}).apply(there, ["id"])
    return back.select("id", ((F.abs(F.col("ox") - F.col("ix")) < 1e-3) & (F.abs(F.col("oy") - F.col("iy")) < 1e-3)).alias("ok"))


@query("spectral_type", f"WITH {CAT} SELECT id, {sky.spectral_type('bp_rp')} AS type FROM cat")
def spectral_type(spark, d):
    return views.catalog(spark, d).select("id", F.expr(sky.spectral_type("bp_rp")).alias("type"))


@query("catalog_validity", f"WITH {CAT} SELECT count(*) AS n FROM cat WHERE mag_v IS NOT NULL OR teff > 0")
def catalog_validity(spark, d):
    return views.catalog(spark, d).where("mag_v IS NOT NULL OR teff > 0").agg(F.count("*").alias("n"))


_MAG = {"mag": sky.magnitude("flux"), "err": sky.magnitude_error("flux", "50.0E0", "200.0E0", "3.0E0", 1.5)}


@query("photometry", f"WITH {STARS} SELECT id, " + ", ".join(f"round({e}, 9) AS {n}" for n, e in _MAG.items()) + " FROM stars_a")
def photometry(spark, d):
    return views.stars(spark, d, "a").select("id", *[F.round(F.expr(e), 9).alias(n) for n, e in _MAG.items()])


# ---- text: sexagesimal and header values ----

_HMS = "SELECT event_id, CAST(event_id % 24 AS VARCHAR) || ':' || CAST(event_id % 60 AS VARCHAR) || ':' || CAST(event_id % 59 AS VARCHAR) || '.5' AS t FROM events"


def parse_sexagesimal(text):
    """Degrees: h:m:s times 15, a plain number unchanged, anything else null."""
    m = lambda k: F.regexp_extract(text, r"^\s*([+-]?\d+)[:\s](\d+)[:\s]([\d.]+)\s*$", k)
    whole = m(1).try_cast("double")
    value = F.abs(whole) + m(2).try_cast("double") / 60 + m(3).try_cast("double") / 3600
    return F.when(whole.isNotNull(), F.when(F.trim(text).startswith("-"), -value).otherwise(value) * 15).otherwise(F.trim(text).try_cast("double"))


@query("sexagesimal", f"WITH h AS ({_HMS}) SELECT event_id, round((event_id % 24 + (event_id % 60) / 60.0::DOUBLE + (event_id % 59 + 0.5::DOUBLE) / 3600.0::DOUBLE) * 15, 8) AS deg FROM h")
def sexagesimal(spark, d):
    e = views.table(spark, d, "events")
    s = lambda k: (F.col("event_id") % k).cast("string")
    return e.select("event_id", F.round(parse_sexagesimal(F.concat(s(24), F.lit(":"), s(60), F.lit(":"), s(59), F.lit(".5"))), 8).alias("deg"))


def coerce_kind(text):
    """Kind of a header value: bool, string (quoted), int, double, or text."""
    t = F.trim(text)
    return (
        F.when(F.lower(t).isin("t", "true", "f", "false"), "bool")
        .when(t.startswith("'") & t.endswith("'"), "string")
        .when(t.rlike(r"^[+-]?\d+$") & t.try_cast("bigint").isNotNull(), "int")
        .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "double")
        .otherwise("text")
    )


_CARD = "CASE event_id % 6 WHEN 0 THEN 'T' WHEN 1 THEN '''abc ''' WHEN 2 THEN CAST(event_id AS VARCHAR) WHEN 3 THEN '1.5e3' WHEN 4 THEN event_type ELSE ' false ' END"


@query("header_coerce", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'string' WHEN 2 THEN 'int' WHEN 3 THEN 'double' WHEN 4 THEN 'text' ELSE 'bool' END AS kind FROM events")
def header_coerce(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", coerce_kind(F.expr(_CARD.replace("'''abc '''", "\"'abc '\"").replace("VARCHAR", "STRING"))).alias("kind"))


@query("header_dedupe", "SELECT user_id, event_type AS key, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def header_dedupe(spark, d):
    """First card of each key wins."""
    return views.table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.min("event_id").alias("first_id"))


@query("header_search", "SELECT event_id FROM events WHERE contains(lower(event_type), 'click') OR contains(lower(props), 'click')")
def header_search(spark, d):
    return views.table(spark, d, "events").where(F.lower("event_type").contains("click") | F.lower("props").contains("click")).select("event_id")


@query("header_valid_keys", "SELECT c_custkey, regexp_matches(upper(c_name), '^[A-Z0-9_-]{1,8}$') AS ok FROM customer")
def header_valid_keys(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", F.upper("c_name").rlike("^[A-Z0-9_-]{1,8}$").alias("ok"))
