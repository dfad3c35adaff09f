"""Queries of frame aggregation, rejection, normalization, weights and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import rejection, stacking, statistics
from framelake.plans import views
from framelake.plans.registry import query

PX, RGB, DEPTH, FRAMES = views.PX, views.RGB, views.DEPTH, views.FRAMES


def rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---- A: combine ----

for _m, _sql in {
    "mean": "avg(nullif(v, 0))", "median": "median(nullif(v, 0))", "max": "max(v)", "min": "min(v)",
}.items():
    query(f"stack_{_m}", f"WITH {PX} SELECT x, y, c, round({_sql}, 9) AS v FROM px GROUP BY x, y, c")(
        lambda spark, d, m=_m: rounded(stacking.stack(views.px(spark, d), m), "v")
    )
    _digits = 12 if _m in ("max", "min") else 9  # quotients of prices can end in a half at the tenth digit
    query(f"depth_{_m}", f"WITH {DEPTH} SELECT pixel, round({_sql}, {_digits}) AS v FROM depth GROUP BY pixel")(
        lambda spark, d, m=_m, n=_digits: rounded(stacking.stack(views.depth(spark, d), m, ("pixel",)), "v", digits=n)
    )


@query("stack_sum", f"""WITH {PX}, s AS (SELECT x, y, c, sum(v) AS s FROM px GROUP BY x, y, c)
SELECT x, y, c, round(s / (SELECT max(s) FROM s), 9) AS v FROM s""")
def stack_sum(spark, d):
    return rounded(stacking.stack(views.px(spark, d), "sum"), "v")


NOISE_WEIGHTS = "w0 AS (SELECT frame_id, 1 / (noise * noise) AS w FROM frames), w AS (SELECT frame_id, w / (SELECT avg(w) FROM w0) AS w FROM w0)"


@query("stack_weighted", f"""WITH {FRAMES}, {NOISE_WEIGHTS}
SELECT x, y, c, round(sum(w * v) / sum(w), 9) AS v FROM px JOIN w USING (frame_id) WHERE v <> 0 GROUP BY x, y, c""")
def stack_weighted(spark, d):
    return rounded(stacking.stack_weighted(views.px(spark, d), stacking.weights(views.frames(spark, d), "noise")), "v")


@query("stack_feather", f"""WITH {PX}, t AS (
  SELECT *, greatest(0, least(1, least(x, y, 7 - x, 7 - y) / 3.0::DOUBLE)) AS t FROM px),
w AS (SELECT *, t * t * (3 - 2 * t) AS w FROM t)
SELECT x, y, c, round(sum(w * v), 9) AS wv, round(sum(w), 9) AS w FROM w GROUP BY x, y, c""")
def stack_feather(spark, d):
    w = stacking.feather(8, 8, 3.0)
    p = views.px(spark, d).withColumn("w", w)
    return p.groupBy("x", "y", "c").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("wv"), F.round(F.sum("w"), 9).alias("w"))


@query("framing_bbox", f"""WITH {FRAMES}, s AS (SELECT (frame_id % 5) - 2 AS sx, (frame_id % 7) - 3 AS sy FROM frames)
SELECT min(sx) AS x0, min(sy) AS y0, max(sx + 8) AS x1, max(sy + 8) AS y1 FROM s""")
def framing_bbox(spark, d):
    f = views.table(spark, d, "embeddings")
    sx, sy = F.col("vec_id") % 5 - 2, F.col("vec_id") % 7 - 3
    return f.agg(F.min(sx).alias("x0"), F.min(sy).alias("y0"), F.max(sx + 8).alias("x1"), F.max(sy + 8).alias("y1"))


@query("fast_drizzle", f"""WITH {PX}
SELECT CAST(floor((x + 0.5::DOUBLE + (frame_id % 5) / 5.0::DOUBLE) * 2.0::DOUBLE) AS INTEGER) AS ox,
       CAST(floor((y + 0.5::DOUBLE + (frame_id % 3) / 3.0::DOUBLE) * 2.0::DOUBLE) AS INTEGER) AS oy, c,
       round(avg(v), 9) AS v, count(*) AS n
FROM px WHERE v <> 0 GROUP BY 1, 2, 3""")
def fast_drizzle(spark, d):
    out = stacking.fast_drizzle(views.px(spark, d), 2.0, (F.col("frame_id") % 5) / 5.0, (F.col("frame_id") % 3) / 3.0)
    return rounded(out, "v")


@query("output_normalize", f"""WITH {PX}, s AS (SELECT x, y, c, avg(nullif(v, 0)) AS v FROM px GROUP BY x, y, c),
e AS (SELECT min(nullif(v, 0)) AS lo, max(nullif(v, 0)) AS hi FROM s)
SELECT x, y, c, round(CASE WHEN v = 0 THEN 0 WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END, 9) AS v FROM s, e""")
def output_normalize(spark, d):
    return rounded(stacking.output_normalize(stacking.stack(views.px(spark, d), "mean")), "v")


@query("equalize_rgb", f"""WITH {RGB}, m AS (SELECT median(nullif(r, 0)) AS mr, median(nullif(g, 0)) AS mg, median(nullif(b, 0)) AS mb FROM rgb)
SELECT img, x, y, round(CASE WHEN mr > 0 THEN r * mg / mr ELSE r END, 9) AS r, round(g, 9) AS g,
       round(CASE WHEN mb > 0 THEN b * mg / mb ELSE b END, 9) AS b FROM rgb, m""")
def equalize_rgb(spark, d):
    return rounded(stacking.equalize_rgb(views.rgb(spark, d)), "r", "g", "b")


@query("rejection_map", f"""WITH {PX}, s AS (SELECT x, y, c, median(v) AS m, stddev_samp(v) AS s FROM px GROUP BY x, y, c)
SELECT x, y, c, count(*) FILTER (WHERE m - v > 2 * s) AS n_low, count(*) FILTER (WHERE v - m > 2 * s) AS n_high
FROM px JOIN s USING (x, y, c) GROUP BY x, y, c""")
def rejection_map(spark, d):
    return stacking.rejection_map(views.px(spark, d))


@query("master_stats", f"""WITH {PX}, s AS (SELECT label, x, y, avg(nullif(v, 0)) AS v FROM px GROUP BY label, x, y)
SELECT label, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(stddev_samp(v), 9) AS sigma, round(min(v), 9) AS lo, round(max(v), 9) AS hi
FROM s GROUP BY label""")
def master_stats(spark, d):
    s = stacking.stack(views.px(spark, d), "mean", ("label", "x", "y"))
    out = s.groupBy("label").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("sigma"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return rounded(out, "mean", "median", "sigma", "lo", "hi")


# ---- R: rejection ----

MODZ = """m AS (SELECT {k}, median(v) AS m, count(*) AS n FROM {t} WHERE v <> 0 GROUP BY {k}),
d AS (SELECT {k}, median(abs(v - m)) AS mad FROM {t} JOIN m USING ({k}) WHERE v <> 0 GROUP BY {k}),
k AS (SELECT {t}.*, n, n < 3 OR abs(v - m) <= 3.5::DOUBLE * mad / 0.6745::DOUBLE AS keep FROM {t} JOIN m USING ({k}) JOIN d USING ({k}) WHERE v <> 0)
SELECT {k}, round(avg(v) FILTER (WHERE keep), 9) AS v, CAST(count(*) FILTER (WHERE NOT keep) AS INTEGER) AS n_rejected FROM k GROUP BY {k}"""
PERC = """m AS (SELECT {k}, median(v) AS m, count(*) AS n FROM {t} WHERE v <> 0 GROUP BY {k}),
k AS (SELECT {t}.*, n < 3 OR m = 0 OR NOT (m - v > 0.2::DOUBLE * m OR v - m > 0.1::DOUBLE * m) AS keep FROM {t} JOIN m USING ({k}) WHERE v <> 0)
SELECT {k}, round(avg(v) FILTER (WHERE keep), 9) AS v, CAST(count(*) FILTER (WHERE NOT keep) AS INTEGER) AS n_rejected FROM k GROUP BY {k}"""


#: Passes in the SQL that checks the iterative rules; the rules themselves go on until nothing changes.
SQL_PASSES = 40


def passes_sql(t: str, k: str, spread: str, low: float, high: float, passes: int = SQL_PASSES) -> str:
    """Unrolled passes of a symmetric rule; ``spread`` is sd or mad. Passes after the last that rejects change nothing."""
    parts = [f"p0 AS (SELECT {k}, frame_id, v FROM {t} WHERE v <> 0)"]
    for i in range(passes):
        p, mad = f"p{i}", ""
        parts.append(f"m{i} AS (SELECT {k}, median(v) AS m, coalesce(stddev_samp(v), 0) AS sd, count(*) AS n FROM {p} GROUP BY {k})")
        parts.append(f"a{i} AS (SELECT {k}, median(abs(v - m)) AS mad FROM {p} JOIN m{i} USING ({k}) GROUP BY {k})")
        parts.append(
            f"o{i} AS (SELECT {p}.*, n, (m - v > {low}::DOUBLE * {spread}) OR (v - m > {high}::DOUBLE * {spread}) AS bad "
            f"FROM {p} JOIN m{i} USING ({k}) JOIN a{i} USING ({k}))")
        parts.append(f"c{i} AS (SELECT {k}, count(*) FILTER (WHERE NOT bad) AS good FROM o{i} GROUP BY {k})")
        parts.append(f"p{i + 1} AS (SELECT {k}, frame_id, v FROM o{i} JOIN c{i} USING ({k}) WHERE NOT bad OR good < 3 OR n < 3)")
    last = f"p{passes}"
    return ",\n".join(parts) + f"""
SELECT {k}, round(f.v, 9) AS v, CAST(a.n - f.n AS INTEGER) AS n_rejected
FROM (SELECT {k}, avg(v) AS v, count(*) AS n FROM {last} GROUP BY {k}) f JOIN (SELECT {k}, count(*) AS n FROM p0 GROUP BY {k}) a USING ({k})"""


def sigmedian_sql(t: str, k: str, passes: int = SQL_PASSES) -> str:
    parts = [f"p0 AS (SELECT {k}, frame_id, v FROM {t} WHERE v <> 0)"]
    for i in range(passes):
        parts.append(f"m{i} AS (SELECT {k}, median(v) AS m, coalesce(stddev_samp(v), 0) AS sd, count(*) AS n FROM p{i} GROUP BY {k})")
        parts.append(f"p{i + 1} AS (SELECT {k}, frame_id, CASE WHEN n >= 3 AND (m - v > 2::DOUBLE * sd OR v - m > 2::DOUBLE * sd) THEN m ELSE v END AS v FROM p{i} JOIN m{i} USING ({k}))")
    return ",\n".join(parts) + f"\nSELECT {k}, round(avg(v), 9) AS v, 0 AS n_rejected FROM p{passes} GROUP BY {k}"


PIXEL = "x, y, c"
_RULES = {
    "modz": ({}, lambda t, k: MODZ.format(t=t, k=k)),
    "percentile": ({"low": 0.2, "high": 0.1}, lambda t, k: PERC.format(t=t, k=k)),
    "sigma": ({"low": 2.0, "high": 2.0}, lambda t, k: passes_sql(t, k, "sd", 2.0, 2.0)),
    "mad": ({"low": 3.0, "high": 3.0}, lambda t, k: passes_sql(t, k, "mad", 3.0, 3.0)),
    "sigmedian": ({"low": 2.0, "high": 2.0}, lambda t, k: sigmedian_sql(t, k)),
    "winsorized": ({}, None), "linear": ({}, None), "gesd": ({}, None), "biweight": ({}, None),
}
for _rule, (_opts, _make) in _RULES.items():
    query(f"reject_{_rule}", _make and f"WITH {PX}, " + _make("px", PIXEL))(
        lambda spark, d, r=_rule, o=_opts: rounded(stacking.stack_rejected(views.px(spark, d), r, **o), "v")
    )
    if _rule in ("modz", "percentile", "winsorized"):
        query(f"depth_reject_{_rule}", _make and f"WITH {DEPTH}, " + _make("depth", "pixel"))(
            lambda spark, d, r=_rule, o=_opts: rounded(stacking.stack_rejected(views.depth(spark, d), r, ("pixel",), **o), "v")
        )


@query("reject_linked_rgb")
def reject_linked_rgb(spark, d):
    p = views.rgb(spark, d)
    lists = p.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("img", "r", "g", "b"))).alias("s"))
    three = F.array(*[F.col(f"s.{n}") for n in "rgb"])
    done = rejection.reject(lists.select("x", "y", three.alias("values")), "sigma", ["x", "y"], linked=True, low=2.0, high=2.0)
    out = done
    for k, n in enumerate("rgb"):
        out = out.withColumn(n, F.filter(F.zip_with(F.get("values", F.lit(k)), "kept", lambda v, g: F.when(g, v)), lambda v: v.isNotNull()))
        out = out.withColumn(n, F.round(stacking.mean_of(n), 9))
    return out.select("x", "y", "r", "g", "b", F.size(F.filter("kept", lambda g: ~g)).alias("n_rejected"))


# ---- N: normalization ----

EST = """loc AS (SELECT frame_id, c, median(v) AS location FROM px WHERE v <> 0 GROUP BY frame_id, c),
est AS (SELECT frame_id, c, any_value(location) AS location, 1.5::DOUBLE * median(abs(v - location)) AS scale
        FROM px JOIN loc USING (frame_id, c) WHERE v <> 0 GROUP BY frame_id, c),
ref AS (SELECT c, location AS l0, scale AS s0 FROM est WHERE frame_id = 0),
co AS (SELECT frame_id, c, CASE WHEN scale <> 0 THEN s0 / scale ELSE 1 END AS s, CASE WHEN location <> 0 THEN l0 / location ELSE 1 END AS m, location, l0 FROM est JOIN ref USING (c))"""
for _mode, _expr in {
    "additive": "v - (location - l0)", "multiplicative": "v * m", "addscale": "v * s - (s * location - l0)", "mulscale": "v * s * m",
}.items():
    query(f"norm_{_mode}", f"""WITH {PX}, {EST}
SELECT x, y, c, round(avg({_expr}), 9) AS mean, round(max({_expr}), 9) AS top FROM px JOIN co USING (frame_id, c) WHERE v <> 0 GROUP BY x, y, c""")(
        lambda spark, d, m=_mode: stacking.normalize(
            views.px(spark, d), stacking.coefficients(stacking.estimators(views.px(spark, d)), 0, m), m)
        .where("v != 0").groupBy("x", "y", "c").agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.max("v"), 9).alias("top"))
    )


@query("norm_overlap", f"""WITH {PX}, a AS (SELECT frame_id, x, y, v FROM px),
o AS (SELECT r.frame_id, r.v AS v, q.v AS v0 FROM a r JOIN a q ON q.frame_id = 0 AND q.x = r.x + (r.frame_id % 3) AND q.y = r.y + (r.frame_id % 2) WHERE r.v <> 0 AND q.v <> 0)
SELECT frame_id, count(*) AS n, round(median(v) - median(v0), 9) AS off FROM o GROUP BY frame_id HAVING count(*) >= 3""")
def norm_overlap(spark, d):
    """Offset of each frame against frame 0 where they overlap."""
    a = views.px(spark, d).where("v != 0")
    ref = a.where("frame_id = 0").select("x", "y", F.col("v").alias("v0"))
    moved = a.select("frame_id", (F.col("x") + F.col("frame_id") % 3).cast("int").alias("x"), (F.col("y") + F.col("frame_id") % 2).cast("int").alias("y"), "v")
    o = moved.join(ref, ["x", "y"]).groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.median("v") - F.median("v0"), 9).alias("off"))
    return o.where("n >= 3")


# ---- W, F: weights and frame filters ----

_W = {
    "fwhm": """e AS (SELECT min(fwhm) AS lo, max(fwhm) AS hi FROM frames WHERE fwhm > 0),
w0 AS (SELECT frame_id, CASE WHEN fwhm <= 0 THEN 0 WHEN hi <= lo THEN 1 ELSE (1 / (fwhm * fwhm) - 1 / (hi * hi)) / (1 / (lo * lo) - 1 / (hi * hi)) END AS w FROM frames, e)""",
    "stars": """e AS (SELECT min(stars) AS lo, max(stars) AS hi FROM frames),
w0 AS (SELECT frame_id, CASE WHEN hi > lo THEN pow((stars - lo) / (hi - lo)::DOUBLE, 2) ELSE 1 END AS w FROM frames, e)""",
    "noise": "w0 AS (SELECT frame_id, CASE WHEN noise > 0 THEN 1 / (noise * noise) ELSE 1 END AS w FROM frames)",
    "roundness": "w0 AS (SELECT frame_id, greatest(0.1::DOUBLE, roundness) AS w FROM frames)",
    "quality": "w0 AS (SELECT frame_id, greatest(0.01::DOUBLE, quality) AS w FROM frames)",
}
for _k, _sql in _W.items():
    query(f"weight_{_k}", f"WITH {FRAMES}, {_sql} SELECT frame_id, round(w / (SELECT avg(w) FROM w0), 7) AS w FROM w0")(
        lambda spark, d, k=_k: rounded(stacking.weights(views.frames(spark, d), k), "w", digits=7)
    )


@query("best_reference", f"WITH {FRAMES} SELECT frame_id, round(quality, 9) AS quality FROM frames ORDER BY quality DESC, frame_id LIMIT 1")
def best_reference(spark, d):
    return rounded(stacking.best_reference(views.frames(spark, d)), "quality")


for _metric, _low in (("fwhm", True), ("background", True), ("roundness", False), ("quality", False)):
    _known = f"{_metric} {'>=' if _metric == 'roundness' else '>'} 0"
    _idx = "least(floor(n * 30.0::DOUBLE / 100), n - 1)" if _low else "floor(n * 70.0::DOUBLE / 100)"
    _cmp = f"{_metric} {'<=' if _low else '>='} t" + (" AND fwhm > 0" if _metric == "fwhm" else "")
    query(f"filter_percent_{_metric}", f"""WITH {FRAMES}, k AS (SELECT {_metric} AS m, row_number() OVER (ORDER BY {_metric}) - 1 AS i, count(*) OVER () AS n FROM frames WHERE {_known}),
t AS (SELECT m AS t FROM k WHERE i = {_idx}) SELECT frame_id, round({_metric}, 9) AS {_metric} FROM frames, t WHERE {_cmp}""")(
        lambda spark, d, m=_metric: rounded(stacking.filter_frames(
            f := views.frames(spark, d), m, stacking.percent_threshold(f, m, 30.0)).select("frame_id", m), m)
    )
    _sign = "+" if _low else "-"
    query(f"filter_ksigma_{_metric}", f"""WITH {FRAMES}, t AS (SELECT avg({_metric}) {_sign} 1.5::DOUBLE * stddev_pop({_metric}) AS t FROM frames WHERE {_known})
SELECT frame_id, round({_metric}, 9) AS {_metric} FROM frames, t WHERE {_cmp}""")(
        lambda spark, d, m=_metric: rounded(stacking.filter_frames(
            f := views.frames(spark, d), m, stacking.sigma_threshold(f, m, 1.5)).select("frame_id", m), m)
    )


@query("filter_best_n", f"""WITH {FRAMES}, k AS (SELECT frame_id, fwhm, row_number() OVER (ORDER BY fwhm, frame_id) AS i, count(*) OVER () AS n FROM frames WHERE fwhm > 0)
SELECT frame_id, round(fwhm, 9) AS fwhm FROM k WHERE i <= greatest(1, floor(n * 25.0::DOUBLE / 100))""")
def filter_best_n(spark, d):
    f = views.frames(spark, d).where("fwhm > 0")
    n = max(1, f.count() * 25 // 100)
    return rounded(f.orderBy("fwhm", "frame_id").limit(n).select("frame_id", "fwhm"), "fwhm")


@query("filter_deselect", f"""WITH {FRAMES} SELECT frame_id, NOT (fwhm > 0 AND fwhm > 2.0::DOUBLE) AND NOT (roundness > 0 AND roundness < 0.7::DOUBLE) AS selected FROM frames""")
def filter_deselect(spark, d):
    return views.frames(spark, d).select("frame_id", (~((F.col("fwhm") > 0) & (F.col("fwhm") > 2.0)) & ~((F.col("roundness") > 0) & (F.col("roundness") < 0.7))).alias("selected"))


# ---- T: statistics ----

@query("stat_basic", f"WITH {PX} SELECT label, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(min(v), 9) AS lo, round(max(v), 9) AS hi FROM px GROUP BY label")
def stat_basic(spark, d):
    return rounded(statistics.by_group(views.px(spark, d), ["label"], F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")), "mean", "sd", "lo", "hi")


@query("stat_median_mad", f"""WITH {PX}, m AS (SELECT label, median(v) AS median FROM px GROUP BY label)
SELECT label, round(any_value(median), 9) AS median, round(median(abs(v - median)), 9) AS mad FROM px JOIN m USING (label) GROUP BY label""")
def stat_median_mad(spark, d):
    return rounded(statistics.mad(views.px(spark, d), ["label"]), "median", "mad")


@query("stat_mean_deviation", f"""WITH {PX}, m AS (SELECT label, avg(v) AS m FROM px GROUP BY label)
SELECT label, round(avg(abs(v - m)), 9) AS dev FROM px JOIN m USING (label) GROUP BY label""")
def stat_mean_deviation(spark, d):
    p = views.px(spark, d)
    m = p.groupBy("label").agg(F.avg("v").alias("m"))
    return p.join(F.broadcast(m), "label").groupBy("label").agg(F.round(F.avg(F.abs(F.col("v") - F.col("m"))), 9).alias("dev"))


@query("stat_upper_median", f"WITH {PX}, r AS (SELECT frame_id, v, row_number() OVER (PARTITION BY frame_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM px) SELECT frame_id, round(v, 9) AS v FROM r WHERE i = n // 2")
def stat_upper_median(spark, d):
    return rounded(views.px(spark, d).groupBy("frame_id").agg(statistics.upper_median(F.col("v")).alias("v")), "v")


@query("stat_percentiles", f"WITH {PX} SELECT label, " + ", ".join(f"round(quantile_cont(v, {p}), 9) AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.95)) + " FROM px GROUP BY label")
def stat_percentiles(spark, d):
    return views.px(spark, d).groupBy("label").agg(*[F.round(F.percentile("v", p), 9).alias(f"p{int(p * 100)}") for p in (0.05, 0.25, 0.5, 0.95)])


def _noise_sql() -> str:
    parts = ["d0 AS (SELECT frame_id, y, d FROM (SELECT frame_id, y, v, lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) AS nx, nx - v AS d FROM px) WHERE v <> 0 AND nx <> 0)"]
    for i in range(3):
        parts.append(f"d{i + 1} AS (SELECT frame_id, y, d FROM (SELECT *, avg(d) OVER (PARTITION BY frame_id, y) AS m, stddev_samp(d) OVER (PARTITION BY frame_id, y) AS s FROM d{i}) WHERE s IS NULL OR abs(d - m) <= 5 * s)")
    return ",\n".join(parts) + """,
r AS (SELECT frame_id, stddev_samp(d) AS s FROM d3 GROUP BY frame_id, y),
o AS (SELECT frame_id, s, row_number() OVER (PARTITION BY frame_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM r WHERE s IS NOT NULL)
SELECT frame_id, round(0.7071::DOUBLE * s, 9) AS noise FROM o WHERE i = n // 2"""


@query("stat_noise", f"WITH {PX}, " + _noise_sql())
def stat_noise(spark, d):
    return rounded(statistics.row_noise(views.px(spark, d)), "noise")


@query("stat_histogram", f"WITH {PX} SELECT c, CAST(floor(greatest(0, least(1, v)) * 255 + 0.5::DOUBLE) AS INTEGER) AS bin, count(*) AS n FROM px GROUP BY 1, 2")
def stat_histogram(spark, d):
    return statistics.histogram(views.px(spark, d), 256)


@query("stat_clipping", f"WITH {RGB} SELECT " + ", ".join(f"count(*) FILTER (WHERE {n} <= 0) AS low_{n}, count(*) FILTER (WHERE {n} >= 1) AS high_{n}" for n in "rgb") + " FROM rgb")
def stat_clipping(spark, d):
    return views.rgb(spark, d).agg(*[x for n in "rgb" for x in (F.count_if(F.col(n) <= 0).alias(f"low_{n}"), F.count_if(F.col(n) >= 1).alias(f"high_{n}"))])


@query("stat_area", f"WITH {RGB} SELECT img, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM rgb WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6 GROUP BY img")
def stat_area(spark, d):
    return rounded(views.rgb(spark, d).where("x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6").groupBy("img").agg(*[F.avg(n).alias(n) for n in "rgb"]), *"rgb")


@query("stat_robust_median", f"""WITH {PX}, m AS (SELECT label, median(v) AS m FROM px GROUP BY label),
s AS (SELECT label, any_value(m) AS m, 1.4826::DOUBLE * median(abs(v - m)) AS s FROM px JOIN m USING (label) GROUP BY label)
SELECT label, round(median(v), 9) AS v FROM px JOIN s USING (label) WHERE v >= m - 2 * s AND v <= m + 1.5::DOUBLE * s GROUP BY label""")
def stat_robust_median(spark, d):
    p = views.px(spark, d)
    s = statistics.mad(p, ["label"]).withColumn("s", 1.4826 * F.col("mad"))
    j = p.join(F.broadcast(s), "label").where("v >= median - 2 * s AND v <= median + 1.5D * s")
    return j.groupBy("label").agg(F.round(F.median("v"), 9).alias("v"))


@query("stat_robust_sigma", f"""WITH {PX}, r AS (SELECT frame_id, v, row_number() OVER (PARTITION BY frame_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM px),
m AS (SELECT frame_id, v AS m FROM r WHERE i = n // 2), a AS (SELECT frame_id, v, abs(v - m) AS d FROM px JOIN m USING (frame_id)),
o AS (SELECT frame_id, d, row_number() OVER (PARTITION BY frame_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n, stddev_pop(v) OVER (PARTITION BY frame_id) AS s FROM a)
SELECT frame_id, round(CASE WHEN d > 0 THEN 1.4826::DOUBLE * d WHEN s > 0 THEN s ELSE 0.000001::DOUBLE END, 9) AS sigma FROM o WHERE i = n // 2""")
def stat_robust_sigma(spark, d):
    return rounded(statistics.robust_sigma(views.px(spark, d).select("frame_id", "v"), ["frame_id"]), "sigma")


@query("stat_lower_half", f"""WITH {PX}, m AS (SELECT label, median(v) AS m FROM px GROUP BY label),
l AS (SELECT label, v FROM px JOIN m USING (label) WHERE v <= m), lm AS (SELECT label, median(v) AS lm FROM l GROUP BY label)
SELECT label, round(1.4826::DOUBLE * median(abs(v - lm)), 9) AS sigma FROM l JOIN lm USING (label) GROUP BY label""")
def stat_lower_half(spark, d):
    p = views.px(spark, d)
    low = p.join(F.broadcast(p.groupBy("label").agg(F.median("v").alias("m"))), "label").where("v <= m").select("label", "v")
    return statistics.mad(low, ["label"]).select("label", F.round(1.4826 * F.col("mad"), 9).alias("sigma"))


@query("stat_linfit", f"WITH {DEPTH} SELECT round(regr_slope(v, frame_id % 1000), 8) AS slope, round(regr_intercept(v, frame_id % 1000), 8) AS intercept FROM depth")
def stat_linfit(spark, d):
    x = F.col("frame_id") % 1000
    return views.depth(spark, d).agg(F.round(F.regr_slope("v", x), 8).alias("slope"), F.round(F.regr_intercept("v", x), 8).alias("intercept"))


@query("stat_grid_sigma", f"""WITH {PX}, g AS (SELECT label, v FROM px WHERE x % 4 = 0 AND y % 4 = 0),
r AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM g), m AS (SELECT label, v AS m FROM r WHERE i = n // 2),
a AS (SELECT label, abs(v - m) AS a FROM g JOIN m USING (label)), ar AS (SELECT label, a, row_number() OVER (PARTITION BY label ORDER BY a) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM a)
SELECT label, round(1.4826::DOUBLE * a, 9) AS sigma FROM ar WHERE i = n // 2""")
def stat_grid_sigma(spark, d):
    g = views.px(spark, d).where("x % 4 = 0 AND y % 4 = 0")
    m = g.groupBy("label").agg(statistics.upper_median(F.col("v")).alias("m"))
    return g.join(F.broadcast(m), "label").groupBy("label").agg(F.round(1.4826 * statistics.upper_median(F.abs(F.col("v") - F.col("m"))), 9).alias("sigma"))


@query("stat_minmaxmean", f"WITH {PX} SELECT round(least(1, min(v)), 9) AS lo, round(greatest(0, max(v)), 9) AS hi, round(avg(v), 9) AS mean FROM px")
def stat_minmaxmean(spark, d):
    return views.px(spark, d).agg(F.round(F.least(F.lit(1.0), F.min("v")), 9).alias("lo"), F.round(F.greatest(F.lit(0.0), F.max("v")), 9).alias("hi"), F.round(F.avg("v"), 9).alias("mean"))


@query("ikss_lite", f"""WITH {PX}, m AS (SELECT frame_id, median(v) AS m FROM px GROUP BY frame_id),
a AS (SELECT frame_id, any_value(m) AS m, median(abs(v - m)) AS mad FROM px JOIN m USING (frame_id) GROUP BY frame_id),
n AS (SELECT frame_id, v FROM px JOIN a USING (frame_id) WHERE mad > 0 AND abs(v - m) <= 6 * mad),
m2 AS (SELECT frame_id, median(v) AS m FROM n GROUP BY frame_id),
a2 AS (SELECT frame_id, any_value(m) AS m, median(abs(v - m)) AS mad FROM n JOIN m2 USING (frame_id) GROUP BY frame_id),
u AS (SELECT frame_id, m, v, pow((v - m) / (9 * mad), 2) AS u2 FROM n JOIN a2 USING (frame_id) WHERE mad > 0)
SELECT frame_id, round(any_value(m), 9) AS location,
  round(0.991::DOUBLE * sqrt(count(*) * sum(pow(v - m, 2) * pow(1 - u2, 4))) / abs(sum((1 - u2) * (1 - 5 * u2))), 9) AS scale
FROM u WHERE u2 < 1 GROUP BY frame_id""")
def ikss_lite(spark, d):
    return rounded(statistics.ikss_lite(views.px(spark, d).select("frame_id", "v"), ["frame_id"]), "location", "scale")


ALL_SAMPLES = "s AS (SELECT pixel, v, row_number() OVER (PARTITION BY pixel ORDER BY frame_id, v) AS xx FROM depth)"


@query("qn_robust_mean", f"""WITH {DEPTH}, {ALL_SAMPLES}, st AS (SELECT pixel, count(*) AS n, median(v) AS m FROM s GROUP BY pixel),
r AS (SELECT pixel, v, row_number() OVER (PARTITION BY pixel ORDER BY v) AS i FROM s),
p AS (SELECT a.pixel, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.pixel ORDER BY abs(a.v - b.v)) AS k FROM r a JOIN r b ON a.pixel = b.pixel AND a.i < b.i),
q AS (SELECT pixel, 2.2219::DOUBLE * d AS qn FROM p JOIN st USING (pixel) WHERE k = (n // 2 + 1) * (n // 2) // 2)
SELECT pixel, round(avg(v), 9) AS mean, count(*) AS n_kept FROM r JOIN st USING (pixel) LEFT JOIN q USING (pixel)
WHERE CASE WHEN n < 5 THEN i - 1 >= floor(n * 0.3::DOUBLE) AND i - 1 < n - floor(n * 0.3::DOUBLE) ELSE abs(v - m) <= 3 * qn END GROUP BY pixel""")
def qn_robust_mean(spark, d):
    return rounded(statistics.qn_robust_means(views.depth(spark, d), ["pixel"]), "mean")


@query("repeated_median", f"""WITH {DEPTH}, {ALL_SAMPLES},
sl AS (SELECT a.pixel, a.xx AS xa, median((b.v - a.v) / (b.xx - a.xx)) AS s FROM s a JOIN s b ON a.pixel = b.pixel AND a.xx <> b.xx GROUP BY a.pixel, a.xx),
m AS (SELECT pixel, median(s) AS slope FROM sl GROUP BY pixel)
SELECT pixel, round(any_value(slope), 9) AS slope, round(median(v - slope * xx), 9) AS intercept FROM s JOIN m USING (pixel) GROUP BY pixel""")
def repeated_median(spark, d):
    return rounded(statistics.repeated_medians(views.depth(spark, d), ["pixel"], "frame_id"), "slope", "intercept")
