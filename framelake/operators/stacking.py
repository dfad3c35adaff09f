"""N-frame aggregation: combine the samples of aligned frames pixel by pixel.

Sums, means, extremes and medians are plain grouped aggregates, so partial
aggregation runs before the shuffle wherever the function allows it. Rejection
gathers a pixel's samples once and works on the array, so a stack with rejection
shuffles the samples once. A sample of exactly 0 is no data, except for sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rejection

PIXEL = ("x", "y", "c")


def no_data(v: str | Column = "v") -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.when(c != 0, c)


def require_frames(px: DataFrame, least: int = 2) -> None:
    """A stack needs two frames; one short aggregate checks that."""
    if px.select("frame_id").distinct().limit(least).count() < least:
        raise ValueError(f"a stack needs at least {least} frames")


def stack(px: DataFrame, method: str, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """``keys, v``: sum (scaled to a maximum of 1), mean, median, max or min of each pixel."""
    if method == "sum":
        total = px.groupBy(*keys).agg(F.sum("v").alias("s"))
        top = total.agg(F.max("s").alias("top"))
        return total.crossJoin(F.broadcast(top)).select(*keys, F.when(F.col("top") != 0, F.col("s") / F.col("top")).otherwise(F.lit(0.0)).alias("v"))
    fn = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}[method]
    value = F.col("v") if method in ("max", "min") else no_data()
    return px.groupBy(*keys).agg(fn(value).alias("v"))


def stack_weighted(px: DataFrame, weights: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Weighted mean by ``frame_id``; where the weights sum to 0, the plain mean."""
    joined = px.withColumn("v", no_data()).where("v IS NOT NULL").join(weights.select("frame_id", "w"), "frame_id")
    sums = joined.groupBy(*keys).agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"), F.avg("v").alias("m"))
    return sums.select(*keys, F.when(F.col("w") > 0, F.col("wv") / F.when(F.col("w") > 0, F.col("w"))).otherwise(F.col("m")).alias("v"))


def stack_kept(px: DataFrame, rule: str, keys: tuple[str, ...] = PIXEL, **options) -> DataFrame:
    """``keys, v``: mean of the samples that a rule keeps, weighted by column ``w`` of each
    sample; where the weights of what is kept sum to 0, the plain mean."""
    some = px.select(*keys, "frame_id", no_data().alias("v"), F.col("w").cast("double").alias("w")).where("v IS NOT NULL")
    if rule == "none":
        sums = some.groupBy(*keys).agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"), F.avg("v").alias("m"))
        return sums.select(*keys, F.when(F.col("w") > 0, F.col("wv") / F.when(F.col("w") > 0, F.col("w"))).otherwise(F.col("m")).alias("v"))
    lists = some.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame_id", "v", "w"))).alias("s"))
    df = lists.select(*keys, F.transform("s", lambda s: s["v"]).alias("values"), F.transform("s", lambda s: s["w"]).alias("weights"))
    done = rejection.keep_mask(df, rule, [*keys, "weights"], **options)
    one = F.zip_with("values", "weights", lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    kept = F.filter(F.zip_with(one, "kept", lambda p, k: F.when(k, p)), lambda p: p.isNotNull())
    done = done.select(*keys, kept.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, p: a + p["w"])
    weighted = F.aggregate("s", F.lit(0.0), lambda a, p: a + p["w"] * p["v"])
    plain = F.aggregate("s", F.lit(0.0), lambda a, p: a + p["v"]) / F.when(F.size("s") > 0, F.size("s"))
    return done.select(*keys, F.when(total > 0, weighted / F.when(total > 0, total)).otherwise(plain).alias("v"))


def edge_weights(px: DataFrame, distance: float) -> DataFrame:
    """Column ``w`` times the smooth fall-off towards the edges of the sample's own frame, whose
    box is taken from its pixels (one row a frame is joined), so shifted frames fade where they end."""
    box = px.groupBy("frame_id").agg(*[f(k).alias(f"_{n}{k}") for k in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    edge = F.least(F.col("x") - F.col("_lox"), F.col("_hix") - F.col("x"), F.col("y") - F.col("_loy"), F.col("_hiy") - F.col("y"))
    return px.join(box, "frame_id").withColumn("w", F.col("w") * smoothstep(edge / F.lit(float(distance)))).drop("_lox", "_hix", "_loy", "_hiy")


def smoothstep(t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * (3.0 - 2.0 * t)


def feather(width: int, height: int, distance: float) -> Column:
    """Weight by distance to the nearest frame edge."""
    edge = F.least(F.col("x"), F.col("y"), F.lit(width - 1) - F.col("x"), F.lit(height - 1) - F.col("y"))
    return smoothstep(edge / F.lit(float(distance)))


def gathered(px: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """``keys, values``: the samples with data of each pixel, in frame order."""
    some = px.select(*keys, "frame_id", no_data().alias("v")).where("v IS NOT NULL")
    lists = some.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame_id", "v"))).alias("s"))
    return lists.select(*keys, F.transform("s", lambda s: s["v"]).alias("values"))


def survivors(px: DataFrame, rule: str, keys: tuple[str, ...] = PIXEL, **options) -> DataFrame:
    """``keys, n, values``: the samples of each pixel that a rule keeps, and how many there were."""
    df = gathered(px, keys).withColumn("n", F.size("values"))
    if rule == "none":
        return df.select(*keys, "n", "values")
    if rule == "modz":
        return rejection.keep_modified_z(df, "values", **options).select(*keys, "n", "values")
    if rule == "percentile":
        return rejection.keep_percentile(df, "values", **options).select(*keys, "n", "values")
    done = rejection.reject(df, rule, list(keys), **options)
    kept = F.filter(F.zip_with("values", "kept", lambda v, k: F.when(k, v)), lambda v: v.isNotNull())
    return done.select(*keys, F.size("values").alias("n"), kept.alias("values"))


def mean_of(values: str = "values") -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def stack_rejected(px: DataFrame, rule: str, keys: tuple[str, ...] = PIXEL, **options) -> DataFrame:
    """``keys, v, n_rejected``: mean of what the rule keeps."""
    kept = survivors(px, rule, keys, **options)
    return kept.select(*keys, mean_of().alias("v"), (F.col("n") - F.size("values")).alias("n_rejected"))


def rejection_map(px: DataFrame, low: float = 2.0, high: float = 2.0, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """``keys, n_low, n_high``: samples below and above median -+ multiples of the deviation."""
    stats = px.groupBy(*keys).agg(F.median("v").alias("m"), F.stddev_samp("v").alias("s"))
    both = px.join(stats, list(keys))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("m") - F.col("v") > low * F.col("s")).alias("n_low"),
        F.count_if(F.col("v") - F.col("m") > high * F.col("s")).alias("n_high"),
    )


def output_normalize(img: DataFrame) -> DataFrame:
    """(v - min) / (max - min) over values with data; others stay 0."""
    ends = img.agg(F.min(no_data()).alias("lo"), F.max(no_data()).alias("hi"))
    span = F.col("hi") - F.col("lo")
    scaled = F.when(F.col("v") == 0, F.lit(0.0)).when(span > 0, (F.col("v") - F.col("lo")) / span).otherwise(F.col("v"))
    return img.crossJoin(F.broadcast(ends)).withColumn("v", scaled).drop("lo", "hi")


def equalize_rgb(rgb: DataFrame) -> DataFrame:
    """Red and blue scaled so that their medians (over values with data) match green's."""
    m = rgb.agg(*[F.median(no_data(n)).alias(f"m{n}") for n in "rgb"])
    out = rgb.crossJoin(F.broadcast(m))
    for n in "rb":
        out = out.withColumn(n, F.when(F.col(f"m{n}") > 0, F.col(n) * F.col("mg") / F.col(f"m{n}")).otherwise(F.col(n)))
    return out.drop("mr", "mg", "mb")


def fast_drizzle(px: DataFrame, scale: float, dx: Column, dy: Column) -> DataFrame:
    """Each pixel's centre, shifted and scaled, falls into one output cell; cells are averaged."""
    ox = F.floor((F.col("x") + 0.5 + dx) * scale).cast("int").alias("ox")
    oy = F.floor((F.col("y") + 0.5 + dy) * scale).cast("int").alias("oy")
    cells = px.select(ox, oy, "c", no_data().alias("v")).where("v IS NOT NULL")
    return cells.groupBy("ox", "oy", "c").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


# ---- normalization ----

def estimators(px: DataFrame, by: tuple[str, ...] = ("frame_id", "c")) -> DataFrame:
    """``by, location, scale``: median and 1.5 times the median absolute deviation of values with data."""
    some = px.withColumn("v", no_data()).where("v IS NOT NULL")
    loc = some.groupBy(*by).agg(F.median("v").alias("location"))
    dev = some.join(loc, list(by)).groupBy(*by).agg(
        F.first("location").alias("location"), (1.5 * F.median(F.abs(F.col("v") - F.col("location")))).alias("scale"))
    return dev


def coefficients(est: DataFrame, reference: int, mode: str) -> DataFrame:
    """``frame_id, c, s, off, mul`` against a reference frame. Modes: additive,
    multiplicative, addscale, mulscale. A zero denominator gives factor 1."""
    ref = est.where(F.col("frame_id") == reference).select("c", F.col("location").alias("l0"), F.col("scale").alias("s0"))
    e = est.join(F.broadcast(ref), "c")
    one = F.lit(1.0)
    s = F.when(F.col("scale") != 0, F.col("s0") / F.col("scale")).otherwise(one) if "scale" in mode else one
    mul = F.when(F.col("location") != 0, F.col("l0") / F.col("location")).otherwise(one)
    e = e.withColumn("s", s)
    if mode.startswith("add"):
        return e.select("frame_id", "c", "s", (F.col("s") * F.col("location") - F.col("l0")).alias("off"), one.alias("mul"))
    return e.select("frame_id", "c", "s", F.lit(0.0).alias("off"), mul.alias("mul"))


def normalize(px: DataFrame, coef: DataFrame, mode: str) -> DataFrame:
    """Samples with the coefficients applied; values of 0 stay. One row a frame is joined."""
    j = px.join(coef, ["frame_id", "c"])
    changed = F.col("v") * F.col("s") - F.col("off") if mode.startswith("add") else F.col("v") * F.col("s") * F.col("mul")
    return j.withColumn("v", F.when(F.col("v") == 0, F.col("v")).otherwise(changed)).drop("s", "off", "mul")


# ---- weights and frame selection ----

def weights(frames: DataFrame, kind: str) -> DataFrame:
    """``frame_id, w`` with a mean weight of 1. Noise weights take the frame's normalization
    factor from a column ``scale`` if there is one."""
    if kind in ("fwhm", "wfwhm"):
        ends = frames.where("fwhm > 0").agg(F.min("fwhm").alias("lo"), F.max("fwhm").alias("hi"))
        inv = lambda c: 1.0 / (F.col(c) * F.col(c))
        spread = inv("lo") - inv("hi")
        w = F.when(F.col("fwhm") <= 0, 0.0).when(F.col("hi") <= F.col("lo"), 1.0).otherwise(
            (1.0 / F.when(F.col("fwhm") > 0, F.col("fwhm") * F.col("fwhm")) - inv("hi")) / F.when(spread != 0, spread))
        f = frames.crossJoin(F.broadcast(ends))
    elif kind == "stars":
        ends = frames.agg(F.min("stars").alias("lo"), F.max("stars").alias("hi"))
        t = (F.col("stars") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")).cast("double"))
        w = F.coalesce(t * t, F.lit(1.0))
        f = frames.crossJoin(F.broadcast(ends))
    else:
        f = frames
        noise = F.col("noise") * F.col("scale") if "scale" in f.columns else F.col("noise") if "noise" in f.columns else F.lit(0.0)
        w = {
            "noise": F.when(noise > 0, 1.0 / F.when(noise > 0, noise * noise)).otherwise(1.0),
            "roundness": F.greatest(F.lit(0.1), F.col("roundness")),
            "quality": F.greatest(F.lit(0.01), F.col("quality")),
        }[kind]
    raw = f.select("frame_id", w.alias("w"))
    mean = raw.agg(F.avg("w").alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("frame_id", F.when(F.col("m") > 0, F.col("w") / F.when(F.col("m") > 0, F.col("m"))).otherwise(1.0).alias("w"))


def best_reference(frames: DataFrame) -> DataFrame:
    """The frame of the greatest quality; the first of equals."""
    best = frames.agg(F.max_by(F.struct("frame_id", "quality"), F.struct(F.col("quality"), -F.col("frame_id"))).alias("b"))
    return best.select("b.frame_id", "b.quality")


LOW_IS_BETTER = {"fwhm", "background"}


def percent_threshold(frames: DataFrame, metric: str, percent: float) -> DataFrame:
    """One row ``t``: the sorted value at the index that the percentage names.

    Ranks come from a window over frames, one number each; positive values only
    (roundness keeps 0).
    """
    from pyspark.sql import Window

    known = frames.where(F.col(metric) >= 0 if metric == "roundness" else F.col(metric) > 0).select(F.col(metric).alias("m"))
    n = known.agg(F.count("*").alias("n"))
    ranked = known.withColumn("i", F.row_number().over(Window.orderBy("m")) - 1).crossJoin(F.broadcast(n))
    if metric in LOW_IS_BETTER:
        at = F.least(F.floor(F.col("n") * percent / 100.0), F.col("n") - 1)
    else:
        at = F.floor(F.col("n") * (100.0 - percent) / 100.0)
    return ranked.where(F.col("i") == at).select(F.col("m").alias("t"))


def filter_frames(frames: DataFrame, metric: str, threshold: DataFrame) -> DataFrame:
    """Frames at or beyond a one-row threshold ``t``; lengths must be known (> 0)."""
    f = frames.crossJoin(F.broadcast(threshold))
    ok = F.col(metric) <= F.col("t") if metric in LOW_IS_BETTER else F.col(metric) >= F.col("t")
    if metric == "fwhm":
        ok = ok & (F.col(metric) > 0)
    return f.where(ok).drop("t")


def sigma_threshold(frames: DataFrame, metric: str, k: float) -> DataFrame:
    known = frames.where(F.col(metric) >= 0 if metric == "roundness" else F.col(metric) > 0)
    sign = 1.0 if metric in LOW_IS_BETTER else -1.0
    return known.agg((F.avg(metric) + sign * k * F.stddev_pop(metric)).alias("t"))
