"""Exact robust statistics over pixel tables, as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_group(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs)


def mad(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """``by, median, mad``: the raw median absolute deviation."""
    med = df.groupBy(*by).agg(F.median(v).alias("median"))
    return df.join(med, by).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col(v) - F.col("median"))).alias("mad"))


def upper_median(v: Column) -> Column:
    """Element n div 2 of the sorted values, as an aggregate."""
    s = F.sort_array(F.collect_list(v))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def row_noise(px: DataFrame) -> DataFrame:
    """``frame_id, noise``: first differences along rows, three 5-sigma clips, the upper
    median of the rows' deviations times 0.7071. Values of 0 end a pair."""
    w = Window.partitionBy("frame_id", "y").orderBy("x")
    d = px.withColumn("nx", F.lead("v").over(w)).where("v != 0 AND nx != 0").select("frame_id", "y", (F.col("nx") - F.col("v")).alias("d"))
    row = Window.partitionBy("frame_id", "y")
    for _ in range(3):
        d = d.withColumn("m", F.avg("d").over(row)).withColumn("s", F.stddev_samp("d").over(row))
        d = d.where(F.col("s").isNull() | (F.abs(F.col("d") - F.col("m")) <= 5.0 * F.col("s")))
    rows = d.groupBy("frame_id", "y").agg(F.stddev_samp("d").alias("s")).where("s IS NOT NULL")
    return rows.groupBy("frame_id").agg((0.7071 * upper_median(F.col("s"))).alias("noise"))


def robust_sigma(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, sigma``: 1.4826 times the upper median of the distances to the upper median.
    Where that is 0, the population deviation; at least 1e-6. Values that are not finite
    don't count; a group without others has 1e-6."""
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    clean = df.select(*by, F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")).alias("v"))
    centre = clean.groupBy(*by).agg(upper("v").alias("m"), F.stddev_pop("v").alias("s"))
    away = clean.join(centre, by).withColumn("d", F.abs(F.col("v") - F.col("m")))
    found = away.groupBy(*by).agg(upper("d").alias("mad"), F.first("s").alias("s"))
    sigma = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("s") > 0, F.col("s")).otherwise(1e-6)
    return found.select(*by, sigma.alias("sigma"))


def ikss_lite(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, location, scale``: values within six deviations of the median are kept; the
    scale is 0.991 times the root of their biweight midvariance."""
    first = mad(df, by)
    near = df.join(first, by).where((F.col("mad") > 0) & (F.abs(F.col("v") - F.col("median")) <= 6.0 * F.col("mad"))).select(*by, "v")
    again = mad(near, by).where("mad > 0")
    u = (F.col("v") - F.col("median")) / (9.0 * F.col("mad"))
    x = near.join(again, by).withColumn("u2", u * u).where("u2 < 1")
    q = 1.0 - F.col("u2")
    d2 = (F.col("v") - F.col("median")) * (F.col("v") - F.col("median"))
    sums = x.groupBy(*by).agg(
        F.first("median").alias("location"), F.count("*").alias("n"),
        F.sum(d2 * q * q * q * q).alias("top"), F.sum(q * (1.0 - 5.0 * F.col("u2"))).alias("low"),
    )
    scale = 0.991 * F.sqrt(F.col("n") * F.col("top")) / F.abs(F.col("low"))
    return sums.select(*by, "location", scale.alias("scale"))


def pairs(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Ordered pairs (a before b) of the rows of each group; groups must be small."""
    w = Window.partitionBy(*by).orderBy(order)
    n = df.withColumn("i", F.row_number().over(w))
    left = n.select(*by, F.col("i").alias("ia"), *[F.col(c).alias(c + "_a") for c in df.columns if c not in by])
    right = n.select(*by, F.col("i").alias("ib"), *[F.col(c).alias(c + "_b") for c in df.columns if c not in by])
    return left.join(right, by).where("ia < ib")


def qn_robust_mean(samples: DataFrame, by: list[str]) -> DataFrame:
    """``by, mean``: values within 3 * 2.2219 * Qn of the median, Qn the k-th least pairwise
    distance with k = h (h - 1) / 2, h = n div 2 + 1; a 30 % trimmed mean for fewer than five."""
    stats = samples.groupBy(*by).agg(F.count("*").alias("n"), F.median("v").alias("m"))
    p = pairs(samples, by, "v").select(*by, F.abs(F.col("v_a") - F.col("v_b")).alias("d"))
    r = p.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("d"))).join(stats, by)
    h = F.floor(F.col("n") / 2) + 1
    qn = r.where(F.col("k") == h * (h - 1) / 2).select(*by, (2.2219 * F.col("d")).alias("qn"))
    ranked = samples.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1)
    s = ranked.join(stats, by).join(qn, by, "left")
    cut = F.floor(F.col("n") * 0.3)
    keep = F.when(F.col("n") < 5, (F.col("i") >= cut) & (F.col("i") < F.col("n") - cut)).otherwise(
        F.abs(F.col("v") - F.col("m")) <= 3.0 * F.col("qn"))
    return s.where(keep).groupBy(*by).agg(F.avg("v").alias("mean"), F.count("*").alias("n_kept"))


def repeated_median(samples: DataFrame, by: list[str]) -> DataFrame:
    """``by, slope, intercept``: the median over points of the median slope to all others."""
    n = samples.withColumn("i", F.monotonically_increasing_id())
    a = n.select(*by, F.col("i").alias("ia"), F.col("xx").alias("xa"), F.col("v").alias("va"))
    b = n.select(*by, F.col("i").alias("ib"), F.col("xx").alias("xb"), F.col("v").alias("vb"))
    slopes = a.join(b, by).where("xa != xb").select(*by, "ia", ((F.col("vb") - F.col("va")) / (F.col("xb") - F.col("xa"))).alias("s"))
    inner = slopes.groupBy(*by, "ia").agg(F.median("s").alias("s"))
    slope = inner.groupBy(*by).agg(F.median("s").alias("slope"))
    return samples.join(slope, by).groupBy(*by).agg(F.first("slope").alias("slope"), F.median(F.col("v") - F.col("slope") * F.col("xx")).alias("intercept"))


def histogram(df: DataFrame, bins: int, by: tuple[str, ...] = ("c",)) -> DataFrame:
    """Counts by bin = floor(clamp(v) * (bins - 1) + 0.5)."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v")))
    return df.groupBy(*by, F.floor(v * (bins - 1) + 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def _grouped_numbers(df: DataFrame, by: list[str], fn, names: list[str], order: str | None = None) -> DataFrame:
    """``by`` and the numbers that ``fn`` makes of each group's values, sorted, or in the
    order of column ``order`` and then by value; a group must fit a task."""
    import numpy as np
    import pyarrow as pa

    values = F.collect_list("v") if order is None else F.array_sort(F.collect_list(F.struct(order, "v")))["v"]
    lists = df.where("v IS NOT NULL").groupBy(*by).agg(values.alias("vs"))
    kinds = ", ".join(f"{k} {lists.schema[k].dataType.simpleString()}" for k in by)

    def run(batches):
        for batch in batches:
            lists = (np.array(v.as_py(), float) for v in batch.column(len(by)))
            got = [fn(np.sort(v) if order is None else v) for v in lists]
            cols = [pa.array([g[k] for g in got], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *cols], [*by, *names])

    return lists.mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


def huber(values) -> tuple[float, float]:
    """Location and scale by at most ten steps of Huber weights (1.5 scales), from median and 1.4826 MAD."""
    import numpy as np

    loc = float(np.median(values))
    scale = max(1.4826 * float(np.median(np.abs(values - loc))), 1e-10)
    for _ in range(10):
        z = np.abs(values - loc) / scale
        w = np.where(z < 1.5, 1.0, 1.5 / np.maximum(z, 1e-300))
        new = float((w * values).sum() / w.sum())
        z = np.abs(values - new) / scale
        w2 = np.where(z < 1.5, 1.0, 1.5 / np.maximum(z, 1e-300))
        spread = max(float(np.sqrt((w2 * (values - new) ** 2).sum() / w.sum())), 1e-10)
        done = abs(new - loc) < 1e-4 * scale and abs(spread - scale) < 1e-4 * scale
        loc, scale = new, spread
        if done:
            break
    return loc, scale


def ikss_huber(df: DataFrame, by: list[str]) -> DataFrame:
    return _grouped_numbers(df, by, huber, ["location", "scale"])


def hampel(values) -> tuple[float]:
    """Location by Newton steps of Hampel's three-part influence function (1.7, 3.4, 8.5)."""
    import numpy as np

    a, b, c = 1.7, 3.4, 8.5
    loc = float(values[len(values) // 2])
    scale = float(np.sort(np.abs(values - loc))[len(values) // 2]) / 0.6745
    if scale < 1e-10:
        return (loc,)
    for _ in range(50):
        r = (values - loc) / scale
        x = np.abs(r)
        psi = np.sign(r) * np.where(x < a, x, np.where(x < b, a, np.where(x < c, a * (c - x) / (c - b), 0.0)))
        slope = np.where(x < a, 1.0, np.where(x < b, 0.0, np.where(x < c, a / (b - c), 0.0))).sum()
        if abs(slope) < 1e-10:
            break
        step = scale * psi.sum() / slope
        loc += step
        if abs(step) < 1e-6 * scale:
            break
    return (float(loc),)


def hampel_mean(df: DataFrame, by: list[str]) -> DataFrame:
    return _grouped_numbers(df, by, hampel, ["mean"])


def qn_mean(values) -> tuple[float, float]:
    """``qn_robust_mean`` of one group's sorted values: the mean and how many it keeps."""
    import numpy as np

    n = len(values)
    if n < 5:
        cut = math.floor(n * 0.3)
        kept = values[cut : n - cut]
    else:
        low, high = np.triu_indices(n, 1)
        h = n // 2 + 1
        k = h * (h - 1) // 2 - 1
        qn = 2.2219 * np.partition(np.abs(values[low] - values[high]), k)[k]
        kept = values[np.abs(values - np.median(values)) <= 3.0 * qn]
    return (float(kept.mean()) if len(kept) else math.nan), float(len(kept))


def qn_robust_means(samples: DataFrame, by: list[str]) -> DataFrame:
    """``qn_robust_mean`` with a group's pairs made inside its task, for whole tables."""
    found = _grouped_numbers(samples, by, qn_mean, ["mean", "n_kept"])
    return found.where("n_kept > 0").withColumn("n_kept", F.col("n_kept").cast("long"))


def median_line(values) -> tuple[float, float]:
    """``repeated_median`` of one group's values at 1, 2, ...; none for a single value."""
    import numpy as np

    n = len(values)
    if n < 2:
        return math.nan, math.nan
    x = np.arange(1, n + 1)
    others = ~np.eye(n, dtype=bool)
    run = np.where(others, x[None, :] - x[:, None], 1)
    slopes = ((values[None, :] - values[:, None]) / run)[others].reshape(n, n - 1)
    slope = float(np.median(np.median(slopes, axis=1)))
    return slope, float(np.median(values - slope * x))


def repeated_medians(samples: DataFrame, by: list[str], order: str) -> DataFrame:
    """``repeated_median`` over places in the order of ``order``, with a group's pairs made
    inside its task, for whole tables."""
    return _grouped_numbers(samples, by, median_line, ["slope", "intercept"], order).where("NOT isnan(slope)")
