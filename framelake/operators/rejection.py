"""Outlier rejection for samples of one pixel.

Closed-form rules are column expressions over an array of samples; iterative
rules are array programs over many pixels at once, run on Arrow batches. NULL
samples are no data and are dropped before. All comparisons are strict. Passes
are free of sample order: all samples of a pass are judged by the same centre
and spread, and a pass that would leave fewer than three is not made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---- closed form, as columns over array<double> ----

def median_of(values: Column) -> Column:
    """Exact median; the mean of the middle two for an even count; null if empty."""
    s, n = F.sort_array(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)


def deviations(values: Column, centre: Column) -> Column:
    return F.zip_with(values, F.array_repeat(centre, F.size(values)), lambda v, m: F.abs(v - m))


def keep_modified_z(df: DataFrame, values: str, threshold: float = 3.5) -> DataFrame:
    """Keep v with |v - median| <= threshold * MAD / 0.6745; fewer than three samples all stay."""
    df = df.withColumn("_med", median_of(F.col(values)))
    df = df.withColumn("_limit", median_of(deviations(F.col(values), F.col("_med"))) * threshold / 0.6745)
    limits = F.array_repeat(F.struct(F.col("_med").alias("m"), F.col("_limit").alias("l")), F.size(values))
    marked = F.zip_with(values, limits, lambda v, k: F.when(F.abs(v - k["m"]) <= k["l"], v))
    kept = F.filter(marked, lambda v: v.isNotNull())
    return df.withColumn(values, F.when(F.size(values) < 3, F.col(values)).otherwise(kept)).drop("_med", "_limit")


def keep_percentile(df: DataFrame, values: str, low: float, high: float) -> DataFrame:
    """One pass: drop v with median - v > low * median or v - median > high * median; a zero median keeps all."""
    df = df.withColumn("_med", median_of(F.col(values)))
    marked = F.zip_with(
        values, F.array_repeat(F.col("_med"), F.size(values)),
        lambda v, m: F.when((m == 0) | ~((m - v > low * m) | (v - m > high * m)), v),
    )
    kept = F.filter(marked, lambda v: v.isNotNull())
    return df.withColumn(values, F.when(F.size(values) < 3, F.col(values)).otherwise(kept)).drop("_med")


def keep_mask(df: DataFrame, rule: str, keys: list[str], **options) -> DataFrame:
    """``keys, values, kept``: any rule as a flag for each of the ``values``, which the rule may change."""
    if rule not in ("modz", "percentile"):
        return reject(df, rule, keys, **options)
    fn = keep_modified_z if rule == "modz" else keep_percentile
    done = fn(df.select(*keys, "values", F.col("values").alias("_all")), "values", **options)
    # both rules test a value against limits: what they keep lies in one range
    lo, hi = F.array_min("values"), F.array_max("values")
    inside = F.zip_with("_all", F.array_repeat(F.struct(lo.alias("lo"), hi.alias("hi")), F.size("_all")), lambda v, r: F.coalesce((v >= r["lo"]) & (v <= r["hi"]), F.lit(False)))
    return done.select(*keys, F.col("_all").alias("values"), inside.alias("kept"))


# ---- iterative, on matrices of (pixel, sample) with a mask of survivors ----

def _median(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    n = keep.sum(axis=1)
    s = np.sort(np.where(keep, x, np.inf), axis=1)
    rows = np.arange(len(x))
    low = s[rows, np.maximum((n - 1) // 2, 0)]
    high = s[rows, np.minimum(n // 2, x.shape[1] - 1)]
    return np.where(n > 0, (low + high) / 2, np.nan)


def _deviation(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Sample standard deviation."""
    n = keep.sum(axis=1)
    mean = np.where(keep, x, 0).sum(axis=1) / np.maximum(n, 1)
    return np.sqrt(np.where(keep, (x - mean[:, None]) ** 2, 0).sum(axis=1) / np.maximum(n - 1, 1))


def _passes(x, keep, centre_and_spread, low, high):
    """Passes until one rejects nothing or would leave fewer than three samples; each rejects one at least."""
    while True:
        centre, spread = centre_and_spread(x, keep)
        out = keep & ((centre[:, None] - x > low * spread[:, None]) | (x - centre[:, None] > high * spread[:, None]))
        make = out.any(axis=1) & ((keep & ~out).sum(axis=1) >= 3)
        if not make.any():
            break
        keep = keep & ~(out & make[:, None])
    return x, keep


def sigma(x, keep, low=2.0, high=2.0):
    """Median plus or minus multiples of the sample deviation, recomputed on survivors."""
    return _passes(x, keep, lambda a, k: (_median(a, k), _deviation(a, k)), low, high)


def _mad(x, keep):
    centre = _median(x, keep)
    return centre, _median(np.abs(x - centre[:, None]), keep)


def mad(x, keep, low=3.0, high=3.0):
    """As ``sigma`` with the raw median absolute deviation as spread."""
    return _passes(x, keep, _mad, low, high)


def sigma_median(x, keep, low=2.0, high=2.0):
    """Outliers are replaced by the median, until there is none; the count stays.
    The spread shrinks with every pass."""
    while True:
        centre, spread = _median(x, keep), _deviation(x, keep)
        out = keep & ((centre[:, None] - x > low * spread[:, None]) | (x - centre[:, None] > high * spread[:, None]))
        out &= (keep.sum(axis=1) >= 3)[:, None]
        if not out.any():
            break
        x = np.where(out, centre[:, None], x)
    return x, keep


def winsorized(x, keep, low=3.0, high=3.0):
    """As ``sigma`` with 1.134 times the deviation of samples clipped to the median
    plus or minus 1.5 spreads, repeated until it changes by 5e-4 at most, or ten times."""

    def spread(a, k):
        centre = _median(a, k)
        s = _deviation(a, k)
        clipped = a
        live = s > 0
        for _ in range(10):
            m = _median(clipped, k)
            clipped = np.clip(clipped, (m - 1.5 * s)[:, None], (m + 1.5 * s)[:, None])
            new = 1.134 * _deviation(clipped, k)
            change = np.abs(new - s) > 5e-4 * np.where(s > 0, s, 1)
            s = np.where(live, new, s)
            live = live & change
            if not live.any():
                break
        return centre, s

    return _passes(x, keep, spread, low, high)


def linear_fit(x, keep, low=5.0, high=2.5):
    """Sorted samples are regressed on their rank; the spread is the mean absolute residual."""
    while True:
        n = keep.sum(axis=1)
        order = np.argsort(np.where(keep, x, np.inf), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(x.shape[1]), x.shape), axis=1)
        r = np.where(keep, rank, 0).astype(float)
        v = np.where(keep, x, 0.0)
        m = np.maximum(n, 1)
        mr, mv = r.sum(axis=1) / m, v.sum(axis=1) / m
        sxy = np.where(keep, (r - mr[:, None]) * (v - mv[:, None]), 0).sum(axis=1)
        sxx = np.where(keep, (r - mr[:, None]) ** 2, 0).sum(axis=1)
        slope = np.where(sxx > 0, sxy / np.where(sxx > 0, sxx, 1), 0)
        rest = v - (mv[:, None] + slope[:, None] * (r - mr[:, None]))
        spread = np.where(keep, np.abs(rest), 0).sum(axis=1) / m
        out = keep & ((-rest > low * spread[:, None]) | (rest > high * spread[:, None]))
        make = out.any(axis=1) & ((keep & ~out).sum(axis=1) >= 3)
        if not make.any():
            break
        keep = keep & ~(out & make[:, None])
    return x, keep


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution by bisection on erfc."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):  # neighbours: further steps change nothing
            break
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def student_quantile(p: float, dof: float) -> float:
    """Student's t quantile by the Cornish-Fisher expansion of the normal quantile."""
    z = normal_quantile(p)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + g1 / dof + g2 / dof**2 + g3 / dof**3


def _grubbs_limits(counts: np.ndarray, alpha: float) -> np.ndarray:
    """Critical values by sample count, up to the greatest of ``counts``; those asked for are filled in."""
    known = _LIMITS.get(alpha, np.zeros(0))
    if len(known) <= counts.max(initial=0):
        known = np.concatenate([known, np.full(int(counts.max(initial=0)) + 1 - len(known), np.nan)])
    for k in counts[np.isnan(known[counts])]:
        k = int(k)
        if k > 2:
            t = student_quantile(1 - alpha / (2 * k), k - 2)
            known[k] = (k - 1) * t / math.sqrt((k - 2 + t * t) * k)
        else:
            known[k] = np.inf
    _LIMITS[alpha] = known
    return known


#: Critical values of a worker, by significance.
_LIMITS: dict[float, np.ndarray] = {}


def _from_middle(d: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Running sums of each row, zero at its middle: a difference of two takes in no sample
    outside its range, however large. Summed in extended precision."""
    sums = np.zeros((len(d), d.shape[1] + 1))
    for row, m in enumerate(middle):
        sums[row, m + 1 :] = np.cumsum(d[row, m:], dtype=np.longdouble)
        sums[row, :m] = -np.cumsum(d[row, :m][::-1], dtype=np.longdouble)[::-1]
    return sums


def gesd(x, keep, fraction=0.3, alpha=0.05):
    """Generalized extreme studentized deviate test for at most ``fraction`` of the samples.

    The sample farthest from the mean is the least or the greatest that is left, so
    samples are sorted once and a step moves one of two ends; sums of what is left are
    differences of running sums. Of equally far ones the first sample goes. Samples that
    are not finite go first."""
    good = keep & np.isfinite(x)
    n0, n = keep.sum(axis=1), good.sum(axis=1)
    most = np.floor(n0 * fraction).astype(int)
    up = np.argsort(np.where(good, x, np.inf), axis=1, kind="stable")
    down = np.argsort(np.where(good, -x, np.inf), axis=1, kind="stable")
    s = np.take_along_axis(x, up, axis=1)
    rows, middle = np.arange(len(x)), n // 2
    centre = s[rows, np.minimum(middle, s.shape[1] - 1)]
    d = np.where(np.arange(s.shape[1]) < n[:, None], s - np.where(n > 0, centre, 0)[:, None], 0)
    first, second = _from_middle(d, middle), _from_middle(d * d, middle)
    wanted = np.zeros(int(n.max(initial=0)) + 1, bool)
    for k, b in set(zip(n.tolist(), most.tolist())):
        wanted[max(k - b, 0) : k + 1] = True
    limits = _grubbs_limits(np.flatnonzero(wanted), alpha)
    low, high = np.zeros(len(x), int), n.copy()  # the samples left
    cut_low, cut_high, lost = low.copy(), high.copy(), np.zeros(len(x), bool)
    live = np.flatnonzero((n > 3) & (n0 - n < most))
    while len(live):
        a, b = low[live], high[live]
        k = b - a
        total = first[live, b] - first[live, a]
        mean = total / k
        spread = np.sqrt(np.maximum(second[live, b] - second[live, a] - total * mean, 0) / (k - 1))
        below, above = mean - d[live, a], d[live, b - 1] - mean
        top = (above > below) | ((above == below) & (down[live, n[live] - b] < up[live, a]))
        g = np.where(top, above, below) / np.where(spread > 0, spread, np.inf)
        high[live] = b = b - top
        low[live] = a = a + ~top
        far = live[g > limits[k]]
        cut_low[far], cut_high[far], lost[far] = low[far], high[far], True
        live = live[(b - a > 3) & (n0[live] - (b - a) < most[live])]
    out = keep.copy()
    for row in np.flatnonzero(lost):
        out[row] &= good[row]
        out[row, up[row, : cut_low[row]]] = False
        out[row, down[row, : n[row] - cut_high[row]]] = False
    return x, out


def biweight(x, keep, c=6.0):
    """Reject |v - centre| >= c * MAD, the centre by up to five biweight steps; n < 4 keeps all."""
    centre, scale = _mad(x, keep)
    safe = np.where(scale > 0, scale, 1.0)
    for _ in range(5):
        u = (x - centre[:, None]) / (c * safe[:, None])
        w = np.where(keep & (np.abs(u) < 1), (1 - u * u) ** 2, 0.0)
        total = w.sum(axis=1)
        centre = np.where(total > 0, (w * np.where(keep, x, 0)).sum(axis=1) / np.where(total > 0, total, 1), centre)
    out = keep & (np.abs(x - centre[:, None]) >= c * scale[:, None])
    out &= ((scale > 0) & (keep.sum(axis=1) >= 4))[:, None]
    return x, keep & ~out


KERNELS: dict[str, Callable] = {
    "sigma": sigma, "mad": mad, "sigmedian": sigma_median, "winsorized": winsorized,
    "linear": linear_fit, "gesd": gesd, "biweight": biweight,
}


def apply_kernel(samples: list[np.ndarray], rule: str, **options) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Values and survivor masks of ragged samples, pixels of like depth at once."""
    depth = max((len(s) for s in samples), default=0)
    if not depth:
        return samples, [np.zeros(0, bool) for _ in samples]
    x, keep = np.zeros((len(samples), depth)), np.zeros((len(samples), depth), bool)
    for i, s in enumerate(samples):
        x[i, : len(s)] = s
        keep[i, : len(s)] = True
    small = keep.sum(axis=1) < 3
    values, kept = KERNELS[rule](x, keep, **options)
    values, kept = np.where(small[:, None], x, values), np.where(small[:, None], keep, kept)
    return [values[i, : len(s)] for i, s in enumerate(samples)], [kept[i, : len(s)] for i, s in enumerate(samples)]


#: Samples, padding included, of the pixels that are worked on at once, if not of one pixel.
PART = 1 << 21


def _parts(column: pa.Array, linked: bool) -> Iterator[tuple[int, int]]:
    """Ranges of at most 1024 rows whose matrix of samples stays below ``PART``."""
    start, depth, wide = 0, 0, 0
    for i, row in enumerate(column):
        sizes = [len(ch) for ch in row.values] if linked else [len(row.values)]
        deepest, n = max(depth, *sizes, 0), wide + len(sizes)
        if i > start and (i - start == 1024 or deepest * n > PART):
            yield start, i
            start, deepest, n = i, max([0, *sizes]), len(sizes)
        depth, wide = deepest, n
    if len(column):
        yield start, len(column)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def reject(df: DataFrame, rule: str, keys: list[str], *, values: str = "values", linked: bool = False, **options) -> DataFrame:
    """``keys, values, kept``: the rule over ``values`` (array<double>, no nulls) of each row.

    With ``linked``, ``values`` is an array of arrays (one a channel, same frames):
    a frame that any channel rejects goes from all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _parts(batch.column(len(keys)), linked):
                part = batch.slice(start, stop - start)
                column = part.column(len(keys))
                if linked:
                    rows = column.to_pylist()
                    flat = [np.array(ch, float) for row in rows for ch in row]
                    new, kept = apply_kernel(flat, rule, **options)
                    out_v, out_k, at = [], [], 0
                    for row in rows:
                        n = len(row)
                        out_v.append([v.tolist() for v in new[at : at + n]])
                        out_k.append(np.logical_and.reduce(kept[at : at + n]).tolist() if n else [])
                        at += n
                    done = pa.array(out_v, pa.list_(pa.list_(pa.float64()))), pa.array(out_k, pa.list_(pa.bool_()))
                else:
                    new, kept = apply_kernel([v.values.to_numpy(zero_copy_only=False).astype(float) for v in column], rule, **options)
                    done = _lists(new, pa.float64()), _lists(kept, pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *done], [*keys, "values", "kept"])

    chosen = df.select(*keys, values)
    types = ", ".join(f"{k} {chosen.schema[k].dataType.simpleString()}" for k in keys)
    inner = "array<array<double>>" if linked else "array<double>"
    return chosen.mapInArrow(run, f"{types}, values {inner}, kept array<boolean>")
