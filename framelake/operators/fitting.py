"""Fits and detection: sums come from distributed aggregates; only their few numbers
are solved on the driver. Detection and profile fits run on tiles or cutouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import KEYS, tiled


def normal_equations(df: DataFrame, terms: list[Column], y: Column, by: list[str] | None = None) -> DataFrame:
    """One row (a group) with the sums of products of all terms and with ``y``."""
    n = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
    rhs = [F.sum(terms[i] * y).alias(f"b{i}") for i in range(n)]
    return df.groupBy(*(by or [])).agg(*sums, *rhs)


def solve(row, n: int) -> np.ndarray:
    """Coefficients of one row of sums; the mean alone if the system is singular."""
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    b = np.array([row[f"b{i}"] or 0.0 for i in range(n)])
    if np.linalg.matrix_rank(a) < n:
        return np.array([b[0] / a[0, 0] if a[0, 0] else 0.0, *[0.0] * (n - 1)])
    return np.linalg.solve(a, b)


def polynomial_terms(x: Column, y: Column, degree: int) -> list[Column]:
    return [F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j))) for d in range(degree + 1) for i in range(d, -1, -1) for j in [d - i]]


def background_samples(img: DataFrame, patch: int, tolerance: float) -> DataFrame:
    """``cx, cy, v``: patch medians below median + tolerance * MAD of the whole image."""
    m = img.agg(F.median("v").alias("m"))
    patches = img.groupBy(F.floor(F.col("x") / patch).alias("i"), F.floor(F.col("y") / patch).alias("j")).agg(F.median("v").alias("v"))
    p = patches.crossJoin(F.broadcast(m))
    mad = p.agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("d"))
    half = (patch - 1) / 2
    kept = p.crossJoin(F.broadcast(mad)).where((F.col("v") > 0) & (F.col("v") <= F.col("m") + tolerance * F.col("d")))
    return kept.select((F.col("i") * patch + half).alias("cx"), (F.col("j") * patch + half).alias("cy"), "v")


def fit_background(samples: DataFrame, degree: int) -> np.ndarray:
    terms = polynomial_terms(F.col("cx"), F.col("cy"), degree)
    return solve(normal_equations(samples, terms, F.col("v")).first(), len(terms))


def remove_background(img: DataFrame, coefficients: np.ndarray, degree: int, divide: bool = False) -> DataFrame:
    """v - model + mean(model), or v / model * mean(model)."""
    model = F.lit(0.0)
    for c, t in zip(coefficients, polynomial_terms(F.col("x"), F.col("y"), degree)):
        model = model + F.lit(float(c)) * t
    out = img.withColumn("_m", model)
    mean = out.agg(F.avg("_m").alias("_mm"))
    out = out.crossJoin(F.broadcast(mean))
    new = F.when(F.col("_m") != 0, F.col("v") / F.col("_m")) * F.col("_mm") if divide else F.col("v") - F.col("_m") + F.col("_mm")
    return out.withColumn("v", new).drop("_m", "_mm")


def rbf_background(img: DataFrame, samples: list[tuple[float, float, float]], smoothing: float = 0.0) -> DataFrame:
    """Thin-plate spline through a bounded list of samples: ``model`` at every pixel.

    The kernel sum runs over the samples as an array literal, without a join."""
    p = np.array(samples, float)
    n = len(p)
    r2 = ((p[:, None, :2] - p[None, :, :2]) ** 2).sum(axis=2)
    phi = np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0) + smoothing * np.eye(n)
    poly = np.column_stack([np.ones(n), p[:, :2]])
    system = np.block([[phi, poly], [poly.T, np.zeros((3, 3))]])
    w = np.linalg.lstsq(system, np.concatenate([p[:, 2], np.zeros(3)]), rcond=None)[0]
    total = F.lit(float(w[n])) + F.lit(float(w[n + 1])) * F.col("x") + F.lit(float(w[n + 2])) * F.col("y")
    for k in range(n):
        d = (F.col("x") - float(p[k, 0])) * (F.col("x") - float(p[k, 0])) + (F.col("y") - float(p[k, 1])) * (F.col("y") - float(p[k, 1]))
        total = total + float(w[k]) * F.when(d > 0, 0.5 * d * F.ln(F.when(d > 0, d))).otherwise(0.0)
    return img.withColumn("model", total)


def background_samples_by(img: DataFrame, patch: int, tolerance: float, by: list[str]) -> DataFrame:
    """``background_samples`` of each image by itself: ``by, cx, cy, v``."""
    m = img.groupBy(*by).agg(F.median("v").alias("m"))
    patches = img.groupBy(*by, F.floor(F.col("x") / patch).alias("i"), F.floor(F.col("y") / patch).alias("j")).agg(F.median("v").alias("v"))
    p = patches.join(m, by)
    mad = p.groupBy(*by).agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("d"))
    half = (patch - 1) / 2
    kept = p.join(mad, by).where((F.col("v") > 0) & (F.col("v") <= F.col("m") + tolerance * F.col("d")))
    return kept.select(*by, (F.col("i") * patch + half).alias("cx"), (F.col("j") * patch + half).alias("cy"), "v")


def remove_background_by(img: DataFrame, samples: DataFrame, degree: int, by: list[str], divide: bool = False) -> DataFrame:
    """``fit_background`` and ``remove_background`` of each image by itself, solved in tasks;
    an image without samples has a model of zero."""
    terms = polynomial_terms(F.col("cx"), F.col("cy"), degree)
    sums = normal_equations(samples, terms, F.col("v"), by)
    kinds = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in by)
    n = len(terms)

    def run(batches):
        for batch in batches:
            found = [solve(r, n).tolist() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(found, pa.list_(pa.float64()))], [*by, "_c"])

    out = img.join(sums.mapInArrow(run, f"{kinds}, _c array<double>"), by, "left")
    model = F.lit(0.0)
    for k, t in enumerate(polynomial_terms(F.col("x"), F.col("y"), degree)):
        model = model + F.col("_c")[k] * t
    out = out.withColumn("_m", F.coalesce(model, F.lit(0.0))).drop("_c")
    out = out.join(out.groupBy(*by).agg(F.avg("_m").alias("_mm")), by)
    new = F.when(F.col("_m") != 0, F.col("v") / F.col("_m")) * F.col("_mm") if divide else F.col("v") - F.col("_m") + F.col("_mm")
    return out.withColumn("v", new).drop("_m", "_mm")


def rbf_background_by(img: DataFrame, samples: DataFrame, by: str, smoothing: float = 0.0) -> DataFrame:
    """``rbf_background`` of each image (``by, c, x, y, v``) by itself through all its samples;
    an image must fit a task."""

    def run(pixels: pa.Table, points: pa.Table) -> pa.Table:
        x, y = (pixels.column(k).to_numpy().astype(float) for k in "xy")
        p = np.column_stack([points.column(k).to_numpy() for k in ("cx", "cy", "v")])
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        n = len(p)
        kernel = lambda r2: np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)
        phi = kernel(((p[:, None, :2] - p[None, :, :2]) ** 2).sum(axis=2)) + smoothing * np.eye(n)
        poly = np.column_stack([np.ones(n), p[:, :2]])
        system = np.block([[phi, poly], [poly.T, np.zeros((3, 3))]])
        w = np.linalg.lstsq(system, np.concatenate([p[:, 2], np.zeros(3)]), rcond=None)[0]
        model = w[n] + w[n + 1] * x + w[n + 2] * y
        for k in range(n):
            model = model + w[k] * kernel((x - p[k, 0]) ** 2 + (y - p[k, 1]) ** 2)
        return pixels.append_column("model", pa.array(model, pa.float64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in img.schema) + ", model double"
    points = samples.select(F.col(by).alias("_by"), "cx", "cy", "v")
    return img.groupBy(by).cogroup(points.groupBy("_by")).applyInArrow(run, schema)


def affine(pairs: DataFrame, least: int = 0) -> np.ndarray | None:
    """Least-squares map of (x_a, y_a) to (x_b, y_b): [[a, b, c], [d, e, f]]; None for fewer
    than ``least`` pairs. The pairs are made once."""
    t = [F.lit(1.0), F.col("x_a"), F.col("y_a")]
    lhs = [F.sum(t[i] * t[j]).alias(f"a{i}_{j}") for i in range(3) for j in range(i, 3)]
    rhs = [F.sum(t[i] * F.col(c)).alias(f"{c}{i}") for c in ("x_b", "y_b") for i in range(3)]
    sums = pairs.agg(F.count("*").alias("n"), *lhs, *rhs).first().asDict()
    if sums["n"] < least:
        return None
    sx, sy = (solve(sums | {f"b{i}": sums[f"{c}{i}"] for i in range(3)}, 3) for c in ("x_b", "y_b"))
    return np.array([[sx[1], sx[2], sx[0]], [sy[1], sy[2], sy[0]]])


def dark_scale(light: DataFrame, dark: DataFrame, steps: int = 41) -> DataFrame:
    """``k, cost``: the factor that minimises MAD / |median| of light - k * dark, on a grid
    of factors 0 to 2, all probed in one plan."""
    both = light.join(dark.select("x", "y", F.col("v").alias("d")), ["x", "y"])
    grid = F.explode(F.array(*[F.lit(2.0 * i / (steps - 1)) for i in range(steps)])).alias("k")
    r = both.select(grid, "v", "d").withColumn("r", F.col("v") - F.col("k") * F.col("d"))
    med = r.groupBy("k").agg(F.median("r").alias("m"))
    cost = r.join(F.broadcast(med), "k").groupBy("k").agg(F.median(F.abs(F.col("r") - F.col("m"))).alias("mad"), F.first("m").alias("m"))
    cost = cost.select("k", F.when(F.col("m") != 0, F.col("mad") / F.abs("m")).alias("cost"))
    return cost.where("cost IS NOT NULL").agg(F.min_by("k", F.struct("cost", "k")).alias("k"), F.min("cost").alias("cost"))


def robust_mean(values: np.ndarray) -> float:
    med = np.median(values)
    mad = np.median(np.abs(values - med))
    keep = np.abs(values - med) <= 3 * 1.4826 * mad if mad > 0 else np.ones(len(values), bool)
    return float(values[keep].mean())


def colour_calibration(matched: DataFrame) -> DataFrame:
    """``kr, kg, kb``: median ratio of expected to measured colour, scaled to a maximum of 1."""
    m = matched.where("fr > 0 AND fg > 0 AND fb > 0").agg(
        F.median(F.col("er") / F.when(F.col("fr") > 0, F.col("fr"))).alias("kr"), F.median(F.col("eg") / F.when(F.col("fg") > 0, F.col("fg"))).alias("kg"), F.median(F.col("eb") / F.when(F.col("fb") > 0, F.col("fb"))).alias("kb"))
    top = F.greatest("kr", "kg", "kb")
    return m.select(*[(F.col(c) / top).alias(c) for c in ("kr", "kg", "kb")])


def colour_models(df: DataFrame) -> DataFrame:
    """Slope, affine and quadratic models of y by x and their relative RMS; the first best wins."""
    x, y = F.col("x"), F.col("y")
    slope = solve(normal_equations(df, [x], y).first(), 1)
    line = solve(normal_equations(df, [F.lit(1.0), x], y).first(), 2)
    quad = solve(normal_equations(df, [F.lit(1.0), x, x * x], y).first(), 3)
    fits = {"slope": float(slope[0]) * x, "affine": float(line[0]) + float(line[1]) * x, "quadratic": float(quad[0]) + float(quad[1]) * x + float(quad[2]) * x * x}
    rms = df.agg(*[F.sqrt(F.avg(((y - f) / F.when(y != 0, y)) * ((y - f) / F.when(y != 0, y)))).alias(n) for n, f in fits.items()])
    best = F.when(F.col("affine") < F.col("slope"), F.when(F.col("quadratic") < F.col("affine"), "quadratic").otherwise("affine")).otherwise(
        F.when(F.col("quadratic") < F.col("slope"), "quadratic").otherwise("slope"))
    return rms.select(best.alias("model"), "slope", "affine", "quadratic")


def detect(px: DataFrame, k: float = 3.0, halo: int = 8) -> DataFrame:
    """``frame_id, x, y, peak, flux``: 3x3 local maxima above median + k sigma of the tile,
    with centroids of the 5x5 around them; the top of equal neighbours is the first in reading order."""

    def fn(a, y0, x0):
        med = np.nanmedian(a)
        sig = 1.4826 * np.nanmedian(np.abs(a - med))
        p = np.pad(a, 1, constant_values=-np.inf)
        h, w = a.shape
        is_max = a > med + k * max(sig, 1e-12)
        for j in (-1, 0, 1):
            for i in (-1, 0, 1):
                if i or j:
                    n = p[1 + j : 1 + j + h, 1 + i : 1 + i + w]
                    is_max &= (a > n) if (j, i) < (0, 0) else (a >= n)
        cx, cy, flux = (np.full(a.shape, np.nan) for _ in range(3))
        for y, x in zip(*np.nonzero(is_max)):
            ys, xs = slice(max(0, y - 2), y + 3), slice(max(0, x - 2), x + 3)
            part = np.maximum(a[ys, xs] - med, 0)
            yy, xx = np.mgrid[ys.start : ys.start + part.shape[0], xs.start : xs.start + part.shape[1]]
            f = part.sum()
            cx[y, x], cy[y, x], flux[y, x] = (part * xx).sum() / f + x0, (part * yy).sum() / f + y0, f
        return {"cx": cx, "cy": cy, "flux": flux, "peak": np.where(is_max, a - med, np.nan)}

    out = tiled(px, fn, halo, ["cx", "cy", "flux", "peak"])
    return out.where("peak IS NOT NULL").select(*KEYS, F.col("cx").alias("x"), F.col("cy").alias("y"), "peak", "flux")


def fit_gaussian(a: np.ndarray, steps: int = 60) -> np.ndarray | None:
    """Levenberg-Marquardt fit of background, amplitude, x, y, sigma to a cutout."""
    yy, xx = np.mgrid[0 : a.shape[0], 0 : a.shape[1]].astype(float)
    bg = float(np.median(a))
    iy, ix = np.unravel_index(int(a.argmax()), a.shape)
    p = np.array([bg, float(a.max() - bg), float(ix), float(iy), 1.2])
    damp = 1e-3

    def model(q):
        d2 = (xx - q[2]) ** 2 + (yy - q[3]) ** 2
        e = np.exp(-d2 / (2 * q[4] ** 2))
        jac = np.stack([np.ones_like(e), e, q[1] * e * (xx - q[2]) / q[4] ** 2, q[1] * e * (yy - q[3]) / q[4] ** 2, q[1] * e * d2 / q[4] ** 3])
        return q[0] + q[1] * e, jac.reshape(5, -1)

    value, jac = model(p)
    cost = ((a - value) ** 2).sum()
    for _ in range(steps):
        h = jac @ jac.T
        g = jac @ (a - value).ravel()
        try:
            step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), g)
        except np.linalg.LinAlgError:
            return None
        new = p + step
        new[4] = abs(new[4])
        if not 0.1 < new[4] < 50:
            damp *= 10
            if damp > 1e12:
                return None
            continue
        value2, jac2 = model(new)
        cost2 = ((a - value2) ** 2).sum()
        if cost2 < cost:
            done = cost - cost2 < 1e-14 * max(cost, 1e-300)
            p, value, jac, cost, damp = new, value2, jac2, cost2, damp / 5
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p


def psf(px: DataFrame, radius: int = 4, k: float = 3.0) -> DataFrame:
    """``frame_id, x, y, amplitude, fwhm``: Gaussian fits around detections, on tiles."""
    kind = px.schema["frame_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        a[y, x] = table.column("v").to_numpy()
        med = np.median(a)
        sig = 1.4826 * np.median(np.abs(a - med))
        p = np.pad(a, 1, constant_values=-np.inf)
        around = np.max([p[1 + j : 1 + j + a.shape[0], 1 + i : 1 + i + a.shape[1]] for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j], axis=0)
        rows = []
        for py, px_ in zip(*np.nonzero((a > med + k * sig) & (a > around))):
            y0, x0 = max(0, py - radius), max(0, px_ - radius)
            fit = fit_gaussian(a[y0 : py + radius + 1, x0 : px_ + radius + 1])
            if fit is not None:
                rows.append((fit[2] + x0, fit[3] + y0, fit[1], 2.3548200450309493 * fit[4]))
        cols = list(zip(*rows)) if rows else [[]] * 4
        frame = [table.column("frame_id")[0].as_py()] * len(rows)
        return pa.table([pa.array(frame, table.schema.field("frame_id").type), *[pa.array(c, pa.float64()) for c in cols]], names=["frame_id", "x", "y", "amplitude", "fwhm"])

    return px.select("frame_id", "c", "x", "y", "v").groupBy(*KEYS).applyInArrow(run, f"frame_id {kind}, x double, y double, amplitude double, fwhm double")
