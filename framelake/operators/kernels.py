"""Neighbourhood kernels on pixel tables ``frame_id, x, y, c, v``.

Binning and index permutations are plain column work or one grouped aggregate.
Small stencils read a neighbour grid made by two window passes (along rows, then
along columns): no join and no copies of pixels. Larger or branching kernels run
as array programs on tiles: a pixel is copied only to the tiles whose halo it is
in, a tile is one group, and only its core leaves it, so memory is bounded by the
tile whatever the frame's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256
KEYS = ["frame_id", "c"]


# ---- binning and permutations ----

def bin_pixels(px: DataFrame, f: int, width: int, height: int) -> DataFrame:
    """Means of f x f blocks; the remainder at the right and bottom is dropped."""
    inside = px.where((F.col("x") < width // f * f) & (F.col("y") < height // f * f))
    return inside.groupBy(*KEYS, F.floor(F.col("x") / f).cast("int").alias("x"), F.floor(F.col("y") / f).cast("int").alias("y")).agg(F.avg("v").alias("v"))


#: (row, column) parity of the red and blue sites of a 2x2 colour filter array: fixed values.
PATTERNS = {"RGGB": ((0, 0), (1, 1)), "BGGR": ((1, 1), (0, 0)), "GRBG": ((0, 1), (1, 0)), "GBRG": ((1, 0), (0, 1))}


def site(pattern: str) -> Column:
    """r, g or b by position."""
    (rr, rc), (br, bc) = PATTERNS[pattern]
    py, px = F.col("y") % 2, F.col("x") % 2
    return F.when((py == rr) & (px == rc), "r").when((py == br) & (px == bc), "b").otherwise("g")


def superpixel(px: DataFrame, pattern: str) -> DataFrame:
    """One colour pixel for each 2x2 cell; the two greens are averaged."""
    s = px.withColumn("s", site(pattern))
    cell = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in ("x", "y")]
    return s.groupBy("frame_id", *cell).agg(*[F.avg(F.when(F.col("s") == n, F.col("v"))).alias(n) for n in "rgb"])


def mirror(px: DataFrame, axis: str, size: int) -> DataFrame:
    return px.withColumn(axis, F.lit(size - 1) - F.col(axis))


def rotate(px: DataFrame, quarter_turns: int, width: int, height: int) -> DataFrame:
    """Clockwise by quarter turns."""
    x, y = F.col("x"), F.col("y")
    new = [(x, y), (F.lit(height - 1) - y, x), (F.lit(width - 1) - x, F.lit(height - 1) - y), (y, F.lit(width - 1) - x)][quarter_turns % 4]
    return px.select(*[c for c in px.columns if c not in ("x", "y")], new[0].alias("x"), new[1].alias("y"))


def crop(px: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    some = px.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return some.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def shift(px: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """Whole-pixel shift; what leaves the frame is dropped."""
    moved = px.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    return moved.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def resample_nearest(px: DataFrame, factor: float, width: int, height: int) -> DataFrame:
    """Every output pixel reads the input pixel at floor(position / factor)."""
    w, h = round(width * factor), round(height * factor)
    reach = math.ceil(factor) + 1
    spread = F.sequence(F.lit(0), F.lit(reach))
    o = px.select(*px.columns, F.explode(spread).alias("i")).select("*", F.explode(spread).alias("j"))
    first = lambda c: F.ceil(F.col(c) * factor).cast("int")
    o = o.withColumns({"ox": first("x") + F.col("i"), "oy": first("y") + F.col("j")})
    same = (F.floor(F.col("ox") / factor) == F.col("x")) & (F.floor(F.col("oy") / factor) == F.col("y")) & (F.col("ox") < w) & (F.col("oy") < h)
    return o.where(same).select(*KEYS, F.col("ox").alias("x"), F.col("oy").alias("y"), "v")


# ---- window stencils ----

def _row(by: str) -> Window:
    along = "x" if by == "y" else "y"
    return Window.partitionBy(*KEYS, by).orderBy(along)


def grid(px: DataFrame, r: int) -> DataFrame:
    """``n``: array of 2r+1 rows (from y-r) of 2r+1 values (from x-r); null outside."""
    w, h = _row("y"), _row("x")
    row = F.array(*[F.lag("v", -k).over(w) if k else F.col("v") for k in range(-r, r + 1)])
    df = px.withColumn("_row", row)
    return df.withColumn("n", F.array(*[F.lag("_row", -k).over(h) if k else F.col("_row") for k in range(-r, r + 1)])).drop("_row")


def at(dx: int, dy: int, r: int) -> Column:
    return F.get(F.get("n", F.lit(dy + r)), F.lit(dx + r))


def mean_of(cells: list[Column]) -> Column:
    total, n = F.lit(0.0), F.lit(0)
    for c in cells:
        total = total + F.coalesce(c, F.lit(0.0))
        n = n + c.isNotNull().cast("int")
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def morphology(px: DataFrame, op: str, iterations: int = 1) -> DataFrame:
    """Erode or dilate with the 3x3 cross; open and close are compositions."""
    if op in ("open", "close"):
        first, second = ("erode", "dilate") if op == "open" else ("dilate", "erode")
        return morphology(morphology(px, first, iterations), second, iterations)
    pick = F.least if op == "erode" else F.greatest
    for _ in range(iterations):
        g = grid(px, 1)
        px = g.withColumn("v", pick(*[at(dx, dy, 1) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])).drop("n")
    return px


def demosaic_bilinear(px: DataFrame, pattern: str) -> DataFrame:
    """``r, g, b`` by the mean of the available neighbours of each colour."""
    (rr, _), _ = PATTERNS[pattern]
    g = grid(px, 1).withColumn("s", site(pattern))
    cross = mean_of([at(1, 0, 1), at(-1, 0, 1), at(0, 1, 1), at(0, -1, 1)])
    diagonal = mean_of([at(i, j, 1) for i in (-1, 1) for j in (-1, 1)])
    across, down = mean_of([at(1, 0, 1), at(-1, 0, 1)]), mean_of([at(0, 1, 1), at(0, -1, 1)])
    red_row = F.col("y") % 2 == rr
    s, v = F.col("s"), F.col("v")
    return g.select(
        "frame_id", "x", "y",
        F.when(s == "r", v).when(s == "b", diagonal).otherwise(F.when(red_row, across).otherwise(down)).alias("r"),
        F.when(s == "g", v).otherwise(cross).alias("g"),
        F.when(s == "b", v).when(s == "r", diagonal).otherwise(F.when(red_row, down).otherwise(across)).alias("b"),
    )


def gaussian(sigma: float) -> list[float]:
    r = math.ceil(3 * sigma)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def blur(px: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian; beyond an edge the edge value repeats."""
    weights = gaussian(sigma)
    r = len(weights) // 2
    for by in ("y", "x"):
        w = _row(by)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = {-1: F.first("v").over(whole), 1: F.last("v").over(whole)}
        total = F.lit(0.0)
        for k, weight in zip(range(-r, r + 1), weights):
            cell = F.col("v") if k == 0 else F.coalesce(F.lag("v", -k).over(w), ends[1 if k > 0 else -1])
            total = total + weight * cell
        px = px.withColumn("v", total)
    return px


def cosmetic(px: DataFrame, low: float, high: float) -> DataFrame:
    """Pixels beyond k * 1.4826 MAD of their CFA phase become the median of their
    same-colour neighbours (two pixels away on each axis)."""
    phase = px.withColumns({"p": F.col("x") % 2 + 2 * (F.col("y") % 2)})
    med = phase.groupBy(*KEYS, "p").agg(F.median("v").alias("m"))
    mad = phase.join(med, [*KEYS, "p"]).groupBy(*KEYS, "p").agg(F.first("m").alias("m"), (1.4826 * F.median(F.abs(F.col("v") - F.col("m")))).alias("s"))
    g = grid(px, 2).withColumn("p", F.col("x") % 2 + 2 * (F.col("y") % 2)).join(mad, [*KEYS, "p"])
    near = F.filter(F.array(*[at(dx, dy, 2) for dx in (-2, 0, 2) for dy in (-2, 0, 2) if dx or dy]), lambda v: v.isNotNull())
    s = F.sort_array(near)
    n = F.size(s)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    bad = (F.col("v") > F.col("m") + high * F.col("s")) | (F.col("v") < F.col("m") - low * F.col("s"))
    return g.select("frame_id", "x", "y", "c", F.when(bad & (n > 0), middle).otherwise(F.col("v")).alias("v"), bad.alias("fixed"))


def deviant_pixels(px: DataFrame, low: float, high: float) -> DataFrame:
    return cosmetic(px, low, high).where("fixed").select("frame_id", "x", "y")


def banding_fix(px: DataFrame) -> DataFrame:
    """Each row's first quartile (element n div 4) is moved to its frame's."""

    def quartile(*by: str) -> DataFrame:
        s = F.sort_array(F.collect_list("v"))
        return px.groupBy(*KEYS, *by).agg(F.get(s, F.floor(F.size(s) / 4).cast("int")).alias("q" + "".join(by)))

    j = px.join(quartile("y"), [*KEYS, "y"]).join(quartile(), KEYS)
    return j.withColumn("v", F.col("v") - F.col("qy") + F.col("q")).drop("q", "qy")


def cfa_equalize(px: DataFrame, pattern: str, width: int, height: int) -> DataFrame:
    """Red and blue scaled to green by cell means of the centre third."""
    inner = px.where((F.col("x") >= width // 3) & (F.col("x") < 2 * width // 3) & (F.col("y") >= height // 3) & (F.col("y") < 2 * height // 3))
    cell = inner.withColumn("s", site(pattern)).groupBy(*KEYS, "s", (F.col("x") % 2).alias("i"), (F.col("y") % 2).alias("j")).agg(F.avg("v").alias("m"))
    means = cell.groupBy(*KEYS).agg(*[F.avg(F.when(F.col("s") == n, F.col("m"))).alias("m" + n) for n in "rgb"])
    j = px.withColumn("s", site(pattern)).join(means, KEYS)
    factor = lambda n: F.when((F.col("mg") >= 1e-9) & (F.col("m" + n) > 1e-9), F.col("mg") / F.col("m" + n)).otherwise(F.lit(1.0))
    f = F.when(F.col("s") == "r", factor("r")).when(F.col("s") == "b", factor("b")).otherwise(F.lit(1.0))
    return j.withColumn("v", F.col("v") * f).drop("s", "mr", "mg", "mb")


# ---- tiles ----

def tiled(px: DataFrame, fn: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], halo: int, outputs: list[str], tile: int = TILE) -> DataFrame:
    """``frame_id, c, x, y`` and the outputs of ``fn(values, y0, x0)`` on tiles with a halo.

    ``values`` covers the part of the frame that tile and halo contain; ``y0, x0``
    is its corner. Outputs have its shape; NaN becomes null. Only the core is kept.
    """
    low, high = lambda c: F.floor((F.col(c) - halo) / tile), lambda c: F.floor((F.col(c) + halo) / tile)
    t = px.select(*KEYS, "x", "y", "v", F.explode(F.sequence(low("x"), high("x"))).alias("tx")).select("*", F.explode(F.sequence(low("y"), high("y"))).alias("ty"))
    frames = px.schema["frame_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        y0, x0 = int(y.min()), int(x.min())
        values = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
        values[y - y0, x - x0] = table.column("v").to_numpy()
        got = fn(values, y0, x0)
        yy, xx = np.mgrid[y0 : y0 + values.shape[0], x0 : x0 + values.shape[1]]
        core = (yy // tile == ty) & (xx // tile == tx) & ~np.isnan(values)
        n = int(core.sum())
        cols = [pa.array([table.column("frame_id")[0].as_py()] * n, table.schema.field("frame_id").type), pa.array([table.column("c")[0].as_py()] * n, pa.int32()),
                pa.array(xx[core].astype(np.int32)), pa.array(yy[core].astype(np.int32))]
        cols += [pa.array(got[o][core].astype(float), from_pandas=True) for o in outputs]
        return pa.table(cols, names=["frame_id", "c", "x", "y", *outputs])

    schema = f"frame_id {frames}, c int, x int, y int, " + ", ".join(f"{o} double" for o in outputs)
    return t.groupBy(*KEYS, "tx", "ty").applyInArrow(run, schema)


def _edge(a: np.ndarray, r: int, mode: str) -> np.ndarray:
    if mode == "reflect" and min(a.shape) <= r:
        mode = "symmetric"
    return np.pad(a, r, mode=mode)


B3 = np.array([1, 4, 6, 4, 1]) / 16.0


def atrous_planes(a: np.ndarray, scales: int) -> list[np.ndarray]:
    """Detail planes of the dilated B3 spline transform, then the residual. They sum to ``a``."""
    planes, now = [], a
    for s in range(scales):
        step = 1 << s
        low = now
        for axis in (0, 1):
            index = np.arange(a.shape[axis])
            total = np.zeros_like(low)
            for k, w in zip((-2, -1, 0, 1, 2), B3):
                i = np.abs(index + k * step)
                last = a.shape[axis] - 1
                i = np.where(i > last, 2 * last - i, i)
                total += w * np.take(low, np.clip(i, 0, last), axis=axis)
            low = total
        planes.append(now - low)
        now = low
    return [*planes, now]


def atrous(px: DataFrame, scales: int = 2) -> DataFrame:
    names = [f"w{k}" for k in range(scales)] + ["residual"]
    return tiled(px, lambda a, y0, x0: dict(zip(names, atrous_planes(a, scales))), 2 * (2**scales), names)


def multiscale_denoise(px: DataFrame, thresholds: list[float], gains: list[float]) -> DataFrame:
    """Soft threshold and gain of each detail plane, then the sum."""

    def fn(a, y0, x0):
        *planes, low = atrous_planes(a, len(thresholds))
        for p, t, g in zip(planes, thresholds, gains):
            low = low + g * np.sign(p) * np.maximum(0, np.abs(p) - t)
        return {"v": low}

    return tiled(px, fn, 2 * (2 ** len(thresholds)), ["v"])


def unsharp(px: DataFrame, sigma: float, amount: float) -> DataFrame:
    """v + amount * (v - blurred): the halo filter's core."""
    soft = blur(px, sigma).select(*KEYS, "x", "y", F.col("v").alias("soft"))
    return px.join(soft, [*KEYS, "x", "y"]).withColumn("v", F.col("v") + amount * (F.col("v") - F.col("soft"))).drop("soft")


def clahe(px: DataFrame, clip: float = 2.0, bins: int = 64, cells: int = 2) -> DataFrame:
    """Contrast-limited adaptive equalization with bilinear blending of cell curves.

    The cells divide a frame of any size. Their histograms are one grouped aggregate;
    a frame's curves (``cells`` squared times ``bins`` numbers) join its pixels."""
    ends = px.groupBy(*KEYS).agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"),
        (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v")))
    level = F.floor(inside * (bins - 1) + 0.5).cast("int")
    cell = lambda at, size: sum((at >= F.floor(size * k / cells)).cast("int") for k in range(1, cells)) + F.lit(0)
    y, x = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    named = px.join(ends, KEYS).select(*KEYS, (cell(y, F.col("h")) * cells + cell(x, F.col("w"))).alias("cell"), level.alias("level"))
    counts = named.groupBy(*KEYS, "cell", "level").agg(F.count("*").alias("n"))
    found = counts.groupBy(*KEYS, "cell").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("by"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0)).cast("double"))
    top = F.greatest(F.lit(1.0), clip * F.col("size") / bins)
    over = F.aggregate("hist", F.lit(0.0), lambda t, n: t + F.greatest(n - F.col("top"), F.lit(0.0)))
    flat = F.transform("hist", lambda n: F.least(n, F.col("top")) + F.col("extra") / bins)
    running = F.aggregate("flat", F.array().cast("array<double>"), lambda t, n: F.array_append(t, F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(0.0)) + n))
    found = found.withColumn("hist", hist).withColumn("top", top).withColumn("extra", over).withColumn("flat", flat)
    found = found.withColumn("curve", F.transform(running, lambda t: t / F.col("size")))
    curves = found.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("cell", "curve"))).alias("curves"))
    cy, cx = (y + 0.5) * cells / F.col("h") - 0.5, (x + 0.5) * cells / F.col("w") - 0.5
    first = lambda at: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(at).cast("int")))
    share = lambda at, k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - F.col(k)))
    j = px.join(ends.join(curves, KEYS), KEYS).select(*KEYS, "x", "y", "curves", (level + 1).alias("level"), cy.alias("cy"), cx.alias("cx"))
    j = j.withColumns({"i": first(F.col("cy")), "j": first(F.col("cx"))}).withColumns({"fy": share(F.col("cy"), "i"), "fx": share(F.col("cx"), "j")})
    after = lambda k: F.least(F.col(k) + 1, F.lit(cells - 1))
    pick = lambda i, k: F.coalesce(F.try_element_at(F.try_element_at("curves", (i * cells + k).cast("int")), F.col("level")), F.lit(0.0))
    row = lambda i: (1 - F.col("fx")) * pick(i, F.col("j")) + F.col("fx") * pick(i, after("j"))
    v = (1 - F.col("fy")) * row(F.col("i")) + F.col("fy") * row(after("i"))
    return j.select(*KEYS, "x", "y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias("v"))


def demosaic_vng(px: DataFrame, pattern: str) -> DataFrame:
    """Variable number of gradients: of eight directions those within 1.5 times the least
    gradient contribute; in a border of three pixels all channels take the raw value."""
    (rr, rc), (br, bc) = PATTERNS[pattern]
    directions = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]

    def fn(a, y0, x0):
        p = _edge(a, 3, "edge")
        h, w = a.shape
        get = lambda dx, dy: p[3 + dy : 3 + dy + h, 3 + dx : 3 + dx + w]
        grads = np.stack([np.abs(a - get(2 * dx, 2 * dy)) + np.abs(get(dx, dy) - get(3 * dx, 3 * dy)) for dx, dy in directions])
        use = grads <= 1.5 * grads.min(axis=0)
        count = use.sum(axis=0)
        yy, xx = np.mgrid[y0 : y0 + h, x0 : x0 + w]
        red, blue = (yy % 2 == rr) & (xx % 2 == rc), (yy % 2 == br) & (xx % 2 == bc)
        total = lambda cells: np.where(use, np.stack(cells), 0).sum(axis=0) / count
        near_green = total([(get(dx, 0) + get(0, dy)) / 2 if dx and dy else get(dx, dy) for dx, dy in directions])
        corner = total([get(dx or 1, dy or 1) for dx, dy in directions])
        along_x = total([(get(-1, 0) + get(1, 0)) / 2] * 8)
        along_y = total([(get(0, -1) + get(0, 1)) / 2] * 8)
        red_row = yy % 2 == rr
        r = np.where(red, a, np.where(blue, corner, np.where(red_row, along_x, along_y)))
        g = np.where(red | blue, near_green, a)
        b = np.where(blue, a, np.where(red, corner, np.where(red_row, along_y, along_x)))
        return {"r": r, "g": g, "b": b}

    out = tiled(px, fn, 3, ["r", "g", "b"])
    ends = px.groupBy(*KEYS).agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    j = out.join(px.select(*KEYS, "x", "y", "v"), [*KEYS, "x", "y"]).join(ends, KEYS)
    border = (F.least("x", "y", F.col("mx") - F.col("x"), F.col("my") - F.col("y"))) < 3
    return j.select("frame_id", "x", "y", *[F.when(border, F.col("v")).otherwise(F.col(n)).alias(n) for n in "rgb"])


def demosaic_ratio(px: DataFrame, pattern: str) -> DataFrame:
    """Green along the smaller gradient for the whole frame, then red and blue by
    interpolated ratios to green; a zero green gives ratio 0."""
    (rr, rc), (br, bc) = PATTERNS[pattern]

    def fn(a, y0, x0):
        h, w = a.shape
        yy, xx = np.mgrid[y0 : y0 + h, x0 : x0 + w]
        red, blue = (yy % 2 == rr) & (xx % 2 == rc), (yy % 2 == br) & (xx % 2 == bc)
        p = _edge(a, 2, "reflect")
        get = lambda q, dx, dy, r: q[r + dy : r + dy + h, r + dx : r + dx + w]
        gx = np.abs(get(p, -1, 0, 2) - get(p, 1, 0, 2)) + np.abs(2 * a - get(p, -2, 0, 2) - get(p, 2, 0, 2))
        gy = np.abs(get(p, 0, -1, 2) - get(p, 0, 1, 2)) + np.abs(2 * a - get(p, 0, -2, 2) - get(p, 0, 2, 2))
        across, down = (get(p, -1, 0, 2) + get(p, 1, 0, 2)) / 2, (get(p, 0, -1, 2) + get(p, 0, 1, 2)) / 2
        green = np.where(red | blue, np.where(gx < gy, across, np.where(gy < gx, down, (across + down) / 2)), a)
        out = {"g": green}
        for name, own in (("r", red), ("b", blue)):
            ratio = np.where(own & (np.abs(green) > 1e-12), a / np.where(np.abs(green) > 1e-12, green, 1), 0.0)
            q, m = np.pad(ratio, 1), np.pad(own.astype(float), 1)
            total = sum(get(q, i, j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1))
            number = sum(get(m, i, j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1))
            out[name] = np.where(own, a, green * total / np.maximum(number, 1))
        return out

    return tiled(px, fn, 4, ["r", "g", "b"])


def cubic_weight(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))


def lanczos_weight(t: np.ndarray, n: int = 4) -> np.ndarray:
    return np.where(np.abs(t) < n, np.sinc(t) * np.sinc(t / n), 0.0)


WEIGHTS = {"linear": (1, lambda t: np.maximum(0, 1 - np.abs(t))), "cubic": (2, cubic_weight), "lanczos": (4, lanczos_weight)}


def sample(a: np.ndarray, sx: np.ndarray, sy: np.ndarray, kind: str = "cubic") -> np.ndarray:
    """Values of ``a`` at fractional positions; NaN outside the frame; edges repeat."""
    reach, weight = WEIGHTS[kind]
    h, w = a.shape
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    total, norm = np.zeros(sx.shape), np.zeros(sx.shape)
    for j in range(1 - reach, reach + 1):
        for i in range(1 - reach, reach + 1):
            k = weight(sx - (x0 + i)) * weight(sy - (y0 + j))
            total += k * a[np.clip(y0 + j, 0, h - 1), np.clip(x0 + i, 0, w - 1)]
            norm += k
    out = total / np.where(np.abs(norm) > 1e-12, norm, 1)
    return np.where((sx < -0.5) | (sy < -0.5) | (sx > w - 0.5) | (sy > h - 0.5), np.nan, out)


def per_frame(px: DataFrame, fn: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """Whole frames through ``fn(frame_id, values)``; the result may have another shape.
    For geometry whose source area isn't known beforehand; a frame must fit a task."""
    kind = px.schema["frame_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        a[y, x] = table.column("v").to_numpy()
        frame = table.column("frame_id")[0].as_py()
        out = fn(frame, a)
        yy, xx = np.mgrid[0 : out.shape[0], 0 : out.shape[1]]
        ok = ~np.isnan(out)
        n = int(ok.sum())
        return pa.table([pa.array([frame] * n, table.schema.field("frame_id").type), pa.array([table.column("c")[0].as_py()] * n, pa.int32()),
                         pa.array(xx[ok].astype(np.int32)), pa.array(yy[ok].astype(np.int32)), pa.array(out[ok])], names=["frame_id", "c", "x", "y", "v"])

    return px.select("frame_id", "c", "x", "y", "v").groupBy(*KEYS).applyInArrow(run, f"frame_id {kind}, c int, x int, y int, v double")


def resample(px: DataFrame, factor: float, kind: str) -> DataFrame:
    def fn(_, a):
        h, w = round(a.shape[0] * factor), round(a.shape[1] * factor)
        yy, xx = np.mgrid[0:h, 0:w]
        return sample(a, (xx + 0.5) / factor - 0.5, (yy + 0.5) / factor - 0.5, kind)

    return per_frame(px, fn)


def warp(px: DataFrame, homography: Callable[[int], np.ndarray], kind: str = "cubic") -> DataFrame:
    """Output (x, y) reads the input at the inverse of the frame's homography."""

    def fn(frame, a):
        inv = np.linalg.inv(homography(frame))
        yy, xx = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
        p = np.tensordot(inv, np.stack([xx, yy, np.ones_like(xx)]).astype(float), axes=1)
        return sample(a, p[0] / p[2], p[1] / p[2], kind)

    return per_frame(px, fn)


def rotate_by(px: DataFrame, degrees: float) -> DataFrame:
    t = math.radians(degrees)

    def fn(_, a):
        cy, cx = (a.shape[0] - 1) / 2, (a.shape[1] - 1) / 2
        yy, xx = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
        dx, dy = xx - cx, yy - cy
        return sample(a, cx + dx * math.cos(t) + dy * math.sin(t), cy - dx * math.sin(t) + dy * math.cos(t), "linear")

    return per_frame(px, fn)


def drizzle(px: DataFrame, scale: float, drop: float, offset: Callable[[int], tuple[float, float]]) -> DataFrame:
    """Shrunk input pixels, shifted by the frame's offset, fall on output cells in
    proportion to their overlap; cells are then summed over frames by one aggregate."""
    kind = px.schema["frame_id"].dataType.simpleString()
    del kind

    def run(batches):
        for batch in batches:
            x, y, v = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2, 4))
            off = np.array([offset(f) for f in batch.column(0).to_pylist()]).reshape(-1, 2)
            cx, cy = (x + 0.5 + off[:, 0]) * scale, (y + 0.5 + off[:, 1]) * scale
            half = drop * scale / 2
            out = []
            reach = int(math.ceil(2 * half)) + 1
            for i in range(reach + 1):
                for j in range(reach + 1):
                    ox, oy = np.floor(cx - half) + i, np.floor(cy - half) + j
                    w = np.clip(np.minimum(cx + half, ox + 1) - np.maximum(cx - half, ox), 0, None) * np.clip(np.minimum(cy + half, oy + 1) - np.maximum(cy - half, oy), 0, None)
                    ok = (w > 0) & (v != 0)
                    out.append((ox[ok], oy[ok], batch.column(3).to_numpy(zero_copy_only=False)[ok], w[ok], (w * v)[ok]))
            cols = [np.concatenate([o[k] for o in out]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3]), pa.array(cols[4])], ["x", "y", "c", "w", "wv"])

    parts = px.select("frame_id", "x", "y", "c", "v").mapInArrow(run, "x int, y int, c int, w double, wv double")
    return parts.groupBy("x", "y", "c").agg((F.sum("wv") / F.sum("w")).alias("v"), F.sum("w").alias("w"))


def hdr_wavescale(px: DataFrame, scales: int = 2, compression: float = 1.5, gamma: float = 1.0) -> DataFrame:
    """Detail planes scaled by a brightness mask, then the old median restored; for single-channel frames."""

    def fn(_, a):
        lum = 100 * np.clip(a, 0, 1)
        *planes, low = atrous_planes(lum, scales)
        mask = np.clip(lum / 100, 0, 1) ** gamma
        out = low + sum(p * (1 + (compression - 1) * mask * 0.5**s) * 2 for s, p in enumerate(planes))
        upper = lambda z: np.sort(z.ravel())[z.size // 2]
        m1 = upper(out)
        return np.clip(out * upper(lum) / (m1 if m1 > 1e-5 else 1.0), 0, 100) / 100

    return per_frame(px, fn)


#: Colours of the six-by-six filter array (0 green, 1 red, 2 blue), by rows: fixed values.
SIX = ((0, 1, 0, 0, 2, 0), (1, 0, 1, 2, 0, 2), (0, 1, 0, 0, 2, 0), (0, 2, 0, 0, 1, 0), (2, 0, 2, 1, 0, 1), (0, 2, 0, 0, 1, 0))


def six_site(x: Column, y: Column) -> Column:
    """Colour number of a position of the six-by-six array."""
    table = F.array(*[F.lit(c) for row in SIX for c in row])
    return F.get(table, (F.pmod(y, F.lit(6)) * 6 + F.pmod(x, F.lit(6))).cast("int"))


def demosaic_six(px: DataFrame) -> DataFrame:
    """``r, g, b`` of a six-by-six filter array: the mean of same-colour sites within two
    pixels, own values kept; the window always holds all three colours inside a frame."""
    s = six_site(F.col("x"), F.col("y"))
    df = px.withColumn("s", s)
    names = {1: "r", 0: "g", 2: "b"}
    for code, name in names.items():
        own = F.col("s") == code
        df = df.withColumns({f"t{name}": F.when(own, F.col("v")).otherwise(0.0), f"n{name}": own.cast("int")})
    for by in ("y", "x"):  # sums of five along rows, then of five along columns
        w = _row(by).rowsBetween(-2, 2)
        df = df.withColumns({c + name: F.sum(c + name).over(w) for c in "tn" for name in names.values()})
    out = [F.when(F.col("s") == code, F.col("v")).when(F.col(f"n{n}") > 0, F.col(f"t{n}") / F.col(f"n{n}")).otherwise(0.0).alias(n) for code, n in names.items()]
    return df.select("frame_id", "x", "y", *out)


def six_equalize(px: DataFrame) -> DataFrame:
    """Red and blue of a six-by-six array scaled to green by the mean of cell means."""
    s = px.withColumn("s", six_site(F.col("x"), F.col("y")))
    cell = s.groupBy(*KEYS, "s", (F.col("x") % 6).alias("i"), (F.col("y") % 6).alias("j")).agg(F.avg("v").alias("m"))
    m = cell.groupBy(*KEYS).agg(*[F.avg(F.when(F.col("s") == k, F.col("m"))).alias(n) for k, n in enumerate(("mg", "mr", "mb"))])
    f = F.when((F.col("s") == 1) & (F.col("mr") > 1e-9), F.col("mg") / F.col("mr")).when((F.col("s") == 2) & (F.col("mb") > 1e-9), F.col("mg") / F.col("mb")).otherwise(1.0)
    return s.join(m, KEYS).withColumn("v", F.col("v") * f).drop("s", "mr", "mg", "mb")


#: Same-colour neighbours that a repair looks at, in row order, and its limit in sigmas: fixed values.
REPAIR_NEIGHBOURS, REPAIR_SIGMAS = 24, 8.0


def repair_six(a: np.ndarray, y0: int, x0: int) -> np.ndarray:
    """Values of a six-by-six array whose corner is at ``y0, x0``: one farther than eight
    sigmas from the median of its first same-colour neighbours within three pixels becomes
    that median. Sigma is 1.4826 times the mean distance to the median, at least 1e-6;
    the three outer rows and columns stay, and all values are judged as they came in."""
    out, r = a.copy(), 3
    steps = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy or dx]
    for py in range(6):
        for px in range(6):
            ys = np.arange(r + (py - y0 - r) % 6, a.shape[0] - r, 6)
            xs = np.arange(r + (px - x0 - r) % 6, a.shape[1] - r, 6)
            if not len(ys) or not len(xs):
                continue
            same = [(dy, dx) for dy, dx in steps if SIX[(py + dy) % 6][(px + dx) % 6] == SIX[py][px]]
            near = np.stack([a[np.ix_(ys + dy, xs + dx)] for dy, dx in same[:REPAIR_NEIGHBOURS]])
            middle = np.median(near, axis=0)
            sigma = np.maximum(1.4826 * np.abs(near - middle).mean(axis=0), 1e-6)
            own = a[np.ix_(ys, xs)]
            out[np.ix_(ys, xs)] = np.where(np.abs(own - middle) > REPAIR_SIGMAS * sigma, middle, own)
    return out


def six_repair(px: DataFrame, tile: int = TILE) -> DataFrame:
    """Outliers of a six-by-six filter array repaired (``repair_six``)."""
    return tiled(px, lambda a, y0, x0: {"v": repair_six(a, y0, x0)}, 3, ["v"], tile)
