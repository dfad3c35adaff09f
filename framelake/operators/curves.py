"""Spectral curves: lookup by name, grids, throughput and synthetic photometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wavelength grid in angstrom.
LOW, HIGH = 3000, 11000
#: Colour index for the start of a spectral type; longer starts first: fixed values.
INDEX = [
    ("O", -0.4), ("B0", -0.3), ("B5", -0.14), ("B", -0.2), ("A0", 0.0), ("A5", 0.15), ("A", 0.1), ("F0", 0.3), ("F5", 0.46), ("F", 0.4),
    ("G0", 0.58), ("G2", 0.64), ("G5", 0.78), ("G", 0.65), ("K0", 0.96), ("K5", 1.41), ("K", 1.1), ("M0", 1.84), ("M5", 2.80), ("M", 2.2),
]


def index_of_type(t: str) -> str:
    """SQL text: colour index of a spectral type, that of G2V if unknown."""
    return "CASE " + " ".join(f"WHEN upper({t}) LIKE '{p}%' THEN CAST({v} AS DOUBLE)" for p, v in INDEX) + " ELSE CAST(0.64 AS DOUBLE) END"


def find(curves: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (name, channel) with the curve found: "name channel", then
    "namechannel", then "name". Three left joins on the name; the first hit wins."""
    c = curves.select(F.col("name").alias("_n"), F.struct(*[k for k in curves.columns if k != "name"]).alias("_c"))
    out = wanted
    has = F.coalesce(F.col("channel"), F.lit("")) != ""
    keys = [F.when(has, F.concat_ws(" ", "name", "channel")), F.when(has, F.concat("name", "channel")), F.col("name")]
    for k, key in enumerate(keys):
        out = out.join(c.select(F.col("_n").alias(f"_n{k}"), F.col("_c").alias(f"_c{k}")), key == F.col(f"_n{k}"), "left")
    return out.select(*wanted.columns, F.coalesce("_n0", "_n1", "_n2").alias("found"), F.coalesce("_c0", "_c1", "_c2").alias("curve"))


def on_grid(curves: DataFrame, step: int = 1) -> DataFrame:
    """``name, w, y``: linear interpolation on the grid; 0 outside a curve.

    Each curve's samples become segments that list the grid points they hold, so
    that no join is needed."""
    s = curves.select("name", F.arrays_zip("wl", "y").alias("p"))
    s = s.select("name", F.posexplode("p").alias("i", "a"), "p").select("name", F.col("a.wl").alias("x1"), F.col("a.y").alias("y1"), F.get("p", F.col("i") + 1).alias("b"))
    s = s.where("b IS NOT NULL AND b.wl > x1").select("name", "x1", "y1", F.col("b.wl").alias("x2"), F.col("b.y").alias("y2"))
    first = F.greatest(F.lit(LOW), F.ceil(F.col("x1") / step).cast("int") * step)
    last = F.least(F.lit(HIGH), (F.ceil(F.col("x2") / step).cast("int") - 1) * step)
    s = s.withColumn("w", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step)))))
    return s.select("name", "w", (F.col("y1") + (F.col("w") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("y"))


def synthetic_flux(source: DataFrame, filters: DataFrame, step: int = 1) -> DataFrame:
    """``source, filter, flux``: trapezoid sums of source times filter over the grid."""
    a = on_grid(source, step).select(F.col("name").alias("source"), "w", F.col("y").alias("s"))
    b = on_grid(filters, step).select(F.col("name").alias("filter"), "w", F.col("y").alias("f"))
    ends = F.when(F.col("w").isin(LOW, HIGH), 0.5).otherwise(1.0)
    return a.join(b, "w").groupBy("source", "filter").agg((F.sum(F.col("s") * F.col("f") * ends) * step).alias("flux"))


def sed_matches(types: DataFrame, names: DataFrame) -> DataFrame:
    """``type, found``: for each type text the sorted names of the best class of matches:
    letter, digit and luminosity; letter and digit; letter and luminosity with the nearest
    digit; letter with the nearest digit."""
    part = lambda c, k: F.regexp_extract(F.upper(F.trim(c)), r"^([OBAFGKMLT])(\d?)((I{1,3}|IV|V)?)", k)
    t = types.select("type", part("type", 1).alias("l"), part("type", 2).alias("d"), part("type", 3).alias("u")).where("l != ''")
    n = names.select("name", part("name", 1).alias("l"), part("name", 2).alias("nd"), part("name", 3).alias("nu")).where("l != ''")
    j = t.join(F.broadcast(n), "l")
    far = F.abs(F.col("d").try_cast("int") - F.col("nd").try_cast("int"))
    same_d, same_u = F.col("d") == F.col("nd"), F.col("u") == F.col("nu")
    rank = (
        F.when((F.col("d") != "") & (F.col("u") != "") & same_d & same_u, 1).when((F.col("d") != "") & (F.col("u") != "") & same_d, 2)
        .when((F.col("d") != "") & (F.col("u") != "") & same_u & far.isNotNull(), F.lit(10) + far).when((F.col("u") != "") & (F.col("d") != ""), F.lit(None).cast("int"))
        .when(F.col("d") != "", F.when(far.isNotNull(), F.lit(10) + far)).when((F.col("u") != "") & same_u, 1).otherwise(30)
    )
    j = j.withColumn("rank", rank).where("rank IS NOT NULL")
    best = j.groupBy("type").agg(F.min("rank").alias("best"))
    return j.join(best, "type").where("rank = best").groupBy("type").agg(F.sort_array(F.collect_set("name")).alias("found"))
