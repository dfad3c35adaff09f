"""Array-shaped views of the driver tables, as DataFrames and as DuckDB SQL.

``px``      one row a pixel of 8x8 frames, from ``embeddings``
``frames``  one row a frame with quality metrics
``rgb``     one row a pixel of colour images: frames of labels 0, 1 and 2 by rank
``depth``   samples of ragged depth for each pixel (part), from ``lineitem``
``stars_a``, ``stars_b``  detections from customers and suppliers
``cat``     a sky catalog from customers
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str, label: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    if label is not None:
        e = e.where(F.col("label") == label)
    e = e.select(F.col("vec_id").alias("frame_id"), "label", F.posexplode("embedding").alias("pos", "e"))
    return e.select(
        "frame_id", "label",
        (F.col("pos") % SIDE).alias("x"), F.floor(F.col("pos") / SIDE).cast("int").alias("y"), F.lit(0).alias("c"),
        (F.lit(0.5) + F.lit(0.5) * F.col("e").cast("double")).alias("v"),
    )


PX = """px AS (
  SELECT vec_id AS frame_id, label, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, 0 AS c,
         0.5::DOUBLE + 0.5::DOUBLE * embedding[i]::DOUBLE AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) t)"""


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img, x, y, r, g, b``: the arrays are joined by rank before pixels are made, so
    the join has one row a frame."""
    e = table(spark, sf_dir, "embeddings").where("label IN (0, 1, 2)")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = e.select("label", rank.alias("img"), "embedding")
    sides = [e.where(F.col("label") == k).select("img", F.col("embedding").alias(n)) for k, n in enumerate("rgb")]
    joined = sides[0].join(sides[1], "img").join(sides[2], "img")
    cells = joined.select("img", F.posexplode(F.arrays_zip("r", "g", "b")).alias("pos", "e"))
    return cells.select(
        "img", (F.col("pos") % SIDE).alias("x"), F.floor(F.col("pos") / SIDE).cast("int").alias("y"),
        *[(F.lit(0.5) + F.lit(0.5) * F.col(f"e.{n}").cast("double")).alias(n) for n in "rgb"],
    )


RGB = """ranked AS (
  SELECT vec_id, label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS img FROM embeddings),
rgb AS (
  SELECT a.img, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y,
         0.5::DOUBLE + 0.5::DOUBLE * a.embedding[i]::DOUBLE AS r, 0.5::DOUBLE + 0.5::DOUBLE * b.embedding[i]::DOUBLE AS g,
         0.5::DOUBLE + 0.5::DOUBLE * d.embedding[i]::DOUBLE AS b
  FROM (SELECT * FROM ranked WHERE label = 0) a JOIN (SELECT * FROM ranked WHERE label = 1) b USING (img)
  JOIN (SELECT * FROM ranked WHERE label = 2) d USING (img), (SELECT unnest(range(1, 65)) AS i) t)"""


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pixel, frame_id, v``: unit prices of a part; samples are numbered by their keys."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("pixel"),
        F.col("l_orderkey").alias("frame_id"),
        (F.col("l_extendedprice") / F.when(F.col("l_quantity") > 0, F.col("l_quantity")) / 1000.0).alias("v"),
    )


DEPTH = """depth AS (
  SELECT l_partkey AS pixel, l_orderkey AS frame_id,
         l_extendedprice / CASE WHEN l_quantity > 0 THEN l_quantity END / 1000.0::DOUBLE AS v FROM lineitem)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_id, label, background, noise, peak, fwhm, roundness, stars, quality``.

    Background is the median pixel, noise the sample deviation; the others are
    simple functions of these, standing in for measured metrics.
    """
    p = px(spark, sf_dir)
    m = p.groupBy("frame_id", "label").agg(
        F.median("v").alias("background"), F.stddev_samp("v").alias("noise"), F.max("v").alias("peak"),
        F.count_if(F.col("v") > 0.55).alias("stars"),
    )
    return m.select("*", *[F.expr(e).alias(n) for n, e in FRAME_METRICS.items()])


FRAME_METRICS = {
    "fwhm": "CASE WHEN frame_id % 17 = 0 THEN 0.0E0 ELSE 1.0E0 + 10.0E0 * noise END",
    "roundness": "CASE WHEN frame_id % 13 = 0 THEN 0.0E0 ELSE 2.0E0 * background - 0.2E0 END",
    "quality": "(peak - background) / noise",
}
FRAMES = (
    PX
    + """,
frames0 AS (
  SELECT frame_id, label, median(v) AS background, stddev_samp(v) AS noise, max(v) AS peak,
         count(*) FILTER (WHERE v > 0.55::DOUBLE) AS stars FROM px GROUP BY frame_id, label),
frames AS (SELECT *, """
    + ", ".join(f"{e} AS {n}" for n, e in FRAME_METRICS.items())
    + " FROM frames0)"
)


def stars(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """``id, x, y, flux``: pseudo positions on a 2000 x 2000 field."""
    if which == "a":
        t, key, bal = table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal"
    else:
        t, key, bal = table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal"
    return t.select(F.col(key).alias("id"), *[F.expr(e.format(key=key, bal=bal)).alias(n) for n, e in STAR_COLUMNS.items()])


STAR_COLUMNS = {
    "x": "(({key} * 7919) % 200000) / 100.0E0",
    "y": "(({key} * 104729) % 200000) / 100.0E0",
    "flux": "1000.0E0 + {bal} / 10.0E0",
}
STARS = ",\n".join(
    f"stars_{w} AS (SELECT {key} AS id, " + ", ".join(f"{e.format(key=key, bal=bal)} AS {n}" for n, e in STAR_COLUMNS.items()) + f" FROM {t})"
    for w, t, key, bal in (("a", "customer", "c_custkey", "c_acctbal"), ("b", "supplier", "s_suppkey", "s_acctbal"))
)


CAT_COLUMNS = {
    "ra": "((c_custkey * 7919) % 360000) / 1000.0E0",
    "dec": "((c_custkey * 104729) % 180000) / 1000.0E0 - 90.0E0",
    "gmag": "8.0E0 + ((c_custkey * 31) % 1500) / 100.0E0",
    "bp_rp": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ((c_custkey * 17) % 350) / 100.0E0 - 0.4E0 END",
    "mag_v": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 8.2E0 + ((c_custkey * 31) % 1500) / 100.0E0 END",
    "mag_b": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 8.9E0 + ((c_custkey * 37) % 1500) / 100.0E0 END",
    "teff": "CASE WHEN c_custkey % 3 = 0 THEN 0.0E0 ELSE 3000.0E0 + (c_custkey * 13) % 9000 END",
    "logd": "0.5E0 + (c_custkey % 20) / 10.0E0",
    "logr": "(c_custkey % 10) / 10.0E0",
}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    return t.select(F.col("c_custkey").alias("id"), *[F.expr(e).alias(n) for n, e in CAT_COLUMNS.items()])


CAT = "cat AS (SELECT c_custkey AS id, " + ", ".join(f"{e} AS {n}" for n, e in CAT_COLUMNS.items()) + " FROM customer)"
