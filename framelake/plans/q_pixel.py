"""Queries of pointwise transforms and masks; one definition gives plan and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions.spec import Transform
from framelake.operators import pointwise as p
from framelake.plans import views
from framelake.plans.registry import query

KEYS = ["img", "x", "y"]
PAIR_SQL = views.RGB + ", pair AS (SELECT img, x, y, r AS u, g AS t, b AS o, r AS v, b AS m FROM rgb)"


def add(name: str, t: Transform, view: str = "rgb") -> None:
    if view == "rgb":
        query(name, t.sql(views.RGB, "rgb", KEYS))(lambda spark, d: t.apply(views.rgb(spark, d), KEYS, 7))
    else:
        def run(spark, d):
            rgb = views.rgb(spark, d)
            pair = rgb.select(*KEYS, F.col("r").alias("u"), F.col("g").alias("t"), F.col("b").alias("o"), F.col("r").alias("v"), F.col("b").alias("m"))
            return t.apply(pair, KEYS, 7)

        query(name, t.sql(PAIR_SQL, "pair", KEYS))(run)


QUERIES = {
    "px_multiply": p.multiply(1.3), "px_subtract": p.subtract(0.1, 0.05, 0.02), "px_offset": p.offset(0.1), "px_negative": p.negative(),
    "px_threshold": p.threshold(0.4, 0.6), "white_balance": p.white_balance(1.2, 1.0, 0.8), "temperature_tint": p.white_balance(*p.temperature_gains(0.3, -0.2), protect=False),
    "scnr_average": p.scnr(0.8), "scnr_maximum": p.scnr(0.8, "maximum"), "scnr_minimum": p.scnr(0.5, "minimum"), "magenta": p.magenta(0.4, 0.45),
    "saturation": p.saturation(1.6, 1.0), "saturation_hue": p.saturation(1.8, 0.5, 120.0, 90.0, 30.0), "luma_saturation": p.luma_saturation(1.4),
    "asinh": p.asinh_stretch(5.0), "asinh_colour": p.asinh_colour(8.0, 0.1), "mtf": p.mtf(0.3), "autostretch": p.autostretch(),
    "true_stretch": p.true_stretch(), "luma_stretch": p.luma_stretch(), "hdr_compress": p.hdr_compress(), "hdr_luma": p.hdr_compress_luma(),
    "high_range": p.high_range(), "curves": p.curves(), "spline": p.spline([0.0, 0.25, 0.6, 1.0], [0.0, 0.35, 0.7, 1.0]),
    "ghs_log": p.ghs(b=-1.0), "ghs_negative": p.ghs(b=-0.5, lp=0.1), "ghs_exponential": p.ghs(b=0.0), "ghs_positive": p.ghs(b=2.0, lp=0.05),
    "ghs_asinh": p.ghs("asinh"), "ghs_inverse_log": p.ghs("inverse", b=-1.0), "ghs_inverse_negative": p.ghs("inverse", b=-0.5), "ghs_inverse_exponential": p.ghs("inverse"),
    "ghs_inverse_positive": p.ghs("inverse", b=2.0), "ghs_inverse_asinh": p.ghs("inverse_asinh"), "ghs_luma": p.ghs(b=1.0, colour="weighted"), "ghs_even_luma": p.ghs(b=1.0, colour="even"),
    "star_stretch": p.star_stretch(), **{f"display_{m}": p.display(m) for m in ("linear", "sqrt", "log", "asinh", "invert")},
    "colour_factors": p.colour_factors((1.1, 1.0, 0.9), (0.05, 0.06, 0.04)), "to_hsl": p.hsl(), "to_hsv": p.hsv(), "to_lab": p.lab(),
    "exposure_chain": p.exposure_chain(), "selective_colour": p.selective_colour(60.0, 200.0, 20.0, cmy=(0.1, 0, 0.05), rgb=(0, 0.1, 0), lum=0.05, contrast=0.2, sat=0.3),
    **{f"palette_{n.lower()}": p.palette(n) for n in (*p.PERMUTATIONS, "Foraxx", "Realistic1", "Realistic2")},
    "nb_normalize_sho": p.nb_normalize(), "nb_normalize_hoo": p.nb_normalize(mode=0, scenario="HOO"), "nb_normalize_hso": p.nb_normalize(scenario="HSO", lightness=False),
    "nb_stars": p.nb_stars(), **{f"luminance_{k}": p.luminance(k) for k in ("rec709", "rec601", "rec2020", "average", "max", "median", "snr")},
    "recombine_hsv": p.recombine_luminance(), "recombine_luma": p.recombine_luminance("luma"), "remove_pedestal": p.remove_pedestal(), "continuum": p.continuum(),
    "anscombe": p.anscombe(), "anscombe_inverse": p.anscombe(False), "soft_threshold": p.soft_threshold(0.05), "grain": p.grain(),
    "mask_range": p.range_mask(0.4, 0.6, 0.1), "mask_chroma": p.chroma_mask(), **{f"mask_{c}": p.colour_mask(c) for c in ("red", "green", "blue")},
    "mask_feather": p.feather_mask(8, 3.0), "mask_polygon": p.polygon_mask([(0.5, 0.5), (6.5, 1.5), (5.5, 6.5), (1.5, 5.5)]),
}
for _name, _t in QUERIES.items():
    add(_name, _t)
for _mode in p.BLENDS:
    add(f"blend_{_mode}", p.blend(_mode), "pair")
add("blend_hard_range", p.blend("screen", feather=0.0), "pair")
add("star_recompose", p.recompose(), "pair")
add("mask_blend", p.mask_blend(opacity=0.8), "pair")
add("mask_blend_protect", p.mask_blend(protect=True), "pair")
