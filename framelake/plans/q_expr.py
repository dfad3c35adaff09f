"""Queries of the per-pixel expression languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import expr
from framelake.functions.spec import clamp
from framelake.plans import views
from framelake.plans.registry import query

#: Another image of the same size: image 1 is the next image of the sequence.
PAIR = views.RGB + """, two AS (SELECT a.*, n.r AS i1_r, n.g AS i1_g, n.b AS i1_b FROM rgb a LEFT JOIN rgb n ON n.img = a.img + 1 AND n.x = a.x AND n.y = a.y)"""


def with_next(spark, d):
    """Left join on (img, x, y); pixels without a partner read 0."""
    a = views.rgb(spark, d)
    n = a.select((F.col("img") - 1).alias("img"), "x", "y", F.col("r").alias("i1_r"), F.col("g").alias("i1_g"), F.col("b").alias("i1_b"))
    return a.join(n, ["img", "x", "y"], "left")


def run_infix(df, text: str, rescale: bool = False):
    """Assigned channels get their values, clamped or mapped by the global minimum and maximum."""
    made = expr.compile_infix(text)
    df = df.withColumns({f"o_{c}": F.expr(made.get(c, c)) for c in "rgb"})
    if not rescale:
        return df.select("img", "x", "y", *[F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"o_{c}"))), 7).alias(c) for c in "rgb"])
    ends = df.agg(F.least(*[F.min(f"o_{c}") for c in "rgb"]).alias("lo"), F.greatest(*[F.max(f"o_{c}") for c in "rgb"]).alias("hi"))
    df = df.crossJoin(F.broadcast(ends))
    scaled = lambda c: F.when(F.col("hi") > F.col("lo"), (F.col(f"o_{c}") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return df.select("img", "x", "y", *[F.round(scaled(c), 7).alias(c) for c in "rgb"])


def sql_infix(cols: dict[str, str], rescale: bool = False) -> str:
    """The same by hand-written expressions in ``cols``."""
    if not rescale:
        return f"WITH {PAIR} SELECT img, x, y, " + ", ".join(f"round({clamp(cols.get(c, c))}, 7) AS {c}" for c in "rgb") + " FROM two"
    o = ", ".join(f"{cols.get(c, c)} AS o_{c}" for c in "rgb")
    return f"""WITH {PAIR}, o AS (SELECT img, x, y, {o} FROM two), e AS (SELECT least(min(o_r), min(o_g), min(o_b)) AS lo, greatest(max(o_r), max(o_g), max(o_b)) AS hi FROM o)
SELECT img, x, y, """ + ", ".join(f"round((o_{c} - lo) / (hi - lo), 7) AS {c}" for c in "rgb") + " FROM o, e"


def every(e: str) -> dict[str, str]:
    return {c: e for c in "rgb"}


CASES: dict[str, tuple[str, dict[str, str], bool]] = {
    "pm_arith": ("(r + g * 2 - b) / 3", every("(r + g * 2 - b) / 3"), False),
    "pm_guards": ("r / (g - g) * 0.5 + b % 0", every("0.5::DOUBLE"), False),
    "pm_power": ("-r ^ 2 + g ^ 0.5 + ~b * 0.1", every("pow(-r, 2) + pow(g, 0.5::DOUBLE) + (1 - b) * 0.1::DOUBLE"), False),
    "pm_funcs": ("abs(sin(r)) * 0.3 + ln(1 + g) * 0.5 + sqrt(b - 0.9) + atan2(r, g) * 0.1",
                 every("abs(sin(r)) * 0.3::DOUBLE + ln(1 + g) * 0.5::DOUBLE + sqrt(greatest(0, b - 0.9::DOUBLE)) + atan2(r, g) * 0.1::DOUBLE"), False),
    "pm_logs": ("(log(r) + log10(r - r) + log2(g)) / -400", every("(log10(r) + log10(1e-300::DOUBLE) + log2(g)) / -400"), False),
    "pm_rounding": ("(floor(r * 10) + ceil(g * 10) + trunc(b * 10) + sign(r - g)) / 40",
                    every("(floor(r * 10) + ceil(g * 10) + trunc(b * 10) + sign(r - g)) / 40.0::DOUBLE"), False),
    "pm_hyper": ("tanh(r) + sinh(g) * 0.1 - cosh(b) * 0.1 + exp(-r) * 0.1", every("tanh(r) + sinh(g) * 0.1::DOUBLE - cosh(b) * 0.1::DOUBLE + exp(-r) * 0.1::DOUBLE"), False),
    "pm_logic": ("(r > 0.5 && g <= 0.5) || !(b != b)", every("CASE WHEN (r > 0.5::DOUBLE AND g <= 0.5::DOUBLE) OR true THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"), False),
    "pm_iif": ("iif(r > g, r, g * 0.5)", every("CASE WHEN r > g THEN r ELSE g * 0.5::DOUBLE END"), False),
    "pm_mtf": ("mtf(0.3, r) * 0.5 + gamma(g, 2.2) * 0.25 + clamp(b, 0.4, 0.6) * 0.25",
               every("(0.3::DOUBLE - 1) * r / ((2 * 0.3::DOUBLE - 1) * r - 0.3::DOUBLE) * 0.5::DOUBLE + pow(greatest(0, g), 2.2::DOUBLE) * 0.25::DOUBLE + least(0.6::DOUBLE, greatest(0.4::DOUBLE, b)) * 0.25::DOUBLE"), False),
    "pm_channels": ("R = max(r, b); B = min(g, pi / 4)", {"r": "greatest(r, b)", "b": "least(g, pi() / 4)"}, False),
    "pm_images": ("(r + I1) / 2 + I1.g * 0.1", {c: f"(r + coalesce(i1_{c}, 0)) / 2 + coalesce(i1_g, 0) * 0.1::DOUBLE" for c in "rgb"}, False),
    "pm_rescale": ("r * 4 - g", every("r * 4 - g"), True),
}
for _name, (_text, _cols, _rescale) in CASES.items():
    query(_name, sql_infix(_cols, _rescale))(lambda spark, d, t=_text, k=_rescale: run_infix(with_next(spark, d), t, k))


@query("pm_script", f"""WITH {PAIR} SELECT img, x, y, round(CASE WHEN i1_r IS NULL OR i1_r = 0 THEN 0 ELSE ((1 - r) * 0.5::DOUBLE + g) / i1_r END + least(g, b) - 0.25::DOUBLE, 7) AS v FROM two""")
def pm_script(spark, d):
    text = "(~$red$ * 0.5 + $green$) / $next$ + min($green$, $blue$) - 0.25"
    columns = {"red": "r", "green": "g", "blue": "b", "next": "coalesce(i1_r, 0.0E0)"}
    return with_next(spark, d).select("img", "x", "y", F.round(F.expr(expr.compile_script(text, columns.__getitem__)), 7).alias("v"))
