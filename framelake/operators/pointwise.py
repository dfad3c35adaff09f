"""Pointwise transforms of colour (r, g, b) and single-channel (v) pixels.

Every function returns a ``Transform``. Colour transforms read columns r, g, b;
narrowband ones take r, g, b as H-alpha, O-III and S-II.
"""

from __future__ import annotations

import math

from framelake.functions.spec import Layer, Transform, clamp, num, one, steps

REC709 = (0.2126, 0.7152, 0.0722)
REC601 = (0.299, 0.587, 0.114)
REC2020 = (0.2627, 0.6780, 0.0593)
RGB = ("r", "g", "b")


def each(template: str, names: tuple[str, ...] = RGB) -> dict[str, str]:
    return {n: template.replace("#", n) for n in names}


def luma(weights: tuple[float, float, float], names: tuple[str, ...] = RGB) -> str:
    return "(" + " + ".join(f"{num(w)} * {n}" for w, n in zip(weights, names)) + ")"


def smooth(t: str) -> str:
    t = clamp(t)
    return f"({t} * {t} * ({num(3)} - {num(2)} * {t}))"


def mtf_expr(m: str, x: str) -> str:
    """Midtones transfer; 0 and 1 saturate, a midtone outside (0, 1) saturates too."""
    den = f"((2.0E0 * ({m}) - 1.0E0) * ({x}) - ({m}))"
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0E0 WHEN ({x}) >= 1 THEN 1.0E0 WHEN ({m}) <= 0 THEN 0.0E0 WHEN ({m}) >= 1 THEN ({x}) WHEN abs({den}) < 1.0E-15 THEN ({x}) ELSE (({m}) - 1.0E0) * ({x}) / {den} END)"


def multiply(f: float) -> Transform:
    return one(**each(f"# * {num(f)}"))


def subtract(r: float, g: float, b: float) -> Transform:
    return one(r=f"r - {num(r)}", g=f"g - {num(g)}", b=f"b - {num(b)}")


def offset(k: float) -> Transform:
    return one(**each(f"# + {num(k)}"))


def negative() -> Transform:
    return one(**each("1.0E0 - #"))


def threshold(lo: float = 0.0, hi: float = 1.0) -> Transform:
    return one(**each(f"CASE WHEN # < {num(lo)} THEN 0.0E0 WHEN # > {num(hi)} THEN 1.0E0 ELSE # END"))


def white_balance(r: float, g: float, b: float, protect: bool = True) -> Transform:
    L = luma(REC709)
    w = f"{smooth(f'{L} / 0.5E0')} * (1.0E0 - {smooth(f'({L} - 0.5E0) / 0.5E0')})" if protect else "1.0E0"
    return steps({"w": w}, out={n: clamp(f"{n} * (1.0E0 + ({num(k)} - 1.0E0) * w)") for n, k in zip(RGB, (r, g, b))})


def temperature_gains(temperature: float, tint: float) -> tuple[float, float, float]:
    green = max(0.01, 1 - 0.5 * tint)
    return max(0.01, (1 + 0.5 * temperature) * (1 + 0.15 * tint)), green, max(0.01, (1 - 0.5 * temperature) * (1 + 0.15 * tint))


def scnr(amount: float, mode: str = "average") -> Transform:
    ref = {"average": "(r + b) / 2.0E0", "maximum": "greatest(r, b)", "minimum": "least(r, b)"}[mode]
    return one(r="r", g=f"g - {num(amount)} * greatest(0.0E0, g - {ref})", b="b")


def hue_columns(names: tuple[str, ...] = RGB) -> list[dict[str, str]]:
    """Layers with mx, mn, chroma, hue in [0, 1) and saturation (HSV)."""
    r, g, b = names
    h = (
        f"CASE WHEN chroma <= 0 THEN 0.0E0 WHEN mx = {r} THEN ({g} - {b}) / chroma + CASE WHEN {g} < {b} THEN 6.0E0 ELSE 0.0E0 END "
        f"WHEN mx = {g} THEN ({b} - {r}) / chroma + 2.0E0 ELSE ({r} - {g}) / chroma + 4.0E0 END / 6.0E0"
    )
    h = f"({h.replace(' END / 6.0E0', ' END')}) / 6.0E0"
    return [
        {"mx": f"greatest({r}, {g}, {b})", "mn": f"least({r}, {g}, {b})"},
        {"chroma": "mx - mn"},
        {"hue": h, "sat": "CASE WHEN mx > 0 THEN chroma / mx ELSE 0.0E0 END"},
    ]


def magenta(mod_b: float, thr: float) -> Transform:
    blue = clamp(f"b * {num(mod_b)} + g * {num(1 - mod_b)}")
    return steps(*hue_columns(), out={"r": "r", "g": "g", "b": f"CASE WHEN hue >= 0.4E0 AND hue <= 0.99E0 AND {luma(REC601)} > {num(thr)} THEN {blue} ELSE b END"})


def saturation(amount: float, bg_factor: float, centre: float = 0.0, width: float = 360.0, soft: float = 30.0) -> Transform:
    half = width / 2
    weight = "1.0E0"
    layers = [{"lum": "(r + g + b) / 3.0E0"}]
    if width < 359:
        layers.append({"deg": f"atan2({num(math.sqrt(3))} * (g - b), 2.0E0 * r - g - b) * {num(180 / math.pi)}"})
        layers.append({"apart": f"abs(CASE WHEN deg < 0 THEN deg + 360.0E0 ELSE deg END - {num(centre)})"})
        layers.append({"dist": "CASE WHEN apart > 180 THEN 360.0E0 - apart ELSE apart END"})
        weight = clamp(f"1.0E0 - (dist - {num(half)}) / {num(soft)}")
    layers.append({"boost": f"greatest(0.0E0, 1.0E0 + {num(amount - 1)} * pow({clamp('lum')}, {num(bg_factor)}) * {weight})"})
    return steps(*layers, out=each("greatest(0.0E0, least(greatest(r, g, b, 1.0E0), lum + (# - lum) * boost))"))


def luma_saturation(f: float) -> Transform:
    return steps({"lum": luma(REC709)}, out=each(clamp(f"lum + {num(f)} * (# - lum)")))


def asinh_stretch(k: float) -> Transform:
    return one(**each(clamp(f"asinh({num(k)} * #) / {num(math.asinh(k))}")))


def asinh_colour(k: float, black: float, human: bool = True) -> Transform:
    w = REC709 if human else (0.3333, 0.3333, 0.3333)
    ready = {f"{n}p": f"greatest(0.0E0, ({n} - {num(black)}) / {num(1 - black)})" for n in RGB}
    x = luma(w, ("rp", "gp", "bp"))
    gain = f"CASE WHEN lx <= 1.0E-9 THEN 0.0E0 ELSE asinh({num(k)} * lx) / (greatest(lx, 1.0E-9) * {num(math.asinh(k))}) END"
    return steps(ready, {"lx": x}, {"gain": gain}, out=each(clamp("#p * gain")))


def mtf(m: float) -> Transform:
    return one(**each(mtf_expr(num(m), "#")))


def autostretch(target: float = 0.25, shadows: float = -2.8) -> Transform:
    """Per channel: shadows at median + ``shadows`` * 1.4826 * MAD, midtone to reach the target."""
    layers = [Layer({}, {f"m{n}": f"median({n})" for n in RGB}), Layer({}, {f"d{n}": f"median(abs({n} - m{n}))" for n in RGB}),
              Layer({f"s{n}": f"greatest(0.0E0, m{n} + {num(shadows)} * 1.4826E0 * d{n})" for n in RGB}),
              Layer({f"t{n}": mtf_expr(num(target), f"(m{n} - s{n})") for n in RGB})]
    return Transform(tuple(layers), {n: mtf_expr(f"t{n}", f"(({n} - s{n}) / greatest(1.0E0 - s{n}, 1.0E-9))") for n in RGB})


def stretch_expr(x: str, med: str, target: float) -> str:
    t = num(target)
    den = f"({med} * ({t} + ({x}) - 1.0E0) - {t} * ({x}))"
    return clamp(f"CASE WHEN abs({den}) < 1.0E-6 THEN ({x}) ELSE ({med} - 1.0E0) * {t} * ({x}) / {den} END")


def true_stretch(target: float = 0.25, sigma: float = 5.0) -> Transform:
    """Per channel rational stretch; the noise is that of the lower half."""
    layers = [Layer({}, {f"m{n}": f"median({n})" for n in RGB} | {f"n{n}": f"min({n})" for n in RGB})]
    layers.append(Layer({}, {f"lm{n}": f"median(CASE WHEN {n} <= m{n} THEN {n} END)" for n in RGB}))
    layers.append(Layer({}, {f"sd{n}": f"1.4826E0 * median(CASE WHEN {n} <= m{n} THEN abs({n} - lm{n}) END)" for n in RGB}))
    layers.append(Layer({f"bp{n}": f"least(0.99E0, greatest(n{n}, m{n} - {num(sigma)} * sd{n}))" for n in RGB}))
    layers.append(Layer({f"md{n}": clamp(f"(m{n} - bp{n}) / (1.0E0 - bp{n})", 1e-6, 1 - 1e-6) for n in RGB} | {f"x{n}": f"greatest(0.0E0, ({n} - bp{n}) / (1.0E0 - bp{n}))" for n in RGB}))
    return Transform(tuple(layers), {n: stretch_expr(f"x{n}", f"md{n}", target) for n in RGB})


def luma_stretch(target: float = 0.25) -> Transform:
    """The stretch of the luminance; colours scale by its ratio."""
    return Transform(
        (Layer({"lum": luma(REC709)}), Layer({}, {"ml": "median(lum)", "nl": "min(lum)"}),
         Layer({"lx": "greatest(0.0E0, (lum - nl) / (1.0E0 - nl))", "md": clamp("(ml - nl) / (1.0E0 - nl)", 1e-6, 1 - 1e-6)}),
         Layer({"ratio": f"CASE WHEN lum > 1.0E-10 THEN {stretch_expr('lx', 'md', target)} / lum ELSE 0.0E0 END"})),
        each(clamp("# * ratio")))


def hermite(y: str, amount: float, knee: float) -> str:
    m1 = min(5.0, max(1.0, 1 + 4 * amount))
    t = clamp(f"(({y}) - {num(knee)}) / {num(1 - knee)}")
    f = clamp(f"{t} * {t} * {t} - 2.0E0 * {t} * {t} + {t} - 2.0E0 * {t} * {t} * {t} + 3.0E0 * {t} * {t} + {num(m1)} * ({t} * {t} * {t} - {t} * {t})")
    return f"{num(knee)} + {num(1 - knee)} * {f}"


def hdr_compress(amount: float = 0.5, knee: float = 0.6) -> Transform:
    return one(**each(clamp(f"CASE WHEN # > {num(knee)} THEN {hermite('#', amount, knee)} ELSE # END")))


def hdr_compress_luma(amount: float = 0.5, knee: float = 0.5) -> Transform:
    return steps({"lum": luma(REC709)}, {"gain": f"CASE WHEN lum > {num(knee)} THEN ({hermite('lum', amount, knee)}) / lum END"},
                 out=each(f"CASE WHEN gain IS NULL THEN # ELSE {clamp('# * gain')} END"))


def high_range(target: float = 0.25, floor_sigma: float = 2.7, soft: float = 0.99, hard: float = 0.9999, pedestal: float = 0.001, knee: float = 0.9) -> Transform:
    """Percentile ceilings and a robust floor, midtones to the target, soft clip."""
    return Transform(
        (Layer({"lum": luma(REC709)}),
         Layer({}, {"ml": "median(lum)", "nl": "min(lum)", "sc": f"quantile(lum, {soft})", "hc": f"quantile(lum, {hard})"}),
         Layer({}, {"lm": "median(CASE WHEN lum <= ml THEN lum END)"}),
         Layer({}, {"sd": "1.4826E0 * median(CASE WHEN lum <= ml THEN abs(lum - lm) END)"}),
         Layer({"fl": f"greatest(ml - {num(floor_sigma)} * sd, nl)"}),
         Layer({"s1": "greatest(sc, fl + 1.0E-6)"}), Layer({"h1": "greatest(hc, s1 + 1.0E-6)"}),
         Layer({"k": f"least({num(0.98 - pedestal)} / (s1 - fl), {num(1 - pedestal)} / (h1 - fl))"}),
         Layer({f"{n}s": clamp(f"({n} - fl) * k + {num(pedestal)}") for n in RGB}),
         Layer({}, {"now": "median(rs)"}),
         Layer({"m": f"CASE WHEN now > 0 AND now < 1 THEN (now * ({num(target)} - 1.0E0)) / ((2.0E0 * {num(target)} - 1.0E0) * now - {num(target)}) ELSE 0.5E0 END"}),
         Layer({f"{n}m": mtf_expr("m", f"{n}s") for n in RGB})),
        each(clamp(f"CASE WHEN #m > {num(knee)} THEN {hermite('#m', 1.0, knee)} ELSE #m END")))


def piecewise(x: str, xs: list[float], ys: list[float]) -> str:
    """Linear interpolation between knots; constant outside."""
    text = num(ys[-1])
    for i in reversed(range(len(xs) - 1)):
        seg = f"{num(ys[i])} + ({x} - {num(xs[i])}) * {num((ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]))}"
        text = f"CASE WHEN {x} <= {num(xs[i + 1])} THEN {seg} ELSE {text} END"
    return f"CASE WHEN {x} <= {num(xs[0])} THEN {num(ys[0])} ELSE {text} END"


def curves(target: float = 0.25, boost: float = 0.3) -> Transform:
    p3, p4 = 0.25 * (1 - target) + target, 0.75 * (1 - target) + target
    xs = [0.0, 0.5 * target, target, p3, p4, 1.0]
    ys = [0.0, 0.5 * target, target, p3 ** (1 - boost), (p4 ** (1 - boost)) ** (1 - boost), 1.0]
    return one(**each(clamp(piecewise(clamp("#"), xs, ys))))


def natural_spline(xs: list[float], ys: list[float]) -> list[tuple[float, float, float, float, float]]:
    """(x, a, b, c, d) of each cubic of a natural spline."""
    n = len(xs) - 1
    h = [xs[i + 1] - xs[i] for i in range(n)]
    lower, diag, upper, rhs = [0.0] * (n + 1), [1.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(1, n):
        lower[i], diag[i], upper[i] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 3 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
    for i in range(1, n + 1):
        f = lower[i] / diag[i - 1]
        diag[i] -= f * upper[i - 1]
        rhs[i] -= f * rhs[i - 1]
    c = [0.0] * (n + 1)
    c[n] = rhs[n] / diag[n]
    for i in reversed(range(n)):
        c[i] = (rhs[i] - upper[i] * c[i + 1]) / diag[i]
    return [(xs[i], ys[i], (ys[i + 1] - ys[i]) / h[i] - h[i] * (2 * c[i] + c[i + 1]) / 3, c[i], (c[i + 1] - c[i]) / (3 * h[i])) for i in range(n)]


def spline(xs: list[float], ys: list[float]) -> Transform:
    text = ""
    for x0, a, b, c, d in natural_spline(xs, ys):
        t = f"(# - {num(x0)})"
        seg = f"{num(a)} + {t} * ({num(b)} + {t} * ({num(c)} + {t} * {num(d)}))"
        text = seg if not text else f"CASE WHEN # < {num(x0)} THEN {text} ELSE {seg} END"
    whole = f"CASE WHEN # <= {num(xs[0])} THEN {num(ys[0])} WHEN # >= {num(xs[-1])} THEN {num(ys[-1])} ELSE {text} END"
    return one(**each(clamp(whole)))


def ghs_expr(x: str, kind: str, b: float, d: float, lp: float, sp: float, hp: float) -> str:
    """Generalised hyperbolic stretch. A primitive q grows from the symmetry point with
    slope q'; tangents continue it below ``lp`` and above ``hp``; the whole is scaled to
    map 0 to 0 and 1 to 1. ``kind`` is normal, asinh, or an inverse of these."""

    def primitive(t: str) -> str:
        if kind.endswith("asinh"):
            return f"asinh({num(d)} * ({t}))"
        if b == -1:
            return f"ln(1.0E0 + {num(d)} * ({t}))"
        if b == 0:
            return f"(1.0E0 - exp({num(-d)} * ({t})))"
        if b < 0:
            return f"((pow(1.0E0 + {num(-d * b)} * ({t}), {num((-b - 1) / -b)}) - 1.0E0) / {num(-b - 1)})"
        return f"(1.0E0 - pow(1.0E0 + {num(d * b)} * ({t}), {num(-1 / b)}))"

    def value(t: float) -> float:
        if kind.endswith("asinh"):
            return math.asinh(d * t)
        if b == -1:
            return math.log1p(d * t)
        if b == 0:
            return 1 - math.exp(-d * t)
        if b < 0:
            return ((1 - d * b * t) ** ((-b - 1) / -b) - 1) / (-b - 1)
        return 1 - (1 + d * b * t) ** (-1 / b)

    def slope(t: float) -> float:
        if kind.endswith("asinh"):
            return d / math.sqrt(d * d * t * t + 1)
        if b == -1:
            return d / (1 + d * t)
        if b == 0:
            return d * math.exp(-d * t)
        if b < 0:
            return d * (1 - d * b * t) ** (1 / b)
        return d * (1 + d * b * t) ** (-(1 + b) / b)

    q_lp, q_hp, s_lp, s_hp = -value(sp - lp), value(hp - sp), slope(sp - lp), slope(hp - sp)
    q0, q1 = q_lp - s_lp * lp, q_hp + s_hp * (1 - hp)
    scale = 1 / (q1 - q0)
    if not kind.startswith("inverse"):
        return (
            f"CASE WHEN {x} < {num(lp)} THEN {num(s_lp * scale)} * {x} "
            f"WHEN {x} < {num(sp)} THEN (-{primitive(f'{num(sp)} - {x}')} - ({num(q0)})) * {num(scale)} "
            f"WHEN {x} < {num(hp)} THEN ({primitive(f'{x} - {num(sp)}')} - ({num(q0)})) * {num(scale)} "
            f"ELSE ({num(q_hp)} + {num(s_hp)} * ({x} - {num(hp)}) - ({num(q0)})) * {num(scale)} END"
        )

    def back(q: str) -> str:
        """The distance from the symmetry point whose primitive is q >= 0."""
        if kind.endswith("asinh"):
            return f"sinh({q}) / {num(d)}"
        if b == -1:
            return f"(exp({q}) - 1.0E0) / {num(d)}"
        if b == 0:
            return f"-ln(1.0E0 - ({q})) / {num(d)}"
        if b < 0:
            return f"(pow(1.0E0 + {num(-b - 1)} * ({q}), {num(-b / (-b - 1))}) - 1.0E0) / {num(-d * b)}"
        return f"(pow(1.0E0 - ({q}), {num(-b)}) - 1.0E0) / {num(d * b)}"

    y = f"(({x}) / {num(scale)} + ({num(q0)}))"
    return (
        f"CASE WHEN {y} < {num(q_lp)} THEN {num(lp)} + ({y} - ({num(q_lp)})) / {num(s_lp)} "
        f"WHEN {y} < 0 THEN {num(sp)} - {back(f'-{y}')} WHEN {y} < {num(q_hp)} THEN {num(sp)} + {back(y)} "
        f"ELSE {num(hp)} + ({y} - {num(q_hp)}) / {num(s_hp)} END"
    )


def ghs(kind: str = "normal", b: float = 0.0, d: float = 3.0, lp: float = 0.0, sp: float = 0.2, hp: float = 0.9, bp: float = 0.0, colour: str = "independent") -> Transform:
    x = {n: f"greatest(0.0E0, ({n} - {num(bp)}) / {num(1 - bp)})" for n in RGB}
    ready = {f"{n}x": e for n, e in x.items()}
    if colour == "independent":
        return steps(ready, out={n: clamp(ghs_expr(f"{n}x", kind, b, d, lp, sp, hp)) for n in RGB})
    w = REC709 if colour == "weighted" else (1 / 3, 1 / 3, 1 / 3)
    return steps(ready, {"lx": luma(w, ("rx", "gx", "bx"))}, {"ratio": f"CASE WHEN lx > 0 THEN ({ghs_expr('lx', kind, b, d, lp, sp, hp)}) / lx ELSE 0.0E0 END"},
                 {f"{n}z": f"{n}x * ratio" for n in RGB}, out=each(clamp("#z")))


def star_stretch(amount: float = 1.5, boost: float = 1.2, green: bool = True) -> Transform:
    f = 3.0**amount
    layers = [{f"{n}s": f"{num(f)} * {n} / ({num(f - 1)} * {n} + 1.0E0)" for n in RGB}, {"lum": "(rs + gs + bs) / 3.0E0"},
              {f"{n}t": clamp(f"lum + ({n}s - lum) * {num(boost)}") for n in RGB}]
    return steps(*layers, out={"r": "rt", "g": "least(gt, (rt + bt) / 2.0E0)" if green else "gt", "b": "bt"})


def display(mode: str) -> Transform:
    e = {"linear": "#", "sqrt": "sqrt(greatest(0.0E0, #))", "log": f"ln(1.0E0 + 1000.0E0 * greatest(0.0E0, #)) / {num(math.log(1001))}",
         "asinh": f"asinh(10.0E0 * #) / {num(math.asinh(10))}", "invert": "1.0E0 - #"}[mode]
    return one(**each(clamp(e)))


def colour_factors(k: tuple[float, float, float], black: tuple[float, float, float]) -> Transform:
    """v * k + mean of channels' (black - black * k)."""
    mean = sum(black) / 3
    return one(**{n: clamp(f"{n} * {num(f)} + ({num(mean - bl * f)})") for n, f, bl in zip(RGB, k, black)})


def hsl() -> Transform:
    return steps(*hue_columns(), {"l": "(mx + mn) / 2.0E0"},
                 out={"h": "hue", "s": "CASE WHEN chroma <= 0 THEN 0.0E0 ELSE chroma / greatest(1.0E-12, 1.0E0 - abs(2.0E0 * l - 1.0E0)) END", "l": "l"})


def hsv() -> Transform:
    return steps(*hue_columns(), out={"h": "hue", "s": "sat", "v": "mx"})


# sRGB to CIE XYZ (D65) and its white point: fixed values
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def lab_layers(names: tuple[str, ...] = RGB) -> list[dict[str, str]]:
    f = {k: luma(m, names) + f" / {num(w)}" for k, m, w in zip(("fx", "fy", "fz"), XYZ, WHITE)}
    root = lambda t: f"CASE WHEN {t} > 0.008856E0 THEN pow({t}, {num(1 / 3)}) ELSE 7.787E0 * {t} + {num(16 / 116)} END"
    return [{f"{k}0": e for k, e in f.items()}, {k: root(f"{k}0") for k in f}]


def lab() -> Transform:
    return steps(*lab_layers(), out={"l": "116.0E0 * fy - 16.0E0", "a": "500.0E0 * (fx - fy)", "bb": "200.0E0 * (fy - fz)"})


def exposure_chain(stops: float = 0.5, vibrance: float = 0.3, vignette: float = 0.4) -> Transform:
    """Exposure, filmic curve, vibrance, vignette about the centre of an 8x8 frame."""
    filmic = f"CASE WHEN #e <= 0 THEN 0.0E0 ELSE #e * (2.51E0 * #e + 0.03E0) / (#e * (2.43E0 * #e + 0.59E0) + 0.14E0) END"
    layers = [{f"{n}e": f"{n} * {num(2**stops)}" for n in RGB}, {f"{n}f": clamp(filmic.replace("#", n)) for n in RGB},
              {"mx": "greatest(rf, gf, bf)", "mn": "least(rf, gf, bf)", "lum": luma(REC709, ("rf", "gf", "bf"))},
              {"amt": f"1.0E0 + {num(vibrance)} * (1.0E0 - (mx - mn))", "rad": "((x - 3.5E0) * (x - 3.5E0) + (y - 3.5E0) * (y - 3.5E0)) / 24.5E0"}]
    return steps(*layers, out=each(clamp(f"(lum + (#f - lum) * amt) * (1.0E0 - {num(vignette)} * rad)")))


def hue_band(start: float, end: float, soft: float, min_chroma: float = 0.0) -> str:
    """Weight of a hue band in degrees, with linear falloff on both sides."""
    length = (end - start) % 360 or 360.0
    ahead = f"(hue * 360.0E0 - {num(start)} - 360.0E0 * floor((hue * 360.0E0 - {num(start)}) / 360.0E0))"
    after = f"({ahead} - {num(length)})"
    before = f"(360.0E0 - {ahead})"
    return f"CASE WHEN chroma < {num(min_chroma)} THEN 0.0E0 WHEN {ahead} <= {num(length)} THEN 1.0E0 ELSE greatest(0.0E0, 1.0E0 - least({after}, {before}) / {num(max(soft, 1e-9))}) END"


def selective_colour(start: float, end: float, soft: float, *, cmy=(0.0, 0.0, 0.0), rgb=(0.0, 0.0, 0.0), lum: float = 0.0, contrast: float = 0.0, sat: float = 0.0, min_chroma: float = 0.05) -> Transform:
    layers = [*hue_columns(), {"w": hue_band(start, end, soft, min_chroma)}]
    layers.append({f"{n}1": clamp(f"{clamp(f'{n} - {num(c)} * w')} + {num(a)} * w") for n, c, a in zip(RGB, cmy, rgb)})
    layers.append({f"{n}2": clamp(f"({clamp(f'{n}1 + {num(lum)} * w')} - 0.5E0) * (1.0E0 + {num(contrast)} * w) + 0.5E0") for n in RGB})
    layers.append({"gray": luma(REC601, ("r2", "g2", "b2"))})
    return steps(*layers, out=each(f"CASE WHEN w < 0.001E0 THEN # ELSE {clamp(f'gray + (#2 - gray) * (1.0E0 + {num(sat)} * w)')} END"))


PERMUTATIONS = {"SHO": "brg", "HOO": "rgg", "HSO": "rbg", "HOS": "rgb", "OSS": "gbb", "OHH": "grr", "OSH": "gbr", "OHS": "grb", "HSS": "rbb"}


def palette(name: str) -> Transform:
    """Narrowband palettes over H (r), O (g), S (b). An unknown name is SHO."""
    if name == "Foraxx":
        return steps({"t": "pow(greatest(1.0E-6, g), 1.0E0 - greatest(1.0E-6, g))", "p": "greatest(0.0E0, r * g)"}, {"t2": "pow(p, 1.0E0 - p)"},
                     out={"r": "t * b + (1.0E0 - t) * r", "g": "t2 * r + (1.0E0 - t2) * g", "b": "g"})
    if name == "Realistic1":
        return one(r="(r + b) * 0.5E0", g="0.3E0 * r + 0.7E0 * g", b="0.9E0 * g + 0.1E0 * r")
    if name == "Realistic2":
        return one(r="0.7E0 * r + 0.3E0 * b", g="0.3E0 * b + 0.7E0 * g", b="g")
    if name not in PERMUTATIONS or name == "SHO":
        return one(r="b", g="r", b="g")
    return one(**dict(zip(RGB, PERMUTATIONS[name])))


def nb_normalize(black: float = 0.25, mode: int = 1, scenario: str = "SHO", boost_o: float = 1.2, boost_s: float = 1.1, recover: float = 0.8, lightness: bool = True) -> Transform:
    """Narrowband normalization: black points, boosts, highlight recovery, palette, lightness, SCNR."""
    low = Layer({}, {f"n{n}": f"min({n})" for n in RGB} | {f"m{n}": f"median({n})" for n in RGB})
    base = Layer({f"k{n}": f"n{n} + {num(black)} * (m{n} - n{n})" for n in RGB})
    if mode == 1:
        norm = [Layer({f"{n}1": clamp(f"({n} - k{n}) / greatest(1.0E0 - k{n}, 1.0E-9)") for n in RGB})]
    else:
        norm = [Layer({f"{n}0": f"greatest(0.0E0, {n} - k{n})" for n in RGB}), Layer({f"{n}1": f"CASE WHEN x{n} > 1.0E-9 THEN {n}0 / x{n} ELSE {n}0 END" for n in RGB}, {f"x{n}": f"max({n}0)" for n in RGB})]
    gains = {"r": 1.0, "g": boost_o, "b": 1.0 if scenario == "HOO" else boost_s}
    boosted = Layer({f"{n}2": clamp(f"{n}1 * {num(gains[n])}") for n in RGB})
    hl = Layer({f"{n}3": f"CASE WHEN {n}2 > 0.5E0 THEN {clamp(f'0.5E0 + ({n}2 - 0.5E0) * {num(recover)}')} ELSE {n}2 END" for n in RGB})
    if scenario == "HOO":
        mapped = Layer({"r4": "r3", "g4": clamp("1.0E0 - (1.0E0 - g3) * (1.0E0 - r3 * 0.6E0)"), "b4": "g3"})
    else:
        s = {"SHO": ("b3", "r3", "g3"), "HSO": ("r3", "b3", "g3"), "HOS": ("r3", "g3", "b3")}[scenario]
        mapped = Layer({"r4": s[0], "g4": s[1], "b4": s[2]})
    lum = Layer({"cur": luma(REC709, ("r4", "g4", "b4"))})
    ratio = Layer({"ratio": "CASE WHEN cur > 1.0E-9 THEN r3 / cur ELSE 1.0E0 END" if lightness and mode == 1 else "1.0E0"})
    fin = Layer({f"{n}5": clamp(f"{n}4 * ratio") for n in RGB})
    green = "g5" if scenario == "HOO" else "least(g5, (r5 + b5) / 2.0E0)"
    return Transform((low, base, *norm, boosted, hl, mapped, lum, ratio, fin), {"r": "r5", "g": green, "b": "b5"})


def nb_stars(ratio: float = 0.3, stretch: float = 1.0, sat: float = 1.2) -> Transform:
    t = 3.0**stretch
    return steps(
        {"r1": clamp("0.5E0 * r + 0.5E0 * b"), "g1": clamp(f"{num(ratio)} * r + {num(1 - ratio)} * g"), "b1": "g"},
        {f"{n}2": clamp(f"{num(t)} * {n}1 / ({num(t - 1)} * {n}1 + 1.0E0)") for n in RGB},
        {"g3": "least(g2, (r2 + b2) / 2.0E0)"}, {"lum": luma(REC709, ("r2", "g3", "b2"))},
        out={"r": clamp(f"lum + {num(sat)} * (r2 - lum)"), "g": clamp(f"lum + {num(sat)} * (g3 - lum)"), "b": clamp(f"lum + {num(sat)} * (b2 - lum)")})


BLENDS = {
    "normal": "t", "multiply": "u * t", "screen": "1.0E0 - (1.0E0 - u) * (1.0E0 - t)",
    "overlay": "CASE WHEN u < 0.5E0 THEN 2.0E0 * u * t ELSE 1.0E0 - 2.0E0 * (1.0E0 - u) * (1.0E0 - t) END",
    "add": "least(1.0E0, u + t)", "subtract": "greatest(0.0E0, u - t)", "difference": "abs(u - t)",
    "softlight": "(1.0E0 - 2.0E0 * t) * u * u + 2.0E0 * t * u",
    "hardlight": "CASE WHEN t < 0.5E0 THEN 2.0E0 * u * t ELSE 1.0E0 - 2.0E0 * (1.0E0 - u) * (1.0E0 - t) END",
}


def blend(mode: str, opacity: float = 0.7, low: float = 0.2, high: float = 0.8, feather: float = 0.1) -> Transform:
    """Top layer t over base u, within an intensity range of the top with feathered ends."""
    mask = (f"{clamp(f'(t - {num(low - feather)}) / {num(feather)}')} * {clamp(f'({num(high + feather)} - t) / {num(feather)}')}"
            if feather > 1e-6 else f"CASE WHEN t < {num(low)} OR t > {num(high)} THEN 0.0E0 ELSE 1.0E0 END")
    return steps({"al": f"{num(opacity)} * {mask}"}, out={"v": clamp(f"u * (1.0E0 - al) + ({BLENDS[mode]}) * al")})


def recompose(kind: str = "normal", d: float = 2.0) -> Transform:
    """Screen of starless (u) and stretched stars (t)."""
    return steps({"s": clamp(ghs_expr("t", kind, 0.0, d, 0.0, 0.1, 1.0))}, out={"v": "s + u - s * u"})


def luminance(kind: str) -> Transform:
    e = {"rec709": luma(REC709), "rec601": luma(REC601), "rec2020": luma(REC2020), "average": "(r + g + b) * 0.3333E0",
         "max": "greatest(r, g, b)", "median": "r + g + b - greatest(r, g, b) - least(r, g, b)"}
    if kind == "snr":
        return Transform((Layer({}, {f"q{n}": f"stddev_samp({n})" for n in RGB}), Layer({f"w{n}": f"1.0E0 / (q{n} * q{n})" for n in RGB})),
                         {"v": clamp("(wr * r + wg * g + wb * b) / (wr + wg + wb)")})
    return one(v=clamp(e[kind]))


def recombine_luminance(space: str = "hsv", amount: float = 0.8, new: str = "(r + g + b) / 3.0E0") -> Transform:
    """Replace V (HSV), or L by scaling (Lab-like ratio), and blend with the original."""
    old = "greatest(r, g, b)" if space == "hsv" else luma(REC709)
    return steps({"old": old, "lum": new}, {"k": "CASE WHEN old > 1.0E-9 THEN lum / old ELSE 0.0E0 END"},
                 out=each(clamp(f"# * {num(1 - amount)} + # * k * {num(amount)}")))


def remove_pedestal() -> Transform:
    return Transform((Layer({}, {f"n{n}": f"min({n})" for n in RGB}),), each("greatest(0.0E0, # - n#)"))


def continuum(q: float = 0.8) -> Transform:
    return Transform((Layer({}, {"mg": "median(g)"}),), {"v": clamp(f"r - {num(q)} * (g - mg)")})


def anscombe(forward: bool = True) -> Transform:
    if forward:
        return one(**each("2.0E0 * sqrt(greatest(0.0E0, # + 0.375E0))"))
    return one(**each("(# / 2.0E0) * (# / 2.0E0) - 0.375E0"))


def soft_threshold(t: float) -> Transform:
    return one(**each(f"CAST(sign(# - 0.5E0) AS DOUBLE) * greatest(0.0E0, abs(# - 0.5E0) - {num(t)})"))


def grain(strength: float = 0.05) -> Transform:
    """Noise from a hash of the position, the same on every run."""
    h = "(((CAST(x AS BIGINT) * 73856093 + CAST(y AS BIGINT) * 19349663 + CAST(img AS BIGINT) * 83492791) % 65536) / 65535.0E0)"
    return one(**each(clamp(f"# + {num(strength)} * ({h} - 0.5E0)")))


# ---- masks ----

def range_mask(low: float, high: float, fuzz: float) -> Transform:
    return steps({"lum": luma(REC709)}, out={"m": f"{clamp(f'(lum - {num(low - fuzz)}) / {num(fuzz)}')} * {clamp(f'({num(high + fuzz)} - lum) / {num(fuzz)}')}"})


def chroma_mask() -> Transform:
    """Distance from the mean chrominance, scaled to [0, 1]."""
    cr, cb = "(r - lum) * 0.713E0", "(b - lum) * 0.564E0"
    return Transform((Layer({"lum": luma(REC601)}), Layer({"cr": cr, "cb": cb}), Layer({"dist": "sqrt((cr - mr) * (cr - mr) + (cb - mb) * (cb - mb))"}, {"mr": "avg(cr)", "mb": "avg(cb)"}),
                      Layer({}, {"lo": "min(dist)", "hi": "max(dist)"})), {"m": "CASE WHEN hi > lo THEN (dist - lo) / (hi - lo) ELSE 0.0E0 END"})


HUES = {"red": (330.0, 30.0), "orange": (15.0, 45.0), "yellow": (45.0, 75.0), "green": (75.0, 165.0), "cyan": (165.0, 195.0), "blue": (195.0, 270.0), "violet": (270.0, 300.0), "magenta": (300.0, 330.0)}


def colour_mask(name: str, fuzz: float = 15.0) -> Transform:
    return steps(*hue_columns(), out={"m": f"CASE WHEN sat >= 0.1E0 THEN {hue_band(*HUES[name], fuzz)} ELSE 0.0E0 END"})


def mask_blend(m: str = "m", opacity: float = 1.0, invert: bool = False, protect: bool = False) -> Transform:
    """Processed v over original o by a mask."""
    a = f"(1.0E0 - {m})" if invert != protect else m
    return steps({"al": f"{a} * {num(opacity)}"}, out={"v": "v * al + o * (1.0E0 - al)"})


def feather_mask(side: int, distance: float) -> Transform:
    return one(m=smooth(f"least(x, y, {side - 1} - x, {side - 1} - y) / {num(distance)}"))


def polygon_mask(points: list[tuple[float, float]]) -> Transform:
    """1 inside a polygon by the even-odd rule."""
    parts = []
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            cross = f"(y - {num(y1)}) * {num((x2 - x1) / (y2 - y1))} + {num(x1)}"
            parts.append(f"CASE WHEN (y < {num(y1)}) <> (y < {num(y2)}) AND x < {cross} THEN 1 ELSE 0 END")
    return one(m=f"CAST(({' + '.join(parts)}) % 2 AS DOUBLE)")
