"""Catalog search and celestial coordinates, as SQL expression text shared by plan and check."""

from __future__ import annotations

from framelake.functions.spec import num

RAD = "1.74532925199432958E-2"
DEG = "5.72957795130823209E1"


def separation(ra: str, dec: str, ra0: float, dec0: float) -> str:
    """Angle in degrees between a position and a point (haversine)."""
    a = f"pow(sin(({dec} - {num(dec0)}) * {RAD} / 2.0E0), 2.0E0) + cos({dec} * {RAD}) * cos({num(dec0)} * {RAD}) * pow(sin(({ra} - {num(ra0)}) * {RAD} / 2.0E0), 2.0E0)"
    return f"(2.0E0 * asin(least(1.0E0, sqrt({a}))) * {DEG})"


#: Colour index from BP-RP: fixed coefficients.
def bv_from_bprp(x: str) -> str:
    return f"(0.393E0 + 0.475E0 * {x} - 0.0548E0 * {x} * {x})"


COLOUR = {
    "b_v": f"CASE WHEN bp_rp IS NOT NULL THEN {bv_from_bprp('bp_rp')} WHEN mag_b IS NOT NULL AND mag_v IS NOT NULL THEN mag_b - mag_v ELSE 0.65E0 END",
    "colour": "CASE WHEN bp_rp IS NOT NULL THEN bp_rp WHEN mag_b IS NOT NULL AND mag_v IS NOT NULL THEN (mag_b - mag_v - 0.393E0) / 0.45E0 END",
}
#: Upper bounds of BP-RP and the spectral type below them: fixed values.
TYPES = [(-0.35, "O5V"), (-0.25, "B0V"), (-0.10, "B5V"), (0.10, "A0V"), (0.25, "A5V"), (0.40, "F0V"), (0.55, "F5V"), (0.65, "G0V"), (0.75, "G2V"), (0.85, "G5V"), (1.00, "K0V"), (1.30, "K5V"), (1.60, "M0V")]


def spectral_type(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} < {num(b)} THEN '{t}'" for b, t in TYPES) + " ELSE 'M5V' END"


GALAXY = {"major": "0.1E0 * pow(10.0E0, logd)", "minor": "CASE WHEN logr IS NULL THEN 0.1E0 * pow(10.0E0, logd) ELSE 0.1E0 * pow(10.0E0, logd) / pow(10.0E0, logr) END"}


def magnitude_limit_layers(fov: float, stars: int) -> tuple[list[dict[str, str]], str]:
    """Star density by galactic latitude: layers of columns over ra, dec and the limit."""
    import math

    l0, a0, d0 = 122.9320, 192.8595, 27.1284  # the galactic pole and node: fixed values
    area = 2 * (1 - math.cos(math.radians(fov) / 2)) * 180 * 180 / math.pi
    h = f"(ra - {num(a0)}) * {RAD}"
    sd, cd = math.sin(math.radians(d0)), math.cos(math.radians(d0))
    layers = [
        {"gl0": f"({num(math.radians(l0))} - atan2(cos(dec * {RAD}) * sin({h}), sin(dec * {RAD}) * {num(cd)} - cos(dec * {RAD}) * {num(sd)} * cos({h}))) * {DEG}",
         "gb": f"asin(greatest(-1.0E0, least(1.0E0, sin(dec * {RAD}) * {num(sd)} + cos(dec * {RAD}) * {num(cd)} * cos({h})))) * {DEG}"},
        {"gl": "abs(CASE WHEN gl0 > 180 THEN gl0 - 360.0E0 ELSE gl0 END)", "sb": f"sin(abs(gb) * {RAD})"},
        {"slope": "2.36E0 + CASE WHEN gl < 90 THEN (gl - 90.0E0) * 0.0073E0 ELSE 0.0E0 END + (0.88E0 - CASE WHEN gl < 90 THEN (gl - 90.0E0) * 0.0065E0 ELSE 0.0E0 END) * sb"},
    ]
    return layers, f"greatest(7.0E0, 11.68E0 + 2.66E0 * sb + slope * {num(math.log10(stars / area) - 2)})"


def tan_project(ra0: float, dec0: float) -> list[dict[str, str]]:
    """Layers with gnomonic plane coordinates xi, eta in degrees (null behind the plane)."""
    h = f"((ra - {num(ra0)}) * {RAD})"
    d, d0 = f"(dec * {RAD})", f"({num(dec0)} * {RAD})"
    return [
        {"cosc": f"sin({d0}) * sin({d}) + cos({d0}) * cos({d}) * cos({h})"},
        {"xi": f"CASE WHEN cosc > 1.0E-9 THEN cos({d}) * sin({h}) / greatest(cosc, 1.0E-9) * {DEG} END",
         "eta": f"CASE WHEN cosc > 1.0E-9 THEN (cos({d0}) * sin({d}) - sin({d0}) * cos({d}) * cos({h})) / greatest(cosc, 1.0E-9) * {DEG} END"},
    ]


def tan_deproject(ra0: float, dec0: float) -> list[dict[str, str]]:
    """Layers with ra, dec in degrees of plane coordinates xi, eta."""
    d0 = f"({num(dec0)} * {RAD})"
    return [
        {"px": f"xi * {RAD}", "py": f"eta * {RAD}"},
        {"ra_raw": f"{num(ra0)} + atan2(px, cos({d0}) - py * sin({d0})) * {DEG}",
         "dec_out": f"asin(greatest(-1.0E0, least(1.0E0, (sin({d0}) + py * cos({d0})) / sqrt(1.0E0 + px * px + py * py)))) * {DEG}"},
        {"ra_out": "ra_raw - 360.0E0 * floor(ra_raw / 360.0E0)"},
    ]


def sip(u: str, v: str, coefficients: dict[tuple[int, int], float]) -> str:
    """A distortion polynomial; a missing coefficient is 0."""
    terms = [f"{num(c)} * pow({u}, {num(p)}) * pow({v}, {num(q)})" for (p, q), c in sorted(coefficients.items())]
    return "(" + " + ".join(terms or ["0.0E0"]) + ")"


class Wcs:
    """A tangent-plane solution: reference pixel, CD matrix, optional SIP polynomials."""

    def __init__(self, ra0, dec0, crpix, cd, a=None, b=None):
        self.ra0, self.dec0, self.crpix, self.cd, self.a, self.b = ra0, dec0, crpix, cd, a or {}, b or {}

    def pixel_to_world(self) -> list[dict[str, str]]:
        """Layers from pixel columns ix, iy (from 0) to ra_out, dec_out."""
        (c11, c12), (c21, c22) = self.cd
        return [
            {"u": f"ix + 1.0E0 - {num(self.crpix[0])}", "w": f"iy + 1.0E0 - {num(self.crpix[1])}"},
            {"uf": f"u + {sip('u', 'w', self.a)}", "wf": f"w + {sip('u', 'w', self.b)}"},
            {"xi": f"{num(c11)} * uf + {num(c12)} * wf", "eta": f"{num(c21)} * uf + {num(c22)} * wf"},
            *tan_deproject(self.ra0, self.dec0),
        ]

    def world_to_pixel(self, steps: int = 6) -> list[dict[str, str]]:
        """Layers from ra, dec to ox, oy; the distortion is undone by fixed-point steps."""
        (c11, c12), (c21, c22) = self.cd
        det = c11 * c22 - c12 * c21
        layers = [*tan_project(self.ra0, self.dec0),
                  {"u0": f"({num(c22)} * xi - {num(c12)} * eta) / {num(det)}", "w0": f"({num(c11)} * eta - {num(c21)} * xi) / {num(det)}"}]
        now = ("u0", "w0")
        if self.a or self.b:
            for k in range(1, steps + 1):
                layers.append({f"u{k}": f"u0 - {sip(*now, self.a)}", f"w{k}": f"w0 - {sip(*now, self.b)}"})
                now = (f"u{k}", f"w{k}")
        return [*layers, {"ox": f"{now[0]} + {num(self.crpix[0])} - 1.0E0", "oy": f"{now[1]} + {num(self.crpix[1])} - 1.0E0"}]

    def scale(self) -> float:
        """Arc seconds a pixel."""
        (c11, c12), (c21, c22) = self.cd
        return abs(c11 * c22 - c12 * c21) ** 0.5 * 3600


def blackbody_layers(bv: str = "b_v") -> tuple[list[dict[str, str]], dict[str, str]]:
    """Colour index to temperature to linear sRGB with the brightest channel 1.
    Planckian locus and matrix coefficients are fixed values."""
    p = lambda c3, c2, c1, c0, t: f"({num(c3)} * {t} * {t} * {t} + {num(c2)} * {t} * {t} + {num(c1)} * {t} + {num(c0)})"
    layers = [
        {"temp": f"4600.0E0 * (1.0E0 / (0.92E0 * {bv} + 1.7E0) + 1.0E0 / (0.92E0 * {bv} + 0.62E0))"}, {"it": "1.0E0 / temp"},
        {"cx": f"CASE WHEN temp < 1667 THEN 0.0E0 WHEN temp < 4000 THEN {p(-0.2661239e9, -0.2343589e6, 0.8776956e3, 0.179910, 'it')} WHEN temp < 25000 THEN {p(-3.0258469e9, 2.1070379e6, 0.2226347e3, 0.240390, 'it')} ELSE 0.0E0 END"},
        {"cy": f"CASE WHEN temp < 1667 THEN 0.0E0 WHEN temp < 2222 THEN {p(-1.1063814, -1.34811020, 2.18555832, -0.20219683, 'cx')} WHEN temp < 4000 THEN {p(-0.9549476, -1.37418593, 2.09137015, -0.16748867, 'cx')} WHEN temp < 25000 THEN {p(3.0817580, -5.87338670, 3.75112997, -0.37001483, 'cx')} ELSE 0.0E0 END"},
        {"zx": "CASE WHEN cy > 1.0E-9 THEN cx / greatest(cy, 1.0E-9) ELSE 0.0E0 END", "zz": "CASE WHEN cy > 1.0E-9 THEN (1.0E0 - cx - cy) / greatest(cy, 1.0E-9) ELSE 0.0E0 END"},
        {"lr": "greatest(0.0E0, 3.2404542E0 * zx - 1.5371385E0 - 0.4985314E0 * zz)", "lg": "greatest(0.0E0, -0.9692660E0 * zx + 1.8760108E0 + 0.0415560E0 * zz)", "lb": "greatest(0.0E0, 0.0556434E0 * zx - 0.2040259E0 + 1.0572252E0 * zz)"},
        {"top": "greatest(lr, lg, lb)"},
    ]
    out = {n: f"CASE WHEN cx = 0 AND cy = 0 THEN 1.0E0 WHEN top > 1.0E-6 THEN l{n} / top ELSE l{n} END" for n in "rgb"}
    return layers, {"temp": "temp", **out}


def magnitude(flux: str) -> str:
    return f"CASE WHEN {flux} <= 0 THEN 99.999E0 ELSE -2.5E0 * log10({flux}) END"


def magnitude_error(flux: str, area: str, n_sky: str, sky_sigma: str, gain: float) -> str:
    noise = f"sqrt({area} * {sky_sigma} * {sky_sigma} + {flux} / {num(gain)} + {sky_sigma} * {sky_sigma} / {n_sky} * {area} * {area})"
    return f"CASE WHEN {flux} <= 0 OR {area} <= 0 OR {n_sky} <= 0 THEN 9.999E0 ELSE least(9.999E0, 1.0857E0 * {noise} / {flux}) END"
