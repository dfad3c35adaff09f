"""The batch script language: parser, binder and commands.

A command returns a lazy table and updates the session; nothing runs until
``save``, ``stat`` or a header variable asks for values. Pixels live in tables
``frame_id, x, y, c, v``; a sequence is such a table under its name, an image is
a sequence of one frame. Variables set by ``set`` work; commands are matched
without regard to case; malformed options are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.expr import compile_script, script_variables
from framelake.operators import fitting, kernels, stacking
from framelake.sources import codecs, readers


class ScriptError(ValueError):
    """A script that cannot be parsed, bound or run; the message names the line."""


@dataclass
class Command:
    name: str
    args: list[str]
    options: dict[str, str]
    line: int


def tokenize(line: str) -> list[str]:
    """Words split at white space; quotes group, with escapes; # and ; start comments."""
    tokens, now, quote, at = [], "", "", 0
    while at < len(line):
        c = line[at]
        if quote:
            if c == quote:
                if now:
                    tokens.append(now)
                now, quote = "", ""
            elif c == "\\" and at + 1 < len(line):
                at += 1
                now += {"n": "\n", "t": "\t"}.get(line[at], line[at])
            else:
                now += c
        elif c in "\"'":
            quote = c
        elif c.isspace():
            if now:
                tokens.append(now)
            now = ""
        elif c in "#;":
            break
        else:
            now += c
        at += 1
    return tokens + ([now] if now else [])


def parse(text: str) -> list[Command]:
    """All commands; a trailing backslash continues a line."""
    out, held, start = [], "", 0
    for number, line in enumerate(text.splitlines(), 1):
        if not held:
            start = number
        if line.rstrip().endswith("\\"):
            held += line.rstrip()[:-1] + " "
            continue
        tokens = tokenize(held + line)
        held = ""
        if not tokens:
            continue
        args, options, k = [], {}, 1
        while k < len(tokens):
            t = tokens[k]
            if t.startswith("-") and len(t) > 1 and not re.fullmatch(r"-\d+(\.\d+)?", t):
                name, eq, value = t.lstrip("-").partition("=")
                if eq:
                    options[name] = value
                elif k + 1 < len(tokens) and tokens[k + 1] == "=":
                    options[name] = tokens[k + 2] if k + 2 < len(tokens) else ""
                    k += 2
                elif k + 1 < len(tokens) and not tokens[k + 1].startswith("-") and name not in FLAGS:
                    k += 1
                    options[name] = tokens[k]
                else:
                    options[name] = ""
            elif t != "=":
                args.append(t)
            k += 1
        out.append(Command(tokens[0].lower(), args, options, start))
    return out


#: Options that never take the next word as their value.
FLAGS = {"nonorm", "output_norm", "rgb_equal", "maximize", "fast", "drizzle", "debayer", "cfa", "equalize_cfa", "nostarmask", "32b", "16b", "flip"}
#: Values of stack options: fixed values.
REJECTIONS = {"none": "none", "percentile": "percentile", "perc": "percentile", "sigma": "sigma", "mad": "mad", "sigmedian": "sigmedian", "winsor": "winsorized", "winsorized": "winsorized", "linear": "linear", "linfit": "linear", "gesdt": "gesd"}
NORMS = {"none": None, "nonorm": None, "add": "additive", "additive": "additive", "mul": "multiplicative", "multiplicative": "multiplicative", "addscale": "addscale", "mulscale": "mulscale"}
WEIGHTS = {"none": None, "noise": "noise", "fwhm": "fwhm", "wfwhm": "fwhm", "stars": "stars", "quality": "quality"}


@dataclass
class Session:
    spark: SparkSession
    folder: str = "."
    sequences: dict[str, DataFrame] = field(default_factory=dict)
    current: DataFrame | None = None
    cards: list[codecs.Card] = field(default_factory=list)
    uncropped: dict[str, DataFrame] = field(default_factory=dict)
    masters: dict[str, DataFrame] = field(default_factory=dict)
    variables: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return name if "://" in name or name.startswith("/") else f"{self.folder}/{name}"

    def image(self) -> DataFrame:
        if self.current is None:
            raise ScriptError("no image is loaded")
        return self.current

    def named(self, name: str) -> DataFrame:
        """A sequence or saved image of the session, or a file."""
        key = re.sub(r"\.(fits?|fts|xisf|tiff?)$", "", name.split("/")[-1])
        if key in self.sequences:
            return self.sequences[key]
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        kind = _kind(name)
        files = self.spark.read.format("binaryFile").load(self.path(name)).select(F.lit(0).cast("long").alias("frame_id"), "content")
        return readers.read_pixels(files, kind).where("hdu = 0").drop("hdu")


def _kind(name: str) -> str:
    suffix = name.rsplit(".", 1)[-1].lower()
    found = {"fit": "fits", "fits": "fits", "fts": "fits", "xisf": "xisf", "tif": "tiff", "tiff": "tiff", "ser": "ser"}.get(suffix)
    if not found:
        raise ScriptError(f"unknown format {name!r}")
    return found


COMMANDS: dict[str, tuple[int, int, Callable]] = {}


def command(names: str, least: int, most: int):
    def add(fn):
        for name in names.split():
            COMMANDS[name] = (least, most, fn)
        return fn

    return add


def size(px: DataFrame) -> tuple[int, int]:
    row = px.agg(F.max("x"), F.max("y")).first()
    return (row[0] or 0) + 1, (row[1] or 0) + 1


def options_float(c: Command, name: str, default: float) -> float:
    try:
        return float(c.options.get(name, default))
    except ValueError:
        raise ScriptError(f"line {c.line}: option {name} needs a number") from None


@command("cd", 1, 1)
def _cd(s, c):
    s.folder = s.path(c.args[0])


@command("set", 2, 99)
def _set(s, c):
    s.variables[c.args[0]] = " ".join(c.args[1:])


@command("load", 1, 1)
def _load(s, c):
    s.current = s.named(c.args[0])
    key = c.args[0].split("/")[-1].rsplit(".", 1)[0]
    if key not in s.sequences and _kind(c.args[0]) == "fits":
        files = s.spark.read.format("binaryFile").load(s.path(c.args[0])).select(F.lit(0).cast("long").alias("frame_id"), "content")
        s.cards = [tuple(r) for r in readers.read_cards(files).where("hdu = 0").orderBy("pos").select("key", "value", "comment").collect()]


@command("save", 1, 1)
def _save(s, c):
    name = c.args[0] if "." in c.args[0].split("/")[-1] else c.args[0] + ".fit"
    px = s.image().withColumn("frame_id", F.lit(0).cast("long"))
    folder, _, file = s.path(name).rpartition("/")
    files = readers.encode(px, _kind(name), s.cards).withColumn("frame_id", F.lit(0).cast("long"))
    stem, _, suffix = file.rpartition(".")
    _write_one(files, folder, stem + "." + suffix)
    s.sequences[stem] = s.current


def _write_one(files: DataFrame, folder: str, file: str) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{file}") as out:
        out.write(bytes(files.first()["content"]))  # one image


@command("close", 0, 0)
def _close(s, c):
    s.current, s.cards = None, []


@command("convert link", 1, 3)
def _convert(s, c):
    """Files of the folder, numbered by path, become a sequence."""
    pattern = c.options.get("pattern", "*.fit*")
    files = readers.sequence(s.spark, s.folder, pattern)
    s.sequences[c.args[0]] = readers.read_pixels(files, _kind(pattern.replace("*", "x").rstrip("x"))).where("hdu = 0").drop("hdu")


@command("convertall", 1, 1)
def _convertall(s, c):
    _convert(s, c)


@command("newproject", 1, 1)
def _newproject(s, c):
    s.folder, s.sequences, s.masters = s.path(c.args[0]), {}, {}


@command("setmaster", 2, 2)
def _setmaster(s, c):
    if c.args[0].lower() not in ("bias", "dark", "flat"):
        raise ScriptError(f"line {c.line}: no master {c.args[0]}")
    s.masters[c.args[0].lower()] = s.named(c.args[1])


@command("calibrate", 1, 1)
def _calibrate(s, c):
    """Bias, then dark, then flat: masters are joined on the position. ``-dark_scale`` multiplies
    the dark (made without bias, to be scaled), ``-pedestal`` is added with it, ``-pattern`` names the filter."""
    masters = dict(s.masters) | {k: s.named(v) for k, v in c.options.items() if k in ("bias", "dark", "flat") and v}
    px = s.named(c.args[0])
    pattern = c.options.get("pattern", "RGGB").upper()
    for kind, factor, pedestal in (("bias", 1.0, 0.0), ("dark", options_float(c, "dark_scale", 1.0), options_float(c, "pedestal", 0.0))):
        if kind in masters:
            m = masters[kind].select("x", "y", "c", F.col("v").alias("m"))
            px = px.join(m, ["x", "y", "c"]).withColumn("v", F.col("v") - factor * F.col("m") + pedestal).drop("m")
    if "flat" in masters:
        f = masters["flat"].select("x", "y", "c", F.col("v").alias("m"))
        mean = f.groupBy("c").agg(F.avg("m").alias("mean"))
        f = f.join(F.broadcast(mean), "c")
        px = px.join(f, ["x", "y", "c"]).withColumn("v", F.col("v") / F.when(F.col("m") > 1e-6, F.col("m") / F.col("mean")).otherwise(1.0)).drop("m", "mean")
    if "cc" in c.options:
        px = kernels.cosmetic(px, 3.0, 3.0).drop("fixed")
    if "equalize_cfa" in c.options:
        px = kernels.cfa_equalize(px, pattern, *size(px))
    if "debayer" in c.options:
        px = _wide_to_long(kernels.demosaic_bilinear(px, pattern))
    s.sequences["pp_" + c.args[0]] = px.select("frame_id", "x", "y", "c", "v")


def _wide_to_long(rgb: DataFrame) -> DataFrame:
    return rgb.select("frame_id", "x", "y", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))


@command("debayer", 0, 1)
def _debayer(s, c):
    how = {"bilinear": kernels.demosaic_bilinear, "vng": kernels.demosaic_vng, "rcd": kernels.demosaic_ratio, "superpixel": kernels.superpixel}
    method = c.options.get("method", "bilinear").lower()
    if method not in how:
        raise ScriptError(f"line {c.line}: no method {method}")
    out = _wide_to_long(how[method](s.named(c.args[0]) if c.args else s.image(), c.options.get("pattern", "RGGB").upper()))
    if c.args:
        s.sequences["db_" + c.args[0]] = out
    else:
        s.current = out


@command("seqextract_ha", 1, 1)
def _extract_ha(s, c):
    p = s.named(c.args[0]).where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    s.sequences["Ha_" + c.args[0]] = p.withColumns({"x": F.floor(F.col("x") / 2).cast("int"), "y": F.floor(F.col("y") / 2).cast("int")})


@command("seqextract_haoiii", 1, 1)
def _extract_haoiii(s, c):
    _extract_ha(s, c)
    sp = kernels.superpixel(s.named(c.args[0]), "RGGB")
    s.sequences["OIII_" + c.args[0]] = sp.select("frame_id", "x", "y", F.lit(0).alias("c"), ((F.col("g") + F.col("b")) / 2).alias("v"))


@command("register", 1, 1)
def _register(s, c):
    """Whole-pixel shifts between flux-weighted centres of the brightest detections; the
    first frame is the reference. One row a frame is joined back."""
    px = s.named(c.args[0])
    d = fitting.detect(px.where("c = 0"), options_float(c, "sigma", 3.0))
    centre = d.groupBy("frame_id").agg((F.sum(F.col("x") * F.col("flux")) / F.sum("flux")).alias("cx"), (F.sum(F.col("y") * F.col("flux")) / F.sum("flux")).alias("cy"))
    known = centre.where("cx IS NOT NULL")
    ref = known.agg(F.min_by(F.struct("cx", "cy"), "frame_id").alias("r")).select("r.cx", "r.cy").toDF("rx", "ry")
    # a frame without a detection stays where it is
    centre = px.select("frame_id").distinct().join(centre, "frame_id", "left")
    moves = centre.crossJoin(F.broadcast(ref)).select("frame_id", F.coalesce(F.round(F.col("rx") - F.col("cx")).cast("int"), F.lit(0)).alias("dx"), F.coalesce(F.round(F.col("ry") - F.col("cy")).cast("int"), F.lit(0)).alias("dy"))
    w, h = size(px)
    moved = px.join(moves, "frame_id").withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).drop("dx", "dy")
    s.sequences["r_" + c.args[0]] = moved.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    s.uncropped["r_" + c.args[0]] = moved


@command("seqapplyreg", 1, 1)
def _seqapplyreg(s, c):
    """Registration is applied when it is made."""


@command("stack", 1, 8)
def _stack(s, c):
    """Normalize, reject, weight and combine. ``--maximize`` takes registered frames whole (the
    canvas starts at their least position), ``--drizzle`` (``--scale``, ``--pixfrac``) and ``--fast``
    lay them on a finer grid instead of a rule; ``--feather`` fades frames towards their edges."""
    px = s.named(c.args[0])
    if "maximize" in c.options and c.args[0] in s.uncropped:
        px = s.uncropped[c.args[0]]
        low = px.agg(F.min("x").alias("_lx"), F.min("y").alias("_ly"))  # one row
        px = px.crossJoin(F.broadcast(low)).withColumns({"x": F.col("x") - F.col("_lx"), "y": F.col("y") - F.col("_ly")}).drop("_lx", "_ly")
    words = [a for a in c.args[1:] if not re.fullmatch(r"[\d.]+", a)]
    method = c.options.get("method") or next((w for w in words if w in ("sum", "mean", "median", "max", "min")), "mean")
    if method not in ("sum", "mean", "median", "max", "min"):
        raise ScriptError(f"line {c.line}: no method {method}")
    rejection = REJECTIONS.get(c.options.get("rejection", "winsorized").lower(), "winsorized")
    limits = [float(a) for a in c.args[1:] + c.options.get("rej", "").split() if re.fullmatch(r"[\d.]+", a)]
    limits = limits * 2 if len(limits) == 1 else limits
    norm = None if "nonorm" in c.options else NORMS.get(c.options.get("norm", "addscale").lower(), "addscale")
    weighting = WEIGHTS.get(c.options.get("weighting", "noise").lower(), "noise")
    distance = options_float(c, "feather", 0.0) if c.options.get("feather") else 0.0
    fine = "drizzle" in c.options or "fast" in c.options or "fast_drizzle" in c.options
    stacking.require_frames(px)
    if norm and method in ("mean", "median"):
        ref = px.agg(F.min("frame_id")).first()[0]
        px = stacking.normalize(px, stacking.coefficients(stacking.estimators(px), ref, norm), norm)
    if fine:
        scale = options_float(c, "scale", 2.0)
        if scale < 1:
            raise ScriptError(f"line {c.line}: a scale of {scale}")
        if "drizzle" in c.options:
            out = kernels.drizzle(px, scale, options_float(c, "pixfrac", 0.9), lambda frame: (0.0, 0.0)).drop("w")
        else:
            out = stacking.fast_drizzle(px, scale, F.lit(0.0), F.lit(0.0)).select(F.col("ox").alias("x"), F.col("oy").alias("y"), "c", "v")
    elif method == "mean":
        options = {"low": limits[0], "high": limits[1]} if len(limits) > 1 and rejection not in ("gesd", "biweight", "modz") else {"low": 0.2, "high": 0.1} if rejection == "percentile" else {}
        px = px.withColumn("w", F.lit(1.0))
        if weighting:
            px = px.drop("w").join(stacking.weights(_measured(px), weighting), "frame_id")
        out = stacking.stack_kept(stacking.edge_weights(px, distance) if distance > 0 else px, rejection, **options)
    else:
        out = stacking.stack(px, method)
    out = out.withColumn("frame_id", F.lit(0).cast("long")).select("frame_id", "x", "y", "c", "v")
    if "rgb_equal" in c.options:
        out = _equalized(out)
    if "output_norm" in c.options:
        out = stacking.output_normalize(out)
    s.current = out
    name = c.options.get("out", c.args[0] + "_stacked").split("/")[-1]
    s.sequences[re.sub(r"\.\w+$", "", name)] = out


def _measured(px: DataFrame) -> DataFrame:
    """One row a frame, measured after normalization, so that noise has its factor already."""
    f = px.groupBy("frame_id").agg(F.median("v").alias("background"), F.stddev_samp("v").alias("noise"), F.count_if(F.col("v") > 0.55).alias("stars"))
    return f.withColumns({"fwhm": F.lit(1.0) + F.col("noise"), "quality": 1.0 / F.greatest(F.col("noise"), F.lit(1e-9))})


def _equalized(img: DataFrame) -> DataFrame:
    """Red and blue of a colour image brought to green's median; a grey image stays as it is."""
    if img.agg(F.max("c")).first()[0] != 2:
        return img
    wide = img.groupBy("frame_id", "x", "y").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])
    return _wide_to_long(stacking.equalize_rgb(wide)).where("v IS NOT NULL")


@command("autostack", 1, 1)
def _autostack(s, c):
    _convert(s, Command("convert", [c.args[0]], c.options, c.line))
    _register(s, Command("register", [c.args[0]], {}, c.line))
    _stack(s, Command("stack", ["r_" + c.args[0]], c.options, c.line))


@command("rgbcomp", 3, 3)
def _rgbcomp(s, c):
    out = None
    for k, name in enumerate(c.args):
        p = s.named(name).where("c = 0").withColumns({"c": F.lit(k), "frame_id": F.lit(0).cast("long")})
        out = p if out is None else out.unionByName(p)
    s.current = out
    if c.options.get("out"):
        s.sequences[re.sub(r"\.\w+$", "", c.options["out"].split("/")[-1])] = out


@command("linear_match", 2, 2)
def _linear_match(s, c):
    """The second image scaled and shifted to the first's median and deviation."""
    b, a = (s.named(n) for n in c.args)
    ea, eb = (stacking.estimators(p.withColumn("frame_id", F.lit(0).cast("long"))) for p in (a, b))
    j = ea.select("c", F.col("location").alias("l"), F.col("scale").alias("sc")).join(eb.select("c", F.col("location").alias("l0"), F.col("scale").alias("s0")), "c")
    k = F.when(F.col("sc") != 0, F.col("s0") / F.col("sc")).otherwise(1.0)
    s.current = a.join(F.broadcast(j), "c").withColumn("v", (F.col("v") - F.col("l")) * k + F.col("l0")).select("frame_id", "x", "y", "c", "v")


@command("pm", 1, 1)
def _pm(s, c):
    names = script_variables(c.args[0])
    if not names:
        raise ScriptError(f"line {c.line}: no image is named")
    out = None
    for k, name in enumerate(names):
        p = s.named(name).select("x", "y", "c", F.col("v").alias(f"v{k}"))
        out = p if out is None else out.join(p, ["x", "y", "c"], "full")
    column = {n: f"coalesce(v{k}, 0.0E0)" for k, n in enumerate(names)}
    s.current = out.select(F.lit(0).cast("long").alias("frame_id"), "x", "y", "c", F.expr(compile_script(c.args[0], column.__getitem__)).alias("v"))


@command("starnet", 0, 0)
def _starnet(s, c):
    raise ScriptError(f"line {c.line}: starnet needs a model that is not part of this library")


@command("background", 0, 1)
def _background(s, c):
    s.current = _flatten(s.image(), int(c.args[0]) if c.args else 1)


@command("seqsubsky", 1, 2)
def _seqsubsky(s, c):
    """Each frame's polynomial background of the given degree (1) is subtracted and its mean
    added back; all frames' fits come from one aggregate."""
    try:
        degree = int(c.args[1]) if len(c.args) > 1 else 1
    except ValueError:
        raise ScriptError(f"line {c.line}: a degree of {c.args[1]!r}") from None
    px, by = s.named(c.args[0]), ["frame_id", "c"]
    samples = fitting.background_samples_by(px, 8, 3.0, by)
    s.sequences["bkg_" + c.args[0]] = fitting.remove_background_by(px, samples, degree, by).select("frame_id", "x", "y", "c", "v")


def _flatten(img: DataFrame, degree: int) -> DataFrame:
    samples = fitting.background_samples(img, 8, 3.0)
    return fitting.remove_background(img, fitting.fit_background(samples, degree), degree)


@command("mirrorx", 0, 0)
def _mirrorx(s, c):
    s.current = kernels.mirror(s.image(), "y", size(s.image())[1])


@command("mirrory", 0, 0)
def _mirrory(s, c):
    s.current = kernels.mirror(s.image(), "x", size(s.image())[0])


@command("rotate", 1, 1)
def _rotate(s, c):
    degrees = float(c.args[0])
    px = s.image()
    s.current = kernels.rotate(px, int(degrees // 90) % 4, *size(px)) if degrees % 90 == 0 else kernels.rotate_by(px, degrees)


@command("resample", 1, 1)
def _resample(s, c):
    s.current = kernels.resample(s.image(), float(c.args[0]), "lanczos")


@command("crop", 0, 4)
def _crop(s, c):
    if len(c.args) != 4:
        raise ScriptError(f"line {c.line}: crop needs x y width height")
    s.current = kernels.crop(s.image(), *(int(a) for a in c.args))


@command("update_key", 2, 3)
def _update_key(s, c):
    key, value, comment = (c.args + [""])[:3]
    card = (key.upper(), value, comment)
    places = [k for k, x in enumerate(s.cards) if x[0].upper() == key.upper()]
    if places:
        s.cards[places[0]] = card
    else:
        s.cards.append(card)


@command("stat", 0, 0)
def _stat(s, c):
    row = s.image().agg(F.least(F.lit(1.0), F.min("v")), F.greatest(F.lit(0.0), F.max("v")), F.avg("v")).first()
    s.variables |= dict(zip(("min", "max", "mean"), (repr(v) for v in row)))


def _each(e: Callable):
    def run(s, c):
        v = F.col("v")
        s.current = s.image().withColumn("v", e(v, *(float(a) for a in c.args)))

    return run


command("thresh", 2, 2)(_each(lambda v, lo, hi: F.when(v < lo, 0.0).when(v > hi, 1.0).otherwise(v)))
command("threshlo", 1, 1)(_each(lambda v, lo: F.when(v < lo, 0.0).otherwise(v)))
command("threshhi", 1, 1)(_each(lambda v, hi: F.when(v > hi, 1.0).otherwise(v)))
command("offset", 1, 1)(_each(lambda v, k: v + k))
command("fmul", 1, 1)(_each(lambda v, k: v * k))
command("neg", 0, 0)(_each(lambda v: 1.0 - v))

#: Header variables: fixed names.
HEADER = {"FILTER": "FILTER", "EXPTIME": "EXPTIME", "DATE": "DATE-OBS", "OBJECT": "OBJECT", "INSTRUME": "INSTRUME", "LIVETIME": "EXPTIME"}


def substitute(text: str, session: Session) -> str:
    """${name} and $name by script variables, then by headers of the current image; unknown names stay."""
    cards = {}
    for k, v, _ in session.cards:
        cards.setdefault(k, v)

    def value(m: re.Match) -> str:
        name = m[1] or m[2]
        return session.variables.get(name) or cards.get(HEADER.get(name, ""), "") or m[0]

    return re.sub(r"\$\{([^}]+)\}|\$([A-Za-z_]\w*)(?!\w*\$)", value, text)


def run(text: str, session: Session) -> Session:
    """Run a script; the first command that fails ends it."""
    for c in parse(text):
        if c.name not in COMMANDS:
            raise ScriptError(f"line {c.line}: unknown command {c.name!r}")
        least, most, fn = COMMANDS[c.name]
        if not least <= len(c.args) <= most:
            raise ScriptError(f"line {c.line}: {c.name} takes {least} to {most} arguments, not {len(c.args)}")
        fill = (lambda t: t) if c.name == "pm" else (lambda t: substitute(t, session))
        fn(session, Command(c.name, [fill(a) for a in c.args], {k: fill(v) for k, v in c.options.items()}, c.line))
    return session
