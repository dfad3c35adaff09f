"""Tables from and to frame files.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads
will do; a file is decoded where it is read. Name filters and path pruning apply
before bytes are fetched; headers alone are decoded without pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codecs

PIXELS = "frame_id long, hdu int, x int, y int, c int, v double"
CARDS = "frame_id long, hdu int, pos int, key string, value string, comment string"


def sequence(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``frame_id, path, content``: files numbered from 0 by name. The numbering window
    is over file names alone, one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    order = files.select("path").withColumn("frame_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    return files.select("path", "content").join(order, "path").select("frame_id", "path", "content")


def read_pixels(files: DataFrame, kind: str, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Long pixels of every image unit of the files (``frame_id, content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                images = codecs.read_fits(data, region=region) if kind == "fits" else codecs.READERS[kind](data)
                for hdu, image in enumerate(images):
                    c, h, w = image.data.shape
                    a = image.data
                    if region and kind != "fits":
                        a = a[:, max(0, region[1]) : region[1] + region[3], max(0, region[0]) : region[0] + region[2]]
                        c, h, w = a.shape
                    x0, y0 = (max(0, region[0]), max(0, region[1])) if region else (0, 0)
                    for k in range(c):  # one batch a channel bounds memory
                        yy, xx = np.mgrid[y0 : y0 + h, x0 : x0 + w]
                        n = h * w
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, frame, np.int64)), pa.array(np.full(n, hdu, np.int32)), pa.array(xx.ravel().astype(np.int32)),
                             pa.array(yy.ravel().astype(np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(a[k].ravel().astype(float))],
                            ["frame_id", "hdu", "x", "y", "c", "v"])

    return files.select("frame_id", "content").mapInArrow(run, PIXELS)


def read_cards(files: DataFrame, kind: str = "fits") -> DataFrame:
    """Header cards in order, one row each; pixels are not decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for frame, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                images = codecs.read_fits(content.as_py(), pixels=False) if kind == "fits" else codecs.READERS[kind](content.as_py())
                rows += [(frame, hdu, pos, *card) for hdu, image in enumerate(images) for pos, card in enumerate(image.cards)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["frame_id", "hdu", "pos", "key", "value", "comment"])

    return files.select("frame_id", "content").mapInArrow(run, CARDS)


def encode(px: DataFrame, kind: str, cards: list[codecs.Card] = (), bits: int | None = None) -> DataFrame:
    """``frame_id, content``: each frame's pixels as a file. A frame must fit a task."""
    cards = list(cards)

    def run(table: pa.Table) -> pa.Table:
        x, y, c = (table.column(k).to_numpy() for k in ("x", "y", "c"))
        a = np.zeros((int(c.max()) + 1, int(y.max()) + 1, int(x.max()) + 1))
        a[c, y, x] = table.column("v").to_numpy()
        args = (bits,) if bits is not None else ()
        data = codecs.WRITERS[kind](codecs.Image(a, cards), *args)
        return pa.table([pa.array([table.column("frame_id")[0].as_py()], pa.int64()), pa.array([data], pa.binary())], names=["frame_id", "content"])

    flat = px.select(F.col("frame_id").cast("long").alias("frame_id"), "x", "y", F.col("c").cast("int").alias("c"), "v")
    return flat.groupBy("frame_id").applyInArrow(run, "frame_id long, content binary")


def write_files(files: DataFrame, folder: str, prefix: str, suffix: str) -> None:
    """Write ``frame_id, content`` rows as files through the JVM-independent file
    system layer of Arrow; each task writes its own files, so a retried task rewrites them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for frame, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with store.open_output_stream(f"{root}/{prefix}{frame:05d}{suffix}") as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["frame_id"])

    files.select("frame_id", "content").mapInArrow(run, "frame_id long").count()


CATALOG = "name string, ra double, dec double, diameter double, mag double, alias string"


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """A CSV catalog with a header; rows without coordinates are left out."""
    return spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).where("ra IS NOT NULL AND dec IS NOT NULL")


CURVES = (
    "model string, name string, type string, channel string, dataQualityMarker int, version int, "
    "wavelength struct<value: array<double>, units: string>, `values` struct<value: array<double>, range: double>")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """``name, model, type, channel, wl, y`` of JSON curve files (object or array):
    wavelengths in angstrom and ascending, values divided by a range above 1."""
    raw = spark.read.schema(CURVES).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    unit = F.lower(F.coalesce("wavelength.units", F.lit("")))
    wl = F.col("wavelength.value")
    s = F.sort_array(wl)
    middle = F.get(s, F.floor(F.size(s) / 2).cast("int"))
    factor = F.when(unit.isin("nm", "nanometer", "nanometers"), 10.0).when(unit.isin("um", "µm", "micron"), 1e4).when((unit == "") & middle.between(250, 2000), 10.0).otherwise(1.0)
    span = F.when(F.col("values.range") > 1, F.col("values.range")).otherwise(1.0)
    size = F.size(wl)
    df = raw.where((F.size(wl) > 1) & (F.size("values.value") == F.size(wl))).select(
        "name", "model", "type", "channel",
        F.zip_with(wl, F.array_repeat(factor, size), lambda a, f: a * f).alias("wl"),
        F.zip_with("values.value", F.array_repeat(span, size), lambda a, f: a / f).alias("y"))
    down = F.element_at("wl", 1) > F.element_at("wl", -1)
    return df.withColumns({"y": F.when(down, F.reverse("y")).otherwise(F.col("y")), "wl": F.when(down, F.reverse("wl")).otherwise(F.col("wl"))})


SEQUENCE = ("version int, type string, reference int, drizzle boolean, images array<struct<filename: string, selected: boolean, calibrated: boolean, registered: boolean, "
            "fwhm: double, roundness: double, background: double, stars: int, registration: struct<shiftX: double, shiftY: double, rotation: double, scaleX: double, scaleY: double, homography: array<double>>>>")


def read_sequence_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a frame of a sequence file, numbered in file order."""
    s = spark.read.schema(SEQUENCE).option("multiLine", True).json(path)
    return s.select("reference", F.posexplode("images").alias("idx", "i")).select("reference", "idx", "i.*")


def write_sequence_json(frames: DataFrame, path: str, reference: int = 0) -> None:
    """``idx`` and the frame columns as one sequence object."""
    cols = [c for c in frames.columns if c not in ("idx", "reference")]
    images = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.struct(*cols).alias("i")))), lambda s: s["i"])
    frames.agg(images.alias("images")).select(F.lit(1).alias("version"), F.lit("sequence").alias("type"), F.lit(reference).alias("reference"), "images").coalesce(1).write.mode("overwrite").json(path)


def read_votable(xml: DataFrame, text: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of VOTable documents in column ``text``. ``fields`` maps output names to
    acceptable field names, ids or UCDs; a missing field is null, values are doubles."""
    heads = [F.expr(f"xpath({text}, '//FIELD/@{a}')") for a in ("name", "ID", "ucd")]
    cells = F.split(text, r"<TR>")
    body = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    named = [f"_h{k}" for k in range(3)]
    df = xml.select(*[h.alias(n) for n, h in zip(named, heads)], body.alias("_body"))  # once a document, not once a row
    df = df.select(*named, F.posexplode("_body").alias("row", "_tr"))
    td = F.transform(F.regexp_extract_all("_tr", F.lit(r"<TD\s*/>|<TD>([^<]*)</TD>"), 1), lambda c: F.trim(c))
    df = df.withColumn("_td", td)
    out = []
    for name, accepted in fields.items():
        place = F.lit(None).cast("int")
        for k in range(3):
            for a in accepted:
                hit = F.array_position(F.transform(F.col(f"_h{k}"), lambda s: F.lower(s)), a.lower()).cast("int")
                place = F.coalesce(place, F.when(hit > 0, hit))
        out.append(F.when(place.isNotNull(), F.get("_td", place - 1)).try_cast("double").alias(name))
    return df.select("row", *out)
