"""Queries that pass frames and catalogs through the file formats and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.plans import views
from framelake.plans.registry import query
from framelake.sources import readers

PX = views.PX
CARDS = [("OBJECT", "field's centre", "a note"), ("EXPTIME", "12.5", "s"), ("FILTER", "Ha", "")]


def frames(spark, d):
    return views.px(spark, d).drop("label")


for _kind, _bits, _stored in (("fits", -64, "v"), ("fits", -32, "v::FLOAT::DOUBLE"), ("xisf", None, "v::FLOAT::DOUBLE"), ("tiff", 32, "v::FLOAT::DOUBLE")):
    _name = f"roundtrip_{_kind}" + (str(abs(_bits)) if _kind == "fits" else "")
    query(_name, f"WITH {PX} SELECT frame_id, x, y, {_stored} AS v FROM px")(lambda spark, d, k=_kind, b=_bits: _roundtrip(spark, d, k, b))


def _roundtrip(spark, d, kind, bits):
    """Every pixel as the file holds it, to the last bit: a double, or the nearest 32-bit float."""
    return readers.read_pixels(readers.encode(frames(spark, d), kind, CARDS, bits), kind).select("frame_id", "x", "y", "v")


@query("fits_region", f"WITH {PX} SELECT frame_id, x, y, v FROM px WHERE x BETWEEN 2 AND 4 AND y BETWEEN 5 AND 7")
def fits_region(spark, d):
    """Only the rectangle is decoded; it is clamped to the frame."""
    files = readers.encode(frames(spark, d), "fits", CARDS, -64)
    return readers.read_pixels(files, "fits", (2, 5, 3, 9)).select("frame_id", "x", "y", "v")


@query("fits_cards", """WITH f AS (SELECT vec_id AS frame_id FROM embeddings), c(key, value, comment) AS (VALUES ('OBJECT', 'field''s centre', 'a note'), ('EXPTIME', '12.5', 's'), ('FILTER', 'Ha', ''))
SELECT frame_id, key, value, comment FROM f, c""")
def fits_cards(spark, d):
    cards = readers.read_cards(readers.encode(frames(spark, d), "fits", CARDS))
    return cards.where(F.col("key").isin([k for k, _, _ in CARDS])).select("frame_id", "key", "value", "comment")


@query("votable_parse", f"WITH {views.CAT} SELECT id, ra, dec, mag_v FROM cat")
def votable_parse(spark, d):
    """A document holds the rows of a thousand ids."""
    c = views.catalog(spark, d)
    cell = lambda x: F.concat(F.lit("<TD>"), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit("</TD>"))
    row = F.concat(F.lit("<TR>"), cell("id"), cell("ra"), cell("dec"), cell("mag_v"), F.lit("</TR>"))
    head = '<VOTABLE><RESOURCE><TABLE><FIELD name="recno" ID="id" ucd="meta.record"/><FIELD name="RAJ2000" ID="r" ucd="pos.eq.ra"/><FIELD name="DEJ2000" ID="d" ucd="pos.eq.dec"/><FIELD name="Vmag" ID="v" ucd="phot.mag"/><DATA><TABLEDATA>'
    docs = c.select(F.floor(F.col("id") / 1000).alias("part"), row.alias("t")).groupBy("part").agg(F.concat(F.lit(head), F.concat_ws("", F.collect_list("t")), F.lit("</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>")).alias("doc"))
    t = readers.read_votable(docs, "doc", {"id": ("meta.record",), "ra": ("raj2000", "ra_icrs"), "dec": ("dej2000",), "mag_v": ("vmag",)})
    return t.select(F.col("id").cast("long").alias("id"), "ra", "dec", "mag_v")


@query("sequence_numbers", "SELECT vec_id AS name, row_number() OVER (ORDER BY 'frame_' || lpad(CAST(vec_id AS VARCHAR), 6, '0')) - 1 AS frame_id FROM embeddings")
def sequence_numbers(spark, d):
    """Frames numbered by file name; the window is over names alone, one row a file."""
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.concat(F.lit("frame_"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("path"))
    from pyspark.sql import Window

    return e.withColumn("frame_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1).select("name", "frame_id")
