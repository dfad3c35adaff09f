"""Frame formats: exact round trips, and the readers over files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.plans import script
from framelake.sources import codecs, readers

CARDS = [("OBJECT", "M 31's core", "a name"), ("EXPTIME", "30.5", "s"), ("FILTER", "Ha", ""), ("bad key!", "1", ""), ("NAXIS1", "9", "")]


def image(channels=1, seed=0):
    return codecs.Image(np.random.default_rng(seed).random((channels, 5, 7)), list(CARDS))


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize(("bits", "tolerance"), [(8, 3e-3), (16, 1e-5), (32, 1e-9), (-32, 1e-7), (-64, 0)])
def test_fits(channels, bits, tolerance):
    src = image(channels)
    back = codecs.read_fits(codecs.write_fits(src, bits))
    assert len(back) == 1 and np.abs(back[0].data - src.data).max() <= tolerance
    assert back[0].card("OBJECT") == "M 31's core" and back[0].card("EXPTIME") == "30.5" and back[0].card("bad key!") is None
    part = codecs.read_fits(codecs.write_fits(src, bits), region=(5, 1, 10, 2))[0].data
    assert part.shape == (channels, 2, 2)


@pytest.mark.parametrize("codec", [None, "zlib", "zstd"])
def test_xisf(codec):
    src = image(3)
    back = codecs.read_xisf(codecs.write_xisf(src, codec))[0]
    assert np.allclose(back.data, src.data, atol=1e-7) and back.card("FILTER") == "Ha"


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_tiff(bits):
    src = image(3)
    assert np.allclose(codecs.read_tiff(codecs.write_tiff(src, bits)).data, src.data, atol=3e-3)


@pytest.mark.parametrize("depth", [8, 16])
def test_ser(depth):
    frames = [image(1, k).data for k in range(3)]
    back, stamps, head = codecs.read_ser(codecs.write_ser(frames, [10, 20, 30], depth))
    assert stamps == [10, 20, 30] and head["frames"] == 3
    assert all(np.allclose(a, b, atol=3e-3) for a, b in zip(frames, back))
    assert codecs.read_ser(codecs.write_ser(frames))[1] == [None] * 3


def test_shuffle_and_scaling():
    data = bytes(range(23))
    assert codecs.unshuffle(codecs.shuffle(data, 4), 4) == data
    assert codecs.scale_to_unit(np.array([0.0, 200.0]), 32, True).max() == pytest.approx(200 / 255)
    assert codecs.scale_to_unit(np.array([0.0, 60000.0]), 32, True).max() == pytest.approx(60000 / 65535)
    assert codecs.scale_to_unit(np.array([0.0, 1e6]), 32, True).max() == 1e6


def test_bad_files():
    for read in (codecs.read_xisf, codecs.read_ser, codecs.read_tiff):
        with pytest.raises(Exception):  # noqa: B017
            read(b"nothing of the kind" * 20)
    assert codecs.read_fits(b"") == []


@pytest.fixture
def lights(tmp_path):
    for k in range(4):
        (tmp_path / f"light_{k}.fit").write_bytes(codecs.write_fits(codecs.Image(np.full((1, 6, 6), 0.1 * (k + 1)), [("FILTER", "Ha", "")]), -64))
    return tmp_path


def test_readers(spark, lights, tmp_path):
    files = readers.sequence(spark, str(lights), "*.fit")
    px = readers.read_pixels(files, "fits")
    got = {r["frame_id"]: r["m"] for r in px.groupBy("frame_id").agg(F.avg("v").alias("m")).collect()}
    assert got == {k: pytest.approx(0.1 * (k + 1)) for k in range(4)}
    assert readers.read_pixels(files, "fits", (4, 4, 9, 9)).count() == 4 * 4
    assert readers.read_cards(files).where("key = 'FILTER' AND value = 'Ha'").count() == 4
    readers.write_files(readers.encode(px.drop("hdu"), "fits"), "file://" + str(tmp_path / "out"), "f_", ".fit")
    again = readers.read_pixels(readers.sequence(spark, str(tmp_path / "out"), "f_*.fit"), "fits")
    assert again.count() == px.count()


def test_script_over_files(spark, lights):
    s = script.Session(spark, str(lights))
    script.run("convert light\nstack light --method=mean --rejection=none -nonorm --out=result\nupdate_key OBJECT 'two words' note\nsave result.fit\nload result.fit\nstat\nset f ${FILTER}${OBJECT}", s)
    assert float(s.variables["mean"]) == pytest.approx(0.25, abs=1e-6)
    back = codecs.read_fits((lights / "result.fit").read_bytes())[0]
    assert back.card("OBJECT") == "two words"


def test_calibrate_script(spark):
    rows = [(f, x, y, 0, 0.5 + 0.1 * f + 0.01 * x) for f in range(3) for x in range(6) for y in range(6)]
    s = script.Session(spark)
    px = spark.createDataFrame(rows, "frame_id long, x int, y int, c int, v double")
    s.sequences |= {"light": px, "bias": px.where("frame_id = 0").withColumn("v", F.lit(0.1)), "flat": px.where("frame_id = 0").withColumn("v", F.lit(0.8))}
    script.run("setmaster bias bias.fit\ncalibrate light -flat=flat.fit\nstack pp_light --method=median -nonorm --out=r\noffset 0.1\nbackground 1\nmirrorx\nrotate 90\nrotate 10\nresample 0.5\nrgbcomp r r r\nlinear_match r r", s)
    assert s.current.count() == 36


def test_catalog_and_curves(spark, tmp_path):
    (tmp_path / "cat.csv").write_text("name,ra,dec,diameter,mag,alias\nA , 10.5,-3,1,2,x\nB,,4,1,2,\n")
    got = readers.read_catalog(spark, str(tmp_path / "cat.csv")).collect()
    assert [(r["name"], r["ra"], r["dec"]) for r in got] == [("A", 10.5, -3.0)]
    folder = tmp_path / "curves"
    folder.mkdir()
    (folder / "a.json").write_text('[{"model":"m","name":"n","type":"t","channel":"RED","version":1,"wavelength":{"value":[500,450,400],"units":"nm"},"values":{"value":[10,20,30],"range":100}}]')
    r = readers.read_curves(spark, str(folder)).first()
    assert r["wl"] == [4000.0, 4500.0, 5000.0] and r["y"] == pytest.approx([0.3, 0.2, 0.1])


def test_sequence_json(spark, tmp_path):
    reg = (1.0, 2.0, 0.0, 1.0, 1.0, [1.0] * 9)
    frames = spark.createDataFrame([(k, f"f{k}.fit", True, False, True, 2.0, 0.9, 0.1, 5, reg) for k in (1, 0)],
                                   "idx int, filename string, selected boolean, calibrated boolean, registered boolean, fwhm double, roundness double, background double, stars int, "
                                   "registration struct<shiftX: double, shiftY: double, rotation: double, scaleX: double, scaleY: double, homography: array<double>>")
    readers.write_sequence_json(frames, str(tmp_path / "s"))
    back = readers.read_sequence_json(spark, str(tmp_path / "s")).orderBy("idx").collect()
    assert [r["filename"] for r in back] == ["f0.fit", "f1.fit"] and back[0]["registration"]["shiftY"] == 2.0


def test_votable(spark):
    xml = ('<VOTABLE><RESOURCE><TABLE><FIELD name="RA_ICRS" ID="ra" ucd="pos.eq.ra"/><FIELD name="DE_ICRS" ID="de" ucd="pos.eq.dec"/><FIELD name="Gmag" ID="g" ucd="phot.mag"/>'
           "<DATA><TABLEDATA><TR><TD>10.5</TD><TD>-2</TD><TD></TD></TR><TR><TD>11</TD><TD>3</TD><TD>12.25</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>")
    t = readers.read_votable(spark.createDataFrame([(xml,)], "doc string"), "doc", {"ra": ("ra_icrs",), "dec": ("pos.eq.dec",), "g": ("gmag",), "teff": ("teff",)})
    got = [tuple(r)[1:] for r in t.orderBy("row").collect()]
    assert got == [(10.5, -2.0, None, None), (11.0, 3.0, 12.25, None)]
