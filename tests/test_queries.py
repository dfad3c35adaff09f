"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__
from framelake.plans import registry

SF = "/root/testdata/sf0.001"
#: A sample of every module; FRAMELAKE_ALL=1 runs all.
SOME = """stack_sum stack_weighted depth_median reject_modz reject_sigma norm_addscale weight_fwhm best_reference filter_percent_fwhm stat_noise stat_histogram
ikss_lite qn_robust_mean autostretch high_range ghs_negative ghs_inverse_asinh saturation_hue selective_colour palette_foraxx nb_normalize_hoo blend_overlay mask_chroma mask_polygon
pm_funcs pm_images pm_rescale pm_script nearest_one_to_one triangle_votes aperture_flux dedupe_objects curve_interp catalog_topk blackbody wcs_roundtrip sexagesimal header_coerce
bin3 debayer_bilinear blur cosmetic banding_fix cfa_equalize drizzle dark_scale calibrate event_sessions script_stack asof_events stat_robust_sigma six_repair""".split()


def clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()) if os.environ.get("FRAMELAKE_ALL") else SOME)
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(clean(dict(zip(cols, r))[c]) for c in order) for r in cur.fetchall()), key=key)
    got = sorted((tuple(clean(r[c]) for c in order) for r in df.collect()), key=key)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 64


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams(spark, tmp_path):
    from framelake.streaming import incremental

    events = spark.range(0, 200).selectExpr("id AS event_id", "timestamp_seconds(id * 600) AS ts", "id % 3 AS user_id", "CAST(id % 2 AS STRING) AS event_type", "CAST(id AS DOUBLE) AS value")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    got = incremental.run_available(incremental.windowed(stream), "win", "append", str(tmp_path / "cp"))
    batch = incremental.windowed(events)
    closed = got.count()
    assert 0 < closed <= batch.count()
    assert got.exceptAll(batch).count() == 0
    px = spark.range(0, 64).selectExpr("id % 4 AS frame_id", "CAST(id % 16 AS INT) AS x", "0 AS y", "0 AS c", "CAST(id % 5 AS DOUBLE) AS v")
    px.write.parquet(str(tmp_path / "px"))
    s = spark.readStream.schema(px.schema).parquet(str(tmp_path / "px"))
    live = incremental.run_available(incremental.running_stack(s), "stk", "complete", str(tmp_path / "cp2"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, incremental.running_stack(px).collect()))
