"""The script command linear_match brings its second image to the first."""

from __future__ import annotations

import pytest

from framelake.plans import script


def test_second_image_is_scaled_to_the_first(spark):
    values = [0.1, 0.2, 0.25, 0.3, 0.42, 0.5, 0.55, 0.6, 0.75]
    s = script.Session(spark)
    schema = "frame_id long, x int, y int, c int, v double"
    s.sequences["one"] = spark.createDataFrame([(0, k % 3, k // 3, 0, v) for k, v in enumerate(values)], schema)
    s.sequences["two"] = spark.createDataFrame([(1, k % 3, k // 3, 0, 0.05 + 0.5 * v) for k, v in enumerate(values)], schema)
    got = {(r["x"], r["y"]): r["v"] for r in script.run("linear_match one two", s).current.collect()}
    assert got == {(k % 3, k // 3): pytest.approx(v) for k, v in enumerate(values)}
