"""Expression languages and the script parser."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from framelake.functions import expr
from framelake.plans import script


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(0.25, 0.5, 0.75, None, 0.2, 0.3)], "r double, g double, b double, i1_r double, i1_g double, i1_b double")


def value(df, text, channel="r"):
    return df.select(F.expr(expr.compile_infix(text)[channel]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3", 8), ("-2 ^ 2", 4), ("~r", 0.75), ("!r", 0), ("!0", 1), ("r / 0", 1), ("7 % 0", 0), ("-7 % 3", -1),
        ("r < g && g < b", 1), ("r > g || b > g", 1), ("r == 0.25", 1), ("r != 0.25", 0), ("1 < 2 < 3", 1), ("sqrt(0 - 4)", 0), ("ln(0)", math.log(1e-300)),
        ("iif(r - g, 1, 2)", 2), ("IFF(1, R, G)", 0.25), ("clamp(5, 0, 1)", 1), ("max(r, g) + min(r, g)", 0.75), ("gamma(0 - 1, 2)", 0), ("trunc(0 - 2.7)", -2),
        ("mtf(0.5, 0.3)", 0.3), ("I1.g", 0.2), ("I1", 0), ("pi", math.pi), ("1e-2 * 100", 1), (".5 + 1.", 1.5), ("floor(2.9) + ceil(2.1)", 5), ("log2(8)", 3),
    ],
)
def test_values(one, text, want):
    assert value(one, text) == pytest.approx(want)


@pytest.mark.parametrize("text", ["", "1 +", "foo(1)", "min(1)", "(1", "1)", "q", "I0", "I11", "R=1; 2", "2 ^ 3 ^ 2 $", "1 2"])
def test_errors(text):
    with pytest.raises(expr.ExpressionError):
        expr.compile_infix(text)


def test_power_does_not_chain():
    with pytest.raises(expr.ExpressionError):
        expr.compile_infix("2 ^ 3 ^ 2")


def test_channels(one):
    made = expr.compile_infix("G = r + b; R = I1")
    assert set(made) == {"r", "g"}
    assert value(one, "G = r + b", "g") == 1.0


@pytest.mark.parametrize(
    ("text", "want"),
    [("~$a$", 0.75), ("~~$a$", 0.25), ("$a$ + $b$ * 2", 1.25), ("($a$ + $b$) * 2", 1.5), ("$a$ / 0", 0), ("mtf(0.2, 0)", 0), ("mtf(0.2, 1)", 1), ("mtf(2, $a$)", 0.25),
     ("min($a$, $b$)", 0.25), ("~mtf(~0.20, $a$) / ~mtf(~0.20, $b$)", None), ("$a$ - $b$ - 1", -1.25), ("~$a$ * 2", 1.5)],
)
def test_script_values(one, text, want):
    got = one.select(F.expr(expr.compile_script(text, {"a": "r", "b": "g"}.__getitem__)).alias("v")).first()["v"]
    assert got == pytest.approx(want) if want is not None else got > 0


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1)", "foo(1, 2)", "1 2", "$a"])
def test_script_errors(text):
    with pytest.raises(expr.ExpressionError):
        expr.compile_script(text, str)


def test_tokens_and_parse():
    assert script.tokenize("a 'b c' \"d\\\"e\" # rest") == ["a", "b c", 'd"e']
    assert script.tokenize("x; y") == ["x"]
    c = script.parse("stack lights 3 3 --method=median -norm add --flag \\\n -out = res.fit\n\n# note\nNEG")
    assert [x.name for x in c] == ["stack", "neg"] and c[0].args == ["lights", "3", "3"]
    assert c[0].options == {"method": "median", "norm": "add", "flag": "", "out": "res.fit"} and c[1].line == 5
    assert script.parse("stack a rej 3 3 -nonorm -out=b")[0].args == ["a", "rej", "3", "3"]


def test_all_commands_are_known():
    names = (
        "cd load save close stack rgbcomp linear_match pm starnet calibrate register convert link setmaster background seqsubsky debayer seqextract_ha "
        "seqextract_haoiii mirrorx mirrory rotate resample crop newproject convertall autostack seqapplyreg update_key stat thresh threshlo threshhi offset fmul neg"
    ).split()
    assert len(names) == 36 and set(names) <= set(script.COMMANDS)


@pytest.mark.parametrize("text", ["nothing", "neg 1", "crop 1 2", "load", "neg", "stack x --method=foo", "starnet", "load a.jpg"])
def test_script_refuses(spark, text):
    with pytest.raises((script.ScriptError, ValueError)):
        script.run(text, script.Session(spark))
