"""Declarative pixel transforms.

A ``Transform`` is a list of layers; a layer names new columns by SQL expressions
over the columns before it, and may first bring in one-row statistics of the
table so far. The text keeps to what Spark and DuckDB read alike (doubles in
exponent form, CASE, least and greatest), so one definition gives a lazy
DataFrame plan and the SQL that checks it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    columns: dict[str, str] = field(default_factory=dict)
    stats: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Transform:
    layers: tuple[Layer, ...]
    out: dict[str, str]

    def apply(self, df: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
        """``keys`` and the outputs. Statistics enter as a broadcast one-row aggregate."""
        for layer in self.layers:
            if layer.stats:
                row = df.agg(*[F.expr(spark_text(e)).alias(n) for n, e in layer.stats.items()])
                df = df.crossJoin(F.broadcast(row))
            if layer.columns:
                df = df.withColumns({n: F.expr(spark_text(e)) for n, e in layer.columns.items()})
        out = {n: F.expr(spark_text(e)) for n, e in self.out.items()}
        return df.select(*keys, *[(F.round(c, digits) if digits else c).alias(n) for n, c in out.items()])

    def sql(self, view: str, name: str, keys: list[str], digits: int = 7) -> str:
        parts, now = [view], name
        for i, layer in enumerate(self.layers):
            frm = now
            if layer.stats:
                parts.append(f"st{i} AS (SELECT " + ", ".join(f"{duck_text(e)} AS {n}" for n, e in layer.stats.items()) + f" FROM {now})")
                frm = f"{now}, st{i}"
            cols = "".join(f", {duck_text(e)} AS {n}" for n, e in layer.columns.items())
            parts.append(f"l{i} AS (SELECT *{cols} FROM {frm})")
            now = f"l{i}"
        out = ", ".join(f"round({duck_text(e)}, {digits}) AS {n}" for n, e in self.out.items())
        return f"WITH {', '.join(parts)} SELECT {', '.join(keys)}, {out} FROM {now}"


def spark_text(e: str) -> str:
    return re.sub(r"\bquantile\(", "percentile(", e)


def duck_text(e: str) -> str:
    return re.sub(r"\bquantile\(", "quantile_cont(", e)


def num(x: float) -> str:
    """A double literal that both engines read as a double."""
    text = f"{float(x):.17e}"
    return f"({text})" if x < 0 else text


def clamp(e: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"least({num(hi)}, greatest({num(lo)}, {e}))"


def one(**out: str) -> Transform:
    return Transform((), out)


def steps(*layers: Layer | dict, out: dict[str, str]) -> Transform:
    return Transform(tuple(x if isinstance(x, Layer) else Layer(x) for x in layers), out)
