"""Connected components of a link table, by alternating large-star and small-star
contraction. Links stay distributed; only two numbers a round reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

#: Parts that the links of one node are dealt out in.
SALTS = 64


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; the root is the smallest node reachable.

    Self links and repeated links are ignored; an empty table gives an empty result.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = staged(links.select(high.alias("u"), low.alias("v")).where("u != v").distinct(), "links")
    state = _digest(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_least(both).withColumn("m", F.least("u", "m"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_staged(now)
        now, before, state = after, state, _digest(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_least(links: DataFrame) -> DataFrame:
    """``u, v, m``: every link with the least ``v`` of its ``u``. A hub may have a third of
    all links, so they are dealt out in ``SALTS`` parts; the part's least comes first,
    then the hub's, from one row a part."""
    salted = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("u", "s").agg(F.min("v").alias("p"))
    whole = part.groupBy("u").agg(F.min("p").alias("m"), F.collect_list("s").alias("parts"))
    return salted.join(whole.select("u", "m", F.explode("parts").alias("s")), ["u", "s"]).select("u", "v", "m")


def _digest(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    parts = [F.sum(F.shiftrightunsigned(mixed, 32)), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return tuple(links.agg(F.count("*"), *parts).first())
