"""Mixing sources to target weights.

Tokens are summed for each source; the sum of all is shared out by weight; a
source's *rate* is its target over its size. A document is emitted floor(rate)
times, plus one more copy with a probability equal to the fraction, drawn from a
hash of its id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe, packed, quoted, ranked, uniform, unpacked, word_count

#: Above this many sources their table is joined by a shuffle; below it is broadcast.
BROADCAST_SOURCES = 100_000
SEED = 20_240_229
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def source_targets(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
) -> tuple[DataFrame, int]:
    """One row a source (``src``, ``source_size``, ``weight``, ``target``), and how many.

    Sources in code point order, null last, take ``weights`` in turn. Targets
    share the sum of all sizes by weight. A target above ``cap`` times its
    source's size stops there and the excess is shared by weight among the
    others, until none is above. An empty table gives no rows; a source without
    words has target 0.
    """
    sizes = (
        docs.select(F.col(quoted(source)).alias("src"), word_count(F.col(quoted(text))).alias("n"))
        .groupBy("src")
        .agg(F.sum("n").alias("source_size"))
    )
    numbered = ranked(sizes, [F.col("src").asc_nulls_last()], "mix-sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    numbered = numbered.select("src", "source_size", pick.alias("weight"))
    limit = F.lit(cap) * F.col("source_size")
    first = numbered.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    total, free, count = float(first[0] or 0), float(first[1] or 0), first[2]
    spare, level = total, None
    while True:  # each round caps at least one source more, or ends
        share = F.lit(spare) * F.col("weight") / F.lit(free) if free else F.lit(0.0)
        over = share > limit
        held, left = numbered.agg(
            F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(~over, F.col("weight")).otherwise(0.0))
        ).first()
        held, left = float(held or 0), float(left or 0)
        if (total - held, left) == (spare, free) or level == (spare, free):
            break
        level = (spare, free)
        spare, free = total - held, left
    share = F.lit(spare) * F.col("weight") / F.lit(free) if free else limit
    return numbered.withColumn("target", F.when(share > limit, limit).otherwise(share)), count


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    A null text has size 0, a null source is a source of its own, rows repeated
    with one id get the same number of copies, very long texts are counted whole,
    sources of equal size are told apart by their names, an empty table stays empty.
    Columns of ``docs`` named like the four give way; others pass through.
    """
    return unpacked(_mixed(docs, doc_id, text, source, weights, cap, seed), docs.columns, ADDED)


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], cap: float, seed: int) -> DataFrame:
    """``_doc`` with the four columns."""
    targets, count = source_targets(docs, text=text, source=source, weights=weights, cap=cap)
    right = targets.select(
        F.col("src").alias("_mix_src"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
    )
    if count <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    whole = packed(docs, _id=doc_id, _source=source, mix_size=word_count(F.col(quoted(text))))
    joined = whole.join(right, null_safe(F.col("_source"), F.col("_mix_src")), "left")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    extra = (uniform(seed, F.col("_id")) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("mix_copies", F.floor(rate) + extra)


def emit(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    seed: int = SEED,
) -> DataFrame:
    """Each row of ``docs`` as often as ``mix`` says, with its own columns, whatever their names."""
    mixed = _mixed(docs, doc_id, text, source, weights, cap, seed)
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return mixed.where("mix_copies > 0").select("_doc", copies.alias("_copy")).select("_doc.*")
