"""Quality rules: a learned decision list over text statistics.

Statistics are built-in expressions. A list of rules is learned from labelled
rows by sequential covering: a rule grows one threshold condition at a time on a
growing set, is pruned on a held-back set, and is kept while it predicts low
quality well; the rows that it covers are set aside and the next rule is learned
from the rest. The list is emitted as one ``CASE WHEN`` expression.

Learning sees a bounded sample of labelled rows (``LEARN_ROWS``, those with the
smallest id hashes); statistics and verdicts cover every row of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, packed, quoted, text_or_empty, unpacked

#: Labelled rows that the list is learned from, at most.
LEARN_ROWS = 3_000
#: Words of a window whose repetition within a text counts.
REPEAT_WINDOW = 5
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that conditions may test: name -> expression over the counts.
RATIOS = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the count columns of the contract and ``n_lines`` (lines with a word).

    Windows are compared by a 64-bit hash of their word hashes, within one text.
    Null and empty texts have all counts zero; very long texts are counted whole.
    Columns of ``docs`` of the same names give way; others stay, whatever their names.
    """
    return unpacked(_counted(packed(docs, _text=text)), docs.columns, [*COUNTS, "n_lines"])


def _counted(whole: DataFrame) -> DataFrame:
    """``_doc`` and the counts of ``_text``."""
    body = text_or_empty("_text")
    spaced = F.regexp_replace(body, f"{SPACE}+", " ")
    df = whole.withColumn("_flat", F.trim(spaced))
    df = df.withColumn("_hash", F.when(F.col("_flat") == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split("_flat", " "), lambda w: F.xxhash64(w))))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    df = (
        df.withColumn("n_words", F.size("_hash").cast("long"))
        .withColumn("word_chars", F.length(F.translate("_flat", " ", "")).cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_flat", "_lines")
    )

    def tail(c: str, by: int) -> Column:
        return F.slice(c, by + 1, F.size(c))

    mixed = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn("_two", F.zip_with("_hash", tail("_hash", 1), mixed))
    df = df.withColumn("_four", F.zip_with("_two", tail("_two", 2), mixed))
    five = F.zip_with("_four", tail("_hash", REPEAT_WINDOW - 1), mixed)
    whole = F.greatest(F.size("_hash") - (REPEAT_WINDOW - 1), F.lit(0))
    df = df.withColumn("_windows", F.slice(five, 1, whole)).drop("_hash", "_two", "_four")
    # only texts with a repeated window sort theirs by (hash, place)
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(repeated, F.sort_array(placed))).drop("_windows")
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.slice(F.concat(nothing, "_sorted"), 1, F.size("_sorted"))
    after = F.concat(tail("_sorted", 1), nothing)
    first = F.zip_with("_sorted", before, lambda x, y: F.struct(x["i"].alias("i"), x["h"].eqNullSafe(y["h"]).alias("e"), x["h"].alias("h")))
    both = F.zip_with(first, after, lambda x, y: F.when(x["e"] | x["h"].eqNullSafe(y["h"]), x["i"]))
    df = df.withColumn("_at", F.sort_array(F.filter(both, lambda x: x.isNotNull()))).drop("_sorted")
    gaps = F.zip_with("_at", tail("_at", 1), lambda x, y: F.least(F.lit(REPEAT_WINDOW), F.coalesce(y - x, F.lit(REPEAT_WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.threshold if self.above else row[self.name] <= self.threshold

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Low quality where all conditions hold."""

    conditions: tuple[Condition, ...]

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.name} {'>' if c.above else '<='} {c.threshold:g}" for c in self.conditions)


def learn_rules(
    rows: list[tuple[dict, int]],
    *,
    max_rules: int = 12,
    max_conditions: int = 4,
    min_cover: int = 5,
    min_precision: float = 0.9,
) -> list[Rule]:
    """Sequential covering over (statistics, quality) rows; quality 0 is what rules find.

    Rows keep their order: every third is held back for pruning. No rows, or
    rows of one class, give an empty list.
    """
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(y == 0 for _, y in grow):
        conditions: list[Condition] = []
        inside = grow
        while len(conditions) < max_conditions and any(y for _, y in inside):
            best = _best_condition(inside, min_cover)
            if best is None:
                break
            conditions.append(best)
            inside = [r for r in inside if best.holds(r[0])]
        if not conditions:
            break
        rule = _pruned(conditions, prune)
        hit = [y for x, y in grow + prune if rule.holds(x)]
        if len(hit) < min_cover or hit.count(0) < min_precision * len(hit):
            break
        rules.append(rule)
        grow = [r for r in grow if not rule.holds(r[0])]
        prune = [r for r in prune if not rule.holds(r[0])]
    return rules


def _best_condition(rows: list[tuple[dict, int]], min_cover: int) -> Condition | None:
    """The condition with the greatest information gain for quality 0 (FOIL's measure)."""
    low = sum(y == 0 for _, y in rows)
    if not low or low == len(rows):
        return None
    start = math.log2(low / len(rows))
    best, found = 1e-9, None
    for name in RATIOS:
        ordered = sorted((x[name], y) for x, y in rows)
        total, seen_low = len(ordered), 0
        for i in range(total - 1):
            seen_low += ordered[i][1] == 0
            if ordered[i][0] == ordered[i + 1][0]:
                continue
            middle = (ordered[i][0] + ordered[i + 1][0]) / 2
            for above, n, zeros in ((False, i + 1, seen_low), (True, total - i - 1, low - seen_low)):
                if zeros >= min_cover and (gain := zeros * (math.log2(zeros / n) - start)) > best:
                    best, found = gain, Condition(name, above, middle)
    return found


def _pruned(conditions: list[Condition], rows: list[tuple[dict, int]]) -> Rule:
    """Drop final conditions while that doesn't lower the rule's worth on held-back rows."""

    def worth(n: int) -> float:
        hit = [y for x, y in rows if all(c.holds(x) for c in conditions[:n])]
        return (hit.count(0) - hit.count(1)) / len(hit) if hit else -1.0

    best = max(range(1, len(conditions) + 1), key=lambda n: (worth(n), -n))
    return Rule(tuple(conditions[:best]))


def learned(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = LEARN_ROWS) -> list[Rule]:
    """Rules from a bounded sample of labelled documents that pass the base rules."""
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.min(quality).alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers
    rows = docs.select(F.col(quoted(doc_id)).alias("_id"), F.col(quoted(text)).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = _counted(rows)
    ratios = [F.expr(e).alias(f"r_{n}") for n, e in RATIOS.items()]
    stats = rows.select(F.xxhash64("_id").alias("_order"), "_id", F.col("_quality").cast("int"), base_failed(), *ratios)
    # a filter here would evaluate all counts once more: the base rules are applied to the small result
    table = sorted({tuple(r) for r in stats.orderBy("_order", "_id").limit(sample).collect()})
    return learn_rules([(dict(zip(RATIOS, r[4:])), r[2]) for r in table if not r[3]])


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """The list as ordered conditionals: kept, and the number of the rule that fired (null: none)."""
    fired = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        fired = F.when(rules[k].column(), F.lit(k)).otherwise(fired)
    return fired.isNull() & ~base_failed(), F.when(~base_failed(), fired)


def keep(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns, whatever their names."""
    # the row number keeps the optimizer from evaluating the counts a second time below the filter
    judged = _judged(packed(docs, _text=text), rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select("_doc.*")


def judge(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``kept`` and ``rule``.

    A text without words fails the base rules. Repeated rows are judged alike,
    very long texts whole, of several rules that hold (a tie) the first of the list
    fires, and an empty table stays empty. Columns of ``docs`` of the added ones'
    names give way.
    """
    return unpacked(_judged(packed(docs, _text=text), rules), docs.columns, [*COUNTS, "n_lines", "base_failed", "kept", "rule"])


def _judged(whole: DataFrame, rules: list[Rule]) -> DataFrame:
    kept, rule = verdict(rules)
    return _counted(whole).select("*", base_failed().alias("base_failed"), kept.alias("kept"), rule.alias("rule"))
