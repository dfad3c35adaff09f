"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model of text statistics, fitted on a bounded sample of labelled
documents, gives each document's evidence. Evidence is averaged for every host
and for every path of a host by grouped aggregation. The spread between hosts
sets how strongly a host is drawn to the global mean, and the spread between
paths how strongly a path is drawn to its host: sparse sites lie near their
prior, large ones near their own mean. A document's posterior combines its own
evidence with its path's posterior, from which its own share is taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Labelled rows that the document model is fitted on, at most.
FIT_ROWS = 4_000
#: Bounds of a document's and a site's log odds.
MOST_EVIDENCE, MOST_PRIOR = 12.0, 3.0
#: Up to so many paths the site table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SITES = 100_000
SYMBOLS = b"#*$%&|<>"
FEATURES = 12


def features(text: bytes | None) -> list[float]:
    """Statistics of a text; all zero for a null or empty one."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = float(sum(map(len, words)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n = float(len(words))
    return [
        np.log1p(n),
        chars / n,
        float(counts[list(SYMBOLS)].sum()) / chars,
        float(counts[48:58].sum()) / chars,
        float(counts[65:91].sum()) / chars,
        float(counts[128:].sum()) / chars,
        float(counts[[33, 34, 39, 44, 46, 58, 59, 63]].sum()) / chars,
        1.0 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / n,
        min(n / max(1, len(lines)), 500.0) / 100.0,
        float(counts[46]) / n,
        float(counts[64] + counts[47]) / chars,
    ]


class LogisticModel:
    """Regularised logistic regression by Newton steps; log odds of quality 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
        self.scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(FEATURES)
        self.weight = np.zeros(FEATURES + 1)
        self.prior = float((y.sum() + 1.0) / (len(y) + 2.0)) if len(y) else 0.5
        if not len(y) or y.min() == y.max():
            self.weight[0] = np.log(self.prior / (1 - self.prior))
            return
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        keep = ridge * np.eye(FEATURES + 1)
        keep[0, 0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
            slope = z.T @ (y - p) - keep @ self.weight
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, slope)
            self.weight += step
            if np.abs(step).max() < 1e-8:
                break


def log_odds(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -12, 12)
    return np.clip(weight[0] + z @ weight[1:], -MOST_EVIDENCE, MOST_EVIDENCE)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = FIT_ROWS) -> LogisticModel:
    """A document model from the labelled rows with the smallest id hashes."""
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.min(quality).cast("int").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    # of rows that share an id the one with the least text hash, so at most ``sample`` rows of a few numbers
    rows = rows.groupBy("_id").agg(F.min_by(F.struct("_quality", "_text"), F.xxhash64("_text")).alias("r")).select("r.*")
    table = sorted((r["y"], r["x"]) for r in rows.mapInArrow(run, "y int, x array<double>").collect())
    x = np.array([r[1] for r in table], dtype=float).reshape(len(table), FEATURES)
    return LogisticModel(x, np.array([r[0] for r in table], dtype=float))


def _spread(sites: DataFrame, n: str, mean: str, prior: str, within: str) -> float:
    """Pseudo-count of a level's prior by the method of moments: within-site variance
    over between-site variance. One row reaches the driver."""
    gap = (F.col(mean) - F.col(prior)) * (F.col(mean) - F.col(prior))
    row = sites.agg(
        F.sum(F.col(n) * gap).alias("between"),
        F.sum(F.col(within)).alias("within"),
        F.sum(F.col(n)).alias("n"),
        F.count("*").alias("sites"),
    ).first()
    if not row["n"] or row["sites"] < 2 or row["n"] <= row["sites"]:
        return 10.0
    noise = max(row["within"] / row["n"], 1e-6)
    tau = max((row["between"] - row["sites"] * noise) / row["n"], noise / 1e4)
    return float(min(max(noise / tau, 0.5), 1e4))


def classify(docs: DataFrame, model: LogisticModel, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, evidence, host_prior, path_prior, quality, kept`` for every row.

    ``evidence`` is the document model's probability, ``quality`` the posterior,
    ``kept`` whether it is at least one half. A null host or path is a site of
    its own, a site of one document has its parent's prior, null and empty texts
    have the evidence of a text without words, very long texts are read whole,
    repeated rows stay repeated, a posterior of just one half (a tie) is kept, other
    columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.mean, model.scale, model.weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(3).cast(pa.binary())], dtype=float).reshape(-1, FEATURES)
            odds = pa.array(log_odds(x, *shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], odds], ["doc_id", "host", "path", "odds"])

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"),
    )
    scored = staged(chosen.mapInArrow(run, f"doc_id {kind}, host string, path string, odds double"), "site-evidence")
    p = 1 / (1 + F.exp(-F.col("odds")))
    scored = scored.withColumn("p", p)
    paths = staged(scored.groupBy("host", "path").agg(
        F.count("*").alias("pn"), F.sum("p").alias("ps"), F.sum(F.col("p") * F.col("p")).alias("pq")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"), F.sum("pq").alias("hq"))
    whole = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    overall = float((whole[1] or 0.0) + model.prior) / float((whole[0] or 0) + 1)
    hosts = hosts.withColumn("hm", F.col("hs") / F.col("hn")).withColumn("h_within", F.col("hq") - F.col("hs") * F.col("hm")).withColumn("g", F.lit(overall))
    k_host = _spread(hosts, "hn", "hm", "g", "h_within")
    sites = paths.join(hosts.select(F.col("host").alias("h"), "hn", "hs", "hm"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    sites = sites.withColumn("pm", F.col("ps") / F.col("pn")).withColumn("p_within", F.col("pq") - F.col("ps") * F.col("pm"))
    k_path = _spread(sites, "pn", "pm", "hm", "p_within")
    right = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "hn", "hs", "pn", "ps")
    if sites.count() <= BROADCAST_SITES:
        right = F.broadcast(right)
    joined = scored.join(right, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    # the document's own evidence is left out of its site's
    host_prior = (F.col("hs") - F.col("p") + F.lit(k_host * overall)) / (F.col("hn") - 1 + F.lit(k_host))
    joined = joined.withColumn("host_prior", _share(host_prior))
    path_prior = (F.col("ps") - F.col("p") + F.lit(k_path) * F.col("host_prior")) / (F.col("pn") - 1 + F.lit(k_path))
    joined = joined.withColumn("path_prior", _share(path_prior))
    shift = _logit(F.col("path_prior")) - F.lit(float(np.log(overall / (1 - overall))) if 0 < overall < 1 else 0.0)
    shift = F.greatest(F.lit(-MOST_PRIOR), F.least(F.lit(MOST_PRIOR), shift))
    quality = 1 / (1 + F.exp(-(F.col("odds") + shift)))
    return joined.select(
        "doc_id", F.col("p").alias("evidence"), "host_prior", "path_prior", quality.alias("quality"), (quality >= 0.5).alias("kept")
    )


def _share(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))
