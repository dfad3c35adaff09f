"""The pipeline's stages in order, each on what its predecessor kept."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from framelake.llm import decontaminate, quality, queries

from test_operators import sentence


def tables(spark, folder):
    rng = random.Random(8)
    good = [sentence(rng, 120) for _ in range(40)]
    passage = sentence(rng, 30)
    data = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    data += [(100, good[4], "en", "s1", 0), (101, " ".join("x" if k == 60 else w for k, w in enumerate(good[5].split())), "en", "s1", 0)]
    data += [(102, sentence(rng, 40) + " " + passage + " " + sentence(rng, 40), "en", "s2", 0), (103, "too short", "en", "s0", 0), (104, None, None, None, 0)]
    data += [(200 + i, " ".join(f"#{w}# $%" for w in sentence(rng, 60).split()), "en", "s0", 0) for i in range(20)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality rules", "near dedup", "decontamination", "mixing", "sharding"]
    one = pipeline.staged(pipeline.quality_rules(spark, docs, folder), "t")
    assert ids(one) == [*range(40), 100, 101, 102] and one.columns == docs.columns
    two = pipeline.staged(pipeline.near_dedup(spark, one, folder), "t")
    assert ids(two) == [*range(40), 102] and two.columns == docs.columns
    three = pipeline.staged(pipeline.decontamination(spark, two, folder), "t")
    assert ids(three) == [*range(40)] and three.columns == docs.columns
    four = pipeline.staged(pipeline.mix_sources(spark, three, folder), "t")
    assert four.columns == docs.columns and set(ids(four)) <= set(range(40))
    last = pipeline.shard(spark, four, folder).collect()
    assert len(last) == four.count()
    sizes = {}
    for r in last:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(sizes.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert pipeline.run(spark, folder).count() == len(last)


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder + "/full")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/full/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert pipeline.run(spark, folder).count() == 0
    for name in ("op1_substring_dedup", "op2_quality_rules", "op4_simhash", "op5_sharding", "op6_language_id", "op7_quality_classifier", "op8_decontamination", "op10_mixing"):
        assert queries.queries()[name](spark, folder).count() == 0, name


def test_names():
    assert [f"op{n}_" in " ".join(queries.queries()) for n in range(1, 11)] == [True] * 10
    assert quality.LEARN_ROWS and decontaminate.WINDOW == 10
