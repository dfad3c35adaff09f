"""Columns of the input named like those that operators add or use inside."""

from __future__ import annotations

import corpus_pipeline as pipeline
from framelake.llm import decontaminate, mixing, quality, simhash, urls

NAMES = ["_mix_src", "mix_size", "kept", "_matched_url", "_stay", "size", "shard", "slot", "law", "_decon_words", "_decon_spans", "_doc", "_text", "_id", "url_rule", "n_words", "n", "a.b"]


def test_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "s", "http://x.org/a", *NAMES), (2, None, None, None, *NAMES), (1, words, "s", "http://x.org/a", *NAMES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, url string, " + ", ".join(f"`{n}` string" for n in NAMES))
    bench = spark.createDataFrame([("7", words)], "item_id string, text string")
    own = lambda df: [tuple(r) for r in df.select(*[f"`{c}`" for c in docs.columns[4:]]).distinct().collect()]
    for same in (mixing.emit(docs), quality.keep(docs, []), simhash.keep_one(docs, width=5, similarity=0.8), decontaminate.clean(docs, bench.limit(0))):
        assert same.columns == docs.columns and own(same) == [tuple(NAMES)]
    for more, name in ((mixing.mix(docs), "mix_size"), (quality.judge(docs, []), "kept"), (urls.judge(docs), "url_rule"), (decontaminate.annotate(docs, bench), "_decon_words")):
        assert more.columns.count(name) == 1 and more.count() == 3 and more.where(more[name].cast("string") == name).count() == 0
    placed = pipeline.shard(spark, docs, "")
    assert placed.columns.count("shard") == 1 and placed.count() == 3 and {r["a.b"] for r in placed.collect()} == {"a.b"}
