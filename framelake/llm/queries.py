"""The registered queries ``opN_<name>`` and ``pipeline``: operators with their
production parameters over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, language, mixing, quality, sharding, simhash, sites, substring, urls
from .common import shared_dir, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(found: DataFrame) -> DataFrame:
        return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

    return substring.dedup(table(spark, sf_dir, "documents"), project=digest)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    names = {"url_host": "host", "url_path": "path", "url_rule": "rule", "url_verdict": "verdict"}
    return judged.select("page_id", *[F.col(a).alias(b) for a, b in names.items()])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.reshard(docs.select("doc_id", "text"), carry=True)
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.rewrite_affected(placed, path)
    schema = placed.withColumnRenamed("_doc", "doc").schema
    files = spark.read.schema(schema).parquet(path) if len(docs.head(1)) else spark.createDataFrame([], schema)
    body = F.coalesce("doc.text", F.lit(""))  # the digests are those of the files' texts
    size = (F.octet_length(body) + 8).cast("long").alias("size")
    return files.select("doc.doc_id", size, F.crc32(body).alias("text_crc32"), "law", "shard", "slot", "grown_shard", "old_shard", "moved")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return sites.classify(docs, sites.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return marked.select(
        "doc_id",
        F.col("_decon_longest").alias("longest"),
        F.col("_decon_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_decon_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_decon_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), html.train())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s),
o AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS bend,
         sum(source_size) OVER ()::DOUBLE
           - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
         sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w),
l AS (SELECT spare, free FROM o WHERE spare / free <= bend ORDER BY bend LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         least(coalesce((SELECT spare FROM l) * o.weight / (SELECT free FROM l), 3.0::DOUBLE * o.source_size),
               3.0::DOUBLE * o.source_size) AS target
  FROM o),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('20240229|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS n FROM r)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken, CAST(n AS BIGINT) AS copies FROM c
"""


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM k, (SELECT unnest(range(0, 20)) AS j) WHERE n > 1),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
r AS (SELECT p.doc_id, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL), '') AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
q AS (SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path FROM p),
r(v, h, t) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(h || t) DESC) AS k
      FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t))
SELECT page_id, host, path, h || t AS rule,
       CASE WHEN v IS NOT NULL THEN v
            WHEN regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9])(spam[^a-z0-9]farm|cheap[^a-z0-9]pills|casino|porn|xxx|viagra|cialis|betting|poker|warez|phishing|malware|escort|lottery)([^a-z0-9]|$)')
              OR regexp_matches(lower(coalesce(url, '')), '[?&]affiliate=|/wp-login\.php([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM m WHERE k = 1
"""

OP8_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, r, i AS j, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
       FROM (SELECT item_id, r, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ln WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n AS n, item_id, r, j FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
g AS (SELECT doc_id, r, i - j AS diagonal, n, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS island FROM h),
m AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS c FROM g GROUP BY doc_id, r, diagonal, n, island) GROUP BY doc_id),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_url_filters": op3_url_filters,
        "op4_simhash": op4_simhash,
        "op5_sharding": op5_sharding,
        "op6_language_id": op6_language_id,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_decontamination": op8_decontamination,
        "op9_html_extraction": op9_html_extraction,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op3_url_filters": OP3_SQL,
        "op8_decontamination": OP8_SQL,
        "op10_mixing": OP10_SQL,
    }
