"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pagecrest.llm import bpe, mixing, packing, ppm, quality, resharding, simhash, topk, toxicity, urls
from pagecrest.llm.common import bucket_of_id, table


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.dedup_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.score(docs, bucket_of_id(F.col("doc_id"), 5) == 1)


def op3_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most_passes=2, weights=(5, 2, 1))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *(F.col(f"counts.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), bucket_of_id(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The old layout: six shards by a hash of the text, so a quarter of the bytes must move to two new ones.
    plan = resharding.reshard(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("text", F.lit("old")), F.lit(6)), new_shards=8)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_url_ngram_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op8_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), path, capacity=1024), capacity=1024)


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.with_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return docs.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 mixes towards."""
    found = mixing.targets(mixing.source_sizes(table(spark, sf_dir, "documents")))
    return found.select("source", "source_no", "source_size", F.col("weight").cast("long").alias("weight"), "target")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4's rules rest on, and its base rule."""
    docs = quality.with_counts(table(spark, sf_dir, "documents"), "text", "counts")
    return docs.select("doc_id", *(F.col(f"counts.{c}") for c in quality.COUNTS[:5]), quality.base_failed("counts").alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of URLs and the rules that op7 lets decide before its model."""
    return urls.ruled(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def queries():
    return {f.__name__: f for f in (source_targets, quality_counts, url_rules, op1_simhash_bktree, op2_ppm, op3_source_schedule, op4_decision_list, op5_toxicity_grammar, op6_min_cost_flow, op7_url_ngram_logistic, op8_cover_tree_top_k, op9_best_fit_packing, op10_prefix_token_counts)}


#: Exact search as plain SQL: every query against every row.
TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


#: Words of a text, as the operators take them.
WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Shares rise together until each reaches its cap; the level is the highest that any number of caps asks for.
SOURCE_TARGETS_SQL = f"""
WITH s AS (SELECT source, sum(len({WORDS_SQL}))::BIGINT AS source_size FROM documents GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM s),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS gone FROM n WINDOW w AS (ORDER BY 2.0 * source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((1.5 * (SELECT sum(source_size) FROM s) - capped)::DOUBLE / ((SELECT sum(weight) FROM n) - gone)::DOUBLE) AS level FROM c)
SELECT source, source_no::BIGINT AS source_no, source_size, weight::BIGINT AS weight, least(2.0 * source_size, weight::DOUBLE * level)::DOUBLE AS target FROM n, l
"""

QUALITY_COUNTS_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM d WHERE len(w) > 2),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t) GROUP BY r),
k AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, (len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w)) AS base_failed
FROM d JOIN k USING (r) LEFT JOIN c USING (r)
"""

URL_RULES_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
h AS (SELECT page_id, regexp_extract(x, '^[^/?#]*') AS raw, x FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(x, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(verdict, h, q)),
m AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(verdict, length(h || q)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN m USING (page_id)
"""


def oracle_sql():
    """The other queries rest on trained models, token ids or XXH64, which DuckDB does not have."""
    return {"op8_cover_tree_top_k": TOP_K_SQL, "source_targets": SOURCE_TARGETS_SQL, "quality_counts": QUALITY_COUNTS_SQL, "url_rules": URL_RULES_SQL}
