"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from credence.llm import (chat, decontaminate, exact_dedup, hard_negatives, packing, passages, periodic, quality, secret_scan, simhash,
                          suffix_dedup, toxicity, url_rules)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def op1_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op2_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


def op3_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_decontaminate(spark, sf):
    return decontaminate.contaminated_pairs(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_toxicity(spark, sf):
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_passages(spark, sf):
    return passages.shared_passages(table(spark, sf, "documents"))


def op7_chat(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_paths(conv.unionByName(own)))


def op8_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


def op9_exact_dedup(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def op10_url_filter(spark, sf):
    return url_rules.judge(table(spark, sf, "pages"))


def op11_hard_negatives(spark, sf):
    return hard_negatives.mine(table(spark, sf, "embeddings"), noise=7)


def op12_periodic(spark, sf):
    return periodic.digests(periodic.periodic_runs(periodic.with_loops(table(spark, sf, "documents"))))


def op13_secrets(spark, sf):
    return secret_scan.secrets(table(spark, sf, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_passages": op6_passages,
    "op7_chat": op7_chat,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic": op12_periodic,
    "op13_secrets": op13_secrets,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {}

SQL["op9_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

SQL["op7_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '### ', '\### '), '</turn>', '\</turn>') AS body FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(4 + length(role) + 1 + length(body) + 9) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


def _op10_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ranked = sorted(url_rules.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(ends_with('.' || host, {quote('.' + h)}) AND starts_with(path, {quote(p)}))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN {quote(h + p)}" for _, h, p in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN {quote(v)}" for v, h, p in ranked)
    first = " ".join(f"WHEN regexp_matches(url, {quote(rx)}) THEN {quote(rx)}" for rx in sorted(rx for rx, _ in url_rules.PATTERNS))
    low = _LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")
    return f"""
WITH p AS (SELECT page_id, url, {low} AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
j AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS v, CASE {first} END AS hit FROM p)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS pattern
FROM j
"""


SQL["op10_url_filter"] = _op10_sql()

SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
   AND 100 * s.score >= 30 * positive_score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""

if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
