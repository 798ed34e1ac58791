"""Oracle SQL per registered key (DuckDB, over the pre-registered views)."""

from __future__ import annotations

from credence.operators import abbreviations as ab
from credence.operators import lexicon as lx
from credence.operators.features import FEATURE_TYPES, GROUPS
from credence.params import CORPUS, DEFAULT
from credence.plans.catalog import ASKED_PAGES, DAILY_LIMIT
from credence.sources.tables import BAIT_TITLE, EMOTIONAL, LINKED
from oracle import sql_parts as sp

PLACES = 6


def col(name: str, typ: str = "int") -> str:
    return f"round({name}, {PLACES}) AS {name}" if typ == "double" else name


def with_ctes(ctes, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def doc_feats_ctes(params=DEFAULT, min_len=0):
    return [f"content AS ({sp.doc_content(min_len)})"] + sp.feature_ctes("content", "doc_id", params)


def feature_group_sql(groups, params=DEFAULT) -> str:
    names = [f for g in groups for f in GROUPS[g]]
    sel = ", ".join(col(f, FEATURE_TYPES[f]) for f in names)
    return with_ctes(doc_feats_ctes(params), f"SELECT doc_id, {sel} FROM feats")


SQL = {
    "linguistic_features": lambda: feature_group_sql(["linguistic"]),
    "sentiment_features": lambda: feature_group_sql(["sentiment"]),
    "readability_features": lambda: feature_group_sql(["readability"]),
    "structural_features": lambda: with_ctes(doc_feats_ctes(), "SELECT doc_id, " + ", ".join(
        col(f, FEATURE_TYPES[f]) for f in GROUPS["structural"]) + ", CAST(floor((" + " + ".join(
        f"(length(text) - length(replace(text, '{ch}', '')))" for ch in ('"', "\u201c", "\u201d"))
        + ") / 2) AS INTEGER) AS quote_pairs FROM feats"),
    "clickbait_features": lambda: feature_group_sql(["clickbait"]),
    "all_features": lambda: feature_group_sql(list(GROUPS)),
}


# ---------------------------------------------------------------------------
# text primitives and intake
# ---------------------------------------------------------------------------
W_ALL = "SELECT doc_id, " + sp.words("coalesce(text, '')") + " AS w FROM documents"
SYL = ("list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), "
       "lambda c: CASE WHEN length(c) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(c, '[aeiouy]+')) "
       "- CASE WHEN suffix(c, 'e') THEN 1 ELSE 0 END) END)")
CONTENT = f"content AS ({sp.doc_content()})"
CONTENT_ALL = f"content AS ({sp.doc_content(0)})"

SQL.update({
    "tokenize": lambda: f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM ({W_ALL})",
    "sentence_stats": lambda: f"""SELECT doc_id, CAST(s AS INTEGER) AS sentence_count,
  round({sp.ratio('n', 's')}, {PLACES}) AS avg_sentence_length,
  CAST(len(list_distinct(st)) AS INTEGER) AS n_sentence_starts
FROM (SELECT doc_id, len(w) AS n,
             CASE WHEN len(w) = 0 THEN 0 ELSE 1 + len(list_filter(w, lambda x, i: i < len(w) AND regexp_matches(x, {sp.SE}))) END AS s,
             list_filter(w, lambda x, i: i = 1 OR regexp_matches(w[i - 1], {sp.SE})) AS st
      FROM ({W_ALL}))""",
    "syllable_count": lambda: f"""SELECT doc_id, CAST(coalesce(list_sum(syl), 0) AS INTEGER) AS total_syllables,
  round({sp.ratio('coalesce(list_sum(syl), 0)', 'len(w)')}, {PLACES}) AS avg_syllables_per_word,
  CAST(list_max(syl) AS INTEGER) AS max_word_syllables
FROM (SELECT doc_id, w, {SYL} AS syl FROM ({W_ALL}))""",
    "keyword_hits": lambda: with_ctes([CONTENT_ALL], f"""SELECT doc_id,
  CAST({sp.hits('lower(text)', DEFAULT.emotional_words)} AS INTEGER) AS emotional_hits,
  CAST({sp.hits('lower(text)', DEFAULT.clickbait_keywords)} AS INTEGER) AS clickbait_hits_text,
  CAST({sp.hits('lower(title)', DEFAULT.clickbait_keywords)} AS INTEGER) AS clickbait_hits_title
FROM content"""),
    "text_intake": lambda: with_ctes([CONTENT], """SELECT doc_id, title, CAST(length(text) AS INTEGER) AS text_length, domain,
  CAST(len(authors) AS INTEGER) AS author_count, publish_date FROM content"""),
    "combined_text": lambda: with_ctes([CONTENT_ALL], """SELECT doc_id, CAST(length(ct) AS INTEGER) AS combined_length, md5(ct) AS combined_md5
FROM (SELECT doc_id, CASE WHEN title <> '' THEN title || '. ' || text ELSE text END AS ct FROM content)"""),
    "truncate_text": lambda: with_ctes([CONTENT_ALL], f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens_kept, md5(array_to_string(w, ' ')) AS kept_md5
FROM (SELECT doc_id, {sp.words("CASE WHEN title <> '' THEN title || '. ' || text ELSE text END")}[1:{DEFAULT.max_tokens}] AS w
      FROM content)"""),
})

# ---------------------------------------------------------------------------
# scoring and explanation
# ---------------------------------------------------------------------------
DOC_SCORED = doc_feats_ctes(min_len=DEFAULT.min_text_length) + [sp.scored_cte("feats", "scored")]
DOC_EXPL = DOC_SCORED + [sp.explained_cte("scored", "explained")]


def page_feats_ctes(params=CORPUS):
    return ([f"pc AS ({sp.page_content(params)})",
             "content AS (SELECT * FROM pc WHERE error IS NULL AND text <> '')"]
            + sp.feature_ctes("content", "page_id", params))


PAGE_SCORED = page_feats_ctes() + [sp.scored_cte("feats", "scored", CORPUS)]
PAGE_EXPL = PAGE_SCORED + [sp.explained_cte("scored", "explained", CORPUS)]

VERDICT = ("prediction, round(confidence, 6) AS confidence, round(fake_probability, 6) AS fake_probability, "
           "round(real_probability, 6) AS real_probability, round(feature_score, 6) AS feature_score, "
           "bert_prediction, model_used")

_POS, _NEG = sp.positive_factor_defs(), sp.negative_factor_defs(DEFAULT)


def factor_sql(ctes, key, pos, neg):
    return with_ctes(ctes, f"""SELECT {key},
  array_to_string({sp.factor_list(pos) if pos else '[]'}, '|') AS positive,
  array_to_string({sp.factor_list(neg) if neg else '[]'}, '|') AS negative,
  array_to_string({sp.factor_list(pos, 'desc') if pos else '[]'}, '|') AS positive_descriptions,
  array_to_string({sp.factor_list(neg, 'desc') if neg else '[]'}, '|') AS negative_descriptions
FROM scored""")


def key_concern_list(names="neg_names", imps="neg_imp"):
    parts = [f"list_transform(list_filter({names}, lambda x, i: {imps}[i] = '{imp}'), lambda x: '⚠ ' || x)"
             for imp in ("critical", "high", "medium", "low")]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"{out}[1:5]"


FLAT_EXPL = f"""prediction, round(confidence, 6) AS confidence, CAST(credibility_score AS INTEGER) AS credibility_score,
  CAST(len(pos_names) AS INTEGER) AS n_positive, CAST(len(neg_names) AS INTEGER) AS n_negative,
  array_to_string(pos_names, '|') AS positive, array_to_string(neg_names, '|') AS negative, summary,
  array_to_string({key_concern_list()}, '|') AS key_concerns, array_to_string(recommendations, '|') AS recommendations"""

RANK_CASE = "CASE imp WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"

SQL.update({
    "rule_score": lambda: with_ctes(doc_feats_ctes(), f"""SELECT doc_id, CAST({sp.rule_points_sql()} AS INTEGER) AS rule_points,
  round(CAST(greatest(0, least(100, {sp.rule_points_sql()})) AS DOUBLE) / 100.0, 6) AS rule_score FROM feats"""),
    "ensemble_verdict": lambda: with_ctes(DOC_SCORED, f"SELECT doc_id, {VERDICT} FROM scored"),
    "source_factors": lambda: factor_sql(PAGE_SCORED, "page_id", _POS[0:3], sp.negative_factor_defs(CORPUS)[0:3]),
    "quality_factors": lambda: factor_sql(DOC_SCORED, "doc_id", _POS[3:5], _NEG[3:7]),
    "sentiment_factors": lambda: factor_sql(DOC_SCORED, "doc_id", _POS[5:6], _NEG[7:10]),
    "clickbait_factors": lambda: factor_sql(DOC_SCORED, "doc_id", [], _NEG[10:12]),
    "explanation": lambda: with_ctes(DOC_EXPL, f"SELECT doc_id, {FLAT_EXPL} FROM explained"),
    "credibility_score": lambda: with_ctes(DOC_EXPL, "SELECT doc_id, CAST(credibility_score AS INTEGER) AS credibility_score FROM explained"),
    "summary_text": lambda: with_ctes(DOC_EXPL, "SELECT doc_id, prediction, CAST(credibility_score AS INTEGER) AS credibility_score, summary FROM explained"),
    "key_concerns": lambda: with_ctes(DOC_EXPL + [
        "negs AS (SELECT doc_id, unnest(neg_names) AS name, unnest(neg_imp) AS imp, "
        "unnest(generate_series(1, len(neg_names))) AS i FROM explained)"],
        f"""SELECT doc_id, CAST(rk AS INTEGER) AS concern_rank, concern FROM (
  SELECT doc_id, '⚠ ' || name AS concern, row_number() OVER (PARTITION BY doc_id ORDER BY {RANK_CASE}, i) AS rk
  FROM negs) WHERE rk <= 5"""),
    "recommendations": lambda: with_ctes(DOC_EXPL, """SELECT doc_id, CAST(position AS INTEGER) AS position, recommendation FROM (
  SELECT doc_id, unnest(recommendations) AS recommendation, unnest(generate_series(1, len(recommendations))) AS position
  FROM explained)"""),
    "factor_preview": lambda: with_ctes(DOC_EXPL, """SELECT doc_id, array_to_string(pos_names[1:5], '|') AS positive_top5,
  array_to_string(neg_names[1:5], '|') AS negative_top5,
  array_to_string(list_transform(pos_names[1:3], lambda x, i: x || ': ' || pos_desc[i]), '|') AS positive_top3,
  substr(text, 1, 200) AS text_preview FROM explained"""),
    "feature_summary": lambda: with_ctes(doc_feats_ctes(), """SELECT doc_id, concat_ws(' | ',
  'Text length: ' || word_count || ' words',
  'Sentiment: ' || CASE WHEN text_polarity > 0 THEN 'Positive' ELSE 'Negative' END,
  'Subjectivity: ' || printf('%.2f', floor(text_subjectivity * 100.0 + 0.5) / 100.0),
  'Readability: ' || printf('%.1f', floor(flesch_reading_ease * 10.0 + 0.5) / 10.0),
  'Clickbait indicators: ' || clickbait_keyword_count,
  'Trusted domain: ' || CASE WHEN is_trusted_domain = 1 THEN 'Yes' ELSE 'No' END) AS feature_summary
FROM feats"""),
})


# ---------------------------------------------------------------------------
# pages and the result table
# ---------------------------------------------------------------------------
PC = f"pc AS ({sp.page_content(CORPUS)})"
CLEAN = "cl AS (SELECT page_id, url, " + sp.clean_html("coalesce(html, '')") + " AS h FROM pages)"
_PP = sp.page_parts("h")


def page_chain(params, prefix, where="TRUE", extra=("url",)):
    """Good pages of one run -> features -> verdict -> explanation, CTE names prefixed."""
    return ([f"{prefix}_pc AS ({sp.page_content(params)})",
             f"{prefix}_c AS (SELECT * FROM {prefix}_pc WHERE error IS NULL AND text <> '' AND ({where}))"]
            + sp.feature_ctes(f"{prefix}_c", "page_id", params, out=f"{prefix}_f", extra=extra)
            + [sp.scored_cte(f"{prefix}_f", f"{prefix}_s", params),
               sp.explained_cte(f"{prefix}_s", f"{prefix}_e", params)])


RUN1 = page_chain(DEFAULT, "r1", "suffix(domain, '.com')")
RUN2 = page_chain(CORPUS, "r2")
CACHE1 = ("cache1 AS (SELECT md5(url) AS cache_key, prediction, confidence, credibility_score, "
          "TIMESTAMP '2024-01-01 00:00:00' AS cached_at FROM r1_e)")
MISSES = ("misses AS (SELECT * FROM r2_e WHERE md5(url) NOT IN (SELECT cache_key FROM cache1))")
AUTHOR = "CASE WHEN array_to_string(authors, ', ') = '' THEN 'Unknown' ELSE array_to_string(authors, ', ') END"


def page_feature_sql(groups) -> str:
    names = [f for g in groups for f in GROUPS[g]]
    sel = ", ".join(col(f, FEATURE_TYPES[f]) for f in names)
    ctes = [PC, "content AS (SELECT * FROM pc WHERE error IS NULL AND text <> '')"] + sp.feature_ctes(
        "content", "page_id", CORPUS)
    return with_ctes(ctes, f"SELECT page_id, {sel} FROM feats")


SQL.update({
    "page_content": lambda: with_ctes([PC], """SELECT page_id, domain, title, CAST(length(text) AS INTEGER) AS text_length,
  md5(text) AS text_md5, CAST(len(authors) AS INTEGER) AS author_count, publish_date, meta_description,
  CAST(len(images) AS INTEGER) AS image_count, extraction_method, error FROM pc"""),
    "url_validation": lambda: f"""SELECT page_id, url, {sp.VALID_URL_SQL} AS is_valid,
  CASE WHEN NOT {sp.VALID_URL_SQL} THEN {sp.q(sp.ERROR_INVALID_URL)} END AS error FROM pages""",
    "url_domain": lambda: f"SELECT page_id, {sp.DOMAIN_SQL} AS domain FROM pages",
    "page_extract": lambda: with_ctes([CLEAN], f"""SELECT page_id, title, CAST(length(text) AS INTEGER) AS text_length,
  md5(text) AS text_md5, meta_description, CAST(len(images) AS INTEGER) AS image_count
FROM (SELECT page_id, {_PP['title']} AS title, {_PP['fallback']} AS text,
             {_PP['meta_description']} AS meta_description, {_PP['images_raw']} AS images FROM cl)"""),
    "extract_fallback": lambda: with_ctes([CLEAN], f"""SELECT page_id,
  CASE WHEN length(p) > 0 THEN 'paragraphs' ELSE 'fallback' END AS extraction_method,
  CAST(length(p) AS INTEGER) AS primary_length, CAST(length(f) AS INTEGER) AS fallback_length,
  CAST(length(CASE WHEN length(p) > 0 THEN p ELSE f END) AS INTEGER) AS text_length
FROM (SELECT page_id, {_PP['primary']} AS p, {_PP['fallback']} AS f FROM cl)"""),
    "size_guard": lambda: f"""SELECT page_id, CAST(strlen(coalesce(html, '')) AS INTEGER) AS html_bytes,
  strlen(coalesce(html, '')) > {DEFAULT.max_content_size} AS too_large,
  CASE WHEN strlen(coalesce(html, '')) > {DEFAULT.max_content_size} THEN {sp.q(sp.ERROR_TOO_LARGE)} END AS error
FROM pages""",
    "quarantine": lambda: with_ctes([PC], f"""SELECT 'pages' AS source, page_id AS id, error FROM pc
  WHERE error IS NOT NULL OR coalesce(text, '') = ''
UNION ALL
SELECT 'documents' AS source, doc_id AS id, 'text shorter than {DEFAULT.min_text_length} characters' AS error
FROM documents WHERE length(coalesce(text, '')) < {DEFAULT.min_text_length}"""),
    "source_features": lambda: page_feature_sql(["source"]),
    "metadata_features": lambda: page_feature_sql(["metadata"]),
    "analysis_response": lambda: with_ctes(RUN2, f"""SELECT page_id, true AS success, prediction, round(confidence, 6) AS confidence,
  CAST(credibility_score AS INTEGER) AS credibility_score, summary,
  CAST(len(pos_names) AS INTEGER) AS n_positive, CAST(len(neg_names) AS INTEGER) AS n_negative,
  array_to_string({key_concern_list()}, '|') AS key_concerns, array_to_string(recommendations, '|') AS recommendations,
  url, domain, title, {AUTHOR} AS author, publish_date, CAST(word_count AS INTEGER) AS word_count, model_used
FROM r2_e"""),
    "cache_key": lambda: "SELECT page_id, url, md5(url) AS cache_key FROM pages",
    "cache_upsert": lambda: with_ctes(RUN1 + RUN2 + [CACHE1], """SELECT cache_key, prediction, round(confidence, 6) AS confidence,
  CAST(credibility_score AS INTEGER) AS credibility_score, cached_at FROM (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC) AS rn FROM (
    SELECT * FROM cache1
    UNION ALL
    SELECT md5(url), prediction, confidence, credibility_score, TIMESTAMP '2024-01-02 00:00:00' FROM r2_e))
WHERE rn = 1"""),
    "cache_lookup": lambda: with_ctes(RUN1 + [CACHE1], """SELECT p.page_id, c.cache_key, c.prediction, round(c.confidence, 6) AS confidence,
  CAST(c.credibility_score AS INTEGER) AS credibility_score, c.cached_at
FROM pages p JOIN cache1 c ON md5(p.url) = c.cache_key"""),
    "cache_misses": lambda: with_ctes(RUN1 + RUN2 + [CACHE1, MISSES], """SELECT page_id, md5(url) AS cache_key, prediction,
  round(confidence, 6) AS confidence, CAST(credibility_score AS INTEGER) AS credibility_score FROM misses"""),
    "cache_stats": lambda: with_ctes(RUN1 + RUN2 + [CACHE1, MISSES], """SELECT count(*) AS cache_size, min(cached_at) AS oldest_entry,
  max(cached_at) AS newest_entry FROM (
  SELECT cached_at FROM cache1 UNION ALL SELECT TIMESTAMP '2024-01-02 00:00:00' FROM misses)"""),
})


# ---------------------------------------------------------------------------
# evaluation, base model, streaming, keywords, pairwise gap
# ---------------------------------------------------------------------------
LABELLED = f"""lab AS (
  SELECT d.doc_id, d.t AS text, split_part(d.t, chr(10), 1) AS title, coalesce(d.source, '') AS domain,
         CAST([] AS VARCHAR[]) AS authors, CAST(NULL AS VARCHAR) AS publish_date,
         CAST([] AS VARCHAR[]) AS images, '' AS meta_description, CAST([] AS VARCHAR[]) AS keywords, '' AS summary,
         CASE WHEN l.quality = 1 THEN 'REAL' ELSE 'FAKE' END AS label
  FROM (SELECT doc_id, {sp.strip("coalesce(text, '')")} AS t, source FROM documents) d JOIN labels l USING (doc_id))"""
EVAL = ([LABELLED] + sp.feature_ctes("lab", "doc_id", DEFAULT, extra=("label",))
        + [sp.scored_cte("feats", "scored"), sp.explained_cte("scored", "explained"),
           """details AS (
  SELECT doc_id, title, label AS true_label, prediction AS predicted_label, confidence,
         CAST(credibility_score AS INTEGER) AS credibility_score, 47 AS feature_count,
         CAST(len(pos_names) AS INTEGER) AS positive_factors, CAST(len(neg_names) AS INTEGER) AS negative_factors,
         prediction = label AS is_correct,
         (label <> 'UNCERTAIN' AND prediction <> 'UNCERTAIN' AND label = 'FAKE' AND prediction = 'FAKE') AS true_positive,
         (label <> 'UNCERTAIN' AND prediction <> 'UNCERTAIN' AND label = 'REAL' AND prediction = 'FAKE') AS false_positive,
         (label <> 'UNCERTAIN' AND prediction <> 'UNCERTAIN' AND label = 'REAL' AND prediction = 'REAL') AS true_negative,
         (label <> 'UNCERTAIN' AND prediction <> 'UNCERTAIN' AND label = 'FAKE' AND prediction = 'REAL') AS false_negative
  FROM explained WHERE prediction <> 'ERROR')""",
           """m AS (
  SELECT count(*) AS valid_samples, count(*) FILTER (WHERE is_correct) AS correct,
         count(*) FILTER (WHERE true_label <> 'UNCERTAIN' AND predicted_label <> 'UNCERTAIN') AS binary_samples,
         count(*) FILTER (WHERE true_positive) AS true_positives, count(*) FILTER (WHERE false_positive) AS false_positives,
         count(*) FILTER (WHERE true_negative) AS true_negatives, count(*) FILTER (WHERE false_negative) AS false_negatives,
         coalesce(avg(confidence), 0.0) AS avg_confidence
  FROM details)"""])

LOGITS = ("sm AS (SELECT vec_id, exp(f - greatest(r, f)) / (exp(r - greatest(r, f)) + exp(f - greatest(r, f))) AS p "
          "FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS r, CAST(embedding[2] AS DOUBLE) AS f FROM embeddings))")
TERMS = ("list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{L}]', '', 'g')), "
         f"lambda x: x <> '' AND x NOT IN {sp.in_list(DEFAULT.stopword_list())})")
CONV = f"""conv AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS ck, conv_id, turn, coalesce(text, '') AS text,
         split_part(coalesce(text, ''), chr(10), 1) AS title, 'direct-text' AS domain,
         CAST([] AS VARCHAR[]) AS authors, CAST(NULL AS VARCHAR) AS publish_date, CAST([] AS VARCHAR[]) AS images,
         '' AS meta_description, CAST([] AS VARCHAR[]) AS keywords, '' AS summary
  FROM conversations)"""

SQL.update({
    "labelled_corpus": lambda: with_ctes([LABELLED], """SELECT doc_id, label, title, CAST(length(text) AS INTEGER) AS text_length,
  domain FROM lab"""),
    "eval_details": lambda: with_ctes(EVAL, """SELECT doc_id, title, true_label, predicted_label, round(confidence, 6) AS confidence,
  credibility_score, feature_count, positive_factors, negative_factors, is_correct, true_positive, false_positive,
  true_negative, false_negative FROM details"""),
    "confusion_matrix": lambda: with_ctes(EVAL, """SELECT true_positives, false_positives, true_negatives, false_negatives,
  binary_samples FROM m"""),
    "classification_metrics": lambda: with_ctes(EVAL, f"""SELECT valid_samples AS total_samples, valid_samples, binary_samples,
  round({sp.ratio('correct', 'valid_samples')}, 6) AS overall_accuracy,
  round({sp.ratio('true_positives + true_negatives', 'binary_samples')}, 6) AS binary_accuracy,
  round(pr, 6) AS precision, round(rc, 6) AS recall,
  round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1_score,
  true_positives, false_positives, true_negatives, false_negatives, round(avg_confidence, 6) AS avg_confidence,
  {DEFAULT.confidence_threshold} :: DOUBLE AS confidence_threshold
FROM (SELECT *, {sp.ratio('true_positives', 'true_positives + false_positives')} AS pr,
             {sp.ratio('true_positives', 'true_positives + false_negatives')} AS rc FROM m)"""),
    "prediction_distribution": lambda: with_ctes(EVAL, """SELECT l.label, count(d.predicted_label) AS n,
  round(CASE WHEN (SELECT count(*) FROM details) > 0
             THEN count(d.predicted_label) * 100.0 / (SELECT count(*) FROM details) ELSE 0.0 END, 6) AS percentage
FROM (VALUES ('REAL'), ('FAKE'), ('UNCERTAIN')) l(label) LEFT JOIN details d ON d.predicted_label = l.label
GROUP BY l.label"""),
    "tolerant_accuracy": lambda: with_ctes(EVAL, """SELECT true_label, count(*) AS n,
  count(*) FILTER (WHERE predicted_label <> CASE true_label WHEN 'REAL' THEN 'FAKE' WHEN 'FAKE' THEN 'REAL' ELSE '' END)
    AS tolerant_correct,
  round(count(*) FILTER (WHERE predicted_label <> CASE true_label WHEN 'REAL' THEN 'FAKE' WHEN 'FAKE' THEN 'REAL' ELSE '' END)
    / count(*), 6) AS tolerant_accuracy,
  count(*) FILTER (WHERE true_label = 'REAL' AND predicted_label = 'FAKE') AS false_positives,
  count(*) FILTER (WHERE true_label = 'FAKE' AND predicted_label = 'REAL') AS false_negatives
FROM details GROUP BY true_label"""),
    "eval_report": lambda: with_ctes(EVAL, """SELECT row_number() OVER (ORDER BY doc_id) AS sample_id, doc_id,
  CASE WHEN is_correct THEN '✓' ELSE '✗' END AS status, substr(coalesce(title, ''), 1, 50) AS title_50,
  true_label, predicted_label, round(confidence * 100.0, 6) AS confidence_pct, credibility_score,
  '+' || CAST(positive_factors AS VARCHAR) || ' / -' || CAST(negative_factors AS VARCHAR) AS factors
FROM details"""),
    "latency_stats": lambda: """SELECT count(value) AS n, round(coalesce(avg(value), 0.0), 6) AS avg_time,
  round(coalesce(median(value), 0.0), 6) AS median_time, round(coalesce(min(value), 0.0), 6) AS min_time,
  round(coalesce(max(value), 0.0), 6) AS max_time,
  round(CASE WHEN avg(value) > 0 THEN 1.0 / avg(value) ELSE 0.0 END, 6) AS throughput
FROM events WHERE event_type <> 'error'""",
    "softmax_argmax": lambda: with_ctes([LOGITS], """SELECT vec_id, round(1 - p, 6) AS real_probability, round(p, 6) AS fake_probability,
  CASE WHEN round(p, 12) > 0.5 THEN 1 ELSE 0 END AS predicted_class,
  CASE WHEN round(p, 12) > 0.5 THEN 'FAKE' ELSE 'REAL' END AS label, round(greatest(p, 1 - p), 6) AS confidence
FROM sm"""),
    "base_verdict": lambda: with_ctes([LOGITS], f"""SELECT vec_id,
  CASE WHEN greatest(round(p, 12), 1 - round(p, 12)) < {DEFAULT.confidence_threshold} THEN 'UNCERTAIN'
       WHEN round(p, 12) > 0.5 THEN 'FAKE' ELSE 'REAL' END AS prediction,
  round(greatest(p, 1 - p), 6) AS confidence, round(p, 12) > 0.5 AS is_fake, round(p, 12) <= 0.5 AS is_real
FROM sm"""),
    "batch_classify": lambda: with_ctes([LOGITS], """SELECT vec_id, CASE WHEN round(p, 12) > 0.5 THEN 'FAKE' ELSE 'REAL' END AS prediction,
  round(greatest(p, 1 - p), 6) AS confidence, round(p, 6) AS fake_probability, round(1 - p, 6) AS real_probability
FROM sm"""),
    "stream_score": lambda: with_ctes(RUN2, """SELECT page_id, prediction, round(confidence, 6) AS confidence,
  CAST(credibility_score AS INTEGER) AS credibility_score FROM r2_e"""),
    "cache_ttl": lambda: f"""SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS rn
  FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {DEFAULT.cache_ttl_seconds} SECOND)
WHERE rn = 1""",
    "rate_check": lambda: f"""SELECT user_id, date_trunc('minute', ts) AS window_start,
  date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end, count(*) AS n
FROM events GROUP BY user_id, date_trunc('minute', ts) HAVING count(*) > {DEFAULT.rate_limit}""",
    "top_keywords": lambda: f"""SELECT doc_id, CAST(rk AS INTEGER) AS rank, term, CAST(cnt AS INTEGER) AS count FROM (
  SELECT doc_id, term, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, term) AS rk FROM (
    SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({TERMS}) AS term FROM ({W_ALL}))
    GROUP BY doc_id, term))
WHERE rk <= 10""",
    "credibility_gap": lambda: with_ctes([CONV] + sp.feature_ctes("conv", "ck", DEFAULT, extra=("conv_id", "turn"))
                                 + [sp.scored_cte("feats", "scored"), sp.explained_cte("scored", "explained")],
                                 """SELECT a.conv_id, a.turn, b.turn AS next_turn,
  CAST(a.credibility_score AS INTEGER) AS credibility_a, CAST(b.credibility_score AS INTEGER) AS credibility_b,
  CAST(abs(a.credibility_score - b.credibility_score) AS INTEGER) AS gap
FROM explained a JOIN explained b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""),
})


# ---------------------------------------------------------------------------
# all branches: documents with derived columns
# ---------------------------------------------------------------------------
_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
ENRICHED = f"""enr AS (
  SELECT d.doc_id,
         CASE WHEN d.doc_id % 8 = 0 THEN coalesce(text, '') || {sp.q(LINKED)}
              WHEN d.doc_id % 8 = 1 THEN {sp.q(EMOTIONAL)} || coalesce(text, '') ELSE coalesce(text, '') END AS text,
         CASE d.doc_id % 7 WHEN 0 THEN {sp.q(BAIT_TITLE)} WHEN 1 THEN {_TITLE} || '!!!' ELSE {_TITLE} END AS title,
         CASE d.doc_id % 6 WHEN 0 THEN 'www.reuters.com' WHEN 1 THEN 'infowars.com' WHEN 2 THEN 'news.bbc.co.uk'
              WHEN 3 THEN coalesce(source, '') || '.example.net' WHEN 4 THEN 'blog.example.co' ELSE '' END AS domain,
         CASE d.doc_id % 5 WHEN 0 THEN ['A. Writer'] WHEN 1 THEN ['A. Writer', 'B. Writer', 'C. Writer']
              ELSE CAST([] AS VARCHAR[]) END AS authors,
         CASE WHEN d.doc_id % 4 < 2 THEN '2024-01-15' END AS publish_date,
         list_transform(generate_series(1, d.doc_id % 4), lambda x: 'img.png') AS images,
         CASE WHEN d.doc_id % 9 = 0 THEN 'About ' || {_TITLE} ELSE '' END AS meta_description,
         CASE WHEN d.doc_id % 9 < 3 THEN ['one', 'two'] ELSE CAST([] AS VARCHAR[]) END AS keywords,
         CASE WHEN d.doc_id % 10 = 0 THEN 'A summary.' ELSE '' END AS summary,
         CASE WHEN d.doc_id % 13 <> 0 THEN CAST(d.doc_id * 37 % 101 AS DOUBLE) / 100.0 END AS p_in,
         CASE quality WHEN 1 THEN 'REAL' WHEN 0 THEN 'FAKE' ELSE 'UNCERTAIN' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ENR_FEATS = [ENRICHED] + sp.feature_ctes("enr", "doc_id", DEFAULT, extra=("p_in", "label"))
ENR_SCORED = ENR_FEATS + [sp.scored_cte("feats", "scored", base="p_in")]
ENR_EXPL = ENR_SCORED + [sp.explained_cte("scored", "explained")]
# the labelled evaluation's CTEs, over the enriched rows
ENR_EVAL = ENR_EXPL + EVAL[-2:]
_ENR_M = """m1 AS (SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 0.0 ELSE true_positives * 1.0 / (true_positives + false_positives) END AS pr,
  CASE WHEN true_positives + false_negatives = 0 THEN 0.0 ELSE true_positives * 1.0 / (true_positives + false_negatives) END AS rc FROM m)"""


def evaluation_record_sql() -> str:
    share = ", ".join(
        f"(SELECT count(*) FROM details WHERE predicted_label = '{lab}') AS n_{lab.lower()}, "
        f"(SELECT round(count(*) FILTER (WHERE predicted_label = '{lab}') * 100.0 / count(*), 6) FROM details) AS share_{lab.lower()}"
        for lab in ("REAL", "FAKE", "UNCERTAIN"))
    return with_ctes(ENR_EVAL + [_ENR_M], f"""SELECT valid_samples AS total_samples, valid_samples, binary_samples,
  round({sp.ratio('correct', 'valid_samples')}, 6) AS overall_accuracy,
  round({sp.ratio('true_positives + true_negatives', 'binary_samples')}, 6) AS binary_accuracy,
  round(CAST(pr AS DOUBLE), 6) AS precision, round(CAST(rc AS DOUBLE), 6) AS recall,
  round(CASE WHEN pr + rc > 0 THEN 2.0 * pr * rc / (pr + rc) ELSE 0.0 END :: DOUBLE, 6) AS f1_score,
  true_positives, false_positives, true_negatives, false_negatives, round(avg_confidence, 6) AS avg_confidence,
  {DEFAULT.confidence_threshold} :: DOUBLE AS confidence_threshold,
  t.n AS timed_samples, avg_time, median_time, min_time, max_time, throughput, {share}
FROM m1, ({SQL["latency_stats"]()}) t""")


SQL.update({
    "enriched_features": lambda: with_ctes(ENR_FEATS, "SELECT doc_id, " + ", ".join(
        col(f, FEATURE_TYPES[f]) for g in GROUPS for f in GROUPS[g]) + " FROM feats"),
    "enriched_verdict": lambda: with_ctes(ENR_SCORED, f"SELECT doc_id, {VERDICT} FROM scored"),
    "enriched_explanation": lambda: with_ctes(ENR_EXPL, f"SELECT doc_id, {FLAT_EXPL} FROM explained"),
    "enriched_details": lambda: with_ctes(
        [c.replace(" FROM explained WHERE prediction <> 'ERROR'", " FROM explained") for c in ENR_EVAL[:-1]],
        """SELECT doc_id, true_label, predicted_label, is_correct, true_positive, false_positive, true_negative, false_negative,
  CASE WHEN predicted_label = 'ERROR' THEN 'prediction failed' END AS error FROM details"""),
    "evaluation_record": evaluation_record_sql,
    "quarantine": lambda: with_ctes([PC] + ENR_SCORED, f"""SELECT 'pages' AS source, page_id AS id, error FROM pc
  WHERE error IS NOT NULL OR coalesce(text, '') = ''
UNION ALL
SELECT 'documents' AS source, doc_id AS id, 'text shorter than {DEFAULT.min_text_length} characters' AS error
FROM documents WHERE length(coalesce(text, '')) < {DEFAULT.min_text_length}
UNION ALL SELECT 'scored', doc_id, 'prediction failed' FROM scored WHERE prediction = 'ERROR'"""),
    "cache_ttl": lambda: f"""WITH r AS (SELECT md5(url) AS cache_key, page_id, ts AS cached_at FROM pages JOIN events ON page_id = event_id),
l AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY cached_at DESC, page_id DESC) AS rn FROM r)
SELECT cache_key, page_id, cached_at FROM l
WHERE rn = 1 AND cached_at >= (SELECT max(cached_at) FROM r) - INTERVAL {DEFAULT.cache_ttl_seconds} SECOND""",
    "rate_check": lambda: f"""SELECT user_id, date_trunc('day', ts) AS window_start,
  date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n
FROM events GROUP BY user_id, date_trunc('day', ts) HAVING count(*) > {DAILY_LIMIT}""",
    "cache_stats": lambda: with_ctes(RUN1 + RUN2 + [CACHE1, MISSES], """SELECT count(*) AS cache_size, min(cached_at) AS oldest_entry,
  max(cached_at) AS newest_entry FROM (SELECT cache_key, max(cached_at) AS cached_at FROM (
  SELECT cache_key, cached_at FROM cache1 UNION ALL SELECT md5(url), TIMESTAMP '2024-01-02 00:00:00' FROM misses) GROUP BY cache_key)"""),
})

_TOP = f"""top AS (SELECT doc_id, term, cnt FROM (
  SELECT doc_id, term, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, term) AS rk FROM (
    SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({TERMS}) AS term FROM ({W_ALL})) GROUP BY doc_id, term))
  WHERE rk <= 10)"""
_SPLIT = sp.q(r"""([.!?]["')\]]*)""" + sp.WS_CLASS + "+")
SQL["extractive_summary"] = lambda: with_ctes([
    _TOP,
    f"""sent AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), {_SPLIT}, '\\1' || chr(1), 'g'), chr(1)),
  lambda x: {sp.strip('x')}), lambda x: x <> '') AS l FROM documents)""",
    "s AS (SELECT doc_id, unnest(l) AS sentence, unnest(generate_series(1, len(l))) AS pos FROM sent)",
    f"t AS (SELECT doc_id, pos, unnest({sp.terms(sp.words('sentence'))}) AS term FROM s)",
    "sc AS (SELECT t.doc_id, t.pos, sum(cnt) AS score FROM t JOIN top USING (doc_id, term) GROUP BY t.doc_id, t.pos)",
    """r AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(score, 0) DESC, s.pos) AS rk
  FROM s LEFT JOIN sc ON s.doc_id = sc.doc_id AND s.pos = sc.pos)""",
    "b AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r WHERE rk <= 5 GROUP BY doc_id)"],
    """SELECT sent.doc_id, CAST(len(l) AS INTEGER) AS n_sentences, CAST(length(coalesce(summary, '')) AS INTEGER) AS summary_length,
  coalesce(summary, '') AS summary FROM sent LEFT JOIN b USING (doc_id)""")


def _page_record_sql() -> str:
    """The whole content record.  The media fields are read by regular
    expressions that agree on the test pages only (see README)."""
    h = "coalesce(html, '')"
    top = " ".join(f"WHEN {sp.meta_tag(h, a, n)} <> '' THEN {sp.meta_content(sp.meta_tag(h, a, n))}"
                   for a, n in (("property", "og:image"), ("name", "twitter:image")))
    sentences = (f"list_filter(list_transform(string_split(regexp_replace(text, {_SPLIT}, '\\1' || chr(1), 'g'), chr(1)), "
                 f"lambda x: {sp.strip('x')}), lambda x: x <> '')")
    return with_ctes([
        PC,
        "art AS (SELECT page_id, text FROM pc WHERE extraction_method = 'paragraphs')",
        f"""tops AS (SELECT page_id, term, cnt, rk FROM (
  SELECT page_id, term, cnt, row_number() OVER (PARTITION BY page_id ORDER BY cnt DESC, term) AS rk FROM (
    SELECT page_id, term, count(*) AS cnt FROM (SELECT page_id, unnest({sp.terms(sp.words('text'))}) AS term FROM art) GROUP BY page_id, term))
  WHERE rk <= 10)""",
        "kw AS (SELECT page_id, string_agg(term, '|' ORDER BY rk) AS keywords FROM tops GROUP BY page_id)",
        f"sl AS (SELECT page_id, {sentences} AS l FROM art)",
        "sn AS (SELECT page_id, unnest(l) AS sentence, unnest(generate_series(1, len(l))) AS pos FROM sl)",
        f"st AS (SELECT page_id, pos, unnest({sp.terms(sp.words('sentence'))}) AS term FROM sn)",
        "ss AS (SELECT st.page_id, st.pos, sum(cnt) AS score FROM st JOIN tops USING (page_id, term) GROUP BY st.page_id, st.pos)",
        """sr AS (SELECT sn.*, row_number() OVER (PARTITION BY sn.page_id ORDER BY coalesce(score, 0) DESC, sn.pos) AS rk
  FROM sn LEFT JOIN ss ON sn.page_id = ss.page_id AND sn.pos = ss.pos)""",
        "sm AS (SELECT page_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM sr WHERE rk <= 5 GROUP BY page_id)"],
        f"""SELECT pc.page_id, pc.url, domain, title, CAST(length(text) AS INTEGER) AS text_length,
  md5(text) AS text_md5, CAST(len(authors) AS INTEGER) AS author_count, publish_date, meta_description,
  CASE WHEN NOT coalesce(extraction_method = 'paragraphs', false) THEN '' {top} WHEN len(images) > 0 THEN images[1] ELSE '' END AS top_image,
  CAST(len(images) AS INTEGER) AS image_count,
  CAST(CASE WHEN extraction_method = 'paragraphs' THEN len(regexp_extract_all({h}, '(?i)<(video|iframe|embed)[^>]*src=')) ELSE 0 END AS INTEGER) AS video_count,
  CASE WHEN extraction_method = 'paragraphs' THEN {sp.meta_content(sp.meta_tag(h, 'name', 'keywords'))} ELSE '' END AS meta_keywords,
  coalesce(kw.keywords, '') AS keywords, md5(coalesce(sm.summary, '')) AS summary_md5,
  CASE WHEN extraction_method = 'paragraphs' THEN regexp_extract(pc.url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') ELSE '' END AS source_url,
  extraction_method, error
FROM pc JOIN pages p ON p.page_id = pc.page_id LEFT JOIN kw ON kw.page_id = pc.page_id LEFT JOIN sm ON sm.page_id = pc.page_id""")


SQL["page_content"] = _page_record_sql


# ---------------------------------------------------------------------------
# requests, learned tables, lists as tables
# ---------------------------------------------------------------------------
def _seconds(key: str) -> str:
    return (f"s AS (SELECT CAST({key} AS VARCHAR) AS key, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS second, count(*) AS requests "
            "FROM events GROUP BY 1, 2)")


def _lines(text: str) -> str:
    return f"SELECT doc_id, {sp.words(text)} AS w FROM documents"


_BARE = (f"lower(regexp_replace(regexp_replace(t, {sp.q(ab.OPENING)}, ''), {sp.q(ab.CLOSING)}, ''))")
ABBREVIATIONS = [
    f"bare AS (SELECT {_BARE} AS b FROM (SELECT unnest(w) AS t FROM ({_lines("coalesce(text, '')")})))",
    f"""pc AS (SELECT CASE WHEN suffix(b, '.') THEN left(b, length(b) - 1) ELSE b END AS word,
    count(*) FILTER (WHERE suffix(b, '.')) AS ab, count(*) FILTER (WHERE NOT suffix(b, '.')) AS np FROM bare GROUP BY 1)""",
    f"pw AS (SELECT * FROM pc WHERE regexp_matches(word, {sp.q(ab.WORD)}))",
    "tot AS (SELECT sum(ab) * 1.0 / sum(ab + np) AS p1 FROM pw)",
    """sc AS (SELECT word, ab AS with_period, np AS without_period, length(replace(word, '.', '')) * 1.0 AS letters,
    length(word) - length(replace(word, '.', '')) AS inner_periods,
    ab * ln(p1) + CASE WHEN np = 0 THEN 0 ELSE np * ln(greatest(1 - p1, 1e-300)) END AS h0,
    ab * ln(0.99) + np * ln(1 - 0.99) AS h1 FROM pw, tot WHERE ab > 0)""",
    """abbr AS (SELECT word, with_period, without_period, score FROM (
    SELECT *, -2 * (h0 - h1) * exp(-letters) * (inner_periods + 1) * pow(letters, -without_period) AS score FROM sc) WHERE score >= 0.3)"""]
_GOOD, _BAD = lx.seeds()
_SKIP = [*_GOOD, *_BAD, *DEFAULT.negations, *DEFAULT.stopword_list()]
_NEAR = f"""tk AS (SELECT doc_id, {sp.stoks("coalesce(text, '')")} AS tk FROM enr),
se AS (SELECT tk, unnest(generate_series(1, len(tk))) AS i FROM tk),
sd AS (SELECT tk, i, tk[i] AS seed FROM se WHERE tk[i] IN {sp.in_list([*_GOOD, *_BAD])}),
nr AS (SELECT seed IN {sp.in_list(_GOOD)} AS g, unnest(list_concat(tk[greatest(i - {lx.SPAN}, 1):i - 1], tk[i + 1:i + {lx.SPAN}])) AS word FROM sd),
mt AS (SELECT word, count(*) FILTER (WHERE g) AS good, count(*) FILTER (WHERE NOT g) AS bad FROM nr GROUP BY word),
lt AS (SELECT sum(good) AS ag, sum(bad) AS ab FROM mt),
lex AS (SELECT word, good, bad, greatest(-1.0, least(1.0, log2(((good + 0.5) * (ab + 0.5)) / ((bad + 0.5) * (ag + 0.5))) / {lx.FULL_BITS})) AS polarity
        FROM mt, lt WHERE good + bad >= {lx.LEAST_MEETINGS} AND word NOT IN {sp.in_list(_SKIP)})"""
_HOST = "regexp_replace(regexp_replace(lower({}), '^.*@', ''), '\\.?(:[0-9]*)?$', '')"

SQL.update({
    "cache_serve": lambda: with_ctes(RUN1 + RUN2 + [CACHE1], """SELECT page_id, true AS from_cache, prediction, round(confidence, 6) AS confidence,
  CAST(credibility_score AS INTEGER) AS credibility_score
FROM (SELECT p.page_id, c.* FROM pages p JOIN cache1 c ON md5(p.url) = c.cache_key WHERE p.page_id % 4 <> 0)
UNION ALL
SELECT page_id, false, prediction, round(confidence, 6), CAST(credibility_score AS INTEGER) FROM r2_e
WHERE page_id % 4 = 0 OR md5(url) NOT IN (SELECT cache_key FROM cache1)"""),
    "cache_expiry": lambda: f"""WITH RECURSIVE {_seconds(f"'page ' || (user_id % {ASKED_PAGES})")},
c AS (SELECT key, min(second) AS at FROM s GROUP BY key
      UNION ALL
      SELECT s.key, min(s.second) FROM c JOIN s ON s.key = c.key AND s.second >= c.at + {DEFAULT.cache_ttl_seconds} GROUP BY s.key)
SELECT s.key, s.second, s.requests, max(c.at) AS stored_at, max(c.at) = s.second AS scored
FROM s JOIN c ON c.key = s.key AND c.at <= s.second GROUP BY s.key, s.second, s.requests""",
    "rolling_rate": lambda: f"""WITH {_seconds("user_id")}
SELECT key, second, n FROM (
  SELECT key, second, CAST(sum(requests) OVER (PARTITION BY key ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM s)
WHERE n > {DAILY_LIMIT}""",
    "learned_abbreviations": lambda: with_ctes(ABBREVIATIONS, "SELECT word, with_period, without_period, round(score, 6) AS score FROM abbr"),
    "learned_sentence_stats": lambda: with_ctes(ABBREVIATIONS + [
        f"l AS ({_lines("coalesce(text, '')")})",
        f"""e AS (SELECT doc_id, i, regexp_matches(t, {sp.SE}) AS closes, regexp_matches(t, {sp.q(ab.FINAL_PERIOD)}) AS period, {_BARE} AS b
  FROM (SELECT doc_id, unnest(w[1:len(w) - 1]) AS t, unnest(generate_series(1, len(w) - 1)) AS i FROM l WHERE len(w) > 1))""",
        """k AS (SELECT doc_id, count(*) FILTER (WHERE closes AND NOT (period AND suffix(b, '.') AND left(b, length(b) - 1) IN (SELECT word FROM abbr))) AS n
  FROM e GROUP BY doc_id)"""],
        """SELECT l.doc_id, CAST(len(w) AS INTEGER) AS n_tokens,
  CAST(CASE WHEN len(w) = 0 THEN 0 ELSE 1 + coalesce(k.n, 0) END AS INTEGER) AS sentence_count FROM l LEFT JOIN k ON k.doc_id = l.doc_id"""),
    "learned_lexicon": lambda: with_ctes([ENRICHED, _NEAR], """SELECT word, good, bad, round(polarity, 6) AS polarity,
  round(abs(polarity), 6) AS subjectivity FROM lex"""),
    "learned_sentiment": lambda: with_ctes([ENRICHED, _NEAR, f"""ht AS (
  SELECT doc_id, polarity * CASE WHEN coalesce(tk[i - 1] IN {sp.in_list(DEFAULT.negations)} AND i > 1, false)
      OR coalesce(tk[i - 2] IN {sp.in_list(DEFAULT.negations)} AND i > 2, false) THEN -0.5 ELSE 1.0 END AS p, abs(polarity) AS s
  FROM (SELECT doc_id, tk, unnest(generate_series(1, len(tk))) AS i FROM tk) w JOIN lex ON lex.word = w.tk[w.i] WHERE polarity <> 0)"""],
        """SELECT enr.doc_id, round(greatest(-1.0, least(1.0, coalesce(avg(p), 0.0))), 6) AS polarity,
  round(greatest(0.0, least(1.0, coalesce(avg(s), 0.0))), 6) AS subjectivity
FROM enr LEFT JOIN ht ON ht.doc_id = enr.doc_id GROUP BY enr.doc_id"""),
    "source_table": lambda: f"""WITH p AS (SELECT page_id, {sp.DOMAIN_SQL} AS domain FROM pages),
h AS (SELECT page_id, domain, {_HOST.format("domain")} AS host FROM p),
raw AS (SELECT 'n' || l_orderkey || '-' || l_linenumber || '.example.org' AS name, CASE WHEN l_orderkey % 2 = 0 THEN 'trusted' ELSE 'unreliable' END AS kind FROM lineitem
  UNION ALL SELECT array_to_string(string_split(host, '.')[-3:], '.'), 'trusted' FROM h WHERE page_id % 5 = 0 AND len(string_split(host, '.')) >= 3
  UNION ALL VALUES ('example.org', 'trusted'), ('example.net', 'unreliable'), ('example.com', 'known')),
names AS (SELECT {_HOST.format("name")} AS name, min(kind) AS kind FROM raw GROUP BY 1),
b AS (SELECT h.page_id, arg_max(name, length(name)) AS name, arg_max(kind, length(name)) AS kind FROM h JOIN names
      ON h.host = name OR suffix(h.host, '.' || name) GROUP BY h.page_id)
SELECT h.page_id, h.domain, b.name AS domain_name, b.kind AS domain_kind, CASE WHEN b.kind = 'trusted' THEN 1 ELSE 0 END AS is_trusted_domain,
  CASE WHEN b.kind = 'unreliable' THEN 1 ELSE 0 END AS is_unreliable_domain FROM h LEFT JOIN b ON b.page_id = h.page_id""",
})

SQL["response_sink"] = lambda: f"SELECT *, TIMESTAMP '2024-01-02 00:00:00' AS analysis_timestamp FROM ({SQL['analysis_response']()})"
SQL["evaluation_sink"] = lambda: with_ctes(
    [f"cm AS ({SQL['classification_metrics']()})"] + EVAL,
    """SELECT cm.*, TIMESTAMP '2024-01-02 00:00:00' AS run_ts, (SELECT count(*) FROM details) AS detailed_results,
  (SELECT count(*) FROM details WHERE is_correct) AS detailed_correct FROM cm""")
