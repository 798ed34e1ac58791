"""Scoring and classification, as column expressions.

The rule score is summed in integer hundredths, so it is exact and the order
of the terms does not matter; it is clamped once and divided by 100.  The
blend and the verdict are plain ``when`` chains, so scoring stays inside the
same narrow stage as the features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.params import (DEFAULT, MODEL_ENSEMBLE, MODEL_OVERRIDE_FULL, MODEL_OVERRIDE_PARTIAL,
                             Params)

# Blended values are rounded to this many places before they are compared
# with the 0.5 / confidence thresholds (removes float noise of the blend).
COMPARE_PLACES = 12


def _c(name: str) -> Column:
    return F.col(name)


def _pts(cond: Column, pts: int) -> Column:
    return F.when(cond, F.lit(pts)).otherwise(F.lit(0))


def rule_points() -> Column:
    """P1-P16 as an integer number of hundredths, before clamping."""
    q, kw, pat = _c("quote_count"), _c("clickbait_keyword_count"), _c("clickbait_pattern_count")
    emo, subj, cap = _c("emotional_word_ratio"), _c("text_subjectivity"), _c("capital_ratio")
    fl, wc = F.coalesce(_c("flesch_reading_ease"), F.lit(50.0)), _c("word_count")
    author, date = _c("has_author") == 1, _c("has_publish_date") == 1
    terms = [
        F.lit(50),
        _pts(_c("is_unreliable_domain") == 1, 40),                                   # P2
        _pts(_c("is_trusted_domain") == 1, -55),                                     # P3
        _pts(author, -15),                                                           # P4
        _pts(date, -10),                                                             # P5
        F.when(q >= 3, F.lit(-10)).when(q >= 1, F.lit(-5)).otherwise(F.lit(0)),      # P6
        _pts(_c("has_common_tld") == 1, -3),                                         # P7
        F.when((kw > 2) | (pat > 1), F.lit(25))                                      # P8
         .when((kw > 0) | (pat > 0), F.lit(10)).otherwise(F.lit(0)),
        F.when(emo > 0.1, F.lit(20)).when(emo > 0.06, F.lit(10)).otherwise(F.lit(0)),  # P9
        _pts(_c("title_caps_ratio") > 0.5, 15),                                      # P10
        F.when((subj >= 0.3) & (subj <= 0.6), F.lit(-5))                            # P11
         .when(subj > 0.8, F.lit(8)).otherwise(F.lit(0)),
        F.when(cap > 0.2, F.lit(15)).when(cap > 0.15, F.lit(8)).otherwise(F.lit(0)),  # P12
        _pts(~author & ~date, 12),                                                   # P13
        _pts(wc < 100, 10),                                                          # P14 (first block)
        F.when((fl >= 40) & (fl <= 70), F.lit(-5))                                   # P15
         .when((fl < 20) | (fl > 90), F.lit(8)).otherwise(F.lit(0)),
        F.when(wc >= 300, F.lit(-5)).when(wc < 100, F.lit(5)).otherwise(F.lit(0)),   # P14 (second block)
        _pts(_c("paragraph_count") >= 5, -3),                                        # P16
        _pts(_c("exclamation_ratio") > 0.02, 8),                                     # P16
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def rule_score() -> Column:
    """clamp(points, 0, 100) / 100 as double."""
    return F.greatest(F.lit(0), F.least(F.lit(100), rule_points())).cast("double") / F.lit(100.0)


def softmax_fake_probability(real_logit: Column, fake_logit: Column) -> Column:
    """Softmax over [REAL, FAKE] logits -> P(FAKE), numerically stable."""
    m = F.greatest(real_logit, fake_logit)
    er, ef = F.exp(real_logit - m), F.exp(fake_logit - m)
    return ef / (er + ef)


def base_label(p_fake: Column, threshold: float = DEFAULT.confidence_threshold, uncertain: bool = True) -> Column:
    """Argmax label of a base probability (tie -> REAL), with
    UNCERTAIN below the confidence threshold unless ``uncertain`` is off."""
    pr = F.round(p_fake, COMPARE_PLACES)
    label = F.when(pr > 0.5, F.lit("FAKE")).otherwise(F.lit("REAL"))
    conf = F.greatest(pr, F.lit(1.0) - pr)
    if uncertain:
        label = F.when(conf < threshold, F.lit("UNCERTAIN")).otherwise(label)
    return F.when(p_fake.isNull(), F.lit("ERROR")).otherwise(label)


def base_verdict(df: DataFrame, p_col: str = "base_fake_probability", params: Params = DEFAULT) -> DataFrame:
    """P20: the base model's own verdict columns."""
    p = F.col(p_col)
    return df.select(
        "*",
        base_label(p, params.confidence_threshold).alias("base_prediction"),
        F.greatest(p, F.lit(1.0) - p).alias("base_confidence"),
        (F.round(p, COMPARE_PLACES) > 0.5).alias("is_fake"),
        (F.round(p, COMPARE_PLACES) <= 0.5).alias("is_real"),
    )


def ensemble(df: DataFrame, p_col: str = "base_fake_probability", params: Params = DEFAULT) -> DataFrame:
    """Trust overrides, blend, verdict.  Adds ``feature_score``,
    ``fake_probability``, ``real_probability``, ``confidence``, ``prediction``,
    ``bert_prediction`` and ``model_used``.

    Rows decided by an override never need the base model: callers that
    compute the probability with a model can restrict it to
    ``needs_base_model()`` rows (see ``plans.pipeline``).
    """
    trusted = F.col("is_trusted_domain") == 1
    author, date = F.col("has_author") == 1, F.col("has_publish_date") == 1
    full = trusted & author & date
    partial = trusted & (author | date) & (F.col("word_count") > 200)
    base = F.col(p_col)
    rs = rule_score()
    blend = F.lit(params.base_weight) * base + F.lit(params.feature_weight) * rs
    staged = df.select("*", rs.alias("_rs"), blend.alias("_blend"), full.alias("_full"), partial.alias("_partial"))
    b = F.col("_blend")
    br = F.round(b, COMPARE_PLACES)
    conf_b = F.greatest(b, F.lit(1.0) - b)
    conf_r = F.greatest(br, F.lit(1.0) - br)
    label = (F.when(conf_r < params.confidence_threshold, F.lit("UNCERTAIN"))
             .when(br > 0.5, F.lit("FAKE")).otherwise(F.lit("REAL")))
    f, pa = F.col("_full"), F.col("_partial")
    err = base.isNull() & ~f & ~pa
    out = staged.select(
        *[F.col(c) for c in df.columns],
        F.when(f | pa, F.lit(0.0)).otherwise(F.col("_rs")).alias("feature_score"),
        F.when(f, F.lit(0.10)).when(pa, F.lit(0.18)).otherwise(b).alias("fake_probability"),
        F.when(f, F.lit(0.90)).when(pa, F.lit(0.82)).otherwise(F.lit(1.0) - b).alias("real_probability"),
        F.when(f, F.lit(0.90)).when(pa, F.lit(0.82)).when(err, F.lit(0.0)).otherwise(conf_b).alias("confidence"),
        F.when(f | pa, F.lit("REAL")).when(err, F.lit("ERROR")).otherwise(label).alias("prediction"),
        base_label(base, params.confidence_threshold).alias("bert_prediction"),
        F.when(f, F.lit(MODEL_OVERRIDE_FULL)).when(pa, F.lit(MODEL_OVERRIDE_PARTIAL))
         .otherwise(F.lit(MODEL_ENSEMBLE)).alias("model_used"),
    )
    return out


def needs_base_model() -> Column:
    """True for rows whose verdict depends on the base probability."""
    trusted = F.col("is_trusted_domain") == 1
    author, date = F.col("has_author") == 1, F.col("has_publish_date") == 1
    return ~((trusted & author & date) | (trusted & (author | date) & (F.col("word_count") > 200)))


def truncate_tokens(ws: Column, max_tokens: int = DEFAULT.max_tokens) -> Column:
    """The first ``max_tokens`` tokens (word-level)."""
    return F.slice(ws, 1, max_tokens)
