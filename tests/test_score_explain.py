import pytest
from pyspark.sql import functions as F

from credence.operators.explain import explain
from credence.operators.features import ALL_FEATURES, FEATURE_TYPES
from credence.operators.score import ensemble, rule_points, rule_score
from credence.params import MODEL_ENSEMBLE, MODEL_OVERRIDE_FULL, MODEL_OVERRIDE_PARTIAL

NEUTRAL = {f: (0.0 if FEATURE_TYPES[f] == "double" else 0) for f in ALL_FEATURES}
# a neutral row: 150 words, readability in no band, one paragraph, no author/date
NEUTRAL.update(word_count=150, flesch_reading_ease=75.0, paragraph_count=1)


def frame(spark, rows):
    cols = ["id", *ALL_FEATURES, "base_fake_probability", "title", "authors"]
    data = []
    for i, r in enumerate(rows):
        f = dict(NEUTRAL)
        f.update({k: v for k, v in r.items() if k in f})
        data.append((i, *[f[c] for c in ALL_FEATURES], r.get("base", 0.5), r.get("title", ""), r.get("authors", [])))
    schema = ", ".join(["id INT"] + [f"{c} {'DOUBLE' if FEATURE_TYPES[c] == 'double' else 'INT'}" for c in ALL_FEATURES]
                       + ["base_fake_probability DOUBLE", "title STRING", "authors ARRAY<STRING>"])
    return spark.createDataFrame(data, schema).select(*cols)


def points(spark, rows):
    return [r[0] for r in frame(spark, rows).select(rule_points()).collect()]


def test_neutral_points(spark):
    # 50 + no author&date (+12) + flesch 75 (0) + 150 words (0)
    assert points(spark, [{}]) == [62]


def test_word_count_bounds(spark):
    got = points(spark, [{"word_count": w} for w in (99, 100, 299, 300)])
    assert got == [62 + 15, 62, 62, 62 - 5]


def test_flesch_bounds(spark):
    got = points(spark, [{"flesch_reading_ease": v} for v in (19.99, 20.0, 40.0, 70.0, 70.01, 90.0, 90.01)])
    assert got == [70, 62, 57, 57, 62, 62, 70]


def test_subjectivity_bounds(spark):
    got = points(spark, [{"text_subjectivity": v} for v in (0.29, 0.3, 0.6, 0.61, 0.8, 0.81)])
    assert got == [62, 57, 57, 62, 62, 70]


def test_other_terms(spark):
    rows = [{"is_unreliable_domain": 1}, {"is_trusted_domain": 1}, {"has_author": 1}, {"has_publish_date": 1},
            {"quote_count": 1}, {"quote_count": 3}, {"has_common_tld": 1}, {"clickbait_keyword_count": 1},
            {"clickbait_pattern_count": 2}, {"clickbait_keyword_count": 3}, {"emotional_word_ratio": 0.07},
            {"emotional_word_ratio": 0.11}, {"title_caps_ratio": 0.5}, {"title_caps_ratio": 0.51},
            {"capital_ratio": 0.16}, {"capital_ratio": 0.21}, {"paragraph_count": 5}, {"exclamation_ratio": 0.021}]
    exp = [102, 7, 62 - 15 - 12, 62 - 10 - 12, 57, 52, 59, 72, 87, 87, 72, 82, 62, 77, 70, 77, 59, 70]
    assert points(spark, rows) == exp


def test_clamp(spark):
    df = frame(spark, [{"is_trusted_domain": 1, "has_author": 1, "has_publish_date": 1, "quote_count": 5}])
    assert df.select(rule_score()).first()[0] == 0.0


def verdicts(spark, rows):
    out = ensemble(frame(spark, rows)).orderBy("id").collect()
    return [(r.prediction, r.confidence, r.model_used) for r in out]


def test_overrides(spark):
    full = {"is_trusted_domain": 1, "has_author": 1, "has_publish_date": 1}
    part = {"is_trusted_domain": 1, "has_author": 1, "word_count": 201}
    not_part = {"is_trusted_domain": 1, "has_author": 1, "word_count": 200}
    got = verdicts(spark, [full, part, not_part])
    assert got[0] == ("REAL", 0.9, MODEL_OVERRIDE_FULL)
    assert got[1] == ("REAL", 0.82, MODEL_OVERRIDE_PARTIAL)
    assert got[2][2] == MODEL_ENSEMBLE


def test_blend_thresholds(spark):
    # base 0.5 -> blend = 0.2 + 0.6 * rule; rule 0.55 -> 0.53 exactly: FAKE (not UNCERTAIN)
    # rule 0.50 -> 0.5: REAL by argmax but confidence 0.5 < 0.53 -> UNCERTAIN
    rows = [{"word_count": 150, "flesch_reading_ease": 75.0, "has_common_tld": 1, "paragraph_count": 5,
             "exclamation_ratio": 0.03, "quote_count": 1, "title_caps_ratio": 0.0}]
    df = frame(spark, rows)
    assert df.select(rule_points()).first()[0] == 62 - 3 - 3 + 8 - 5
    out = ensemble(frame(spark, [{"base": 0.5, "has_common_tld": 1, "paragraph_count": 5, "exclamation_ratio": 0.03,
                                  "quote_count": 1}]).withColumn("base_fake_probability", F.lit(0.5))).first()
    assert out.feature_score == pytest.approx(0.59)
    b = ensemble(frame(spark, [{}]).withColumn("base_fake_probability", F.lit((0.53 - 0.6 * 0.62) / 0.4))).first()
    assert b.prediction == "FAKE" and b.confidence == pytest.approx(0.53)
    c = ensemble(frame(spark, [{}]).withColumn("base_fake_probability", F.lit((0.5 - 0.6 * 0.62) / 0.4))).first()
    assert c.prediction == "UNCERTAIN"


def test_null_base_is_error_unless_override(spark):
    df = frame(spark, [{}, {"is_trusted_domain": 1, "has_author": 1, "has_publish_date": 1}]).withColumn(
        "base_fake_probability", F.lit(None).cast("double"))
    got = [r.prediction for r in ensemble(df).orderBy("id").collect()]
    assert got == ["ERROR", "REAL"]


def test_explanation_factors_and_scores(spark):
    rows = [{"is_trusted_domain": 1, "is_unreliable_domain": 1, "has_author": 1, "authors": ["A", "B", "C"],
             "has_publish_date": 1, "quote_count": 3, "flesch_reading_ease": 50.0},
            {"is_unreliable_domain": 1, "clickbait_keyword_count": 2, "title": "You won't believe this MUST SEE",
             "exclamation_ratio": 0.02, "exclamation_count": 4, "capital_ratio": 0.2, "url_ratio": 0.06,
             "text_subjectivity": 0.75, "emotional_word_ratio": 0.04, "text_polarity": -0.6, "word_count": 150,
             "flesch_reading_ease": 10.0}]
    out = explain(ensemble(frame(spark, rows))).orderBy("id").collect()
    a, b = out
    assert [f.factor for f in a.positive_factors] == ["Trusted Domain", "Author Present", "Publication Date",
                                                     "Citations Present", "Appropriate Readability", "Objective Tone"]
    assert a.positive_factors[1].description == "✓ Written by: A, B"
    assert a.negative_factors == [] and a.credibility_score == 100
    assert [f.factor for f in b.negative_factors] == [
        "Unreliable Domain", "No Author", "Missing Date", "Lacks Citations", "Unusual Readability",
        "Excessive Capitalization", "Excessive URLs", "High Subjectivity", "Emotional Language",
        "Extreme Sentiment", "Clickbait Language", "Excessive Punctuation"]
    assert b.negative_factors[10].description == "⚠ Title contains clickbait language ('you won't believe, must see')"
    assert b.credibility_score == 0
    # stable sort by importance: critical, high, then medium in list order
    assert b.key_concerns == ["⚠ Unreliable Domain", "⚠ Clickbait Language", "⚠ No Author",
                              "⚠ Lacks Citations", "⚠ Excessive Capitalization"]
    assert len(b.recommendations) == 6
    assert b.factor_count.negative == 12


def test_summary_templates(spark):
    out = explain(ensemble(frame(spark, [{}]))).first()
    assert "Credibility score: " in out.summary
