import re

import __spark_entry__ as entry

SURVEY_KEYS = """tokenize sentence_stats structural_features syllable_count keyword_hits page_content url_validation
url_domain page_extract top_keywords extractive_summary extract_fallback size_guard quarantine text_intake
combined_text labelled_corpus analysis_response linguistic_features sentiment_features readability_features
source_features clickbait_features metadata_features feature_summary all_features rule_score base_classifier
truncate_text softmax_argmax base_verdict batch_classify ensemble_verdict source_factors quality_factors
sentiment_factors clickbait_factors explanation credibility_score summary_text key_concerns recommendations
factor_preview cache_key cache_upsert cache_lookup cache_misses cache_stats stream_score cache_ttl rate_check
eval_details confusion_matrix classification_metrics latency_stats prediction_distribution eval_report
tolerant_accuracy credibility_gap enriched_features enriched_verdict enriched_explanation enriched_details
evaluation_record classifier_verdict cache_serve cache_expiry rolling_rate learned_abbreviations
learned_sentence_stats learned_lexicon learned_sentiment source_table subword_truncate document_classify
response_sink evaluation_sink""".split()
#: trained models and a tokenizer are beyond SQL
NO_SQL = {"base_classifier", "classifier_verdict", "subword_truncate", "document_classify"}


def own(keys):
    """Without the training-data queries, which have tests of their own."""
    return {k: v for k, v in keys.items() if k != "pipeline" and not re.match(r"op[0-9]+_", k)}


def test_every_key_registered():
    q, s = own(entry.queries()), own(entry.oracle_sql())
    assert sorted(q) == sorted(SURVEY_KEYS)
    assert set(s) <= set(q)
    assert set(q) - set(s) == NO_SQL


def test_maps_load_without_jars(monkeypatch):
    """No lookup of files next to pyspark is needed to build the SQL."""
    import glob
    import zipfile

    def fail(*a, **k):
        raise RuntimeError("no such file here")

    monkeypatch.setattr(glob, "glob", fail)
    monkeypatch.setattr(zipfile, "ZipFile", fail)
    assert set(own(entry.oracle_sql())) == set(own(entry.queries())) - NO_SQL


def test_one_broken_key_costs_one_key(monkeypatch):
    from oracle import queries as oq

    before = set(entry.oracle_sql())
    monkeypatch.setitem(oq.SQL, "tokenize", lambda: 1 / 0)
    assert set(entry.oracle_sql()) == before - {"tokenize"}


def test_building_evaluation_queries_starts_no_job(spark):
    from conftest import SF

    seen = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for key in ("eval_details", "confusion_matrix", "classification_metrics", "prediction_distribution",
                "tolerant_accuracy"):
        spark.read.parquet(f"{SF}/documents.parquet")
        n = seen()
        entry.queries()[key](spark, SF)
        # reading a file's schema is a job of its own; no table row is touched
        assert seen() - n <= 4, key


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r.label for r in rows} == {"REAL", "FAKE", "UNCERTAIN"}
    assert sum(r.n for r in rows) > 0


def test_base_classifier_held_out_accuracy(spark):
    """Fitted on three quarters of the labelled texts, judged on the rest."""
    from pyspark.sql import functions as F
    from credence.operators import classifier as clf
    from credence.plans.catalog import _labelled_model_text
    lab = _labelled_model_text(spark, "/root/testdata/sf0.01").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    model = clf.fit(lab.where("fold < 3"))
    out = clf.predict(model, lab.where("fold = 3"), batch=True)
    r = out.agg(F.avg((F.col("base_prediction") == F.col("label")).cast("double")).alias("acc"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.acc >= 0.85


def test_every_branch_is_reached(spark):
    """Rows that reach overrides, errors, factors and metadata features."""
    from pyspark.sql import functions as F
    from conftest import SF
    q = entry.queries()
    v = q["enriched_verdict"](spark, SF)
    assert {r.model_used for r in v.select("model_used").distinct().collect()} == {
        "Ensemble (BERT + Features) - Trusted Source Override", "Ensemble (BERT + Features) - Trusted Source", "Ensemble (BERT + Features)"}
    assert {r[0] for r in v.select("prediction").distinct().collect()} >= {"REAL", "FAKE", "UNCERTAIN", "ERROR"}
    assert {r[0] for r in v.select("bert_prediction").distinct().collect()} == {"REAL", "FAKE", "UNCERTAIN", "ERROR"}
    f = q["enriched_features"](spark, SF)
    names = ("url_count", "quote_count", "paragraph_count", "is_trusted_domain", "is_unreliable_domain", "has_author", "author_count", "has_publish_date",
             "image_count", "has_images", "clickbait_keyword_count", "has_clickbait", "title_has_numbers", "clickbait_pattern_count",
             "title_trailing_punctuation", "has_meta_description", "meta_description_length", "has_keywords", "keyword_count", "has_summary",
             "emotional_word_count")
    r = f.agg(*[F.max(n).alias(n) for n in names]).first()
    assert all(r[n] > 0 for n in names) and r.author_count == 3 and r.paragraph_count > 1
    e = q["enriched_explanation"](spark, SF)
    summaries = {x[0][:18] for x in e.select("summary").collect()}
    assert len(summaries) == 5, summaries
    assert {r[0] for r in q["enriched_details"](spark, SF).select("true_label").distinct().collect()} == {"REAL", "FAKE", "UNCERTAIN"}
    assert "scored" in {r[0] for r in q["quarantine"](spark, SF).select("source").distinct().collect()}
    for key in ("rate_check", "cache_ttl"):
        assert not q[key](spark, SF).isEmpty(), key


def test_external_model_plugin_and_override_skip(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from credence.operators import classifier as clf
    from credence.operators.score import needs_base_model

    def make():
        def predict(texts):
            return np.array([min(1.0, len(t) / 1000.0) for t in texts], dtype=np.float64)
        return predict

    udf = clf.external_model(make)
    df = spark.createDataFrame([("a" * 100,), ("b" * 2000,)], "text STRING")
    got = [r[0] for r in df.select(udf("text")).collect()]
    assert got == [0.1, 1.0]
    rows = spark.createDataFrame([(1, 1, 1, 10), (0, 0, 0, 10)],
                                 "is_trusted_domain INT, has_author INT, has_publish_date INT, word_count INT")
    assert [r[0] for r in rows.select(needs_base_model()).collect()] == [False, True]


def test_lexicon_table_join(spark):
    """The joined lexicon gives what the inlined one does, repeated words
    and nulls included."""
    from conftest import SF
    from credence.operators.features import extract_features, lexicon_sentiment
    from credence.params import DEFAULT
    rows = [(w, p, s, i) for w, p, s, i in DEFAULT.lexicon] + [("GOOD", 0.4, 0.5, 1.0), (None, 1.0, 1.0, 1.0)]
    lex = spark.createDataFrame(rows, "word STRING, polarity DOUBLE, subjectivity DOUBLE, intensity DOUBLE")
    docs = spark.createDataFrame(
        [(-1, "very good, not bad; never extremely terrible"), (-2, None), (-3, ""), (-4, "no hit"), (-5, "so new old good")], "doc_id LONG, text STRING"
    ).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = {r.doc_id: (round(r.text_polarity, 9), round(r.text_subjectivity, 9))
            for r in extract_features(docs, DEFAULT, groups=["sentiment"]).collect()}
    got = {r.doc_id: (round(r.polarity, 9), round(r.subjectivity, 9)) for r in lexicon_sentiment(docs, "doc_id", "text", lex).collect()}
    assert got == want and got[-1] != (0.0, 0.0)


def test_model_runs_only_where_needed(spark):
    from pyspark.sql import functions as F
    from conftest import SF01
    from credence.operators import classifier as clf
    from credence.plans import pipeline as pl
    from credence.sources import tables as tb
    model = clf.fit(tb.labelled_content(spark, SF01))
    rows = [(1, "A long text. " * 30, "T", "bbc.com", ["X"], "2020"), (2, "Short text here, nothing more.", "T", "x.xyz", [], None)]
    content = spark.createDataFrame(rows, "id INT, text STRING, title STRING, domain STRING, authors ARRAY<STRING>, "
                                          "publish_date STRING")
    out = {r.id: r for r in pl.score_with_classifier(content, model).collect()}
    assert out[1].prediction == "REAL" and out[1].bert_prediction == pl.MODEL_NOT_RUN
    assert out[1].base_fake_probability is None
    assert out[2].bert_prediction != pl.MODEL_NOT_RUN and out[2].base_fake_probability is not None
