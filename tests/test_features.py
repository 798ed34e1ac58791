import math

import pytest
from pyspark.sql import functions as F

from bruteforce import features as brute
from conftest import SF
from credence.operators.features import ALL_FEATURES, extract_features
from credence.plans import pipeline as pl

SCHEMA = ("id INT, text STRING, title STRING, domain STRING, authors ARRAY<STRING>, publish_date STRING, "
          "images ARRAY<STRING>, meta_description STRING, keywords ARRAY<STRING>, summary STRING")


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = extract_features(df, keep_content=False, **kw).orderBy("id").collect()
    return [r.asDict() for r in out]


def row(i, text="", title="", domain="", authors=None, date=None, images=None, meta=None, keywords=None,
        summary=None):
    return (i, text, title, domain, authors, date, images, meta, keywords, summary)


def test_47_features(spark):
    assert len(ALL_FEATURES) == 47
    out = run(spark, [row(1, "Hello world.")])
    assert set(out[0]) == {"id", *ALL_FEATURES}


def test_empty_and_whitespace_text(spark):
    a, b = run(spark, [row(1, ""), row(2, "   \n  ")])
    for k in ALL_FEATURES:
        if k == "paragraph_count":
            assert a[k] == 1
        elif k in ("has_common_tld",):
            continue
        else:
            assert a[k] == 0, k
    assert b["text_length"] == 6 and b["word_count"] == 0
    assert b["exclamation_ratio"] == 0 and b["emotional_word_ratio"] == 0 and b["url_ratio"] == 0
    assert b["flesch_reading_ease"] == 0


def test_single_word_is_one_sentence(spark):
    (a,) = run(spark, [row(1, "Hello")])
    assert a["word_count"] == 1 and a["sentence_count"] == 1


def test_null_defaults_and_empty_author(spark):
    a, b = run(spark, [row(1, "Some text here", None, None, None, None, None, None),
                       row(2, "x", "t", "d", [""], None, None, "")])
    assert a["title_length"] == 0 and a["has_author"] == 0 and a["meta_description_length"] == 0
    assert b["has_author"] == 1 and b["author_count"] == 1


def test_domains(spark):
    doms = ["sometime.com", "www.bbc.com", "bbc.co.uk", "bbc.com:8080", "infowars.com"]
    out = run(spark, [row(i, "t", domain=d) for i, d in enumerate(doms)])
    assert [r["is_trusted_domain"] for r in out] == [1, 1, 1, 1, 0]
    assert [r["is_unreliable_domain"] for r in out] == [0, 0, 0, 0, 1]
    assert [r["has_common_tld"] for r in out] == [1, 1, 0, 0, 1]


def test_suffix_domain_mode(spark):
    from credence.params import DEFAULT
    from dataclasses import replace
    out = run(spark, [row(1, "t", domain="sometime.com"), row(2, "t", domain="news.bbc.co.uk")],
              params=replace(DEFAULT, domain_match="suffix"))
    assert [r["is_trusted_domain"] for r in out] == [0, 1]


def test_quotes(spark):
    texts = ['a"', 'a"b"', 'a"b"c"', 'a"b"c"d"', "a“b”"]
    out = run(spark, [row(i, t) for i, t in enumerate(texts)])
    assert [r["quote_count"] for r in out] == [1, 3, 4, 6, 0]


def test_paragraphs(spark):
    out = run(spark, [row(1, "\n\n".join(["p one", "p two", "p three", "p four", "p five"])),
                      row(2, "a\n \nb")])
    assert out[0]["paragraph_count"] == 5 and out[1]["paragraph_count"] == 1


def test_title_caps_urls_trailing(spark):
    out = run(spark, [row(1, "see https://a.com/x?y=1 and http://b.org!", "SHOCKING: 10 I U.S. Foo"),
                      row(2, "x", "Wait..."), row(3, "x", "Wait!"), row(4, "x", "Wait…")])
    assert out[0]["title_caps_ratio"] == pytest.approx(2 / 5)
    assert out[0]["url_count"] == 2
    assert [r["title_trailing_punctuation"] for r in out[1:]] == [1, 0, 1]


def test_sentiment_negation_and_intensifier(spark):
    out = run(spark, [row(1, "This is very good"), row(2, "This is not good"), row(3, "nothing here")])
    # "very" intensifies "good" (0.4 * 1.25)
    assert out[0]["text_polarity"] == pytest.approx(0.4 * 1.25)
    assert out[1]["text_polarity"] == pytest.approx(0.4 * -0.5)
    assert out[2]["text_polarity"] == 0 and out[2]["text_subjectivity"] == 0


def test_against_brute_force_on_corpus(spark):
    """Every feature of every sf0.001 document equals the plain-Python rules."""
    content = pl.document_content(spark, SF)
    got = {r["doc_id"]: r.asDict() for r in extract_features(content).collect()}
    assert got
    for d, r in got.items():
        exp = brute(r["text"], r["title"], r["domain"])
        for k in ALL_FEATURES:
            a, b = r[k], exp[k]
            if isinstance(b, float):
                assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (d, k, a, b)
            else:
                assert a == b, (d, k, a, b)


def test_plan_is_narrow_and_jvm_only(spark):
    """The feature projection has no Python UDF, no shuffle beyond the
    optional round-robin, and uses hash InSet lookups for word lists."""
    from credence.sources import tables as tb
    content = tb.text_intake(tb.documents(spark, SF))
    plan = extract_features(content)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Exchange" not in plan
    assert "INSET" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in extract_features(content)._jdf.queryExecution() \
        .executedPlan().toString() or "text" in plan


def test_feature_summary(spark):
    from credence.operators.features import feature_summary
    df = extract_features(spark.createDataFrame([row(1, "Hello world. Fine day!", "T", "bbc.com")], SCHEMA))
    s = df.select(feature_summary(df).alias("s")).first()["s"]
    assert s.startswith("Text length: 4 words | Sentiment: ")
    assert s.endswith("Clickbait indicators: 0 | Trusted domain: Yes")


ODD = ["", " ", "Ate an apple. Ago era. Aba 'ice' -- don't queue!", "One.Two. 'Three.') Four?! five ... Six", "x　Y z\x85 \x1c w\n\n\n v.",
       "Été été ǅx Ⓐb ⓐb ßa İstanbul 漢字 NASA U.S. ΟΔΟΣ.", "  lead.  trail. ", ".)!) a. \". b", "aaaa eeee bcdf theee queue's"]


def test_text_primitives_without_a_look_at_each_token(spark):
    """The whole-text forms against the token by token ones, in Spark."""
    from credence.functions import text as tx
    from credence.operators.features import sentiment_letters
    df = spark.createDataFrame([(t,) for t in ODD], "t STRING")
    w = F.array_remove(F.split(F.translate("t", tx.WS_CHARS, " " * len(tx.WS_CHARS)), " +"), "")
    d = df.select("t", tx.materialize(w).alias("w"), tx.spaced(F.col("t")).alias("s"))
    ends = tx.sentence_end_flags(F.col("w"))
    cap = lambda x: tx.is_capitalised(x) & (F.length(x) > 1)
    letters = F.replace(sentiment_letters(F.lower("s")), F.lit("'"), F.lit(""))
    got = d.select(
        "w", tx.words(F.col("t")).alias("w2"),
        tx.sentence_count_from_flags(ends).alias("s1"), tx.sentence_count(F.col("s")).alias("s2"),
        F.filter("w", cap).alias("c1"), tx.capitalised(F.col("s")).alias("c2"),
        F.filter(tx.sentence_starts_from_flags(F.col("w"), ends), cap).alias("b1"), tx.capitalised_starts(F.col("s")).alias("b2"),
        F.size(F.filter("w", lambda x: tx.is_all_caps(x) & (F.length(x) > 1))).alias("a1"), tx.all_caps_count(F.col("s")).alias("a2"),
        F.aggregate(F.transform("w", tx.syllables), F.lit(0), lambda a, x: a + x).alias("y1"),
        tx.total_syllables(letters, F.size("w")).alias("y2")).collect()
    for r in got:
        assert (r.w, r.s1, r.c1, r.b1, r.a1, r.y1) == (r.w2, r.s2, r.c2, r.b2, r.a2, r.y2), r


def test_features_look_at_no_token_with_a_regex(spark):
    plan = extract_features(spark.createDataFrame([row(1, "a")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "transform(split" not in plan and "regexp_replace(lower(lambda" not in plan
